"""Commits that two writers make at once, or that one never finishes; coverage and plans."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest

from panelforge.sources import ledger

D = dt.date


def rows(spark, *values):
    return spark.createDataFrame([(s, D(2024, m, d), float(v)) for s, m, d, v in values], "symbol string, date date, close double")


def told(df):
    return sorted((r["symbol"], r["date"].month, r["date"].day, r["close"]) for r in df.collect())


def test_two_writers_lose_nothing(spark, tmp_path):
    stores = [ledger.CommitStore(spark, str(tmp_path), "bars") for _ in range(6)]
    with ThreadPoolExecutor(6) as pool:
        names = list(pool.map(lambda k: stores[k].put(rows(spark, (f"s{k}", 1, 1, k), ("all", 1, 2, k))), range(6)))
    log = stores[0].log()
    assert sorted(names) == sorted(e["name"] for e in log)
    got = told(stores[0].get())
    assert [r for r in got if r[0] != "all"] == [(f"s{k}", 1, 1, float(k)) for k in range(6)]
    assert [r[3] for r in got if r[0] == "all"] == [float(names.index(log[-1]["name"]))]
    with ThreadPoolExecutor(4) as pool:  # folding beside writers
        list(pool.map(lambda k: stores[0].compact() if k == 1 else stores[k].put(rows(spark, (f"t{k}", 1, 1, k))), range(4)))
    assert told(stores[0].get()) == sorted([*got, *((f"t{k}", 1, 1, float(k)) for k in (0, 2, 3))])
    late = stores[1].put(rows(spark, ("all", 1, 2, 99)))
    assert late == stores[0].log()[-1]["name"] and ("all", 1, 2, 99.0) in told(stores[0].get())


def test_a_writer_that_dies_before_its_number_leaves_what_counted(spark, tmp_path, monkeypatch):
    s = ledger.CommitStore(spark, str(tmp_path), "bars")
    s.put(rows(spark, ("a", 1, 1, 1)))
    with monkeypatch.context() as m:
        m.setattr(ledger.CommitStore, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            s.put(rows(spark, ("a", 1, 1, 2)))
    assert told(s.get()) == [("a", 1, 1, 1.0)]
    s.put(rows(spark, ("a", 1, 1, 3)))
    assert told(s.get()) == [("a", 1, 1, 3.0)]


def test_reads_as_known_at_a_time(spark, tmp_path):
    s = ledger.CommitStore(spark, str(tmp_path), "bars")
    assert s.get() is None and s.log() == []
    s.put(rows(spark, ("a", 1, 5, 1), ("a", 2, 5, 1)), 10.0)
    s.put(rows(spark, ("a", 2, 5, 2), ("a", 3, 5, 2)), 20.0)
    s.prune("2024-02", 30.0)
    s.put(rows(spark, ("a", 3, 6, 9)), 40.0)
    assert s.get(known_at=5.0) is None
    assert told(s.get(known_at=10.0)) == [("a", 1, 5, 1.0), ("a", 2, 5, 1.0)]
    assert told(s.get(known_at=29.0)) == [("a", 1, 5, 1.0), ("a", 2, 5, 2.0), ("a", 3, 5, 2.0)]
    assert told(s.get(known_at=35.0)) == [("a", 1, 5, 1.0)]
    want = [("a", 1, 5, 1.0), ("a", 3, 6, 9.0)]
    assert told(s.get()) == want
    s.compact(50.0)
    assert told(s.get()) == want and told(s.get(known_at=29.0))[1] == ("a", 2, 5, 2.0)
    s.put(rows(spark, ("a", 1, 5, 7)), 60.0)
    assert told(s.get()) == [("a", 1, 5, 7.0), want[1]] and told(s.get("2024-02-01", "2024-03-06")) == [want[1]]


def test_the_current_month_is_never_covered_and_gaps_become_calls(spark):
    symbols = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "symbol string")
    covered = spark.createDataFrame([("a", "2024-01"), ("a", "2024-04"), ("b", "2024-01"), ("b", "2024-04"), ("c", "2023-12"), ("c", "2024-02"), ("c", "2024-05")], "symbol string, ym string")
    lacking = ledger.missing(ledger.months(symbols, "2023-12-15", "2024-05-02"), covered, "2024-05-20")
    gaps = sorted(map(tuple, ledger.ranges(lacking).select("symbol", "first", "last", "n").collect()))
    assert gaps == [("a", "2023-12", "2023-12", 1), ("a", "2024-02", "2024-03", 2), ("a", "2024-05", "2024-05", 1), ("b", "2023-12", "2023-12", 1), ("b", "2024-02", "2024-03", 2), ("b", "2024-05", "2024-05", 1), ("c", "2024-01", "2024-01", 1), ("c", "2024-03", "2024-05", 3)]
    calls = sorted((r["first"], r["last"], r["call"], r["symbols"], r["months"]) for r in ledger.plan(ledger.ranges(lacking), 2, 3).collect())
    assert calls == [("2023-12", "2023-12", 0, ["a", "b"], 2), ("2024-01", "2024-01", 0, ["c"], 1), ("2024-02", "2024-03", 0, ["a"], 2), ("2024-02", "2024-03", 1, ["b"], 2), ("2024-03", "2024-05", 0, ["c"], 3), ("2024-05", "2024-05", 0, ["a", "b"], 2)]
