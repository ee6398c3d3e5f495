"""A store of commits: every write adds rows beside the old ones, and a log says which count.

``{root}/{kind}/data/{commit}`` holds a commit's rows by month, ``{root}/{kind}/log/{number}-{name}`` is its entry, written aside
and then renamed, so it is there whole or not at all.  A writer takes the number after the greatest that it sees, and its entry's
name is its own: two writers at once may share a number, but never a file, so neither loses anything on any file system, and
their order is that of their names.  One that dies before its entry leaves only a folder that nobody reads.  Reads take the entries in
order, and of equal keys the newest row: all of them, or those known at a time.  ``compact`` folds entries into one that names
them, so what is put meanwhile still counts.  The log is read by the driver: a line an entry not yet folded.

Coverage is a ledger of its own: (symbol, month) pairs that were fetched, with or without rows.  The current month is never
covered, as it can still grow; what a pair lacks is planned as ranges of months, grouped by equal ranges and cut to a workload.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.joins import keep_last
from .shards import safe_segment


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class CommitStore:
    """Rows with a ``time`` column by which months are cut, and a key."""

    def __init__(self, spark: SparkSession, root: str, kind: str, time: str = "date", key: tuple[str, ...] = ("symbol", "date")):
        self.spark, self.time, self.key = spark, time, list(key)
        self.path = f"{root}/{safe_segment(kind)}"

    def log(self, known_at: float | None = None) -> list[dict]:
        """Entries that count, in order, of those known at a time (seconds): name, number, data, at, rule."""
        fs, p = _fs(self.spark, f"{self.path}/log")
        if not fs.exists(p) or not fs.listStatus(p):
            return []
        texts = self.spark.read.option("wholetext", True).text(f"{self.path}/log").select("value").collect()
        got = [e for e in (json.loads(r["value"]) for r in texts) if known_at is None or e["at"] <= known_at]
        folded = {name for e in got for name in e["folds"]}
        return sorted((e for e in got if e["name"] not in folded), key=lambda e: (e["number"], e["rule"] != "whole", e["name"]))

    def _commit(self, entry: dict, at: float | None, number: int | None = None) -> str:
        """Adds an entry; returns its name."""
        name = uuid.uuid4().hex
        if number is None:
            number = max((e["number"] for e in self.log()), default=-1) + 1
        full = {"folds": []} | entry | {"name": name, "number": number, "at": time.time() if at is None else at}
        fs, aside = _fs(self.spark, f"{self.path}/aside/{name}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(full).encode()))
        out.close()
        _, place = _fs(self.spark, f"{self.path}/log/{number:012d}-{name}")
        fs.mkdirs(place.getParent())
        if not fs.rename(aside, place):
            raise OSError(f"no entry {place}")
        return name

    def write(self, rows: DataFrame) -> str:
        """The rows beside the others, not yet counted; returns their name."""
        name = uuid.uuid4().hex
        rows.withColumn("ym", F.date_format(self.time, "yyyy-MM")).repartition("ym").sortWithinPartitions("ym", *self.key).write.partitionBy("ym").parquet(f"{self.path}/data/{name}")
        return name

    def put(self, rows: DataFrame, at: float | None = None) -> str:
        return self._commit({"data": self.write(rows), "rule": "put"}, at)

    def prune(self, month: str, at: float | None = None) -> str:
        """What was stored of ``month`` and later no longer counts; rows put afterwards do."""
        return self._commit({"data": None, "rule": "prune", "month": month}, at)

    def get(self, start: str | None = None, end: str | None = None, known_at: float | None = None, _log: list[dict] | None = None) -> DataFrame | None:
        """Rows between two dates, both included, as known at a time; None where nothing counts."""
        log = self.log(known_at) if _log is None else _log
        parts, below = [], None  # from the newest: rows of a month from ``below`` on are pruned
        for e in reversed(log):
            if e["rule"] == "prune":
                below = e["month"] if below is None else min(below, e["month"])
                continue
            rows = self.spark.read.parquet(f"{self.path}/data/{e['data']}").withColumn("ym", F.col("ym").cast("string"))
            if below is not None:
                rows = rows.where(F.col("ym") < below)
            parts.append(rows.withColumn("_n", F.lit(len(log) - len(parts))))
        if not parts:
            return None
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p, allowMissingColumns=True)
        if start:
            every = every.where((F.col("ym") >= start[:7]) & (F.col(self.time) >= F.lit(start)))
        if end:
            every = every.where((F.col("ym") <= end[:7]) & (F.col(self.time) < F.date_add(F.to_date(F.lit(end)), 1)))
        others = sorted(c for c in every.columns if c not in (*self.key, "_n", "ym"))
        return keep_last(every, self.key, [F.desc("_n"), *(F.desc_nulls_last(c) for c in others)]).drop("_n", "ym")

    def compact(self, at: float | None = None) -> str | None:
        """Folds all that counts into one entry; reads as known before it still take the older ones, whose data stays."""
        before = self.log()
        rows = self.get(_log=before)
        if rows is None:
            return None
        return self._commit({"data": self.write(rows), "rule": "whole", "folds": [e["name"] for e in before]}, at, before[-1]["number"])


# ---- coverage and plans -------------------------------------------------------------------------------------------


def months(symbols: DataFrame, start: str, end: str) -> DataFrame:
    """(symbol, ym) of every month that the range touches."""
    each = F.explode(F.sequence(F.trunc(F.to_date(F.lit(start)), "month"), F.to_date(F.lit(end)), F.expr("interval 1 month")))
    return symbols.select("symbol").distinct().select("symbol", each.alias("m")).select("symbol", F.date_format("m", "yyyy-MM").alias("ym"))


def missing(wanted: DataFrame, covered: DataFrame, today: str) -> DataFrame:
    """(symbol, ym) wanted and not covered; the month of ``today`` and later ones always are."""
    held = covered.where(F.col("ym") < today[:7]).select("symbol", "ym").distinct()
    return wanted.join(held, ["symbol", "ym"], "left_anti")


def ranges(lacking: DataFrame) -> DataFrame:
    """(symbol, first, last, n): consecutive months as one range."""
    place = F.row_number().over(W.partitionBy("symbol").orderBy("ym"))
    number = F.substring("ym", 1, 4).cast("int") * 12 + F.substring("ym", 6, 2).cast("int")
    runs = lacking.select("symbol", "ym").distinct().withColumn("_run", number - place)
    return runs.groupBy("symbol", "_run").agg(F.min("ym").alias("first"), F.max("ym").alias("last"), F.count("*").alias("n")).drop("_run")


def plan(gaps: DataFrame, most_symbols: int = 50, most_months: int = 400) -> DataFrame:
    """(first, last, call, symbols, months): symbols of the same range share a call, up to so many symbols and so many symbol-months a call."""
    size = F.greatest(F.lit(1), F.least(F.lit(most_symbols), F.floor(F.lit(most_months) / F.col("n"))))
    place = F.row_number().over(W.partitionBy("first", "last").orderBy("symbol")) - 1
    dealt = gaps.withColumn("call", F.floor(place / size).cast("int"))
    return dealt.groupBy("first", "last", "call").agg(F.array_sort(F.collect_list("symbol")).alias("symbols"), F.sum("n").alias("months"))
