"""Queries of the market source on inputs of our own."""

from datetime import datetime

from panelforge.catalog import ORACLES
from panelforge.queries import market
from panelforge.sources.layer import DataLayer
from panelforge.sources.trade import TradeSource


def _events(spark, folder):
    at = [datetime(2023, 12, 31, 23, 59), datetime(2024, 1, 7, 11), datetime(2024, 1, 8), datetime(2024, 1, 19, 23, 59, 59), datetime(2024, 1, 20), datetime(2025, 6, 1, 12), None]
    rows = [(i, t, i, "click", float(i), None) for i, t in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_intraday_gives_every_event(spark, tmp_path):
    folder = _events(spark, tmp_path)
    got = market.market_intraday(spark, folder)
    assert sorted(r["close"] for r in got.collect()) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    assert {r["volume"] for r in got.collect()} == {1}
    assert "WHERE" not in ORACLES["market_intraday"]


def test_a_date_as_end_is_the_whole_day(spark, tmp_path):
    rows = DataLayer(TradeSource(spark, _events(spark, tmp_path))).rows("intraday", None, "2024-01-08", "2024-01-19")
    assert sorted(r["close"] for r in rows.collect()) == [2.0, 3.0]
