"""Trading sessions: places of dates in a calendar, and steps along it by equi-joins on session numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Names and minutes after midnight of a session's turning points.
TIMES = {"open_auction_start": 555, "open_auction_end": 565, "morning_open": 570, "morning_close": 690, "afternoon_open": 780, "close_auction_start": 897, "close": 900}


def places(dates: DataFrame, sessions: DataFrame) -> DataFrame:
    """(date, at, is_session): how many sessions lie at or before each date.  The window runs over days, not rows, in one small task."""
    marks = dates.select("date", F.lit(0).alias("s")).union(sessions.select("date", F.lit(1))).groupBy("date").agg(F.max("s").alias("s"))
    return marks.select("date", F.sum("s").over(W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)).alias("at"), (F.col("s") == 1).alias("is_session"))


def step(rows: DataFrame, sessions: DataFrame, column: str, n: int, out: str) -> DataFrame:
    """Adds the n-th session after a date (before it, for negative n), null beyond the calendar; 0 is the date itself.

    A date that is no session counts the nearest session in the step's direction as the first one.
    """
    if n == 0:
        return rows.withColumn(out, F.col(column))
    at = places(rows.select(F.col(column).alias("date")).where("date is not null").distinct(), sessions)
    aim = F.col("at") + n + F.when(~F.col("is_session"), 1).otherwise(0) if n < 0 else F.col("at") + n
    numbers = at.where("is_session").select(F.col("at").alias("_aim"), F.col("date").alias(out))
    ends = at.select(F.col("date").alias("_day"), aim.alias("_aim")).join(numbers, "_aim").select("_day", out)
    return rows.join(ends, F.col(column) == F.col("_day"), "left").drop("_day")


def between(sessions: DataFrame, first, last) -> DataFrame:
    """Sessions of a closed range."""
    return sessions.select("date").distinct().where((F.col("date") >= F.lit(first)) & (F.col("date") <= F.lit(last)))


def times(days: DataFrame) -> DataFrame:
    """A session's turning points as timestamps."""
    midnight = F.col("date").cast("timestamp")
    return days.select("date", *((midnight + F.expr(f"INTERVAL {m} MINUTES")).alias(name) for name, m in TIMES.items()))


def last_sessions(panel: DataFrame, sessions: DataFrame, n: int, column: str = "date") -> DataFrame:
    """Each (symbol, date) beside the first of its last ``n`` sessions, as ``since``: the window of rolling intraday features."""
    return step(panel, sessions, column, 1 - n, "since") if n > 1 else panel.withColumn("since", F.col(column))
