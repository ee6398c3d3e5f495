"""Point-in-time facts of companies: reports with the time from which they are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Which kind of report counts where several describe one period.
RANK = {"official": 3, "flash": 2, "forecast": 1}


def latest_as_of(reports: DataFrame, fields: list[str], when) -> DataFrame:
    """(symbol, fields) known at a time: of each field the value that is not null of the newest period, official before flash before forecast.

    One aggregation with a map-side part; reports: (symbol, report_period, report_type, available_at, ...).
    """
    rank = F.coalesce(*(F.when(F.col("report_type") == k, v) for k, v in RANK.items()), F.lit(0))
    known = reports.where(F.col("available_at") <= F.lit(when))
    return known.groupBy("symbol").agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.struct("report_period", rank))).alias(f) for f in fields))


def trailing_year(reports: DataFrame, field: str, when) -> DataFrame:
    """(symbol, value): twelve months up to the newest official report known at a time.

    A fourth quarter stands for itself; else it is this year so far, plus all of last year, less last year so far.  Null
    where one of these is absent or null; a null newest report does not fall through to an older one.
    """
    own = reports.where((F.col("available_at") <= F.lit(when)) & (F.col("report_type") == "official"))
    own = own.groupBy("symbol", "fiscal_year", "fiscal_quarter").agg(F.max_by(F.struct(F.col(field).alias("v")), "report_period")["v"].alias("v"), F.max("report_period").alias("p"))
    new = own.groupBy("symbol").agg(F.max_by(F.struct("fiscal_year", "fiscal_quarter", "v"), "p").alias("n")).select("symbol", "n.*")
    last = own.select("symbol", (F.col("fiscal_year") + 1).alias("fiscal_year"), F.col("fiscal_quarter").alias("q"), F.col("v").alias("before"))
    both = new.join(last, ["symbol", "fiscal_year"], "left").groupBy("symbol", "fiscal_year", "fiscal_quarter", "v").agg(F.max(F.when(F.col("q") == 4, F.col("before"))).alias("whole"), F.max(F.when(F.col("q") == F.col("fiscal_quarter"), F.col("before"))).alias("part"))
    return both.select("symbol", F.when(F.col("fiscal_quarter") == 4, F.col("v")).otherwise(F.col("v") + F.col("whole") - F.col("part")).alias("value"))
