"""Global order without a single task over all rows.

A table is ordered by a coarse key (sessions) and then a fine one.  Rows are numbered or summed within each value of the
coarse key and shifted by the totals of smaller values; the only single task sees one row for each distinct coarse value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _shifted(df: DataFrame, coarse: str, fine: list, total: Column, within: Column, name: str) -> DataFrame:
    if dict(df.dtypes)[coarse].startswith("timestamp"):  # nearly as many values as rows: their days are the coarse key
        return _shifted(df.withColumn("_day", F.to_date(coarse)), "_day", [coarse, *fine], total, within, name).drop("_day")
    sizes = df.groupBy(coarse).agg(total.alias("_k"))
    before = F.coalesce(F.sum("_k").over(W.orderBy("_c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select(F.col(coarse).alias("_c"), "_k").select("_c", before.alias("_before"))
    own = within.over(W.partitionBy(coarse).orderBy(*fine).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("_own", own).join(shift, F.col(coarse).eqNullSafe(F.col("_c"))).withColumn(name, F.col("_before") + F.col("_own")).drop("_c", "_before", "_own")


def position(df: DataFrame, coarse: str, fine: list, name: str = "i") -> DataFrame:
    """Adds the place of a row in the order, from 0; ``fine`` must break all ties."""
    out = _shifted(df, coarse, fine, F.count(F.lit(1)), F.row_number(), name)
    return out.withColumn(name, F.col(name) - 1)


def running_sum(df: DataFrame, coarse: str, fine: list, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` up to a row, itself included; nulls count as nothing."""
    return _shifted(df, coarse, fine, F.coalesce(F.sum(value), F.lit(0.0)), F.sum(value), name)
