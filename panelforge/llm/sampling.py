"""Bounded training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded(rows: DataFrame, id_col: str, most: int, seed: int = 7) -> DataFrame:
    """About the ``most`` rows of the least id hash: all rows up to the hash of that rank.  Only the rank's hash reaches the driver; ties at it stay in."""
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    last = rows.select(h.alias("h")).orderBy("h").limit(most).agg(F.max("h"), F.count("*")).first()
    return rows.where(h <= last[0]) if last[1] >= most else rows


def bucket_of(id_col: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n
