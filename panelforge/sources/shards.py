"""A store of time series in month shards: ``{root}/{kind}/{version}/ym=YYYY-MM/b=B`` Parquet, b a hash bucket of the symbol.

Readers prune on months by folder and on symbols by the statistics of sorted files; a write merges the shards it touches and replaces only those, keeping the last row of a
key.  Everything is a DataFrame operation on a path that
Spark reads, so the root may be any file system that Spark knows.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.joins import keep_last


def cache_key(**parts) -> str:
    """The first 16 hex digits of the SHA-1 of the sorted JSON of the parts."""
    return hashlib.sha1(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


def safe_segment(value: str) -> str:
    """Text that is safe as a folder name."""
    return re.sub(r"[^\w\-.]", "_", str(value))


def _month(c: str):
    return F.date_format(c, "yyyy-MM")


class ShardStore:
    """Time series by month and bucket of symbols.  ``time`` is the order column, ``key`` what identifies a row; give more ``buckets`` where a month outgrows a task."""

    def __init__(self, spark: SparkSession, root: str, kind: str, version: str = "v1", time: str = "date", key: tuple[str, ...] = ("symbol", "date"), buckets: int = 1):
        self.spark, self.time, self.key, self.buckets = spark, time, list(key), buckets
        self.path = f"{root}/{safe_segment(kind)}/{safe_segment(version)}"

    def _all(self) -> DataFrame | None:
        try:
            return self.spark.read.option("basePath", self.path).parquet(self.path).withColumn("ym", F.col("ym").cast("string"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def put(self, rows: DataFrame) -> None:
        """Merges rows into their shards; of equal keys the newly given row stays, of repeats among those given the largest by its columns in order.

        The merged shards are written aside first, since a job cannot overwrite what it reads; then only they are replaced.
        """
        fresh = rows.withColumn("ym", _month(self.time)).withColumn("b", F.pmod(F.xxhash64("symbol"), F.lit(self.buckets)).cast("int")).withColumn("_age", F.lit(1))
        held = self._all()
        if held is not None:
            touched = fresh.select("ym", "b").distinct()
            fresh = fresh.unionByName(held.join(touched, ["ym", "b"], "left_semi").withColumn("_age", F.lit(0)), allowMissingColumns=True)
        others = sorted(c for c in fresh.columns if c not in (*self.key, "_age", "ym", "b"))
        merged = keep_last(fresh, self.key, [F.desc("_age"), *(F.desc_nulls_last(c) for c in others)]).drop("_age")
        aside = f"{self.path}.aside-{uuid.uuid4().hex}"
        merged.write.parquet(aside)
        out = self.spark.read.parquet(aside).repartition("ym", "b").sortWithinPartitions("ym", "b", "symbol", self.time)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ym", "b").parquet(self.path)
        _remove(self.spark, aside)

    def get(self, symbols: list[str] | None, start: str, end: str) -> DataFrame | None:
        """Rows from start to end, both included (a date as end means the whole day); None where nothing is stored."""
        held = self._all()
        if held is None:
            return None
        upto = F.date_add(F.to_date(F.lit(end)), 1) if len(end) == 10 else F.lit(end).cast("timestamp_ntz") + F.expr("interval 1 microsecond")
        got = held.where((F.col("ym") >= start[:7]) & (F.col("ym") <= end[:7]) & (F.col(self.time) >= F.lit(start)) & (F.col(self.time) < upto))
        return (got.where(F.col("symbol").isin(symbols)) if symbols is not None else got).drop("ym", "b")

    def missing(self, symbols: DataFrame, start: str, end: str) -> DataFrame:
        """(symbol, ym): months of the range that no shard holds, for a table of symbols."""
        months = F.explode(F.sequence(F.trunc(F.to_date(F.lit(start)), "month"), F.to_date(F.lit(end)), F.expr("interval 1 month")))
        want = symbols.select("symbol").distinct().select("symbol", months.alias("m")).select("symbol", _month("m").alias("ym"))
        held = self._all()
        if held is None:
            return want
        inside = held.where((F.col("ym") >= start[:7]) & (F.col("ym") <= end[:7]))  # only these months' folders are read
        return want.join(inside.select("symbol", "ym").distinct(), ["symbol", "ym"], "left_anti")

    def invalidate(self, symbols: list[str] | None = None) -> None:
        """Drops everything, or the rows of some symbols: their shards are written aside without them and then replaced, so a crash loses no other row."""
        held = self._all()
        if symbols is None or held is None:
            return _remove(self.spark, self.path)
        gone = F.col("symbol").isin(symbols)
        touched = held.where(gone).select("ym", "b").distinct()
        rest = held.where(~gone).join(touched, ["ym", "b"], "left_semi")
        empty = [(r["ym"], r["b"]) for r in touched.join(rest.select("ym", "b").distinct(), ["ym", "b"], "left_anti").collect()]  # shards, not rows
        aside = f"{self.path}.aside-{uuid.uuid4().hex}"
        rest.write.parquet(aside)
        out = self.spark.read.parquet(aside).repartition("ym", "b").sortWithinPartitions("ym", "b", "symbol", self.time)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ym", "b").parquet(self.path)
        for ym, b in empty:
            _remove(self.spark, f"{self.path}/ym={ym}/b={b}")
        _remove(self.spark, aside)

    def read_through(self, symbols: DataFrame, start: str, end: str, fetch) -> DataFrame | None:
        """Rows of the range, after ``fetch(missing)``, a DataFrame of (symbol, ym), has supplied what no shard holds."""
        lacking = self.missing(symbols, start, end)
        if not lacking.isEmpty():
            self.put(fetch(lacking))
        got = self.get(None, start, end)
        return got if got is None else got.join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
