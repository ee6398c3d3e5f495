"""Tables of trials and of computed features: appended Parquet with JSON columns, read by DataFrames."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .shards import cache_key, safe_segment

TRIAL = "trial_id string, dataset_id string, recorded_at timestamp, config string, metrics string, git_commit string, notes string"


class TrialRegistry:
    """Every backtest that was run, so that its best can be deflated by their number."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root}/trials"

    def record(self, dataset_id: str, config: dict, metrics: dict, git_commit: str | None = None, notes: str | None = None) -> str:
        trial = uuid.uuid4().hex
        row = (trial, dataset_id, dt.datetime.now(), json.dumps(config, sort_keys=True), json.dumps(metrics, sort_keys=True), git_commit, notes)
        self.spark.createDataFrame([row], TRIAL).coalesce(1).write.mode("append").parquet(self.path)
        return trial

    def record_all(self, trials: DataFrame) -> None:
        """Appends many trials at once: (dataset_id, config, metrics), the last two JSON text."""
        empty = F.lit(None).cast("string")
        rows = trials.select(F.expr("uuid()").alias("trial_id"), "dataset_id", F.current_timestamp().alias("recorded_at"), "config", "metrics", empty.alias("git_commit"), empty.alias("notes"))
        rows.write.mode("append").parquet(self.path)

    def trials(self, dataset_id: str | None = None) -> DataFrame:
        try:
            all_ = self.spark.read.schema(TRIAL).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            all_ = self.spark.createDataFrame([], TRIAL)
        return all_ if dataset_id is None else all_.where(F.col("dataset_id") == dataset_id)

    def sharpe_ratios(self, dataset_id: str) -> DataFrame:
        return self.trials(dataset_id).select("trial_id", F.get_json_object("metrics", "$.sharpe_ratio").cast("double").alias("sharpe_ratio")).where("sharpe_ratio is not null")

    def count(self, dataset_id: str) -> int:
        return self.trials(dataset_id).count()


class FeatureStore:
    """Values (symbol, date, value) by a key of all that they depend on, data version and symbols included."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root}/features"

    def key(self, name: str, version: str, dataset: str, universe: str, start: str, end: str, data_version: str) -> str:
        return cache_key(name=name, version=version, dataset=dataset, universe=universe, start=start, end=end, data_version=data_version)

    def put(self, key: str, values: DataFrame) -> None:
        values.write.mode("overwrite").parquet(f"{self.path}/feature_key={safe_segment(key)}")

    def get(self, key: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/feature_key={safe_segment(key)}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
