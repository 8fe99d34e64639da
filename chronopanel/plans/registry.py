"""Versioned model artifacts by configuration hash."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_table
from ..sources.tabular import exists
from .models import Fitted

LOG_SCHEMA = "config_hash string, version int, folder string, card string"


class ModelRegistry:
    """Artifacts under one path, and a log that names them.

    An artifact is written whole into a folder of its own before one row of the log, a single file that appears at once, names
    it: a reader sees the version before or the new one, never half of it.  Nothing is overwritten.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self) -> DataFrame:
        path = f"{self.path}/log"
        return self.spark.read.schema(LOG_SCHEMA).parquet(path) if exists(self.spark, path) else small_table(self.spark, [], LOG_SCHEMA)

    def latest(self) -> DataFrame:
        """The newest version of each configuration; of two that were published at once, the one with the greater folder."""
        newest = F.max_by(F.struct("version", "folder", "card"), F.struct("version", "folder")).alias("n")
        return self.log().groupBy("config_hash").agg(newest).select("config_hash", "n.*")

    def publish(self, config_hash: str, fitted: Fitted, card: Mapping[str, object]) -> int:
        folder = f"{self.path}/{config_hash}/{uuid.uuid4().hex}"
        fitted.save(self.spark, folder)
        found = self.log().filter(F.col("config_hash") == config_hash).agg(F.max("version")).first()[0]
        version = (found or 0) + 1
        row = (config_hash, version, folder, json.dumps({k: str(v) for k, v in card.items()}, sort_keys=True))
        small_table(self.spark, [row], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return version

    def load(self, config_hash: str, version: int | None = None) -> tuple[Fitted, dict]:
        """The model and its card; the newest version unless one is named."""
        rows = self.latest() if version is None else self.log().filter(F.col("version") == version)
        row = rows.filter(F.col("config_hash") == config_hash).orderBy(F.desc("folder")).first()
        if row is None:
            raise KeyError(f"no model of configuration {config_hash}" + (f", version {version}" if version else ""))
        return Fitted.load(self.spark, row["folder"]), json.loads(row["card"])
