"""Session settings and durable materialisation."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # window work is heavy per byte: small shuffles keep more than one task
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "chronopanel", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A handful of driver-side rows as a local relation (known size, no Python work in tasks)."""
    fields = T._parse_datatype_string(schema)
    named = [dict(zip(fields.names, r)) for r in rows]
    return spark.createDataFrame(pa.Table.from_pylist(named, schema=to_arrow_schema(fields)), schema=fields)


def shared_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster.  A local one is made only for a local master, where no executor is elsewhere."""
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"name a folder that all executors share in {CHECKPOINT_DIR}")
    own = getattr(spark, "_chronopanel_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="chronopanel-")
        spark._chronopanel_dir = own
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder (never reused, never deleted)."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write an intermediate that several later jobs read, and read it back.

    The files survive lost executors, end the lineage, keep column pruning and
    give the optimizer a real size.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
