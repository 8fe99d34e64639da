"""Landed JSON payloads to tidy tables.

Each parser takes a DataFrame with the payload text in ``raw`` (one document
per row) so files, object stores and tables are read the same way.  Numbers
arrive as text and are coerced; unreadable ones become NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import to_double
from ..functions.text import file_stem
from ..operators.cleaning import epoch_date, keep_first, utc_date

# Metrics kept from paged payloads, in provider spelling.
PAGED_METRICS = (
    "AdrActCnt", "TxCnt", "TxTfrValAdjUSD", "FeeTotUSD", "HashRate",
    "DiffMean", "BlkCnt", "SplyCur", "CapMrktCurUSD", "PriceUSD",
)

INDEX_SCHEMA = "data array<struct<timestamp:string,value:string,value_classification:string>>"
CHART_SCHEMA = "values array<struct<x:string,y:string>>"
POINT_SCHEMA = "array<struct<t:string,v:string>>"
POSTS_SCHEMA = (
    "data array<struct<id:string,created_at:string,text:string,lang:string,"
    "public_metrics:struct<like_count:bigint,retweet_count:bigint,reply_count:bigint,quote_count:bigint>>>"
)
SNAPSHOT_SCHEMA = (
    "collected_at string, mempool struct<count:bigint,vsize:bigint,total_fee:double>, "
    "recommended_fees struct<fastestFee:double,halfHourFee:double,hourFee:double,economyFee:double,minimumFee:double>, "
    "difficulty_adjustment struct<progressPercent:double,difficultyChange:double,remainingBlocks:bigint>"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON documents with their metric name (the file stem)."""
    return spark.read.option("wholetext", True).text(path).select(
        F.col("value").alias("raw"), file_stem(F.input_file_name()).alias("metric")
    )


def sentiment_index(docs: DataFrame, value_name: str = "fear_greed") -> DataFrame:
    item = F.explode(F.from_json("raw", INDEX_SCHEMA)["data"])
    return docs.select(item.alias("i")).select(
        epoch_date("i.timestamp").alias("date"),
        to_double("i.value").alias(value_name),
        F.col("i.value_classification").alias("value_classification"),
    )


def chart_points(docs: DataFrame) -> DataFrame:
    """``metric, date, value`` from chart documents, the first point of a day kept.

    ``doc_order`` (optional) orders several documents of one metric.
    """
    doc = F.col("doc_order") if "doc_order" in docs.columns else F.lit(0).cast("long")
    points = docs.select(
        "metric", doc.alias("doc"), F.posexplode(F.from_json("raw", CHART_SCHEMA)["values"]).alias("pos", "i")
    ).select(
        "metric",
        epoch_date("i.x").alias("date"),
        to_double("i.y").alias("value"),
        F.struct("doc", "pos").alias("seq"),
    )
    return keep_first(points.na.drop(subset=["date"]), ["metric", "date"], "seq").drop("seq")


def metric_points(docs: DataFrame) -> DataFrame:
    """``metric, date, value`` from ``[{t, v}]`` documents."""
    return docs.select("metric", F.explode(F.from_json("raw", POINT_SCHEMA)).alias("i")).select(
        "metric", epoch_date("i.t").alias("date"), to_double("i.v").alias("value")
    )


def paged_metrics(pages: DataFrame, metrics: Sequence[str] = PAGED_METRICS, prefix: str = "cm_") -> DataFrame:
    """``metric, date, value`` from pages of ``{time, <metric>: number}`` rows; unknown metrics ignored."""
    fields = ",".join(f"`{m}`:string" for m in metrics)
    rows = pages.select(F.explode(F.from_json("raw", f"data array<struct<time:string,{fields}>>")["data"]).alias("i"))
    wide = rows.select(utc_date("i.time").alias("date"), *[to_double(F.col("i")[m]).alias(f"{prefix}{m}") for m in metrics])
    return wide.unpivot(["date"], [f"{prefix}{m}" for m in metrics], "metric", "value").select("metric", "date", "value")


def post_rows(docs: DataFrame) -> DataFrame:
    """Nested posts flattened; missing counters are 0, missing text is empty."""
    p = docs.select(F.explode(F.from_json("raw", POSTS_SCHEMA)["data"]).alias("p"))
    counters = ("like_count", "retweet_count", "reply_count", "quote_count")
    return p.select(
        F.col("p.id").alias("id"),
        F.col("p.created_at").alias("created_at"),
        F.coalesce("p.text", F.lit("")).alias("text"),
        F.col("p.lang").alias("lang"),
        *[F.coalesce(F.col(f"p.public_metrics.{c}"), F.lit(0)).alias(c) for c in counters],
    )


def network_snapshots(docs: DataFrame) -> DataFrame:
    """Stored snapshots of three nested objects; a failed object has NULL fields."""
    s = F.from_json("raw", SNAPSHOT_SCHEMA)
    return docs.select(s.alias("s")).select(
        F.try_to_timestamp("s.collected_at").alias("collected_at"),
        F.col("s.mempool.count").alias("mempool_count"),
        F.col("s.mempool.vsize").alias("mempool_vsize"),
        F.col("s.mempool.total_fee").alias("mempool_total_fee"),
        F.col("s.recommended_fees.fastestFee").alias("fastest_fee"),
        F.col("s.recommended_fees.hourFee").alias("hour_fee"),
        F.col("s.difficulty_adjustment.progressPercent").alias("difficulty_progress"),
        F.col("s.difficulty_adjustment.difficultyChange").alias("difficulty_change"),
    )
