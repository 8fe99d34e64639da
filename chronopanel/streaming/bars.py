"""Bars and daily sentiment over event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def streaming_bars(
    stream: DataFrame, series: Column, time: str, trade_order: Column, price: Column, volume: Column,
    period: str = "1 day", lateness: str = "1 hour",
) -> DataFrame:
    """Bars of closed periods (append mode); rows later than ``lateness`` are dropped."""
    staged = stream.select(
        series.alias("series_id"), F.col(time).cast("timestamp").alias("__ts"), trade_order.alias("__ord"),
        price.alias("__price"), volume.alias("__volume"),
    ).withWatermark("__ts", lateness)
    return (
        staged.groupBy("series_id", F.window("__ts", period).alias("__w"))
        .agg(
            F.min_by("__price", "__ord").alias("open"),
            F.max("__price").alias("high"),
            F.min("__price").alias("low"),
            F.max_by("__price", "__ord").alias("close"),
            F.sum("__volume").alias("volume"),
        )
        .select("series_id", F.col("__w.start").alias("period"), "open", "high", "low", "close", "volume")
    )


def streaming_sentiment(scored: DataFrame, time: str, lateness: str = "1 hour") -> DataFrame:
    """Daily sentiment of closed days from scored posts; the median is approximate in a stream."""
    c = F.col("compound")
    return (
        scored.withWatermark(time, lateness)
        .groupBy(F.window(time, "1 day").alias("__w"))
        .agg(
            F.count(F.lit(1)).alias("x_post_count"),
            F.avg(c).alias("x_sentiment_mean"),
            F.percentile_approx(c, F.lit(0.5), F.lit(10000)).alias("x_sentiment_median"),
            F.avg((c >= 0.05).cast("double")).alias("x_positive_share"),
            F.avg((c <= -0.05).cast("double")).alias("x_negative_share"),
            F.sum("engagement").alias("x_engagement"),
            F.try_divide(F.sum(c * F.col("sentiment_weight")), F.sum("sentiment_weight")).alias("x_sentiment_weighted"),
        )
        .select(F.col("__w.start").alias("period"), "x_post_count", "x_sentiment_mean", "x_sentiment_median",
                "x_positive_share", "x_negative_share", "x_engagement", "x_sentiment_weighted")
    )
