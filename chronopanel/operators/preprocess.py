"""Train-fitted imputation, scaling and class weights as DataFrame work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import exact_median
from .selection import long_features


def train_medians(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exact median per feature, one row per feature."""
    return exact_median(long_features(train, [], features), ["feature"], "value", "median")


def impute_long(long: DataFrame, medians: DataFrame) -> DataFrame:
    """Long rows with missing values replaced; the medians are one row per feature."""
    joined = long.join(F.broadcast(medians), "feature", "left")
    return joined.withColumns(
        {"imputed": F.coalesce("value", "median"), "was_missing": F.col("value").isNull().cast("double")}
    ).drop("median")


def missing_flags(train: DataFrame, features: Sequence[str]) -> list[str]:
    """Features with a missing value in training (one aggregate row on the driver)."""
    row = train.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in features]).first()
    return [f for f in features if row[f] > 0]


def with_missing_flags(df: DataFrame, flagged: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{f}_missing": F.col(f).isNull().cast("double") for f in flagged})


def scale_stats(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: population mean and deviation of each feature."""
    aggs = []
    for f in features:
        aggs += [F.avg(f).alias(f"__m_{f}"), F.stddev_pop(f).alias(f"__s_{f}")]
    return train.agg(*aggs)


def standardised(df: DataFrame, stats: DataFrame, features: Sequence[str]) -> DataFrame:
    """Centre and scale; a constant feature is only centred."""
    joined = df.join(F.broadcast(stats))
    scale = lambda f: F.when(F.col(f"__s_{f}") == 0, F.lit(1.0)).otherwise(F.col(f"__s_{f}"))
    out = joined.withColumns({f: (F.col(f) - F.col(f"__m_{f}")) / scale(f) for f in features})
    return out.drop(*[f"__{k}_{f}" for f in features for k in ("m", "s")])


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))
    return counts.join(F.broadcast(whole)).select(
        label, (F.col("rows") / (F.col("classes") * F.col("n"))).alias("weight")
    )


def with_class_weights(train: DataFrame, label: str) -> DataFrame:
    return train.join(F.broadcast(class_weights(train, label)), label)


def class_shares(df: DataFrame, label: str, groups: Sequence[str] = (), classes: Sequence[int] | None = None) -> DataFrame:
    """Share of each class; a listed class that never occurs gets 0."""
    counts = df.groupBy(*groups, label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*groups).agg(F.sum("n").alias("__t"))
    joined = counts.join(totals, list(groups)) if groups else counts.join(F.broadcast(totals))
    shares = joined.select(*groups, label, F.col("n"), (F.col("n") / F.col("__t")).alias("share"))
    if classes is None:
        return shares
    wanted = F.explode(F.array(*[F.lit(c) for c in classes])).alias(label)
    full = (totals.select(*groups, wanted)) if groups else totals.select(wanted)
    return full.join(shares, [*groups, label], "left").withColumns(
        {"n": F.coalesce("n", F.lit(0)), "share": F.coalesce("share", F.lit(0.0))}
    )
