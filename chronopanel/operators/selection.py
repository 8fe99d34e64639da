"""Feature catalogue, coverage gates and train-only feature selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranking import exact_median
from .splits import assign
from ..session import small_table

# Which catalogue families each named feature group contains.
GROUPS_V1 = {
    "price": ("price_core", "crypto", "macro_corr"),
    "price_macro": ("price_core", "crypto", "macro_corr", "macro"),
    "price_onchain": ("price_core", "crypto", "macro_corr", "onchain"),
    "price_sentiment": ("price_core", "crypto", "macro_corr", "sentiment"),
    "all": ("price_core", "crypto", "macro_corr", "macro", "onchain", "sentiment"),
}
GROUPS_V2 = {
    "price_core": ("price_core",),
    "price_crypto": ("price_core", "crypto"),
    "price_macro": ("price_core", "macro", "macro_corr"),
    "price_onchain": ("price_core", "onchain"),
    "price_crypto_onchain": ("price_core", "crypto", "onchain"),
    "price_all_external": ("price_core", "macro", "macro_corr", "onchain", "sentiment"),
    "all": ("price_core", "crypto", "macro_corr", "macro", "onchain", "sentiment"),
}
SMALLEST_GROUP = 5


def catalog(spark: SparkSession, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """``feature, family`` rows of the active features (as many rows as columns)."""
    rows = [(f, fam) for fam, feats in families.items() for f in feats]
    return small_table(spark, rows, "feature string, family string")


def feature_groups(features: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Group name and feature, deduplicated; groups with under five features are left out."""
    pairs = small_table(features.sparkSession, [(g, fam) for g, fams in groups.items() for fam in fams], "feature_set string, family string"
    )
    members = features.join(F.broadcast(pairs), "family").select("feature_set", "feature").distinct()
    sizes = members.groupBy("feature_set").agg(F.count(F.lit(1)).alias("n"))
    return members.join(sizes.filter(F.col("n") >= SMALLEST_GROUP), "feature_set").drop("n")


def union_features(*lists: DataFrame) -> DataFrame:
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other)
    return out.distinct()


def missing_features(required: DataFrame, present: DataFrame) -> DataFrame:
    return required.exceptAll(present)


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Coverage per column in one pass, thinnest first."""
    counts = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(c).alias(c) for c in columns])
    long = counts.unpivot(["__rows"], list(columns), "column", "non_null")
    return long.select(
        "column", "non_null", F.try_divide(F.col("non_null").cast("double"), F.col("__rows")).alias("coverage")
    )


def describe_series(df: DataFrame, key: str = "series_id", date: str = "date") -> DataFrame:
    """One row per series: its rows, first and last date."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("series_rows"), F.min(date).alias("series_start"), F.max(date).alias("series_end"))


def describe_panel(df: DataFrame, key: str = "series_id", date: str = "date") -> DataFrame:
    """One row on the whole panel; which series it holds is ``describe_series``, as many rows as there are."""
    return describe_series(df, key, date).agg(
        F.coalesce(F.sum("series_rows"), F.lit(0)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.min("series_start").alias("date_start"),
        F.max("series_end").alias("date_end"),
        F.count(key).alias("n_series"),
    )


def long_features(rows: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    return rows.select(*keep, *[F.col(f).cast("double") for f in features]).unpivot(
        list(keep), list(features), "feature", "value"
    )


def train_stats(rows: DataFrame, folds: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per fold and feature on training rows: rows, known share, extremes, distinct values."""
    train = assign(rows.select("date", "target_end_date", *features), folds).filter(F.col("role") == "train")
    long = long_features(train, ["fold"], features)
    return long.groupBy("fold", "feature").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("value").alias("known"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.count_distinct("value").alias("n_distinct"),
    ).withColumn("coverage", F.col("known") / F.col("rows"))


def coverage_selected(stats: DataFrame, wanted: float = 0.60, relaxed: float = 0.30, least: int = 5) -> DataFrame:
    """Features with enough coverage and more than one value; a fold with too few relaxes its gate."""
    varied = stats.filter(F.col("lo") < F.col("hi"))
    strict = F.col("coverage") >= wanted
    per_fold = Window.partitionBy("fold")
    n_strict = F.count_if(strict).over(per_fold)
    return (
        varied.withColumn("__n", n_strict)
        .filter(strict | ((F.col("__n") < least) & (F.col("coverage") >= relaxed)))
        .drop("__n")
    )


def binned_information(
    rows: DataFrame,
    folds: DataFrame,
    features: Sequence[str],
    target: str,
    bins: int = 10,
    min_coverage: float = 0.60,
    min_distinct: int = 2,
    target_bins: int | None = None,
) -> DataFrame:
    """Mutual information of each feature with a class target, per fold, on training rows.

    A numeric target is first cut into ``target_bins`` quantiles of the fold's own training rows.

    Values fall into train-quantile bins.  Bin edges are ``folds x features``
    arrays of ``bins - 1`` numbers.  A missing value joins the bin of the
    training median, as median imputation would place it.
    """
    train = assign(rows.select("date", "target_end_date", target, *features), folds).filter(F.col("role") == "train")
    if target_bins:
        steps = F.array(*[F.lit(i / target_bins) for i in range(1, target_bins)])
        quantiles = train.groupBy("fold").agg(F.percentile_approx(target, steps, F.lit(10000)).alias("__q"))
        binned = F.size(F.filter("__q", lambda e: e <= F.col(target)))
        train = train.join(F.broadcast(quantiles), "fold").withColumn(target, F.when(F.col(target).isNotNull(), binned)).drop("__q")
    long = long_features(train, ["fold", target], features)
    cuts = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    edges = long.groupBy("fold", "feature").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("value").alias("known"),
        F.approx_count_distinct("value", 0.01).alias("n_distinct"),
        F.percentile_approx("value", cuts, F.lit(10000)).alias("edges"),
        F.percentile_approx("value", F.lit(0.5), F.lit(10000)).alias("mid"),
    )
    usable = edges.filter(
        (F.col("known") >= F.lit(min_coverage) * F.col("rows")) & (F.col("n_distinct") > min_distinct)
    ).select("fold", "feature", "edges", "mid")
    # folds x features rows: a shuffle on these few keys would gather a feature's rows in one task
    placed = long.join(F.broadcast(usable), ["fold", "feature"]).withColumn("x", F.coalesce("value", "mid"))
    binned = placed.withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("x"))))
    joint = binned.groupBy("fold", "feature", "bin", F.col(target).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    by_bin = Window.partitionBy("fold", "feature", "bin")
    by_y = Window.partitionBy("fold", "feature", "y")
    by_all = Window.partitionBy("fold", "feature")
    cells = joint.withColumns(
        {
            "nx": F.sum("n").over(by_bin).cast("double"),
            "ny": F.sum("n").over(by_y).cast("double"),
            "total": F.sum("n").over(by_all).cast("double"),
        }
    )
    term = F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))
    return cells.groupBy("fold", "feature").agg(F.sum(term).alias("mi"))


def train_variance(
    rows: DataFrame, folds: DataFrame, features: Sequence[str], min_coverage: float = 0.60, min_distinct: int = 2
) -> DataFrame:
    """Population variance per fold and feature on training rows, missing values replaced by the training median.

    Features with too few known values, or with no more than ``min_distinct`` different ones, are left out.
    """
    train = assign(rows.select("date", "target_end_date", *features), folds).filter(F.col("role") == "train")
    long = long_features(train, ["fold"], features)
    gate = long.groupBy("fold", "feature").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("known"), F.count_distinct("value").alias("n_distinct")
    ).filter((F.col("known") >= F.lit(min_coverage) * F.col("rows")) & (F.col("n_distinct") > min_distinct))
    medians = exact_median(long, ["fold", "feature"], "value", "mid")
    usable = gate.select("fold", "feature").join(medians, ["fold", "feature"])
    # folds x features rows, as in binned_information
    return long.join(F.broadcast(usable), ["fold", "feature"]).groupBy("fold", "feature").agg(
        F.var_pop(F.coalesce("value", "mid")).alias("variance")
    )


def top_features(scores: DataFrame, score: str, k: int) -> DataFrame:
    """First ``k`` features per fold; ties by feature name."""
    w = Window.partitionBy("fold").orderBy(F.col(score).desc_nulls_last(), F.col("feature"))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def selection_frequency(records: DataFrame) -> DataFrame:
    """How often each feature was chosen.

    ``records``: experiment, feature_set, model, selected_features array<array<string>>.
    """
    folds = records.select(
        "experiment", "feature_set", "model",
        F.size("selected_features").alias("fold_count"),
        F.explode("selected_features").alias("__fold"),
    )
    picks = folds.select("experiment", "feature_set", "model", "fold_count", F.explode("__fold").alias("feature"))
    return (
        picks.groupBy("experiment", "feature_set", "model", "feature", "fold_count")
        .agg(F.count(F.lit(1)).alias("selected_folds"))
        .withColumn("selection_rate", F.col("selected_folds") / F.greatest(F.lit(1), F.col("fold_count")))
    )
