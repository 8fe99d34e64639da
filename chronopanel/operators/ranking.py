"""Order statistics over large groups without one task per group.

The idea throughout: collapse to distinct values, put values into monotone
buckets, prefix-sum the (few) buckets, and sort only inside a bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import col

PER_OCTAVE = 256
OFFSET = PER_OCTAVE * 1100


def magnitude_bucket(value: str | Column, per_octave: int = PER_OCTAVE) -> Column:
    """Monotone integer bucket of a double: ``per_octave`` buckets for each power of two."""
    v = col(value).cast("double")
    level = F.floor(F.log2(F.abs(v)) * F.lit(per_octave)).cast("long") + F.lit(OFFSET)
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, level).otherwise(-level)


def hash_bucket(digest: str | Column, digits: int = 4) -> Column:
    """Bucket of a hex digest by its leading digits."""
    return F.conv(F.substring(col(digest), 1, digits), 16, 10).cast("long")


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: Sequence[str],
    descending: bool = False,
    bucket: Column | None = None,
) -> DataFrame:
    """Add ``<name>_before``: the total of ``name`` over strictly smaller values in the key.

    ``df`` must hold one row per key and value.  With ``descending`` the total
    runs over strictly larger values.
    """
    b = magnitude_bucket(value) if bucket is None else bucket
    cut = df.withColumn("__b", b)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    per_bucket = cut.groupBy(*keys, "__b").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    over_buckets = (
        Window.partitionBy(*keys).orderBy(direction("__b")).rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = per_bucket.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__b").alias("__kb"),
        *[F.coalesce(F.sum(f"__t_{s}").over(over_buckets), F.lit(0)).alias(f"__s_{s}") for s in sums],
    )
    inside = (
        Window.partitionBy(*keys, "__b").orderBy(direction(value)).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = cut.withColumns({f"__l_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    match = F.col("__b") == F.col("__kb")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = local.join(starts, match)
    return joined.withColumns({f"{s}_before": F.col(f"__s_{s}") + F.col(f"__l_{s}") for s in sums}).drop(
        "__b", "__kb", *[f"__k_{k}" for k in keys], *[f"__s_{s}" for s in sums], *[f"__l_{s}" for s in sums]
    )


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Distinct values of each key with their tie-averaged rank: ``keys, value, out``."""
    tally = df.filter(col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_before(tally, keys, value, ["n"])
    return ranked.select(*keys, value, (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).alias(out))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact median per key; the two middle ranks are located by prefix sums."""
    tally = df.filter(col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    sizes = tally.groupBy(*keys).agg(F.sum("n").alias("__total"))
    ranked = running_before(tally, keys, value, ["n"])
    renamed = sizes.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__total")
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    low, high = F.floor((F.col("__total") + 1) / 2), F.floor(F.col("__total") / 2) + 1
    hit = lambda r: (F.col("n_before") < r) & (r <= F.col("n_before") + F.col("n"))
    middle = ranked.join(renamed, match).filter(hit(low) | hit(high))
    weight = hit(low).cast("int") + hit(high).cast("int")
    return middle.groupBy(*keys).agg((F.sum(col(value) * weight) / F.lit(2.0)).alias(out))


def positions_by_hash(df: DataFrame, keys: Sequence[str], digest: str, unique: str, out: str) -> DataFrame:
    """1-based position of each row in its key when ordered by a hex digest (ties by ``unique``)."""
    cut = df.withColumn("__b", hash_bucket(digest))
    sizes = cut.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    over_buckets = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__b").alias("__kb"),
        F.coalesce(F.sum("__n").over(over_buckets), F.lit(0)).alias("__start"),
        F.sum("__n").over(Window.partitionBy(*keys)).alias(f"{out}_total"),
    )
    inside = Window.partitionBy(*keys, "__b").orderBy(digest, unique)
    match = F.col("__b") == F.col("__kb")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return (
        cut.withColumn("__i", F.row_number().over(inside))
        .join(starts, match)
        .withColumn(out, F.col("__start") + F.col("__i"))
        .drop("__b", "__kb", "__start", "__i", *[f"__k_{k}" for k in keys])
    )


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Best ``k`` rows per group; Spark prunes to k per task before the shuffle (group limit)."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_per_group(df: DataFrame, groups: Sequence[str], score: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """Row with the lexicographically largest score per group."""
    return df.groupBy(*groups).agg(F.max_by(F.struct(*keep), F.struct(*score)).alias("best")).select(*groups, "best.*")


def top_values(df: DataFrame, column: str, score: str, n: int) -> DataFrame:
    """Distinct values of a column by their best score, first ``n``."""
    return (
        df.groupBy(column)
        .agg(F.max(score).alias(score))
        .orderBy(F.col(score).desc(), F.col(column).asc())
        .limit(n)
    )
