"""Purged chronological splits and their audits.

Fold tables have one row per fold.  They are built from the calendar (distinct
dates), so a panel of many series is cut at the same dates everywhere, and are
joined to rows as a broadcast of at most ``n_splits`` rows.
Validation lengths count calendar rows; training windows count days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import calendar
from .ranking import positions_by_hash
from ..session import small_table

FOLD_SCHEMA = ["fold", "valid_start", "valid_end", "train_from"]


class LeakingSplit(ValueError):
    """A training target ends on or after the start of validation."""


def _dated(blocks: DataFrame, days: DataFrame) -> DataFrame:
    start = days.select(F.col("day_index").alias("first_row"), F.col("date").alias("valid_start"))
    end = days.select((F.col("day_index") + 1).alias("end_row"), F.col("date").alias("valid_end"))
    return blocks.join(start, "first_row").join(end, "end_row")


def _train_days(folds: DataFrame, days: DataFrame) -> DataFrame:
    """Calendar rows left for training after purge and window."""
    inside = (F.col("next_date") < F.col("valid_start")) & (
        F.col("train_from").isNull() | (F.col("date") >= F.col("train_from"))
    )
    counted = (
        folds.join(days.select("date", "next_date"), inside, "left")
        .groupBy("fold")
        .agg(F.count("date").alias("train_days"))
    )
    return folds.join(counted, "fold")


def expanding_folds(df: DataFrame, n_splits: int = 5, min_train: int = 50) -> DataFrame:
    """Equal blocks at the end of the calendar, everything before as training."""
    days = calendar(df)
    size = days.agg(F.count(F.lit(1)).alias("n"))
    blocks = size.select(
        "n",
        F.floor(F.col("n") / (n_splits + 1)).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("__i"),
    ).select(
        (F.col("__i") + 1).alias("fold"),
        (F.col("n") - F.col("block") * (n_splits - F.col("__i"))).alias("first_row"),
        (F.col("n") - F.col("block") * (n_splits - F.col("__i") - 1)).alias("end_row"),
    )
    folds = _dated(blocks, days).withColumn("train_from", F.lit(None).cast("date"))
    return _train_days(folds, days).filter(F.col("train_days") >= min_train).select(*FOLD_SCHEMA)


def rolling_folds(
    df: DataFrame,
    train_window_days: int | None = None,
    valid_days: int = 180,
    n_splits: int = 6,
    warmup: int = 400,
    min_valid: int = 60,
    min_train: int = 180,
) -> DataFrame:
    """Walk-forward blocks at the end of the calendar, shorter ones on a short history."""
    days = calendar(df)
    size = days.agg(F.count(F.lit(1)).alias("n"))
    short = F.greatest(F.lit(min_valid), F.floor((F.col("n") - warmup) / n_splits))
    length = F.when(F.col("n") - valid_days * n_splits < warmup, short).otherwise(F.lit(valid_days))
    blocks = (
        size.withColumn("len", length)
        .withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
        .select(
            (F.col("__i") + 1).alias("fold"),
            (F.col("n") - F.col("len") * (n_splits - F.col("__i"))).alias("first_row"),
            F.least(F.col("n") - F.col("len") * (n_splits - F.col("__i") - 1), F.col("n")).alias("end_row"),
        )
        .filter((F.col("first_row") > 0) & (F.col("end_row") > F.col("first_row")))
    )
    train_from = F.date_sub("valid_start", train_window_days) if train_window_days else F.lit(None).cast("date")
    folds = _dated(blocks, days).withColumn("train_from", train_from)
    return _train_days(folds, days).filter(F.col("train_days") >= min_train).select(*FOLD_SCHEMA)


def holdout_fold(df: DataFrame, train_ratio: float = 0.80) -> DataFrame:
    """One chronological cut of the calendar, as a fold table with fold 0."""
    days = calendar(df)
    size = days.agg(F.count(F.lit(1)).alias("n"))
    blocks = size.select(
        F.lit(0).alias("fold"),
        F.floor(F.col("n") * F.lit(train_ratio)).alias("first_row"),
        F.col("n").alias("end_row"),
    ).filter((F.col("first_row") > 0) & (F.col("first_row") < F.col("end_row")))
    return _dated(blocks, days).withColumn("train_from", F.lit(None).cast("date")).select(*FOLD_SCHEMA)


def fixed(folds: DataFrame) -> DataFrame:
    """The fold table as literal rows (at most ``n_splits``), so later plans do not rebuild the calendar."""
    rows = folds.select(*FOLD_SCHEMA).orderBy("fold").collect()
    return small_table(folds.sparkSession, [tuple(r) for r in rows], "fold int, valid_start date, valid_end date, train_from date"
    )


def role() -> Column:
    """valid / train / purged / None for a row beside a fold."""
    in_window = F.col("train_from").isNull() | (F.col("date") >= F.col("train_from"))
    return (
        F.when(F.col("date").between(F.col("valid_start"), F.col("valid_end")), F.lit("valid"))
        .when((F.col("date") < F.col("valid_start")) & (F.col("target_end_date") < F.col("valid_start")) & in_window, F.lit("train"))
        .when((F.col("date") < F.col("valid_start")) & in_window, F.lit("purged"))
    )


def assign(rows: DataFrame, folds: DataFrame, purged: bool = False) -> DataFrame:
    """Rows beside every fold they belong to, with ``fold`` and ``role``.

    Range join against a broadcast of one row per fold; pass only the columns
    that are needed, because an expanding fold repeats early rows.
    """
    hit = (F.col("date") <= F.col("valid_end")) & (
        F.col("train_from").isNull() | (F.col("date") >= F.col("train_from"))
    )
    out = rows.join(F.broadcast(folds), hit).withColumn("role", role())
    keep = F.col("role").isNotNull() if purged else F.col("role").isin("train", "valid")
    return out.filter(keep).drop("valid_start", "valid_end", "train_from")


def audit(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Per fold: row counts before and after the purge and the boundary dates."""
    marked = assign(rows.select("date", "target_end_date"), folds, purged=True)
    is_role = lambda r: F.col("role") == r
    return marked.groupBy("fold").agg(
        F.count_if(is_role("train") | is_role("purged")).alias("raw_train_rows"),
        F.count_if(is_role("train")).alias("train_rows_after_purge"),
        F.count_if(is_role("purged")).alias("purged_rows"),
        F.count_if(is_role("valid")).alias("valid_rows"),
        F.min(F.when(is_role("train"), F.col("date"))).alias("train_first_feature_date"),
        F.max(F.when(is_role("train"), F.col("date"))).alias("train_last_feature_date"),
        F.max(F.when(is_role("train"), F.col("target_end_date"))).alias("train_last_target_end_date"),
        F.min(F.when(is_role("valid"), F.col("date"))).alias("valid_first_feature_date"),
        F.max(F.when(is_role("valid"), F.col("date"))).alias("valid_last_feature_date"),
    )


def boundary_problems(audits: DataFrame) -> DataFrame:
    """Folds whose training reaches into validation, or with an empty side."""
    bad = (
        (F.col("train_rows_after_purge") == 0)
        | (F.col("valid_rows") == 0)
        | (F.col("train_last_feature_date") >= F.col("valid_first_feature_date"))
        | (F.col("train_last_target_end_date") >= F.col("valid_first_feature_date"))
    )
    return audits.filter(bad)


def assert_boundaries(audits: DataFrame) -> DataFrame:
    bad = boundary_problems(audits).select("fold").take(1)
    if bad:
        raise LeakingSplit(f"fold {bad[0]['fold']} overlaps its validation block")
    return audits


def task_audit(audits: DataFrame, task: str) -> DataFrame:
    return audits.select(F.lit(task).alias("task"), "*")


def selection_cut(oof: DataFrame, share: float = 0.60, least: int = 60, tail: int = 30) -> DataFrame:
    """Mark out-of-fold rows ``select`` (early) or ``verify`` (late) by calendar position."""
    days = calendar(oof)
    size = days.agg(F.count(F.lit(1)).alias("n"))
    cut = F.least(F.greatest(F.lit(least), F.floor(F.col("n") * share)), F.col("n") - tail)
    edge = size.select(cut.alias("__cut"))
    first_late = days.join(F.broadcast(edge), F.col("day_index") == F.col("__cut")).select(F.col("date").alias("__late"))
    return oof.join(F.broadcast(first_late)).withColumn(
        "part", F.when(F.col("date") < F.col("__late"), "select").otherwise("verify")
    ).drop("__late")


def stratified_split(df: DataFrame, label: str, unique: str, seed: int = 42, test_size: float = 0.2) -> DataFrame:
    """Random split that keeps class shares; the order is a digest of key and seed.

    Positions come from bucketed counts, so a class that holds most rows is not
    sorted in one task.  For time series this leaks; it is kept for the classic
    training table only.
    """
    digest = F.md5(F.concat_ws("|", F.col(unique).cast("string"), F.lit(str(seed))))
    ranked = positions_by_hash(df.withColumn("__digest", digest), [label], "__digest", unique, "__p")
    in_test = F.col("__p") <= F.round(F.col("__p_total") * test_size)
    return ranked.withColumn("split", F.when(in_test, "test").otherwise("train")).drop("__digest", "__p", "__p_total")
