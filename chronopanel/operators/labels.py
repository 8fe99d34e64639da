"""Targets, thresholds and labels.

A row whose return or threshold is unknown is labelled 0, never NULL, and
stays in the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import rolling as R
from ..functions.rolling import SeriesWindow
from ..session import small_table

FIXED_THRESHOLD = 0.01
DYNAMIC_WINDOW, DYNAMIC_MIN, DYNAMIC_K = 21, 14, 0.7

# Class lists per target.
THREE_CLASSES = [-1, 0, 1]
TWO_CLASSES = [0, 1]


def target_classes(target: str) -> list[int]:
    return THREE_CLASSES if target.startswith(("label_", "research_label")) else TWO_CLASSES


def target_class_table(spark, targets: Sequence[str]) -> DataFrame:
    return small_table(spark, [(t, target_classes(t)) for t in targets], "target string, classes array<int>")


def forward_target(df: DataFrame, w: SeriesWindow) -> DataFrame:
    """Next row's date and return."""
    return df.withColumns(
        {
            "target_end_date": F.lead(w.order, 1).over(w.rows),
            "target_return_1d": N.ratio_change(F.lead("close", 1).over(w.rows), F.col("close")),
        }
    )


def three_way(ret: str | Column, threshold: Column) -> Column:
    ret = N.col(ret)
    return N.branch(ret > threshold, ret < -threshold)


def standard_labels(df: DataFrame, w: SeriesWindow, k: float = DYNAMIC_K) -> DataFrame:
    """Fixed and volatility-scaled labels; needs ``log_r1`` and ``target_return_1d``."""
    df = df.withColumns(
        {
            "threshold_fixed": F.lit(FIXED_THRESHOLD),
            "threshold_dynamic": F.lit(k) * R.std("log_r1", DYNAMIC_WINDOW, DYNAMIC_MIN, w),
        }
    )
    return df.withColumns(
        {
            "label_fixed": three_way("target_return_1d", F.col("threshold_fixed")),
            "label_dynamic": three_way("target_return_1d", F.col("threshold_dynamic")),
            "target_move_dynamic": N.flag(F.abs("target_return_1d") > F.col("threshold_dynamic")),
            "target_direction": N.flag(F.col("target_return_1d") > 0),
        }
    )


def with_dynamic_label(df: DataFrame, w: SeriesWindow, vol_window: int, k: float, log_return: str = "log_return_1d") -> DataFrame:
    """One (window, k) choice: ``research_threshold``, ``research_label``, ``research_move``."""
    sigma = R.std(log_return, vol_window, max(5, vol_window // 2), w)
    df = df.withColumn("research_threshold", F.lit(k) * sigma)
    return df.withColumns(
        {
            "research_label": three_way("target_return_1d", F.col("research_threshold")),
            "research_move": N.flag(F.abs("target_return_1d") > F.col("research_threshold")),
        }
    )


def label_grid(
    df: DataFrame,
    w: SeriesWindow,
    vol_windows: Sequence[int],
    ks: Sequence[float],
    log_return: str = "log_return_1d",
) -> DataFrame:
    """Every (vol_window, k) label in long form; each deviation is computed once per window."""
    sigmas = {f"__sd_{v}": R.std(log_return, v, max(5, v // 2), w) for v in vol_windows}
    df = df.withColumns(sigmas)
    grid = F.array(
        *[
            F.struct(F.lit(v).alias("vol_window"), F.lit(k).alias("k"), (F.lit(k) * F.col(f"__sd_{v}")).alias("threshold"))
            for v in vol_windows
            for k in ks
        ]
    )
    long = df.withColumn("__g", F.explode(grid)).drop(*sigmas).select("*", "__g.*").drop("__g")
    return long.withColumns(
        {
            "label": three_way("target_return_1d", F.col("threshold")),
            "move": N.flag(F.abs("target_return_1d") > F.col("threshold")),
        }
    )


def classic_labels(df: DataFrame, w: SeriesWindow) -> DataFrame:
    """Next-row percent change cut at +-1 %, then rows with any unknown value dropped."""
    change = N.ratio_change(F.lead("close", 1).over(w.rows), F.col("close"))
    df = df.withColumn("return", change)
    label = N.branch(F.col("return") > FIXED_THRESHOLD, F.col("return") < -FIXED_THRESHOLD)
    return df.withColumn("label", label).na.drop("any")


def zero_based(label: str) -> Column:
    return F.col(label) + F.lit(1)
