"""Alignment joins on the calendar."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import SeriesWindow, carry_forward


def outer_by_date(frames: Sequence[DataFrame], date: str = "date") -> DataFrame:
    """Full outer equi-join of a handful of wide tables."""
    return reduce(lambda a, b: a.join(b, date, "full"), frames)


def outer_from_long(long: DataFrame, index: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """The same result from a long table: one shuffle instead of one per source."""
    return long.groupBy(*index).pivot(name, list(names)).agg(F.first(value, ignorenulls=True))


def on_spine(spine: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join onto the spine; Spark picks broadcast or sort-merge by measured size."""
    return spine.join(table, list(keys), "left")


def last_known(spine_rows: DataFrame, value: str, out: str, observed: str, w: SeriesWindow) -> DataFrame:
    """Last known value and its date for every spine row (backward as-of)."""
    return spine_rows.withColumns(
        {
            out: carry_forward(value, w),
            observed: F.last(F.when(F.col(value).isNotNull(), F.col(w.order)), ignorenulls=True).over(w.so_far),
        }
    )


def anchor_with_peers(panel: DataFrame, anchor_id: str, columns: Sequence[str], date: str = "date") -> DataFrame:
    """Anchor rows beside each peer's row of the same date.

    The broadcast side is the anchor alone: one row per calendar day and the
    named columns, whatever the number of peers.
    """
    anchor = panel.filter(F.col("series_id") == anchor_id).select(
        F.col(date), F.lit(anchor_id).alias("anchor_id"), *[F.col(c).alias(f"anchor_{c}") for c in columns]
    )
    peers = panel.filter(F.col("series_id") != anchor_id).select(
        F.col("series_id").alias("peer_id"), F.col(date), *[F.col(c).alias(f"peer_{c}") for c in columns]
    )
    return peers.join(F.broadcast(anchor), date)


def missing_configs(grid: DataFrame, results: DataFrame, key: str = "config_hash") -> DataFrame:
    """Configurations that have no stored result yet."""
    return grid.join(results.select(key), key, "left_anti")


def common_support(predictions: DataFrame, row_keys: Sequence[str], model: str, n_models: int) -> DataFrame:
    """Rows predicted by every model."""
    seen = predictions.groupBy(*row_keys).agg(F.count_distinct(model).alias("__m"))
    return predictions.join(seen.filter(F.col("__m") == n_models).drop("__m"), list(row_keys), "left_semi")
