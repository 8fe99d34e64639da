"""Lagged features of sparse and exogenous series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import rolling as R
from ..functions.rolling import SeriesWindow
from .joins import last_known

SPARSE_GATE = 30


def lagged_macro(rows: DataFrame, w: SeriesWindow, value: str = "close", anchor_return: str | None = None) -> DataFrame:
    """Forward-filled returns, volatility and staleness, all delayed by one row.

    ``rows`` lies on the spine, with NULL where the series was not observed.
    """
    df = last_known(rows, value, "__known", "__seen", w)
    df = df.withColumns(
        {
            "__r1": N.ratio_change(F.col("__known"), R.lag("__known", 1, w)),
            "__r5": N.ratio_change(F.col("__known"), R.lag("__known", 5, w)),
            "__r20": N.ratio_change(F.col("__known"), R.lag("__known", 20, w)),
            "__stale": F.datediff(F.col(w.order), F.col("__seen")).cast("double"),
        }
    )
    df = df.withColumn("__vol", R.std("__r1", 20, 10, w))
    cols = {
        "ret_1d_lag1": R.lag("__r1", 1, w),
        "ret_5d_lag1": R.lag("__r5", 1, w),
        "ret_20d_lag1": R.lag("__r20", 1, w),
        "vol_20d_lag1": R.lag("__vol", 1, w),
        "staleness_days_lag1": R.lag("__stale", 1, w),
    }
    if anchor_return:
        df = df.withColumn("__corr", R.correlation(anchor_return, "__r1", 30, 15, w))
        cols["corr_30d_lag1"] = R.lag("__corr", 1, w)
    out = df.withColumns(cols)
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def exogenous(rows: DataFrame, w: SeriesWindow, value: str = "value", gate: DataFrame | None = None) -> DataFrame:
    """Lagged level, differences, z-scores and mean ratio; log changes where the gate allows.

    ``gate`` has one row per key with ``active``; without it no log change is emitted.
    """
    df = rows.withColumn("lag1", R.lag(value, 1, w))
    cols = {
        "diff_1d": F.col("lag1") - R.lag("lag1", 1, w),
        "diff_7d": F.col("lag1") - R.lag("lag1", 7, w),
    }
    for n in (30, 90):
        need = max(10, n // 2)
        cols[f"z{n}"] = N.safe_div(F.col("lag1") - R.mean("lag1", n, need, w), R.std("lag1", n, need, w))
    cols["ma7_vs_ma30"] = N.ratio_change(R.mean("lag1", 7, 4, w), R.mean("lag1", 30, 15, w))
    df = df.withColumns(cols)
    if gate is None:
        return df
    logged = F.log1p(N.clip_low("lag1", 0.0))
    df = df.withColumn("__log", logged)
    df = df.withColumns(
        {
            "__lc1": F.col("__log") - R.lag("__log", 1, w),
            "__lc7": F.col("__log") - R.lag("__log", 7, w),
        }
    )
    keyed = df.join(gate.select(*w.keys, "active"), list(w.keys), "left")
    return keyed.withColumns(
        {
            "log_change_1d": F.when(F.col("active"), F.col("__lc1")),
            "log_change_7d": F.when(F.col("active"), F.col("__lc7")),
        }
    ).drop("__log", "__lc1", "__lc7", "active")
