"""From panel and external tables to the labelled model dataset."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import SeriesWindow
from ..operators import external as X
from ..operators import labels as L
from ..operators import peers as P
from ..operators import price as PR
from ..operators.cleaning import finite_only
from ..operators.panel import series_gate

TARGETS = (
    "target_end_date", "target_return_1d", "threshold_fixed", "threshold_dynamic",
    "label_fixed", "label_dynamic", "target_move_dynamic", "target_direction",
)


def column_name(text: str) -> str:
    """A source name as part of a column name."""
    return re.sub(r"[^0-9a-z]+", "_", text.lower()).strip("_")


def series_dataset(panel: DataFrame, k: float = L.DYNAMIC_K, features: Sequence[str] | None = None) -> DataFrame:
    """Price features and targets of every series: one exchange by series."""
    w = SeriesWindow()
    df = PR.price_features(panel, w)
    df = L.standard_labels(L.forward_target(df, w), w, k)
    keep = features or PR.feature_names()
    return finite_only(df.select("series_id", "date", "close", *keep, *TARGETS))


def peer_matrix(panel: DataFrame, anchor_id: str, peers: Sequence[str]) -> DataFrame:
    """Peer and basket features of the anchor, one row per date."""
    w = SeriesWindow()
    returns = P.short_returns(series_gate(panel, ["series_id"], "close", P.PEER_GATE), w)
    known = [p for p in peers if p != anchor_id]
    pairs = P.peer_features(returns, anchor_id)
    names = {
        "peer_return_1d": "{p}_return_1d", "peer_return_7d": "{p}_return_7d",
        "minus_peer_1d": "minus_{p}_1d", "minus_peer_7d": "minus_{p}_7d", "peer_corr_30d": "{p}_corr_30d",
    }
    wide = pairs.groupBy("date").agg(
        *[
            F.max(F.when(F.col("peer_id") == p, F.col(src))).alias("crypto_" + dst.format(p=column_name(p)))
            for p in known
            for src, dst in names.items()
        ]
    )
    basket = P.basket(returns, anchor_id)
    own = P.anchor_vs_basket(returns, basket, anchor_id).drop("series_id", "r1", "r7")
    own = own.withColumnsRenamed({c: f"crypto_{c}" for c in own.columns if c != "date"})
    return own.join(wide, "date", "left")


def macro_matrix(calendar_rows: DataFrame, sparse: DataFrame, names: Sequence[str], anchor_returns: DataFrame) -> DataFrame:
    """Lagged features of sparse series on the anchor's dates, one column set per series."""
    sparse = series_gate(sparse, ["macro_id"], "close", X.SPARSE_GATE)
    keyed = sparse.select("macro_id").distinct().join(F.broadcast(calendar_rows.select("date")))  # one row per day
    rows = keyed.join(sparse.select("macro_id", "date", "close"), ["macro_id", "date"], "left").join(
        anchor_returns.select("date", F.col("r1").alias("anchor_r1")), "date", "left"
    )
    w = SeriesWindow(("macro_id",), "date")
    feats = X.lagged_macro(rows, w, "close", "anchor_r1")
    cols = ["ret_1d_lag1", "ret_5d_lag1", "ret_20d_lag1", "vol_20d_lag1", "corr_30d_lag1", "staleness_days_lag1"]
    return feats.groupBy("date").agg(
        *[F.max(F.when(F.col("macro_id") == n, F.col(c))).alias(f"macro_{column_name(n)}_{c}") for n in names for c in cols]
    )


def exogenous_matrix(calendar_rows: DataFrame, metrics: DataFrame, names: Sequence[str], gate: DataFrame | None = None) -> DataFrame:
    """Lagged features of exogenous metrics on the anchor's dates."""
    metrics = series_gate(metrics, ["metric"], "value", X.SPARSE_GATE)
    keyed = metrics.select("metric").distinct().join(F.broadcast(calendar_rows.select("date")))  # one row per day
    rows = keyed.join(metrics.select("metric", "date", "value"), ["metric", "date"], "left")
    feats = X.exogenous(rows, SeriesWindow(("metric",), "date"), "value", gate)
    cols = ["lag1", "diff_1d", "diff_7d", "z30", "z90", "ma7_vs_ma30"] + (
        ["log_change_1d", "log_change_7d"] if gate is not None else []
    )
    return feats.groupBy("date").agg(
        *[F.max(F.when(F.col("metric") == n, F.col(c))).alias(f"ext_{column_name(n)}_{c}") for n in names for c in cols]
    )


def anchor_dataset(
    panel: DataFrame,
    anchor_id: str,
    peers: Sequence[str],
    sparse: DataFrame,
    sparse_names: Sequence[str],
    metrics: DataFrame,
    metric_names: Sequence[str],
    gate: DataFrame | None = None,
    k: float = L.DYNAMIC_K,
) -> tuple[DataFrame, Mapping[str, list[str]]]:
    """The full model dataset of one anchor and the family of each feature."""
    own = series_dataset(panel.filter(F.col("series_id") == anchor_id), k)
    returns = P.short_returns(panel.filter(F.col("series_id") == anchor_id), SeriesWindow())
    crypto = peer_matrix(panel, anchor_id, peers)
    macro = macro_matrix(own, sparse, sparse_names, returns)
    ext = exogenous_matrix(own, metrics, metric_names, gate)
    df = own.join(crypto, "date", "left").join(macro, "date", "left").join(ext, "date", "left")
    families = {
        "price_core": PR.feature_names(),
        "crypto": [c for c in crypto.columns if c != "date"],
        "macro": [c for c in macro.columns if c != "date" and "corr_30d" not in c],
        "macro_corr": [c for c in macro.columns if "corr_30d" in c],
        "onchain": [c for c in ext.columns if c != "date" and "sentiment" not in c],
        "sentiment": [c for c in ext.columns if c != "date" and "sentiment" in c],
    }
    return finite_only(df), families
