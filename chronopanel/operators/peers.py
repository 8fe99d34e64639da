"""Relations between an anchor series and its peers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import rolling as R
from ..functions.rolling import SeriesWindow
from .joins import anchor_with_peers
from .ranking import exact_median

PEER_GATE = 120


def short_returns(panel: DataFrame, w: SeriesWindow) -> DataFrame:
    """1- and 7-row returns of every series."""
    return panel.select(
        "series_id",
        w.order,
        N.ratio_change(F.col("close"), R.lag("close", 1, w)).alias("r1"),
        N.ratio_change(F.col("close"), R.lag("close", 7, w)).alias("r7"),
    )


def peer_features(returns: DataFrame, anchor_id: str) -> DataFrame:
    """Peer returns, relative strength and rolling correlation, one row per peer and date."""
    pairs = anchor_with_peers(returns, anchor_id, ["r1", "r7"])
    w = SeriesWindow(("peer_id",), "date")
    return pairs.select(
        "anchor_id",
        "peer_id",
        "date",
        F.col("peer_r1").alias("peer_return_1d"),
        F.col("peer_r7").alias("peer_return_7d"),
        (F.col("anchor_r1") - F.col("peer_r1")).alias("minus_peer_1d"),
        (F.col("anchor_r7") - F.col("peer_r7")).alias("minus_peer_7d"),
        R.correlation("anchor_r1", "peer_r1", 30, 15, w).alias("peer_corr_30d"),
    )


def basket(returns: DataFrame, anchor_id: str) -> DataFrame:
    """Cross-section of the peers per date: mean, exact median, dispersion, breadth."""
    peers = returns.filter(F.col("series_id") != anchor_id)
    stats = peers.groupBy("date").agg(
        F.avg("r1").alias("basket_return_1d"),
        F.avg("r7").alias("basket_return_7d"),
        F.stddev_samp("r1").alias("basket_dispersion_1d"),
        F.try_divide(F.count_if(F.col("r1") > 0).cast("double"), F.count("r1")).alias("basket_breadth_positive_1d"),
    )
    middle = exact_median(peers, ["date"], "r1", "basket_median_1d")
    return stats.join(middle, "date", "left")


def anchor_vs_basket(returns: DataFrame, basket_table: DataFrame, anchor_id: str) -> DataFrame:
    """Relative strength, correlation, beta and residual of the anchor against the basket."""
    own = returns.filter(F.col("series_id") == anchor_id).select("series_id", "date", "r1", "r7")
    df = own.join(basket_table, "date", "left")
    w = SeriesWindow()
    df = df.withColumns(
        {
            "minus_basket_1d": F.col("r1") - F.col("basket_return_1d"),
            "minus_basket_7d": F.col("r7") - F.col("basket_return_7d"),
            "basket_corr_30d": R.correlation("r1", "basket_return_1d", 30, 15, w),
            "basket_corr_90d": R.correlation("r1", "basket_return_1d", 90, 45, w),
            "basket_beta_30d": R.beta("r1", "basket_return_1d", 30, w),
            "basket_beta_90d": R.beta("r1", "basket_return_1d", 90, w),
        }
    )
    return df.withColumn("residual_1d", F.col("r1") - F.col("basket_beta_30d") * F.col("basket_return_1d"))
