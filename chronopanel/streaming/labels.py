"""Labels that come after the predictions they belong to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def late_labels(
    predictions: DataFrame, labels: DataFrame, keys: Sequence[str], made: str, known: str, horizon: str, lateness: str = "0 seconds"
) -> DataFrame:
    """Each prediction with the label that became known within ``horizon`` after it was made, or with nulls if none did.

    ``made`` and ``known`` are the event times of the two streams.  Both carry a watermark, so the state of either side ends:
    a prediction waits until the labels' watermark has passed its horizon and is then given out unlabelled.  Labels without
    a prediction, before it, or beyond the horizon are left out; several labels give several rows; null keys match nothing.
    """
    left = predictions.withWatermark(made, lateness)
    right = labels.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in labels.columns if c not in keys]).withWatermark(known, lateness)
    same = F.lit(True)
    for k in keys:
        same &= F.col(k) == F.col(f"__{k}")
    in_time = (F.col(known) >= F.col(made)) & (F.col(known) <= F.col(made) + F.expr(f"INTERVAL {horizon}"))
    return left.join(right, same & in_time, "left_outer").drop(*[f"__{k}" for k in keys])
