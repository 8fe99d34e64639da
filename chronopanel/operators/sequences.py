"""Fixed-length model input sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import SeriesWindow


def sequences(df: DataFrame, w: SeriesWindow, features: Sequence[str], label: str, length: int = 60) -> DataFrame:
    """The ``length`` rows before each row, as an array of feature arrays, with the row's own label."""
    frame = w.rows.rowsBetween(-length, -1)
    step = F.array(*[F.col(f).cast("double") for f in features])
    return (
        df.withColumn("sequence", F.collect_list(step).over(frame))
        .filter(F.size("sequence") == length)
        .select(*w.keys, w.order, "sequence", F.col(label).alias("label"))
    )
