"""Exponentially weighted means as window sums (no Python, no per-series loop).

The recursion ``y = A*y_prev + s`` is unrolled to a sum of ``s`` terms scaled
by the decay accumulated since.  Scaling by exp(decay) would overflow on long
series, so a series is cut where the accumulated decay passes ``CUT``: inside a
cut the sums stay small and precise, and anything older than the previous cut
has lost a factor exp(-CUT), far below double precision.  A missing value repeats the
last mean and lets the older weight decay for every skipped row.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import SeriesWindow

CUT = 60.0
LONGEST_STEP = 600.0


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


def wilder_alpha(n: int) -> float:
    return 1.0 / n


def ewm_lookback(alpha: float) -> int:
    """Rows after which older values weigh less than 1e-19 (overlap for blocked layouts)."""
    return math.ceil(45.0 / -math.log(1.0 - alpha))


def ewm(
    df: DataFrame,
    value: str,
    alphas: Mapping[str, float],
    w: SeriesWindow,
    seed_rows: int | None = None,
) -> DataFrame:
    """Add one exponentially weighted mean of ``value`` per entry of ``alphas``.

    The first known value starts the recursion; with ``seed_rows`` the plain
    mean of the first ``seed_rows`` known values does, and earlier rows are NULL.
    """
    x, pos, prev = "__x", "__pos", "__prev"
    start = F.col(value)
    if seed_rows:
        seen = F.count(value).over(w.so_far)
        start = (
            F.when(F.col(value).isNull() | (seen < seed_rows), F.lit(None).cast("double"))
            .when(seen == seed_rows, F.avg(value).over(w.so_far))
            .otherwise(F.col(value))
        )
    base = df.withColumns({x: start, pos: F.row_number().over(w.rows)})
    base = base.withColumn(prev, F.last(F.when(F.col(x).isNotNull(), F.col(pos)), ignorenulls=True).over(w.before))
    gap = (F.col(pos) - F.col(prev)).cast("double")
    absent, first = F.col(x).isNull(), F.col(prev).isNull()

    steps: dict[str, Column] = {}
    decays: dict[str, Column] = {}
    for name, alpha in alphas.items():
        decay, step = transition(F.col(x), alpha, gap)
        decays[f"__d_{name}"] = F.when(absent | first, F.lit(0.0)).otherwise(decay)
        steps[f"__s_{name}"] = F.when(absent, F.lit(0.0)).when(first, F.col(x)).otherwise(step)
    frame = base.withColumns({**decays, **steps})
    frame = frame.withColumns({f"__total_{n}": F.sum(f"__d_{n}").over(w.so_far) for n in alphas})

    known = F.col(prev).isNotNull() | F.col(x).isNotNull()
    for name in alphas:
        frame = decayed_sum(frame, name, f"__s_{name}", f"__d_{name}", f"__total_{name}", w)
        frame = frame.withColumn(name, F.when(known, F.col(name)))
    scratch = [f"__{k}_{n}" for n in alphas for k in ("d", "s", "total")]
    return frame.drop(x, pos, prev, *scratch)


def decayed_sum(frame: DataFrame, name: str, step: str, decay: str, total: str, w: SeriesWindow) -> DataFrame:
    """Add ``name``, the recursion y = exp(-decay) * y_prev + step from zero on; ``total`` is the running sum of ``decay``.

    All windows of one sum run on a single sort by (keys, cut, order).
    """
    cut = "__cut"
    frame = frame.withColumn(cut, F.floor(F.col(total) / CUT))
    so_far = Window.partitionBy(*w.keys, cut).orderBy(w.order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*w.keys).orderBy(cut, w.order)
    frame = frame.withColumns(
        {"__entry": F.first(decay).over(so_far), "__level": F.sum(decay).over(so_far) - F.first(decay).over(so_far)}
    )
    terms = F.sum(F.col(step) * F.exp("__level")).over(so_far)
    frame = frame.withColumn("__part", terms * F.exp(-F.col("__level")))
    frame = frame.withColumn("__before", F.lag("__part").over(across))
    frame = frame.withColumn("__before", F.first("__before").over(so_far))
    carried = F.coalesce(F.col("__before") * F.exp(-(F.col("__level") + F.col("__entry"))), F.lit(0.0))
    return frame.withColumn(name, F.col("__part") + carried).drop(cut, "__entry", "__level", "__part", "__before")


def transition(value: Column, alpha: float, gap: Column) -> tuple[Column, Column]:
    """(decay, step) of a known value after ``gap`` rows: the older weight decays for each of them, then both are normalised."""
    rate = -math.log(1.0 - alpha)
    scale = F.exp(-gap * rate) + F.lit(alpha)
    return F.least(gap * rate + F.ln(scale), F.lit(LONGEST_STEP)), F.lit(alpha) * value / scale
