"""Exponential means and running totals of fine panels, without a whole series in one task.

A mean is the recursion y = a * y_prev + b, and two such steps after another are one of the same kind.  So every row block is
reduced to one pair (a, b), the pairs of a series, one per block, are run through in order, and the blocks then go on from the
value before them.  Nothing depends on how long a series is: a block is the largest task, and the pairs are its rows over
``block_rows``.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import SeriesWindow
from ..session import stored
from .ewm import LONGEST_STEP, decayed_sum, transition
from .panel import BLOCK, POSITION


@dataclass(frozen=True)
class Mean:
    """Exponential mean of a column; the plain mean of its first ``seed_rows`` known values starts it."""

    value: str
    alpha: float
    seed_rows: int = 1


@dataclass(frozen=True)
class Total:
    """Running total of a column; a missing value adds nothing."""

    value: str


def _matching(keys, mark: str):
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{mark}{k}"))
    return same


def scan(df: DataFrame, items: Mapping[str, Mean | Total], w: SeriesWindow) -> DataFrame:
    """Add one column per entry to rows that carry their block and position (``panel.in_blocks`` with ``keep_place``).

    A missing value repeats the mean and lets the older weight decay for every skipped row; before the seed is complete the
    mean is missing.  The rows are written twice, so that what a block carries and the block itself come from the same rows.
    """
    keys = [*w.keys, BLOCK]
    inside, names = w.with_keys(*keys), [f"__of_{k}" for k in keys]
    renamed = [F.col(k).alias(n) for k, n in zip(keys, names)]
    means = {n: m for n, m in items.items() if isinstance(m, Mean)}
    values = sorted({m.value for m in items.values()})
    at = F.col(POSITION)
    rows = stored(df, "scan-rows")

    # what the blocks before hold: known values, their sum, the place of the last
    place = {v: F.max(F.when(F.col(v).isNotNull(), at)) for v in values}
    reduced = rows.groupBy(*keys).agg(
        *[F.count(v).alias(f"__n_{v}") for v in values], *[F.sum(v).alias(f"__t_{v}") for v in values], *[place[v].alias(f"__p_{v}") for v in values]
    )
    earlier = Window.partitionBy(*w.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    before = reduced.select(
        *renamed, *[F.sum(f"__{c}_{v}").over(earlier).alias(f"__b{c}_{v}") for c in "nt" for v in values], *[F.max(f"__p_{v}").over(earlier).alias(f"__bp_{v}") for v in values]
    )
    frame = rows.join(before, _matching(keys, "__of_")).drop(*names)
    here = {}
    for v in values:
        seen = F.coalesce(F.col(f"__bn_{v}"), F.lit(0)) + F.count(v).over(inside.so_far)
        total = F.sum(v).over(inside.so_far)
        here[f"__seen_{v}"] = seen
        here[f"__sum_{v}"] = F.coalesce(F.col(f"__bt_{v}") + total, f"__bt_{v}", total)
        here[f"__prev_{v}"] = F.coalesce(F.last(F.when(F.col(v).isNotNull(), at), ignorenulls=True).over(inside.before), f"__bp_{v}")
    frame = frame.withColumns(here).drop(*[f"__b{c}_{v}" for c in "ntp" for v in values])
    frame = frame.withColumns({n: F.col(f"__sum_{m.value}") for n, m in items.items() if isinstance(m, Total)})

    steps = {}
    for n, m in means.items():
        seen, known = F.col(f"__seen_{m.value}"), F.col(m.value).isNotNull()
        decay, step = transition(F.col(m.value), m.alpha, (at - F.col(f"__prev_{m.value}")).cast("double"))
        first, later = known & (seen == m.seed_rows), known & (seen > m.seed_rows)
        start = F.col(f"__sum_{m.value}") / F.lit(float(m.seed_rows)) if m.seed_rows > 1 else F.col(m.value)
        steps[f"__d_{n}"] = F.when(later, decay).otherwise(0.0)
        steps[f"__s_{n}"] = F.when(first, start).when(later, step).otherwise(0.0)
        steps[f"__live_{n}"] = seen >= m.seed_rows
    frame = frame.withColumns(steps).drop(*[f"__{c}_{v}" for c in ("seen", "sum", "prev") for v in values])
    if not means:
        return frame
    frame = frame.withColumns({f"__total_{n}": F.sum(f"__d_{n}").over(inside.so_far) for n in means})
    for n in means:
        frame = decayed_sum(frame, f"__y_{n}", f"__s_{n}", f"__d_{n}", f"__total_{n}", inside)
    frame = stored(frame.drop(*[f"__{c}_{n}" for n in means for c in "ds"]), "scan-blocks")

    # one pair per block: how much of the value before it is left at its end, and what it adds
    pairs = frame.groupBy(*keys).agg(
        *[F.least(F.max(f"__total_{n}"), F.lit(LONGEST_STEP)).alias(f"__d_{n}") for n in means], *[F.max_by(f"__y_{n}", at).alias(f"__s_{n}") for n in means]
    )
    over = SeriesWindow(w.keys, BLOCK)
    pairs = pairs.withColumns({f"__t_{n}": F.sum(f"__d_{n}").over(over.so_far) for n in means})
    for n in means:
        pairs = decayed_sum(pairs, f"__e_{n}", f"__s_{n}", f"__d_{n}", f"__t_{n}", over)
    starts = pairs.select(*renamed, *[F.lag(f"__e_{n}").over(over.rows).alias(f"__start_{n}") for n in means])
    frame = frame.join(starts, _matching(keys, "__of_")).drop(*names)
    left = lambda n: F.coalesce(F.exp(-F.col(f"__total_{n}")) * F.col(f"__start_{n}"), F.lit(0.0))
    frame = frame.withColumns({n: F.when(F.col(f"__live_{n}"), F.col(f"__y_{n}") + left(n)) for n in means})
    return frame.drop(*[f"__{c}_{n}" for n in means for c in ("total", "y", "live", "start")])
