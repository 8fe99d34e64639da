"""Row-count rolling statistics over an ordered series.

``SeriesWindow`` names the partition keys and the order once, so every
statistic of a family shares one exchange and one sort.  ``min_rows`` counts
non-null values inside the frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numeric import col


@dataclass(frozen=True)
class SeriesWindow:
    keys: tuple[str, ...] = ("series_id",)
    order: str = "date"

    @property
    def rows(self):
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def last(self, n: int):
        return self.rows.rowsBetween(-(n - 1), 0)

    @property
    def so_far(self):
        return self.rows.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def before(self):
        return self.rows.rowsBetween(Window.unboundedPreceding, -1)

    def with_keys(self, *keys: str) -> "SeriesWindow":
        return SeriesWindow(tuple(keys), self.order)


def lag(c, n: int, w: SeriesWindow) -> Column:
    return F.lag(col(c), n).over(w.rows)


def enough(c, n: int, min_rows: int, w: SeriesWindow, value: Column) -> Column:
    return F.when(F.count(col(c)).over(w.last(n)) >= min_rows, value)


def mean(c, n: int, min_rows: int, w: SeriesWindow) -> Column:
    return enough(c, n, min_rows, w, F.avg(col(c)).over(w.last(n)))


def std(c, n: int, min_rows: int, w: SeriesWindow) -> Column:
    """Sample standard deviation; NULL for a single value."""
    return enough(c, n, max(2, min_rows), w, F.stddev_samp(col(c)).over(w.last(n)))


def covariance(x, y, n: int, min_rows: int, w: SeriesWindow) -> Column:
    """Sample covariance over pairwise-complete rows."""
    pair = F.when(col(x).isNotNull() & col(y).isNotNull(), F.lit(1))
    enough_pairs = F.count(pair).over(w.last(n)) >= max(2, min_rows)
    return F.when(enough_pairs, F.covar_samp(col(x), col(y)).over(w.last(n)))


def correlation(x, y, n: int, min_rows: int, w: SeriesWindow) -> Column:
    """Pearson correlation over pairwise-complete rows, NULL on a constant side."""
    known = col(x).isNotNull() & col(y).isNotNull()
    px, py = F.when(known, col(x)), F.when(known, col(y))
    frame = w.last(n)
    varies = (F.max(px).over(frame) > F.min(px).over(frame)) & (F.max(py).over(frame) > F.min(py).over(frame))
    value = F.try_divide(
        F.covar_samp(px, py).over(frame),
        F.stddev_samp(px).over(frame) * F.stddev_samp(py).over(frame),
    )
    return F.when((F.count(px).over(frame) >= max(2, min_rows)) & varies, value)


def beta(asset, market, n: int, w: SeriesWindow) -> Column:
    """Covariance over pair rows divided by the variance of every market row."""
    need = max(10, n // 2)
    frame = w.last(n)
    var = F.when(F.count(col(market)).over(frame) >= need, F.var_samp(col(market)).over(frame))
    return F.try_divide(covariance(asset, market, n, need, w), var)


def percentile_rank(c, n: int, min_rows: int, w: SeriesWindow) -> Column:
    """Share of the frame at or below the current value, ties averaged."""
    seen = F.collect_list(col(c)).over(w.last(n))
    below = F.size(F.filter(seen, lambda v: v < col(c)))
    equal = F.size(F.filter(seen, lambda v: v == col(c)))
    size = F.size(seen)
    rank = (below + (equal + F.lit(1)) / F.lit(2.0)) / size
    return F.when(col(c).isNotNull() & (size >= min_rows), rank)


class Frames:
    """Rolling statistics of many windows that share their underlying aggregates.

    Spark recomputes a sliding frame for every row, so its cost grows with the
    window.  Up to ``DIRECT`` rows that is cheap.  For longer windows rows are
    cut into runs of the window's length: any window is then the tail of one run
    plus the head of the next, both are running aggregates (constant work per
    row), and the two sides are merged with the usual update of counts, means
    and central moments.  Nothing is subtracted, so no precision is lost.

    Each (function, column, length) is computed once however often it is asked for.
    """

    DIRECT = 21
    STATES = {
        "count": ("n",),
        "avg": ("n", "mean"),
        "stddev_samp": ("n", "mean", "var"),
        "skewness": ("n", "mean", "var", "skew"),
        "max": ("max",),
        "min": ("min",),
    }

    def __init__(self, w: SeriesWindow):
        self.w = w
        self.direct: dict[str, Column] = {}
        self.merged: dict[int, dict[str, tuple[str, str]]] = {}
        self.values: dict[int, dict[str, Column]] = {}

    def part(self, function: str, c: str, n: int) -> Column:
        name = f"__{function}_{c}_{n}"
        if n <= self.DIRECT:
            if name not in self.direct:
                self.direct[name] = getattr(F, function)(c).over(self.w.last(n))
            return F.col(name)
        states = self.merged.setdefault(n, {})
        for state in self.STATES[function]:
            states[f"{state}_{c}"] = (state, c)
        self.values.setdefault(n, {})[name] = self._merge(function, c, n)
        return F.col(name)

    def enough(self, c: str, n: int, min_rows: int, value: Column) -> Column:
        return F.when(self.part("count", c, n) >= min_rows, value)

    def mean(self, c: str, n: int, min_rows: int) -> Column:
        return self.enough(c, n, min_rows, self.part("avg", c, n))

    def std(self, c: str, n: int, min_rows: int) -> Column:
        return self.enough(c, n, max(2, min_rows), self.part("stddev_samp", c, n))

    def skew(self, c: str, n: int, min_rows: int) -> Column:
        """Bias-corrected skewness; 0 on a constant window."""
        cnt = self.part("count", c, n).cast("double")
        adjusted = F.try_divide(F.sqrt(cnt * (cnt - 1)), cnt - 2) * self.part("skewness", c, n)
        flat = self.part("stddev_samp", c, n) == 0
        return self.enough(c, n, max(3, min_rows), F.when(flat, F.lit(0.0)).otherwise(adjusted))

    def add(self, df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        if self.direct:
            df = df.withColumns(self.direct)
        if self.merged:
            df = self._two_sided(df.withColumn("__pos", F.row_number().over(self.w.rows)))
        return df.withColumns(columns).drop(*self.direct, *(v for vs in self.values.values() for v in vs), "__pos")

    def _two_sided(self, df: DataFrame) -> DataFrame:
        """Tail and head of the two runs under each window, for all lengths in a few steps."""
        keys, order, lengths = self.w.keys, self.w.order, list(self.merged)
        df = df.withColumns({f"__run_{n}": F.floor((F.col("__pos") - 1) / n) for n in lengths})
        tails, heads, lagged, values = {}, {}, {}, {}
        for n in lengths:
            run = Window.partitionBy(*keys, f"__run_{n}")
            tails[f"__tail_{n}"] = self._running(n, run.orderBy(F.col(order).desc()))
            heads[f"__head_{n}"] = self._running(n, run.orderBy(order))
            in_order = Window.partitionBy(*keys).orderBy(f"__run_{n}", order)
            # the last row of a run has its whole window in the head
            lagged[f"__tail_{n}"] = F.when(F.col("__pos") % n != 0, F.lag(f"__tail_{n}", n - 1).over(in_order))
            values.update(self.values[n])
        df = df.withColumns(tails).withColumns({**heads, **lagged})
        return df.withColumns(values).drop(*(f"__{k}_{n}" for n in lengths for k in ("run", "tail", "head")))

    def _running(self, n: int, spec) -> Column:
        frame = spec.rowsBetween(Window.unboundedPreceding, 0)
        return F.struct(*[self._state(s, c).over(frame).alias(k) for k, (s, c) in self.merged[n].items()])

    @staticmethod
    def _state(state: str, c: str) -> Column:
        return {
            "n": F.count, "mean": F.avg, "var": F.var_pop, "skew": F.skewness, "max": F.max, "min": F.min,
        }[state](c)

    @staticmethod
    def _merge(function: str, c: str, n: int) -> Column:
        """The statistic of tail and head together, as SQL text (one parse instead of many calls)."""
        a, b = (lambda s: f"__tail_{n}.{s}_{c}"), (lambda s: f"__head_{n}.{s}_{c}")
        if function in ("max", "min"):
            return F.expr(f"{'greatest' if function == 'max' else 'least'}({a(function)}, {b(function)})")
        na, nb = f"coalesce({a('n')}, 0)", f"coalesce({b('n')}, 0)"
        total = f"({na} + {nb})"
        if function == "count":
            return F.expr(total)
        ma, mb = f"coalesce({a('mean')}, {b('mean')})", f"coalesce({b('mean')}, {a('mean')})"
        if function == "avg":
            return F.expr(f"{ma} + ({mb} - {ma}) * try_divide({nb}, {total})")
        qa, qb = f"(coalesce({a('var')}, 0D) * {na})", f"(coalesce({b('var')}, 0D) * {nb})"
        gap = f"({mb} - {ma})"
        second = f"({qa} + {qb} + {gap} * {gap} * try_divide(double({na}) * {nb}, {total}))"
        if function == "stddev_samp":
            return F.expr(f"sqrt(try_divide({second}, {total} - 1))")
        third = (
            f"(coalesce({a('skew')}, 0D) * {qa} * sqrt(coalesce(try_divide({qa}, {na}), 0D))"
            f" + coalesce({b('skew')}, 0D) * {qb} * sqrt(coalesce(try_divide({qb}, {nb}), 0D))"
            f" + {gap} * {gap} * {gap} * {na} * {nb} * try_divide({na} - {nb}, double({total}) * {total})"
            f" + 3 * {gap} * try_divide({na} * {qb} - {nb} * {qa}, {total}))"
        )
        return F.expr(f"try_divide({third}, {second} * sqrt(try_divide({second}, {total})))")


def carry_forward(c, w: SeriesWindow) -> Column:
    return F.last(col(c), ignorenulls=True).over(w.so_far)
