"""Building panels and laying them out for windows.

Layout rule.  A panel has one row per series and period.  For daily bars the
period key bounds a series at one row per calendar day (about 36,500 per
century), however many raw rows a hot series has: those are absorbed by the
map-side half of the bar aggregation.  Windows can then be partitioned by
series.  A finer panel (minutes, ticks) has no such bound, so it goes through
``in_blocks``: rows get a global position from two-phase counting, are cut into
blocks of ``block_rows`` and every block carries a copy of the preceding
``lookback`` rows.  Results are the same, the largest task is one block.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import col
from ..functions.rolling import SeriesWindow

BLOCK = "__block"
POSITION = "__position"
BLOCK_ROWS = 65536


def bars(
    raw: DataFrame,
    series: Column,
    period: Column,
    trade_order: Column,
    price: Column,
    volume: Column,
    period_name: str = "date",
) -> DataFrame:
    """Open/high/low/close/volume per series and period, one shuffle of partial aggregates.

    ``trade_order`` decides open and close; give a number or decimal (not a
    struct) so that the aggregation buffer stays fixed-width and hash based.
    """
    staged = raw.select(
        series.alias("series_id"),
        period.alias(period_name),
        trade_order.alias("__ord"),
        price.alias("__price"),
        volume.alias("__volume"),
    )
    return (
        staged.groupBy("series_id", period_name)
        .agg(
            F.min_by("__price", "__ord").alias("open"),
            F.max("__price").alias("high"),
            F.min("__price").alias("low"),
            F.max_by("__price", "__ord").alias("close"),
            F.sum("__volume").alias("volume"),
        )
        .withColumn("adj_close", F.col("close"))
        .select("series_id", period_name, "open", "high", "low", "close", "adj_close", "volume")
    )


def with_positions(df: DataFrame, keys: Sequence[str], order: str, bucket: Column) -> DataFrame:
    """Row number of each row inside its keys, without sorting a whole key in one task.

    ``bucket`` must grow with ``order`` (for example the month of a date).
    Counts per bucket are summed first; rows are only sorted inside a bucket.
    """
    cut = df.withColumn("__bucket", bucket)
    sizes = cut.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__bucket").alias("__k_bucket"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"),
    )
    inside = Window.partitionBy(*keys, "__bucket").orderBy(order)
    match = F.col("__bucket").eqNullSafe(F.col("__k_bucket"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    numbered = cut.withColumn("__inside", F.row_number().over(inside))
    return (
        numbered.join(starts, match)
        .withColumn(POSITION, F.col("__start") + F.col("__inside"))
        .drop("__bucket", "__k_bucket", "__start", "__inside", *[f"__k_{k}" for k in keys])
    )


def in_blocks(
    df: DataFrame,
    compute: Callable[[DataFrame, SeriesWindow], DataFrame],
    w: SeriesWindow,
    bucket: Column,
    lookback: int | None,
    lookahead: int = 0,
    block_rows: int = BLOCK_ROWS,
    keep_place: bool = False,
) -> DataFrame:
    """Run ``compute`` over overlapping row blocks instead of whole series.

    ``lookback``/``lookahead`` are the rows any output may depend on; the
    copies are dropped again, so each input row yields one output row.  A
    compute without bound (``lookback`` None: running totals, last known
    values) is refused; ``so_far`` and ``scan`` are made for it.
    ``keep_place`` leaves the block and position of each row for a scan.
    """
    if lookback is None:
        raise ValueError("blocks need a bounded look-back; running totals and last known values come from so_far")
    if block_rows <= max(lookback, lookahead):
        raise ValueError("block_rows must exceed the overlap")
    placed = with_positions(df, w.keys, w.order, bucket)
    home = F.floor((F.col(POSITION) - 1) / F.lit(block_rows)).cast("long")
    offset = (F.col(POSITION) - 1) % F.lit(block_rows)
    targets = F.array_compact(
        F.array(
            F.col("__home"),
            F.when(offset >= block_rows - lookback, F.col("__home") + 1) if lookback else F.lit(None).cast("long"),
            F.when((offset < lookahead) & (F.col("__home") > 0), F.col("__home") - 1)
            if lookahead
            else F.lit(None).cast("long"),
        )
    )
    spread = placed.withColumn("__home", home).withColumn(BLOCK, F.explode(targets))
    result = compute(spread, w.with_keys(*w.keys, BLOCK))
    result = result.filter(F.col(BLOCK) == F.col("__home")).drop("__home")
    return result if keep_place else result.drop(BLOCK, POSITION)


def so_far(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    bucket: Column,
    totals: Mapping[str, str | Column] | None = None,
    latest: Mapping[str, str | Column] | None = None,
) -> DataFrame:
    """Running totals and last known values from the first row of a series on, without a whole series in one task.

    Both reach back without bound, so row blocks with an overlap cannot give them.  ``bucket`` must grow with ``order``:
    buckets are reduced first, their few rows are carried forward, and rows are only sorted inside a bucket.  Missing
    values add nothing; before the first known one the result is missing.
    """
    totals, latest = dict(totals or {}), dict(latest or {})
    given = {f"__v_{n}": col(e) for n, e in (totals | latest).items()}
    cut = df.withColumn("__bucket", bucket).withColumns(given)
    known = lambda n: F.when(F.col(f"__v_{n}").isNotNull(), F.col(order))
    reduced = cut.groupBy(*keys, "__bucket").agg(
        *[F.sum(f"__v_{n}").alias(f"__r_{n}") for n in totals], *[F.max_by(f"__v_{n}", known(n)).alias(f"__r_{n}") for n in latest]
    )
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = reduced.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__bucket").alias("__k_bucket"),
        *[F.sum(f"__r_{n}").over(earlier).alias(f"__s_{n}") for n in totals],
        *[F.last(f"__r_{n}", ignorenulls=True).over(earlier).alias(f"__s_{n}") for n in latest],
    )
    inside = Window.partitionBy(*keys, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = {f"__l_{n}": F.sum(f"__v_{n}").over(inside) for n in totals}
    local |= {f"__l_{n}": F.last(f"__v_{n}", ignorenulls=True).over(inside) for n in latest}
    match = F.col("__bucket").eqNullSafe(F.col("__k_bucket"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = cut.withColumns(local).join(starts, match)
    both = {n: F.coalesce(F.col(f"__s_{n}") + F.col(f"__l_{n}"), f"__s_{n}", f"__l_{n}") for n in totals}
    both |= {n: F.coalesce(f"__l_{n}", f"__s_{n}") for n in latest}
    helpers = [f"__{k}_{n}" for n in both for k in "vls"]
    return joined.withColumns(both).drop("__bucket", "__k_bucket", *[f"__k_{k}" for k in keys], *helpers)


def calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """Distinct dates, their 0-based index and the next date (at most one row per day)."""
    days = df.select(date).where(F.col(date).isNotNull()).distinct()
    w = Window.orderBy(date)
    return days.select(
        F.col(date),
        (F.row_number().over(w) - 1).alias("day_index"),
        F.lead(date).over(w).alias("next_date"),
    )


def spine(df: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Every key on every calendar day between the first and last date of the table."""
    span = df.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    who = df.select(*keys).distinct()
    return who.join(F.broadcast(span)).select(*keys, F.explode(F.sequence("lo", "hi")).alias(date))


def series_gate(df: DataFrame, keys: Sequence[str], value: str, least: int) -> DataFrame:
    """Keep series with at least ``least`` known values."""
    good = df.groupBy(*keys).agg(F.count(col(value)).alias("__n")).filter(F.col("__n") >= least).drop("__n")
    return df.join(good, list(keys), "left_semi")


def nonnegative_gate(df: DataFrame, keys: Sequence[str], value: str, share: float = 0.95) -> DataFrame:
    """Keys and whether a log-change is defined: share of rows >= 0, a missing row counting against."""
    ok = F.coalesce(col(value) >= 0, F.lit(False)).cast("double")
    return df.groupBy(*keys).agg(F.avg(ok).alias("nonneg_share")).withColumn("active", F.col("nonneg_share") > share)


def to_wide(long: DataFrame, index: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    return long.groupBy(*index).pivot(name, list(names)).agg(F.first(value, ignorenulls=True))


def to_long(wide: DataFrame, index: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return wide.unpivot(list(index), list(columns), name, value)
