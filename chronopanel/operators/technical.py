"""Classic chart indicators with textbook definitions.

Seeding: exponential means start from the plain mean of their first ``n``
known values; Wilder means (RSI, ATR) use the same seed with alpha = 1/n.
Bollinger bands use the population deviation.  Commodity channel uses the mean
absolute deviation around the window's own mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import rolling as R
from ..functions.rolling import SeriesWindow
from .ewm import ewm, span_alpha, wilder_alpha
from .panel import BLOCK_ROWS, in_blocks
from .scan import Mean, Total, scan


def sma(df: DataFrame, w: SeriesWindow, n: int = 50) -> DataFrame:
    return df.withColumn(f"sma_{n}", R.mean("close", n, n, w))


def ema(df: DataFrame, w: SeriesWindow, n: int = 20) -> DataFrame:
    return ewm(df, "close", {f"ema_{n}": span_alpha(n)}, w, seed_rows=n)


def wma(df: DataFrame, w: SeriesWindow, n: int = 20) -> DataFrame:
    """Linear weights, newest row heaviest."""
    parts = F.col("close") * F.lit(float(n))
    for k in range(1, n):
        parts = parts + R.lag("close", k, w) * F.lit(float(n - k))
    return df.withColumn(f"wma_{n}", parts / F.lit(n * (n + 1) / 2.0))


def macd_lines(df: DataFrame, w: SeriesWindow, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ewm(df, "close", {"__fast": span_alpha(fast)}, w, seed_rows=fast)
    df = ewm(df, "close", {"__slow": span_alpha(slow)}, w, seed_rows=slow)
    df = df.withColumn("macd", F.col("__fast") - F.col("__slow"))
    df = ewm(df, "macd", {"macd_signal": span_alpha(signal)}, w, seed_rows=signal)
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("__fast", "__slow")


def tema(df: DataFrame, w: SeriesWindow, n: int = 20) -> DataFrame:
    a = {k: span_alpha(n) for k in ("__e1", "__e2", "__e3")}
    df = ewm(df, "close", {"__e1": a["__e1"]}, w, seed_rows=n)
    df = ewm(df, "__e1", {"__e2": a["__e2"]}, w, seed_rows=n)
    df = ewm(df, "__e2", {"__e3": a["__e3"]}, w, seed_rows=n)
    return df.withColumn(f"tema_{n}", 3 * F.col("__e1") - 3 * F.col("__e2") + F.col("__e3")).drop(*a)


def _gains(df: DataFrame, w: SeriesWindow) -> DataFrame:
    df = df.withColumn("__diff", F.col("close") - R.lag("close", 1, w))
    return df.withColumns({"__gain": N.clip_low("__diff", 0.0), "__loss": N.clip_low(-F.col("__diff"), 0.0)})


def wilder_rsi(df: DataFrame, w: SeriesWindow, n: int = 14) -> DataFrame:
    df = _gains(df, w)
    df = ewm(df, "__gain", {"__ag": wilder_alpha(n)}, w, seed_rows=n)
    df = ewm(df, "__loss", {"__al": wilder_alpha(n)}, w, seed_rows=n)
    value = F.lit(100.0) * N.safe_div("__ag", F.col("__ag") + F.col("__al"))
    return df.withColumn(f"rsi_{n}", value).drop("__diff", "__gain", "__loss", "__ag", "__al")


def roc(df: DataFrame, w: SeriesWindow, n: int = 10) -> DataFrame:
    return df.withColumn("roc", F.lit(100.0) * N.ratio_change(F.col("close"), R.lag("close", n, w)))


def cci(df: DataFrame, w: SeriesWindow, n: int = 14) -> DataFrame:
    df = df.withColumn("__tp", (F.col("high") + F.col("low") + F.col("close")) / F.lit(3.0))
    df = df.withColumns({"__avg": R.mean("__tp", n, n, w), "__seen": F.collect_list("__tp").over(w.last(n))})
    away = F.aggregate("__seen", F.lit(0.0), lambda acc, v: acc + F.abs(v - F.col("__avg"))) / F.lit(float(n))
    value = N.safe_div(F.col("__tp") - F.col("__avg"), F.lit(0.015) * away)
    return df.withColumn(f"cci_{n}", F.when(F.col("__avg").isNotNull(), value)).drop("__tp", "__avg", "__seen")


def willr(df: DataFrame, w: SeriesWindow, n: int = 14) -> DataFrame:
    high = R.enough("high", n, n, w, F.max("high").over(w.last(n)))
    low = R.enough("low", n, n, w, F.min("low").over(w.last(n)))
    return df.withColumn(f"willr_{n}", F.lit(-100.0) * N.safe_div(high - F.col("close"), high - low))


def _true_range(w: SeriesWindow) -> Column:
    prev = R.lag("close", 1, w)
    span = F.col("high") - F.col("low")
    wide = F.greatest(span, F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    return F.when(prev.isNotNull() & span.isNotNull(), wide)


def atr(df: DataFrame, w: SeriesWindow, n: int = 14) -> DataFrame:
    df = df.withColumn("__tr", _true_range(w))
    return ewm(df, "__tr", {f"atr_{n}": wilder_alpha(n)}, w, seed_rows=n).drop("__tr")


def bbands(df: DataFrame, w: SeriesWindow, n: int = 20, width: float = 2.0) -> DataFrame:
    avg = R.mean("close", n, n, w)
    dev = R.enough("close", n, n, w, F.stddev_pop("close").over(w.last(n)))
    return df.withColumns({"upper_bb": avg + width * dev, "middle_bb": avg, "lower_bb": avg - width * dev})


def _signed_volume(w: SeriesWindow) -> Column:
    return F.coalesce(F.signum(F.col("close") - R.lag("close", 1, w)), F.lit(0.0)) * F.col("volume")


def obv(df: DataFrame, w: SeriesWindow) -> DataFrame:
    df = df.withColumn("__flow", _signed_volume(w))
    return df.withColumn("obv", F.sum("__flow").over(w.so_far)).drop("__flow")


def _money_flow() -> Column:
    place = N.safe_div(2 * F.col("close") - F.col("low") - F.col("high"), F.col("high") - F.col("low"))
    return F.coalesce(place, F.lit(0.0)) * F.col("volume")


def accumulation(df: DataFrame, w: SeriesWindow) -> DataFrame:
    """Accumulation/distribution line; a bar without range adds nothing."""
    return df.withColumn("ad", F.sum(_money_flow()).over(w.so_far))


def chaikin(df: DataFrame, w: SeriesWindow, fast: int = 3, slow: int = 10) -> DataFrame:
    if "ad" not in df.columns:
        df = accumulation(df, w)
    df = ewm(df, "ad", {"__f": span_alpha(fast)}, w, seed_rows=fast)
    df = ewm(df, "ad", {"__s": span_alpha(slow)}, w, seed_rows=slow)
    return df.withColumn("chaikin_ad", F.col("__f") - F.col("__s")).drop("__f", "__s")


# Indicator columns of the classic training table, in its order.
INDICATORS = (
    "sma_50", "ema_20", "wma_20", "macd", "macd_signal", "macd_hist", "tema_20",
    "rsi_14", "roc", "cci_14", "willr_14", "atr_14", "upper_bb", "middle_bb", "lower_bb",
    "obv", "ad", "chaikin_ad",
)


def indicators(df: DataFrame, w: SeriesWindow) -> DataFrame:
    for add in (sma, ema, wma, macd_lines, tema, wilder_rsi, roc, cci, willr, atr, bbands, obv, accumulation, chaikin):
        df = add(df, w)
    return df


#: Rows that the widest plain window of ``INDICATORS`` looks back on.
LOOKBACK = 50


def indicators_of_fine_panel(df: DataFrame, w: SeriesWindow, bucket: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The same columns for panels finer than daily ones, whose series have no bound on their rows.

    Plain windows run over overlapping row blocks; seeded means and running totals are carried from block to block, in three
    scans because some are means of means.  ``bucket`` must grow with the order of ``w``.
    """

    def bounded(part: DataFrame, inside: SeriesWindow) -> DataFrame:
        for add in (sma, wma, roc, cci, willr, bbands, _gains):
            part = add(part, inside)
        return part.withColumns({"__tr": _true_range(inside), "__flow": _signed_volume(inside), "__money": _money_flow()})

    span = lambda c, n: Mean(c, span_alpha(n), n)
    wilder = lambda c: Mean(c, wilder_alpha(14), 14)
    rows = in_blocks(df, bounded, w, bucket, LOOKBACK, block_rows=block_rows, keep_place=True)
    rows = scan(
        rows,
        {
            "ema_20": span("close", 20), "__fast": span("close", 12), "__slow": span("close", 26), "__ag": wilder("__gain"), "__al": wilder("__loss"),
            "atr_14": wilder("__tr"), "obv": Total("__flow"), "ad": Total("__money"),
        },
        w,
    )
    rows = rows.withColumn("macd", F.col("__fast") - F.col("__slow"))
    rows = scan(rows, {"macd_signal": span("macd", 9), "__e2": span("ema_20", 20), "__f": span("ad", 3), "__s": span("ad", 10)}, w)
    rows = scan(rows, {"__e3": span("__e2", 20)}, w)
    done = rows.withColumns(
        {
            "macd_hist": F.col("macd") - F.col("macd_signal"), "tema_20": 3 * F.col("ema_20") - 3 * F.col("__e2") + F.col("__e3"),
            "rsi_14": F.lit(100.0) * N.safe_div("__ag", F.col("__ag") + F.col("__al")), "chaikin_ad": F.col("__f") - F.col("__s"),
        }
    )
    return done.select(*df.columns, *INDICATORS)
