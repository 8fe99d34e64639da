"""Price and volume features of one series, all causal windows over rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import rolling as R
from ..functions.rolling import SeriesWindow
from .ewm import ewm, ewm_lookback, span_alpha
from .panel import BLOCK_ROWS, in_blocks
from .scan import Mean, scan

# Window lengths in rows.
RETURN_LAGS = (1, 2, 3, 5, 7, 10, 14, 21, 30, 45, 60, 90, 180)
ROLL_WINDOWS = (3, 7, 14, 21, 30, 60, 90, 180)
EMA_SPANS = (7, 14, 30, 60, 90, 180)
RSI_WINDOWS = (7, 14, 28)
RANGE_WINDOWS = (30, 90, 180)
REGIME_WINDOW, REGIME_MIN = 365, 90

# Rows a feature may look back: the regime rank over a 21-row volatility of a
# 1-row return, or the memory of the slowest mean, whichever is longer.
WINDOW_LOOKBACK = REGIME_WINDOW + 21 + 1
PRICE_LOOKBACK = max(WINDOW_LOOKBACK, ewm_lookback(span_alpha(max(EMA_SPANS))))


def base_columns(df: DataFrame, w: SeriesWindow) -> DataFrame:
    """Returns, log price, log volume and log range that later families share."""
    df = df.withColumns(
        {
            "log_price": N.ln_positive("close"),
            "log_volume": N.log1p_safe("volume"),
            "range_log": N.ln_positive(N.safe_div("high", "low")),
        }
    )
    return df.withColumns(
        {
            "r1": N.ratio_change(F.col("close"), R.lag("close", 1, w)),
            "log_r1": F.col("log_price") - R.lag("log_price", 1, w),
            "volume_log_change": F.col("log_volume") - R.lag("log_volume", 1, w),
        }
    )


def returns(df: DataFrame, w: SeriesWindow, lags: Sequence[int] = RETURN_LAGS) -> DataFrame:
    cols = {}
    for n in lags:
        cols[f"return_{n}d"] = N.ratio_change(F.col("close"), R.lag("close", n, w))
        cols[f"log_return_{n}d"] = F.col("log_price") - R.lag("log_price", n, w)
    return df.withColumns(cols)


def candles(df: DataFrame) -> DataFrame:
    top, bottom = N.larger("open", "close"), N.smaller("open", "close")
    return df.withColumns(
        {
            "body_pct": N.safe_div(F.col("close") - F.col("open"), "open"),
            "range_pct": N.safe_div(F.col("high") - F.col("low"), "close"),
            "upper_wick_pct": N.safe_div(F.col("high") - top, "close"),
            "lower_wick_pct": N.safe_div(bottom - F.col("low"), "close"),
        }
    )


def _moment_columns(f: R.Frames, windows: Sequence[int]) -> dict:
    cols = {}
    for n in windows:
        need = max(3, n // 2)
        cols[f"return_mean_{n}d"] = f.mean("r1", n, need)
        cols[f"volatility_{n}d"] = f.std("r1", n, need)
        cols[f"downside_vol_{n}d"] = f.enough("r1", n, need, F.sqrt(f.part("avg", "__down", n)))
        cols[f"return_skew_{n}d"] = f.skew("r1", n, need)
    return cols


def _level_columns(f: R.Frames, windows: Sequence[int]) -> dict:
    cols = {}
    for n in windows:
        need = max(3, n // 2)
        avg = f.mean("close", n, need)
        cols[f"price_ma_gap_{n}d"] = N.ratio_change(F.col("close"), avg)
        cols[f"price_z_{n}d"] = N.safe_div(F.col("close") - avg, f.std("close", n, need))
        cols[f"volume_z_{n}d"] = N.safe_div(
            F.col("log_volume") - f.mean("log_volume", n, need), f.std("log_volume", n, need)
        )
        cols[f"range_mean_{n}d"] = f.mean("range_log", n, need)
    return cols


def _range_columns(f: R.Frames, windows: Sequence[int]) -> dict:
    cols = {}
    for n in windows:
        need = max(10, n // 2)
        high = f.enough("close", n, need, f.part("max", "close", n))
        low = f.enough("close", n, need, f.part("min", "close", n))
        cols[f"drawdown_{n}d"] = N.ratio_change(F.col("close"), high)
        cols[f"range_position_{n}d"] = N.safe_div(F.col("close") - low, high - low)
    return cols


def _with_downside(df: DataFrame) -> DataFrame:
    down = N.clip_high("r1", 0.0)
    return df.withColumn("__down", down * down)


def rolling_moments(df: DataFrame, w: SeriesWindow, windows: Sequence[int] = ROLL_WINDOWS) -> DataFrame:
    """Mean, volatility, downside volatility and skew of returns per window."""
    f = R.Frames(w)
    return f.add(_with_downside(df), _moment_columns(f, windows)).drop("__down")


def rolling_levels(df: DataFrame, w: SeriesWindow, windows: Sequence[int] = ROLL_WINDOWS) -> DataFrame:
    """Gap to the moving average, price and volume z-scores, mean log range."""
    f = R.Frames(w)
    return f.add(df, _level_columns(f, windows))


def drawdowns(df: DataFrame, w: SeriesWindow, windows: Sequence[int] = RANGE_WINDOWS) -> DataFrame:
    """Distance from the rolling high and place inside the rolling range."""
    f = R.Frames(w)
    return f.add(df, _range_columns(f, windows))


def rolling_family(df: DataFrame, w: SeriesWindow) -> DataFrame:
    """Moments, levels and ranges together, so that every window is laid out once."""
    f = R.Frames(w)
    cols = {**_moment_columns(f, ROLL_WINDOWS), **_level_columns(f, ROLL_WINDOWS), **_range_columns(f, RANGE_WINDOWS)}
    return f.add(_with_downside(df), cols).drop("__down")


def ratios(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "vol_ratio_7_30": N.safe_div("volatility_7d", "volatility_30d"),
            "vol_ratio_21_90": N.safe_div("volatility_21d", "volatility_90d"),
            "momentum_7_30": F.col("return_7d") - F.col("return_30d"),
            "momentum_30_90": F.col("return_30d") - F.col("return_90d"),
        }
    )


def ema_gaps(df: DataFrame, w: SeriesWindow, spans: Sequence[int] = EMA_SPANS) -> DataFrame:
    names = {f"__ema_{s}": span_alpha(s) for s in spans}
    df = ewm(df, "close", names, w)
    return df.withColumns(
        {f"ema_gap_{s}d": N.ratio_change(F.col("close"), F.col(f"__ema_{s}")) for s in spans}
    ).drop(*names)


def simple_rsi(df: DataFrame, w: SeriesWindow, windows: Sequence[int] = RSI_WINDOWS) -> DataFrame:
    """RSI from plain means, scaled to 0..1; NULL without losses in the window."""
    df = df.withColumn("__diff", F.col("close") - R.lag("close", 1, w))
    df = df.withColumns({"__gain": N.clip_low("__diff", 0.0), "__loss": N.clip_low(-F.col("__diff"), 0.0)})
    f, cols = R.Frames(w), {}
    for n in windows:
        rs = N.safe_div(f.mean("__gain", n, n), f.part("avg", "__loss", n))
        cols[f"rsi_{n}"] = (F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + rs)) / F.lit(100.0)
    return f.add(df, cols).drop("__diff", "__gain", "__loss")


def macd(df: DataFrame, w: SeriesWindow) -> DataFrame:
    df = ewm(df, "close", {"__e12": span_alpha(12), "__e26": span_alpha(26)}, w)
    df = df.withColumn("__macd", F.col("__e12") - F.col("__e26"))
    df = ewm(df, "__macd", {"__sig": span_alpha(9)}, w)
    return df.withColumns(
        {"macd_pct": N.safe_div("__macd", "close"), "macd_signal_pct": N.safe_div("__sig", "close")}
    ).drop("__e12", "__e26", "__macd", "__sig")


def bollinger(df: DataFrame, w: SeriesWindow) -> DataFrame:
    f = R.Frames(w)
    avg, dev = f.mean("close", 20, 10), f.std("close", 20, 10)
    return f.add(
        df,
        {
            "bb_position": N.safe_div(F.col("close") - (avg - 2 * dev), 4 * dev),
            "bb_width": N.safe_div(4 * dev, avg),
        },
    )


def price_volume_corr(df: DataFrame, w: SeriesWindow) -> DataFrame:
    return df.withColumn("price_volume_corr_30d", R.correlation("r1", "volume_log_change", 30, 15, w))


def vol_regime(df: DataFrame, w: SeriesWindow) -> DataFrame:
    return df.withColumn("vol_regime_pctile", R.percentile_rank("volatility_21d", REGIME_WINDOW, REGIME_MIN, w))


def calendar_cycle(df: DataFrame, date: str = "date") -> DataFrame:
    sin, cos = N.weekday_cycle(date)
    return df.withColumns({"calendar_dow_sin": sin, "calendar_dow_cos": cos})


def price_features(df: DataFrame, w: SeriesWindow) -> DataFrame:
    """All price and volume features; one exchange, Spark prunes what is not selected."""
    df = base_columns(df, w)
    df = ema_gaps(df, w)
    df = macd(df, w)
    df = rolling_family(df, w)
    df = simple_rsi(df, w)
    df = bollinger(df, w)
    df = price_volume_corr(df, w)
    df = vol_regime(df, w)
    df = ratios(returns(candles(df), w))
    if w.order == "date":
        df = calendar_cycle(df)
    return df


def features_of_fine_panel(df: DataFrame, w: SeriesWindow, bucket: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The same features for panels finer than daily ones, whose series have no bound on their rows.

    Plain windows run over overlapping row blocks, exponential means are carried from block to block; no task holds a whole
    series, however short the longest one is.  ``bucket`` must grow with the order of ``w``.
    """

    def bounded(part: DataFrame, inside: SeriesWindow) -> DataFrame:
        part = rolling_family(base_columns(part, inside), inside)
        part = bollinger(simple_rsi(part, inside), inside)
        part = vol_regime(price_volume_corr(part, inside), inside)
        return ratios(returns(candles(part), inside))

    spans = {f"__ema_{s}": span_alpha(s) for s in (*EMA_SPANS, 12, 26)}
    rows = in_blocks(df, bounded, w, bucket, WINDOW_LOOKBACK, block_rows=block_rows, keep_place=True)
    rows = scan(rows, {n: Mean("close", a) for n, a in spans.items()}, w)
    rows = rows.withColumn("__macd", F.col("__ema_12") - F.col("__ema_26"))
    rows = scan(rows, {"__sig": Mean("__macd", span_alpha(9))}, w)
    gaps = {f"ema_gap_{s}d": N.ratio_change(F.col("close"), F.col(f"__ema_{s}")) for s in EMA_SPANS}
    macds = {"macd_pct": N.safe_div("__macd", "close"), "macd_signal_pct": N.safe_div("__sig", "close")}
    done = rows.withColumns({**gaps, **macds})
    return done.select(*df.columns, *[n for n in feature_names() if not n.startswith("calendar_")])


def feature_names() -> list[str]:
    """Names produced by ``price_features`` in a stable order."""
    names = [f"{p}_{n}d" for n in RETURN_LAGS for p in ("return", "log_return")]
    names += ["body_pct", "range_pct", "upper_wick_pct", "lower_wick_pct", "volume_log_change"]
    families = (
        "return_mean", "volatility", "downside_vol", "return_skew",
        "price_ma_gap", "price_z", "volume_z", "range_mean",
    )
    names += [f"{p}_{n}d" for n in ROLL_WINDOWS for p in families]
    names += ["vol_ratio_7_30", "vol_ratio_21_90", "momentum_7_30", "momentum_30_90"]
    names += [f"ema_gap_{s}d" for s in EMA_SPANS] + [f"rsi_{n}" for n in RSI_WINDOWS]
    names += ["macd_pct", "macd_signal_pct", "bb_position", "bb_width"]
    names += [f"{p}_{n}d" for n in RANGE_WINDOWS for p in ("drawdown", "range_position")]
    names += ["price_volume_corr_30d", "vol_regime_pctile", "calendar_dow_sin", "calendar_dow_cos"]
    return names
