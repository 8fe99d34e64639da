"""Price-window, indicator, label and sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rolling import SeriesWindow
from ..operators import ewm as E
from ..operators import labels as L
from ..operators import panel as PN
from ..operators import price as P
from ..operators import technical as TA
from ..operators.preprocess import class_shares
from ..operators.sequences import sequences
from .base import BARS, BASE, S, corr_sql, enough, frame, line_bars, out, query, sparse_closes, SPARSE, table

W = SeriesWindow()


def based(spark, sf_dir):
    return P.base_columns(line_bars(spark, sf_dir), W)


@query("daily_bars", "A11 S05", out("SELECT * FROM bars", "series_id", "date", "open high low close adj_close volume", ctes=BARS))
def _(spark, sf_dir):
    return line_bars(spark, sf_dir)


EVENT_BARS = """SELECT event_type AS series_id, date_trunc('hour', ts) AS hour, arg_min(value, event_id) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, event_id) AS close, count(*) AS volume FROM events GROUP BY 1, 2"""


def event_bars(spark, sf_dir):
    ev = table(spark, sf_dir, "events", "event_id", "ts", "event_type", "value")
    return PN.bars(
        ev, F.col("event_type"), F.date_trunc("hour", "ts"), F.col("event_id"), F.col("value"), F.lit(1), "hour"
    ).drop("adj_close")


@query("hourly_event_bars", "A11", out(EVENT_BARS, "series_id", "hour", "open high low close", "volume"))
def _(spark, sf_dir):
    return event_bars(spark, sf_dir)


BLOCK_SQL = f"""SELECT series_id, hour, close / lag(close, 7) OVER s - 1 AS return_7,
  {enough('close', 30, 15, 'stddev_samp(close) OVER {w}', order='hour')} AS sd_30,
  {enough('close', 90, 45, 'max(close) OVER {w}', order='hour')} AS max_90, lead(close) OVER s AS next_close
  FROM ({EVENT_BARS}) WINDOW s AS (PARTITION BY series_id ORDER BY hour)"""


@query(
    "block_windows_hourly", "A11 W01 W06 W18",
    out(BLOCK_SQL, "series_id", "hour", "return_7 sd_30 max_90 next_close"),
)
def _(spark, sf_dir):
    """Intraday panel through overlapping row blocks (no whole series in one task)."""
    from ..functions import numeric as N
    from ..functions import rolling as R

    def compute(df, w):
        high = R.enough("close", 90, 45, w, F.max("close").over(w.last(90)))
        return df.select(
            "*",
            N.ratio_change(F.col("close"), R.lag("close", 7, w)).alias("return_7"),
            R.std("close", 30, 15, w).alias("sd_30"),
            high.alias("max_90"),
            F.lead("close").over(w.rows).alias("next_close"),
        )

    bars = event_bars(spark, sf_dir)
    done = PN.in_blocks(bars, compute, SeriesWindow(("series_id",), "hour"), F.to_date("hour"), 90, 1, block_rows=256)
    return done.select("series_id", "hour", "return_7", "sd_30", "max_90", "next_close")


@query(
    "hourly_running_totals", "W47 W48 J03",
    out(
        f"""SELECT series_id, hour, sum(coalesce(sign(close - pc), 0) * volume) OVER s AS obv,
            sum(coalesce((2 * close - low - high) / nullif(high - low, 0), 0) * volume) OVER s AS ad,
            last_value(CASE WHEN close > pc THEN close END IGNORE NULLS) OVER s AS last_rise
            FROM (SELECT *, lag(close) OVER (PARTITION BY series_id ORDER BY hour) AS pc FROM ({EVENT_BARS}))
            WINDOW s AS (PARTITION BY series_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "series_id", "hour", "obv ad last_rise",
    ),
)
def _(spark, sf_dir):
    """Volume balance, accumulation and the last rising close of an intraday panel, no whole series in one task."""
    from ..functions import numeric as N
    from ..functions import rolling as R

    def compute(df, w):
        return df.withColumn("step", F.col("close") - R.lag("close", 1, w))

    w, day = SeriesWindow(("series_id",), "hour"), F.to_date("hour")
    steps = PN.in_blocks(event_bars(spark, sf_dir), compute, w, day, 1, block_rows=64)
    place = N.safe_div(2 * F.col("close") - F.col("low") - F.col("high"), F.col("high") - F.col("low"))
    totals = {
        "obv": F.coalesce(F.signum("step"), F.lit(0.0)) * F.col("volume"),
        "ad": F.coalesce(place, F.lit(0.0)) * F.col("volume"),
    }
    done = PN.so_far(steps, ["series_id"], "hour", day, totals, {"last_rise": F.when(F.col("step") > 0, F.col("close"))})
    return done.select("series_id", "hour", "obv", "ad", "last_rise")


RETURN_NAMES = [f"{p}_{n}d" for n in P.RETURN_LAGS for p in ("return", "log_return")]
RETURN_SQL = "SELECT series_id, date, " + ", ".join(
    f"close / lag(close, {n}) OVER {S} - 1 AS return_{n}d, log_price - lag(log_price, {n}) OVER {S} AS log_return_{n}d"
    for n in P.RETURN_LAGS
) + " FROM base"


@query("returns", "W01 W02", out(RETURN_SQL, "series_id", "date", RETURN_NAMES, ctes=BASE))
def _(spark, sf_dir):
    return P.returns(based(spark, sf_dir), W).select("series_id", "date", *RETURN_NAMES)


@query(
    "candles", "W03 W04",
    out(
        """SELECT series_id, date, (close - open) / open AS body_pct, (high - low) / close AS range_pct,
           (high - greatest(open, close)) / close AS upper_wick_pct, (least(open, close) - low) / close AS lower_wick_pct,
           volume_log_change FROM base""",
        "series_id", "date", "body_pct range_pct upper_wick_pct lower_wick_pct volume_log_change", ctes=BASE,
    ),
)
def _(spark, sf_dir):
    names = ["body_pct", "range_pct", "upper_wick_pct", "lower_wick_pct", "volume_log_change"]
    return P.candles(based(spark, sf_dir)).select("series_id", "date", *names)


def _moment_sql(n):
    m = max(3, n // 2)
    return ", ".join(
        [
            enough("r1", n, m, "avg(r1) OVER {w}") + f" AS return_mean_{n}d",
            enough("r1", n, m, "stddev_samp(r1) OVER {w}") + f" AS volatility_{n}d",
            enough("r1", n, m, "sqrt(avg(CASE WHEN r1 < 0 THEN r1 * r1 WHEN r1 IS NOT NULL THEN 0 END) OVER {w})")
            + f" AS downside_vol_{n}d",
            enough("r1", n, m, "CASE WHEN max(r1) OVER {w} = min(r1) OVER {w} THEN 0 ELSE skewness(r1) OVER {w} END")
            + f" AS return_skew_{n}d",
        ]
    )


MOMENT_NAMES = [f"{p}_{n}d" for n in P.ROLL_WINDOWS for p in ("return_mean", "volatility", "downside_vol", "return_skew")]


@query(
    "rolling_moments", "W05 W06 W07 W08",
    out(f"SELECT series_id, date, {', '.join(_moment_sql(n) for n in P.ROLL_WINDOWS)} FROM base", "series_id", "date", MOMENT_NAMES, ctes=BASE),
)
def _(spark, sf_dir):
    return P.rolling_moments(based(spark, sf_dir), W).select("series_id", "date", *MOMENT_NAMES)


def _level_sql(n):
    m = max(3, n // 2)
    return ", ".join(
        [
            enough("close", n, m, "close / avg(close) OVER {w} - 1") + f" AS price_ma_gap_{n}d",
            enough("close", n, m, "(close - avg(close) OVER {w}) / nullif(stddev_samp(close) OVER {w}, 0)") + f" AS price_z_{n}d",
            enough("log_volume", n, m, "(log_volume - avg(log_volume) OVER {w}) / nullif(stddev_samp(log_volume) OVER {w}, 0)")
            + f" AS volume_z_{n}d",
            enough("range_log", n, m, "avg(range_log) OVER {w}") + f" AS range_mean_{n}d",
        ]
    )


LEVEL_NAMES = [f"{p}_{n}d" for n in P.ROLL_WINDOWS for p in ("price_ma_gap", "price_z", "volume_z", "range_mean")]


@query(
    "rolling_levels", "W09 W10 W11 W12",
    out(f"SELECT series_id, date, {', '.join(_level_sql(n) for n in P.ROLL_WINDOWS)} FROM base", "series_id", "date", LEVEL_NAMES, ctes=BASE),
)
def _(spark, sf_dir):
    return P.rolling_levels(based(spark, sf_dir), W).select("series_id", "date", *LEVEL_NAMES)


RATIO_NAMES = ["vol_ratio_7_30", "vol_ratio_21_90", "momentum_7_30", "momentum_30_90"]


@query(
    "ratios", "W13",
    out(
        """SELECT series_id, date, volatility_7d / nullif(volatility_30d, 0) AS vol_ratio_7_30,
           volatility_21d / nullif(volatility_90d, 0) AS vol_ratio_21_90,
           return_7d - return_30d AS momentum_7_30, return_30d - return_90d AS momentum_30_90 FROM m JOIN r USING (series_id, date)""",
        "series_id", "date", RATIO_NAMES,
        ctes=BASE + f", m AS (SELECT series_id, date, {', '.join(_moment_sql(n) for n in (7, 21, 30, 90))} FROM base), r AS ({RETURN_SQL})",
    ),
)
def _(spark, sf_dir):
    df = P.rolling_moments(P.returns(based(spark, sf_dir), W), W)
    return P.ratios(df).select("series_id", "date", *RATIO_NAMES)


NUMBERED = f", numbered AS (SELECT series_id, date, close, row_number() OVER {S} AS rn FROM bars)"


def recursion(spans: dict[str, float], src: str = "numbered", value: str = "close", name: str = "means") -> str:
    """Row-by-row recursion of exponential means from the first row on."""
    first = ", ".join(f"{value} AS {n}" for n in spans)
    step = ", ".join(f"e.{n} * (1 - {a!r}) + {a!r} * q.{value}" for n, a in spans.items())
    return (
        f", {name} AS (SELECT series_id, rn, {first} FROM {src} WHERE rn = 1 UNION ALL "
        f"SELECT q.series_id, q.rn, {step} FROM {name} e JOIN {src} q ON q.series_id = e.series_id AND q.rn = e.rn + 1)"
    )


EMA_SQL = "SELECT q.series_id, q.date, " + ", ".join(
    f"q.close / e.m{s} - 1 AS ema_gap_{s}d" for s in P.EMA_SPANS
) + " FROM numbered q JOIN means e ON q.series_id = e.series_id AND q.rn = e.rn"


@query(
    "ema_gaps", "W14 N03",
    out(EMA_SQL, "series_id", "date", [f"ema_gap_{s}d" for s in P.EMA_SPANS], ctes=BARS + NUMBERED + recursion({f"m{s}": E.span_alpha(s) for s in P.EMA_SPANS})),
)
def _(spark, sf_dir):
    return P.ema_gaps(line_bars(spark, sf_dir), W).select("series_id", "date", *[f"ema_gap_{s}d" for s in P.EMA_SPANS])


@query(
    "ema_gaps_blocked", "W14 N03",
    out(EMA_SQL, "series_id", "date", [f"ema_gap_{s}d" for s in (7, 14)], ctes=BARS + NUMBERED + recursion({f"m{s}": E.span_alpha(s) for s in P.EMA_SPANS})),
)
def _(spark, sf_dir):
    """The same means over overlapping row blocks."""
    bars = line_bars(spark, sf_dir).select("series_id", "date", "close")
    done = PN.in_blocks(
        bars, lambda d, w: P.ema_gaps(d, w, (7, 14)), W, F.trunc("date", "month"),
        E.ewm_lookback(E.span_alpha(14)), block_rows=1024,
    )
    return done.select("series_id", "date", "ema_gap_7d", "ema_gap_14d")


GAP_EWM = f"""numbered AS (SELECT macro_id AS series_id, date, close, row_number() OVER (PARTITION BY macro_id ORDER BY date) AS rn FROM sp),
m AS (
  SELECT series_id, rn, close AS y, CASE WHEN close IS NULL THEN NULL ELSE 0 END AS gap FROM numbered WHERE rn = 1
  UNION ALL
  SELECT q.series_id, q.rn,
    CASE WHEN q.close IS NULL THEN e.y WHEN e.y IS NULL THEN q.close
         ELSE (power(1 - 2.0 / 31, e.gap + 1) * e.y + (2.0 / 31) * q.close) / (power(1 - 2.0 / 31, e.gap + 1) + 2.0 / 31) END,
    CASE WHEN q.close IS NOT NULL THEN 0 WHEN e.gap IS NULL THEN NULL ELSE e.gap + 1 END
  FROM m e JOIN numbered q ON q.series_id = e.series_id AND q.rn = e.rn + 1)"""


@query(
    "ewm_with_gaps", "W14",
    out("SELECT q.series_id, q.date, m.y AS ewm_30 FROM numbered q JOIN m USING (series_id, rn)", "series_id", "date", "ewm_30", ctes=SPARSE + ", " + GAP_EWM, digits=4),
    digits=4,
)
def _(spark, sf_dir):
    """Missing observations repeat the mean while older weight decays."""
    sparse = sparse_closes(spark, sf_dir)
    rows = PN.spine(sparse, ["macro_id"]).join(sparse, ["macro_id", "date"], "left")
    w = SeriesWindow(("macro_id",), "date")
    return E.ewm(rows, "close", {"ewm_30": E.span_alpha(30)}, w).select(F.col("macro_id").alias("series_id"), "date", "ewm_30")


def _rsi_sql(n):
    gain = "avg(CASE WHEN d IS NOT NULL THEN greatest(d, 0) END) OVER {w}"
    loss = "avg(CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END) OVER {w}"
    return enough("d", n, n, f"(100 - 100 / (1 + {gain} / nullif({loss}, 0))) / 100") + f" AS rsi_{n}"


@query(
    "simple_rsi", "W15",
    out(
        f"SELECT series_id, date, {', '.join(_rsi_sql(n) for n in P.RSI_WINDOWS)} FROM (SELECT *, close - lag(close) OVER {S} AS d FROM bars)",
        "series_id", "date", [f"rsi_{n}" for n in P.RSI_WINDOWS], ctes=BARS,
    ),
)
def _(spark, sf_dir):
    return P.simple_rsi(line_bars(spark, sf_dir), W).select("series_id", "date", *[f"rsi_{n}" for n in P.RSI_WINDOWS])


MACD_CTES = (
    BARS + NUMBERED
    + recursion({"e12": E.span_alpha(12), "e26": E.span_alpha(26)})
    + ", lines AS (SELECT series_id, rn, e12 - e26 AS macd FROM means)"
    + recursion({"sig": E.span_alpha(9)}, "lines", "macd", "signals")
)


@query(
    "macd", "W16",
    out(
        """SELECT q.series_id, q.date, l.macd / q.close AS macd_pct, s.sig / q.close AS macd_signal_pct
           FROM numbered q JOIN lines l USING (series_id, rn) JOIN signals s USING (series_id, rn)""",
        "series_id", "date", "macd_pct macd_signal_pct", ctes=MACD_CTES,
    ),
)
def _(spark, sf_dir):
    return P.macd(line_bars(spark, sf_dir), W).select("series_id", "date", "macd_pct", "macd_signal_pct")


@query(
    "bollinger", "W17",
    out(
        "SELECT series_id, date, "
        + enough("close", 20, 10, "(close - (avg(close) OVER {w} - 2 * stddev_samp(close) OVER {w})) / nullif(4 * stddev_samp(close) OVER {w}, 0)")
        + " AS bb_position, "
        + enough("close", 20, 10, "4 * stddev_samp(close) OVER {w} / nullif(avg(close) OVER {w}, 0)")
        + " AS bb_width FROM bars",
        "series_id", "date", "bb_position bb_width", ctes=BARS,
    ),
)
def _(spark, sf_dir):
    return P.bollinger(line_bars(spark, sf_dir), W).select("series_id", "date", "bb_position", "bb_width")


def _range_sql(n):
    m = max(10, n // 2)
    return (
        enough("close", n, m, "close / max(close) OVER {w} - 1") + f" AS drawdown_{n}d, "
        + enough("close", n, m, "(close - min(close) OVER {w}) / nullif(max(close) OVER {w} - min(close) OVER {w}, 0)")
        + f" AS range_position_{n}d"
    )


RANGE_NAMES = [f"{p}_{n}d" for n in P.RANGE_WINDOWS for p in ("drawdown", "range_position")]


@query(
    "drawdowns", "W18 W19",
    out(f"SELECT series_id, date, {', '.join(_range_sql(n) for n in P.RANGE_WINDOWS)} FROM bars", "series_id", "date", RANGE_NAMES, ctes=BARS),
)
def _(spark, sf_dir):
    return P.drawdowns(line_bars(spark, sf_dir), W).select("series_id", "date", *RANGE_NAMES)


@query(
    "price_volume_corr", "W20",
    out(f"SELECT series_id, date, {corr_sql('r1', 'volume_log_change', 30, 15)} AS price_volume_corr_30d FROM base", "series_id", "date", "price_volume_corr_30d", ctes=BASE),
)
def _(spark, sf_dir):
    return P.price_volume_corr(based(spark, sf_dir), W).select("series_id", "date", "price_volume_corr_30d")


REGIME_CTES = (
    BASE
    + f", vol AS (SELECT series_id, date, row_number() OVER {S} AS rn, round({enough('r1', 21, 10, 'stddev_samp(r1) OVER {w}')}, 9) AS v FROM base)"
)
REGIME_SQL = """SELECT a.series_id, a.date,
  CASE WHEN a.v IS NOT NULL AND count(b.v) >= 90 THEN
    (count(*) FILTER (b.v < a.v) + (count(*) FILTER (b.v = a.v) + 1) / 2.0) / count(b.v) END AS vol_regime_pctile
  FROM vol a JOIN vol b ON a.series_id = b.series_id AND b.rn BETWEEN a.rn - 364 AND a.rn GROUP BY a.series_id, a.date, a.v"""


@query("vol_regime", "W21", out(REGIME_SQL, "series_id", "date", "vol_regime_pctile", ctes=REGIME_CTES))
def _(spark, sf_dir):
    """Rank of volatility (compared at nine decimals so that both engines see the same ties)."""
    df = P.rolling_moments(based(spark, sf_dir), W, (21,))
    df = df.withColumn("volatility_21d", F.round("volatility_21d", 9))
    return P.vol_regime(df, W).select("series_id", "date", "vol_regime_pctile")


@query(
    "calendar_cycle", "W22",
    out(
        """SELECT series_id, date, sin(2 * pi() * (isodow(date) - 1) / 7) AS calendar_dow_sin,
           cos(2 * pi() * (isodow(date) - 1) / 7) AS calendar_dow_cos FROM bars""",
        "series_id", "date", "calendar_dow_sin calendar_dow_cos", ctes=BARS,
    ),
)
def _(spark, sf_dir):
    return P.calendar_cycle(line_bars(spark, sf_dir)).select("series_id", "date", "calendar_dow_sin", "calendar_dow_cos")


# --- targets and labels ------------------------------------------------------------------


@query(
    "forward_target", "W34",
    out("SELECT series_id, date, target_end_date, target_return_1d FROM base", "series_id", "date target_end_date", "target_return_1d", ctes=BASE),
)
def _(spark, sf_dir):
    return L.forward_target(line_bars(spark, sf_dir), W).select("series_id", "date", "target_end_date", "target_return_1d")


LABELS = (
    BASE
    + f", thr AS (SELECT *, 0.7 * ({enough('log_r1', 21, 14, 'stddev_samp(log_r1) OVER {w}')}) AS threshold_dynamic FROM base)"
    + """, labelled AS (SELECT *, 0.01 AS threshold_fixed,
  CASE WHEN target_return_1d > 0.01 THEN 1 WHEN target_return_1d < -0.01 THEN -1 ELSE 0 END AS label_fixed,
  CASE WHEN target_return_1d > threshold_dynamic THEN 1 WHEN target_return_1d < -threshold_dynamic THEN -1 ELSE 0 END AS label_dynamic,
  CASE WHEN abs(target_return_1d) > threshold_dynamic THEN 1 ELSE 0 END AS target_move_dynamic,
  CASE WHEN target_return_1d > 0 THEN 1 ELSE 0 END AS target_direction FROM thr)"""
)
LABEL_COLS = ["label_fixed", "label_dynamic", "target_move_dynamic", "target_direction"]


def labelled(spark, sf_dir):
    return L.standard_labels(L.forward_target(based(spark, sf_dir), W), W)


@query(
    "labels", "L01 L02 L03 L04 P16 N02",
    out("SELECT * FROM labelled", "series_id", "date", "threshold_fixed threshold_dynamic", " ".join(LABEL_COLS), ctes=LABELS),
)
def _(spark, sf_dir):
    return labelled(spark, sf_dir).select("series_id", "date", "threshold_fixed", "threshold_dynamic", *LABEL_COLS)


VOLS, KS = (7, 14, 21, 30, 60), (0.5, 0.7, 0.9, 1.1)
GRID_SQL = " UNION ALL ".join(
    f"SELECT series_id, date, {v} AS vol_window, k, target_return_1d, k * ({enough('log_r1', v, max(5, v // 2), 'stddev_samp(log_r1) OVER {w}')}) AS threshold "
    f"FROM base, (VALUES {', '.join(f'({k}::DOUBLE)' for k in KS)}) AS g(k)"
    for v in VOLS
)
# The k values multiply the rows before the frame above is taken, so each k needs its own partition.
GRID_SQL = GRID_SQL.replace("PARTITION BY series_id", "PARTITION BY series_id, k")


@query(
    "label_grid", "L05 L06",
    out(
        f"""SELECT series_id, date, vol_window, k, threshold,
          CASE WHEN target_return_1d > threshold THEN 1 WHEN target_return_1d < -threshold THEN -1 ELSE 0 END AS label,
          CASE WHEN abs(target_return_1d) > threshold THEN 1 ELSE 0 END AS move FROM ({GRID_SQL})""",
        "series_id", "date", "k threshold", "vol_window label move", ctes=BASE,
    ),
)
def _(spark, sf_dir):
    df = L.forward_target(based(spark, sf_dir), W)
    return L.label_grid(df, W, VOLS, KS, "log_r1").select("series_id", "date", "vol_window", "k", "threshold", "label", "move")


@query(
    "classic_labels", "L07 P04 N02",
    out(
        """SELECT series_id, date, close, target_return_1d AS "return",
          CASE WHEN target_return_1d > 0.01 THEN 1 WHEN target_return_1d < -0.01 THEN -1 ELSE 0 END AS label
          FROM base WHERE target_return_1d IS NOT NULL""",
        "series_id", "date", "close return", "label", ctes=BASE,
    ),
)
def _(spark, sf_dir):
    return L.classic_labels(line_bars(spark, sf_dir), W).select("series_id", "date", "close", "return", "label")


@query(
    "encoded_labels", "L08",
    out("SELECT series_id, date, label_dynamic + 1 AS encoded FROM labelled", "series_id", "date", (), "encoded", ctes=LABELS),
)
def _(spark, sf_dir):
    return labelled(spark, sf_dir).select("series_id", "date", L.zero_based("label_dynamic").alias("encoded"))


@query(
    "target_classes", "L09",
    out(
        f"""SELECT t.target, t.classes, l.rows FROM (VALUES
          ('label_fixed', '-1,0,1'), ('label_dynamic', '-1,0,1'), ('target_move_dynamic', '0,1'), ('target_direction', '0,1')) AS t(target, classes),
          (SELECT count(*) AS rows FROM labelled) AS l""",
        "target classes", "", (), "rows", ctes=LABELS,
    ),
)
def _(spark, sf_dir):
    rows = labelled(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"))
    t = L.target_class_table(spark, LABEL_COLS).select("target", F.array_join(F.col("classes").cast("array<string>"), ",").alias("classes"))
    return t.join(F.broadcast(rows))


@query(
    "class_shares", "A03 A04 N01",
    out(
        """SELECT s.series_id, s.label_dynamic, coalesce(c.n, 0) AS n, coalesce(c.n, 0) / t.n AS share FROM
          (SELECT series_id, unnest([-1, 0, 1]) AS label_dynamic FROM (SELECT DISTINCT series_id FROM labelled)) s
          LEFT JOIN (SELECT series_id, label_dynamic, count(*) AS n FROM labelled GROUP BY 1, 2) c USING (series_id, label_dynamic)
          JOIN (SELECT series_id, count(*) AS n FROM labelled GROUP BY 1) t USING (series_id)""",
        "series_id", "", "share", "label_dynamic n", ctes=LABELS,
    ),
)
def _(spark, sf_dir):
    return class_shares(labelled(spark, sf_dir), "label_dynamic", ["series_id"], [-1, 0, 1])


@query(
    "move_share", "A04",
    out("SELECT series_id, avg(target_move_dynamic) AS move_share FROM labelled GROUP BY 1", "series_id", "", "move_share", ctes=LABELS),
)
def _(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("series_id").agg(F.avg("target_move_dynamic").alias("move_share"))


SEQ_SQL = f"""SELECT series_id, date, label_dynamic AS label, sc, sv, c0, n, sha256(array_to_string(steps, ';')) AS steps FROM (
  SELECT *, count(*) OVER p AS n, sum(close) OVER p AS sc, sum(volume) OVER p AS sv, first_value(close) OVER p AS c0,
    list(CAST(round(close * 100) AS BIGINT) || ':' || CAST(round(volume * 100) AS BIGINT)) OVER p AS steps
  FROM labelled WINDOW p AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) WHERE n = 60"""


@query("sequences", "W35 N04", out(SEQ_SQL, "series_id steps", "date", "sc sv c0", "label n", ctes=LABELS, digits=3), digits=3)
def _(spark, sf_dir):
    """Sixty-row sequences, reported by length, column sums, first element and a digest of all steps in order."""
    seq = sequences(labelled(spark, sf_dir), W, ["close", "volume"], "label_dynamic", 60)
    total = lambda i: F.aggregate("sequence", F.lit(0.0), lambda acc, s: acc + s[i])
    cents = lambda x: F.round(x * 100).cast("long").cast("string")
    steps = F.array_join(F.transform("sequence", lambda s: F.concat(cents(s[0]), F.lit(":"), cents(s[1]))), ";")
    return seq.select(
        "series_id", "date", "label", total(0).alias("sc"), total(1).alias("sv"),
        F.col("sequence")[0][0].alias("c0"), F.size("sequence").alias("n"), F.sha2(steps, 256).alias("steps"),
    )


# --- classic indicators --------------------------------------------------------------------


def seeded(name: str, src: str, value: str, alpha: float, n: int) -> str:
    """CTEs: running count and mean of ``value``, then the recursion from its n-th known value."""
    so_far = "(PARTITION BY series_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return (
        f", {name}_s AS (SELECT series_id, rn, {value} AS x, count({value}) OVER {so_far} AS c, avg({value}) OVER {so_far} AS a FROM {src})"
        f", {name} AS (SELECT series_id, rn, CASE WHEN c = {n} THEN a END AS y FROM {name}_s WHERE rn = 1 UNION ALL "
        f"SELECT q.series_id, q.rn, CASE WHEN q.c < {n} THEN NULL WHEN e.y IS NULL THEN q.a ELSE e.y * (1 - {alpha!r}) + {alpha!r} * q.x END "
        f"FROM {name} e JOIN {name}_s q ON q.series_id = e.series_id AND q.rn = e.rn + 1)"
    )


NB = f", nb AS (SELECT *, row_number() OVER {S} AS rn, lag(close) OVER {S} AS pc FROM bars)"


def ta_query(name, ids, add, cols, sql, ctes, digits=4):
    @query(name, ids, out(sql, "series_id", "date", cols, ctes=ctes, digits=digits), digits=digits)
    def _(spark, sf_dir):
        return add(line_bars(spark, sf_dir), W).select("series_id", "date", *cols)


ta_query("sma", "W36", TA.sma, ["sma_50"], f"SELECT series_id, date, {enough('close', 50, 50, 'avg(close) OVER {w}')} AS sma_50 FROM bars", BARS)
ta_query(
    "ema", "W37", TA.ema, ["ema_20"],
    "SELECT nb.series_id, date, y AS ema_20 FROM nb JOIN e20 USING (series_id, rn)",
    BARS + NB + seeded("e20", "nb", "close", E.span_alpha(20), 20),
)
ta_query(
    "wma", "W38", TA.wma, ["wma_20"],
    "SELECT series_id, date, (" + " + ".join(f"{20 - k} * lag(close, {k}) OVER {S}" for k in range(20)) + ") / 210.0 AS wma_20 FROM bars",
    BARS,
)
ta_query(
    "macd_lines", "W39", TA.macd_lines, ["macd", "macd_signal", "macd_hist"],
    "SELECT nb.series_id, date, l.macd, g.y AS macd_signal, l.macd - g.y AS macd_hist FROM nb JOIN l USING (series_id, rn) JOIN g USING (series_id, rn)",
    BARS + NB + seeded("f12", "nb", "close", E.span_alpha(12), 12) + seeded("s26", "nb", "close", E.span_alpha(26), 26)
    + ", l AS (SELECT f12.series_id, f12.rn, f12.y - s26.y AS macd FROM f12 JOIN s26 USING (series_id, rn))"
    + seeded("g", "l", "macd", E.span_alpha(9), 9),
)
ta_query(
    "tema", "W40", TA.tema, ["tema_20"],
    "SELECT nb.series_id, date, 3 * a.y - 3 * b.y + c.y AS tema_20 FROM nb JOIN a USING (series_id, rn) JOIN b USING (series_id, rn) JOIN c USING (series_id, rn)",
    BARS + NB + seeded("a", "nb", "close", E.span_alpha(20), 20) + seeded("b", "a", "y", E.span_alpha(20), 20) + seeded("c", "b", "y", E.span_alpha(20), 20),
)
ta_query(
    "wilder_rsi", "W41", TA.wilder_rsi, ["rsi_14"],
    "SELECT nb.series_id, date, 100 * g.y / nullif(g.y + l.y, 0) AS rsi_14 FROM nb JOIN g USING (series_id, rn) JOIN l USING (series_id, rn)",
    BARS + NB
    + ", gl AS (SELECT series_id, rn, CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS gain, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS loss FROM nb)"
    + seeded("g", "gl", "gain", 1 / 14, 14) + seeded("l", "gl", "loss", 1 / 14, 14),
)
ta_query("rate_of_change", "W42", TA.roc, ["roc"], f"SELECT series_id, date, 100 * (close / lag(close, 10) OVER {S} - 1) AS roc FROM bars", BARS)
ta_query(
    "cci", "W43", TA.cci, ["cci_14"],
    """SELECT a.series_id, a.date, CASE WHEN a.n = 14 THEN (any_value(a.tp) - any_value(a.m)) / nullif(0.015 * avg(abs(b.tp - a.m)), 0) END AS cci_14
       FROM t a JOIN t b ON a.series_id = b.series_id AND b.rn BETWEEN a.rn - 13 AND a.rn GROUP BY a.series_id, a.date, a.n""",
    BARS + NB + ", t0 AS (SELECT series_id, date, rn, (high + low + close) / 3 AS tp FROM nb)"
    + f", t AS (SELECT *, count(*) OVER {frame(14)} AS n, avg(tp) OVER {frame(14)} AS m FROM t0)",
)
ta_query(
    "williams_r", "W44", TA.willr, ["willr_14"],
    "SELECT series_id, date, "
    + enough("close", 14, 14, "-100 * (max(high) OVER {w} - close) / nullif(max(high) OVER {w} - min(low) OVER {w}, 0)")
    + " AS willr_14 FROM bars",
    BARS,
)
ta_query(
    "atr", "W45", lambda df, w: TA.atr(df, w).withColumn("ln_atr_14", F.ln("atr_14")), ["ln_atr_14"],
    "SELECT nb.series_id, date, ln(a.y) AS ln_atr_14 FROM nb JOIN a USING (series_id, rn)",
    BARS + NB + ", tr AS (SELECT series_id, rn, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM nb)"
    + seeded("a", "tr", "tr", 1 / 14, 14),
    digits=6,
)
ta_query(
    "bbands", "W46", TA.bbands, ["upper_bb", "middle_bb", "lower_bb"],
    "SELECT series_id, date, " + enough("close", 20, 20, "avg(close) OVER {w} + 2 * stddev_pop(close) OVER {w}") + " AS upper_bb, "
    + enough("close", 20, 20, "avg(close) OVER {w}") + " AS middle_bb, "
    + enough("close", 20, 20, "avg(close) OVER {w} - 2 * stddev_pop(close) OVER {w}") + " AS lower_bb FROM bars",
    BARS,
)
AD_SQL = f"sum(coalesce((2 * close - low - high) / nullif(high - low, 0), 0) * volume) OVER {S}"
ta_query("on_balance_volume", "W47", TA.obv, ["obv"], f"SELECT series_id, date, sum(coalesce(sign(close - pc), 0) * volume) OVER {S} AS obv FROM nb", BARS + NB)
ta_query("accumulation", "W48", TA.accumulation, ["ad"], f"SELECT series_id, date, {AD_SQL} AS ad FROM bars", BARS)
ta_query(
    "chaikin", "W49", TA.chaikin, ["chaikin_ad"],
    "SELECT nb.series_id, date, a.y - b.y AS chaikin_ad FROM nb JOIN a USING (series_id, rn) JOIN b USING (series_id, rn)",
    BARS + NB + f", adl AS (SELECT series_id, rn, {AD_SQL} AS ad FROM nb)"
    + seeded("a", "adl", "ad", E.span_alpha(3), 3) + seeded("b", "adl", "ad", E.span_alpha(10), 10),
)


# --- the same on a panel without a bound on its series -----------------------------------

#: Rows of a block: few, so that every series of the table runs through many.
SMALL_BLOCK = 64
HOUR = SeriesWindow(("series_id",), "hour")
HB = f"""hb AS ({EVENT_BARS}), nb AS (SELECT *, row_number() OVER s AS rn, lag(close) OVER s AS pc FROM hb WINDOW s AS (PARTITION BY series_id ORDER BY hour))"""
HOURLY = ["ema_20", "macd", "macd_signal", "macd_hist", "tema_20", "rsi_14", "atr_14", "chaikin_ad", "obv", "ad", "sma_50", "willr_14"]
HS = "(PARTITION BY series_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(
    "hourly_indicators", "W36 W37 W39 W40 W41 W44 W45 W47 W48 W49",
    out(
        f"""SELECT nb.series_id, nb.hour, a.y AS ema_20, l.macd, g.y AS macd_signal, l.macd - g.y AS macd_hist, 3 * a.y - 3 * b.y + c.y AS tema_20,
              100 * u.y / nullif(u.y + d.y, 0) AS rsi_14, t.y AS atr_14, f.y - s.y AS chaikin_ad, fl.obv, fl.ad,
              {enough('close', 50, 50, 'avg(close) OVER {w}', order='nb.rn', key='nb.series_id')} AS sma_50,
              {enough('close', 14, 14, '-100 * (max(high) OVER {w} - close) / nullif(max(high) OVER {w} - min(low) OVER {w}, 0)', order='nb.rn', key='nb.series_id')} AS willr_14
            FROM nb JOIN a USING (series_id, rn) JOIN b USING (series_id, rn) JOIN c USING (series_id, rn) JOIN l USING (series_id, rn) JOIN g USING (series_id, rn)
              JOIN u USING (series_id, rn) JOIN d USING (series_id, rn) JOIN t USING (series_id, rn) JOIN f USING (series_id, rn) JOIN s USING (series_id, rn) JOIN fl USING (series_id, rn)""",
        "series_id", "hour", HOURLY,
        ctes=HB
        + f""", mv AS (SELECT series_id, rn, CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS gain, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS loss,
              CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM nb),
            fl AS (SELECT series_id, rn, sum(coalesce(sign(close - pc), 0) * volume) OVER {HS} AS obv,
              sum(coalesce((2 * close - low - high) / nullif(high - low, 0), 0) * volume) OVER {HS} AS ad FROM nb)"""
        + seeded("a", "nb", "close", E.span_alpha(20), 20) + seeded("b", "a", "y", E.span_alpha(20), 20) + seeded("c", "b", "y", E.span_alpha(20), 20)
        + seeded("f12", "nb", "close", E.span_alpha(12), 12) + seeded("s26", "nb", "close", E.span_alpha(26), 26)
        + ", l AS (SELECT f12.series_id, f12.rn, f12.y - s26.y AS macd FROM f12 JOIN s26 USING (series_id, rn))" + seeded("g", "l", "macd", E.span_alpha(9), 9)
        + seeded("u", "mv", "gain", 1 / 14, 14) + seeded("d", "mv", "loss", 1 / 14, 14) + seeded("t", "mv", "tr", 1 / 14, 14)
        + seeded("f", "fl", "ad", E.span_alpha(3), 3) + seeded("s", "fl", "ad", E.span_alpha(10), 10),
    ),
)
def _(spark, sf_dir):
    """Classic indicators of an intraday panel, carried from block to block."""
    done = TA.indicators_of_fine_panel(event_bars(spark, sf_dir), HOUR, F.to_date("hour"), block_rows=SMALL_BLOCK)
    return done.select("series_id", "hour", *HOURLY)


HOURLY_PRICE = [f"ema_gap_{s}d" for s in P.EMA_SPANS] + ["macd_pct", "macd_signal_pct", "volatility_21d", "drawdown_180d"]


@query(
    "hourly_price_features", "W06 W14 W16 W18 N03",
    out(
        "SELECT q.series_id, q.hour, " + ", ".join(f"q.close / e.m{s} - 1 AS ema_gap_{s}d" for s in P.EMA_SPANS)
        + f""", (e.m12 - e.m26) / q.close AS macd_pct, g.sig / q.close AS macd_signal_pct,
            {enough('r1', 21, 10, 'stddev_samp(r1) OVER {w}', order='q.rn', key='q.series_id')} AS volatility_21d,
            {enough('close', 180, 90, 'close / max(close) OVER {w} - 1', order='q.rn', key='q.series_id')} AS drawdown_180d
            FROM hr q JOIN means e USING (series_id, rn) JOIN sigs g USING (series_id, rn)""",
        "series_id", "hour", HOURLY_PRICE,
        ctes=HB + ", hr AS (SELECT *, close / pc - 1 AS r1 FROM nb)"
        + recursion({f"m{s}": E.span_alpha(s) for s in (*P.EMA_SPANS, 12, 26)}, "nb")
        + ", lines AS (SELECT series_id, rn, m12 - m26 AS macd FROM means)" + recursion({"sig": E.span_alpha(9)}, "lines", "macd", "sigs"),
    ),
)
def _(spark, sf_dir):
    """Price features of an intraday panel; blocks longer than the widest window."""
    done = P.features_of_fine_panel(event_bars(spark, sf_dir), HOUR, F.to_date("hour"), block_rows=P.WINDOW_LOOKBACK + 13)
    return done.select("series_id", "hour", *HOURLY_PRICE)
