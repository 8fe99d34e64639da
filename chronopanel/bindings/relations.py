"""Join, peer, sparse-series and exogenous queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rolling import SeriesWindow
from ..operators import external as X
from ..operators import joins as J
from ..operators import panel as PN
from ..operators import peers as P
from ..operators.selection import profile
from ..session import stored
from .base import (
    ANCHOR, BARS, BASE, METRICS, PEERS, S, SPARSE, corr_sql, enough, frame, line_bars, out, query, sparse_closes,
    status_metrics, table,
)

W = SeriesWindow()


@query(
    "outer_join_by_date", "J01",
    out(
        """SELECT coalesce(a.date, b.date, c.date) AS date, a.value AS f, b.value AS o, c.value AS p
           FROM (SELECT date, value FROM metrics WHERE metric = 'F') a
           FULL JOIN (SELECT date, value FROM metrics WHERE metric = 'O') b ON a.date = b.date
           FULL JOIN (SELECT date, value FROM metrics WHERE metric = 'P') c ON coalesce(a.date, b.date) = c.date""",
        "", "date", "f o p", ctes=METRICS,
    ),
)
def _(spark, sf_dir):
    m = status_metrics(spark, sf_dir)
    one = lambda k: m.filter(F.col("metric") == k).select("date", F.col("value").alias(k.lower()))
    return J.outer_by_date([one("F"), one("O"), one("P")])


@query(
    "outer_join_one_shuffle", "J01",
    out(
        "SELECT date, max(value) FILTER (metric = 'F') AS f, max(value) FILTER (metric = 'O') AS o, max(value) FILTER (metric = 'P') AS p FROM metrics GROUP BY 1",
        "", "date", "f o p", ctes=METRICS,
    ),
)
def _(spark, sf_dir):
    m = status_metrics(spark, sf_dir)
    return J.outer_from_long(m, ["date"], "metric", "value", ["F", "O", "P"]).toDF("date", "f", "o", "p")


@query(
    "spine_join", "J02",
    out(
        """SELECT b.series_id, b.date, b.close, m.f, m.o, m.p FROM bars b LEFT JOIN (SELECT date, max(value) FILTER (metric = 'F') AS f, max(value) FILTER (metric = 'O') AS o,
             max(value) FILTER (metric = 'P') AS p FROM metrics GROUP BY 1) m ON b.date = m.date""",
        "series_id", "date", "close f o p", ctes=BARS + ", " + METRICS,
    ),
)
def _(spark, sf_dir):
    ext = J.outer_from_long(status_metrics(spark, sf_dir), ["date"], "metric", "value", ["F", "O", "P"]).toDF("date", "f", "o", "p")
    return J.on_spine(line_bars(spark, sf_dir).select("series_id", "date", "close"), ext, ["date"])


def sparse_rows(spark, sf_dir):
    sparse = sparse_closes(spark, sf_dir)
    return PN.spine(sparse, ["macro_id"]).join(sparse, ["macro_id", "date"], "left")


SM = "(PARTITION BY macro_id ORDER BY date)"
KNOWN = SPARSE + f""", known AS (
  SELECT macro_id, date, close, last_value(close IGNORE NULLS) OVER {SM} AS known,
         last_value(CASE WHEN close IS NOT NULL THEN date END IGNORE NULLS) OVER {SM} AS seen FROM sp)"""
WM = SeriesWindow(("macro_id",), "date")


@query("last_known", "J03", out("SELECT macro_id, date, known, seen FROM known", "macro_id", "date seen", "known", ctes=KNOWN))
def _(spark, sf_dir):
    return J.last_known(sparse_rows(spark, sf_dir), "close", "known", "seen", WM).select("macro_id", "date", "known", "seen")


MACRO_NAMES = ["ret_1d_lag1", "ret_5d_lag1", "ret_20d_lag1", "vol_20d_lag1", "staleness_days_lag1", "corr_30d_lag1"]
MACRO_CTES = (
    BASE + ", " + KNOWN
    + f""", an AS (SELECT date, r1 AS ar FROM base WHERE series_id = '{ANCHOR}'),
k AS (SELECT known.*, ar, known / lag(known) OVER {SM} - 1 AS q1, known / lag(known, 5) OVER {SM} - 1 AS q5,
  known / lag(known, 20) OVER {SM} - 1 AS q20, date - seen AS stale FROM known LEFT JOIN an USING (date)),
v AS (SELECT *, {enough('q1', 20, 10, 'stddev_samp(q1) OVER {w}', 'macro_id')} AS vol,
  {corr_sql('ar', 'q1', 30, 15, 'macro_id')} AS cor FROM k)"""
)
MACRO_SQL = f"""SELECT macro_id, date, lag(q1) OVER {SM} AS ret_1d_lag1, lag(q5) OVER {SM} AS ret_5d_lag1, lag(q20) OVER {SM} AS ret_20d_lag1,
  lag(vol) OVER {SM} AS vol_20d_lag1, lag(stale) OVER {SM} AS staleness_days_lag1, lag(cor) OVER {SM} AS corr_30d_lag1 FROM v"""


@query("lagged_macro", "W28 W29 J03", out(MACRO_SQL, "macro_id", "date", MACRO_NAMES, ctes=MACRO_CTES))
def _(spark, sf_dir):
    anchor = P.short_returns(line_bars(spark, sf_dir).filter(F.col("series_id") == ANCHOR), W).select("date", F.col("r1").alias("ar"))
    rows = sparse_rows(spark, sf_dir).join(anchor, "date", "left")
    return X.lagged_macro(rows, WM, "close", "ar").select("macro_id", "date", *MACRO_NAMES)


SX = "(PARTITION BY metric ORDER BY date)"
EXO_NAMES = ["lag1", "diff_1d", "diff_7d", "z30", "z90", "ma7_vs_ma30", "log_change_1d", "log_change_7d"]


def _z(n):
    return enough("lag1", n, max(10, n // 2), "(lag1 - avg(lag1) OVER {w}) / nullif(stddev_samp(lag1) OVER {w}, 0)", "metric")


EXO_CTES = METRICS + f""", l AS (SELECT metric, date, lag(value) OVER {SX} AS lag1 FROM mx),
gate AS (SELECT metric, avg(CASE WHEN lag1 >= 0 THEN 1.0 ELSE 0.0 END) > 0.30 AS active FROM l GROUP BY 1),
g AS (SELECT *, ln(1 + greatest(lag1, 0)) AS lg FROM (SELECT *, lag1 AS known FROM l) WHERE TRUE)"""
EXO_SQL = f"""SELECT metric, date, lag1, lag1 - lag(lag1) OVER {SX} AS diff_1d, lag1 - lag(lag1, 7) OVER {SX} AS diff_7d,
  {_z(30)} AS z30, {_z(90)} AS z90,
  ({enough('lag1', 7, 4, 'avg(lag1) OVER {w}', 'metric')}) / nullif({enough('lag1', 30, 15, 'avg(lag1) OVER {w}', 'metric')}, 0) - 1 AS ma7_vs_ma30,
  CASE WHEN active THEN lc1 END AS log_change_1d, CASE WHEN active THEN lc7 END AS log_change_7d
  FROM (SELECT g.*, gate.active, CASE WHEN lag1 IS NOT NULL THEN lg END - lag(CASE WHEN lag1 IS NOT NULL THEN lg END) OVER (PARTITION BY g.metric ORDER BY date) AS lc1,
        CASE WHEN lag1 IS NOT NULL THEN lg END - lag(CASE WHEN lag1 IS NOT NULL THEN lg END, 7) OVER (PARTITION BY g.metric ORDER BY date) AS lc7
        FROM g JOIN gate ON g.metric = gate.metric)"""


@query("exogenous", "W30 W31 W32 W33 P11", out(EXO_SQL, "metric", "date", EXO_NAMES, ctes=EXO_CTES, digits=5), digits=5)
def _(spark, sf_dir):
    m = status_metrics(spark, sf_dir)
    rows = PN.spine(m, ["metric"]).join(m, ["metric", "date"], "left")
    w = SeriesWindow(("metric",), "date")
    lagged = rows.withColumn("__l", F.lag("value", 1).over(w.rows))
    gate = PN.nonnegative_gate(lagged, ["metric"], "__l", share=0.30)
    return X.exogenous(rows, w, "value", gate).select("metric", "date", *EXO_NAMES)


# --- peers --------------------------------------------------------------------------------

RET = BARS + f""", ret AS (SELECT series_id, date, close / lag(close) OVER {S} - 1 AS r1, close / lag(close, 7) OVER {S} - 1 AS r7 FROM bars),
pair AS (SELECT p.series_id AS peer_id, p.date, a.r1 AS a1, a.r7 AS a7, p.r1 AS p1, p.r7 AS p7 FROM ret p JOIN ret a ON a.date = p.date AND a.series_id = '{ANCHOR}' WHERE p.series_id <> '{ANCHOR}')"""
PEER_NAMES = ["peer_return_1d", "peer_return_7d", "minus_peer_1d", "minus_peer_7d", "peer_corr_30d"]


@query(
    "peer_features", "W23 W24 W25 J04",
    out(
        f"""SELECT '{ANCHOR}' AS anchor_id, peer_id, date, p1 AS peer_return_1d, p7 AS peer_return_7d, a1 - p1 AS minus_peer_1d, a7 - p7 AS minus_peer_7d,
           {corr_sql('a1', 'p1', 30, 15, 'peer_id')} AS peer_corr_30d FROM pair""",
        "anchor_id peer_id", "date", PEER_NAMES, ctes=RET,
    ),
)
def _(spark, sf_dir):
    return P.peer_features(P.short_returns(line_bars(spark, sf_dir), W), ANCHOR)


BASKET = RET + f""", basket AS (SELECT date, avg(r1) AS b1, avg(r7) AS b7, median(r1) AS med, stddev_samp(r1) AS disp,
  count(*) FILTER (r1 > 0) / nullif(count(r1), 0) AS breadth FROM ret WHERE series_id <> '{ANCHOR}' GROUP BY date)"""


@query(
    "peer_basket", "A07",
    out(
        "SELECT date, b1 AS basket_return_1d, b7 AS basket_return_7d, med AS basket_median_1d, disp AS basket_dispersion_1d, breadth AS basket_breadth_positive_1d FROM basket",
        "", "date", "basket_return_1d basket_return_7d basket_median_1d basket_dispersion_1d basket_breadth_positive_1d", ctes=BASKET,
    ),
)
def _(spark, sf_dir):
    return P.basket(P.short_returns(line_bars(spark, sf_dir), W), ANCHOR)


def _beta(n):
    m = max(10, n // 2)
    w = frame(n)
    pair = "CASE WHEN r1 IS NOT NULL AND b1 IS NOT NULL THEN 1 END"
    return (
        f"CASE WHEN count({pair}) OVER {w} >= {m} AND count(b1) OVER {w} >= {m} "
        f"THEN covar_samp(r1, b1) OVER {w} / nullif(var_samp(b1) OVER {w}, 0) END"
    )


VS_NAMES = ["minus_basket_1d", "minus_basket_7d", "basket_corr_30d", "basket_corr_90d", "basket_beta_30d", "basket_beta_90d", "residual_1d"]


@query(
    "anchor_vs_basket", "W24 W25 W26 W27",
    out(
        f"""SELECT *, r1 - basket_beta_30d * b1 AS residual_1d FROM (SELECT series_id, date, r1, b1, r1 - b1 AS minus_basket_1d, r7 - b7 AS minus_basket_7d,
          {corr_sql('r1', 'b1', 30, 15)} AS basket_corr_30d, {corr_sql('r1', 'b1', 90, 45)} AS basket_corr_90d,
          {_beta(30)} AS basket_beta_30d, {_beta(90)} AS basket_beta_90d
          FROM (SELECT r.*, b1, b7 FROM ret r LEFT JOIN basket USING (date) WHERE series_id = '{ANCHOR}'))""",
        "series_id", "date", VS_NAMES, ctes=BASKET,
    ),
)
def _(spark, sf_dir):
    returns = P.short_returns(line_bars(spark, sf_dir), W)
    return P.anchor_vs_basket(returns, P.basket(returns, ANCHOR), ANCHOR).select("series_id", "date", *VS_NAMES)


@query(
    "coverage_profile", "A05 A08",
    out(
        """SELECT 'close' AS column, count(close) AS non_null, count(close) / count(*) AS coverage FROM known
           UNION ALL SELECT 'known', count(known), count(known) / count(*) FROM known UNION ALL SELECT 'seen', count(seen), count(seen) / count(*) FROM known""",
        "column", "", "coverage", "non_null", ctes=KNOWN,
    ),
)
def _(spark, sf_dir):
    return profile(J.last_known(sparse_rows(spark, sf_dir), "close", "known", "seen", WM), ["close", "known", "seen"])


@query(
    "panel_metadata", "A06",
    out(
        """SELECT series_id, count(*) AS series_rows, min(date) AS series_start, max(date) AS series_end, any_value(n) AS rows, 8 AS columns,
             any_value(lo) AS date_start, any_value(hi) AS date_end, any_value(k) AS n_series
           FROM bars, (SELECT count(*) AS n, min(date) AS lo, max(date) AS hi, count(DISTINCT series_id) AS k FROM bars) GROUP BY 1""",
        "series_id", "series_start series_end date_start date_end", (), "series_rows rows columns n_series", ctes=BARS,
    ),
)
def _(spark, sf_dir):
    from ..operators.selection import describe_panel, describe_series

    bars = stored(line_bars(spark, sf_dir), "bars")
    return describe_series(bars).join(F.broadcast(describe_panel(bars)))
