"""Feature-selection, imputation, scaling and search-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rolling import SeriesWindow
from ..operators import neighbours as NB
from ..operators import preprocess as PP
from ..operators import price as P
from ..operators import selection as SEL
from ..operators import splits as SP
from ..operators import labels as L
from ..operators.joins import missing_configs
from ..plans import search as SR
from ..session import scratch_path, stored
from ..sources.results import ResultStore
from .base import S, enough, line_bars, out, query, table
from .evaluation import ASSIGN, DATA, rolling_sql
from .price import LABELS

W = SeriesWindow()
FEATS = ["return_1d", "return_7d", "volatility_7d", "volatility_30d", "range_pct", "body_pct", "volume_z_14d"]


def feature_rows(spark, sf_dir):
    """Labelled rows with seven price features (rounded so both engines bin the same numbers)."""
    df = P.base_columns(line_bars(spark, sf_dir), W)
    df = P.candles(P.returns(df, W, (1, 7)))
    df = P.rolling_levels(P.rolling_moments(df, W, (7, 30)), W, (14,))
    df = L.standard_labels(L.forward_target(df, W), W)
    df = df.filter(F.col("target_end_date").isNotNull() & F.col("target_return_1d").isNotNull())
    cols = [F.round(f, 6).alias(f) for f in FEATS]
    keep = ["series_id", "date", "target_end_date", "target_return_1d", "label_dynamic", "target_move_dynamic"]
    return stored(df.select(*keep, *cols), "features")


def _feat_sql():
    z = "(log_volume - avg(log_volume) OVER {w}) / nullif(stddev_samp(log_volume) OVER {w}, 0)"
    exprs = {
        "return_1d": f"close / lag(close) OVER {S} - 1",
        "return_7d": f"close / lag(close, 7) OVER {S} - 1",
        "volatility_7d": enough("r1", 7, 3, "stddev_samp(r1) OVER {w}"),
        "volatility_30d": enough("r1", 30, 15, "stddev_samp(r1) OVER {w}"),
        "range_pct": "(high - low) / close",
        "body_pct": "(close - open) / open",
        "volume_z_14d": enough("log_volume", 14, 7, z),
    }
    return ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in exprs.items())


FDATA = DATA.replace("data AS (SELECT * FROM labelled", f"wide AS (SELECT *, {_feat_sql()} FROM labelled), data AS (SELECT * FROM wide")
TRAIN = FDATA + rolling_sql(730, 3) + ASSIGN + ", train AS (SELECT * FROM marked WHERE role = 'train')" + ", lf AS (" + " UNION ALL ".join(
    f"SELECT fold, series_id, date, target_move_dynamic AS y, '{f}' AS feature, {f} AS value FROM train" for f in FEATS
) + ")"
STATS = """SELECT fold, feature, count(*) AS rows, count(value) AS known, min(value) AS lo, max(value) AS hi, count(DISTINCT value) AS nd FROM lf GROUP BY 1, 2"""


def folds3(df):
    return SP.fixed(SP.rolling_folds(df, 730, n_splits=3))


@query(
    "train_stats", "A08 P12",
    out(f"SELECT fold, feature, rows, known, lo, hi, nd AS n_distinct, known / rows AS coverage FROM ({STATS})", "feature", "", "lo hi coverage", "fold rows known n_distinct", ctes=TRAIN),
)
def _(spark, sf_dir):
    df = feature_rows(spark, sf_dir)
    return SEL.train_stats(df, folds3(df), FEATS)


@query(
    "coverage_selected", "P12",
    out(
        f"""SELECT fold, feature FROM (SELECT *, count(*) FILTER (known / rows >= 0.995) OVER (PARTITION BY fold) AS n FROM ({STATS}) WHERE lo < hi)
            WHERE known / rows >= 0.995 OR (n < 5 AND known / rows >= 0.30)""",
        "feature", "", (), "fold", ctes=TRAIN,
    ),
)
def _(spark, sf_dir):
    """With a strict 99.5 % gate, so that the relaxed branch is exercised."""
    df = feature_rows(spark, sf_dir)
    return SEL.coverage_selected(SEL.train_stats(df, folds3(df), FEATS), wanted=0.995).select("fold", "feature")


MI_CTES = TRAIN + """, ed AS (SELECT fold, feature, quantile_disc(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e, quantile_disc(value, 0.5) AS mid,
    count(value) AS known, count(*) AS rows FROM lf GROUP BY 1, 2),
bn AS (SELECT fold, feature, y, len([v for v in e if v <= coalesce(value, mid)]) AS bin FROM lf JOIN ed USING (fold, feature) WHERE known >= 0.6 * rows),
jt AS (SELECT fold, feature, bin, y, count(*)::DOUBLE AS n FROM bn GROUP BY 1, 2, 3, 4),
mi AS (SELECT fold, feature, sum(n / t * ln(n * t / (nx * ny))) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY fold, feature, bin) AS nx,
    sum(n) OVER (PARTITION BY fold, feature, y) AS ny, sum(n) OVER (PARTITION BY fold, feature) AS t FROM jt) GROUP BY 1, 2)"""


@query("mutual_information", "M15", out("SELECT fold, feature, mi FROM mi", "feature", "", "mi", "fold", ctes=MI_CTES))
def _(spark, sf_dir):
    df = feature_rows(spark, sf_dir)
    return SEL.binned_information(df, folds3(df), FEATS, "target_move_dynamic")


@query(
    "top_features", "M15 O04",
    out("SELECT fold, feature, rank FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY mi DESC, feature) AS rank FROM mi) WHERE rank <= 4", "feature", "", (), "fold rank", ctes=MI_CTES),
)
def _(spark, sf_dir):
    df = feature_rows(spark, sf_dir)
    return SEL.top_features(SEL.binned_information(df, folds3(df), FEATS, "target_move_dynamic"), "mi", 4).select("fold", "feature", "rank")


def _psi(x):
    """Digamma of a positive whole number."""
    return f"(ln({x} + 6.0) - 0.5 / ({x} + 6.0) - 1 / (12 * power({x} + 6.0, 2)) + 1 / (120 * power({x} + 6.0, 4)) - 1 / (252 * power({x} + 6.0, 6)) + 1 / (240 * power({x} + 6.0, 8)) - " + " - ".join(f"1.0 / ({x} + {i})" for i in range(6)) + ")"


NEAR = ", ".join(f"abs(x - {f}(x, {j}) OVER c)" for f in ("lag", "lead") for j in (1, 2, 3))
KNN_CTES = TRAIN + f""", gate AS (SELECT fold, feature, median(value) AS mid FROM lf GROUP BY 1, 2 HAVING count(value) >= 0.6 * count(*) AND count(DISTINCT value) > 2),
pt0 AS (SELECT fold, feature, y, coalesce(value, mid) AS x FROM lf JOIN gate USING (fold, feature) WHERE y IS NOT NULL),
pt AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY fold, feature, y) AS nc FROM pt0) WHERE nc > 1),
rad AS (SELECT *, least(3, nc - 1) AS k, list_sort([{NEAR}])[CAST(least(3, nc - 1) AS INTEGER)] * (1 - power(2.0::DOUBLE, -53)) AS r FROM pt WINDOW c AS (PARTITION BY fold, feature, y ORDER BY x)),
cnt AS (SELECT *, count(*) OVER (PARTITION BY fold, feature ORDER BY x RANGE BETWEEN r PRECEDING AND r FOLLOWING) AS m, count(*) OVER (PARTITION BY fold, feature) AS t FROM rad),
knn AS (SELECT fold, feature, greatest({_psi('any_value(t)')} + avg({_psi('k')}) - avg({_psi('nc')}) - avg({_psi('m')}), 0) AS mi FROM cnt GROUP BY 1, 2)"""


@query("neighbour_information", "M15", out("SELECT fold, feature, mi FROM knn", "feature", "", "mi", "fold", ctes=KNN_CTES))
def _(spark, sf_dir):
    """Information about the move from the third neighbour in its class; blocks short enough that each feature spans many."""
    df = feature_rows(spark, sf_dir)
    return NB.class_information(df, folds3(df), FEATS, "target_move_dynamic", block_rows=512)


@query("neighbour_information_of_returns", "M15")
def _(spark, sf_dir):
    """The same about the next return as a number."""
    df = feature_rows(spark, sf_dir)
    return NB.value_information(df, folds3(df), FEATS, "target_return_1d")


@query(
    "variance_ranking", "M16",
    out(
        """SELECT fold, feature, var_pop(coalesce(value, mid)) AS variance FROM lf JOIN (SELECT fold, feature, median(value) AS mid FROM lf GROUP BY 1, 2
           HAVING count(value) >= 0.6 * count(*) AND count(DISTINCT value) > 2) USING (fold, feature) GROUP BY 1, 2""",
        "feature", "", "variance", "fold", ctes=TRAIN,
    ),
)
def _(spark, sf_dir):
    df = feature_rows(spark, sf_dir)
    return SEL.train_variance(df, folds3(df), FEATS)


@query(
    "selection_frequency", "A10",
    out(
        """SELECT 'scout' AS experiment, 'all' AS feature_set, 'm' AS model, feature, 3 AS fold_count, count(*) AS selected_folds, count(*) / 3.0 AS selection_rate
           FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY mi DESC, feature) AS rank FROM mi) WHERE rank <= 4 GROUP BY feature""",
        "experiment feature_set model feature", "", "selection_rate", "fold_count selected_folds", ctes=MI_CTES,
    ),
)
def _(spark, sf_dir):
    df = feature_rows(spark, sf_dir)
    top = SEL.top_features(SEL.binned_information(df, folds3(df), FEATS, "target_move_dynamic"), "mi", 4)
    per_fold = top.groupBy("fold").agg(F.collect_list("feature").alias("fs"))
    records = per_fold.agg(F.collect_list("fs").alias("selected_features")).select(
        F.lit("scout").alias("experiment"), F.lit("all").alias("feature_set"), F.lit("m").alias("model"), "selected_features"
    )
    return SEL.selection_frequency(records)


#: Dimensions of the vectors; each is unknown for one class.
DIMS, N_CLASSES = 64, 10
EMB = [f"e{i}" for i in range(DIMS)]
EMB_SQL = "emb AS (SELECT vec_id, label, " + ", ".join(
    f"CASE WHEN label = {i % N_CLASSES} THEN NULL ELSE round(CAST(embedding[{i + 1}] AS DOUBLE), 6) END AS e{i}" for i in range(DIMS)
) + " FROM embeddings)"


def vectors(spark, sf_dir):
    """The dimensions of the embeddings as features."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id", "label",
        *[F.when(F.col("label") != i % N_CLASSES, F.round(F.col("embedding")[i].cast("double"), 6)).alias(f"e{i}") for i in range(DIMS)],
    )


@query(
    "median_imputation", "M01 M02",
    out(
        " UNION ALL ".join(
            f"SELECT vec_id, 'e{i}' AS feature, coalesce(e{i}, (SELECT median(e{i}) FROM emb)) AS imputed, CASE WHEN e{i} IS NULL THEN 1.0 ELSE 0.0 END AS was_missing FROM emb"
            for i in range(DIMS)
        ),
        "feature", "", "imputed was_missing", "vec_id", ctes=EMB_SQL, digits=8,
    ),
    digits=8,
)
def _(spark, sf_dir):
    v = vectors(spark, sf_dir)
    long = SEL.long_features(v, ["vec_id"], EMB)
    return PP.impute_long(long, PP.train_medians(v, EMB)).drop("value")


@query(
    "missing_flags", "M02",
    out("SELECT vec_id, " + ", ".join(f"CASE WHEN e{i} IS NULL THEN 1.0 ELSE 0.0 END AS e{i}_missing" for i in range(DIMS)) + " FROM emb", "", "", [f"{c}_missing" for c in EMB], "vec_id", ctes=EMB_SQL),
)
def _(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return PP.with_missing_flags(v, PP.missing_flags(v, EMB)).select("vec_id", *[f"{c}_missing" for c in EMB])


@query(
    "standardised_features", "M03",
    out("SELECT vec_id, " + ", ".join(f"(e{i} - (SELECT avg(e{i}) FROM emb)) / (SELECT stddev_pop(e{i}) FROM emb) AS e{i}" for i in range(DIMS)) + " FROM emb", "", "", EMB, "vec_id", ctes=EMB_SQL),
)
def _(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return PP.standardised(v, PP.scale_stats(v, EMB), EMB).select("vec_id", *EMB)


@query(
    "class_weights", "M09",
    out(
        "SELECT label_dynamic, (SELECT count(*) FROM labelled)::DOUBLE / ((SELECT count(DISTINCT label_dynamic) FROM labelled) * count(*)) AS weight FROM labelled GROUP BY 1",
        "", "", "weight", "label_dynamic", ctes=LABELS,
    ),
)
def _(spark, sf_dir):
    from .price import labelled

    return PP.class_weights(labelled(spark, sf_dir), "label_dynamic")


# --- search tables ------------------------------------------------------------------------

GRID_AXES = """(SELECT DISTINCT o_orderpriority AS feature_set FROM orders), (SELECT DISTINCT o_orderstatus AS model FROM orders), (VALUES (30), (50)) AS t(top_k)"""
HASH = """sha256('{"feature_set":"' || feature_set || '","model":"' || model || '","top_k":' || top_k || '}')"""


def order_grid(spark, sf_dir):
    """A configuration grid whose axes are the distinct priorities and statuses of the orders."""
    from ..plans.search import config_grid

    o = table(spark, sf_dir, "orders", "o_orderpriority", "o_orderstatus")
    axis = lambda name: sorted(r[0] for r in o.select(name).distinct().collect())
    return config_grid(spark, {"feature_set": axis("o_orderpriority"), "model": axis("o_orderstatus"), "top_k": [30, 50]})


@query("config_grid", "X01 F07", out(f"SELECT feature_set, model, top_k, {HASH} AS config_hash FROM {GRID_AXES}", "feature_set model config_hash", "", (), "top_k"))
def _(spark, sf_dir):
    return order_grid(spark, sf_dir)


@query(
    "missing_configs", "J08 S18",
    out(f"SELECT feature_set, model, top_k, {HASH} AS config_hash FROM {GRID_AXES} WHERE NOT (model = 'F' AND top_k = 50)", "feature_set model config_hash", "", (), "top_k"),
)
def _(spark, sf_dir):
    """Results are appended twice for one model; only unseen configurations remain."""
    grid = order_grid(spark, sf_dir)
    store = ResultStore(spark, scratch_path(spark, "results"))
    known = [
        {"config_hash": r["config_hash"], "kind": "scout", "model": "F", "top_k": 50, "robust_score": 0.5}
        for r in grid.filter((F.col("model") == "F") & (F.col("top_k") == 50)).collect()
    ]
    store.append(known)
    store.append(known)
    return missing_configs(grid, store.load())


REC = """rec AS (SELECT o_orderpriority AS feature_set, o_orderstatus AS model, CAST(extract(year FROM o_orderdate) AS INTEGER) AS top_k,
  round(avg(o_totalprice), 2) AS robust_score, CAST(max(o_custkey) AS DOUBLE) AS roc_auc FROM orders GROUP BY 1, 2, 3)"""


def order_results(spark, sf_dir):
    """Experiment records whose scores are order aggregates."""
    from ..functions.hashing import config_hash

    o = table(spark, sf_dir, "orders")
    r = o.groupBy(F.col("o_orderpriority").alias("feature_set"), F.col("o_orderstatus").alias("model"), F.year("o_orderdate").alias("top_k")).agg(
        F.round(F.avg("o_totalprice"), 2).alias("robust_score"), F.max("o_custkey").cast("double").alias("roc_auc")
    )
    r = r.withColumn("config_hash", config_hash(["feature_set", "model", "top_k"]))
    return r.withColumns({"kind": F.lit("scout"), "task": F.lit("orders"), "selected_features": F.array(F.array("feature_set"))})


@query(
    "experiment_promotion", "O04 O05 X02",
    out(
        """SELECT model, feature_set, top_k, robust_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY robust_score DESC, roc_auc DESC) AS rank FROM rec) WHERE rank <= 3""",
        "model feature_set", "", "robust_score", "top_k rank", ctes=REC,
    ),
)
def _(spark, sf_dir):
    return SR.promoted(order_results(spark, sf_dir), 3, ["model"]).select("model", "feature_set", "top_k", "robust_score", "rank")


@query(
    "comparison_rows", "X08",
    out("SELECT 'scout' AS kind, feature_set, model, top_k, robust_score, roc_auc FROM rec", "kind feature_set model", "", "robust_score roc_auc", "top_k", ctes=REC),
)
def _(spark, sf_dir):
    return SR.comparison_rows(order_results(spark, sf_dir)).drop("task")


@query(
    "config_lock", "X06 O05",
    out("SELECT feature_set, model, top_k, robust_score FROM rec ORDER BY robust_score DESC, roc_auc DESC LIMIT 1", "feature_set model", "", "robust_score", "top_k", ctes=REC),
)
def _(spark, sf_dir):
    row = SR.lock({"final": order_results(spark, sf_dir)}, scratch_path(spark, "lock"))
    return row.select("feature_set", "model", "top_k", "robust_score")
