"""Model, cross-validation and search queries over the whole labelled panel.

Learners are not expressible in SQL, so these report scores and are checked by
tests.  Forests and logistic models have their catalogued sizes, boosting has fewer rounds here.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import splits as SP
from ..plans import research as RS
from ..plans import search as SR
from ..plans import staged as ST
from ..plans.crossval import KEYS, classification_cv, regression_cv, side_by_side
from ..plans.models import CLASSIFIERS, REGRESSORS, FactsCache, fit_classifier, predict_classes
from ..plans.registry import ModelRegistry
from ..session import scratch_path, stored
from ..sources.results import ResultStore
from ..operators import price as P
from ..operators import labels as L
from ..functions.rolling import SeriesWindow
from .base import line_bars, out, query
from .evaluation import ASSIGN, DATA, rolling_sql

W = SeriesWindow()
FEATS = ["return_1d", "return_7d", "volatility_7d", "volatility_30d", "range_pct", "body_pct", "volume_z_14d"]
GROUPS = {"all": FEATS, "returns": FEATS[:5]}
#: Boosting rounds of the queries (300 to 500 in the catalogue).
ROUNDS = 20
QUICK = {n: s.sized(ROUNDS) if s.family == "boost" else s for n, s in CLASSIFIERS.items()}
QUICK_REG = {n: s.sized(ROUNDS) if s.family == "boost_reg" else s for n, s in REGRESSORS.items()}


def model_rows(spark, sf_dir, regimes=False):
    """Seven features, targets and the log return of every labelled row, stored once; the columns of regimes if asked for."""
    df = P.base_columns(line_bars(spark, sf_dir), W)
    df = P.candles(P.returns(df, W, (1, 7)))
    df = P.rolling_levels(P.rolling_moments(df, W, (7, 21, 30)), W, (14,))
    df = L.standard_labels(L.forward_target(df, W), W)
    context = ["vol_regime_pctile", "ema_gap_90d"] if regimes else []
    if regimes:
        df = P.vol_regime(P.ema_gaps(df, W, (90,)), W)
    df = df.filter(F.col("target_end_date").isNotNull() & F.col("target_return_1d").isNotNull())
    keep = ["series_id", "date", "target_end_date", "target_return_1d", "log_return_1d", "threshold_dynamic", "label_dynamic", "target_move_dynamic", "target_direction", "volatility_21d"]
    return stored(df.select(*keep, *FEATS, *context), "model-rows")


def folds_of(df, k=2, window=730):
    return SP.rolling_folds(df, window, n_splits=k)


def oof(spark, sf_dir, name, target, window=730, k=2):
    df = model_rows(spark, sf_dir)
    done = classification_cv(df, target, L.target_classes(target), FEATS, QUICK[name], folds_of(df, k, window), top_k=5)
    return done.fold_scores


@query("logistic_oof", "M04 M13")
def _(spark, sf_dir):
    return oof(spark, sf_dir, "logistic", "label_dynamic")


@query("random_forest_oof", "M05 M13")
def _(spark, sf_dir):
    return oof(spark, sf_dir, "random_forest", "target_move_dynamic")


@query("extra_trees_oof", "M06 M13")
def _(spark, sf_dir):
    return oof(spark, sf_dir, "extra_trees", "target_move_dynamic", None)


@query("boosted_trees_oof", "M07 M13")
def _(spark, sf_dir):
    return oof(spark, sf_dir, "lightgbm", "label_dynamic")


@query("expanding_oof", "M12")
def _(spark, sf_dir):
    df = model_rows(spark, sf_dir)
    done = classification_cv(df, "label_dynamic", L.THREE_CLASSES, FEATS, QUICK["random_forest"], SP.expanding_folds(df, 2), how="coverage")
    return done.fold_scores


@query("regression_oof", "M08 M14")
def _(spark, sf_dir):
    df = model_rows(spark, sf_dir)
    return regression_cv(df, "target_return_1d", "threshold_dynamic", FEATS, QUICK_REG["random_forest_reg"], folds_of(df), top_k=5).fold_scores


@query(
    "oof_audit", "M04 M06 M07 M13 M10 E01",
    out(
        """SELECT model, fold, count(*) AS samples, count(DISTINCT (series_id, date)) AS distinct_rows, count(*) AS sum_to_one, count(*) AS in_range, 1 AS scores_agree
           FROM marked, (VALUES ('logistic'), ('extra_trees'), ('lightgbm')) AS m(model) WHERE role = 'valid' GROUP BY 1, 2""",
        "model", "", (), "fold samples distinct_rows sum_to_one in_range scores_agree", ctes=DATA + rolling_sql(730, 2) + ASSIGN,
    ),
)
def _(spark, sf_dir):
    """What SQL can say of out-of-fold predictions: each validation row once, probabilities that sum to one, and fold scores that
    are those of the stored rows.  Tree counts are small here, the other queries have the catalogue's."""
    df = model_rows(spark, sf_dir)
    specs = [QUICK["logistic"], QUICK["extra_trees"].sized(20), QUICK["lightgbm"].sized(3)]
    folds, facts = SP.fixed(folds_of(df)), FactsCache()
    calls = [partial(classification_cv, df, "label_dynamic", L.THREE_CLASSES, FEATS, s, folds, 5, facts=facts) for s in specs]
    parts = []
    for spec, done in zip(specs, side_by_side(*calls)):
        p = F.col("p")
        audit = done.predictions.groupBy("fold").agg(
            F.count(F.lit(1)).alias("samples"), F.count_distinct("series_id", "date").alias("distinct_rows"),
            F.count_if(F.abs(F.aggregate(p, F.lit(0.0), lambda a, v: a + v) - 1) < 1e-9).alias("sum_to_one"),
            F.count_if((F.size(p) == 3) & (F.array_min(p) >= 0) & (F.array_max(p) <= 1)).alias("in_range"),
        )
        again = M.class_scores(done.predictions, ["fold"], "y", "pred").select("fold", F.col("macro_f1").alias("__f1"), F.col("accuracy").alias("__acc"))
        agree = (F.abs(F.col("__f1") - F.col("macro_f1")) < 1e-9) & (F.abs(F.col("__acc") - F.col("accuracy")) < 1e-9)
        scores = done.fold_scores.select("fold", "macro_f1", "accuracy").join(again, "fold").select("fold", agree.cast("int").alias("scores_agree"))
        parts.append(audit.join(scores, "fold").withColumn("model", F.lit(spec.name)))
    return reduce(DataFrame.unionByName, parts)


@query("model_registry", "S17 M20", out("SELECT model, series_id, date, 2 AS version, 1 AS same FROM data, (VALUES ('logistic'), ('extra_trees'), ('lightgbm')) AS m(model)", "model series_id", "date", (), "version same", ctes=DATA))
def _(spark, sf_dir):
    """Models published twice and loaded again by their configuration hash: every prediction as before."""
    df = model_rows(spark, sf_dir)
    registry, facts = ModelRegistry(spark, scratch_path(spark, "registry")), FactsCache()
    parts = []
    for spec in (QUICK["logistic"], QUICK["extra_trees"].sized(20), QUICK["lightgbm"].sized(3)):
        fitted = fit_classifier(df, FEATS, "label_dynamic", spec, facts.of(("all",), df, FEATS, "label_dynamic"))
        before = predict_classes(fitted, df, KEYS, L.THREE_CLASSES)
        for _ in range(2):
            registry.publish(f"{spec.name}-all", fitted, {"model": spec.name, "rows": facts.of(("all",), df, FEATS, "label_dynamic").rows})
        loaded, _ = registry.load(f"{spec.name}-all")
        version = registry.latest().filter(F.col("config_hash") == f"{spec.name}-all").first()["version"]
        after = predict_classes(loaded, df, KEYS, L.THREE_CLASSES).withColumnRenamed("p", "q")
        same = F.forall(F.arrays_zip("p", "q"), lambda z: z["p"] == z["q"]).cast("int")
        parts.append(before.join(after, list(KEYS)).select(F.lit(spec.name).alias("model"), *KEYS, F.lit(version).alias("version"), same.alias("same")))
    return reduce(DataFrame.unionByName, parts)


@query("task_evaluation", "M18 M25 M17 S17")
def _(spark, sf_dir):
    df = model_rows(spark, sf_dir)
    parts = RS.evaluate_task(df, "label_dynamic", {"all": FEATS}, [QUICK["random_forest"], QUICK["logistic"]], 2, 2, scratch_path(spark, "best"))
    return parts["holdout"]


@query("two_stage_models", "M19")
def _(spark, sf_dir):
    return RS.two_stage(model_rows(spark, sf_dir), FEATS, [QUICK["random_forest"]], 2)["holdout"]


@query("baseline_research", "X07 E12")
def _(spark, sf_dir):
    df = model_rows(spark, sf_dir)
    targets = {"move_dynamic": "target_move_dynamic", "three_class_dynamic": "label_dynamic"}
    forest = [QUICK["random_forest"]]
    *parts, staged = side_by_side(
        *[partial(RS.evaluate_task, df, target, {"all": FEATS}, forest, 2, 1) for target in targets.values()], lambda: RS.two_stage(df, FEATS, forest, 2)
    )
    return RS.scorecard(dict(zip(targets, parts)), staged)


@query("locked_refit", "M20 S17 P13")
def _(spark, sf_dir):
    df = model_rows(spark, sf_dir)
    config = {"train_window_days": 730, "target": "label_dynamic", "top_k": 5, "vol_window": 21, "k": 0.7}
    _, summary = RS.refit_locked(df, config, FEATS, QUICK["extra_trees"], scratch_path(spark, "locked"))
    return summary.withColumn("features", F.array_join("features", ","))


@query("seed_stability", "M21 A09")
def _(spark, sf_dir):
    df = model_rows(spark, sf_dir)
    return RS.seed_stability(df, "target_move_dynamic", FEATS, QUICK["random_forest"], folds_of(df))


@query("post_analysis", "X05 M17 M23 M24")
def _(spark, sf_dir):
    """Every part of the analysis but the predictions, each row as JSON."""
    df = model_rows(spark, sf_dir, regimes=True)
    specs = [QUICK["random_forest"], QUICK["logistic"]]
    parts = RS.post_analysis(df, "label_dynamic", FEATS, specs, folds_of(df), "vol_regime_pctile", "ema_gap_90d")
    long = [p.select(F.lit(n).alias("part"), F.to_json(F.struct(*p.columns)).alias("row")) for n, p in parts.items() if n != "predictions"]
    return reduce(DataFrame.unionByName, long)


def search_data(spark, sf_dir, task):
    return SR.SearchData(model_rows(spark, sf_dir), GROUPS, QUICK, task)


SMALL = dict(windows=(730, 0), vol_windows=(7,), ks=(0.9,), top_ks=(5,), scout_splits=1, confirm_splits=2, final_splits=2, keep_windows=1, keep_labels=1, keep_groups=1)


@query("move_search", "X03 X01 J08 O04 S18 M20")
def _(spark, sf_dir):
    """Stages, threshold, verification, baselines, refit and lock; each row as JSON."""
    plan = SR.SearchPlan(**SMALL, scout_model="logistic", confirm_models=("logistic",), start_top_k=7)
    store = ResultStore(spark, scratch_path(spark, "move-search"))
    return ST.as_rows(ST.move_research(search_data(spark, sf_dir, "move"), store, plan, scratch_path(spark, "move-lock")))


@query("three_class_search", "X02 X01 J08 A10 M22")
def _(spark, sf_dir):
    """Stages, tasks, regressions, baselines, selection frequency, pruning and lock; each row as JSON."""
    plan = SR.SearchPlan(name="three_class_search", **{**SMALL, "windows": (730,), "ks": (0.7,)}, scout_model="logistic", confirm_models=("logistic",), start_top_k=7)
    store = ResultStore(spark, scratch_path(spark, "class-search"))
    data = search_data(spark, sf_dir, "three_class")
    return ST.as_rows(ST.three_class_research(data, store, plan, scratch_path(spark, "class-lock"), [QUICK_REG["lightgbm_reg"]]))


@query("exhaustive_search", "X04")
def _(spark, sf_dir):
    axes = {
        "kind": ["full"], "train_window_days": [730, 0], "vol_window": [21], "k": [0.7], "feature_set": ["returns"],
        "model": ["logistic"], "top_k": [7], "n_splits": [1], "seed": [42], "task": ["move"],
    }
    store = ResultStore(spark, scratch_path(spark, "full-search"))
    return SR.comparison_rows(SR.exhaustive(search_data(spark, sf_dir, "move"), store, axes))


@query("task_formulations", "X02")
def _(spark, sf_dir):
    return SR.task_comparison(search_data(spark, sf_dir, "move"), 21, 0.7, "all", ["logistic"], 1, 730, 7)


@query("regression_formulations", "M08 M14 X02")
def _(spark, sf_dir):
    return SR.regression_comparison(search_data(spark, sf_dir, "move"), 21, 0.7, "all", [QUICK_REG["random_forest_reg"], QUICK_REG["lightgbm_reg"]], 1, 730)


@query("model_dataset_profile", "A05 A06 W23 W28 W30")
def _(spark, sf_dir):
    """Coverage of every column of the anchor's full dataset: price, peer, sparse and exogenous families."""
    from ..operators.selection import profile
    from ..plans.dataset import anchor_dataset
    from .base import ANCHOR, PEERS, sparse_closes, status_metrics

    sparse = sparse_closes(spark, sf_dir)
    metrics = status_metrics(spark, sf_dir)
    df, families = anchor_dataset(
        line_bars(spark, sf_dir), ANCHOR, PEERS, sparse, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], metrics, ["F", "O", "P"]
    )
    names = [f for fam in families.values() for f in fam]
    return profile(stored(df, "dataset"), names)
