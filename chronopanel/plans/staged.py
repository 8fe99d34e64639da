"""Staged searches run to their end: stages, decision threshold, its verification, baselines, refit and lock.

Everything a stage has finished lies in the store under its configuration hash, predictions included, so a run that was killed
goes on where it stopped, and what follows the last stage reads the predictions instead of fitting again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decisions as D
from ..operators import selection as SEL
from ..operators import splits as SP
from ..session import small_table, stored
from ..sources.results import ResultStore
from .models import ModelSpec
from .research import refit_locked
from .search import CONFIG, SearchData, SearchPlan, coarse_to_fine, config_grid, lock, promoted, regression_comparison, run_stage

#: Training window of the folds that the three-class baselines are read on.
BASELINE_WINDOW = 1095
#: Place of the task stages in the log, behind those of the search.
TASK_STAGE = 100


def _chosen(history: dict[str, DataFrame]) -> dict:
    """The configuration that the last stage confirmed."""
    return promoted(history["final"], 1).first().asDict()


def pruning(store: ResultStore, run: str) -> DataFrame:
    """Per stage: how many configurations it asked for, and the best score among them."""
    return store.stages(run).groupBy("run", "position", "stage", "phase").agg(
        F.count(F.lit(1)).alias("asked"), F.max("robust_score").alias("best_robust_score"), F.max_by("config_hash", F.struct("robust_score", "roc_auc", "config_hash")).alias("best_config")
    )


def move_research(data: SearchData, store: ResultStore, plan: SearchPlan, path: str) -> dict[str, DataFrame]:
    """The binary search to its lock.

    The threshold is chosen on the first part of the final out-of-fold calendar and verified, fixed, on the rest, beside two
    baselines; the chosen configuration is then fitted on its trailing window and stored under ``path``.  ``prospective`` says
    which day the first untouched prediction can be made.
    """
    history = coarse_to_fine(data, store, plan)
    best = _chosen(history)
    oof = store.predictions(best["config_hash"])
    parts = stored(SP.selection_cut(oof.withColumn("move_p", F.col("p")[1])), "final-oof")
    early, late = parts.filter("part = 'select'"), parts.filter("part = 'verify'")
    sweep = stored(D.threshold_scores(early, [], "y", "move_p"), "threshold-sweep")
    picked = stored(D.best_threshold(sweep, []), "threshold")
    sizes = parts.agg(F.count_if(F.col("part") == "select").alias("selection_rows"), F.count_if(F.col("part") == "verify").alias("verification_rows"))
    verified = stored(D.verify_threshold(late, picked, "y", "move_p").join(F.broadcast(sizes)), "verification")
    frame = data.labels_for(best["vol_window"], best["k"])
    known = frame.select("series_id", "date", F.col("return_1d").alias("r1"), "research_threshold")
    baselines = stored(D.move_baselines(late.select("series_id", "date", "y").join(known, ["series_id", "date"]), "y", "r1", "research_threshold"), "move-baselines")

    threshold = picked.first()["decision_threshold"]
    window = best["train_window_days"] or None
    spec = data.specs[best["model"]].seeded(best["seed"])
    config = {c: best[c] for c in CONFIG} | {"train_window_days": window, "target": data.target, "decision_threshold": threshold, "config_hash": best["config_hash"]}
    supervised = frame.filter(F.col(data.target).isNotNull() & F.col("target_end_date").isNotNull())
    _, refit = refit_locked(supervised, config, data.groups[best["feature_set"]], spec, f"{path}/model")
    prospective = supervised.agg(F.max("target_end_date").alias("reviewed_through")).withColumn("prospective_start", F.date_add("reviewed_through", 1))
    locked = lock(history, f"{path}/lock").withColumn("decision_threshold", F.lit(threshold)).join(F.broadcast(prospective))
    return {
        "stages": store.stages(plan.name).drop("selected_features"), "pruning": pruning(store, plan.name), "threshold": sweep, "verification": verified,
        "baselines": baselines, "refit": refit, "lock": locked,
    }


#: Formulations of the same rows.
TASKS = ("three_class", "direction", "move")


def _tasks(data: SearchData, store: ResultStore, plan: SearchPlan, best: dict, models: Sequence[str]) -> DataFrame:
    """The chosen configuration as three tasks, through the store: what the stages have fitted is read."""
    parts = []
    for i, task in enumerate(TASKS):
        axes = {a: [best[a]] for a in ("train_window_days", "vol_window", "k", "feature_set")}
        axes = {"kind": [f"{plan.name}_task"], **axes, "model": list(models), "top_k": [best["top_k"]], "n_splits": [plan.confirm_splits], "seed": [plan.seed], "task": [task]}
        grid = config_grid(data.frame.sparkSession, axes)
        store.note(plan.name, TASK_STAGE + i, f"task_{task}", "confirm", grid)
        parts.append(run_stage(replace(data, task=task), store, grid, "confirm"))
    columns = ["task", "model", "accuracy", "balanced_accuracy", "macro_f1", "robust_score", "oof_rows"]
    return reduce(DataFrame.unionByName, parts).select(*columns)


def three_class_research(
    data: SearchData, store: ResultStore, plan: SearchPlan, path: str, regressors: Sequence[ModelSpec], ranked_models: int = 3
) -> dict[str, DataFrame]:
    """The three-class search to its lock: stages, the same rows as three tasks and as a regression, baselines, how often
    features were chosen, and what each stage kept."""
    history = coarse_to_fine(data, store, plan)
    best = _chosen(history)
    vol, k, group, window = best["vol_window"], best["k"], best["feature_set"], best["train_window_days"]
    families = promoted(history["family"], 10**6).orderBy("rank").select("model").collect()  # one row per configuration
    models = list(dict.fromkeys(r["model"] for r in families))[:ranked_models]
    tasks = stored(_tasks(data, store, plan, best, models), "tasks")
    regressions = stored(regression_comparison(data, vol, k, group, regressors, plan.confirm_splits, window), "regressions")
    frame = data.labels_for(vol, k)
    folds = data.folds_for(BASELINE_WINDOW, plan.final_splits)
    valid = SP.assign(frame, folds).filter("role = 'valid' AND research_label IS NOT NULL")
    baselines = stored(D.three_class_baselines(valid, "research_label", "return_1d", "research_threshold"), "baselines")
    records = store.stages(plan.name).withColumnRenamed("stage", "experiment").filter(F.size("selected_features") > 0)
    best_task = tasks.groupBy("task").agg(F.max_by("model", F.struct("robust_score", "model")).alias("model"), F.max("robust_score").alias("robust_score"))
    chosen = [lock(history, f"{path}/lock").select(F.lit("three_class_lock").alias("item"), F.to_json(F.struct(*CONFIG)).alias("choice"))]
    chosen.append(best_task.select(F.concat(F.lit("best_"), "task"), F.to_json(F.struct("model", "robust_score"))))
    order = F.struct("fold_pearson_mean", "model")
    chosen.append(regressions.agg(F.max_by(F.struct("model", "fold_pearson_mean"), order).alias("b")).filter("b IS NOT NULL").select(F.lit("best_regression"), F.to_json("b")))
    chosen.append(small_table(frame.sparkSession, [("promoted_models", ", ".join(models))], "item string, choice string"))
    return {
        "stages": store.stages(plan.name).drop("selected_features"), "pruning": pruning(store, plan.name), "tasks": tasks, "regressions": regressions,
        "baselines": baselines, "selection_frequency": SEL.selection_frequency(records), "lock": reduce(DataFrame.union, chosen),
    }


def as_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """All parts under one another: name of the part, and each row as JSON."""
    return reduce(DataFrame.unionByName, [p.select(F.lit(n).alias("part"), F.to_json(F.struct(*p.columns)).alias("row")) for n, p in parts.items()])
