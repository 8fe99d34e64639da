"""Configuration search as table work: grid, skip what is known, fit, promote, lock.

A stage is a small DataFrame of configurations.  Stored results are removed by
an anti join, the rest is evaluated and appended, and the best rows seed the
next stage.  Grids and summaries have one row per configuration.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import config_hash
from ..functions.rolling import SeriesWindow
from ..operators import labels as L
from ..operators import splits as SP
from ..operators.joins import missing_configs
from ..operators.ranking import top_per_group
from ..session import small_table, stored
from ..sources.results import ResultStore
from .crossval import PARALLEL, classification_cv, regression_cv
from .models import FactsCache, ModelSpec

# Search grids; 0 days means an expanding window.
WINDOWS = (365, 730, 1095, 1825, 0)
VOL_WINDOWS = (7, 14, 21, 30, 60)
KS_THREE = (0.5, 0.7, 0.9)
KS_MOVE = (0.5, 0.7, 0.9, 1.1)
TOP_KS = (30, 50, 75, 100, 150)
CONFIG = ("kind", "train_window_days", "vol_window", "k", "feature_set", "model", "top_k", "n_splits", "seed", "task")


def config_grid(spark: SparkSession, axes: Mapping[str, Sequence]) -> DataFrame:
    """Cross product of the axes (as many rows as combinations).

    The hash leaves out ``kind``: a configuration that two stages ask for is evaluated once.
    """
    grid = spark.range(1)
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    grid = grid.drop("id")
    return grid.withColumn("config_hash", config_hash([a for a in axes if a != "kind"]))


def promoted(results: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Best ``k`` configurations (per group): robust score, then ROC AUC, then hash."""
    groups = list(by) or ["task"]
    order = [F.col("robust_score").desc_nulls_last(), F.col("roc_auc").desc_nulls_last(), F.col("config_hash")]
    return top_per_group(results, groups, order, k)


def comparison_rows(results: DataFrame) -> DataFrame:
    """Phase, configuration and summary columns without the feature lists."""
    return results.drop("selected_features", "config_hash")


@dataclass
class SearchData:
    """What a search runs on: stored rows, feature groups and estimator choices."""

    frame: DataFrame
    groups: Mapping[str, Sequence[str]]
    specs: Mapping[str, ModelSpec]
    task: str = "move"
    log_return: str = "log_return_1d"
    valid_days: int = 180
    prepared: dict = field(default_factory=dict)

    def labels_for(self, vol: int, k: float) -> DataFrame:
        """Rows labelled for one (window, k), written once per search."""
        key = ("labels", vol, k)
        if key not in self.prepared:
            labelled = L.with_dynamic_label(self.frame, SeriesWindow(), vol, k, self.log_return)
            self.prepared[key] = stored(labelled, "labelled")
        return self.prepared[key]

    def folds_for(self, window: int, n_splits: int) -> DataFrame:
        """Fold table of one (training window, splits); it does not depend on the labels."""
        key = ("folds", window, n_splits)
        if key not in self.prepared:
            self.prepared[key] = SP.fixed(SP.rolling_folds(self.frame, window or None, self.valid_days, n_splits))
        return self.prepared[key]

    def facts_for(self, row) -> FactsCache:
        """Facts of the folds of one labelled table."""
        return self.prepared.setdefault(("facts", row["vol_window"], row["k"]), FactsCache())

    @property
    def target(self) -> str:
        if self.task == "direction":
            return "target_direction"
        return "research_move" if self.task == "move" else "research_label"


def run_stage(data: SearchData, store: ResultStore, grid: DataFrame, phase: str, parallelism: int = PARALLEL) -> DataFrame:
    """Evaluate the configurations of a grid that have no stored result; return the grid's results.

    Labels and fold tables are prepared once per distinct choice.  Independent
    configurations run side by side; results are appended as they finish, with
    their out-of-fold predictions in the store before them.
    """
    todo = missing_configs(grid, store.load()).orderBy("config_hash").collect()
    for row in todo:
        data.labels_for(row["vol_window"], row["k"])
        data.folds_for(row["train_window_days"], row["n_splits"])

    def one(row):
        frame = data.labels_for(row["vol_window"], row["k"])
        folds = data.folds_for(row["train_window_days"], row["n_splits"])
        spec = data.specs[row["model"]].seeded(row["seed"])
        classes = L.target_classes(data.target)
        features = data.groups[row["feature_set"]]
        keep = store.predictions_path(row["config_hash"])
        done = classification_cv(frame, data.target, classes, features, spec, folds, row["top_k"], parallelism=1, keep=keep, facts=data.facts_for(row))
        record = {c: row[c] for c in (*CONFIG, "config_hash")}
        record["phase"] = phase
        if done is None:
            record.update({"robust_score": -1.0, "roc_auc": -1.0, "selected_features": []})
        else:
            record.update(done.summary)
            record["selected_features"] = [done.selected[f] for f in sorted(done.selected)]
        return record

    with ThreadPoolExecutor(parallelism) as pool:
        work = inheritable_thread_target(data.frame.sparkSession)(one)
        waiting = [pool.submit(work, row) for row in todo]
        try:
            for finished in as_completed(waiting):
                store.append([finished.result()])
        except BaseException:
            for later in waiting:
                later.cancel()
            raise
    return store.load().join(grid.select("config_hash"), "config_hash", "left_semi")


@dataclass(frozen=True)
class SearchPlan:
    """Grid and promotion sizes of a coarse-to-fine search."""

    name: str = "move_search"
    windows: Sequence[int] = WINDOWS
    vol_windows: Sequence[int] = VOL_WINDOWS
    ks: Sequence[float] = KS_MOVE
    top_ks: Sequence[int] = TOP_KS
    first_vol: int = 7
    first_k: float = 0.9
    first_group: str = "all"
    scout_model: str = "extra_trees"
    confirm_models: Sequence[str] = ("extra_trees", "catboost", "lightgbm")
    scout_splits: int = 3
    confirm_splits: int = 4
    final_splits: int = 6
    keep_windows: int = 2
    keep_labels: int = 3
    keep_groups: int = 3
    start_top_k: int = 100
    seed: int = 42


THREE_CLASS_PLAN = SearchPlan(
    name="three_class_search", ks=KS_THREE, first_vol=21, first_k=0.7, scout_model="lightgbm",
    confirm_models=("random_forest", "extra_trees", "lightgbm", "catboost"), top_ks=(100,),
    scout_splits=4, confirm_splits=6, final_splits=6,
)


def coarse_to_fine(data: SearchData, store: ResultStore, plan: SearchPlan) -> dict[str, DataFrame]:
    """Window, label, family/model and top-k stages; scouts are cheap, promoted ones are confirmed."""
    spark = data.frame.sparkSession
    base = {
        "kind": [plan.name], "train_window_days": [0], "vol_window": [plan.first_vol], "k": [plan.first_k],
        "feature_set": [plan.first_group], "model": [plan.scout_model], "top_k": [plan.start_top_k],
        "n_splits": [plan.scout_splits], "seed": [plan.seed], "task": [data.task],
    }
    history: dict[str, DataFrame] = {}

    def stage(name: str, axes: dict, splits: int) -> DataFrame:
        grid = config_grid(spark, {**base, **axes, "kind": [f"{plan.name}_{name}"], "n_splits": [splits]})
        phase = "scout" if name.endswith("_scout") else "final" if name == "final" else "confirm"
        store.note(plan.name, len(history), name, phase, grid)
        done = run_stage(data, store, grid, phase)
        history[name] = done.withColumn("kind", F.lit(f"{plan.name}_{name}"))
        return history[name]

    def best(name: str, k: int, column: str) -> list:
        return [r[column] for r in promoted(history[name], k).orderBy("rank").collect()]

    stage("window_scout", {"train_window_days": list(plan.windows)}, plan.scout_splits)
    stage("window", {"train_window_days": best("window_scout", plan.keep_windows, "train_window_days")}, plan.confirm_splits)
    base["train_window_days"] = best("window", 1, "train_window_days")

    stage("label_scout", {"vol_window": list(plan.vol_windows), "k": list(plan.ks)}, plan.scout_splits)
    pairs = [(r["vol_window"], r["k"]) for r in promoted(history["label_scout"], plan.keep_labels).orderBy("rank").collect()]
    for i, (vol, k) in enumerate(pairs):
        stage(f"label_{i}", {"vol_window": [vol], "k": [k]}, plan.confirm_splits)
    history["label"] = reduce(DataFrame.unionByName, [history[f"label_{i}"] for i in range(len(pairs))])
    base["vol_window"], base["k"] = best("label", 1, "vol_window"), best("label", 1, "k")

    stage("family_scout", {"feature_set": list(data.groups)}, plan.scout_splits)
    stage(
        "family",
        {"feature_set": best("family_scout", plan.keep_groups, "feature_set"), "model": list(plan.confirm_models)},
        plan.confirm_splits,
    )
    base["feature_set"], base["model"] = best("family", 1, "feature_set"), best("family", 1, "model")

    stage("top_k", {"top_k": list(plan.top_ks)}, plan.confirm_splits)
    base["top_k"] = best("top_k", 1, "top_k")
    stage("final", {}, plan.final_splits)
    return history


def exhaustive(data: SearchData, store: ResultStore, axes: Mapping[str, Sequence]) -> DataFrame:
    """Every combination, no promotion."""
    return run_stage(data, store, config_grid(data.frame.sparkSession, axes), "full")


def lock(history: Mapping[str, DataFrame], path: str) -> DataFrame:
    """The chosen configuration, one row, persisted."""
    row = comparison_rows(promoted(history["final"], 1).drop("rank"))
    row.coalesce(1).write.mode("overwrite").json(path)
    return row


def task_comparison(data: SearchData, vol: int, k: float, group: str, models: Sequence[str], folds_k: int, window: int, top_k: int) -> DataFrame:
    """The same rows as three classes, direction and move (out of fold)."""
    spark = data.frame.sparkSession
    frame = data.labels_for(vol, k)
    rows = []
    for task, target in (("three_class", "research_label"), ("direction_binary", "target_direction"), ("move_binary", "research_move")):
        classes = L.target_classes(target)
        for m in models:
            folds = data.folds_for(window, folds_k)
            done = classification_cv(frame, target, classes, data.groups[group], data.specs[m], folds, top_k)
            if done:
                s = done.summary
                rows.append((task, m, s["accuracy"], s["balanced_accuracy"], s["macro_f1"], s["robust_score"], s["oof_rows"]))
    return small_table(spark, rows, "task string, model string, accuracy double, balanced_accuracy double, macro_f1 double, robust_score double, oof_rows bigint"
    )


def regression_comparison(data: SearchData, vol: int, k: float, group: str, specs: Sequence[ModelSpec], folds_k: int, window: int) -> DataFrame:
    spark = data.frame.sparkSession
    frame = data.labels_for(vol, k)
    rows = []
    for spec in specs:
        folds = data.folds_for(window, folds_k)
        done = regression_cv(frame, "target_return_1d", "research_threshold", data.groups[group], spec, folds)
        if done:
            s = done.summary
            rows.append((spec.name, s["mae"], s["rmse"], s["pearson"], s["sign_accuracy"], s["fold_pearson_mean"], s["oof_rows"]))
    return small_table(spark, rows, "model string, mae double, rmse double, pearson double, sign_accuracy double, fold_pearson_mean double, oof_rows bigint"
    )
