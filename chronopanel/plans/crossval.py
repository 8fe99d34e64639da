"""Out-of-fold evaluation: fold table, train-only selection, fits, metrics.

The driver holds fold dates, feature names and one summary row; rows stay in
Spark.  Independent folds are submitted from a small thread pool, as Spark's own
CrossValidator does.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from statistics import mean, pstdev

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import metrics as M
from ..operators import selection as SEL
from ..operators import splits as SP
from ..session import small_table, stored
from .models import FactsCache, ModelSpec, fit_classifier, fit_regressor, predict_classes, predict_values

KEYS = ("series_id", "date")
FEWEST = 5
#: Folds that are fitted side by side.
PARALLEL = 6


@dataclass
class Evaluation:
    predictions: DataFrame
    fold_scores: DataFrame
    summary: dict
    selected: dict[int, list[str]]


def pick_features(
    df: DataFrame, folds: DataFrame, features: Sequence[str], target: str, top_k: int, how: str = "information"
) -> dict[int, list[str]]:
    """Features per fold chosen on training rows only (fold x feature names reach the driver)."""
    features = list(features)
    if how == "coverage":
        chosen = SEL.coverage_selected(SEL.train_stats(df, folds, features)).select("fold", "feature")
    elif len(features) <= top_k:
        stats = SEL.train_stats(df, folds, features)
        chosen = stats.filter((F.col("coverage") >= 0.60) & (F.col("n_distinct") > 2)).select("fold", "feature")
    elif how == "variance":
        chosen = SEL.top_features(SEL.train_variance(df, folds, features), "variance", top_k)
    else:
        bins = 10 if how == "regression" else None
        chosen = SEL.top_features(SEL.binned_information(df, folds, features, target, target_bins=bins), "mi", top_k)
    out: dict[int, list[str]] = {}
    for r in chosen.select("fold", "feature").collect():
        out.setdefault(r["fold"], []).append(r["feature"])
    return {f: sorted(v) for f, v in out.items()}


def _sides(df: DataFrame, fold) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of one fold as plain date filters (pushed to the scan)."""
    start, end, since = (F.lit(fold[c]) for c in ("valid_start", "valid_end", "train_from"))
    train = df.filter((F.col("date") < start) & (F.col("target_end_date") < start))
    if fold["train_from"] is not None:
        train = train.filter(F.col("date") >= since)
    return train, df.filter((F.col("date") >= start) & (F.col("date") <= end))


def _rows_key(fold) -> tuple:
    """What tells the training rows of folds over one table apart."""
    return fold["valid_start"], fold["train_from"]


def _over_folds(work, folds: Sequence, parallelism: int) -> list:
    if parallelism <= 1 or len(folds) <= 1:
        return [work(f) for f in folds]
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.active())(work), folds))


def side_by_side(*calls: Callable[[], object]) -> list:
    """Results of independent calls that submit their jobs at once."""
    return _over_folds(lambda call: call(), calls, len(calls))


def classification_cv(
    df: DataFrame,
    target: str,
    classes: Sequence[int],
    features: Sequence[str],
    spec: ModelSpec,
    folds: DataFrame,
    top_k: int = 100,
    how: str = "information",
    parallelism: int = PARALLEL,
    keep: str | None = None,
    facts: FactsCache | None = None,
) -> Evaluation | None:
    """Fit per fold, predict its validation rows, pool and score; predictions are written to ``keep`` or a scratch path.

    ``facts`` is shared by evaluations of the same rows.
    """
    folds = SP.fixed(folds)
    selected = pick_features(df, folds, features, target, top_k, how)
    fewest = 2 if how == "coverage" else FEWEST
    facts = facts or FactsCache()

    def one(fold):
        chosen = selected.get(fold["fold"], [])
        if len(chosen) < min(fewest, len(features)):
            return None
        train, valid = _sides(df, fold)
        fitted = fit_classifier(train, chosen, target, spec, facts.of(_rows_key(fold), train, features, target))
        if fitted is None:
            return None
        truth = valid.select(*KEYS, F.col(target).cast("int").alias("y"))
        p = predict_classes(fitted, valid, KEYS, classes)
        return truth.join(p, list(KEYS)).withColumn("fold", F.lit(fold["fold"]))

    parts = [p for p in _over_folds(one, folds.collect(), parallelism) if p is not None]
    if not parts:
        return None
    pooled = reduce(DataFrame.unionByName, parts).withColumn("pred", A.class_of_max("p", list(classes)))
    if keep is None:
        predictions = stored(pooled, "oof")
    else:
        pooled.write.mode("overwrite").parquet(keep)
        predictions = df.sparkSession.read.schema(pooled.schema).parquet(keep)
    scores, summary = pooled_and_fold_scores(predictions, classes)
    return Evaluation(predictions, scores, summary, selected)


POOLED = 0


def pooled_and_fold_scores(predictions: DataFrame, classes: Sequence[int]) -> tuple[DataFrame, dict]:
    """Scores of every fold and of all folds together from one pass (fold 0 stands for all)."""
    both = predictions.withColumn("fold", F.explode(F.array(F.col("fold"), F.lit(POOLED))))
    scores = M.classification_scores(both, ["fold"], "y", "pred", "p", classes)
    rows = [r.asDict() for r in scores.collect()]  # one row per fold
    per_fold = small_table(
        predictions.sparkSession, [tuple(r[c] for c in scores.columns) for r in rows if r["fold"] != POOLED],
        ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scores.schema.fields),
    )
    summary = next(r for r in rows if r["fold"] == POOLED)
    f1 = [r["macro_f1"] for r in rows if r["fold"] != POOLED]
    summary["oof_rows"] = summary.pop("samples")
    del summary["fold"]
    summary["fold_macro_f1_mean"] = mean(f1)
    summary["fold_macro_f1_std"] = pstdev(f1)
    summary["fold_macro_f1_worst"] = min(f1)
    summary["robust_score"] = mean(f1) - 0.25 * pstdev(f1)
    return per_fold, summary


def regression_cv(
    df: DataFrame,
    target: str,
    threshold: str,
    features: Sequence[str],
    spec: ModelSpec,
    folds: DataFrame,
    top_k: int = 100,
    parallelism: int = PARALLEL,
    facts: FactsCache | None = None,
) -> Evaluation | None:
    folds = SP.fixed(folds)
    facts = facts or FactsCache()
    selected = pick_features(df, folds, features, target, top_k, "regression")

    def one(fold):
        chosen = selected.get(fold["fold"], [])
        if len(chosen) < min(FEWEST, len(features)):
            return None
        train, valid = _sides(df, fold)
        fitted = fit_regressor(train, chosen, target, spec, facts.of(_rows_key(fold), train, features, target, classes=False))
        truth = valid.select(*KEYS, F.col(target).alias("y"), F.col(threshold).alias("threshold"))
        return truth.join(predict_values(fitted, valid, KEYS), list(KEYS)).withColumn("fold", F.lit(fold["fold"]))

    parts = [p for p in _over_folds(one, folds.collect(), parallelism) if p is not None]
    if not parts:
        return None
    predictions = stored(reduce(DataFrame.unionByName, parts), "oof")
    fold_scores = stored(M.regression_scores(predictions, ["fold"], "y", "pred", "threshold"), "fold_scores")
    overall = M.regression_scores(predictions, [], "y", "pred", "threshold").first().asDict()
    spread = fold_scores.agg(
        F.avg("pearson").alias("fold_pearson_mean"),
        F.stddev_pop("pearson").alias("fold_pearson_std"),
        F.avg("derived_class_macro_f1").alias("fold_derived_macro_f1_mean"),
        F.stddev_pop("derived_class_macro_f1").alias("fold_derived_macro_f1_std"),
    ).first().asDict()
    return Evaluation(predictions, fold_scores, {**overall, **spread, "oof_rows": predictions.count()}, selected)
