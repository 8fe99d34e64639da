"""Estimators over DataFrames: Spark ML for linear models and forests, ``trees`` for what Spark ML lacks."""

from __future__ import annotations

import json
import math
import threading
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators.ranking import exact_median
from ..operators.selection import long_features
from ..session import small_table
from . import trees as TR

#: Training rows to a task: fits over few rows run side by side rather than each over many tasks.
TASK_ROWS = 20_000
SEED = 42


@dataclass(frozen=True)
class ModelSpec:
    """One estimator choice; ``size`` is trees or iterations."""

    name: str
    family: str
    size: int = 100
    depth: int = 5
    min_leaf: int = 1
    step: float = 0.05
    c: float = 0.3
    flags: bool = True
    balanced: bool = True
    leaves: int = 15
    l1: float = 0.0
    l2: float = 0.0
    columns: float = 1.0
    seed: int = SEED

    def seeded(self, seed: int) -> "ModelSpec":
        return replace(self, seed=seed)

    def sized(self, size: int, depth: int | None = None) -> "ModelSpec":
        return replace(self, size=size, depth=min(self.depth, depth) if depth else self.depth)


# Estimator settings; boosted trees grow by leaves, six levels at most.
CLASSIFIERS = {
    s.name: s
    for s in (
        ModelSpec("logistic", "logistic", size=4000, c=0.3),
        ModelSpec("random_forest", "forest", size=450, depth=9, min_leaf=6),
        ModelSpec("extra_trees", "extra", size=550, depth=10, min_leaf=5),
        ModelSpec("hist_gradient_boosting", "boost", size=300, depth=6, min_leaf=20, step=0.04, l2=3.0, flags=False, balanced=False),
        ModelSpec("lightgbm", "boost", size=500, depth=6, min_leaf=25, step=0.025, l1=0.5, l2=2.0, columns=0.8),
        ModelSpec("catboost", "boost", size=450, depth=6, step=0.035, leaves=64, l2=3.0),
    )
}
REGRESSORS = {
    s.name: s
    for s in (
        ModelSpec("random_forest_reg", "forest_reg", size=500, depth=9, min_leaf=6),
        ModelSpec("extra_trees_reg", "extra_reg", size=600, depth=10, min_leaf=5),
        ModelSpec("hist_gradient_reg", "boost_reg", size=300, depth=6, min_leaf=20, step=0.04, l2=3.0, flags=False),
        ModelSpec("lightgbm_reg", "boost_reg", size=500, depth=6, min_leaf=25, step=0.025, l1=0.5, l2=2.0, columns=0.8),
        ModelSpec("catboost_reg", "boost_reg", size=450, depth=6, step=0.035, leaves=64, l2=3.0),
    )
}


@dataclass
class Facts:
    """What fits need to know of training rows: rows by class, medians, and which features have missing values."""

    counts: dict[int, int]
    medians: dict[str, float]
    missing: list[str]

    @property
    def rows(self) -> int:
        return sum(self.counts.values())


def facts_of(train: DataFrame, features: Sequence[str], target: str, classes: bool = True) -> Facts:
    """Facts of the rows with a known target, for all candidate features at once: any choice of them reads the same ones.

    Medians are exact and lie between the two middle values; a feature without values has 0.
    """
    features = list(features)
    y = F.col(target).cast("int") if classes else F.lit(0)
    known = train.filter(F.col(target).isNotNull())
    tallies = known.groupBy(y.alias("__y")).agg(F.count(F.lit(1)).alias("__n"), *[F.count(f).alias(f) for f in features])
    rows = [r.asDict() for r in tallies.collect()]  # one row per class
    total = sum(r["__n"] for r in rows)
    long = long_features(known, [], features)
    medians = {r["feature"]: r["mid"] for r in exact_median(long, ["feature"], "value", "mid").collect()}  # one row per feature
    missing = [f for f in features if sum(r[f] for r in rows) < total]
    return Facts({r["__y"]: r["__n"] for r in rows}, {f: float(medians.get(f) or 0.0) for f in features}, missing)


class FactsCache:
    """Facts by training rows, so that models, seeds and feature choices over the same rows share them."""

    def __init__(self):
        self.known: dict[tuple, Facts] = {}
        self.locks: dict[tuple, threading.Lock] = {}

    def of(self, key: tuple, train: DataFrame, features: Sequence[str], target: str, classes: bool = True) -> Facts:
        key = (*key, target, classes, tuple(sorted(features)))
        with self.locks.setdefault(key, threading.Lock()):
            if key not in self.known:
                self.known[key] = facts_of(train, features, target, classes)
            return self.known[key]


@dataclass
class Fitted:
    """Preparation and a fitted estimator."""

    spec: ModelSpec
    features: list[str]
    prepare: PipelineModel
    model: object
    classes: list[int] = field(default_factory=list)

    def save(self, spark: SparkSession, path: str) -> None:
        self.prepare.write().overwrite().save(f"{path}/prepare")
        if isinstance(self.model, TR.TreeModel):
            self.model.save(spark, f"{path}/trees")
        else:
            PipelineModel(stages=[self.model]).write().overwrite().save(f"{path}/stages")
        whole = json.dumps({"spec": asdict(self.spec), "features": self.features, "classes": self.classes})
        small_table(spark, [(whole,)], "fitted string").coalesce(1).write.mode("overwrite").parquet(f"{path}/fitted")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Fitted":
        whole = json.loads(spark.read.parquet(f"{path}/fitted").first()["fitted"])
        spec = ModelSpec(**whole["spec"])
        grown = spec.family.startswith(("extra", "boost"))
        model = TR.TreeModel.load(spark, f"{path}/trees") if grown else PipelineModel.load(f"{path}/stages")
        return cls(spec, whole["features"], PipelineModel.load(f"{path}/prepare"), model, whole["classes"])


def preparation(train: DataFrame, features: Sequence[str], facts: Facts, flags: bool, scale: bool) -> PipelineModel:
    """Median imputation, missing flags and (for linear models) scaling by training rows."""
    features = list(features)
    flagged = [f for f in features if f in facts.missing] if flags else []
    filled = [f"coalesce(CAST(`{f}` AS DOUBLE), CAST('{facts.medians[f]!r}' AS DOUBLE)) AS `{f}__in`" for f in features]
    marks = [f"CAST(`{f}` IS NULL AS DOUBLE) AS `{f}__na`" for f in flagged]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(filled + marks)} FROM __THIS__")]
    inputs = [f"{f}__in" for f in features] + [f"{f}__na" for f in flagged]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="raw_vector" if scale else "features_vector"))
    if scale:
        stages.append(StandardScaler(inputCol="raw_vector", outputCol="features_vector", withMean=True, withStd=True))
    return Pipeline(stages=stages).fit(train)


def _estimated(spec: ModelSpec, ready: DataFrame, facts: Facts, classes: int, width: int):
    """Fit on rows of features_vector, label_index and weight; ``classes`` 0 means a numeric target."""
    ready = ready.coalesce(1 + facts.rows // TASK_ROWS)
    if spec.family.startswith(("extra", "boost")):
        rows = ready.select(vector_to_array("features_vector").alias("x"), F.col("label_index").alias("y"), F.col("weight").alias("w"))
        if spec.family.startswith("extra"):
            per_split = max(1, math.isqrt(width)) if classes else width
            grown = TR.grow_extra(rows, width, classes, spec.size, spec.depth, spec.min_leaf, spec.seed, per_split)
            return TR.TreeModel(grown, "mean", np.zeros(classes or 1))
        how = TR.Boosting(spec.size, spec.step, spec.depth, spec.leaves, spec.min_leaf, spec.l1, spec.l2, spec.columns, spec.seed)
        grown, base = TR.grow_boosted(rows, width, classes, how)
        return TR.TreeModel(grown, {0: "sum", 2: "logistic"}.get(classes, "softmax"), base)
    common = {"featuresCol": "features_vector", "labelCol": "label_index"}
    ready = ready.cache()
    try:
        if spec.family == "logistic":
            return LogisticRegression(
                **common, weightCol="weight", family="multinomial", maxIter=spec.size, regParam=1.0 / (spec.c * max(facts.rows, 1)),
                elasticNetParam=0.0, standardization=False,
            ).fit(ready)
        forest = {"numTrees": spec.size, "maxDepth": spec.depth, "minInstancesPerNode": spec.min_leaf, "seed": spec.seed}
        if classes:
            return RandomForestClassifier(**common, **forest, weightCol="weight", featureSubsetStrategy="sqrt").fit(ready)
        return RandomForestRegressor(**common, **forest, featureSubsetStrategy="all").fit(ready)
    finally:
        ready.unpersist()


def fit_classifier(train: DataFrame, features: Sequence[str], target: str, spec: ModelSpec, facts: Facts | None = None) -> Fitted | None:
    """Fit on training rows, with balanced weights where the learner asks for them; None when only one class occurs."""
    facts = facts or facts_of(train, features, target)
    have = sorted(facts.counts)
    if len(have) < 2:
        return None
    known = train.select(*features, F.col(target).cast("int").alias("__y")).filter(F.col("__y").isNotNull())
    prepare = preparation(known, features, facts, spec.flags, spec.family == "logistic")
    place = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.array_position(F.array(*[F.lit(c) for c in have]), F.col("__y")).cast("int") - 1)
    weights = [facts.rows / (len(have) * facts.counts[c]) if spec.balanced else 1.0 for c in have]
    ready = prepare.transform(known).select("features_vector", place([float(i) for i in range(len(have))]).alias("label_index"), place(weights).alias("weight"))
    model = _estimated(spec, ready, facts, len(have), _width(features, facts, spec))
    return Fitted(spec, list(features), prepare, model, have)


def _width(features: Sequence[str], facts: Facts, spec: ModelSpec) -> int:
    return len(features) + (sum(f in facts.missing for f in features) if spec.flags else 0)


def predict_classes(fitted: Fitted, rows: DataFrame, keys: Sequence[str], classes: Sequence[int]) -> DataFrame:
    """``keys`` and ``p``, a probability per entry of ``classes``."""
    ready = fitted.prepare.transform(rows.select(*keys, *fitted.features)).select(*keys, "features_vector")
    if isinstance(fitted.model, TR.TreeModel):
        scored = fitted.model.transform(ready.withColumn("x", vector_to_array("features_vector")), "x", "__p")
    else:
        scored = fitted.model.transform(ready).withColumn("__p", vector_to_array("probability"))
    return scored.select(*keys, A.align_classes("__p", fitted.classes, list(classes)).alias("p"))


def fit_regressor(train: DataFrame, features: Sequence[str], target: str, spec: ModelSpec, facts: Facts | None = None) -> Fitted:
    facts = facts or facts_of(train, features, target, classes=False)
    known = train.select(*features, F.col(target).cast("double").alias("label_index")).na.drop(subset=["label_index"])
    prepare = preparation(known, features, facts, spec.flags, False)
    ready = prepare.transform(known).select("features_vector", "label_index", F.lit(1.0).alias("weight"))
    return Fitted(spec, list(features), prepare, _estimated(spec, ready, facts, 0, _width(features, facts, spec)))


def predict_values(fitted: Fitted, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    ready = fitted.prepare.transform(rows.select(*keys, *fitted.features)).select(*keys, "features_vector")
    if isinstance(fitted.model, TR.TreeModel):
        scored = fitted.model.transform(ready.withColumn("x", vector_to_array("features_vector")), "x", "__p")
        return scored.select(*keys, F.get("__p", F.lit(0)).alias("pred"))
    return fitted.model.transform(ready).select(*keys, F.col("prediction").alias("pred"))
