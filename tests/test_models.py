"""Fits over shared facts, exact medians, and models that come back from the registry."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import splits as SP
from chronopanel.plans import crossval as CV
from chronopanel.plans import models as MD
from chronopanel.plans import research as RS
from chronopanel.plans.registry import ModelRegistry
from chronopanel.session import scratch_path, small_table

FEATS = ["a", "b", "c", "d", "e"]
SMALL = {n: s.sized(6, 4) if s.family != "logistic" else s.sized(30) for n, s in MD.CLASSIFIERS.items()}


@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(1)
    rows, start = [], dt.date(2018, 1, 1)
    for i in range(700):
        x = r.normal(size=5)
        y = int(np.sign(x[0] + 0.3 * r.normal())) if abs(x[0]) > 0.5 else 0
        x = [None if j == 1 and i % 9 == 0 else float(v) for j, v in enumerate(x)]
        rows.append(("s", start + dt.timedelta(days=i), start + dt.timedelta(days=i + 1), y, int(y != 0), int(y > 0), float(x[0]), *x))
    schema = "series_id string, date date, target_end_date date, label_dynamic int, target_move_dynamic int, target_direction int, ret double, " + ", ".join(f"{f} double" for f in FEATS)
    return spark.createDataFrame(rows, schema)


def folds(panel, k=2):
    return SP.fixed(SP.rolling_folds(panel, None, 60, k))


def test_facts(spark):
    rows = [(1, 1.0, None), (1, 4.0, 2.0), (0, 2.0, 9.0), (0, 10.0, 4.0), (None, 99.0, 99.0)]
    facts = MD.facts_of(spark.createDataFrame(rows, "y int, a double, b double"), ["a", "b"], "y")
    assert facts == MD.Facts({0: 2, 1: 2}, {"a": 3.0, "b": 4.0}, ["b"])
    empty = MD.facts_of(spark.createDataFrame([], "y int, a double"), ["a"], "y")
    assert empty.counts == {} and empty.medians == {"a": 0.0}


def test_facts_are_worked_out_once(panel, monkeypatch):
    """Two models, two feature choices and two seeds over the same two folds share their medians and weights."""
    asked, real = [], MD.facts_of
    monkeypatch.setattr(MD, "facts_of", lambda *a, **k: asked.append(1) or real(*a, **k))
    cache, table = MD.FactsCache(), folds(panel)
    for spec in (SMALL["logistic"], SMALL["logistic"].seeded(7), SMALL["lightgbm"]):
        for top_k in (5, 4):
            assert CV.classification_cv(panel, "label_dynamic", [-1, 0, 1], FEATS, spec, table, top_k, facts=cache) is not None or top_k == 4
    assert len(asked) == 2


@pytest.mark.parametrize("name", sorted(SMALL))
def test_models_learn_and_come_back(spark, panel, name):
    train, test = panel.filter("date < '2019-07-01'"), panel.filter("date >= '2019-07-01'")
    for target, classes in (("label_dynamic", [-1, 0, 1]), ("target_move_dynamic", [0, 1])):
        spec = SMALL[name].sized(12, 4)
        fitted = MD.fit_classifier(train, FEATS, target, MD.replace(spec, step=0.3) if spec.family == "boost" else spec)
        registry = ModelRegistry(spark, scratch_path(spark, "registry"))
        assert [registry.publish("h", fitted, {"target": target}) for _ in range(2)] == [1, 2]
        loaded, card = registry.load("h")
        first, _ = registry.load("h", 1)
        assert card == {"target": target} and first.features == FEATS and loaded.classes == classes
        p = {r.date: r.p for r in MD.predict_classes(fitted, test, CV.KEYS, classes).collect()}
        assert p == {r.date: r.p for r in MD.predict_classes(loaded, test, CV.KEYS, classes).collect()}
        truth = {r.date: r[target] for r in test.collect()}
        hits = np.mean([classes[int(np.argmax(v))] == truth[d] for d, v in p.items()])
        common = max(list(truth.values()).count(c) for c in classes) / len(truth)
        assert all(abs(sum(v) - 1) < 1e-9 for v in p.values())
        if (name, target) != ("logistic", "target_move_dynamic"):  # moves are no linear matter
            assert hits > common + 0.05
    with pytest.raises(KeyError):
        registry.load("other")
    assert registry.latest().count() == 1


@pytest.mark.parametrize("name", sorted(MD.REGRESSORS))
def test_regressors(panel, name):
    train, test = panel.filter("date < '2019-07-01'"), panel.filter("date >= '2019-07-01'")
    spec = MD.REGRESSORS[name].sized(12, 4)
    spec = MD.replace(spec, step=0.3) if spec.family == "boost_reg" else spec
    fitted = MD.fit_regressor(train, FEATS, "ret", spec)
    got = MD.predict_values(fitted, test, CV.KEYS).join(test.select("date", "ret"), "date")
    error, spread = got.agg(F.avg((F.col("pred") - F.col("ret")) ** 2), F.var_pop("ret")).first()
    assert error < 0.35 * spread


def test_research_plans(spark, panel):
    specs = [SMALL["logistic"], SMALL["extra_trees"]]
    parts = RS.evaluate_task(panel, "label_dynamic", {"all": FEATS, "few": FEATS[:4]}, specs, 2, 2, scratch_path(spark, "best"))
    assert parts["comparison"].count() == 4
    assert {r.member: r.samples for r in parts["holdout"].collect()} == {"best": 140, "ensemble": 140}
    staged = RS.two_stage(panel, FEATS, [SMALL["logistic"]], 2)
    card = {r.task: r for r in RS.scorecard({"three_class": parts}, staged).collect()}
    assert set(card) == {"three_class", "two_stage"} and card["three_class"].best_oof_macro_f1 == max(r.macro_f1 for r in parts["comparison"].collect())
    stable = RS.seed_stability(panel, "target_move_dynamic", FEATS, SMALL["extra_trees"], folds(panel), (1, 2, 1))
    scores = [r.macro_f1 for r in stable.collect()]
    assert scores[0] == scores[2] and len(scores) == 3
    analysed = RS.post_analysis(panel.withColumns({"rank": F.abs("b") % 1, "trend": F.col("c")}), "label_dynamic", FEATS, specs, folds(panel), "rank", "trend", (3, 4))
    assert analysed["seeds"].count() == 2 and analysed["ensemble"].first().samples == analysed["predictions"].count()
    assert analysed["ensemble"].first().ensemble_improved in (True, False)


def test_one_class_cannot_be_fitted(spark, panel):
    assert MD.fit_classifier(panel.withColumn("label_dynamic", F.lit(1)), FEATS, "label_dynamic", SMALL["logistic"]) is None
    empty = small_table(spark, [], "label_dynamic int, " + ", ".join(f"{f} double" for f in FEATS))
    assert MD.fit_classifier(empty, FEATS, "label_dynamic", SMALL["extra_trees"]) is None
