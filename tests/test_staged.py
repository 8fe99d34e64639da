"""Staged searches: a run that is stopped goes on from the store, and its end reads stored predictions."""

import json
import os

import pytest
from pyspark.sql import functions as F

from chronopanel.bindings import learning as LN
from chronopanel.operators import metrics as M
from chronopanel.plans import search as SR
from chronopanel.plans import staged as ST
from chronopanel.session import scratch_path
from chronopanel.sources.results import ResultStore

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables are absent")
SMALL = dict(windows=(730, 0), vol_windows=(7,), ks=(0.7, 0.9), top_ks=(5, 7), scout_splits=1, confirm_splits=2, final_splits=2, keep_windows=1, keep_labels=1, keep_groups=1)
PLAN = SR.SearchPlan(**SMALL, scout_model="logistic", confirm_models=("logistic",), start_top_k=7)


class Stopped(Exception):
    pass


@pytest.fixture(scope="module")
def frame(spark):
    return LN.model_rows(spark, SF)


def data(frame, task):
    return SR.SearchData(frame, {"all": LN.FEATS, "returns": LN.FEATS[:5]}, {"logistic": LN.QUICK["logistic"].sized(5)}, task)


def counting(monkeypatch, stop_after=None):
    """Count the configurations that are fitted, and stop the run after some of them."""
    fitted, real = [], SR.classification_cv

    def fit(*args, **kwargs):
        if stop_after is not None and len(fitted) >= stop_after:
            raise Stopped
        done = real(*args, **kwargs)
        fitted.append(kwargs["keep"])
        return done

    monkeypatch.setattr(SR, "classification_cv", fit)
    return fitted


def plain(df):
    """Rows as text, numbers without the last digits that the order of summation decides."""
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())


def test_a_stopped_run_goes_on_where_it_was(spark, frame, monkeypatch):
    store = ResultStore(spark, scratch_path(spark, "stopped"))
    first = counting(monkeypatch, 4)
    with pytest.raises(Stopped):
        ST.move_research(data(frame, "move"), store, PLAN, scratch_path(spark, "lock"))
    monkeypatch.undo()
    done = {r.config_hash for r in store.load().select("config_hash").collect()}
    assert 0 < len(done) <= len(first) == 4

    second = counting(monkeypatch)
    parts = ST.move_research(data(frame, "move"), ResultStore(spark, store.path), PLAN, scratch_path(spark, "lock"))
    monkeypatch.undo()
    everything = {r.config_hash for r in store.load().select("config_hash").collect()}
    # what has a row is not fitted again, all else is, once
    assert sorted(p.rsplit("/", 1)[1] for p in second) == sorted(everything - done)

    third = counting(monkeypatch)
    again = ST.move_research(data(frame, "move"), store, PLAN, scratch_path(spark, "lock"))
    monkeypatch.undo()
    assert third == []
    for name in ("stages", "pruning", "threshold", "verification", "baselines"):
        assert plain(parts[name]) == plain(again[name]), name

    stages = parts["stages"].collect()
    assert {r.stage for r in stages} == {"window_scout", "window", "label_scout", "label_0", "family_scout", "family", "top_k", "final"}
    lock = parts["lock"].first()
    final = next(r for r in stages if r.stage == "final")
    assert (lock.k, lock.top_k, lock.model, lock.robust_score) == (final.k, final.top_k, final.model, final.robust_score)
    oof = store.predictions(final.config_hash)
    # scores of the log are those of the stored predictions
    scores = M.class_scores(oof, [], "y", "pred").first()
    assert (scores.samples, scores.macro_f1) == (final.oof_rows, pytest.approx(final.macro_f1))
    check = parts["verification"].first()
    assert check.selection_rows + check.verification_rows == oof.count()
    late = oof.join(oof.select("date").distinct().orderBy(F.desc("date")).limit(1), "date", "left_semi")
    assert late.count() > 0 and check.samples == check.verification_rows
    assert {r.baseline for r in parts["baselines"].collect()} == {"always_no_move", "previous_day_move"}
    assert lock.decision_threshold == check.decision_threshold and (lock.prospective_start - lock.reviewed_through).days == 1


def test_three_class_run(spark, frame, monkeypatch):
    plan = SR.SearchPlan(name="three", **{**SMALL, "windows": (730,), "ks": (0.7,), "top_ks": (7,)}, scout_model="logistic", confirm_models=("logistic",), start_top_k=7)
    store = ResultStore(spark, scratch_path(spark, "three"))
    fits = counting(monkeypatch)
    parts = ST.three_class_research(data(frame, "three_class"), store, plan, scratch_path(spark, "lock"), [LN.QUICK_REG["lightgbm_reg"].sized(2, 2)])
    monkeypatch.undo()
    assert len(fits) == len(set(fits)) == store.load().count()
    assert {r.task for r in parts["tasks"].collect()} == set(ST.TASKS)
    # the three-class task is a configuration of the stages: it is read, not fitted
    final = next(r for r in parts["stages"].collect() if r.stage == "top_k")
    assert next(r for r in parts["tasks"].collect() if r.task == "three_class").macro_f1 == final.macro_f1
    assert {r.baseline for r in parts["baselines"].collect()} == {"always_neutral", "previous_day_momentum"}
    often = parts["selection_frequency"].collect()
    assert all(0 < r.selection_rate <= 1 for r in often) and {r.feature for r in often} <= set(LN.FEATS)
    items = {r.item: r.choice for r in parts["lock"].collect()}
    assert set(items) == {"three_class_lock", "best_three_class", "best_direction", "best_move", "best_regression", "promoted_models"}
    assert json.loads(items["three_class_lock"])["model"] == "logistic"
    rows = ST.as_rows(parts).groupBy("part").count().collect()
    assert {r.part for r in rows} == set(parts)
