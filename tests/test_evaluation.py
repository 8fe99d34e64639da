"""Splits, metrics, ranking helpers and decisions by hand and against brute force."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronopanel.operators import cleaning as C
from chronopanel.operators import decisions as D
from chronopanel.operators import fingerprints as FP
from chronopanel.operators import metrics as M
from chronopanel.operators import preprocess as PP
from chronopanel.operators import ranking as RK
from chronopanel.operators import splits as SP
from chronopanel.plans import research as RS
from chronopanel.plans.models import CLASSIFIERS

DAY0 = dt.date(2015, 1, 1)


@pytest.fixture(scope="module")
def days(spark):
    df = spark.range(4275).select(
        F.lit("a").alias("series_id"), F.date_add(F.lit(DAY0), F.col("id").cast("int")).alias("date"), (F.col("id") % 3 - 1).cast("int").alias("y")
    )
    return df.withColumns({"target_end_date": F.date_add("date", 1), "target_return_1d": F.lit(0.0)}).cache()


@pytest.mark.parametrize("k,rows", [(3, 540), (4, 720), (6, 1080)])
def test_rolling_fold_sizes(days, k, rows):
    audits = SP.assert_boundaries(SP.audit(days, SP.rolling_folds(days, 730, n_splits=k))).collect()
    assert sum(r["valid_rows"] for r in audits) == rows
    assert all(r["purged_rows"] == 1 for r in audits)
    assert all(r["train_last_target_end_date"] < r["valid_first_feature_date"] for r in audits)
    assert all(r["train_rows_after_purge"] == 729 for r in audits)


def test_short_history_shrinks_blocks(days):
    short = days.filter(F.col("date") < F.lit(DAY0 + dt.timedelta(days=800)))
    folds = SP.rolling_folds(short, None, n_splits=6).orderBy("fold").collect()
    assert [(f["valid_end"] - f["valid_start"]).days + 1 for f in folds] == [66] * 6


def test_expanding_and_holdout(days):
    audits = {r["fold"]: r for r in SP.audit(days, SP.expanding_folds(days, 5)).collect()}
    assert [audits[f]["valid_rows"] for f in range(1, 6)] == [712] * 5 and audits[1]["raw_train_rows"] == 4275 - 5 * 712
    hold = SP.audit(days, SP.holdout_fold(days)).first()
    assert hold["valid_rows"] == 4275 - 3420 and hold["train_rows_after_purge"] == 3419


def test_leak_is_refused(days):
    bad = days.withColumn("target_end_date", F.date_sub("date", 2))
    audits = SP.audit(bad, SP.rolling_folds(days, 730)).withColumn("train_last_target_end_date", F.col("valid_first_feature_date"))
    with pytest.raises(SP.LeakingSplit):
        SP.assert_boundaries(audits)


def test_selection_cut_648_432(days):
    oof = days.filter(F.col("date") >= F.date_sub(F.lit(DAY0 + dt.timedelta(days=4275)), 1080))
    counts = {r["part"]: r["count"] for r in SP.selection_cut(oof).groupBy("part").count().collect()}
    assert counts == {"select": 648, "verify": 432}


def test_baseline_432(spark):
    df = spark.range(432).select((F.col("id") >= 310).cast("int").alias("y"), F.lit(0).alias("pred"))
    s = M.class_scores(df, [], "y", "pred").first()
    assert round(s["accuracy"], 6) == 0.717593 and s["balanced_accuracy"] == 0.5 and round(s["macro_f1"], 6) == 0.417790


def test_class_missing_in_truth(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1), (1, 0)], "y int, pred int")
    s = M.class_scores(df, [], "y", "pred").first()
    assert s["balanced_accuracy"] == pytest.approx(0.5)
    assert s["macro_f1"] == pytest.approx((0.5 + 2 / 3 + 0) / 3)


def test_rank_metrics_against_brute_force(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 400), np.round(rng.normal(0, 1, 400), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    wins = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert M.roc_auc(df, [], "y", "s").first()["roc_auc"] == pytest.approx(wins)
    ap, prev = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        recall = (y[hit] == 1).sum() / y.sum()
        ap += (recall - prev) * (y[hit] == 1).mean()
        prev = recall
    assert M.average_precision(df, [], "y", "s").first()["pr_auc"] == pytest.approx(ap)
    one = spark.createDataFrame([(1, 0.2), (1, 0.3)], "y int, s double")
    assert M.roc_auc(one, [], "y", "s").first()["roc_auc"] is None


def test_spearman_median_and_buckets(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 500), "a": np.round(rng.normal(0, 1, 500), 2), "b": rng.normal(0, 1e-3, 500)})
    df = spark.createDataFrame(pdf)
    got = {r["k"]: r["spearman"] for r in M.spearman(df, ["k"], "a", "b").collect()}
    med = {r["k"]: r["m"] for r in RK.exact_median(df, ["k"], "a", "m").collect()}
    for k, g in pdf.groupby("k"):
        assert got[k] == pytest.approx(g["a"].rank().corr(g["b"].rank()))
        assert med[k] == pytest.approx(g["a"].median())
    values = sorted([-1e9, -3.0, -1e-12, 0.0, 1e-12, 0.5, 0.5000001, 7.0, 1e9])
    b = [r["b"] for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", RK.magnitude_bucket("v").alias("b")).orderBy("v").collect()]
    assert b == sorted(b)


def test_stratified_split_shares(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 900, "x").otherwise("z").alias("label"))
    got = {(r["label"], r["split"]): r["count"] for r in SP.stratified_split(df, "label", "id").groupBy("label", "split").count().collect()}
    assert got == {("x", "test"): 180, ("x", "train"): 720, ("z", "test"): 20, ("z", "train"): 80}


def test_grids_match_stepping():
    assert len(D.TWO_STAGE_GRID) == 15 and len(D.MOVE_GRID) == 21 and len(D.CONFIDENCE_GRID) == 10
    np.testing.assert_array_equal(D.MOVE_GRID, np.arange(0.25, 0.751, 0.025))
    np.testing.assert_array_equal(D.TWO_STAGE_GRID, np.arange(0.40, 0.76, 0.025))
    np.testing.assert_array_equal(D.CONFIDENCE_GRID, np.arange(0.35, 0.81, 0.05))


def test_threshold_scores_equal_row_expansion(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(rng.integers(0, 2, 300), rng.random(300))], "y int, s double")
    rows = {r["threshold"]: r for r in D.threshold_scores(df, [], "y", "s").collect()}
    pdf = df.toPandas()
    for t in D.MOVE_GRID:
        assert rows[round(t, 3)]["accuracy"] == pytest.approx(((pdf["s"] >= t).astype(int) == pdf["y"]).mean())


def test_keep_first_and_validation(spark):
    df = spark.createDataFrame([("2", 1, 0), ("1", 2, 1), ("2", 3, 2)], "d string, v int, o int")
    assert sorted((r["d"], r["v"]) for r in C.keep_first(df, ["d"], "o").collect()) == [("1", 2), ("2", 1)]
    ok = [("a", DAY0, DAY0 + dt.timedelta(days=1), 0.1)]
    schema = "series_id string, date date, target_end_date date, target_return_1d double"
    assert C.validated(spark.createDataFrame(ok, schema)).count() == 1
    with pytest.raises(C.InvalidPanel):
        C.validated(spark.createDataFrame(ok * 2, schema))
    with pytest.raises(C.InvalidPanel):
        C.validated(spark.createDataFrame([("a", DAY0, DAY0, 0.1)], schema))
    with pytest.raises(C.InvalidPanel):
        C.validated(spark.createDataFrame([(1,)], "x int"))


def test_class_weights_balance(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    got = {r["label"]: r["weight"] for r in PP.class_weights(df, "label").collect()}
    assert got == {0: pytest.approx(8 / 12), 1: pytest.approx(2.0)}


def test_fingerprint_ignores_order(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 2)
    a = FP.fingerprint(df).first()["digest"]
    assert a == FP.fingerprint(df.repartition(7).orderBy(F.rand(1))).first()["digest"]
    assert a != FP.fingerprint(df.filter("id < 999").unionByName(df.filter("id = 5"))).first()["digest"]


def test_canonical_text_tells_values_apart(spark):
    """Numbers are exact, nulls are no texts, and lengths keep neighbours from running together."""
    numbers = [0.0, -0.0, 1.0, -1.0, 0.1, 0.30000000000000004, 0.3, 2.0**52, 2.0**53, 1e300, 1e-300, 5e-324, 2.0**-1022, math.inf, -math.inf, math.nan, None, 1.5, 3.0, 0.75]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    texts = [r.t for r in df.select(FP.canonical(F.col("x"), T.DoubleType()).alias("t")).collect()]
    assert texts[0] == texts[1] == "0" and len(set(texts)) == len(numbers) - 1
    for x, t in zip(numbers, texts):
        if x is not None and math.isfinite(x) and x and abs(x) > 1e-307:
            mantissa, exponent = t.split("p")
            assert math.ldexp(int(mantissa), int(exponent)) == x and 2**52 <= abs(int(mantissa)) < 2**53
    print_of = lambda rows: FP.fingerprint(spark.createDataFrame(rows, "a string, b string")).first()["digest"]
    rows = [("x", "1:y"), ("x|1:y", ""), (None, "N"), ("N", None), ("", ""), (None, None)]
    assert len({print_of([r]) for r in rows}) == len(rows)
    assert print_of(rows) == print_of(rows[::-1]) != print_of(rows + rows[:1])


def test_fingerprint_digest_and_compiled_methods(spark):
    """The digest is that of the rows' texts summed word by word, and no generated method of a table like lineitem is too large for Java's compiler."""
    import contextlib
    import hashlib
    import io
    import re

    def real(x):
        if x is None or x == 0 or not math.isfinite(x):
            return "N" if x is None else "0" if x == 0 else "nan" if math.isnan(x) else "inf" if x > 0 else "-inf"
        m, e = math.frexp(abs(x))
        return f"{'-' if x < 0 else ''}{int(m * 2**53)}p{e - 53}"

    odd = [0.0, -0.0, 1.0, -0.1, 7.5e-310, 5e-324, 1.7976931348623157e308, math.inf, -math.inf, math.nan, None, 2.0**53 - 1, math.nextafter(8.0, 0.0)]
    rows = [(i, x, None if x is None else -x, 1.5 * i, 0.04, f"t{i}", [x, float(i)], [[x], None]) for i, x in enumerate(odd)]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, d double, t string, u array<double>, w array<array<double>>")
    lists = lambda xs: f"[{','.join(map(real, xs))}]"
    texts = [f"{i}|{real(a)}|{real(b)}|{real(c)}|{real(d)}|{len(t)}:{t}|{lists(u)}|[{lists(w[0])},N]" for i, a, b, c, d, t, u, w in rows]
    # columns by name
    texts = ["|".join([*x[1:5], x[0], *x[5:]]) for x in (y.split("|") for y in texts)]
    words = [sum(int(hashlib.md5(x.encode()).hexdigest()[8 * k : 8 * k + 8], 16) for x in texts) for k in range(4)]
    schema = "a:real,b:real,c:real,d:real,i:int,t:text,u:list of real,w:list of list of real"
    got = FP.fingerprint(df).first()
    assert (got["rows"], got["digest"]) == (len(rows), hashlib.sha256("|".join(map(str, [schema, len(rows), *words])).encode()).hexdigest())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            FP.fingerprint(df.drop("u", "w")).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", plan.getvalue())]
    assert sizes and max(sizes) < 8000


def test_regression_selection_ignores_validation_targets(spark):
    """Target quantiles come from a fold's training rows: other validation targets choose the same features."""
    import datetime as dt
    import random

    from chronopanel.plans.crossval import pick_features

    r = random.Random(1)
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    rows = [("s", day(i), day(i + 1), *(r.random() for _ in range(6))) for i in range(400)]
    rows = [(*row, row[3] + 0.1 * r.random()) for row in rows]
    names = [f"f{i}" for i in range(6)]
    schema = "series_id string, date date, target_end_date date, " + ", ".join(f"{n} double" for n in names) + ", y double"
    df = spark.createDataFrame(rows, schema)
    folds = SP.fixed(SP.expanding_folds(df, 2))
    first = {f["fold"]: f for f in folds.collect()}
    start = min(v for k, v in first[max(first)].asDict().items() if k.startswith("valid") and isinstance(v, dt.date))
    other = df.withColumn("y", F.when(F.col("date") >= F.lit(start), F.lit(1e6) - F.col("y")).otherwise(F.col("y")))
    chosen = pick_features(df, folds, names, "y", 2, "regression")
    assert chosen == pick_features(other, folds, names, "y", 2, "regression") and all("f0" in v for v in chosen.values())


def test_two_stage_without_direction_models(spark):
    rows = [(f"s{i % 2}", dt.date(2020, 1, 1) + dt.timedelta(i // 2), float(i % 7), float(i % 5), i % 2) for i in range(800)]
    df = spark.createDataFrame(rows, "series_id string, date date, a double, b double, target_move_dynamic int").withColumns(
        {"target_end_date": F.date_add("date", 1), "label_dynamic": F.col("target_move_dynamic"), "target_direction": F.lit(1)}
    )
    # every move goes up, so no direction model can be fitted in any fold
    assert RS.two_stage(df, ["a", "b"], [CLASSIFIERS["logistic"].sized(3)], 2) == {}


def test_queries_use_catalogued_forests_and_logistic_models():
    from chronopanel.bindings import learning
    from chronopanel.plans.models import CLASSIFIERS, REGRESSORS

    for used, catalogue in ((learning.QUICK, CLASSIFIERS), (learning.QUICK_REG, REGRESSORS)):
        assert all(used[n] == s for n, s in catalogue.items() if not s.family.startswith("boost"))
