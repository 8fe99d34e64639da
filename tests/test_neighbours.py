"""Nearest-neighbour information against comparing all points with one another."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.functions.numeric import digamma
from chronopanel.operators import neighbours as NB
from chronopanel.operators import splits as SP
from chronopanel.session import small_table


def psi(n):
    """Digamma of a whole number by its harmonic sum."""
    return -0.5772156649015329 + sum(1.0 / i for i in range(1, int(n)))


def plain_class(x, y, k):
    n = {c: int((y == c).sum()) for c in set(y.tolist())}
    keep = np.array([n[c] > 1 for c in y.tolist()])
    x, y = x[keep], y[keep]
    parts = []
    for i in range(len(x)):
        near = np.sort(np.abs(np.delete(x[y == y[i]] - x[i], np.flatnonzero(np.flatnonzero(y == y[i]) == i))))
        use = min(k, len(near))
        r = np.nextafter(near[use - 1], 0)
        parts.append(psi(use) - psi(n[y[i]]) - psi(((x >= x[i] - r) & (x <= x[i] + r)).sum()))
    return max(psi(len(x)) + float(np.mean(parts)), 0.0)


def plain_value(x, v, k):
    x, v = x / x.std(), v / v.std()
    parts = []
    for i in range(len(x)):
        d = np.maximum(np.abs(x - x[i]), np.abs(v - v[i]))
        r = np.nextafter(np.sort(np.delete(d, i))[k - 1], 0)
        parts.append(psi(((x >= x[i] - r) & (x <= x[i] + r)).sum()) + psi(((v >= v[i] - r) & (v <= v[i] + r)).sum()))
    return max(psi(len(x)) + psi(k) - float(np.mean(parts)), 0.0)


def table(spark, n=240, seed=3):
    r = np.random.default_rng(seed)
    ret = r.normal(size=n)
    cols = {
        "close_to": ret + r.normal(size=n) * 0.3, "square": ret**2 + r.normal(size=n) * 0.1, "noise": r.normal(size=n),
        "steps": np.round(ret * 2 + r.normal(size=n)), "holes": np.where(r.random(n) < 0.3, np.nan, ret), "flat": np.ones(n), "rare": np.where(r.random(n) < 0.8, np.nan, ret),
    }
    label = np.where(ret > 0.8, 1, np.where(ret < -0.8, -1, 0))
    label[5] = 7  # a class of its own
    start = dt.date(2020, 1, 1)
    rows = [
        ("a", start + dt.timedelta(days=i), start + dt.timedelta(days=i + 1), int(label[i]), float(ret[i]), *[None if math.isnan(c[i]) else float(c[i]) for c in cols.values()])
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "series_id string, date date, target_end_date date, label int, ret double, " + ", ".join(f"{c} double" for c in cols))
    folds = SP.fixed(small_table(spark, [(1, start + dt.timedelta(days=n + 5), start + dt.timedelta(days=n + 9), None)], "fold int, valid_start date, valid_end date, train_from date"))
    filled = {c: np.where(np.isnan(v), np.nanmedian(v), v) for c, v in cols.items() if c not in ("flat", "rare")}
    return df, folds, list(cols), filled, label, ret


def test_digamma(spark):
    got = spark.range(1, 60).select("id", digamma("id").alias("p")).collect()
    assert all(r.p == pytest.approx(psi(r.id), abs=1e-10) for r in got)


@pytest.mark.parametrize("block_rows", [7, 60, 10_000])
def test_class_target(spark, block_rows):
    df, folds, names, filled, label, _ = table(spark)
    got = {r.feature: r.mi for r in NB.class_information(df, folds, names, "label", block_rows=block_rows).collect()}
    assert got.keys() == filled.keys()  # constant and thin features are left out
    for name, x in filled.items():
        assert got[name] == pytest.approx(plain_class(x, label, 3), abs=1e-9), name
    assert got["close_to"] > got["square"] > got["noise"]


@pytest.mark.parametrize("block_rows", [5, 50, 10_000])
def test_numeric_target(spark, block_rows):
    df, folds, names, filled, _, ret = table(spark, 200)
    got = {r.feature: r.mi for r in NB.value_information(df, folds, names, "ret", block_rows=block_rows).collect()}
    assert got.keys() == filled.keys()
    for name, x in filled.items():
        if name != "steps":
            assert got[name] == pytest.approx(plain_value(x, ret, 3), abs=1e-9), name


def test_no_rows(spark):
    df, folds, names, *_ = table(spark, 40)
    assert NB.class_information(df.limit(0), folds, names, "label").count() == 0
    assert NB.value_information(df.limit(0), folds, names, "ret").count() == 0
    assert NB.class_information(df.withColumn("label", F.lit(None).cast("int")), folds, names, "label").count() == 0
