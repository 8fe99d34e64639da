"""Rolling features, exponential means and layouts against pandas and by hand."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronopanel.functions import rolling as R
from chronopanel.functions.rolling import SeriesWindow
from chronopanel.operators import ewm as E
from chronopanel.operators import external as X
from chronopanel.operators import labels as L
from chronopanel.operators import panel as PN
from chronopanel.operators import price as P
from chronopanel.operators import scan as SC
from chronopanel.operators import technical as TA

W = SeriesWindow()
DAY0 = dt.date(2020, 1, 1)


def walk(n=420, series=("a", "b"), seed=7, holes=0.0):
    """A random-walk panel; optional missing closes."""
    rng = np.random.default_rng(seed)
    parts = []
    for s in series:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
        frame = pd.DataFrame(
            {
                "series_id": s, "date": [DAY0 + dt.timedelta(days=i) for i in range(n)], "open": close * (1 + rng.normal(0, 0.01, n)),
                "close": close, "volume": rng.integers(10, 1000, n).astype(float),
            }
        )
        frame["high"] = frame[["open", "close"]].max(axis=1) * 1.01
        frame["low"] = frame[["open", "close"]].min(axis=1) * 0.99
        if holes:
            frame.loc[rng.random(n) < holes, "close"] = np.nan
        parts.append(frame)
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def result(df, *cols):
    return df.select("series_id", "date", *cols).toPandas().sort_values(["series_id", "date"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def pdf():
    return walk()


@pytest.fixture(scope="module")
def panel(spark, pdf):
    return to_spark(spark, pdf).cache()


def per_series(pdf, fn):
    return pd.concat([fn(g.reset_index(drop=True)) for _, g in pdf.groupby("series_id")], ignore_index=True)


def test_rolling_matches_pandas(panel, pdf):
    got = result(P.rolling_levels(P.rolling_moments(P.base_columns(panel, W), W), W), *[
        f"{p}_{n}d" for n in P.ROLL_WINDOWS for p in ("return_mean", "volatility", "downside_vol", "return_skew", "price_z", "volume_z", "range_mean")
    ])

    def want(g):
        r = g["close"].pct_change(fill_method=None)
        lv, rl = np.log1p(g["volume"]), np.log(g["high"] / g["low"])
        out = {}
        for n in P.ROLL_WINDOWS:
            m = max(3, n // 2)
            roll = r.rolling(n, min_periods=m)
            out[f"return_mean_{n}d"], out[f"volatility_{n}d"] = roll.mean(), roll.std()
            out[f"downside_vol_{n}d"] = np.sqrt((r.clip(upper=0) ** 2).rolling(n, min_periods=m).mean())
            out[f"return_skew_{n}d"] = roll.skew()
            c, v = g["close"].rolling(n, min_periods=m), lv.rolling(n, min_periods=m)
            out[f"price_z_{n}d"] = (g["close"] - c.mean()) / c.std()
            out[f"volume_z_{n}d"] = (lv - v.mean()) / v.std()
            out[f"range_mean_{n}d"] = rl.rolling(n, min_periods=m).mean()
        return pd.DataFrame(out)

    expected = per_series(pdf, want)
    for c in expected:
        np.testing.assert_allclose(got[c].astype(float), expected[c], rtol=1e-7, atol=1e-9, err_msg=c)


def test_long_windows_with_missing_values_and_flat_stretches(spark):
    pdf = walk(300, ("a",), holes=0.2)
    pdf.loc[100:220, "close"] = 50.0
    f = R.Frames(W)
    cols = {"m": f.mean("close", 60, 10), "s": f.std("close", 60, 10), "k": f.skew("close", 60, 10), "hi": f.part("max", "close", 60)}
    got = result(f.add(to_spark(spark, pdf), cols), "m", "s", "k", "hi")
    roll = pdf["close"].rolling(60, min_periods=10)
    np.testing.assert_allclose(got["m"].astype(float), roll.mean(), rtol=1e-10)
    np.testing.assert_allclose(got["s"].astype(float), roll.std(), rtol=1e-7, atol=1e-9)
    np.testing.assert_allclose(got["k"].astype(float), roll.skew(), rtol=1e-6, atol=1e-7)
    assert (got["s"][165:215] == 0).all() and (got["k"][165:215] == 0).all()


@pytest.mark.parametrize("holes", [0.0, 0.15])
def test_ewm_matches_pandas_through_gaps(spark, holes):
    pdf = walk(1500, ("a", "b"), holes=holes)
    spans = (3, 7, 60, 180)
    got = result(E.ewm(to_spark(spark, pdf), "close", {f"e{s}": E.span_alpha(s) for s in spans}, W), *[f"e{s}" for s in spans])
    want = per_series(pdf, lambda g: pd.DataFrame({f"e{s}": g["close"].ewm(span=s, adjust=False).mean() for s in spans}))
    for c in want:
        np.testing.assert_allclose(got[c].astype(float), want[c], rtol=1e-11, err_msg=c)


def test_ewm_gap_fixture(spark):
    rows = [("a", DAY0 + dt.timedelta(days=i), v) for i, v in enumerate([1.0, 2.0, None, None, 5.0, 6.0])]
    df = spark.createDataFrame(rows, "series_id string, date date, close double")
    got = [r["e"] for r in E.ewm(df, "close", {"e": E.span_alpha(3)}, W).orderBy("date").collect()]
    assert got == pytest.approx([1, 1.5, 1.5, 1.5, 4.3, 5.15])


def test_rank_ties(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 2.0, 2.0, 3.0])], "series_id string, date int, v double")
    got = [r["p"] for r in df.select("date", R.percentile_rank("v", 4, 2, W).alias("p")).orderBy("date").collect()]
    assert got == [None, pytest.approx(1.0), pytest.approx(2.5 / 3), pytest.approx(1.0)]


def test_constant_and_zero_prices(spark):
    rows = [("flat", DAY0 + dt.timedelta(days=i), 5.0, 5.0, 5.0, 5.0, 1.0) for i in range(40)]
    rows += [("zero", DAY0 + dt.timedelta(days=i), 5.0, 6.0, 4.0, 0.0 if i == 3 else 5.0 + i % 2, 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "series_id string, date date, open double, high double, low double, close double, volume double")
    out = P.price_features(df, W)
    flat = out.filter("series_id = 'flat'").orderBy("date").collect()[-1]
    assert flat["volatility_14d"] == 0 and flat["return_skew_30d"] == 0
    assert flat["price_z_14d"] is None and flat["price_volume_corr_30d"] is None and flat["rsi_14"] is None and flat["range_position_30d"] is None
    after = out.filter("series_id = 'zero'").orderBy("date").collect()[4]
    assert after["return_1d"] is None and after["log_return_1d"] is None


@pytest.mark.parametrize("block_rows", [220, 300])
def test_blocks_equal_whole_series(panel, block_rows):
    names = ["volatility_30d", "price_z_180d", "ema_gap_7d", "target_return_1d"]

    def compute(df, w):
        df = P.rolling_levels(P.rolling_moments(P.base_columns(df, w), w, (30,)), w, (180,))
        return L.forward_target(P.ema_gaps(df, w, (7,)), w)

    whole = result(compute(panel, W), *names)
    cut = result(PN.in_blocks(panel, compute, W, F.trunc("date", "month"), 200, 1, block_rows), *names)
    pd.testing.assert_frame_equal(whole, cut, rtol=1e-9, atol=1e-12)
    with pytest.raises(ValueError):
        PN.in_blocks(panel, compute, W, F.trunc("date", "month"), 200, 1, 100)
    with pytest.raises(ValueError, match="so_far"):
        PN.in_blocks(panel, compute, W, F.trunc("date", "month"), None)


def test_running_totals_equal_whole_series(panel):
    rows = panel.withColumn("some", F.when(F.dayofmonth("date") % 7 == 3, F.col("volume")))
    whole = result(rows.withColumns({"total": F.sum("some").over(W.so_far), "known": F.last("some", True).over(W.so_far)}), "total", "known")
    cut = result(PN.so_far(rows, ["series_id"], "date", F.trunc("date", "month"), {"total": "some"}, {"known": "some"}), "total", "known")
    pd.testing.assert_frame_equal(whole, cut, rtol=1e-9)
    assert whole["total"].isna().any() and whole["known"].notna().any()


@pytest.mark.parametrize("block_rows", [1, 7, 64, 10_000])
def test_scan_equals_whole_series(panel, block_rows):
    """Seeded and unseeded means and totals with gaps, however the rows are cut."""
    rows = panel.withColumns(
        {"some": F.when(F.dayofmonth("date") % 7 != 3, F.col("close")), "rare": F.when(F.dayofmonth("date") == 9, F.col("close")), "never": F.lit(None).cast("double")}
    )
    whole = E.ewm(rows, "some", {"slow": 0.01, "fast": 0.9}, W)
    whole = E.ewm(E.ewm(whole, "some", {"seeded": 0.1}, W, seed_rows=14), "rare", {"rarely": 0.3}, W, seed_rows=3)
    whole = E.ewm(whole, "never", {"none": 0.3}, W).withColumn("total", F.sum("some").over(W.so_far))
    items = {
        "slow": SC.Mean("some", 0.01), "fast": SC.Mean("some", 0.9), "seeded": SC.Mean("some", 0.1, 14), "rarely": SC.Mean("rare", 0.3, 3),
        "none": SC.Mean("never", 0.3), "total": SC.Total("some"),
    }
    placed = PN.in_blocks(rows, lambda d, w: d, W, F.trunc("date", "month"), 0, block_rows=block_rows, keep_place=True)
    cut = SC.scan(placed, items, W)
    names = list(items)
    pd.testing.assert_frame_equal(result(whole, *names), result(cut, *names), rtol=1e-10, atol=1e-12)


def test_scan_of_null_keys_and_no_rows(spark):
    rows = spark.createDataFrame([(None, 1, 2.0), (None, 2, 4.0), ("a", 1, 1.0)], "series_id string, date int, close double")
    w = SeriesWindow(("series_id",), "date")
    placed = lambda d: PN.in_blocks(d, lambda x, _: x, w, F.col("date"), 0, block_rows=1, keep_place=True)
    out = SC.scan(placed(rows), {"m": SC.Mean("close", 0.5), "t": SC.Total("close")}, w).collect()
    assert {(r.series_id, r.date): (r.m, r.t) for r in out} == {(None, 1): (2.0, 2.0), (None, 2): (3.0, 6.0), ("a", 1): (1.0, 1.0)}
    assert SC.scan(placed(rows.limit(0)), {"m": SC.Mean("close", 0.5)}, w).count() == 0


def test_indicators_and_features_of_blocks_equal_whole_series(panel):
    month = F.trunc("date", "month")
    names = [n for n in TA.INDICATORS]
    pd.testing.assert_frame_equal(
        result(TA.indicators(panel, W), *names), result(TA.indicators_of_fine_panel(panel, W, month, 60), *names), rtol=1e-8, atol=1e-9
    )
    names = ["ema_gap_180d", "macd_signal_pct", "vol_regime_pctile", "rsi_14", "return_skew_90d", "bb_width"]
    pd.testing.assert_frame_equal(
        result(P.price_features(panel, W), *names), result(P.features_of_fine_panel(panel, W, month, 400), *names), rtol=1e-8, atol=1e-9
    )


def test_prefix_invariance(panel):
    """Features at t do not change when later rows exist."""
    names = [n for n in P.feature_names() if n != "vol_regime_pctile"] + ["vol_regime_pctile"]
    cut = DAY0 + dt.timedelta(days=250)
    full = P.price_features(panel, W).filter(F.col("date") <= F.lit(cut))
    part = P.price_features(panel.filter(F.col("date") <= F.lit(cut)), W)
    a, b = result(full, *names), result(part, *names)
    pd.testing.assert_frame_equal(a, b, rtol=1e-9, atol=1e-11)


def test_permutation(panel):
    a = result(P.rolling_moments(P.base_columns(panel, W), W, (30,)), "volatility_30d")
    b = result(P.rolling_moments(P.base_columns(panel.repartition(5).orderBy(F.rand(3)), W), W, (30,)), "volatility_30d")
    pd.testing.assert_frame_equal(a, b)


def test_feature_count():
    assert len(P.feature_names()) == 122 and len(set(P.feature_names())) == 122
    assert len(TA.INDICATORS) == 18


def test_one_exchange_per_family(panel):
    plan = P.rolling_moments(P.base_columns(panel, W), W)._jdf.queryExecution().sparkPlan().toString()
    executed = P.rolling_moments(P.base_columns(panel, W), W)._jdf.queryExecution().executedPlan().toString()
    assert executed.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1, plan


def test_indicators_produce_all_columns(panel):
    out = TA.indicators(panel, W)
    assert set(TA.INDICATORS) <= set(out.columns)


def test_labels_with_unknowns_are_zero(spark):
    rows = [("a", 1, None, 0.1), ("a", 2, 0.2, None), ("a", 3, 0.1, 0.1), ("a", 4, -0.1, 0.1), ("a", 5, 0.11, 0.1), ("a", 6, -0.11, 0.1)]
    df = spark.createDataFrame(rows, "series_id string, date int, ret double, thr double")
    got = [r["l"] for r in df.select("date", L.three_way("ret", F.col("thr")).alias("l")).orderBy("date").collect()]
    assert got == [0, 0, 0, 0, 1, -1]


def test_staleness_and_lag(spark):
    seen = {0: 10.0, 1: 11.0, 4: 12.0, 5: 12.0, 8: 15.0, 9: 15.0}
    rows = [("a", DAY0 + dt.timedelta(days=i), seen.get(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "series_id string, date date, close double")
    got = X.lagged_macro(df, W).orderBy("date").collect()
    assert [r["staleness_days_lag1"] for r in got] == [None, 0, 0, 1, 2, 0, 0, 1, 2, 0]
    assert [r["ret_1d_lag1"] for r in got][2:6] == pytest.approx([0.1, 0.0, 0.0, 12 / 11 - 1])
