"""Streams with state: indicators over whole tables, silent series, labels that come late."""

import os
import random
from datetime import datetime, timedelta
from functools import partial

import pytest

import oracle
from chronopanel.bindings import load_all
from chronopanel.session import scratch_path
from chronopanel.streaming import labels, sinks, stateful

SF = "/root/testdata/sf0.001"
QUERY = load_all()["streaming_indicators"]
BARS = "series_id string, period timestamp, close double, volume double"
START = datetime(2024, 1, 1)


def compared(con, got):
    have = {(r.series_id, r.period): tuple(r) for r in got.collect()}
    names = got.columns
    con_rows = con.execute(QUERY.sql)
    order = [d[0] for d in con_rows.description]
    want = {}
    for row in con_rows.fetchall():
        named = dict(zip(order, row))
        want[named["series_id"], named["period"]] = tuple(named[n] for n in names)
    assert have.keys() == want.keys() and len(have) == got.count()
    for k in want:
        assert have[k] == tuple(x if not isinstance(x, float) else pytest.approx(x, abs=1e-5) for x in want[k])
    return have


@pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables are absent")
def test_indicators_of_every_bar(spark):
    """The stream starts again from its checkpoint for every slice that lands."""
    compared(oracle.duck(SF), QUERY.build(spark, SF))


def test_indicators_of_a_table_shorter_than_the_lateness(spark, tmp_path):
    import duckdb

    rows = [(i, START + timedelta(hours=i // 2), i % 5, "ab"[i % 2], float(i * 7 % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    df.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert len(compared(con, QUERY.build(spark, str(tmp_path)))) == 60


def streamed(spark, schema, parts, build):
    """Rows that ``build`` gives for a stream whose parts land one after another."""
    path = scratch_path(spark, "landed")
    land = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
    land([])
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(path)
    return sinks.drained(build(stream), "out", [partial(land, p) for p in parts])


def day(n, hours=0):
    return START + timedelta(days=n, hours=hours)


def test_silent_series_are_forgotten(spark):
    """After ``keep_days`` without a bar the state goes: on-balance volume begins at zero again; a series that goes on keeps it."""
    a = [[("a", day(i), 1.0 + i, 10.0) for i in range(4)], [("b", day(i), 5.0 - i % 2, 1.0) for i in range(30)], [("a", day(40), 9.0, 10.0), ("a", day(41), 9.5, 10.0)], [("b", day(60), 5.0, 1.0)]]
    run = lambda keep: {(r.series_id, r.period): r.obv for r in streamed(spark, BARS, a, lambda s: stateful.streaming_indicators(s, keep_days=keep)).collect()}
    kept, gone = run(None), run(10)
    assert kept["a", day(3)] == gone["a", day(3)] == 30.0
    assert (kept["a", day(40)], kept["a", day(41)]) == (40.0, 50.0)
    assert (gone["a", day(40)], gone["a", day(41)]) == (0.0, 10.0)
    assert kept["b", day(29)] == gone["b", day(29)]


def test_bars_without_close_twice_and_late(spark):
    rows = [("a", day(i), None if i in (3, 4) else float(i % 5), 2.0) for i in range(30)]
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    behind = [("a", day(2), 99.0, 2.0)]  # the watermark has passed it
    out = streamed(spark, BARS, [shuffled + rows[:3], behind, [("a", day(90), 0.0, 0.0)], [("a", day(200), 0.0, 0.0)]], lambda s: stateful.streaming_indicators(s, span=4, window=3, lateness="1 day"))
    got = {r.period: r for r in out.collect()}
    assert sorted(got) == [r[1] for r in rows] + [day(90)]
    ema, weight, closes = None, 1.0, []
    for _, period, close, _ in rows:
        if close is None:
            weight *= 0.6
            assert got[period].close is None and got[period].ema == pytest.approx(ema)
            continue
        weight *= 0.6
        ema = close if ema is None else (weight * ema + 0.4 * close) / (weight + 0.4)
        weight = 1.0
        closes.append(close)
        assert got[period].ema == pytest.approx(ema)
        assert got[period].sma == (pytest.approx(sum(closes[-3:]) / 3) if len(closes) > 2 else None)


def test_labels_days_after_their_predictions(spark):
    """Within the horizon a label is found however late its file lands; later ones, strangers and null keys are not."""
    said, truth = "key string, pred int, made timestamp", "key string, y int, known timestamp"
    paths = scratch_path(spark, "said"), scratch_path(spark, "truth")

    def land(p, t):
        for rows, schema, path in ((p, said, paths[0]), (t, truth, paths[1])):
            spark.createDataFrame(rows, schema).write.mode("append").parquet(path)

    land([], [])
    streams = [spark.readStream.schema(spark.createDataFrame([], s).schema).parquet(p) for s, p in ((said, paths[0]), (truth, paths[1]))]
    joined = labels.late_labels(*streams, ["key"], "made", "known", "10 DAYS")
    lands = [
        ([("a", 1, day(0)), ("b", 0, day(0)), (None, 1, day(0)), ("c", 1, day(1))], [("x", 1, day(1))]),
        ([("d", 1, day(5))], [("a", 1, day(5)), (None, 0, day(5))]),
        ([("e", 1, day(12))], [("b", 0, day(10)), ("c", 1, day(12)), ("d", 0, day(12))]),  # the one for c is a day too late
        ([("f", 0, day(13))], [("e", 1, day(13))]),
        ([("end", 0, day(99))], [("other end", 0, day(99))]),
    ]
    out = sinks.drained(joined, "late", [partial(land, *x) for x in lands])
    assert sorted(((r.key, r.pred, r.y) for r in out.collect()), key=str) == sorted([("a", 1, 1), ("b", 0, 0), (None, 1, None), ("c", 1, None), ("d", 1, 0), ("e", 1, 1), ("f", 0, None)], key=str)
