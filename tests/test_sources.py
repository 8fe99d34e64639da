"""File sources, payload fixtures, artifacts, streams and the search store."""

import json

import pytest
from pyspark.sql import functions as F

from chronopanel.operators import sentiment as ST
from chronopanel.plans import search as SR
from chronopanel.plans.crossval import pick_features
from chronopanel.plans.models import CLASSIFIERS, REGRESSORS
from chronopanel.sources import inventory, payloads, posts, tabular
from chronopanel.sources.results import ResultStore


def test_optional_table(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("date,v\n2024-01-02,1\nnot a date,9\n2024-01-01,2\n2024-01-02,3\n")
    got = sorted((str(r["date"]), r["v"]) for r in tabular.read_optional(spark, str(path)).collect())
    assert got == [("2024-01-01", "2"), ("2024-01-02", "1")]
    assert tabular.read_optional(spark, str(tmp_path / "absent.csv")) is None
    (tmp_path / "nodate.csv").write_text("x\n1\n")
    assert tabular.read_optional(spark, str(tmp_path / "nodate.csv")) is None


def test_instrument_glob(spark, tmp_path):
    for name in ("AAA", "BBB"):
        (tmp_path / f"{name}_TA.csv").write_text("Date,Closing Price\n2024-01-01,1.5\n")
    df = tabular.read_instruments(spark, str(tmp_path / "*_TA.csv"), suffix="_TA")
    assert sorted((r["series_id"], r["close"]) for r in df.collect()) == [("AAA", "1.5"), ("BBB", "1.5")]


def docs(spark, tmp_path, **files):
    for name, obj in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(obj))
    return payloads.read_documents(spark, str(tmp_path / "*.json"))


def test_payload_shapes(spark, tmp_path):
    d = docs(spark, tmp_path, hash_rate={"values": [{"x": 86400, "y": 1.5}, {"x": 86500, "y": 9}, {"x": "bad", "y": 1}, {"x": 172800, "y": "oops"}]})
    got = sorted((r["metric"], str(r["date"]), r["value"]) for r in payloads.chart_points(d).collect())
    assert got == [("hash_rate", "1970-01-02", 1.5), ("hash_rate", "1970-01-03", None)]


def test_index_and_points(spark, tmp_path):
    d = docs(spark, tmp_path, fng={"data": [{"timestamp": "86400", "value": "55", "value_classification": "Greed"}, {"timestamp": "x", "value": "y", "value_classification": "?"}]})
    rows = payloads.sentiment_index(d).collect()
    assert (str(rows[0]["date"]), rows[0]["fear_greed"]) == ("1970-01-02", 55.0) and rows[1]["date"] is None and rows[1]["fear_greed"] is None


def test_posts_and_snapshot(spark, tmp_path):
    d = docs(spark, tmp_path, p={"data": [{"id": "1", "created_at": "2024-01-01T10:00:00Z", "lang": "en", "public_metrics": {"like_count": 3}}, {"id": "2", "text": "hi"}]})
    rows = payloads.post_rows(d).collect()
    assert rows[0]["text"] == "" and rows[0]["like_count"] == 3 and rows[1]["quote_count"] == 0
    s = spark.createDataFrame([(json.dumps({"collected_at": "2024-01-01T00:00:00+00:00", "mempool": {"count": 4}, "recommended_fees": {"error": "x"}}),)], "raw string")
    snap = payloads.network_snapshots(s).first()
    assert snap["mempool_count"] == 4 and snap["fastest_fee"] is None


def test_synonyms_and_status(spark):
    df = spark.createDataFrame([("a", "b")], "tweet string, timestamp string")
    assert posts.resolve_posts(df).columns == ["text", "created_at"]
    assert posts.resolve_posts(df.drop("tweet")) is None
    panel = spark.createDataFrame([("a", 1.0), ("b", None)], "series_id string, close double")
    got = {r["series_id"]: r["status"] for r in inventory.source_status(panel, ["a", "b", "c"]).collect()}
    assert got == {"a": "ok", "b": "empty", "c": "missing"}


def test_sentiment_by_hand(spark):
    rows = [
        (1, "2024-01-01", "Bullish!! https://t.co/x @me #moon", 0), (2, "2024-01-01", "nothing here", 9), (3, "2024-01-02", "crash crash", 0),
    ]
    df = spark.createDataFrame(rows, "id int, date string, text string, like_count int")
    scored = ST.compound(ST.with_engagement(ST.with_clean_text(df)), "id")
    got = {r["id"]: r["compound"] for r in scored.collect()}
    assert got[1] == pytest.approx(4.5 / (4.5**2 + 15) ** 0.5) and got[2] == 0 and got[3] == pytest.approx(-5 / 40**0.5)
    padded = ST.DOMAIN_LEXICON | {f"unseen{i}": 1.0 for i in range(5000)}
    joined = ST.compound(ST.with_engagement(ST.with_clean_text(df)), "id", padded)
    assert {r["id"]: r["compound"] for r in joined.collect()} == pytest.approx(got)
    day = {r["date"]: r for r in ST.daily_sentiment(scored).collect()}
    assert day["2024-01-01"]["x_post_count"] == 2 and day["2024-01-01"]["x_sentiment_median"] == pytest.approx(got[1] / 2)
    assert day["2024-01-02"]["x_sentiment_std"] is None and day["2024-01-02"]["x_negative_share"] == 1


def test_result_store_and_grid(spark, tmp_path):
    grid = SR.config_grid(spark, {"kind": ["a"], "top_k": [30, 50], "model": ["m"], "k": [0.5]})
    assert grid.count() == 2 and grid.select("config_hash").distinct().count() == 2
    again = SR.config_grid(spark, {"kind": ["b"], "top_k": [30], "model": ["m"], "k": [0.5]})
    assert again.join(grid, "config_hash").count() == 1
    store = ResultStore(spark, str(tmp_path / "r"))
    assert store.load().count() == 0
    h = grid.first()["config_hash"]
    store.append([{"config_hash": h, "robust_score": 0.5}])
    store.append([{"config_hash": h, "robust_score": 0.5}])
    assert store.load().count() == 1
    assert SR.missing_configs(grid, store.load()).count() == 1


def test_catalogue_sizes():
    assert len(CLASSIFIERS) == 6 and len(REGRESSORS) == 5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "series_id string, v int")
    tabular.write_table(df, str(tmp_path / "t"), ["series_id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    tabular.write_csv(df, str(tmp_path / "c"))
    tabular.write_report(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
