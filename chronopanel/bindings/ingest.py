"""Source, cleaning and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as TX
from ..functions.hashing import canonical_json, config_hash
from ..functions.rolling import SeriesWindow
from ..operators import cleaning as C
from ..operators import labels as L
from ..operators import panel as PN
from ..operators import selection as SEL
from ..session import scratch_path
from ..sources import inventory, payloads, posts, tabular
from .base import (
    ANCHOR, BARS, BASE, METRICS, PEERS, S, SPARSE, TABLES, line_bars, out, query, sparse_closes, status_metrics, table,
)

W = SeriesWindow()

# Date text that cannot be read for low-priority pending orders.
BAD_DATE = "CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'pending' ELSE CAST(o_orderdate AS VARCHAR) END"


def text_orders(spark, sf_dir):
    """Orders the way a text file delivers them."""
    o = table(spark, sf_dir, "orders")
    bad = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    return o.select(
        F.col("o_orderpriority").alias("source"),
        F.when(bad, F.lit("pending")).otherwise(F.col("o_orderdate").cast("string")).alias("date"),
        F.when(F.col("o_orderstatus") == "F", F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("value"),
        F.col("o_orderkey").alias("ingest"),
    )


@query(
    "normalised_table", "S01 P01",
    out(
        f"""SELECT source, date, arg_min(value, ingest) AS value, min(ingest) AS ingest FROM (
          SELECT o_orderpriority AS source, TRY_CAST({BAD_DATE} AS DATE) AS date,
            CASE WHEN o_orderstatus = 'F' THEN 'n/a' ELSE 'v' || o_orderkey END AS value, o_orderkey AS ingest FROM orders)
          WHERE date IS NOT NULL GROUP BY 1, 2""",
        "source value", "date", (), "ingest",
    ),
)
def _(spark, sf_dir):
    raw = text_orders(spark, sf_dir)
    raw = raw.withColumn("value", F.when(F.col("value") == "n/a", F.col("value")).otherwise(F.concat(F.lit("v"), F.col("ingest"))))
    return C.normalise_table(raw, "date", "ingest", ["source"])


@query("typed_reload", "S02", out("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders", "", "o_orderdate", "o_totalprice", "o_orderkey"))
def _(spark, sf_dir):
    return tabular.read_panel(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_totalprice")


@query(
    "instrument_files", "S03 S13 S14 F02 P07",
    out("SELECT series_id, date, open, close, volume FROM bars", "series_id", "date", "open close volume", ctes=BARS),
)
def _(spark, sf_dir):
    """Bars written as one CSV folder per instrument with classic names, then scanned back in one glob."""
    path = scratch_path(spark, "instruments")
    b = line_bars(spark, sf_dir)
    named = b.select(
        "series_id", F.col("date").alias("Date"), F.col("open").alias("Opening Price"), F.col("close").alias("Closing Price"),
        F.col("volume").alias("Trading Volume"),
    )
    named.write.partitionBy("series_id").option("header", True).csv(path)
    back = tabular.read_instruments(spark, f"{path}/*/*.csv", pattern=r"series_id=([^/]+)/")
    return C.to_numbers(back, ["open", "close", "volume"]).select(
        "series_id", C.utc_date("date").alias("date"), "open", "close", "volume"
    )


@query(
    "provider_bars", "S05 P02",
    out(
        "SELECT event_type AS series_id, CAST(ts AS DATE) AS date, arg_min(value, event_id) AS close, 1.0 AS volume FROM events GROUP BY 1, 2",
        "series_id", "date", "close volume",
    ),
)
def _(spark, sf_dir):
    ev = table(spark, sf_dir, "events", "event_id", "ts", "event_type", "value")
    raw = ev.select(
        "event_id", "event_type", F.col("ts").cast("string").alias("Date"), F.col("value").cast("string").alias("Close"),
        F.lit("1").alias("Volume"), F.lit("unused").alias("Note"),
    )
    return tabular.provider_bars(raw, F.col("event_type"), "event_id")


def epoch(c):
    return F.unix_seconds(F.col(c).cast("timestamp"))


@query(
    "sentiment_index_payload", "S06 F03",
    out("SELECT event_id, CAST(ts AS DATE) AS date, value AS fear_greed, event_type AS value_classification FROM events", "value_classification", "date", "fear_greed"),
)
def _(spark, sf_dir):
    ev = table(spark, sf_dir, "events", "ts", "event_type", "value")
    item = F.struct(
        epoch("ts").cast("string").alias("timestamp"), F.col("value").cast("string").alias("value"), F.col("event_type").alias("value_classification")
    )
    return payloads.sentiment_index(ev.select(F.to_json(F.struct(F.array(item).alias("data"))).alias("raw")))


@query(
    "chart_payload", "S07 J01",
    out("SELECT event_type AS metric, CAST(ts AS DATE) AS date, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2", "metric", "date", "value"),
)
def _(spark, sf_dir):
    ev = table(spark, sf_dir, "events", "event_id", "ts", "event_type", "value")
    pair = F.array(
        F.struct(epoch("ts").alias("x"), F.col("value").alias("y")), F.struct(epoch("ts").alias("x"), F.lit(-1.0).alias("y"))
    )
    docs = ev.select(F.col("event_type").alias("metric"), F.col("event_id").alias("doc_order"), F.to_json(F.struct(pair.alias("values"))).alias("raw"))
    return payloads.chart_points(docs)


@query(
    "paged_metrics", "S08 U01 P15",
    out(
        """SELECT 'cm_AdrActCnt' AS metric, CAST(o_orderdate AS DATE) AS date, o_totalprice AS value FROM orders
           UNION ALL SELECT 'cm_TxCnt', CAST(o_orderdate AS DATE), CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END FROM orders""",
        "metric", "date", "value",
    ),
)
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderdate", "o_totalprice", "o_custkey", "o_orderstatus")
    row = F.struct(
        F.col("o_orderdate").cast("string").alias("time"), F.col("o_totalprice").alias("AdrActCnt"),
        F.when(F.col("o_orderstatus") == "P", F.lit("bad")).otherwise(F.col("o_custkey").cast("string")).alias("TxCnt"), F.lit(1).alias("Other"),
    )
    pages = o.select(F.to_json(F.struct(F.array(row).alias("data"))).alias("raw"))
    return payloads.paged_metrics(pages, ("AdrActCnt", "TxCnt"))


@query(
    "metric_points_payload", "S09",
    out("SELECT event_type AS metric, CAST(ts AS DATE) AS date, value FROM events", "metric", "date", "value"),
)
def _(spark, sf_dir):
    ev = table(spark, sf_dir, "events", "ts", "event_type", "value")
    item = F.array(F.struct(epoch("ts").alias("t"), F.col("value").alias("v")))
    return payloads.metric_points(ev.select(F.col("event_type").alias("metric"), F.to_json(item).alias("raw")))


@query(
    "nested_posts", "S10",
    out(
        "SELECT conv_id || '-' || turn AS id, '2024-01-01' AS created_at, text, role AS lang, turn AS like_count, 0 AS retweet_count, 0 AS reply_count, length(text) AS quote_count FROM conversations",
        "id created_at text lang", "", (), "like_count retweet_count reply_count quote_count",
    ),
)
def _(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    post = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("2024-01-01").alias("created_at"), F.col("text"), F.col("role").alias("lang"),
        F.struct(F.col("turn").alias("like_count"), F.lit(None).cast("bigint").alias("retweet_count"), F.length("text").alias("quote_count")).alias("public_metrics"),
    )
    return payloads.post_rows(c.select(F.to_json(F.struct(F.array(post).alias("data"))).alias("raw")))


@query(
    "network_snapshots", "S11",
    out(
        "SELECT CAST(date_trunc('second', ts) AS VARCHAR) AS collected_at, CAST(json_extract(props, '$.k') AS BIGINT) AS mempool_count, user_id AS mempool_vsize, value AS fastest_fee FROM events",
        "collected_at", "", "fastest_fee", "mempool_count mempool_vsize",
    ),
)
def _(spark, sf_dir):
    ev = table(spark, sf_dir, "events", "ts", "user_id", "value", "props")
    k = F.from_json("props", "k bigint")["k"]
    doc = F.struct(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("collected_at"),
        F.struct(k.alias("count"), F.col("user_id").alias("vsize")).alias("mempool"),
        F.struct(F.col("value").alias("fastestFee")).alias("recommended_fees"),
        F.struct(F.lit("unavailable").alias("error")).alias("difficulty_adjustment"),
    )
    snaps = payloads.network_snapshots(ev.select(F.to_json(doc).alias("raw")))
    return snaps.select("collected_at", "mempool_count", "mempool_vsize", "fastest_fee")


@query(
    "post_synonyms", "S12",
    out("SELECT doc_id, CAST(CAST('2024-01-01' AS DATE) + CAST(doc_id % 30 AS INTEGER) AS VARCHAR) AS created_at, length(text) AS text_length FROM documents", "created_at", "", (), "doc_id text_length"),
)
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text").withColumn(
        "timestamp", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
    )
    resolved = posts.resolve_posts(d.withColumnRenamed("text", "content"))
    return resolved.select("doc_id", "created_at", F.length("text").alias("text_length"))


@query(
    "source_status", "S15",
    out(
        """SELECT w.series_id, CASE WHEN b.n IS NULL THEN 'missing' ELSE 'ok' END AS status, coalesce(b.n, 0) AS rows
           FROM (VALUES ('AF'), ('AO'), ('NF'), ('NO'), ('RF'), ('RO'), ('ZZ')) AS w(series_id)
           LEFT JOIN (SELECT series_id, count(*) AS n FROM bars GROUP BY 1) b USING (series_id)""",
        "series_id status", "", (), "rows", ctes=BARS,
    ),
)
def _(spark, sf_dir):
    return inventory.source_status(line_bars(spark, sf_dir), [ANCHOR, *PEERS, "ZZ"])


@query(
    "collection_inventory", "S16",
    out(
        "SELECT 'optional_metrics' AS source, 0 AS rows" + "".join(f" UNION ALL SELECT '{n}', count(*) FROM {n}" for n in TABLES),
        "source", "", (), "rows",
    ),
)
def _(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in TABLES}
    return inventory.collection_inventory({**t, "optional_metrics": None})


@query(
    "json_report", "S04 A06",
    out("SELECT count(*) AS rows, min(date) AS date_start, max(date) AS date_end FROM bars", "", "date_start date_end", (), "rows", ctes=BARS),
)
def _(spark, sf_dir):
    path = scratch_path(spark, "report")
    tabular.write_report(SEL.describe_panel(line_bars(spark, sf_dir)).drop("columns", "n_series"), path)
    return spark.read.schema("rows bigint, date_start date, date_end date").json(path)


# --- cleaning ---------------------------------------------------------------------------


@query(
    "coerced_values", "P01 P02",
    out(
        f"""SELECT o_orderkey AS ingest, TRY_CAST({BAD_DATE} AS DATE) AS date,
          CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS value FROM orders""",
        "", "date", "value", "ingest",
    ),
)
def _(spark, sf_dir):
    return text_orders(spark, sf_dir).select("ingest", C.utc_date("date").alias("date"), N.to_double("value").alias("value"))


@query(
    "known_rows", "P03",
    out("SELECT macro_id, date, close FROM sp WHERE close IS NOT NULL", "macro_id", "date", "close", ctes=SPARSE),
)
def _(spark, sf_dir):
    sparse = sparse_closes(spark, sf_dir)
    rows = PN.spine(sparse, ["macro_id"]).join(sparse, ["macro_id", "date"], "left")
    return C.drop_unknown(rows, ["close"])


@query(
    "finite_values", "P05 F05",
    out(
        "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS a, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 1.0 END AS b FROM orders",
        "", "", "a b", "o_orderkey",
    ),
)
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    df = o.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", F.lit(float("-inf"))).otherwise(F.col("o_totalprice")).alias("a"),
        F.when(F.col("o_orderstatus") == "F", F.lit(float("nan"))).otherwise(F.lit(1.0)).alias("b"),
    )
    return C.finite_only(df)


@query(
    "safe_division", "P06 F04",
    out(
        """SELECT l_returnflag, count(*) AS rows, count(l_extendedprice / nullif(l_discount, 0)) AS known,
          max(l_extendedprice / nullif(l_discount, 0)) AS largest FROM lineitem GROUP BY 1""",
        "l_returnflag", "", "largest", "rows known", digits=3,
    ),
    digits=3,
)
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_returnflag", "l_extendedprice", "l_discount")
    ratio = N.safe_div("l_extendedprice", "l_discount")
    return li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), F.count(ratio).alias("known"), F.max(ratio).alias("largest"))


@query(
    "tidy_columns", "P07 F02 S14",
    out("SELECT series_id, date, close FROM bars", "series_id", "date", "close", ctes=BARS),
)
def _(spark, sf_dir):
    b = line_bars(spark, sf_dir).select(F.col("series_id").alias(" Series_ID "), F.col("date").alias("DATE"), F.col("close").alias("Close "))
    return C.tidy_columns(b)


CATALOG = f"""{BARS}, cat AS (
  SELECT DISTINCT series_id AS feature, CASE WHEN series_id LIKE 'A%' THEN 'price_core' ELSE 'crypto' END AS family FROM bars
  UNION ALL SELECT DISTINCT o_orderpriority, 'macro' FROM orders
  UNION ALL SELECT DISTINCT 'corr_' || o_orderpriority, 'macro_corr' FROM orders
  UNION ALL SELECT DISTINCT o_orderstatus, 'onchain' FROM orders
  UNION ALL SELECT DISTINCT event_type, 'sentiment' FROM events)"""


def data_catalog(spark, sf_dir):
    """A feature catalogue read off the tables: series, priorities, statuses and event types."""
    li = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus").select(
        F.concat("l_returnflag", "l_linestatus").alias("feature")
    ).distinct()
    prices = li.withColumn("family", F.when(F.col("feature").startswith("A"), "price_core").otherwise("crypto"))
    o = table(spark, sf_dir, "orders", "o_orderpriority", "o_orderstatus")
    pri = o.select(F.col("o_orderpriority").alias("feature")).distinct()
    return (
        prices.unionByName(pri.withColumn("family", F.lit("macro")))
        .unionByName(pri.select(F.concat(F.lit("corr_"), "feature").alias("feature"), F.lit("macro_corr").alias("family")))
        .unionByName(o.select(F.col("o_orderstatus").alias("feature")).distinct().withColumn("family", F.lit("onchain")))
        .unionByName(table(spark, sf_dir, "events", "event_type").select(F.col("event_type").alias("feature")).distinct().withColumn("family", F.lit("sentiment")))
    )


def _group_sql(groups):
    pairs = ", ".join(f"('{g}', '{f}')" for g, fams in groups.items() for f in fams)
    return out(
        f"""SELECT feature_set, feature FROM (
          SELECT DISTINCT g.feature_set, c.feature, count(*) OVER (PARTITION BY g.feature_set) AS n
          FROM cat c JOIN (VALUES {pairs}) AS g(feature_set, family) USING (family)) WHERE n >= 5""",
        "feature_set feature", ctes=CATALOG,
    )


@query("feature_groups_by_prefix", "P08 U02", _group_sql(SEL.GROUPS_V1))
def _(spark, sf_dir):
    return SEL.feature_groups(data_catalog(spark, sf_dir), SEL.GROUPS_V1)


@query("feature_groups", "P09 U02", _group_sql(SEL.GROUPS_V2))
def _(spark, sf_dir):
    return SEL.feature_groups(data_catalog(spark, sf_dir), SEL.GROUPS_V2)


@query(
    "feature_union", "U02",
    out("SELECT feature FROM cat WHERE family IN ('price_core', 'crypto') UNION SELECT feature FROM cat WHERE family IN ('crypto', 'macro')", "feature", ctes=CATALOG),
)
def _(spark, sf_dir):
    cat = data_catalog(spark, sf_dir)
    pick = lambda *f: cat.filter(F.col("family").isin(*f)).select("feature")
    return SEL.union_features(pick("price_core", "crypto"), pick("crypto", "macro"))


@query(
    "feature_difference", "U04",
    out("SELECT feature FROM cat EXCEPT SELECT feature FROM cat WHERE family = 'crypto'", "feature", ctes=CATALOG),
)
def _(spark, sf_dir):
    cat = data_catalog(spark, sf_dir)
    return SEL.missing_features(cat.select("feature"), cat.filter(F.col("family") == "crypto").select("feature"))


@query(
    "series_gate", "P10",
    out(
        "SELECT macro_id, date, close FROM sparse WHERE macro_id IN (SELECT macro_id FROM sparse GROUP BY 1 HAVING count(close) >= (SELECT avg(n) FROM (SELECT count(close) AS n FROM sparse GROUP BY macro_id)))",
        "macro_id", "date", "close", ctes=SPARSE,
    ),
)
def _(spark, sf_dir):
    """Series at least as long as the mean series."""
    sparse = sparse_closes(spark, sf_dir)
    mean = sparse.groupBy("macro_id").count().agg(F.avg("count").alias("m")).first()["m"]
    return PN.series_gate(sparse, ["macro_id"], "close", mean)


@query(
    "nonnegative_gate", "P11",
    out(
        "SELECT metric, avg(CASE WHEN value >= 0 THEN 1.0 ELSE 0.0 END) AS nonneg_share, CASE WHEN avg(CASE WHEN value >= 0 THEN 1.0 ELSE 0.0 END) > 0.95 THEN 'yes' ELSE 'no' END AS active FROM mx GROUP BY 1",
        "metric active", "", "nonneg_share", ctes=METRICS,
    ),
)
def _(spark, sf_dir):
    m = status_metrics(spark, sf_dir)
    rows = PN.spine(m, ["metric"]).join(m, ["metric", "date"], "left")
    return PN.nonnegative_gate(rows, ["metric"], "value").withColumn("active", F.when(F.col("active"), "yes").otherwise("no"))


@query(
    "recent_window", "P13 F03",
    out("SELECT series_id, date, close FROM bars WHERE date >= (SELECT max(date) - 365 FROM bars)", "series_id", "date", "close", ctes=BARS),
)
def _(spark, sf_dir):
    return C.recent_window(line_bars(spark, sf_dir), 365).select("series_id", "date", "close")


@query(
    "temporal_violations", "P14",
    out(
        """SELECT count(*) AS rows, count(*) FILTER (target_end_date IS NULL OR target_return_1d IS NULL) AS null_key,
          count(*) FILTER (target_end_date <= date) AS target_not_after, 0 AS duplicate_key FROM base""",
        "", "", (), "rows null_key target_not_after duplicate_key", ctes=BASE,
    ),
)
def _(spark, sf_dir):
    return C.temporal_violations(L.forward_target(line_bars(spark, sf_dir), W))


@query(
    "validated_panel", "P14 P03",
    out("SELECT series_id, date, target_return_1d FROM base WHERE target_return_1d IS NOT NULL", "series_id", "date", "target_return_1d", ctes=BASE),
)
def _(spark, sf_dir):
    return C.validated(L.forward_target(line_bars(spark, sf_dir), W)).select("series_id", "date", "target_return_1d")


@query(
    "wide_panel", "P15 J01",
    out(
        "SELECT date, " + ", ".join(f"max(close) FILTER (series_id = '{s}') AS \"{s}\"" for s in (ANCHOR, *PEERS)) + " FROM bars GROUP BY 1",
        "", "date", [ANCHOR, *PEERS], ctes=BARS,
    ),
)
def _(spark, sf_dir):
    return PN.to_wide(line_bars(spark, sf_dir), ["date"], "series_id", "close", [ANCHOR, *PEERS])


@query(
    "long_panel", "P15",
    out(
        "SELECT series_id, date, 'open' AS field, open AS value FROM bars UNION ALL SELECT series_id, date, 'close', close FROM bars",
        "series_id field", "date", "value", ctes=BARS,
    ),
)
def _(spark, sf_dir):
    return PN.to_long(line_bars(spark, sf_dir), ["series_id", "date"], ["open", "close"], "field", "value")


@query(
    "after_review", "P17",
    out(
        "SELECT series_id, date, close FROM bars WHERE date >= (SELECT max(target_end_date) + 1 FROM base WHERE date < DATE '2001-06-01')",
        "series_id", "date", "close", ctes=BASE,
    ),
)
def _(spark, sf_dir):
    df = L.forward_target(line_bars(spark, sf_dir), W)
    return C.after_review(df, df.filter(F.col("date") < F.lit("2001-06-01").cast("date"))).select("series_id", "date", "close")


@query(
    "union_of_pages", "U01",
    out("SELECT 'orders' AS origin, o_orderkey AS id, o_totalprice AS amount FROM orders UNION ALL SELECT 'events', event_id, NULL FROM events", "origin", "", "amount", "id"),
)
def _(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.lit("orders").alias("origin"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    b = table(spark, sf_dir, "events").select(F.lit("events").alias("origin"), F.col("event_id").alias("id"))
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "date_intersection", "U03",
    out("SELECT date FROM sparse INTERSECT SELECT date FROM bars", "", "date", ctes=SPARSE + ", " + BARS),
)
def _(spark, sf_dir):
    return sparse_closes(spark, sf_dir).select("date").intersect(line_bars(spark, sf_dir).select("date"))


@query(
    "file_names", "F02 S13",
    out("SELECT DISTINCT lower(trim(source)) AS name, 'sub_TA' AS stem, replace(source || '_TA.csv', '_TA.csv', '_Labeled.csv') AS renamed FROM documents", "name stem renamed"),
)
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "source").distinct()
    path = F.concat(F.lit("/data/"), "source", F.lit("/sub_TA.csv"))
    return d.select(
        TX.tidy_name("source").alias("name"), TX.file_stem(path).alias("stem"),
        TX.replace_suffix(F.concat("source", F.lit("_TA.csv")), "_TA.csv", "_Labeled.csv").alias("renamed"),
    )


@query(
    "date_functions", "F03",
    out(
        """SELECT event_id, CAST(ts AS DATE) AS day, isodow(ts) - 1 AS dow, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS since,
           CAST(ts AS DATE) - 30 AS back FROM events""",
        "", "day back", (), "event_id dow since",
    ),
)
def _(spark, sf_dir):
    ev = table(spark, sf_dir, "events", "event_id", "ts")
    day = C.epoch_date(F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"))
    return ev.select(
        "event_id", day.alias("day"), F.weekday(day).alias("dow"), F.datediff(day, F.lit("2024-01-01").cast("date")).alias("since"), F.date_sub(day, 30).alias("back")
    )


@query(
    "math_functions", "F04 F05",
    out(
        """SELECT event_id, CASE WHEN value > 50 THEN ln(value - 50) END AS l, CASE WHEN value > 49 THEN ln(1 + (value - 50)) END AS l1, sqrt(abs(value)) AS s, abs(value - 50) AS a, sign(value - 50) AS g,
           greatest(value - 50, 0) AS up, least(value - 50, 0) AS down, power(value, 2) AS sq FROM events""",
        "", "", "l l1 s a g up down sq", "event_id", digits=5,
    ),
    digits=5,
)
def _(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events", "event_id", "value").select(
        "event_id", N.ln_positive(v - 50).alias("l"), N.log1p_safe(v - 50).alias("l1"), F.sqrt(F.abs(v)).alias("s"), F.abs(v - 50).alias("a"),
        F.signum(v - 50).alias("g"), N.clip_low(v - 50, 0.0).alias("up"), N.clip_high(v - 50, 0.0).alias("down"), F.pow(v, 2).alias("sq"),
    )


@query(
    "config_hashes", "F07 R02",
    out(
        """SELECT priority, status, sha256('{"priority":"' || priority || '","status":"' || status || '"}') AS hash
           FROM (SELECT DISTINCT o_orderpriority AS priority, o_orderstatus AS status FROM orders)""",
        "priority status hash",
    ),
)
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).distinct()
    return o.withColumn("hash", config_hash(["status", "priority"]))
