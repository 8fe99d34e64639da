"""Sentiment, fingerprint and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_post
from ..operators import fingerprints as FP
from ..operators import sentiment as ST
from ..session import stored
from .base import TABLES, out, query, table

# Words of the supplied invented prose with made-up polarities, beside the domain list.
PROSE = {"the": 0.5, "and": -0.4, "is": 0.3, "un": 0.9, "la": -0.7, "elle": 1.1, "que": -1.3, "der": 0.8, "und": -0.6, "in": 0.2}
LEXICON = {**ST.DOMAIN_LEXICON, **PROSE}

CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, 'https?://\S+', ' ', 'g'), '@\w+', ' ', 'g'), '#', '', 'g'), '\s+', ' ', 'g'))"""
DAY = "CAST('2024-01-01' AS DATE) + CAST({k} % 30 AS INTEGER)"
WORDS = ", ".join(f"('{w}', {p}::DOUBLE)" for w, p in LEXICON.items())


@query(
    "clean_posts", "F01",
    out(f"SELECT doc_id, md5({CLEAN.format(t='text')}) AS digest, length({CLEAN.format(t='text')}) AS size FROM documents", "digest", "", (), "doc_id size"),
)
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("c", clean_post("text"))
    return d.select("doc_id", F.md5("c").alias("digest"), F.length("c").alias("size"))


@query(
    "clean_marked_posts", "F01",
    out(
        f"""SELECT doc_id, {CLEAN.format(t="('@' || lang || ' see https://x.org/' || source || '?q=1 #' || lang || '  ' || source)")} AS cleaned FROM documents""",
        "cleaned", "", (), "doc_id",
    ),
)
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "lang", "source")
    post = F.concat(F.lit("@"), "lang", F.lit(" see https://x.org/"), "source", F.lit("?q=1 #"), "lang", F.lit("  "), "source")
    return d.select("doc_id", clean_post(post).alias("cleaned"))


SCORED = rf"""lex(word, polarity) AS (VALUES {WORDS}),
docs AS (SELECT doc_id, {DAY.format(k='doc_id')} AS date, lower({CLEAN.format(t='text')}) AS t, n_chars FROM documents),
tok AS (SELECT doc_id, unnest(regexp_split_to_array(t, '[^\p{{L}}\p{{N}}'']+')) AS word FROM docs),
hit AS (SELECT doc_id, sum(polarity) AS s FROM tok JOIN lex USING (word) GROUP BY 1),
scored AS (SELECT doc_id, date, coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15) AS compound, n_chars AS engagement, 1 + ln(1 + n_chars) AS wt
  FROM docs LEFT JOIN hit USING (doc_id))"""


def scored_posts(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text", "n_chars").withColumns(
        {
            "date": F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")),
            "like_count": F.col("n_chars"),
        }
    )
    posts = ST.with_engagement(ST.with_clean_text(d))
    return ST.compound(posts, "doc_id", LEXICON)


@query("lexicon_sentiment", "F08", out("SELECT doc_id, compound FROM scored", "", "", "compound", "doc_id", ctes=SCORED))
def _(spark, sf_dir):
    return scored_posts(spark, sf_dir).select("doc_id", "compound")


#: Words of the prose that stand for negations and degree words, so that every rule finds hits.
PROSE_NOT, PROSE_DEGREES = ("a", "en", "ne", "zu"), {"of": ST.MORE, "to": ST.LESS, "de": ST.MORE, "die": ST.LESS}
TURNS = ", ".join(f"'{w}'" for w in PROSE_NOT)


def _rule_sql() -> str:
    value = f"polarity + CASE WHEN loud AND mixed THEN sign(polarity) * {ST.CAPITALS} ELSE 0 END"
    steps = []
    for k, fade in enumerate(ST.FADING, 1):
        base = "CASE " + " ".join(f"WHEN lower(b{k}) = '{w}' THEN {s!r}" for w, s in PROSE_DEGREES.items()) + " ELSE 0 END"
        size = f"({base} + CASE WHEN {base} <> 0 AND b{k} = upper(b{k}) AND b{k} <> lower(b{k}) AND mixed THEN sign({base}) * {ST.CAPITALS} ELSE 0 END)"
        grown = f"v{k - 1} + CASE WHEN b{k} IS NULL THEN 0 WHEN v{k - 1} < 0 THEN -{size} ELSE {size} END * {fade}"
        steps.append(f"r{k} AS (SELECT *, ({grown}) * CASE WHEN lower(b{k}) IN ({TURNS}) OR lower(b{k}) LIKE '%n''t' THEN {ST.TURN} ELSE 1 END AS v{k} FROM r{k - 1})")
    return f"""lex(word, polarity) AS (VALUES {WORDS}),
txt AS (SELECT doc_id, {CLEAN.format(t='text')} AS t FROM documents),
arr AS (SELECT doc_id, t, [regexp_replace(w, '{ST.STRIP}', '', 'g') FOR w IN string_split(t, ' ')] AS w FROM txt),
mk AS (SELECT *, list_position([lower(x) FOR x IN w], 'but') AS but, len([x FOR x IN w IF x = upper(x) AND x <> lower(x)]) AS caps FROM arr),
at0 AS (SELECT doc_id, w, but, caps > 0 AND caps < len(w) AS mixed, unnest(range(1, len(w) + 1)) AS i FROM mk),
tk AS (SELECT doc_id, but, mixed, i, lower(w[i]) AS word, w[i] = upper(w[i]) AND w[i] <> lower(w[i]) AS loud, CASE WHEN i > 1 THEN w[i - 1] END AS b1,
  CASE WHEN i > 2 THEN w[i - 2] END AS b2, CASE WHEN i > 3 THEN w[i - 3] END AS b3 FROM at0),
r0 AS (SELECT *, {value} AS v0 FROM tk JOIN lex USING (word)), {', '.join(steps)},
tot AS (SELECT doc_id, sum(v3 * CASE WHEN i < but THEN {ST.BEFORE_BUT} WHEN i > but THEN {ST.AFTER_BUT} ELSE 1 END) AS s FROM r3 GROUP BY 1),
st AS (SELECT doc_id, s, least(length(t) - length(replace(t, '!', '')), {ST.MOST_EXCLAMATIONS}) * {ST.EXCLAMATION} + CASE WHEN length(t) - length(replace(t, '?', '')) > 3 THEN {ST.MANY_QUESTIONS}
  WHEN length(t) - length(replace(t, '?', '')) > 1 THEN (length(t) - length(replace(t, '?', ''))) * {ST.QUESTION} ELSE 0 END AS stress FROM txt LEFT JOIN tot USING (doc_id)),
ruled AS (SELECT doc_id, s + sign(s) * stress AS z FROM st)"""


@query("rule_sentiment", "F08", out("SELECT doc_id, coalesce(z / sqrt(z * z + 15), 0) AS compound FROM ruled", "", "", "compound", "doc_id", ctes=_rule_sql()))
def _(spark, sf_dir):
    posts = ST.with_clean_text(table(spark, sf_dir, "documents", "doc_id", "text"))
    return ST.rule_compound(posts, "doc_id", LEXICON, negations=PROSE_NOT, degrees=PROSE_DEGREES).select("doc_id", "compound")


@query(
    "engagement_weights", "F09",
    out("SELECT doc_id, engagement, wt AS sentiment_weight, compound * wt AS weighted FROM scored", "", "", "engagement sentiment_weight weighted", "doc_id", ctes=SCORED),
)
def _(spark, sf_dir):
    s = scored_posts(spark, sf_dir)
    return s.select("doc_id", "engagement", "sentiment_weight", (F.col("compound") * F.col("sentiment_weight")).alias("weighted"))


DAILY = [
    "x_sentiment_mean", "x_sentiment_median", "x_sentiment_std", "x_positive_share", "x_negative_share", "x_engagement", "x_sentiment_weighted",
]


@query(
    "daily_sentiment", "A01 A02 N01",
    out(
        """SELECT date, count(*) AS x_post_count, avg(compound) AS x_sentiment_mean, median(compound) AS x_sentiment_median, stddev_samp(compound) AS x_sentiment_std,
           avg(CASE WHEN compound >= 0.05 THEN 1.0 ELSE 0 END) AS x_positive_share, avg(CASE WHEN compound <= -0.05 THEN 1.0 ELSE 0 END) AS x_negative_share,
           sum(engagement) AS x_engagement, sum(compound * wt) / sum(wt) AS x_sentiment_weighted FROM scored GROUP BY 1""",
        "", "date", DAILY, "x_post_count", ctes=SCORED,
    ),
)
def _(spark, sf_dir):
    scored = scored_posts(spark, sf_dir).select("date", "compound", "engagement", "sentiment_weight")
    return ST.daily_sentiment(stored(scored, "scored-posts")).select("date", "x_post_count", *DAILY)


#: Columns of the supplied tables by kind.
COLUMNS = {
    "region": {"int": "r_regionkey", "text": "r_name"},
    "nation": {"int": "n_nationkey n_regionkey", "text": "n_name"},
    "customer": {"int": "c_custkey c_nationkey", "text": "c_name c_mktsegment", "real": "c_acctbal"},
    "supplier": {"int": "s_suppkey s_nationkey", "text": "s_name", "real": "s_acctbal"},
    "part": {"int": "p_partkey p_size", "text": "p_name p_brand p_type", "real": "p_retailprice"},
    "orders": {"int": "o_orderkey o_custkey", "text": "o_orderstatus o_orderpriority", "real": "o_totalprice", "time": "o_orderdate"},
    "lineitem": {
        "int": "l_orderkey l_partkey l_suppkey l_linenumber", "real": "l_quantity l_extendedprice l_discount l_tax", "text": "l_returnflag l_linestatus", "time": "l_shipdate",
    },
    "events": {"int": "event_id user_id", "time": "ts", "text": "event_type props", "real": "value"},
    "documents": {"int": "doc_id n_chars", "text": "text lang source"},
    "embeddings": {"int": "vec_id label", "list of real": "embedding"},
    "pages": {"int": "page_id", "text": "url html"},
    "benchmark": {"int": "item_id", "text": "text"},
    "labels": {"int": "doc_id quality toxic"},
    "conversations": {"int": "conv_id turn", "text": "role text"},
}


def canonical_sql(kind: str, c: str) -> str:
    if kind == "list of real":
        return f"coalesce('[' || array_to_string([{canonical_sql('real', 'v')} FOR v IN {c}], ',') || ']', 'N')"
    if kind == "real":
        x, p = f"CAST({c} AS DOUBLE)", "power(2.0::DOUBLE, {})"
        g = f"CAST(floor(log2(abs({x}))) AS BIGINT)"
        e = f"({g} + CAST(abs({x}) >= {p.format(f'{g} + 1')} AS BIGINT) - CAST(abs({x}) < {p.format(g)} AS BIGINT))"
        h = f"CAST(floor((52 - {e}) / 2.0) AS BIGINT)"
        m = f"CAST(abs({x}) * {p.format(h)} * {p.format(f'(52 - {e} - {h})')} AS BIGINT)"
        text = f"CASE WHEN {x} < 0 THEN '-' ELSE '' END || {m} || 'p' || ({e} - 52)"
        return f"coalesce(CASE WHEN isnan({x}) THEN 'nan' WHEN isinf({x}) THEN CASE WHEN {x} > 0 THEN 'inf' ELSE '-inf' END WHEN {x} = 0 THEN '0' ELSE {text} END, 'N')"
    text = {"text": f"octet_length(encode({c})) || ':' || {c}", "time": f"CAST(epoch_us({c}) AS VARCHAR)"}.get(kind, f"CAST({c} AS VARCHAR)")
    return f"coalesce({text}, 'N')"


def fingerprint_sql(name: str) -> str:
    fields = sorted((c, kind) for kind, names in COLUMNS[name].items() for c in names.split())
    row = " || '|' || ".join(canonical_sql(kind, c) for c, kind in fields)
    schema = ",".join(f"{c}:{kind}" for c, kind in fields)
    words = ", ".join(f"coalesce(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)), 0)" for i in range(4))
    return f"SELECT '{name}' AS name, count(*) AS rows, sha256(concat_ws('|', '{schema}', count(*), {words})) AS digest FROM (SELECT md5({row}) AS h FROM {name})"


PRINTS = "prints AS (" + " UNION ALL ".join(map(fingerprint_sql, TABLES)) + ")"
LISTED = "array_to_string(list_sort(list(name || '=' || digest)), ';')"


@query("table_fingerprints", "R01 R03", out("SELECT * FROM prints", "name digest", "", (), "rows", ctes=PRINTS))
def _(spark, sf_dir):
    return FP.manifest({n: table(spark, sf_dir, n) for n in TABLES})


@query("fingerprint_rows", "R01", out(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in TABLES), "name", "", (), "rows"))
def _(spark, sf_dir):
    """Row counts of the fingerprints; shuffled input gives the same digest (see tests)."""
    return FP.manifest({n: table(spark, sf_dir, n) for n in TABLES}).select("name", "rows")


@query(
    "run_manifest", "R02 R03",
    out(f"SELECT count(*) AS tables, sha256({LISTED}) AS run_id, sha256('v1|k=0.7;splits=6|' || {LISTED}) AS signature FROM prints", "run_id signature", "", (), "tables", ctes=PRINTS),
)
def _(spark, sf_dir):
    rows = stored(FP.manifest({n: table(spark, sf_dir, n) for n in TABLES}), "manifest")
    ids = FP.reproducibility_id(rows)
    return ids.join(F.broadcast(FP.signature(rows, {"k": 0.7, "splits": 6})))
