"""Queries opN_<name>: each operator over its whole table with production parameters, and the SQL that checks it where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import bpe, langid, lm, packing, quantised, radix, repair, repeats, secrets, simhash, urlfilter, warc, whitening
from .common import read

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
PACKING_MODEL = "byte_bpe_50k.json"
#: SimHash as the query and the pipeline use it: words in a shingle, differing bits of linked fingerprints.
SHINGLE, RADIUS = 4, 4
COSINE = 0.93


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    captures = warc.transactions(pages, scratch_path(spark, "warc"), with_payload=False)
    return captures.select(
        warc.page_of(F.col("record_id"), kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to"), kind).alias("refers_to"),
        "target_uri", F.size("requests").cast("long").alias("n_requests"), F.size("metadata").cast("long").alias("n_metadata"),
    )


OP1_SQL = r"""WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND head IS NOT NULL AND head IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND head IS DISTINCT FROM page_id THEN head END AS refers_to, regexp_replace(url, '[\x00-\x20]', '%20', 'g') AS target_uri,
  CAST(1 AS BIGINT) AS n_requests, CAST(1 AS BIGINT) AS n_metadata FROM f"""


def op2_radix_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix.duplicates(read(spark, sf_dir, "documents", "doc_id", "text")).drop("row")


OP2_SQL = r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)"""


def op3_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.coded(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op4_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = langid.predicted(docs, langid.learned(docs))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: Dated entries that three lists would hold for the hosts, host folders and parent domains of the pages.  Every number comes
#: from characters of the pattern's md5 digest, so that SQL can say the same.
def list_entries(pages: DataFrame) -> DataFrame:
    host, folder = urlfilter.host_of(F.col("url")), urlfilter.first_folder(F.col("url"))
    named = pages.select(host.alias("host"), folder.alias("folder")).filter("host IS NOT NULL").distinct()
    domain = F.regexp_extract("host", r"[^.]+\.[^.]+$", 0)
    patterns = named.select(
        F.explode(
            F.array(
                F.struct(F.lit("hosts").alias("list"), F.col("host").alias("pattern"), F.lit(49).alias("least")),
                F.struct(F.lit("folders").alias("list"), F.concat("host", F.lit("/"), "folder").alias("pattern"), F.lit(55).alias("least")),
                F.struct(F.lit("domains").alias("list"), F.when(domain != "", domain).alias("pattern"), F.lit(100).alias("least")),
            )
        ).alias("p")
    ).select("p.*").filter("pattern IS NOT NULL").distinct()
    sign = lambda i: F.ascii(F.substring(F.md5("pattern"), i, 1))
    chosen = patterns.filter(sign(1) >= F.col("least")).withColumns({"start": (sign(2) * 3 - 144).cast("int"), "gap": (sign(3) - 40).cast("int")})
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(added).alias("added"), F.lit(least).alias("need")) for i, added, least in ((0, True, 0), (1, False, 52), (2, True, 98))])
    return chosen.withColumn("e", F.explode(steps)).filter(sign(4) >= F.col("e.need")).select(
        "list", "pattern", F.date_add(F.lit("2024-01-01").cast("date"), F.col("start") + F.col("gap") * F.col("e.i")).alias("day"), F.col("e.added").alias("added"), F.col("e.i").alias("seq")
    )


def op5_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no time of fetch; the page number stands for it, over a year."""
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.coalesce(F.col("page_id") % 366, F.lit(0)).cast("int"))
    out = urlfilter.evaluated(pages.withColumn("day", day), list_entries(pages))
    return out.select(F.col("id").alias("page_id"), "host", F.col("day").cast("string").alias("day"), "n_active", "blocked", "first_pattern")


OP5_SQL = r"""WITH u AS (SELECT row_number() OVER () AS row, page_id, CAST('2024-01-01' AS DATE) + CAST(page_id % 366 AS INTEGER) AS day,
  nullif(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '') AS host,
  nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)/', 1), '') || '/' AS folder FROM pages),
pat AS (SELECT DISTINCT * FROM (
  SELECT 'hosts' AS list, host AS pattern, 49 AS least FROM u UNION ALL SELECT 'folders', host || '/' || folder, 55 FROM u
  UNION ALL SELECT 'domains', nullif(regexp_extract(host, '[^.]+\.[^.]+$', 0), ''), 100 FROM u) WHERE pattern IS NOT NULL),
sig AS (SELECT list, pattern, least, md5(pattern) AS h FROM pat),
ent AS (SELECT list, pattern, i, added, CAST('2024-01-01' AS DATE) + CAST(ascii(substr(h, 2, 1)) * 3 - 144 + (ascii(substr(h, 3, 1)) - 40) * i AS INTEGER) AS day
  FROM sig, (VALUES (0, true, 0), (1, false, 52), (2, true, 98)) AS s(i, added, need) WHERE ascii(substr(h, 1, 1)) >= least AND ascii(substr(h, 4, 1)) >= need),
one AS (SELECT list, pattern, day, arg_max(added, i) AS added FROM ent GROUP BY ALL),
span AS (SELECT *, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS until FROM one),
ask AS (SELECT row, day, unnest(list_distinct([array_to_string(string_split(host, '.')[k:], '.') FOR k IN range(1, len(string_split(host, '.')) + 1)] || [host || '/' || folder])) AS key FROM u WHERE host IS NOT NULL),
hit AS (SELECT a.row, s.pattern FROM ask a JOIN span s ON s.pattern = a.key AND s.added AND s.day <= a.day AND (s.until IS NULL OR a.day < s.until)),
agg AS (SELECT row, count(*) AS n, min(pattern) AS p FROM hit GROUP BY row)
SELECT page_id, host, CAST(day AS VARCHAR) AS day, CAST(coalesce(n, 0) AS BIGINT) AS n_active, coalesce(n, 0) > 0 AS blocked, p AS first_pattern FROM u LEFT JOIN agg USING (row)"""


def op6_quantised_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised.near_vectors(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), COSINE)


OP6_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS node, vec_id AS far FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.far),
comp AS (SELECT node, min(far) AS component_id FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n FROM link GROUP BY 1)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON node = vec_id LEFT JOIN n ON n.a = vec_id"""


def op7_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), SHINGLE, RADIUS)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_secret_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scanned(read(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), count("entropy"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def op9_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target are the documents that are labelled as good."""
    good = read(spark, sf_dir, "labels", "doc_id", "quality").filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("good")).distinct()
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    # labels grow with the documents, so the join is the same at every size
    marked = docs.join(good.hint("merge"), docs["doc_id"] == good["good"], "left")
    return lm.scored(marked.select("doc_id", "text", F.col("good").isNotNull().alias("target")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(PACKING_MODEL))


def op11_prefix_free_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))


# bytes as two hexadecimal digits, so that DuckDB's string functions cut them
OP11_SQL = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
spot AS (SELECT r, h, unnest(range(greatest(CAST(length(h) // 2 - 399 AS BIGINT), 0))) AS i FROM d),
w AS MATERIALIZED (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM spot),
hit AS (SELECT r, i FROM w SEMI JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) AS often USING (m)),
seam AS (SELECT *, CAST(coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 400, true) AS INTEGER) AS opens FROM hit),
isle AS (SELECT *, sum(opens) OVER (PARTITION BY r ORDER BY i) AS g FROM seam),
span AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM isle GROUP BY r, g),
part AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS since FROM span),
cut AS (SELECT r, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head, max(b) AS stop, sum(b - a) AS removed, count(*) AS n
  FROM part JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN cut USING (r)"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(repair.damaged(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))


def op13_whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_transactions, op2_radix_duplicates, op3_bpe_replay, op4_rank_order_language, op5_temporal_url_filter, op6_quantised_vectors,
        op7_simhash_tiles, op8_secret_windows, op9_cross_entropy_difference, op10_best_fit_packing,
        op11_prefix_free_repeats, op12_conversation_repair, op13_whitened_vectors,
    )
}
SQL = {
    "op1_warc_transactions": OP1_SQL, "op2_radix_duplicates": OP2_SQL, "op5_temporal_url_filter": OP5_SQL, "op6_quantised_vectors": OP6_SQL,
    "op11_prefix_free_repeats": OP11_SQL,
}
