"""WARC archives: writing captures, reading records back, and assembling each capture from its linked records."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

#: Payloads shorter than this are stored again rather than referred to.
REVISIT_BYTES = 100
END_OF_RECORD = "\r\n\r\n"
#: Captures in one archive file.
FILE_CAPTURES = 5_000
PRIMARY = ("response", "revisit", "resource")


def referred(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) with payload_bytes, payload_digest and refers_to.

    Of pages with equal payloads of at least ``least`` bytes the one with the smallest page_id is kept, the others refer to it.
    A page with a null id is never the one that is kept, unless all of them have null ids: then each is.
    Payloads are counted by digest with partial aggregation; only digests that repeat are joined back, from a written table.
    """
    c = F.col
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    sized = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.octet_length(body).cast("long").alias("payload_bytes"),
        F.sha2(body, 256).alias("payload_digest"),
    )
    repeated = (
        sized.filter(c("payload_bytes") >= least).groupBy(c("payload_digest").alias("digest"))
        .agg(F.count("*").alias("n"), F.min("page_id").alias("head")).filter("n > 1").select("digest", "head")
    )
    joined = sized.join(stored(repeated, "repeated"), c("payload_digest") == c("digest"), "left")
    return joined.withColumn("refers_to", F.when(~c("head").eqNullSafe(c("page_id")), c("head"))).drop("digest", "head")


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record as text; a field whose value is null is left out."""
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in fields]
    size = F.octet_length(block).cast("string")
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("Content-Length: "), size, F.lit(END_OF_RECORD), block)


def name_of(page_id: Column) -> Column:
    """Name of a page in record ids; every character that could break a header line is percent-encoded."""
    return F.concat(F.lit("capture:"), F.url_encode(page_id.cast("string")))


def record_id(name: Column, kind: str) -> Column:
    return F.concat(F.lit("<urn:"), name, F.lit(f":{kind}>"))


def page_of(record: Column, kind: str) -> Column:
    """The page id in a record id, as a ``kind``; null for pages without one."""
    text = F.url_decode(F.regexp_extract(record, "^<urn:capture:(.*):[a-z]+>$", 1))
    return F.when(record.startswith("<urn:capture:"), text.try_cast(kind))


def write(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """One response or revisit, one request and one metadata record per row of ``referred`` pages.

    A record ends with two line ends, so Spark's text writer lays the records down as they are, with its usual commit of
    whole files: a task that is run again leaves no half archive.  A null id gets a name of its own; a null url has no target.
    """
    c = F.col
    page = F.coalesce(name_of(c("page_id")), F.concat(F.lit("unnamed:"), F.uuid()))
    named = pages.withColumn("page", page)
    url = F.regexp_replace("url", r"[\x00-\x20]", "%20")
    main = record_id(c("page"), "response")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), c("payload_bytes").cast("string"), F.lit(END_OF_RECORD)
    )
    shared = [("WARC-Target-URI", url), ("WARC-Date", F.lit(date))]
    digest = F.concat(F.lit("sha256:"), c("payload_digest"))
    head = _record(
        [
            ("WARC-Type", F.when(c("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))), ("WARC-Record-ID", main), *shared,
            ("WARC-Payload-Digest", digest), ("WARC-Refers-To", record_id(name_of(c("refers_to")), "response")),
            ("WARC-Profile", F.when(c("refers_to").isNotNull(), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(c("refers_to").isNull(), F.concat(http, "html")).otherwise(http),
    )
    asked = _record(
        [
            ("WARC-Type", F.lit("request")), ("WARC-Record-ID", record_id(c("page"), "request")), *shared, ("WARC-Concurrent-To", main),
            ("Content-Type", F.lit("application/http; msgtype=request")),
        ],
        F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(" HTTP/1.1" + END_OF_RECORD)),
    )
    about = _record(
        [
            ("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", record_id(c("page"), "metadata")), *shared, ("WARC-Concurrent-To", main),
            ("Content-Type", F.lit("application/warc-fields")),
        ],
        F.concat(F.lit("payloadBytes: "), c("payload_bytes").cast("string"), F.lit("\r\n")),
    )
    rows = named.select(F.concat_ws(END_OF_RECORD, head, asked, about).alias("value"))
    rows.write.option("lineSep", END_OF_RECORD).option("compression", "gzip").option("maxRecordsPerFile", FILE_CAPTURES).text(folder)


def records(stream) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(fields by lower-case name, block) of every record, one record in memory at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields: dict[str, list[str]] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields.setdefault(name.strip().lower(), []).append(value.strip())
        yield fields, stream.read(int(fields["content-length"][0]))


_TEXT = pa.string()
SCHEMA = pa.schema(
    [
        ("record_id", _TEXT), ("kind", _TEXT), ("concurrent_to", pa.list_(_TEXT)), ("target_uri", _TEXT), ("date", _TEXT), ("refers_to", _TEXT),
        ("payload_bytes", pa.int64()), ("payload_digest", _TEXT), ("payload", pa.binary()),
    ]
)
RECORD = "record_id string, kind string, concurrent_to array<string>, target_uri string, date string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def _row(fields: dict[str, list[str]], block: bytes, with_payload: bool) -> dict:
    one = lambda name: fields.get(name, [None])[0]
    kind, payload = one("warc-type"), block
    size, digest = None, (one("warc-payload-digest") or "").removeprefix("sha256:") or None
    if (one("content-type") or "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        if kind == "revisit":
            stated = [v for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"]
            size = int(stated[0]) if stated else None
    if kind != "revisit":
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return {
        "record_id": one("warc-record-id"), "kind": kind, "concurrent_to": fields.get("warc-concurrent-to", []), "target_uri": one("warc-target-uri"),
        "date": one("warc-date"), "refers_to": one("warc-refers-to"), "payload_bytes": size, "payload_digest": digest,
        "payload": payload if with_payload and kind != "revisit" else None,
    }


def read(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """A row per record of all archives in a folder, plain or gzip.  Sizes and digests are those of the payload as read; a
    revisit, which holds none, has the size and digest that it states."""

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(content.as_py())
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw
                out, held = [], 0
                for fields, block in records(stream):
                    out.append(_row(fields, block, with_payload))
                    held += len(block) if with_payload else 100
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(parse, RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit with the requests and metadata concurrent to it.

    A record joins a capture if it names the response, if the response names it, or if it names a record that does either.
    Captures without other records have empty lists; records that lead to no capture are left out; equal records count once.
    """
    c = F.col
    main = found.filter(c("kind").isin(*PRIMARY))
    other = found.filter(~c("kind").isin(*PRIMARY))
    named = other.select(c("record_id").alias("member"), F.explode("concurrent_to").alias("anchor"))
    naming = main.select(F.explode("concurrent_to").alias("member"), c("record_id").alias("anchor"))
    link = named.union(naming)
    onward = link.select(c("member").alias("via"), c("anchor").alias("behind"))
    reached = link.join(onward, c("anchor") == c("via"), "left").select("member", F.coalesce("behind", "anchor").alias("capture")).distinct()
    part = F.struct("kind", "record_id", "payload_bytes", "payload_digest", "payload")
    parts = (
        other.join(reached, c("record_id") == c("member")).groupBy("capture").agg(F.sort_array(F.collect_set(part)).alias("parts"))
    )
    of = lambda kind: F.filter(F.coalesce("parts", F.array()), lambda x: x["kind"] == kind)
    return main.join(parts, c("record_id") == c("capture"), "left").select(
        "record_id", c("kind").alias("record_type"), "target_uri", "date", "refers_to", "payload_bytes", "payload_digest", "payload",
        of("request").alias("requests"), of("metadata").alias("metadata"),
    )


def transactions(pages: DataFrame, folder: str, least: int = REVISIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Write ``pages`` as archives in ``folder``, read them back and assemble every capture.

    A null html is an empty payload; rows that repeat a page_id give a row each; a null page_id has a record id that names no
    page; no pages give no rows; other columns are ignored.  A very long html is one record, whole in memory while it is read.
    """
    write(referred(pages.select("page_id", "url", "html"), least), folder)
    return assemble(stored(read(pages.sparkSession, folder, with_payload), "records"))
