"""Near duplicates by SimHash: 64-bit fingerprints of word shingles and an exact tiled comparison of all fingerprints."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import components, spanning, width

SEED = 42
#: Fingerprints in a tile, and rows of it compared at a time.
TILE, STRIP = 2048, 128
#: Shingles hashed at a time.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit fingerprint: each bit that is set in over half the shingle hashes; zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = [len(w) + 1 for w in words]
    ends = [e - 1 for e in accumulate(lengths)]
    starts = [e - n + 1 for e, n in zip(ends, lengths)]
    last = ends[shingle - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(last), BLOCK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[i : i + BLOCK], last[i : i + BLOCK])], "<u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(last), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) per row; a null text is empty."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches):
        for b in batches:
            fp = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _tiles(batches):
    """Consecutive sorted fingerprints with the same population counts, at most ``TILE`` together."""
    held: list[np.ndarray] = []
    at = None

    def tile():
        fp = np.concatenate(held)
        for i in range(0, len(fp), TILE):
            part = fp[i : i + TILE]
            yield {"tile": int(part[0]), "high": at[0], "low": at[1], "fps": part.astype("<i8").tobytes()}

    for b in batches:
        high, low, fp = (b.column(i).to_numpy() for i in range(3))
        breaks = np.flatnonzero((np.diff(high) != 0) | (np.diff(low) != 0)) + 1
        for s, e in zip([0, *breaks], [*breaks, len(fp)]):
            if e > s:
                key = (int(high[s]), int(low[s]))
                if at not in (None, key):
                    yield from tile()
                    held = []
                at = key
                held.append(fp[s:e])
                if sum(map(len, held)) >= 64 * TILE:
                    yield from tile()
                    held = []
    if held:
        yield from tile()


def _batched(rows, schema, many=256):
    out = []
    for r in rows:
        out.append(r)
        if len(out) == many:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def links_between(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links with the same components as all pairs within ``radius`` between two tiles."""
    u, v = [], []
    for i in range(0, len(a), STRIP):
        x, y = np.nonzero(np.bitwise_count(a[i : i + STRIP, None] ^ b[None, :]) <= radius)
        if len(x):
            # one link per row and column of the strip is enough where all of them hang together
            m, r = spanning(len(a) + len(b), x + i, y + len(a))
            u.append(m)
            v.append(r)
    if not u:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    m, r = spanning(len(a) + len(b), np.concatenate(u), np.concatenate(v))
    both = np.concatenate([a, b]).view(np.int64)
    return both[m], both[r]


def linked(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) that hold together all fingerprints ``fp`` within ``radius`` bits of each other.

    A fingerprint's halves have population counts (high, low); two within the radius differ by at most that much in both
    counts together.  Tiles hold one pair of counts, so a tile meets only the tiles of nearby counts, by an equi-join on the
    pair of counts; all other tile pairs are skipped, and the rest are compared in full with exclusive-or and bit counts.
    """
    spark, c, n = distinct.sparkSession, F.col, width(distinct.sparkSession)
    counted = distinct.select(
        F.bit_count(F.shiftrightunsigned("fp", 32)).cast("int").alias("high"), F.bit_count(F.expr("fp & 4294967295")).cast("int").alias("low"), "fp"
    )
    schema = pa.schema([("tile", pa.int64()), ("high", pa.int32()), ("low", pa.int32()), ("fps", pa.binary())])
    ordered = counted.repartitionByRange(n, "high", "low", "fp").sortWithinPartitions("high", "low", "fp")
    tiles = stored(ordered.mapInArrow(lambda it: _batched(_tiles(it), schema), "tile long, high int, low int, fps binary"), "tiles")
    near = [(h, w) for h in range(radius + 1) for w in range(-radius, radius + 1) if h + abs(w) <= radius and (h or w >= 0)]
    steps = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(w).alias("w")) for h, w in near])
    left = tiles.select(F.explode(steps).alias("d"), c("tile").alias("a"), c("fps").alias("x"), "high", "low").select(
        (c("high") + c("d.h")).alias("high"), (c("low") + c("d.w")).alias("low"), "a", "x", ((c("d.h") == 0) & (c("d.w") == 0)).alias("same")
    )
    right = tiles.select("high", "low", c("tile").alias("b"), c("fps").alias("y"))
    pairs = left.join(right, ["high", "low"]).filter(~c("same") | (c("a") <= c("b"))).select("x", "y").repartition(4 * n)
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(batches):
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                u, v = links_between(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8"), radius)
                keep = u != v
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], schema=out)

    return pairs.mapInArrow(compare, "u long, v long")


def _classes(docs: DataFrame, shingle: int, radius: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Fingerprints per row, and (fp, low, component) per distinct fingerprint: its smallest id and its component."""
    prints = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    nodes = stored(components(linked(classes.select("fp"), radius)), "nodes")
    joined = classes.join(nodes, F.col("fp") == F.col("node"), "left")
    return prints, joined.select("fp", "low", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per row: the smallest doc_id that links of at most ``radius`` differing bits reach.

    Equal fingerprints are one node, so copies are never paired.  Texts without words have fingerprint zero and link like any
    other; ids that repeat get their row's own fingerprint; null ids take part but never name a component unless they are
    alone (then it is null); an empty table gives no rows; other columns are ignored.
    """
    c = F.col
    prints, named = _classes(docs, shingle, radius, id_col, text_col)
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    table = stored(named.join(lowest, "component").select(c("fp").alias("of"), "component_id"), "components")
    return prints.join(table.hint("merge"), c("fp") == c("of")).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: one that has its smallest id; nulls come last.

    Rows whose ids repeat are told apart by their fingerprint, which is computed again for them; all others are found by
    their id alone.
    """
    c = F.col
    prints, named = _classes(docs, shingle, radius, id_col, text_col)
    first = named.groupBy("component").agg(F.min(F.struct(c("low").isNull().alias("none"), "low", "fp")).alias("first"))
    kept = stored(first.select(c("first.low").alias("_id"), c("first.fp").alias("_fp")), "representatives")
    many = stored(prints.groupBy(c("doc_id").alias("_many")).count().filter("count > 1").select("_many"), "repeated-ids")
    same = docs[id_col].eqNullSafe(c("_many"))
    single = docs.join(many, same, "left_anti")
    single = single.join(kept.select("_id").hint("merge"), single[id_col].eqNullSafe(c("_id")), "left_semi")

    @F.pandas_udf("long")
    def printed(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    several = docs.join(many, same, "left_semi").withColumn("_print", printed(text_col))
    several = several.join(kept, several[id_col].eqNullSafe(c("_id")) & (c("_print") == c("_fp")), "left_semi")
    return single.union(several.dropDuplicates([id_col, "_print"]).drop("_print"))
