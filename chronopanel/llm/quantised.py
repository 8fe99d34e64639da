"""Near duplicates among embeddings: inverted lists, product-quantised residuals, and exact cosine on what is left."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, stored
from .common import components, spanning, width

#: Vectors that lists and codebooks are fitted on: those with the smallest hashes.
SAMPLE = 8192
MOST_LISTS, SUBSPACES, CODES, ROUNDS = 1024, 8, 256, 8
#: Vectors in a tile, and bytes of their components.
TILE, TILE_BYTES = 4096, 1 << 20
#: Vectors of a tile that are compared at a time, pairs that are, and numbers that a table of distances to centres holds.
SLAB, PAIRS, SLICE = 256, 1 << 15, 1 << 22
#: Share of pairs from which their cosines come from one product of matrices.
DENSE = 1 / 32
#: Labels of more than a tile are dealt to so many folders by their hashes; a pair of tiles is looked for in one of them.
BANDS = 16
#: What single precision may add to a product of unit vectors; what a pair that passes the leading coordinates costs in coordinates.
SLACK, PASSING = 1e-5, 20000


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """In single precision: of two centres that lie as near, either may come."""
    ends = np.column_stack([2 * centres, -np.square(centres).sum(axis=1)]).astype(np.float32).T
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float32)
    return np.concatenate([(x[i : i + SLAB] @ ends).argmax(axis=1) for i in range(0, len(x), SLAB)] or [np.zeros(0, np.int64)])


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by Lloyd's method from evenly spaced rows; a centre that loses all its rows stays where it was."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Index:
    """Centres of the lists, one codebook of residuals for each subspace, and the axes of the leading coordinates."""

    def __init__(self, sample: np.ndarray, lists: int, cosine: float):
        self.centres = kmeans(sample, lists)
        residual = sample - self.centres[nearest(sample, self.centres)]
        self.parts = [p for p in np.array_split(np.arange(sample.shape[1]), SUBSPACES) if len(p)]
        self.books = [kmeans(residual[:, p], CODES) for p in self.parts]
        axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
        some, dims = sample[np.linspace(0, len(sample) - 1, min(512, len(sample))).astype(int)] @ axes, sample.shape[1]
        bounds = lambda k: some[:, :k] @ some[:, :k].T + np.outer(*[np.sqrt(np.maximum(0, 1 - np.square(some[:, :k]).sum(axis=1)))] * 2)
        self.axes = axes[:, : min((k for k in [*range(4, min(dims, 129), 4), dims]), key=lambda k: k + PASSING * (bounds(k) >= cosine - SLACK).mean())]

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance between each vector of a list and what its codes stand for."""
        residual = x - self.centres[cell]
        codes = np.stack([nearest(residual[:, p], b) for p, b in zip(self.parts, self.books)], axis=1)
        near = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return codes.astype(np.uint8), np.linalg.norm(residual - near, axis=1)

    def to_centres(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        centres = self.centres[lists]
        square = np.square(x).sum(axis=1)[:, None] + np.square(centres).sum(axis=1)[None, :] - 2 * x @ centres.T
        return np.sqrt(np.maximum(square, 0))

    def leading(self, x: np.ndarray) -> np.ndarray:
        """Leading coordinates and the length of the rest: their products are at least the cosines of unit vectors."""
        first = x @ self.axes
        rest = np.sqrt(np.maximum(0, 1 - np.square(first).sum(axis=1)))
        return np.column_stack([first, rest]).astype(np.float32)

    def asymmetric(self, x: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances between exact vectors and the coded ones of lists beside them."""
        residual = x - self.centres[cell]
        return np.sqrt(sum(np.square(residual[:, p] - b[codes[:, m]]).sum(axis=1) for m, (p, b) in enumerate(zip(self.parts, self.books))))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linkable(label: str, vector: str):
    """A label, and a vector with finite components that are not all zero."""
    c = F.col
    fine = F.forall(c(vector), lambda x: F.abs(x) < float("inf"))  # null where a component is, false where one is not a number
    some = (F.array_min(vector) < 0) | (F.array_max(vector) > 0)
    return F.coalesce(c(label).isNotNull() & c(vector).isNotNull() & fine & some, F.lit(False))


TILE_FIELDS = (
    "band int, label {label}, tile long, lists binary, ends binary, radii binary, copies binary, codes binary, error binary, vectors binary, "
    "heads binary, tails binary, lows array<{low}>"
)
#: What a comparison needs of a tile.
COMPARED = ("tile", "lists", "ends", "radii", "copies", "codes", "error", "vectors")


def precision(rows: DataFrame) -> str:
    """Tiles hold the components as they came; arithmetic is in double precision."""
    return "<f4" if isinstance(rows.schema["vector"].dataType.elementType, T.FloatType) else "<f8"


def laid_out(rows: DataFrame, index: Index, dims: int) -> DataFrame:
    """Tiles of different vectors of a label, in order of their lists.  A vector's number is that of its tile and its place there.

    ``band`` is -1 for tiles that hold all vectors of their label, else one of ``BANDS`` that holds all tiles of the label.
    """
    spark, c = rows.sparkSession, F.col
    label, low = (rows.schema[x].dataType.simpleString() for x in ("label", "vec_id"))
    kind = precision(rows)
    most = max(1, min(TILE, TILE_BYTES // (dims * int(kind[2:]))))

    def listed(batches):
        """Rows of a batch that repeat a vector are one row, so a very common vector comes but once from a batch."""
        for b in batches:
            at = pa.table({"label": b.column("label").dictionary_encode().indices, "head": b.column("head"), "tail": b.column("tail"), "low": b.column("vec_id")})
            order = pc.sort_indices(at, sort_keys=[(x, "ascending") for x in at.column_names])
            same = np.stack([at.column(x).take(order).to_numpy() for x in ("label", "head", "tail")])
            starts = np.flatnonzero(np.r_[True, (same[:, 1:] != same[:, :-1]).any(axis=0)][: len(order)])
            copies = np.diff(np.r_[starts, len(order)])
            chosen = b.take(order.take(pa.array(starts)))
            step = max(1, SLICE // max(dims, len(index.centres)))
            for i in range(0, len(chosen), step):
                part = chosen.slice(i, step)
                raw = np.array(part.column("vector").flatten().to_numpy(zero_copy_only=False), kind).reshape(-1, dims)
                cell = nearest(unit(raw), index.centres).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), pa.array(cell), *(part.column(x) for x in ("head", "tail", "vec_id")), pa.array(copies[i : i + step]), pa.array([x.tobytes() for x in raw], pa.binary())],
                    names=["label", "cell", "head", "tail", "low", "copies", "raw"],
                )

    def tile(part, whole: bool):
        cell = part.column("cell").to_numpy()
        ends = np.append(np.flatnonzero(np.diff(cell)) + 1, len(cell)).astype(np.int32)
        vectors = b"".join(part.column("raw").to_pylist())
        x = unit(np.frombuffer(vectors, kind).reshape(-1, dims))
        codes, error = index.encode(x, cell)
        far = np.linalg.norm(x - index.centres[cell], axis=1)
        as_bytes = lambda name: part.column(name).to_numpy().tobytes()
        values = {
            "band": -1 if whole else part.column("band")[0].as_py(), "label": part.column("label")[0].as_py(), "tile": part.column("key")[0].as_py(),
            "lists": cell[ends - 1].tobytes(), "ends": ends.tobytes(), "radii": np.maximum.reduceat(far, np.r_[0, ends[:-1]]).tobytes(),
            "copies": as_bytes("copies"), "codes": codes.tobytes(), "error": error.tobytes(), "vectors": vectors,
            "heads": as_bytes("head"), "tails": as_bytes("tail"),
        }
        lows = part.column("low").combine_chunks()
        arrays = {k: pa.array([v], part.schema.field("label").type if k == "label" else pa.int32() if k == "band" else pa.int64() if k == "tile" else pa.binary()) for k, v in values.items()}
        return pa.RecordBatch.from_arrays([*arrays.values(), pa.ListArray.from_arrays(pa.array([0, len(lows)], pa.int32()), lows)], names=[*arrays, "lows"])

    def tiles(batches):
        held, fresh, opened = None, False, False  # rows not yet in a tile; whether they begin their label; whether a label has begun before
        for b in batches:
            if not len(b):
                continue
            held = pa.concat_tables([held, pa.Table.from_batches([b])]) if held is not None else pa.Table.from_batches([b])
            name = held.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
            runs = np.append(np.flatnonzero(np.diff(name)) + 1, len(name))
            at = 0
            for k, end in enumerate(runs):
                last = k == len(runs) - 1
                while end - at > most or (not last and end > at):
                    n = min(most, end - at)
                    # the first label of a partition may have begun in the one before
                    yield tile(held.slice(at, n), fresh and not last and at + n == end)
                    at, fresh = at + n, False
                if not last:
                    fresh = True
            held = held.slice(at)
        if held is not None:
            yield tile(held, False)  # the last label may go on in the next partition

    n = width(spark)
    vectors = rows.mapInArrow(listed, f"label {label}, cell int, head long, tail long, low {low}, copies long, raw binary").repartitionByRange(n, "label", "cell", "head")
    vectors = vectors.groupBy("label", "cell", "head", "tail").agg(F.min("low").alias("low"), F.sum("copies").alias("copies"), F.first("raw").alias("raw"))
    vectors = vectors.sortWithinPartitions("label", "cell", "head", "tail").withColumns(
        {"key": F.monotonically_increasing_id(), "band": F.pmod(F.xxhash64("label"), F.lit(BANDS)).cast("int")}
    )
    path = scratch_path(spark, "tiles")
    made = vectors.mapInArrow(tiles, TILE_FIELDS.format(label=label, low=low))
    made.write.partitionBy("band").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


class Tile:
    """What a comparison needs of a tile, from one row of a batch."""

    def __init__(self, batch: pa.RecordBatch, i: int, side: str, index: Index, kind: str, dims: int):
        of = lambda name, kind: np.frombuffer(batch.column(side + name)[i].as_buffer(), kind)
        self.tile = batch.column(f"{side}tile")[i].as_py()
        self.lists, ends, self.radii, self.copies, self.error = of("lists", np.int32), of("ends", np.int32), of("radii", np.float64), of("copies", np.int64), of("error", np.float64)
        self.x = unit(of("vectors", kind).reshape(-1, dims))
        self.codes = of("codes", np.uint8).reshape(len(self.x), -1)
        self.place = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        self.keys, self.first = self.tile + np.arange(len(self.x)), index.leading(self.x)


def passing(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true ones, which are few."""
    packed = np.packbits(mask)
    at = np.flatnonzero(np.append(packed, np.zeros(-len(packed) % 8, np.uint8)).view(np.int64))
    at = (at[:, None] * 8 + np.arange(8)).ravel()
    at = at[at < len(packed)]
    at = at[packed[at] != 0]
    byte, bit = np.nonzero(np.unpackbits(packed[at]).reshape(-1, 8))
    return np.divmod(at[byte] * 8 + bit, mask.shape[1])


def met(q: Tile, t: Tile, index: Index, cosine: float):
    """(i, j) of the vectors of two tiles that are linked, some at a time; in a tile that meets itself i < j."""
    reach, own = math.sqrt(2 - 2 * cosine) + 1e-9, q.tile == t.tile
    asks = index.to_centres(q.x, t.lists) <= t.radii + reach
    rows, columns = np.flatnonzero(asks.any(axis=1)), np.flatnonzero(asks.any(axis=0)[t.place])
    first = np.ascontiguousarray(t.first[columns].T)
    bounds, mask = np.empty(SLAB * len(columns), np.float32), np.empty(SLAB * len(columns), bool)
    for s in range(0, len(rows), SLAB):
        at = rows[s : s + SLAB]
        left = np.searchsorted(columns, at[0], "right") if own else 0
        to = columns[left:]
        if not len(to):
            continue
        held = slice(0, len(at) * len(to))
        np.matmul(q.first[at], first[:, left:], out=bounds[held].reshape(len(at), -1))
        i, j = passing(np.greater_equal(bounds[held], np.float32(cosine - SLACK), out=mask[held]).reshape(len(at), -1))
        dense = len(i) > DENSE * len(at) * len(to)
        exact = q.x[at] @ t.x[to].T if dense else None
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            if dense:
                near = exact[a, b] >= cosine - 1e-9
                a, b = at[a[near]], to[b[near]]
                sure = exact[i[k : k + PAIRS][near], j[k : k + PAIRS][near]] >= cosine + 1e-9
            else:
                a, b = at[a], to[b]
                near = asks[a, t.place[b]]
                a, b = a[near], b[near]
                near = index.asymmetric(q.x[a], t.lists[t.place[b]], t.codes[b]) - t.error[b] <= reach
                a, b = a[near], b[near]
                sure = np.zeros(len(a), bool)
            sure[~sure] = np.einsum("ij,ij->i", q.x[a[~sure]], t.x[b[~sure]]) >= cosine
            a, b = a[sure], b[sure]
            if own:
                a, b = a[a < b], b[a < b]
            if len(a):
                yield a, b


def links(tiles: DataFrame, index: Index, dims: int, kind: str, cosine: float) -> DataFrame:
    """(u, v, n): links of vector u to different vectors (v is null; u may come again), and links that hold its component
    together (n is null).

    Nothing is missed: by the triangle inequality a list is passed over only if its radius does not reach a vector within the
    distance of the cosine, a pair only if its leading coordinates rule the cosine out, and a coded vector only if its
    distance less its coding error lies beyond.

    Each pair of tiles of a label meets once, in a task that reads both from their files: no vector is dealt out or broadcast.
    """
    c = F.col
    bands = sorted(r.band for r in tiles.select("band").distinct().collect())
    as_side = lambda df, side: [df[x].alias(side + x) for x in COMPARED]
    parts = []
    for band in bands:
        of = tiles.filter(c("band") == band)
        if band < 0:
            parts.append(of.select(*as_side(of, "q_"), *as_side(of, "t_")))
            continue
        q, t = of.select(c("label").alias("q_label"), *as_side(of, "q_")), of.select(c("label").alias("t_label"), *as_side(of, "t_"))
        both = q.join(t.hint("shuffle_replicate_nl"), (c("q_label") == c("t_label")) & (c("q_tile") <= c("t_tile")))
        parts.append(both.drop("q_label", "t_label"))

    def rows(u, v=None, n=None):
        blank = pa.nulls(len(u), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(u), blank if v is None else pa.array(v), blank if n is None else pa.array(n)], names=["u", "v", "n"])

    def counted(keys, counts):
        some = np.flatnonzero(counts)
        return rows(keys[some], n=counts[some])

    def compare(batches):
        q, mine = None, None
        for batch in batches:
            for i in range(len(batch)):
                if q is None or q.tile != batch.column("q_tile")[i].as_py():
                    if q is not None:
                        yield counted(q.keys, mine)
                    q = Tile(batch, i, "q_", index, kind, dims)
                    mine = np.zeros(len(q.keys), np.int64)
                t = q if q.tile == batch.column("t_tile")[i].as_py() else Tile(batch, i, "t_", index, kind, dims)
                shift = 0 if t is q else len(q.keys)
                yours, stars = np.zeros(len(t.keys), np.int64), []
                for a, b in met(q, t, index, cosine):
                    np.add.at(mine, a, t.copies[b])
                    np.add.at(yours, b, q.copies[a])
                    stars.append(spanning(shift + len(t.keys), a, b + shift))
                if not stars:
                    continue
                yield counted(t.keys, yours)
                member, root = spanning(shift + len(t.keys), *(np.concatenate(x) for x in zip(*stars)))
                ends = np.concatenate([q.keys, t.keys]) if shift else q.keys
                yield rows(ends[member], v=ends[root])
        if q is not None:
            yield counted(q.keys, mine)

    return reduce(DataFrame.union, parts).mapInArrow(compare, "u long, v long, n long")


def classes(tiles: DataFrame) -> DataFrame:
    """(key, label, head, tail, low, copies) of every vector in tiles."""
    label, low = tiles.schema["label"].dataType.simpleString(), tiles.schema["lows"].dataType.elementType.simpleString()

    def flat(batches):
        for b in batches:
            for i in range(len(b)):
                of = lambda name: np.frombuffer(b.column(name)[i].as_buffer(), np.int64)  # noqa: E731, B023
                heads = of("heads")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.column("tile")[i].as_py() + np.arange(len(heads))), b.column("label").take(pa.array(np.full(len(heads), i))), pa.array(heads), pa.array(of("tails")), b.column("lows")[i].values, pa.array(of("copies"))],
                    names=["key", "label", "head", "tail", "low", "copies"],
                )

    return tiles.select("label", "tile", "heads", "tails", "lows", "copies").mapInArrow(flat, f"key long, label {label}, head long, tail long, low {low}, copies long")


def _of_length(rows: DataFrame, dims: int, size: int, labels: int, different: int, cosine: float) -> DataFrame:
    """(label, head, tail, n_links, component_id) of vectors with ``dims`` components that have links or copies."""
    c = F.col
    low = -(1 << 63) + (1 << 64) * 2 * SAMPLE // max(different, 1)
    of = rows.filter(c("head") < low) if low < 1 << 63 else rows
    sample = of.filter(linkable("label", "vector") & (F.size("vector") == dims)).select("head", "vector").distinct().orderBy("head").limit(SAMPLE).toArrow()
    sample = np.array(sample.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
    index = Index(unit(sample), min(MOST_LISTS, max(1, math.isqrt(size // labels) // 4)), cosine)
    tiles = laid_out(rows.filter(linkable("label", "vector") & (F.size("vector") == dims)), index, dims)
    found = stored(links(tiles, index, dims, precision(rows), cosine), "found")
    counts = found.filter("v IS NULL").groupBy(c("u").alias("of")).agg(F.sum("n").alias("n"))
    nodes = components(found.filter("v IS NOT NULL").select("u", "v"), "merge").join(counts.hint("merge"), c("node") == c("of"))
    named = classes(tiles).join(nodes.hint("merge"), c("key") == c("node"), "left").filter("n IS NOT NULL OR copies > 1")
    named = stored(
        named.select("label", "head", "tail", "low", F.coalesce("component", "key").alias("component"), (F.coalesce("n", F.lit(0)) + c("copies") - 1).alias("n_links")),
        "vectors-named",
    )
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    # were equal vectors in two lists, each would count the other among its links
    return named.join(lowest.hint("merge"), "component").groupBy("label", "head", "tail").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))


def near_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row: links join rows with equal labels and a cosine of at least ``cosine``.

    Equal vectors of a label (by 128 bits of hashes) are one node with its number of copies.  Lists and codebooks are fitted on
    at most ``SAMPLE`` vectors of a length; every vector is indexed.  Vectors that are null, zero, without label or with null or
    non-finite components have no links.  Vectors of different lengths are never linked: each length has an index of its own.
    Rows that repeat an id are separate vectors; an empty table gives no rows; other columns are ignored.
    """
    c = F.col
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[label_col].alias("label"), vectors[vector_col].alias("vector"))
    rows = rows.withColumns({"head": F.xxhash64("vector"), "tail": F.xxhash64(F.lit(1), c("vector"))})
    fine = linkable("label", "vector")
    kinds = rows.filter(fine).groupBy(F.size("vector").alias("d")).agg(
        F.count("*").alias("size"), F.approx_count_distinct("label").alias("labels"), F.approx_count_distinct("head").alias("different")
    )
    # a vector that is the only one of its length has none to meet
    kinds = sorted(kinds.filter("size > 1").collect())
    if not kinds:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), c("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    named = reduce(DataFrame.union, [_of_length(rows, r.d, r.size, max(r.labels, 1), r.different, cosine) for r in kinds])
    # a vector without links or copies stands alone
    joined = rows.select("vec_id", F.when(fine, c("label")).alias("label"), "head", "tail").join(named.hint("merge"), ["label", "head", "tail"], "left")
    out = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(c("n_links").isNull(), c("vec_id")).otherwise(c("component_id")).alias("component_id"))
    return out.withColumn("kept", c("vec_id").eqNullSafe(c("component_id")))
