"""Removal of byte strings that occur elsewhere, by prefix-free parsing.

Rolling-hash triggers cut texts into phrases that overlap.  A trigger is the least hash of some ``LENGTH``-byte string, so every
such string has one, and equal strings have it at the same place: a string lies in the phrase of its trigger.  The dictionary
holds each distinct phrase once with its number of occurrences.  A phrase that occurs twice is repeated as a whole; one whose
trigger occurs nowhere else holds nothing repeated.  Only the other phrases of a trigger, those that share some bytes, are put in
corpus order: a second, finer parse of theirs, the suffix array of its dictionary and that of its parse give the order of their
suffixes, in which equal strings are neighbours.  Phrases of a very common trigger are first cut again, by their strings' distance
from the trigger, into pieces whose new trigger is what the strings of a piece have in common, and so on until few share one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import stored

#: Bytes of a string that must not occur twice.
LENGTH = 400
#: Bytes under the rolling hash.
WINDOW = 64
#: Bytes of text that a task parses at a time, and of phrases that it puts in order at a time.
SLICE_BYTES, ORDER_BYTES = 4 << 20, 1 << 20
#: Phrases with one trigger that are put in order in one task; more are cut again, into pieces of so many strings.
TOGETHER, STEPS = 512, (32, 4, 1)
#: The finer parse: bytes under its hash and bytes per phrase on average.
FINE_WINDOW, FINE_STEP = 8, 32

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def rolling(data: np.ndarray, window: int) -> np.ndarray:
    """Hash of the ``window`` bytes (a power of two) from each place: polynomial hashes of twice the length, step by step, then mixed."""
    h, base, size = data.astype(np.uint64) + np.uint64(1), _BASE, 1
    with np.errstate(over="ignore"):
        while size < window:
            h = h[:-size] * base + h[size:]
            base, size = base * base, size * 2
        h *= _MIX
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
    return h


def least(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value among each ``width`` neighbours, from running minima in blocks from either side."""
    blocks = -(-len(h) // width)
    table = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    table[: len(h)] = h
    table = table.reshape(blocks, width)
    place = np.arange(blocks * width).reshape(blocks, width)
    low = np.minimum.accumulate(table, 1)
    new = np.ones(table.shape, bool)
    new[:, 1:] = table[:, 1:] < low[:, :-1]
    to_here = np.maximum.accumulate(np.where(new, place, 0), 1).ravel()
    high = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1]
    new[:, -1], new[:, :-1] = True, table[:, :-1] <= high[:, 1:]
    from_here = np.minimum.accumulate(np.where(new, place, blocks * width)[:, ::-1], 1)[:, ::-1].ravel()
    count = len(h) - width + 1
    end = slice(width - 1, width - 1 + count)
    return np.where(high.ravel()[:count] <= low.ravel()[end], from_here[:count], to_here[end])


def phrases(texts: list[bytes], length: int = LENGTH) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts joined, and per phrase its text, first and last start of a string in it, trigger place and trigger hash."""
    raw = b"".join(texts)
    none = np.empty(0, np.int64)
    if len(raw) < length:
        return raw, none, none, none, none, none.astype(np.uint64)
    h = rolling(np.frombuffer(raw, np.uint8), min(WINDOW, 1 << (length.bit_length() - 1)))
    trigger = least(h, len(h) - (len(raw) - length))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(trigger)]
    starts = np.flatnonzero(np.arange(len(trigger)) <= ends[text] - length)
    if not len(starts):
        return raw, none, none, none, none, none.astype(np.uint64)
    at = trigger[starts]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    last = np.append(first[1:], len(at)) - 1
    return raw, text[starts[first]], starts[first], starts[last], at[first], h[at[first]]


def _order_of_ends(symbols: np.ndarray, row: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of rows of symbols by their first ``depth`` symbols, equal ones alike; a row's end comes first.

    Prefix doubling: ranks by 2k symbols come from pairs of ranks by k.
    """
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    n, k = len(rank), 1
    while k < depth:
        behind = np.zeros(n, np.int64)
        if k < n:
            behind[:-k] = np.where(row[:-k] == row[k:], rank[k:], 0)
        _, new = np.unique(rank * (n + 2) + behind, return_inverse=True)
        new = new.astype(np.int64) + 1
        if new.max(initial=0) == rank.max(initial=0):
            break
        rank, k = new, 2 * k
    return rank


def corpus_order(strings: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all ``length``-byte strings in suffix order: (string, place in it, equal to the one before).

    Triggers are hashes divisible by ``FINE_STEP``.  A phrase runs from a trigger to the end of the next one's window, so that
    no phrase end is the beginning of another and the order of suffixes is that of (rest of their phrase, parse from the next
    phrase on).  The former comes from the suffix array of the distinct phrases, the latter from that of the parse.
    """
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    raw = np.frombuffer(b"".join(strings), np.uint8)
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(strings)), sizes)
    cut = np.zeros(len(raw), bool)
    cut[begins[sizes > 0]] = True
    if len(raw) >= FINE_WINDOW:
        trigger = np.flatnonzero(rolling(raw, FINE_WINDOW) % np.uint64(FINE_STEP) == 0)
        cut[trigger[owner[trigger] == owner[trigger + FINE_WINDOW - 1]]] = True
    starts = np.flatnonzero(cut)
    of = owner[starts]
    text_end = (begins + sizes)[of]
    more = np.append(of[1:] == of[:-1], False)
    stops = np.where(more, np.minimum(np.append(starts[1:], 0) + FINE_WINDOW, text_end), text_end)
    # a phrase at the end of its text is told from one that goes on
    data = raw.tobytes()
    known: dict[tuple[bytes, bool], int] = {}
    word = np.fromiter((known.setdefault((data[a:b], m), len(known)) for a, b, m in zip(starts.tolist(), stops.tolist(), more.tolist())), np.int64, len(starts))
    words = [w for w, _ in known]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    rest = _order_of_ends(np.frombuffer(b"".join(words), np.uint8), np.repeat(np.arange(len(words)), lengths), length + FINE_WINDOW)
    heads = np.cumsum(lengths) - lengths
    # the parse, its phrases named by their place in the dictionary's order
    parse = _order_of_ends(rest[heads[word]] * 2 + more, of, length)
    follow = np.where(more, np.append(parse[1:], 0), 0)
    place = np.arange(len(raw)) - begins[owner]
    chosen = np.flatnonzero(place <= sizes[owner] - length)
    phrase = np.searchsorted(starts, chosen, side="right") - 1
    first = rest[heads[word[phrase]] + chosen - starts[phrase]]
    order = np.lexsort((follow[phrase], first))
    chosen = chosen[order]
    same = np.zeros(len(chosen), bool)
    view = np.lib.stride_tricks.sliding_window_view(raw, length) if len(raw) >= length else raw
    for i in range(1, len(chosen), 1 << 14):
        part = slice(i, min(i + (1 << 14), len(chosen)))
        before = chosen[part.start - 1 : part.stop - 1]
        same[part] = (view[chosen[part]] == view[before]).all(axis=1)
    return owner[chosen], place[chosen], same


def repeated(strings: list[bytes], counts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """Per string the places where a ``length``-byte string starts that occurs twice, a string counted as often as it occurs."""
    owner, place, same = corpus_order(strings, length)
    group = np.cumsum(~same)
    total = np.bincount(group, weights=np.asarray(counts, float)[owner])
    hit = total[group] >= 2
    order = np.lexsort((place[hit], owner[hit]))
    owner, place = owner[hit][order], place[hit][order]
    return np.split(place, np.searchsorted(owner, np.arange(1, len(strings))))


def runs(places: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of neighbouring places."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.append(0, cut + 1)].tolist(), places[np.append(cut, len(places) - 1)].tolist()))


def _name(doc_id: Column, text: Column) -> list[Column]:
    """Two 64-bit hashes that name a row; rows alike in id and text have alike results, so they may share a name."""
    return [F.xxhash64(doc_id, text).alias("u"), F.xxhash64(text, F.lit(1), doc_id).alias("v")]


def _halves(digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]


def _texts(batches, limit: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    us, vs, texts, held = [], [], [], 0
    for batch in batches:
        for u, v, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            us.append(u)
            vs.append(v)
            texts.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
            held += len(texts[-1])
            if held >= limit:
                yield us, vs, texts
                us, vs, texts, held = [], [], [], 0
    if texts:
        yield us, vs, texts


def parsed(rows: DataFrame, length: int = LENGTH, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The parse: (u, v, first, last, at, key, hi, lo) per phrase of every text: where its strings start, its trigger's place
    in it, the trigger's hash and a 128-bit digest of its bytes."""
    schema = "u long, v long, first long, last long, at int, key long, hi long, lo long"

    def run(batches):
        for us, vs, texts in _texts(batches, slice_bytes):
            raw, text, first, last, at, key = phrases(texts, length)
            if not len(text):
                continue
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            begins = np.cumsum(sizes) - sizes
            view = memoryview(raw)
            digests = [xxhash.xxh3_128_digest(view[a : b + length]) for a, b in zip(first.tolist(), last.tolist())]
            arrays = [
                pa.array(np.array(us, np.int64)[text]), pa.array(np.array(vs, np.int64)[text]), pa.array(first - begins[text]), pa.array(last - begins[text]),
                pa.array((at - first).astype(np.int32)), pa.array(key.view(np.int64)), *_halves(digests),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["u", "v", "first", "last", "at", "key", "hi", "lo"])

    return rows.select("u", "v", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


FOUND = "key long, hi long, lo long, starts array<struct<first:int,last:int>>"
_SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32())])


def _found(keys: list[tuple], places: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    spans = [[{"first": a, "last": b} for a, b in p] for p in places]
    columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(3)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.list_(_SPAN))], names=["key", "hi", "lo", "starts"])


def _ordered(entries: DataFrame, length: int) -> DataFrame:
    """Repeated starts in dictionary entries that come sorted by key; entries of a key stay together in a bounded slice."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def settle():
            strings, counts = [e[4] for e in held], [e[3] for e in held]
            marks = [runs(p) for p in repeated(strings, counts, length)]
            live = [i for i, m in enumerate(marks) if m]
            return _found([held[i][:3] for i in live], [marks[i] for i in live]) if live else None

        for batch in batches:
            for entry in zip(*(c.to_pylist() for c in batch.columns)):
                if held and size >= ORDER_BYTES and entry[0] != held[-1][0]:
                    done = settle()
                    if done is not None:
                        yield done
                    held, size = [], 0
                held.append(entry)
                size += len(entry[4])
        if held:
            done = settle()
            if done is not None:
                yield done

    return entries.select("key", "hi", "lo", "n", "bytes").mapInArrow(run, FOUND)


def _cut(entries: DataFrame, length: int, step: int) -> DataFrame:
    """A finer parse of phrases: a piece has the strings whose distance from the trigger has one quotient by ``step``, its key is
    the hash of the bytes that all strings of that quotient share.  Equal strings are as far from it, so they have one key."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            digests = []
            for u, v, w, n, at, data in zip(*(c.to_pylist() for c in batch.columns)):
                view, nearest = memoryview(data), at - (len(data) - length)
                for k in range(nearest // step, at // step + 1):
                    first, last = at - min(at, k * step + step - 1), at - max(nearest, k * step)
                    shared = view[at - k * step :][: max(length - step + 1, 0)]
                    key = xxhash.xxh3_64_intdigest(shared, (u ^ k) & 0xFFFFFFFFFFFFFFFF)
                    digests.append(xxhash.xxh3_128_digest(view[first : last + length]))
                    for column, x in zip(out, (u, v, w, n, first, last, at - first, key - (key >> 63 << 64))):
                        column.append(x)
            if digests:
                kinds = [pa.int64()] * 6 + [pa.int32(), pa.int64()]
                arrays = [*(pa.array(x, kind) for x, kind in zip(out, kinds)), *_halves(digests)]
                yield pa.RecordBatch.from_arrays(arrays, names=["u", "v", "w", "n", "first", "last", "at", "key", "hi", "lo"])

    return entries.select("u", "v", "w", "n", "at", "text").mapInArrow(run, "u long, v long, w long, n long, first long, last long, at int, key long, hi long, lo long")


def _settled(rows: DataFrame, parse: DataFrame, name: list[str], length: int, together: int, steps: tuple[int, ...]) -> DataFrame:
    """(name, spans) of texts with repeated strings, from their parse; a phrase with ``n`` occurs so often."""
    c, phrase = F.col, ["key", "hi", "lo"]
    entries = parse.groupBy(*phrase).agg(F.sum("n").alias("n"), F.min(F.struct(*name, "first", "last", "at")).alias("where"))
    entries = stored(entries, "dictionary")
    # a trigger's phrases: their number and that of their occurrences
    common = entries.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).filter(c("all") > 1)
    entries = stored(entries.join(common.hint("merge"), "key"), "shared-phrases")
    again = entries.filter("n > 1").select(*phrase, F.array(F.struct(F.lit(0).alias("first"), (c("where.last") - c("where.first")).cast("int").alias("last"))).alias("starts"))
    unclear = entries.filter("kinds > 1")
    wanted = unclear.groupBy(*[f"where.{x}" for x in name]).agg(F.collect_list(F.struct(*phrase, "n", "kinds", c("where.first").alias("first"), c("where.last").alias("last"), c("where.at").alias("at"))).alias("pieces"))
    texts = rows.join(wanted.hint("merge"), name).select(F.col("text").cast("binary").alias("text"), "pieces")
    piece = texts.select("text", F.explode("pieces").alias("p"))
    # rows alike in id and text give the same pieces again
    whole = piece.select("p.key", "p.hi", "p.lo", "p.n", "p.kinds", "p.at", F.expr(f"substring(text, int(p.first) + 1, int(p.last - p.first) + {length})").alias("bytes"))
    whole = stored(whole.dropDuplicates(phrase), "unclear-phrases")
    # cut into single strings, only phrases whose hashes collide share a key
    few = whole.filter(c("kinds") <= together) if steps else whole
    found = again.unionByName(_ordered(few.repartition("key").sortWithinPartitions("key"), length))
    many = whole.filter(c("kinds") > together)
    if steps and not many.isEmpty():
        many = many.select(c("key").alias("u"), c("hi").alias("v"), c("lo").alias("w"), "n", "at", c("bytes").alias("text"))
        finer = _settled(many, stored(_cut(many, length, steps[0]), "pieces"), ["u", "v", "w"], length, together, steps[1:])
        found = found.unionByName(finer.select(c("u").alias("key"), c("v").alias("hi"), c("w").alias("lo"), c("spans").cast("array<struct<first:int,last:int>>").alias("starts")))
    found = stored(found, "repeated-phrases")
    hits = parse.join(found.hint("merge"), phrase).select(
        *name, F.explode(F.transform("starts", lambda s: F.struct((c("first") + s["first"]).alias("first"), (c("first") + s["last"]).alias("last")))).alias("span")
    )
    return hits.groupBy(*name).agg(F.collect_set("span").alias("spans"))


def starts_of_repeats(rows: DataFrame, length: int = LENGTH, together: int = TOGETHER, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(u, v, spans) per row name with repeated strings: first and last starts of runs of them."""
    parse = stored(parsed(rows, length, slice_bytes), "parse").withColumn("n", F.lit(1))
    return _settled(rows, parse, ["u", "v"], length, together, STEPS)


SCHEMA = "doc_id {id}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False,
    together: int = TOGETHER, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) per row: UTF-8 bytes covered by a string of ``length`` bytes that
    also starts elsewhere are removed; strings are judged on the input and never cross rows.

    A null text is empty, one shorter than ``length`` stays whole; repeated rows repeat each other's strings; null and repeated
    ids keep a row each; an empty table gives no rows; other columns are ignored.  Very long texts are parsed one at a time.
    Equality of whole phrases and pieces goes by 128-bit digests; strings within them are compared byte by byte.
    """
    c = F.col
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *_name(c("doc_id"), c("text")))
    spans = starts_of_repeats(rows, length, together, slice_bytes)
    kind = rows.schema["doc_id"].dataType
    joined = rows.join(spans.hint("merge"), ["u", "v"], "left").select("doc_id", c("text").cast("binary").alias("text"), "spans.first", "spans.last")
    schema = SCHEMA.format(id=kind.simpleString()) + (", kept binary" if with_text else "")
    names = [f.split()[0] for f in schema.split(", ")]
    arrow = to_arrow_type(kind)

    def run(batches):
        for batch in batches:
            out = []
            for text, first, last in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                data = text.as_buffer().to_pybytes()
                kept, removed, spans, end = [], 0, 0, 0
                for a, b in sorted(zip(first or (), last or ())):
                    if a > end or not spans:
                        kept.append(data[end:a])
                        spans += 1
                        end = a
                    removed += max(b + length - end, 0)
                    end = max(end, b + length)
                kept = b"".join([*kept, data[end:]])
                out.append((len(data), removed, spans, hashlib.sha256(kept).hexdigest(), *((kept,) if with_text else ())))
            arrays = [batch.column(0).cast(arrow), *[pa.array(list(x)) for x in zip(*out)]]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return joined.mapInArrow(run, schema)
