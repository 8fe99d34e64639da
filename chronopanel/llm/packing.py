"""Packing of documents into token windows: best-fit decreasing with a segment tree over remaining capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .common import SLICE_BYTES, slices
from .units import Ragged, number

WINDOW = 2048
END = 1
#: Bytes of joined units given to the tokenizer in one string.
CHUNK = 1 << 16


class OpenWindows:
    """Open windows by remaining capacity; a segment tree of counts finds the tightest that still fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.at[capacity].append(window)
        i = capacity + self.size
        while i:
            self.tree[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest window with at least ``need`` free, removed from the tree."""
        tree, i = self.tree, need + self.size
        while not tree[i]:
            while i & 1:
                i >>= 1
                if i <= 1:
                    return None
            i += 1
        while i < self.size:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        capacity = i - self.size
        while i:
            tree[i] -= 1
            i >>= 1
        return capacity, self.at[capacity].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Numbers of the pieces in each window: longest first, each into the tightest open window."""
    opened = OpenWindows(window)
    out: list[list[int]] = []
    for n in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = opened.take(lengths[n])
        capacity, k = found or (window, len(out))
        if found is None:
            out.append([])
        out[k].append(n)
        if capacity > lengths[n]:
            opened.put(capacity - lengths[n], k)
    return out


def top_up(windows: list[list[tuple[int, int, int]]], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Fill the gaps of the fuller windows with cuts from the emptiest ones; what is left over goes into sequences whose
    lengths are powers of two, which need no padding.  Pieces are (document, start, length)."""
    room = lambda w: window - sum(p[2] for p in w)
    full = [w for w in windows if not room(w)]
    rest = sorted((w for w in windows if room(w)), key=room)
    loose: list[tuple[int, int, int]] = []
    while rest:
        if not loose:
            loose = rest.pop()
            continue
        gap = room(rest[0])
        doc, start, length = loose.pop()
        used = min(gap, length)
        rest[0].append((doc, start, used))
        if used < length:
            loose.append((doc, start + used, length - used))
        if used == gap:
            full.append(rest.pop(0))
    left = sum(p[2] for p in loose)
    while left:
        target = 1 << (left.bit_length() - 1)
        left -= target
        new = []
        while target:
            doc, start, length = loose.pop()
            used = min(target, length)
            new.append((doc, start, used))
            if used < length:
                loose.append((doc, start + used, length - used))
            target -= used
        full.append(new)
    return full


class UnitTokenizer:
    """Token ids of distinct units by the ``tokenizers`` library.  The file's path must exist on every executor.

    A text that holds a special token is given to the library whole, as the token cuts it elsewhere than spaces do; with
    ``literal`` special tokens count as ordinary text.
    """

    def __init__(self, path: str, literal: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = literal
        self.special = [] if literal else [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.bytes_of = np.array([len(self.model.id_to_token(i) or "") for i in range(self.model.get_vocab_size())], np.int64)

    def spaced(self, units: list[str]) -> Ragged:
        """Units are joined into longer strings, as no token crosses from one into the next; the byte lengths of the tokens
        tell where each unit ends."""
        flat, lengths, i = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        while i < len(units):
            j, held = i, 0
            while j < len(units) and (held < CHUNK or j == i):
                held += len(units[j]) + 1
                j += 1
            part = units[i:j]
            ids = np.array(self.model.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.cumsum(np.fromiter((len(u.encode()) + 1 for u in part), np.int64, len(part)))
            token_ends = np.cumsum(self.bytes_of[ids])
            last = np.searchsorted(token_ends, ends)
            if (token_ends[last] != ends).any():
                raise ValueError("a token crosses the end of a unit")
            flat.append(ids)
            lengths.append(np.diff(last, prepend=-1))
            i = j
        return Ragged(np.concatenate(flat), np.concatenate(lengths))

    def heads(self, units: list[str]) -> Ragged:
        rows = [np.array(e.ids, np.int64) for e in self.model.encode_batch_fast(units, add_special_tokens=False)]
        return Ragged(np.concatenate([np.empty(0, np.int64), *rows]), np.fromiter(map(len, rows), np.int64, len(rows)))

    def documents(self, texts: list[str]) -> Iterator[np.ndarray]:
        whole = {i for token in self.special for i, t in enumerate(texts) if token in t}
        docs, spaced, heads = number(["" if i in whole else t for i, t in enumerate(texts)] if whole else texts)
        # first units follow the spaced ones in reverse, so that -1 - n counts from the end
        a, b = self.spaced(spaced), self.heads(heads[::-1])
        table = Ragged(np.concatenate([a.flat, b.flat]), np.concatenate([a.lengths, b.lengths]))
        for i, row in enumerate(docs):
            if i in whole:
                yield np.array(self.model.encode(texts[i], add_special_tokens=False).ids, np.int64)
            else:
                yield table.gather(row)


@lru_cache(maxsize=2)
def tokenizer(path: str, literal: bool = False) -> UnitTokenizer:
    return UnitTokenizer(path, literal)


FIELDS = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_ids: bool = False, slice_bytes: int = SLICE_BYTES, literal: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``window`` tokens.

    Every task packs bounded slices of its own rows, so nothing is shuffled and no window is shared between tasks.  In a
    slice, overlong documents give full windows first; the remainders are packed best-fit decreasing; then the last gaps are
    filled by cuts.  A null text is empty and holds the end token alone; equal ids or texts stay separate documents; an empty
    table gives no rows; other columns are ignored.  A very long text is a slice of its own, worked on whole.  ``with_ids`` adds
    the token ids of each piece; ``literal`` takes the special tokens' own text for ordinary text.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    key_type = to_arrow_type(rows.schema["doc_id"].dataType)
    schema = FIELDS.format(id=rows.schema["doc_id"].dataType.simpleString()) + (", ids array<int>" if with_ids else "")

    def pack(batches):
        model = tokenizer(path, literal)
        number_of = TaskContext.get().partitionId() << 33
        for keys, texts in slices(batches, slice_bytes):
            ids: list[np.ndarray] = []
            full: list[list[tuple[int, int, int]]] = []
            rest: list[tuple[int, int, int]] = []
            for k, found in enumerate(model.documents(texts)):
                ids.append(np.append(found, END).astype("<u4"))
                whole = len(ids[k]) // window * window
                full += [[(k, s, window)] for s in range(0, whole, window)]
                if whole < len(ids[k]):
                    rest.append((k, whole, len(ids[k]) - whole))
            shared = [[rest[i] for i in w] for w in best_fit([p[2] for p in rest], window)]
            out: list[tuple] = []
            for sequence in full + top_up(shared, window):
                offset = 0
                for k, start, length in sequence:
                    part = ids[k][start : start + length]
                    row = (keys[k], start, length, zlib.crc32(part.tobytes()), len(ids[k]), number_of, offset)
                    out.append(row + (part.astype(np.int32),) if with_ids else row)
                    offset += length
                number_of += 1
                if len(out) >= 10_000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(out[0])]
        key, *others = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(key, key_type), *[pa.array(list(c)) for c in others]], names=names)

    return rows.mapInArrow(pack, schema)
