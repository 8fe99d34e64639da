"""Byte-level BPE by replaying the merges over a whole slice of the corpus at once."""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import SLICE_BYTES, slices
from .units import Ragged, number

NONE = np.int64(1 << 40)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merges:
    """Rank of the token that two neighbouring tokens form, looked up for whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values(), default=0) + 1
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.bytes_of = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NONE) if len(self.keys) else np.full(len(key), NONE)


def replay(words: list[bytes], merges: Merges) -> Ragged:
    """Token ids of every word.

    All words lie in one linked list of symbols.  An inverted index leads from each rank to the positions whose pair forms
    that token; ranks are taken from a heap, lowest first, and a merge touches only the positions on either side.  All places
    of a rank merge together, left to right where they overlap, so a long word costs no more than many short ones; where a
    merge forms a pair of a lower rank, its word goes on from there later, since that pair goes first.  A word that is a
    token itself is one token.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    token = merges.of_byte[flat]
    size = len(token)
    word = np.repeat(np.arange(len(words)), lengths)
    nxt = np.arange(1, size + 1)
    prv = np.arange(-1, size - 1)
    ends = np.cumsum(lengths)
    nxt[ends[lengths > 0] - 1] = -1
    prv[(ends - lengths)[lengths > 0]] = -1
    pair = np.full(size, NONE)
    inner = np.flatnonzero(nxt >= 0)
    pair[inner] = merges.rank(token[inner], token[inner + 1])
    whole = [merges.ranks.get(w) for w in words]
    known = np.array([r is not None for r in whole], bool)
    pair[known[word]] = NONE

    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def add(places: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for rank, part in zip(ranks[np.append(0, cuts)].tolist(), np.split(places, cuts)):
            if rank in index:
                index[rank].append(part)
            else:
                index[rank] = [part]
                heapq.heappush(queue, rank)

    start = np.flatnonzero(pair < NONE)
    if len(start):
        add(start, pair[start])
    gone = np.zeros(size, bool)
    while queue:
        rank = heapq.heappop(queue)
        at = np.unique(np.concatenate(index.pop(rank)))
        at = at[pair[at] == rank]
        if not len(at):
            continue
        # of places that overlap in a row every second one merges
        linked = np.append(False, nxt[at[:-1]] == at[1:])
        row_start = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
        every, at = at, at[(np.arange(len(at)) - row_start) % 2 == 0]
        # tokens on either side as they are when a place merges: those to the left have merged by then
        beside = prv[at]
        near = np.append(False, nxt[nxt[at[:-1]]] == at[1:])
        left_token = np.where(near, rank, token[beside])
        end = nxt[nxt[at]]
        low = (beside >= 0) & (merges.rank(left_token, np.full(len(at), rank)) < rank)
        low |= (end >= 0) & (merges.rank(np.full(len(at), rank), token[end]) < rank)
        if low.any():
            of = word[at]
            stop_of, stop = np.unique(of[low], return_index=True)
            stop = at[low][stop]
            limit = np.full(len(words), size)
            limit[stop_of] = stop
            at = at[at <= limit[of]]
            index[rank] = [every[every > limit[word[every]]]]
            heapq.heappush(queue, rank)
        right = nxt[at]
        behind = nxt[right]
        token[at] = rank
        nxt[at] = behind
        gone[right] = True
        pair[right] = NONE
        has = behind >= 0
        prv[behind[has]] = at[has]
        pair[at] = NONE
        before = prv[at]
        left = before[before >= 0]
        touched = np.concatenate([at[has], left])
        if len(touched):
            new = merges.rank(token[touched], token[nxt[touched]])
            pair[touched] = new
            live = new < NONE
            if live.any():
                add(touched[live], new[live])
    # words that are tokens keep their first symbol alone
    head = (ends - lengths)[known]
    gone |= known[word]
    gone[head] = False
    token[head] = [r for r in whole if r is not None]
    return Ragged(token[~gone], np.bincount(word[~gone], minlength=len(words)) if len(words) else lengths)


@lru_cache(maxsize=2)
def load(path: str) -> Merges:
    return Merges(read_ranks(path))


def encode(texts: list[str], merges: Merges, pattern: regex.Pattern) -> list[np.ndarray]:
    """Ids of each text: its units, their words by the pattern, and the merges replayed over all distinct words together."""
    docs, spaced, heads = number(texts)
    words: dict[str, int] = {}
    of_unit, counts = [], []
    for unit in [f" {u}" for u in spaced] + heads[::-1]:
        found = pattern.findall(unit)
        counts.append(len(found))
        of_unit += [words.setdefault(w, len(words)) for w in found]
    ids = replay([w.encode("utf-8", "surrogatepass") for w in words], merges)
    parts = np.array(of_unit, np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    lengths = np.bincount(owner, weights=ids.lengths[parts], minlength=len(counts)).astype(np.int64)
    table = Ragged(ids.gather(parts), lengths)
    return [table.gather(row) for row in docs]


def coded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) per row, encoded and decoded again.

    The corpus is worked on in bounded slices of whole documents, so memory is bounded and nothing is shuffled; merges act
    inside words only, so slices don't change the ids; a very long text is a slice of its own, worked on whole.  ``path`` must exist on every executor.  A null text is empty and has
    no ids; repeated rows are coded each; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded binary" if with_ids else ""

    def run(batches):
        merges, compiled = load(path), regex.compile(pattern)
        bytes_of = merges.bytes_of.__getitem__
        for batch in batches:
            for keys, texts in slices([batch], slice_bytes):
                out = []
                for key, ids in zip(keys, encode(texts, merges, compiled)):
                    decoded = b"".join(map(bytes_of, ids.tolist()))
                    sha = [hashlib.sha256(x).hexdigest() for x in (ids.astype("<u4").tobytes(), decoded)]
                    out.append([key, len(ids), *sha, *((ids.astype(np.int32), decoded) if with_ids else ())])
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(out[0])]
                arrays = [pa.array(list(c)) for c in zip(*out)]
                arrays[0] = arrays[0].cast(batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(run, schema)


def decoded(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text as bytes) from token ids; null ids give no bytes, repeated rows a row each, an empty table none."""
    rows = ids.select(ids[id_col].alias("doc_id"), ids[ids_col].alias("ids"))

    def run(batches):
        bytes_of = load(path).bytes_of.__getitem__
        for b in batches:
            out = [b"".join(map(bytes_of, x.as_py() or [])) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text binary")
