"""Removal of repeated byte strings against counting every string."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from chronopanel.llm import repeats


def plain(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for key, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        spans = int((gone[:-1] & ~np.append(False, gone[:-1])[:-1]).sum())
        out.append((key, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def text(r, n, letters="abcdefgh "):
    return "".join(r.choice(letters) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    shared = [text(r, r.randint(20, 700)) for _ in range(6)]
    out = []
    for i in range(60):
        parts = [r.choice([text(r, r.randint(0, 300)), r.choice(shared), r.choice(shared)[r.randint(0, 50) :]]) for _ in range(r.randint(0, 6))]
        out.append((i, "".join(parts)))
    out += out[:5]  # repeated rows
    out += [(None, None), (None, out[3][1]), (7, ""), (300, "x" * 3000), (301, "ab" * 700 + "é" * 500), (302, "x" * 399), (303, "x" * 400), (304, "🙂" * 100 + "z")]
    return out


@pytest.mark.parametrize("length,options", [(400, {}), (400, {"together": 1, "slice_bytes": 500}), (64, {}), (64, {"together": 1}), (130, {"slice_bytes": 4000})])
def test_removed_bytes(spark, rows, length, options):
    docs = spark.createDataFrame([(i, t, "u", 1, 2.0) for i, t in rows], "doc_id long, text string, key string, n int, first double").repartition(3)
    out = repeats.without_repeats(docs, length=length, with_text=True, **options).collect()
    assert sorted((tuple(x)[:5] for x in out), key=str) == plain(rows, length)
    assert all(hashlib.sha256(x.kept).hexdigest() == x.kept_sha256 and x.n_bytes - x.n_removed == len(x.kept) for x in out)


def test_string_ids_no_rows_and_nothing_long(spark):
    docs = spark.createDataFrame([("a", "y" * 500), ("b", None), ("c", "short")], "doc_id string, text string")
    assert {x.doc_id: (x.n_removed, x.n_spans) for x in repeats.without_repeats(docs).collect()} == {"a": (500, 1), "b": (0, 0), "c": (0, 0)}
    assert repeats.without_repeats(docs.limit(0)).collect() == []
    assert [x.n_removed for x in repeats.without_repeats(docs.filter("doc_id <> 'a'")).collect()] == [0, 0]


def test_one_very_long_text(spark):
    """A megabyte with one passage twice, and a long run of spaces."""
    r = random.Random(9)
    body = text(r, 300_000, "abcdefghijklmnopqrstuvwxyz")
    long = body + body[1000:1450] + text(r, 300_000, "abcdefghijklmnopqrstuvwxyz")
    docs = spark.createDataFrame([(1, long), (2, " " * 200_000)], "doc_id long, text string")
    assert {x.doc_id: (x.n_removed, x.n_spans) for x in repeats.without_repeats(docs).collect()} == {1: (900, 2), 2: (200_000, 1)}


def test_phrase_triggers_are_the_leftmost_least():
    r = np.random.default_rng(1)
    for width in (1, 2, 7, 30):
        h = r.integers(0, 6, 100).astype(np.uint64)
        assert repeats.least(h, width).tolist() == [i + int(np.argmin(h[i : i + width])) for i in range(len(h) - width + 1)]


@pytest.mark.parametrize("letters", ["ab", "a", "abcdefghijklmnop"])
def test_corpus_order_is_that_of_suffixes(letters):
    """Suffixes come in the order of (equal strings together), and neighbours are marked as equal exactly where they are."""
    r = random.Random(len(letters))
    part = text(r, 120, letters).encode()
    strings = [text(r, r.randint(0, 150), letters).encode() + part[: r.randint(0, 120)] + text(r, 20, letters).encode() for _ in range(12)] + [part, part, b""]
    length = 40
    owner, place, same = repeats.corpus_order(strings, length)
    found = [strings[o][p : p + length] for o, p in zip(owner.tolist(), place.tolist())]
    assert Counter(found) == Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
    assert [bool(x) for x in same] == [i > 0 and found[i] == found[i - 1] for i in range(len(found))]
    # equal strings are neighbours
    assert sum(not x for x in same) == len(set(found))


def test_common_triggers_are_cut_coarsely(spark):
    """A passage in many places, alone and in repeated surroundings: its phrases give a few pieces each, not a row per string."""
    r = random.Random(11)
    passage = text(r, 300, "abcdefghijklmnop ")
    around = [text(r, 200) for _ in range(4)]
    texts = [text(r, 300) + r.choice(["", around[0][-60:]]) + passage + r.choice(["", around[1][:90]]) + text(r, 300) for _ in range(60)]
    texts += [r.choice(around) + passage + r.choice(around) for _ in range(20)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    phrases = [(7, i, 0, 1, int(repeats.phrases([t.encode()])[4][0]), t.encode()) for i, t in enumerate(texts)]
    strings = sum(len(p[5]) - 399 for p in phrases)
    cut = spark.createDataFrame([(*p[:4], min(p[4], 336), p[5][: min(p[4], 336) + 400]) for p in phrases], "u long, v long, w long, n long, at int, text binary")
    pieces = repeats._cut(cut, 400, repeats.STEPS[0]).collect()
    assert len(pieces) <= 12 * len(texts) < strings / 8
    # every string is in one piece
    assert sum(p["last"] - p["first"] + 1 for p in pieces) == sum(min(p[4], 336) + 1 for p in phrases)
    for together in (2, 8):
        out = repeats.without_repeats(docs, together=together).collect()
        assert sorted((tuple(x) for x in out), key=str) == plain(rows, 400)
