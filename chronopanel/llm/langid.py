"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import numbered, slices
from .units import Numbers, Ragged

#: N-grams in a profile, and of a document that are compared.
PROFILE = 300
UNKNOWN = "und"
_WORDS = regex.compile(r"\p{L}+")
_BITS = 21
#: Bytes of text whose grams a task counts at a time.
SLICE_BYTES = 6 << 20


class Grams:
    """N-grams of one to three letters of every distinct white-space unit of some texts.

    A word is a run of letters in lower case with one blank at either end; a gram is its code points packed into one number,
    so numbers sort like the grams.
    """

    def __init__(self, texts: list[str]):
        units = Numbers()
        of = units.__getitem__
        self.docs = [np.fromiter(map(of, parts), np.int64, len(parts)) for parts in map(str.split, texts)]
        words, owner = [], []
        for n, unit in enumerate(units):
            for word in _WORDS.findall(unit.lower()):
                words.append(word)
                owner.append(n)
        points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), "<u4")
        letters, ids = numbered(points, 0x110000)
        blank = points == 32
        base = len(letters) + 1
        # three grams begin at every position but the last two; zero stands for no letter
        ids = np.concatenate([ids.astype(np.int64) + 1, [0, 0]])
        first = ids[:-2] * base * base
        begun = np.stack([first, first + ids[1:-1] * base, first + ids[1:-1] * base + ids[2:]], axis=1)
        behind = np.append(blank[1:], True)
        room = np.arange(len(points))
        keep = np.stack([~blank, ~(blank & behind) & (room < len(points) - 1), ~behind & (room < len(points) - 2)], axis=1)
        distinct, flat = numbered(begun[keep], base**3)
        parts = np.stack([distinct // base**2, distinct // base % base, distinct % base])
        points_of = np.concatenate([[0], letters])[parts]
        self.codes = points_of[0] << 2 * _BITS | points_of[1] << _BITS | points_of[2]
        # a blank belongs to the word behind it
        unit_at = np.append(np.array(owner, np.int64), 0)[np.minimum(np.cumsum(blank) - 1, len(owner))]
        self.units = Ragged(flat, np.bincount(unit_at, weights=keep.sum(axis=1), minlength=max(1, len(units))).astype(np.int64))
        self.of_unit = np.repeat(np.arange(len(self.units.lengths)), self.units.lengths)

    def totals(self, docs: list[int]) -> np.ndarray:
        """Counts of all grams in the chosen documents together."""
        seen = np.bincount(np.concatenate([self.docs[d] for d in docs]), minlength=len(self.units.lengths))
        return np.bincount(self.units.flat, weights=seen[self.of_unit], minlength=len(self.codes)).astype(np.int64)

    def top(self, doc: int, most: int) -> np.ndarray:
        """Grams of a document by falling count, then by code."""
        counts = np.bincount(self.units.gather(self.docs[doc]), minlength=0)
        found = np.flatnonzero(counts)
        key = (-counts[found] << 32) | found
        if len(key) > most:
            key = np.partition(key, most - 1)[:most]
        return np.sort(key) & 0xFFFFFFFF


def profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> dict[str, np.ndarray]:
    """The ``size`` most frequent grams of each language over all labelled texts, most frequent first.

    Tasks count their own rows and send one row per language and gram.  What reaches the driver is the profile, ``size``
    numbers for each language name.
    """
    rows = labelled.select(labelled[lang_col].alias("lang"), labelled[text_col].alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches):
        sums: dict[str, dict] = defaultdict(lambda: defaultdict(int))
        for langs, texts in slices(batches, SLICE_BYTES):
            grams = Grams(texts)
            by = defaultdict(list)
            for n, lang in enumerate(langs):
                by[lang].append(n)
            for lang, docs in by.items():
                total = grams.totals(docs)
                held = sums[lang]
                for k in np.flatnonzero(total):
                    held[int(grams.codes[k])] += int(total[k])
        for lang, held in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(held), pa.string()), pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["lang", "gram", "n"]
            )

    counts = stored(rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    best = lambda lang: counts.filter(F.col("lang") == lang).orderBy(F.desc("n"), "gram").select("gram").limit(size).collect()
    return {lang: np.array([r.gram for r in best(lang)], np.int64) for lang in langs}


def predicted(docs: DataFrame, known: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """(doc_id, lang_pred, score) per row of ``docs``, as by ``tagged``."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return tagged(rows, known, "text", size).select("doc_id", "lang_pred", "score")


def tagged(docs: DataFrame, known: dict[str, np.ndarray], text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """``docs`` with lang_pred and score: the language with the smallest out-of-place distance.

    A gram of the document adds the distance between its two ranks, or ``size`` where the profile lacks it; the score is one
    less the distance over the largest possible.  Ties go to the language that sorts first.  Texts that are null or have no
    letter, and all texts where no language is known, give ``und`` with score zero.  Rows keep repeated ids; an empty table
    gives no rows; other columns are ignored.
    """
    langs = sorted(known)

    def judged(texts: list[str]) -> tuple[list[str], list[float]]:
        grams = Grams(texts)
        ranks = np.full((len(langs), len(grams.codes)), size, np.int64)
        for n, lang in enumerate(langs):
            at = np.searchsorted(grams.codes, known[lang])
            inside = at < len(grams.codes)
            inside[inside] = grams.codes[at[inside]] == known[lang][inside]
            ranks[n, at[inside]] = np.flatnonzero(inside)
        names, scores = [], []
        for doc in range(len(texts)):
            top = grams.top(doc, size)
            if not len(top) or not langs:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            mine = ranks[:, top]
            distance = np.where(mine < size, np.abs(mine - np.arange(len(top))), size).sum(axis=1)
            names.append(langs[int(distance.argmin())])
            scores.append(1.0 - float(distance.min()) / (size * len(top)))
        return names, scores

    @F.pandas_udf("lang_pred string, score double")
    def judge(column: pd.Series) -> pd.DataFrame:
        names, scores = [], []
        for texts in text_slices(column):
            n, s = judged(texts)
            names += n
            scores += s
        return pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype=float)})

    # said to be nondeterministic, so that a filter on its result doesn't run it a second time
    judge = judge.asNondeterministic()
    held = docs.withColumn("_judged", judge(docs[text_col]))
    return held.withColumns({"lang_pred": F.col("_judged.lang_pred"), "score": F.col("_judged.score")}).drop("_judged")


def lettered(text_col):
    """Whether a text has a letter; a null has none."""

    @F.pandas_udf("boolean")
    def found(column: pd.Series) -> pd.Series:
        return pd.Series([isinstance(t, str) and _WORDS.search(t) is not None for t in column], dtype=bool)

    return found(text_col)


def text_slices(column: pd.Series, limit: int = SLICE_BYTES) -> Iterator[list[str]]:
    held, size = [], 0
    for text in column:
        held.append(text if isinstance(text, str) else "")
        size += len(held[-1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def held_out(id_col):
    """Whether a document is kept from learning: crc32 of its id as text leaves remainder one; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    return profiles(docs.filter(~held_out(docs[id_col])), text_col, lang_col)
