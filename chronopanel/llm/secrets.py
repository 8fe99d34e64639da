"""Secret scans: fixed key patterns, and sliding-window entropy over the remaining candidate strings."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Sequence
from math import log2

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The base patterns and least lengths that results must agree on.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20
KINDS = ("assign", "access", "hex", "entropy")
#: Every assignment holds one of these in some case; a text without them is not searched for assignments.
MARKS = ("passw", "secret", "token", "api")

#: Character class, pattern of its candidate strings, bits per character that a window must reach.
WINDOW = 24
CLASSES = (
    ("hex", re.compile(r"[0-9A-Fa-f]{%d,}" % WINDOW), 3.0),
    ("base64", re.compile(r"[A-Za-z0-9+/=_-]{%d,}" % WINDOW), 3.8),
)
#: Windows that share a character with a match of any of these are not secrets; nor are those that begin right behind it, if
#: its number is 1.
ALLOWED = (
    (re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"), 0),
    (re.compile(r"example|sample|placeholder|dummy|changeme|abcdefgh|0123456789", re.IGNORECASE), 1),
)
_WEIGHT = [0.0] + [n * log2(n) for n in range(1, WINDOW + 1)]


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself), leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(m in low for m in MARKS):
        out += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def merged(ranges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as ranges in order that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def outside(start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What ``taken``, as ``merged`` gives it, leaves of a range."""
    out = []
    for s, e in taken[max(bisect_right(taken, (start,)) - 1, 0) :]:
        if s >= end:
            break
        if s > start:
            out.append((start, s))
        start = max(start, e)
    return [*out, (start, end)] if start < end else out


def dense_runs(string: str, threshold: float, window: int = WINDOW, allowed: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Unions of the windows that reach ``threshold`` bits per character, hold both a letter and a digit and share no character
    with the ranges ``allowed``, as ``merged`` gives them.

    The window slides by one character: only the counts of the one that leaves and the one that enters change.
    """
    counts: dict[str, int] = {}
    mass, digits, letters = 0.0, 0, 0
    runs: list[list[int]] = []
    least = log2(window) - threshold
    at = 0
    for i, ch in enumerate(string):
        if i >= window:
            old = string[i - window]
            n = counts[old]
            mass += _WEIGHT[n - 1] - _WEIGHT[n]
            counts[old] = n - 1
            digits -= old.isdigit()
            letters -= old.isalpha()
        n = counts.get(ch, 0)
        mass += _WEIGHT[n + 1] - _WEIGHT[n]
        counts[ch] = n + 1
        digits += ch.isdigit()
        letters += ch.isalpha()
        if i >= window - 1 and digits and letters and mass <= least * window + 1e-9:
            start = i - window + 1
            while at < len(allowed) and allowed[at][1] <= start:
                at += 1
            if at < len(allowed) and allowed[at][0] <= i:
                continue
            if runs and start <= runs[-1][1]:
                runs[-1][1] = i + 1
            else:
                runs.append([start, i + 1])
    return [(s, e) for s, e in runs]


def entropy_spans(text: str, base: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """Dense runs, less what base spans or runs of an earlier class cover; the parts that are left count one by one."""
    out: list[tuple[str, int, int, int]] = []
    widest = CLASSES[-1][1]  # holds the characters of all classes
    candidates = [
        (c.span(), merged([(m.start(), m.end() + behind) for a, behind in ALLOWED for m in a.finditer(text, *c.span())]))
        for c in widest.finditer(text)
    ]
    taken = merged([x[1:3] for x in base]) if candidates else []
    for _, pattern, threshold in CLASSES:
        found: list[tuple[int, int]] = []
        for span, allowed in candidates:
            for m in pattern.finditer(text, *span):
                at = m.start()
                for s, e in dense_runs(m.group(), threshold, allowed=[(a - at, b - at) for a, b in allowed]):
                    found += outside(s + at, e + at, taken)
        out += [("entropy", s, e, s) for s, e in found]
        taken = merged([*taken, *found])
    return out


def spans(text: str | None) -> list[tuple[str, int, int, int]]:
    """All spans by start, then kind; code points, end exclusive."""
    text = text or ""
    base = base_spans(text)
    return sorted(base + entropy_spans(text, base), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPAN = "array<struct<kind:string,start:long,end:long,secret:long>>"


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) per row, each span with its kind, start, end and the start of the secret inside it.

    A null text is empty and has no spans; repeated rows are scanned each; an empty table gives no rows; other columns are
    ignored.  Whole texts are scanned where they lie, so nothing is shuffled.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.int64())]))

    def run(batches):
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "secret"), s)) for s in spans(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, item)], names=["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPAN}")


def cleared(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with every secret replaced; overlapping ones count as one."""
    if text is None:
        return None
    joined: list[list[int]] = []
    for _, _, end, start in sorted(spans(text), key=lambda s: (s[3], s[2])):
        if joined and start < joined[-1][1]:
            joined[-1][1] = max(end, joined[-1][1])
        else:
            joined.append([start, end])
    out, at = [], 0
    for s, e in joined:
        out += [text[at:s], mask]
        at = e
    return "".join([*out, text[at:]]) if joined else text


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with the secrets in its texts replaced and, if a length column is named, the new number of characters there.

    All rows and columns stay; null texts stay null.
    """

    @F.pandas_udf(T.StringType())
    def clear(texts: pd.Series) -> pd.Series:
        return pd.Series([cleared(t) for t in texts], dtype=object)

    # said to be nondeterministic, so that the length doesn't run it a second time
    out = docs.withColumn(text_col, clear.asNondeterministic()(text_col))
    if length_col is not None:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.char_length(text_col)).cast(kind))
    return out
