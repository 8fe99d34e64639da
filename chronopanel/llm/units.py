"""Context-free units of a text: encode each distinct unit once, then put documents together by number.

The pre-tokenizer pattern of byte-level BPE always breaks before a single space that stands before a non-space.  Texts are
cut there, so a unit is a space with what follows it, and the tokens of a text are the tokens of its units in order.  A unit
that would begin with two white spaces stays with the one before it.
"""

from __future__ import annotations

import re

import numpy as np

_ODD = re.compile(r" (?:\s|\Z)")


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def cut(text: str) -> list[str]:
    """The first unit as it stands, then the others without the space that each begins with."""
    pieces = text.split(" ")
    if _ODD.search(text) is None:
        return pieces
    out, held = [], pieces[:1]
    for piece in pieces[1:]:
        if piece and not piece[0].isspace():
            out.append(" ".join(held))
            held = []
        held.append(piece)
    out.append(" ".join(held))
    return out


def number(texts: list[str]) -> tuple[list[np.ndarray], list[str], list[str]]:
    """Unit numbers of each text, the spaced units (without their space) and the first units; first ones are numbered from -1 down."""
    spaced, heads = Numbers(), Numbers()
    of = spaced.__getitem__
    docs = []
    for text in texts:
        parts = cut(text)
        row = np.empty(len(parts), np.int64)
        row[0] = -1 - heads[parts[0]]
        row[1:] = np.fromiter(map(of, parts[1:]), np.int64, len(parts) - 1)
        docs.append(row)
    return docs, list(spaced), list(heads)


class Ragged:
    """Rows of different lengths in one flat array."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths
        self.starts = np.cumsum(lengths) - lengths

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The chosen rows one after another."""
        n = self.lengths[rows]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[rows] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
