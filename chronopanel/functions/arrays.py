"""Probability-vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col


def class_of_max(p: str | Column, classes: list[int]) -> Column:
    """Class with the largest probability; a tie goes to the lowest class."""
    index = F.array_position(col(p), F.array_max(col(p))).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in classes]), index)


def confidence(p: str | Column) -> Column:
    return F.array_max(col(p))


def total(p: str | Column) -> Column:
    return F.aggregate(col(p), F.lit(0.0), lambda acc, v: acc + v)


def align_classes(p: str | Column, have: list[int], want: list[int]) -> Column:
    """Reorder a probability vector to ``want``; absent classes get 0, rows re-normalised."""
    slots = [
        F.element_at(col(p), have.index(c) + 1) if c in have else F.lit(0.0)
        for c in want
    ]
    vec = F.array(*slots)
    norm = F.when(total(vec) == 0, F.lit(1.0)).otherwise(total(vec))
    return F.transform(vec, lambda v: v / norm)


def weighted_sum(p: str | Column, weight: str | Column) -> Column:
    return F.transform(col(p), lambda v: v * col(weight))


def add_vectors(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y)
