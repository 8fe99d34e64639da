"""Helpers shared by the text operators: reading, bounded slices of Arrow batches, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

#: Bytes of text that one task holds at a time; a longer single text forms a slice of its own.
SLICE_BYTES = 24 << 20
#: Largest table that numbers values by their place; larger ranges of values are sorted.
PLACES = 1 << 26


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def width(spark: SparkSession) -> int:
    """Number of partitions that the session deals shuffles to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[list, list[str]]]:
    """(first column, texts) of consecutive rows, ``limit`` bytes of text or a little more at a time; a null text is empty."""
    keys: list = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys.append(key)
            texts.append(text or "")
            held += len(texts[-1])
            if held >= limit:
                yield keys, texts
                keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


def numbered(values: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of ``values`` below ``top`` in order, and the number of each value among them."""
    if top > PLACES:
        distinct, numbers = np.unique(values, return_inverse=True)
        return distinct, numbers.astype(np.int32)
    seen = np.zeros(top, bool)
    seen[values] = True
    distinct = np.flatnonzero(seen)
    place = np.empty(top, np.int32)
    place[distinct] = np.arange(len(distinct), dtype=np.int32)
    return distinct, place[values]


def spanning(size: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, smallest member) with the same components as the links u-v among ``size`` nodes."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for end in (u, v):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(size))
    return member, label[member]


def _print_of(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h % F.lit(1 << 30))).first())


def components(edges: DataFrame, hint: str | None = None) -> DataFrame:
    """(node, component) for every node of the links (u, v); component is the smallest node reachable.

    Large-star and small-star steps in turn (Kiveris et al., 2014) until the links no longer change.  Each step is one
    partial minimum and one join of two written tables, so a node with very many links is split by adaptive execution.
    Links with a null end and self-links are ignored; no links give no rows.  ``hint`` goes to the joins: files of numbers are
    much smaller than their rows in memory, so Spark may broadcast tables that do not fit; "merge" forbids it.
    """
    c = F.col
    as_told = lambda df: df.hint(hint) if hint else df
    edges = stored(
        edges.filter(c("u") != c("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    mark = _print_of(edges)
    while mark[0]:
        both = edges.union(edges.select(c("v").alias("u"), c("u").alias("v")))
        low = stored(both.groupBy(c("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m")), "low")
        up = both.filter(c("v") > c("u")).join(as_told(low), c("u") == c("k")).select(c("v").alias("u"), c("m").alias("v"))
        large = stored(up.filter(c("u") != c("v")).distinct(), "large")
        low = stored(large.groupBy(c("u").alias("k")).agg(F.min("v").alias("m")), "low")
        moved = large.filter(c("v").isNotNull()).join(as_told(low), c("u") == c("k")).select(c("v").alias("u"), c("m").alias("v"))
        edges = stored(moved.filter(c("u") != c("v")).union(low.select(c("k").alias("u"), c("m").alias("v"))).distinct(), "small")
        seen, mark = mark, _print_of(edges)
        if seen == mark:
            break
    members = edges.select(c("u").alias("node"), c("v").alias("component"))
    roots = edges.select(c("v").alias("node"), c("v").alias("component")).distinct()
    return members.union(roots)
