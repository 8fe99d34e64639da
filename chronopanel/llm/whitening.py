"""Whitening of vectors by shifted CholeskyQR: Gram passes over centred rows, triangular solves, one SVD of the composed factor."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

COMPONENTS = 8
#: Integer form of an entry: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Gram passes at most, and how far the rows may be from orthonormal after the last factor.
PASSES, NEAR = 6, 0.01
#: Numbers in the factors that one broadcast may hold; vector lengths beyond that are fitted in further rounds.
FACTOR_ENTRIES = 1 << 24
#: Entries worked on at a time in a task.
BLOCK = 1 << 20
LONG = 1 << 62


@dataclass
class Fit:
    """What is known of the vectors of one length: their number, sums, and the factors found so far."""

    n: int
    sums: list[int]
    factors: list[np.ndarray] = field(default_factory=list)
    #: Columns are components over the root of their eigenvalue (zero where there is no variance).
    project: np.ndarray | None = None
    explained: np.ndarray | None = None
    error: float = 0.0


def integers(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer entries) of the usable vectors of a batch, a block of one vector length at a time."""
    lists = batch.column(1)
    flat = lists.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    lengths = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    starts = np.cumsum(lengths) - lengths
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(values * SCALE)
        bad = ~(np.abs(scaled) < LONG)
    bad |= flat.is_null().to_numpy(zero_copy_only=False)
    usable = lists.is_valid().to_numpy(zero_copy_only=False) & (lengths > 0)
    usable &= np.bincount(np.repeat(np.arange(len(lengths)), lengths)[bad], minlength=len(lengths)) == 0
    for d in np.unique(lengths[usable]).tolist():
        rows = np.flatnonzero(usable & (lengths == d))
        step = max(1, BLOCK // d)
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            yield part, scaled[starts[part][:, None] + np.arange(d)].astype(np.int64) + SHIFT


def deviations(x: np.ndarray, fit: Fit) -> np.ndarray:
    """n*x - S, exact: 64-bit integers where they hold it, else Python's."""
    top = max(int(np.abs(x).max(initial=0)), 1)
    if top * fit.n < LONG:
        return x * fit.n - np.array(fit.sums, np.int64)
    return x.astype(object) * fit.n - np.array(fit.sums, object)


def centred(x: np.ndarray, fit: Fit) -> np.ndarray:
    return deviations(x, fit).astype(np.float64) / fit.n


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows @ inverse(factor) for an upper triangular factor, by substitution column after column."""
    out = np.asfortranarray(rows)
    for j in range(factor.shape[0]):
        out[:, j] = (out[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _orthogonalised(x: np.ndarray, fit: Fit) -> np.ndarray:
    rows = centred(x, fit)
    for factor in fit.factors:
        rows = solved(rows, factor)
    return rows


def _whitened(x: np.ndarray, fit: Fit) -> np.ndarray:
    return centred(x, fit) @ fit.project


def sums(vectors: DataFrame) -> dict[int, Fit]:
    """Number and exact sums of the usable vectors of every length."""

    def add(batches):
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for rows, x in integers(batch):
                n, s = held.get(x.shape[1], (0, 0))
                small = int(np.abs(x).max()) * len(x) < LONG
                held[x.shape[1]] = (n + len(rows), s + (x if small else x.astype(object)).sum(axis=0).astype(object))
        for d, (n, s) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(v) for v in s])],
                names=["d", "j", "n", "s"],
            )

    part = vectors.mapInArrow(add, "d int, j int, n long, s string")
    total = part.groupBy("d", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[int, Fit] = {}
    for r in total.orderBy("d", "j").collect():  # one row per dimension
        out.setdefault(r["d"], Fit(r["n"], [])).sums.append(int(r["s"]))
    return out


def gram(vectors: DataFrame, fits: dict[int, Fit], rows_of: Callable[[np.ndarray, Fit], np.ndarray]) -> dict[int, np.ndarray]:
    """Products of the columns of ``rows_of(x, fit)``, summed over all rows: each task sends one triangle per vector length."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in integers(batch):
                fit = fits.get(x.shape[1])
                if fit is not None:
                    part = rows_of(x, fit)
                    held[x.shape[1]] = held.get(x.shape[1], 0.0) + part.T @ part
        for d, g in held.items():
            i, j = np.triu_indices(len(g))
            arrays = [pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(g[i, j])]
            yield pa.RecordBatch.from_arrays(arrays, names=["d", "i", "j", "g"])

    total = vectors.mapInArrow(add, "d int, i int, j int, g double").groupBy("d", "i", "j").agg(F.sum("g").alias("g"))
    found = total.toArrow()  # one number per pair of dimensions
    d, i, j, g = (found.column(k).to_numpy() for k in range(4))
    out = {}
    for one in np.unique(d).tolist():
        at = d == one
        side = int(i[at].max()) + 1
        out[one] = np.zeros((side, side))
        out[one][i[at], j[at]] = g[at]
        out[one][j[at], i[at]] = g[at]
    return out


def _factor(g: np.ndarray, shift: float) -> np.ndarray:
    """Upper Cholesky factor of g, its diagonal raised by ``shift`` and by more where that is not yet definite."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, np.finfo(float).eps * np.linalg.norm(g, 2))


def _root(g: np.ndarray) -> np.ndarray:
    """F with F.T @ F = g, also for a singular g."""
    try:
        return np.linalg.cholesky(g).T
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(g)
        return np.sqrt(np.clip(values, 0, None))[:, None] * vectors.T


def fitted(vectors: DataFrame, fits: dict[int, Fit]) -> None:
    """Fill in components, shares and identity errors of the given vector lengths.

    Each pass sums the Gram matrix of the rows as orthogonalised so far and adds its Cholesky factor.  The first Gram matrix
    is shifted, so that it factors however badly conditioned it is; later passes remove what the shift left.  The last Gram
    matrix, near the identity, corrects the product of the factors, and the SVD of that product gives the components.
    """
    eps = np.finfo(float).eps
    open_ = dict(fits)
    for turn in range(PASSES):
        grams = gram(vectors, open_, _orthogonalised)
        for d, g in grams.items():
            fit = open_[d]
            norm = np.linalg.norm(g, 2)
            if norm and turn + 1 < PASSES and (turn == 0 or np.abs(g - np.eye(d)).max() > NEAR):
                # sums are added by task, so their rounding does not grow with all rows
                fit.factors.append(_factor(g, 0.0 if turn else 11 * eps * norm * d * (min(fit.n, 1 << 20) + d + 1)))
                continue
            del open_[d]
            product = _root(g)
            for factor in reversed(fit.factors):
                product = product @ factor
            _, size, rows = np.linalg.svd(product)
            rows *= np.sign(rows[np.arange(d), np.abs(rows).argmax(axis=1)])[:, None]
            live = size > size[0] * 1e-13 * max(d, 16)
            with np.errstate(divide="ignore"):
                scale = np.where(live, np.sqrt(fit.n) / size, 0.0)
            fit.project = (rows * scale[:, None])[:COMPONENTS].T
            fit.explained = (size**2 / (size @ size) if live.any() else np.zeros(d))[:COMPONENTS]
        if not open_:
            break
    for d, g in gram(vectors, fits, _whitened).items():
        live = np.flatnonzero(fits[d].project.any(axis=0))
        fits[d].error = float(np.abs(g[np.ix_(live, live)] / fits[d].n - np.eye(len(live))).max(initial=0.0))


SCHEMA = "vec_id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component, ``COMPONENTS`` at most, numbered from 1 by falling eigenvalue.

    Vectors that are null, empty or hold null, non-finite or unrepresentable entries (beyond 2^62 once scaled) have no rows.
    Vectors of each length are a fit of their own, all in the same passes; rounds bound what is broadcast.  A component without
    variance has null ``whitened`` and takes no part in ``identity_error``; of equal eigenvalues any basis may be chosen, the
    same for all rows; the largest entry of a component is positive.  ``deviation`` is null where no long holds it.  Null and
    repeated ids and repeated vectors keep a row each; an empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].alias("vector"))
    kind = rows.schema["vec_id"].dataType
    fits = sums(rows)
    rounds: list[dict[int, Fit]] = [{}]
    for d, fit in fits.items():
        if rounds[-1] and PASSES * (d * d + sum(k * k for k in rounds[-1])) > FACTOR_ENTRIES:
            rounds.append({})
        rounds[-1][d] = fit
    parts = []
    for some in rounds:
        if some:
            fitted(rows, some)
        parts.append(_projected(rows, some, SCHEMA.format(id=kind.simpleString()), to_arrow_type(kind)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _projected(rows: DataFrame, fits: dict[int, Fit], schema: str, kind: pa.DataType) -> DataFrame:
    light = {d: Fit(f.n, f.sums, [], f.project, f.explained, f.error) for d, f in fits.items()}

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, x in integers(batch):
                fit = light.get(x.shape[1])
                if fit is None:
                    continue
                k = fit.project.shape[1]
                away = deviations(x, fit)
                if away.dtype == object or float(np.abs(away).max()) ** 2 * x.shape[1] >= LONG:
                    exact = [s if s < 1 << 63 else None for s in (away.astype(object) ** 2).sum(axis=1)]
                else:
                    exact = (away**2).sum(axis=1)
                values = (away.astype(np.float64) / fit.n @ fit.project).ravel()
                dead = np.tile(~fit.project.any(axis=0), len(at))
                repeat = np.repeat(np.arange(len(at)), k)
                size = len(repeat)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(at)).cast(kind).take(pa.array(repeat)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(size, fit.n, np.int64)), pa.array(exact, pa.int64()).take(pa.array(repeat)),
                        pa.array(values, mask=dead), pa.array(np.tile(fit.explained, len(at))), pa.array(np.full(size, fit.error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
