"""Trees that Spark ML lacks: extremely randomised forests and histogram boosting, grown a level at a time.

Every task sums statistics of its rows for all open nodes of all trees, one aggregation adds the tasks up, and the driver, which
holds the model and one number per candidate split, chooses the splits.  What reaches the driver is bounded by the model (open
nodes times drawn features, or times features and bins), never by the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_table, stored

#: Rows that a task works on at a time.
BLOCK_ROWS = 4096
#: Candidates of one level that one pass may hold; more trees go into further passes.
CANDIDATES = 1 << 21
#: Rounds of boosting after which the rows are written with their scores.
KEEP_EVERY = 20
BINS = 64


@dataclass
class Trees:
    """Binary trees in arrays: node 1 is the root, 2i and 2i + 1 are the children of i; a leaf's feature is -1.

    A row goes left where its feature is at most the threshold.
    """

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, trees: int, depth: int, outputs: int) -> "Trees":
        nodes = 2 << depth
        return cls(np.full((trees, nodes), -1, np.int32), np.zeros((trees, nodes)), np.zeros((trees, nodes, outputs)))

    @property
    def depth(self) -> int:
        return self.feature.shape[1].bit_length() - 2

    def some(self, which: slice) -> "Trees":
        return Trees(self.feature[which], self.threshold[which], self.value[which])

    def nodes(self, x: np.ndarray, levels: int) -> np.ndarray:
        """Node of each row in each tree after so many levels (a leaf keeps its rows)."""
        trees = np.arange(len(self.feature))
        node = np.ones((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(levels):
            f = self.feature[trees, node]
            right = x[rows, np.maximum(f, 0)] > self.threshold[trees, node]
            node = np.where(f >= 0, 2 * node + right, node)
        return node


def _blocks(batches) -> Iterator[tuple[np.ndarray, ...]]:
    """Features as a matrix, and the other columns, a block of rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            yield x, *(part.column(i) for i in range(1, part.num_columns))


def _summed(rows: DataFrame, work: Callable[[Iterator], tuple[np.ndarray, list[np.ndarray]]], how: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(ids, columns) of what the tasks' (id, values) rows give when values of one id are reduced by ``how``."""
    names = [f"s{i}" for i in range(len(how))]

    def run(batches):
        ids, columns = work(_blocks(batches))
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(ids), *map(pa.array, columns)], names=["id", *names])

    found = rows.mapInArrow(run, "id long, " + ", ".join(f"{n} double" for n in names))
    reduced = found.groupBy("id").agg(*[getattr(F, h)(n).alias(n) for h, n in zip(how, names)]).toArrow()
    return reduced.column(0).to_numpy(), [reduced.column(1 + i).to_numpy() for i in range(len(how))]


def _dense(size: int, ids: np.ndarray, column: np.ndarray, fill: float = 0.0) -> np.ndarray:
    out = np.full(size, fill)
    out[ids] = column
    return out


# --- extremely randomised trees ---------------------------------------------------------------


def drawn(seed: int, tree: int, level: int, features: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of every node of a level, and where between the extremes its thresholds lie."""
    r = np.random.default_rng([seed, tree, level])
    nodes = 1 << level
    order = np.argsort(r.random((nodes, features)), axis=1)[:, :count]
    return order.astype(np.int32), r.random((nodes, count))


def _statistics(y: np.ndarray, w: np.ndarray, classes: int) -> np.ndarray:
    """Columns whose sums a split needs: rows, then weights by class, or the target and its square."""
    one = np.ones(len(y))
    if classes:
        return np.column_stack([one, *[w * (y == c) for c in range(classes)]])
    return np.column_stack([one, y, y * y])


def purity(s: np.ndarray, classes: int) -> np.ndarray:
    """What a split maximises, added over both sides: squared class weights over the weight, or the squared sum over the rows."""
    part = s[..., 1 : 1 + classes] if classes else s[..., 1:2]
    weight = part.sum(-1) if classes else s[..., 0]
    return np.divide((part**2).sum(-1), weight, out=np.zeros(weight.shape), where=weight > 0)


def leaf_value(s: np.ndarray, classes: int) -> np.ndarray:
    part = s[..., 1 : 1 + classes] if classes else s[..., 1:2]
    weight = part.sum(-1) if classes else s[..., 0]
    return np.divide(part, weight[..., None], out=np.zeros(part.shape), where=weight[..., None] > 0)


def grow_extra(rows: DataFrame, features: int, classes: int, trees: int, depth: int, min_leaf: int, seed: int, per_split: int) -> Trees:
    """Extremely randomised trees over all rows (x, y, w); ``classes`` 0 means a numeric target.

    A node draws ``per_split`` features and for each one threshold between the extremes of its own rows; the best of these
    splits it.  A level takes two passes: extremes, then sums on the left of every threshold.
    """
    rows = stored(rows.select("x", "y", "w"), "tree-rows")
    context = rows.sparkSession.sparkContext
    model = Trees.of(trees, depth, classes or 1)
    width = 1 + classes if classes else 3
    live = np.zeros((trees, 2 << depth), bool)
    live[:, 1] = True
    for level in range(depth):
        nodes = 1 << level
        step = max(1, CANDIDATES // (nodes * per_split))
        for start in range(0, trees, step):
            which = slice(start, min(start + step, trees))
            size = which.stop - which.start
            if not live[which, nodes : 2 * nodes].any():
                continue
            chosen, place = map(np.stack, zip(*[drawn(seed, t, level, features, per_split) for t in range(which.start, which.stop)]))
            shared = context.broadcast((model.some(which), chosen, live[which, nodes : 2 * nodes]))
            shape = (size, nodes, per_split)

            def places(x, shared=shared, level=level, nodes=nodes):
                """(tree, rows, their node within the level, their values of its drawn features) for each tree."""
                trees_, chosen_, live_ = shared.value
                node = trees_.nodes(x, level) - nodes
                for t in range(len(trees_.feature)):
                    at = np.flatnonzero(node[:, t] >= 0)
                    at = at[live_[t, node[at, t]]]
                    of = node[at, t]
                    yield t, at, of, x[at[:, None], chosen_[t, of]]

            def extremes(blocks, shape=shape, places=places):
                low, high = np.full(shape, np.inf), np.full(shape, -np.inf)
                for x, *_ in blocks:
                    for t, _, of, v in places(x):
                        np.minimum.at(low[t], of, v)
                        np.maximum.at(high[t], of, v)
                ids = np.flatnonzero(low <= high)
                return ids, [low.ravel()[ids], high.ravel()[ids]]

            ids, (low, high) = _summed(rows, extremes, ["min", "max"])
            total = size * nodes * per_split
            low, high = _dense(total, ids, low, np.inf).reshape(shape), _dense(total, ids, high, -np.inf).reshape(shape)
            with np.errstate(invalid="ignore"):
                threshold = np.where(low < high, low + place * (high - low), np.nan)
                # rounding may reach the upper extreme, which would leave nothing on the right
                threshold = np.where(threshold >= high, low, threshold)
            cut = context.broadcast(threshold)
            full = (size, nodes, per_split + 1)

            def sums(blocks, full=full, places=places, cut=cut):
                out = np.zeros((*full, width))
                for x, y, w in blocks:
                    stats = _statistics(y.to_numpy(zero_copy_only=False), w.to_numpy(zero_copy_only=False), classes)
                    for t, at, of, v in places(x):
                        left = v <= cut.value[t, of]
                        for j in range(per_split):
                            np.add.at(out[t, :, j], of[left[:, j]], stats[at[left[:, j]]])
                        np.add.at(out[t, :, per_split], of, stats[at])
                flat = out.reshape(-1, width)
                ids = np.flatnonzero(flat[:, 0])
                return ids, list(flat[ids].T)

            ids, columns = _summed(rows, sums, ["sum"] * width)
            stats = np.stack([_dense(int(np.prod(full)), ids, c) for c in columns], axis=-1).reshape(*full, width)
            _split(model, live, which, level, chosen, threshold, stats, classes, min_leaf)
            shared.unpersist()
            cut.unpersist()
    return model


def _split(model: Trees, live: np.ndarray, which: slice, level: int, chosen: np.ndarray, threshold: np.ndarray, stats: np.ndarray, classes: int, min_leaf: int) -> None:
    """Enter the best split of every node of a level into the model, with the values of both children."""
    nodes = 1 << level
    left, whole = stats[:, :, :-1], stats[:, :, -1]
    right = whole[:, :, None] - left
    if level == 0:
        model.value[which, 1] = leaf_value(whole[:, 0], classes)
    before = purity(whole, classes)
    gain = purity(left, classes) + purity(right, classes) - before[..., None]
    fits = ~np.isnan(threshold) & (left[..., 0] >= min_leaf) & (right[..., 0] >= min_leaf)
    gain = np.where(fits, gain, -np.inf)
    best = gain.argmax(axis=-1)
    t, n = np.nonzero(np.take_along_axis(gain, best[..., None], -1)[..., 0] > 1e-12 * np.maximum(before, 1e-300))
    j, tree, node = best[t, n], t + which.start, n + nodes
    model.feature[tree, node] = chosen[t, n, j]
    model.threshold[tree, node] = threshold[t, n, j]
    for side, part in ((0, left), (1, right)):
        child = 2 * node + side
        model.value[tree, child] = leaf_value(part[t, n, j], classes)
        live[tree, child] = part[t, n, j, 0] >= 2 * min_leaf


# --- histogram boosting ------------------------------------------------------------------------


@dataclass(frozen=True)
class Boosting:
    rounds: int
    rate: float
    depth: int
    leaves: int
    min_leaf: int = 20
    l1: float = 0.0
    l2: float = 0.0
    columns: float = 1.0
    seed: int = 42


def shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def gradients(score: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by row and output: squared error, logistic, or all classes together."""
    if classes == 0:
        return (score[:, 0] - y)[:, None], np.ones((len(y), 1))
    if classes == 2:
        p = 1.0 / (1.0 + np.exp(-score[:, 0]))
        return (w * (p - y))[:, None], (w * p * (1.0 - p))[:, None]
    p = np.exp(score - score.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return w[:, None] * (p - (y[:, None] == np.arange(classes))), w[:, None] * p * (1.0 - p)


def best_splits(hist: np.ndarray, spec: Boosting, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, feature, bin) per node from sums of (gradient, curvature, rows) by (node, feature, bin); rows up to the bin go left."""
    left = hist.cumsum(axis=2)[:, :, :-1]
    whole = hist.sum(axis=2)[:, :, None]
    right = whole - left
    worth = lambda s: shrunk(s[..., 0], spec.l1) ** 2 / np.maximum(s[..., 1] + spec.l2, 1e-12)
    gain = worth(left) + worth(right) - worth(whole)
    fits = (left[..., 2] >= spec.min_leaf) & (right[..., 2] >= spec.min_leaf) & allowed[None, :, None]
    gain = np.where(fits, gain, -np.inf).reshape(len(hist), -1)
    at = gain.argmax(axis=1)
    return gain[np.arange(len(hist)), at], at // left.shape[2], at % left.shape[2]


def kept_splits(gain: np.ndarray, leaves: int) -> np.ndarray:
    """Nodes of a tree that are split when the leaf with the greatest gain goes first, until there are ``leaves`` of them."""
    kept = np.zeros(len(gain), bool)
    open_ = [1]
    while len(open_) < leaves:
        best = max(open_, key=lambda i: (gain[i] if i < len(gain) else -np.inf, -i))
        if best >= len(gain) or not gain[best] > 1e-12:
            break
        kept[best] = True
        open_.remove(best)
        open_ += [2 * best, 2 * best + 1]
    return kept


def start_scores(rows: DataFrame, classes: int) -> np.ndarray:
    if classes == 0:
        return np.array([rows.agg(F.avg("y")).first()[0] or 0.0])
    weight = {int(r["y"]): r["w"] for r in rows.groupBy("y").agg(F.sum("w").alias("w")).collect()}  # one row per class
    share = np.array([weight.get(c, 0.0) for c in range(classes)])
    share = np.log(np.maximum(share / share.sum(), 1e-12))
    return np.array([share[1] - share[0]]) if classes == 2 else share - share.mean()


def bin_edges(rows: DataFrame, features: int, bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of the bins of each feature: distinct quantiles of all rows (``features`` x ``bins`` numbers)."""
    cuts = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.get("x", F.lit(i)), cuts, F.lit(10000)).alias(f"e{i}") for i in range(features)]).first()
    return [np.unique(np.array(e or [], float)) for e in found]


def grow_boosted(rows: DataFrame, features: int, classes: int, spec: Boosting, bins: int = BINS) -> tuple[Trees, np.ndarray]:
    """Boosted trees over all rows (x, y, w) and the scores they start from; one tree per round and output.

    Features are cut into bins once.  Each level of a round is one aggregation of gradient histograms for all open nodes of all
    outputs; from the levels the leaves with the greatest gain are kept.  Rows are written with their scores every few rounds,
    so a task replays only the rounds since.
    """
    context = rows.sparkSession.sparkContext
    outputs = 1 if classes in (0, 2) else classes
    edges = bin_edges(rows, features, bins)
    base = start_scores(rows, classes)
    model = Trees.of(spec.rounds * outputs, spec.depth, 1)
    codes = Trees.of(spec.rounds * outputs, spec.depth, 1)  # the same trees on bin numbers

    def binned(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            code = np.column_stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)]).astype(np.int16)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * features, pa.int32()), pa.array(code.ravel()))
            start = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * outputs, pa.int32()), pa.array(np.tile(base, len(x))))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1), batch.column(2), start], names=["x", "y", "w", "score"])

    schema = "x array<short>, y double, w double, score array<double>"
    table = stored(rows.select("x", "y", "w").mapInArrow(binned, schema), "binned")
    written = 0
    for turn in range(spec.rounds):
        if turn - written >= KEEP_EVERY:
            table = stored(_rescored(table, codes.some(slice(written * outputs, turn * outputs)), outputs, schema), "scored")
            written = turn
        now = slice(turn * outputs, (turn + 1) * outputs)
        r = np.random.default_rng([spec.seed, turn])
        count = max(1, round(spec.columns * features))
        allowed = np.array([np.isin(np.arange(features), r.permutation(features)[:count]) for _ in range(outputs)])
        gain = np.full((outputs, 2 << spec.depth), -np.inf)
        for level in range(spec.depth):
            nodes = 1 << level
            if level and not (gain[:, nodes // 2 : nodes] > 1e-12).any():
                break
            earlier = codes.some(slice(written * outputs, turn * outputs))
            hist = _histograms(table, context.broadcast((earlier, codes.some(now))), level, outputs, features, bins, classes)
            for k in range(outputs):
                gain[k, nodes : 2 * nodes], f, b = best_splits(hist[k], spec, allowed[k])
                good = np.flatnonzero(gain[k, nodes : 2 * nodes] > 1e-12)
                for n in good.tolist():
                    if b[n] >= len(edges[f[n]]):
                        gain[k, nodes + n] = -np.inf
                        continue
                    tree, node = now.start + k, nodes + n
                    codes.feature[tree, node] = model.feature[tree, node] = f[n]
                    codes.threshold[tree, node], model.threshold[tree, node] = b[n], edges[f[n]][b[n]]
                    left, whole = hist[k, n, f[n], : b[n] + 1].sum(axis=0), hist[k, n, f[n]].sum(axis=0)
                    for child, s in ((2 * node, left), (2 * node + 1, whole - left)):
                        model.value[tree, child] = -spec.rate * shrunk(s[0], spec.l1) / max(s[1] + spec.l2, 1e-12)
        for k in range(outputs):
            tree = now.start + k
            kept = kept_splits(gain[k], spec.leaves)
            for trees in (model, codes):
                trees.feature[tree, ~kept] = -1
            codes.value[tree] = model.value[tree]
    return model, base


def _replayed(x: np.ndarray, score: np.ndarray, trees: Trees, outputs: int) -> np.ndarray:
    if not len(trees.feature):
        return score
    node = trees.nodes(x, trees.depth)
    worth = trees.value[np.arange(node.shape[1]), node, 0]
    return score + worth.reshape(len(x), -1, outputs).sum(axis=1)


def _score_of(column: pa.Array, outputs: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, outputs)


def _rescored(table: DataFrame, trees: Trees, outputs: int, schema: str) -> DataFrame:
    shared = table.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            score = _replayed(x, _score_of(batch.column(3), outputs), shared.value, outputs)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * outputs, pa.int32()), pa.array(score.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=batch.schema.names)

    return table.mapInArrow(run, schema)


def _histograms(table: DataFrame, shared, level: int, outputs: int, features: int, bins: int, classes: int) -> np.ndarray:
    """Sums of (gradient, curvature, rows) by (output, node of the level, feature, bin)."""
    nodes = 1 << level
    shape = (outputs, nodes, features, bins)

    def work(blocks):
        earlier, growing = shared.value
        out = np.zeros((3, outputs, features, nodes * bins))
        for x, y, w, score in blocks:
            score = _replayed(x, _score_of(score, outputs), earlier, outputs)
            g, h = gradients(score, y.to_numpy(zero_copy_only=False), w.to_numpy(zero_copy_only=False), classes)
            node = growing.nodes(x, level) - nodes
            for k in range(outputs):
                at = np.flatnonzero(node[:, k] >= 0)
                for f in range(features):
                    cell = node[at, k] * bins + x[at, f]
                    out[0, k, f] += np.bincount(cell, g[at, k], nodes * bins)
                    out[1, k, f] += np.bincount(cell, h[at, k], nodes * bins)
                    out[2, k, f] += np.bincount(cell, None, nodes * bins)
        flat = out.reshape(3, outputs, features, nodes, bins).transpose(0, 1, 3, 2, 4).reshape(3, -1)
        ids = np.flatnonzero(flat[2])
        return ids, list(flat[:, ids])

    ids, columns = _summed(table, work, ["sum"] * 3)
    shared.unpersist()
    size = int(np.prod(shape))
    return np.stack([_dense(size, ids, c) for c in columns], axis=-1).reshape(*shape, 3)


# --- fitted models -----------------------------------------------------------------------------


@dataclass
class TreeModel:
    """Grown trees as an estimator: ``link`` is mean (forests), softmax, logistic or sum (boosted)."""

    trees: Trees
    link: str
    base: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of all classes, or the predicted number, per row."""
        trees, outputs = self.trees, len(self.base)
        out = []
        for start in range(0, len(x), BLOCK_ROWS):
            part = x[start : start + BLOCK_ROWS]
            if self.link == "mean":
                node = trees.nodes(part, trees.depth)
                out.append(trees.value[np.arange(node.shape[1]), node].mean(axis=1))
                continue
            score = _replayed(part, np.tile(self.base, (len(part), 1)), trees, outputs)
            if self.link == "logistic":
                p = 1.0 / (1.0 + np.exp(-score[:, 0]))
                score = np.column_stack([1.0 - p, p])
            elif self.link == "softmax":
                score = np.exp(score - score.max(axis=1, keepdims=True))
                score /= score.sum(axis=1, keepdims=True)
            out.append(score)
        return np.concatenate(out) if out else np.empty((0, 1))

    def transform(self, df: DataFrame, x: str, out: str) -> DataFrame:
        """Add ``out``, an array of scores, from the array column ``x``."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def scored(rows):
            import pandas as pd

            return pd.Series(list(shared.value.scores(np.stack(rows.to_numpy())))) if len(rows) else pd.Series([], dtype=object)

        return df.withColumn(out, scored(F.col(x)))

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes as rows, and one row on the model as a whole."""
        t = self.trees
        tree, node = np.nonzero((t.feature >= 0) | (t.value != 0).any(axis=-1))
        rows = pa.table({
            "tree": pa.array(tree, pa.int32()), "node": pa.array(node, pa.int32()), "feature": pa.array(t.feature[tree, node]),
            "threshold": pa.array(t.threshold[tree, node]), "value": pa.array(list(t.value[tree, node])),
        })
        spark.createDataFrame(rows).write.mode("overwrite").parquet(f"{path}/nodes")
        whole = [(self.link, self.base.tolist(), len(t.feature), t.depth, t.value.shape[-1])]
        small_table(spark, whole, "link string, base array<double>, trees int, depth int, outputs int").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TreeModel":
        whole = spark.read.parquet(f"{path}/model").first()
        trees = Trees.of(whole["trees"], whole["depth"], whole["outputs"])
        rows = spark.read.parquet(f"{path}/nodes").toArrow()
        tree, node = rows["tree"].to_numpy(), rows["node"].to_numpy()
        trees.feature[tree, node] = rows["feature"].to_numpy()
        trees.threshold[tree, node] = rows["threshold"].to_numpy()
        if len(tree):
            trees.value[tree, node] = np.stack(rows["value"].to_numpy())
        return cls(trees, whole["link"], np.array(whole["base"]))
