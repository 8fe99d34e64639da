"""Mutual information of features with a target from nearest neighbours, per fold, on training rows.

Distances are taken between neighbours in a distributed order and counts within a radius are differences of ranks, so no
feature is sorted or held whole in one task.  Estimates are floored at zero.  Ties are kept as they are: a value that occurs
more than ``k`` times in its class has radius zero, within which its equals count.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import col, digamma
from ..functions.rolling import SeriesWindow
from ..session import stored
from .panel import BLOCK, BLOCK_ROWS, POSITION, in_blocks, with_positions
from .ranking import exact_median, magnitude_bucket, running_before
from .selection import long_features
from .splits import assign

#: What turns a positive double into the next smaller one: the k-th neighbour itself lies outside the radius.
BELOW = 1.0 - 2.0**-53
#: Points of a block that are compared with one another.
NEAR_ROWS = 1024
KEYS = ["fold", "feature"]


def imputed(rows: DataFrame, folds: DataFrame, features: Sequence[str], target: str, min_coverage: float, min_distinct: int) -> DataFrame:
    """(fold, feature, y, x) of training rows with a known target; a missing value is the training median.  Features with too
    few known values, or no more than ``min_distinct`` different ones, are left out."""
    train = assign(rows.select("date", "target_end_date", target, *features), folds).filter((F.col("role") == "train") & F.col(target).isNotNull())
    long = stored(long_features(train.withColumnRenamed(target, "y"), ["fold", "y"], features), "information-rows")
    gate = long.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("known"), F.count_distinct("value").alias("n_distinct"))
    gate = gate.filter((F.col("known") >= F.lit(min_coverage) * F.col("rows")) & (F.col("n_distinct") > min_distinct)).select(*KEYS)
    usable = gate.join(exact_median(long, KEYS, "value", "mid"), KEYS)
    # folds x features rows: a shuffle on these few keys would gather a feature's rows in one task
    return long.join(F.broadcast(usable), KEYS).select(*KEYS, "y", F.coalesce("value", "mid").alias("x"))


def within(points: DataFrame, keys: Sequence[str], value: str, radius: str, out: str, count: str = "n") -> DataFrame:
    """Add how many points (``count`` a row) of the same key lie within ``radius`` of each value, itself included.

    The ends of all intervals are ranked among the values, and the difference of the ranks is the number between them.
    """
    staged = points.withColumns({"__lo": F.col(value) - F.col(radius), "__hi": F.col(value) + F.col(radius)})
    none = F.lit(0).cast("long")
    marks = staged.select(*keys, F.col(value).alias("__v"), F.col(count).cast("long").alias("__n"))
    for end in ("__lo", "__hi"):
        marks = marks.unionByName(staged.select(*keys, F.col(end).alias("__v"), none.alias("__n")))
    ranked = running_before(marks.groupBy(*keys, "__v").agg(F.sum("__n").alias("__n")), keys, "__v", ["__n"])
    ranked = stored(ranked, "ranks")
    at = lambda end, rank, name: ranked.select(*keys, F.col("__v").alias(end), rank.alias(name))
    low = at("__lo", F.col("__n_before"), "__first")
    high = at("__hi", F.col("__n_before") + F.col("__n"), "__last")
    joined = staged.join(low, [*keys, "__lo"]).join(high, [*keys, "__hi"])
    return joined.withColumn(out, F.col("__last") - F.col("__first")).drop("__lo", "__hi", "__first", "__last")


def _kth(candidates: Column, k: Column) -> Column:
    """Distance of the k-th of (distance, how many) candidates."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("r"))

    def step(acc, c):
        seen = acc["seen"] + c["m"]
        return F.struct(seen.alias("seen"), F.coalesce(acc["r"], F.when(seen >= k, c["d"])).alias("r"))

    return F.aggregate(F.array_sort(candidates), start, step)["r"]


def class_information(
    rows: DataFrame, folds: DataFrame, features: Sequence[str], target: str, k: int = 3, min_coverage: float = 0.60, min_distinct: int = 2,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``fold, feature, mi`` with a class target: radius of the k-th neighbour in the class, number of all points within it.

    Rows collapse to distinct values of each class first.  Classes with one row are left out, small ones use fewer neighbours.
    """
    points = imputed(rows, folds, features, target, min_coverage, min_distinct)
    tally = points.groupBy(*KEYS, "y", "x").agg(F.count(F.lit(1)).alias("n"))
    sizes = tally.groupBy(*KEYS, "y").agg(F.sum("n").alias("n_class")).filter(F.col("n_class") > 1)
    sized = tally.join(F.broadcast(sizes), [*KEYS, "y"]).withColumn("k", F.least(F.lit(k).cast("long"), F.col("n_class") - 1))

    def radii(part: DataFrame, w: SeriesWindow) -> DataFrame:
        other = lambda c, j: (F.lag if j < 0 else F.lead)(c, abs(j)).over(w.rows)
        pair = lambda d, m: F.struct(d.cast("double").alias("d"), m.cast("long").alias("m"))
        near = [F.when(other("x", j).isNotNull(), pair(F.abs(F.col("x") - other("x", j)), other("n", j))) for j in range(-k, k + 1) if j]
        candidates = F.array_compact(F.array(pair(F.lit(0.0), F.col("n") - 1), *near))
        return part.withColumn("__c", candidates)

    w = SeriesWindow((*KEYS, "y"), "x")
    placed = in_blocks(sized, radii, w, magnitude_bucket("x"), k, k, block_rows)
    reach = stored(placed.withColumn("radius", _kth(F.col("__c"), F.col("k")) * F.lit(BELOW)).drop("__c"), "radii")
    counted = within(reach, KEYS, "x", "radius", "m")
    mean = lambda c: F.sum(F.col("n") * digamma(c)) / F.sum("n")
    total = counted.groupBy(*KEYS).agg(F.sum("n").alias("all"), (mean("k") - mean("n_class") - mean("m")).alias("rest"))
    return total.select(*KEYS, F.greatest(digamma("all") + F.col("rest"), F.lit(0.0)).alias("mi"))


_NEAR = "id long, side int, best array<double>"


def _nearest(asking: pd.DataFrame, points: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` least distances of each asking point among ``best`` and the points of a block (the larger of both coordinates)."""
    px, py, pid = (points[c].to_numpy() for c in ("x", "v", "id"))
    out = []
    for start in range(0, len(asking), 512):
        part = asking.iloc[start : start + 512]
        d = np.maximum(np.abs(part["x"].to_numpy()[:, None] - px), np.abs(part["v"].to_numpy()[:, None] - py))
        d[part["id"].to_numpy()[:, None] == pid] = np.inf  # a point is not its own neighbour
        known = np.array([[*b, *[np.inf] * (k - len(b))] for b in part["best"]]).reshape(len(part), k)
        d = np.sort(np.hstack([known, d]), axis=1)[:, :k]
        out.append(pd.DataFrame({"id": part["id"], "side": part["side"], "best": list(d)}))
    return pd.concat(out) if out else pd.DataFrame({"id": [], "side": [], "best": []})


def value_information(
    rows: DataFrame, folds: DataFrame, features: Sequence[str], target: str, k: int = 3, min_coverage: float = 0.60, min_distinct: int = 2,
    block_rows: int = NEAR_ROWS,
) -> DataFrame:
    """``fold, feature, mi`` with a numeric target: k-th neighbour in (feature, target), numbers within it along each of them.

    Points lie in blocks along the feature.  Each looks in its own block first; one whose k-th neighbour is farther than its
    block's edge asks the next block on that side, until no block can hold a nearer one.  Both coordinates are in deviations.
    """
    points = imputed(rows, folds, features, target, min_coverage, min_distinct).withColumn("v", F.col("y").cast("double"))
    points = stored(points.withColumn("id", F.monotonically_increasing_id()), "points")
    scale = points.groupBy(*KEYS).agg(F.stddev_pop("x").alias("sx"), F.stddev_pop("v").alias("sv"), F.count(F.lit(1)).alias("all")).filter((F.col("all") > k) & (F.col("sx") > 0) & (F.col("sv") > 0))
    scaled = points.join(F.broadcast(scale), KEYS).select(*KEYS, "id", (F.col("x") / F.col("sx")).alias("x"), (F.col("v") / F.col("sv")).alias("v"))
    placed = with_positions(scaled, KEYS, "x", magnitude_bucket("x"))
    placed = stored(placed.withColumn(BLOCK, F.floor((F.col(POSITION) - 1) / F.lit(block_rows)).cast("long")).drop(POSITION), "blocks")
    edges = stored(placed.groupBy(*KEYS, BLOCK).agg(F.min("x").alias("lo"), F.max("x").alias("hi")), "edges")
    group, c = [*KEYS, BLOCK], F.col
    none = F.array().cast("array<double>")

    def looked(asking: DataFrame) -> DataFrame:
        blocks = asking.select(*group).distinct()
        # columns of their own: both sides come from one table
        there = placed.select(*[c(n).alias(n) for n in placed.columns]).join(blocks, group, "left_semi")
        both = asking.groupBy(*group).cogroup(there.groupBy(*group))
        return stored(both.applyInPandas(lambda a, p: _nearest(a, p, k), _NEAR), "nearest")

    at_home = looked(placed.withColumns({"best": none, "side": F.lit(0)})).select("id", c("best").alias("own"))
    at_home = stored(placed.join(at_home, "id"), "at-home")
    # a walk to either side collects what lies there; distances are never met twice, as blocks share no points
    walk = at_home.withColumns({"best": none, "side": F.explode(F.array(F.lit(-1), F.lit(1)))})
    ended = []
    while True:
        ahead = walk.withColumn(BLOCK, c(BLOCK) + c("side")).join(edges, group, "left")
        gap = F.when(c("side") > 0, c("lo") - c("x")).otherwise(c("x") - c("hi"))
        kth = F.get(F.array_sort(F.concat("own", "best")), F.lit(k - 1))
        ahead = stored(ahead.withColumn("on", F.coalesce(gap < kth, F.lit(False))).drop("lo", "hi"), "walks")
        ended.append(ahead.filter(~c("on")).select("id", "best"))
        asking = ahead.filter("on").drop("on")
        if asking.isEmpty():
            break
        walk = asking.drop("best").join(looked(asking), ["id", "side"])
    beside = reduce(DataFrame.union, ended).groupBy("id").agg(F.flatten(F.collect_list("best")).alias("beside"))
    radius = F.get(F.array_sort(F.concat("own", "beside")), F.lit(k - 1)) * F.lit(BELOW)
    reach = stored(at_home.join(beside, "id").select("id", *KEYS, "x", "v", radius.alias("radius"), F.lit(1).alias("n")), "radius")
    counted = within(within(reach, KEYS, "x", "radius", "nx"), KEYS, "v", "radius", "nv")
    total = counted.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("all"), (F.avg(digamma("nx")) + F.avg(digamma("nv"))).alias("rest"))
    return total.select(*KEYS, F.greatest(digamma("all") + digamma(F.lit(k)) - c("rest"), F.lit(0.0)).alias("mi"))
