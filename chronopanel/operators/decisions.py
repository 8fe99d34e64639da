"""Thresholds, ensembles, baselines, regimes and prospective scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.numeric import branch, col, flag
from .metrics import average_precision, class_scores, confusion, joined_scores, roc_auc, scores_from_confusion
from .panel import calendar


def stepped(start: float, stop: float, step: float) -> list[float]:
    """Evenly stepped floats below ``stop`` (start + i * increment)."""
    increment = (start + step) - start
    out, i = [], 0
    while start + i * step < stop - 1e-12:
        out.append(start + i * increment)
        i += 1
    return out


# Decision grids.
TWO_STAGE_GRID = stepped(0.40, 0.76, 0.025)
MOVE_GRID = stepped(0.25, 0.751, 0.025)
CONFIDENCE_GRID = stepped(0.35, 0.81, 0.05)


def grid_level(score: str | Column, grid: Sequence[float]) -> Column:
    """How many grid thresholds the score reaches (no row is multiplied by the grid)."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: t <= col(score)))


def _expand(levels: DataFrame, grid: Sequence[float], digits: int) -> DataFrame:
    """Small count table times the grid; ``reached`` says whether the level passes."""
    steps = F.array(
        *[F.struct(F.lit(i + 1).alias("step"), F.lit(round(t, digits)).alias("threshold")) for i, t in enumerate(grid)]
    )
    return levels.withColumn("__t", F.explode(steps)).select(
        "*", F.col("__t.threshold").alias("threshold"), (F.col("level") >= F.col("__t.step")).alias("reached")
    ).drop("__t")


def threshold_scores(df: DataFrame, keys: Sequence[str], y: str, score: str, grid: Sequence[float] = MOVE_GRID) -> DataFrame:
    """Binary class scores at each threshold from one pass over the rows."""
    levels = df.groupBy(*keys, F.col(y).alias("y"), grid_level(score, grid).alias("level")).agg(
        F.count(F.lit(1)).alias("n")
    )
    wide = _expand(levels, grid, 3).withColumn("pred", F.col("reached").cast("int"))
    return scores_from_confusion(wide, [*keys, "threshold"])


def two_stage_prediction(move: str, up: str, threshold: float | Column) -> Column:
    """0 below the move threshold, else the more likely direction."""
    limit = F.lit(threshold) if isinstance(threshold, float) else threshold
    direction = F.when(col(up) >= 0.5, F.lit(1)).otherwise(F.lit(-1))
    return F.when(col(move) >= limit, direction).otherwise(F.lit(0))


def two_stage_scores(df: DataFrame, keys: Sequence[str], y: str, move: str, up: str, grid: Sequence[float] = TWO_STAGE_GRID) -> DataFrame:
    side = F.when(col(up) >= 0.5, F.lit(1)).otherwise(F.lit(-1))
    levels = df.groupBy(
        *keys, F.col(y).alias("y"), side.alias("side"), grid_level(move, grid).alias("level")
    ).agg(F.count(F.lit(1)).alias("n"))
    wide = _expand(levels, grid, 3).withColumn("pred", F.when(F.col("reached"), F.col("side")).otherwise(F.lit(0)))
    return scores_from_confusion(wide, [*keys, "threshold"])


def best_threshold(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Macro F1, then balanced accuracy, then the smaller threshold."""
    order = F.struct(F.col("macro_f1"), F.col("balanced_accuracy"), -F.col("threshold"))
    picked = scores.groupBy(*keys).agg(F.max_by("threshold", order).alias("decision_threshold"))
    return picked


def verify_threshold(df: DataFrame, chosen: DataFrame, y: str, score: str) -> DataFrame:
    """Fixed-threshold scores of the late part (``chosen`` is one row)."""
    judged = df.join(F.broadcast(chosen)).withColumn("__pred", (col(score) >= F.col("decision_threshold")).cast("int"))
    squared = (col(score) - col(y)) * (col(score) - col(y))
    parts = [
        class_scores(judged, [], y, "__pred"),
        roc_auc(df, [], y, score),
        average_precision(df, [], y, score),
        df.agg(F.avg(squared).alias("brier")),
    ]
    return joined_scores([chosen, *parts], [])


def selective_curve(df: DataFrame, keys: Sequence[str], y: str, pred: str, confidence: str, grid: Sequence[float] = CONFIDENCE_GRID, least: int = 30) -> DataFrame:
    """Scores and coverage when only confident predictions are kept."""
    levels = df.groupBy(
        *keys, F.col(y).alias("y"), F.col(pred).alias("pred"), grid_level(confidence, grid).alias("level")
    ).agg(F.count(F.lit(1)).alias("n"))
    totals = levels.groupBy(*keys).agg(F.sum("n").alias("__all"))
    kept = _expand(levels, grid, 2).filter("reached")
    scores = scores_from_confusion(kept, [*keys, "threshold"]).filter(F.col("samples") >= least)
    joined = scores.join(totals, list(keys)) if keys else scores.join(F.broadcast(totals))
    return joined.withColumn("coverage", F.col("samples") / F.col("__all")).drop("__all").withColumnRenamed(
        "threshold", "confidence_threshold"
    )


def regimes(vol_rank: str, trend: str) -> Column:
    """Names of the (overlapping) regimes a row belongs to."""
    v, t = col(vol_rank), col(trend)
    return F.array_compact(
        F.array(
            F.when(v < 0.33, F.lit("vol_low")),
            F.when((v >= 0.33) & (v < 0.67), F.lit("vol_mid")),
            F.when(v >= 0.67, F.lit("vol_high")),
            F.when(t >= 0, F.lit("trend_above_ema90")),
            F.when(t < 0, F.lit("trend_below_ema90")),
        )
    )


def regime_scores(df: DataFrame, y: str, pred: str, vol_rank: str, trend: str, least: int = 30) -> DataFrame:
    """Class scores per regime; rows are counted per regime set before they are spread."""
    counted = df.groupBy(regimes(vol_rank, trend).alias("__r"), F.col(y).alias("y"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )
    spread = counted.withColumn("regime", F.explode("__r"))
    return scores_from_confusion(spread, ["regime"]).filter(F.col("samples") >= least)


def ensemble(predictions: DataFrame, weights: DataFrame, row_keys: Sequence[str], classes: int, p: str = "p") -> DataFrame:
    """Weighted mean of vectors of ``classes`` probabilities over models, in one aggregation.

    ``weights`` has one row per model (score floored at 1e-6, normalised here).
    """
    share = member_weights(weights).select("model", "weight")
    sums = [F.sum(F.col("weight") * F.get(F.col(p), F.lit(i))) for i in range(classes)]
    return predictions.join(F.broadcast(share), "model").groupBy(*row_keys).agg(F.array(*sums).alias(p))


def member_weights(weights: DataFrame) -> DataFrame:
    floored = weights.withColumn("__w", F.greatest(F.col("score"), F.lit(1e-6)))
    whole = floored.agg(F.sum("__w").alias("__sum"))
    return floored.join(F.broadcast(whole)).select("model", "score", (F.col("__w") / F.col("__sum")).alias("weight"))


def prediction_table(df: DataFrame, keys: Sequence[str], p: str, classes: Sequence[int]) -> DataFrame:
    """Keys, predicted class, confidence and one probability column per class."""
    cols = [F.element_at(col(p), i + 1).alias(f"prob_{str(c).replace('-', 'minus_')}") for i, c in enumerate(classes)]
    return df.select(
        *keys, A.class_of_max(p, list(classes)).alias("pred"), A.confidence(p).alias("confidence"), *cols
    )


def three_class_baselines(valid: DataFrame, y: str, ret: str, threshold: str, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Always neutral and previous-row momentum."""
    momentum = branch(col(ret) > col(threshold), col(ret) < -col(threshold))
    return _baselines(valid, y, {"always_neutral": F.lit(0), "previous_day_momentum": momentum}, keys)


def move_baselines(valid: DataFrame, y: str, ret: str, threshold: str, keys: Sequence[str] = ()) -> DataFrame:
    """Never a move and move-again."""
    again = flag(F.abs(col(ret)) > col(threshold))
    return _baselines(valid, y, {"always_no_move": F.lit(0), "previous_day_move": again}, keys)


def _baselines(valid: DataFrame, y: str, rules: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """Both rules are evaluated in one scan; counts are spread afterwards."""
    staged = valid.select(*keys, F.col(y).alias("y"), *[c.alias(f"__{n}") for n, c in rules.items()])
    counted = staged.groupBy(*keys, "y", *[f"__{n}" for n in rules]).agg(F.count(F.lit(1)).alias("n"))
    spread = counted.withColumn(
        "__b",
        F.explode(F.array(*[F.struct(F.lit(n).alias("baseline"), F.col(f"__{n}").cast("int").alias("pred")) for n in rules])),
    ).select(*keys, "y", "n", "__b.*")
    return scores_from_confusion(spread, [*keys, "baseline"])


# Labelled days at which the prospective log is read.
REVIEW_DAYS = (30, 60, 90, 180, 365)


def prospective_log(predictions: DataFrame, outcomes: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Predictions joined to outcomes once these are known."""
    joined = predictions.join(outcomes, list(keys), "left")
    said = (F.col("move_probability") >= threshold).cast("int")
    return joined.withColumns(
        {
            "decision_threshold": F.lit(threshold),
            "predicted_label": said,
            "correct": (said == F.col("actual_label")).cast("int"),
        }
    )


def prospective_reviews(log: DataFrame, days: Sequence[int] = REVIEW_DAYS) -> DataFrame:
    """Cumulative scores, confusion cells and prevalence at each review length.

    Labelled calendar days are numbered; a row belongs to every review at least
    as long as its day number, so each row is counted once and spread after.
    """
    labelled = log.filter(F.col("actual_label").isNotNull())
    numbered = labelled.join(calendar(labelled).select("date", "day_index"), "date")
    level = F.array(*[F.lit(d) for d in days])
    first_review = F.array_min(F.filter(level, lambda d: d > F.col("day_index")))
    counted = (
        numbered.withColumn("__first", first_review)
        .filter(F.col("__first").isNotNull())
        .groupBy("__first", F.col("actual_label").alias("y"), F.col("predicted_label").alias("pred"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    available = numbered.agg((F.max("day_index") + 1).alias("__have"))
    spread = (
        counted.withColumn("review_days", F.explode(level))
        .filter(F.col("review_days") >= F.col("__first"))
        .join(F.broadcast(available))
        .filter(F.col("review_days") <= F.col("__have"))
    )
    scores = scores_from_confusion(spread, ["review_days"])
    cell = lambda y, p: F.sum(F.when((F.col("y") == y) & (F.col("pred") == p), F.col("n")).otherwise(0))
    cells = spread.groupBy("review_days").agg(
        cell(1, 1).alias("true_move"),
        cell(0, 1).alias("false_move"),
        cell(1, 0).alias("missed_move"),
        cell(0, 0).alias("true_quiet"),
        (F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("move_prevalence"),
    )
    return scores.join(cells, "review_days")
