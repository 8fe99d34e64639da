"""Evaluation metrics, grouped by any keys.

Counts are aggregated first (partial aggregation), every metric is derived
from the resulting small tables.  Rank metrics collapse to distinct scores and
use bucketed prefix sums, so no group is sorted whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import col
from .ranking import average_rank, running_before

TINY = 2.220446049250313e-16  # double machine epsilon


def confusion(df: DataFrame, keys: Sequence[str], y: str, pred: str, weight: Column | None = None) -> DataFrame:
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(*keys, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(n.alias("n"))


def scores_from_confusion(matrix: DataFrame, keys: Sequence[str]) -> DataFrame:
    """accuracy, balanced accuracy (classes present in truth), macro F1 (classes in truth or prediction)."""
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    sides = F.explode(
        F.array(
            F.struct(F.col("y").alias("cls"), F.col("n").alias("truth"), F.lit(0).cast("long").alias("said"), hit.cast("long").alias("tp")),
            F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("truth"), F.col("n").alias("said"), F.lit(0).cast("long").alias("tp")),
        )
    )
    per_class = (
        matrix.withColumn("n", F.col("n").cast("long"))
        .select(*keys, sides.alias("s"))
        .groupBy(*keys, F.col("s.cls").alias("cls"))
        .agg(F.sum("s.truth").alias("truth"), F.sum("s.said").alias("said"), F.sum("s.tp").alias("tp"))
    )
    f1 = F.coalesce(F.try_divide(F.col("tp") * 2.0, F.col("truth") + F.col("said")), F.lit(0.0))
    return per_class.groupBy(*keys).agg(
        F.sum("truth").alias("samples"),
        F.try_divide(F.sum("tp").cast("double"), F.sum("truth")).alias("accuracy"),
        F.avg(F.when(F.col("truth") > 0, F.col("tp") / F.col("truth"))).alias("balanced_accuracy"),
        F.avg(F.when(F.col("truth") + F.col("said") > 0, f1)).alias("macro_f1"),
    )


def class_scores(df: DataFrame, keys: Sequence[str], y: str, pred: str) -> DataFrame:
    return scores_from_confusion(confusion(df, keys, y, pred), keys)


def probability_losses(df: DataFrame, keys: Sequence[str], y: str, p: str, classes: Sequence[int]) -> DataFrame:
    """Log loss over a fixed class list; Brier score too when there are two classes."""
    picked = F.element_at(col(p), F.array_position(F.array(*[F.lit(c) for c in classes]), col(y)).cast("int"))
    clipped = F.least(F.greatest(picked, F.lit(TINY)), F.lit(1.0 - TINY))
    aggs = [(-F.avg(F.ln(clipped))).alias("log_loss")]
    if len(classes) == 2:
        positive = F.element_at(col(p), 2)
        truth = (col(y) == classes[1]).cast("double")
        aggs.append(F.avg((positive - truth) * (positive - truth)).alias("brier"))
    return df.groupBy(*keys).agg(*aggs)


def score_counts(df: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count_if(col(y) == 1).alias("pos"), F.count_if(col(y) != 1).alias("neg")
    )


def roc_auc(df: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    """Mann-Whitney area with tied scores halved; NULL unless both classes occur."""
    ranked = running_before(score_counts(df, keys, y, score), keys, "score", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0)))
    return ranked.groupBy(*keys).agg(
        F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("roc_auc")
    )


def average_precision(df: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    """Sum of recall steps times precision over descending distinct scores."""
    ranked = running_before(score_counts(df, keys, y, score), keys, "score", ["pos", "neg"], descending=True)
    tp = F.col("pos_before") + F.col("pos")
    said = tp + F.col("neg_before") + F.col("neg")
    return ranked.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("pos") * tp / said), F.sum("pos")).alias("pr_auc")
    )


def regression_errors(df: DataFrame, keys: Sequence[str], y: str, pred: str) -> DataFrame:
    err = col(pred) - col(y)
    same_sign = (F.signum(col(y)) == F.signum(col(pred))).cast("double")
    return df.groupBy(*keys).agg(
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(same_sign).alias("sign_accuracy"),
    )


def _pearson(x: str, y: str) -> Column:
    varies = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    return F.when(varies, F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)))


def pearson(df: DataFrame, keys: Sequence[str], y: str, pred: str, out: str = "pearson") -> DataFrame:
    known = df.filter(col(y).isNotNull() & col(pred).isNotNull())
    return known.groupBy(*keys).agg(_pearson(y, pred).alias(out))


def spearman(df: DataFrame, keys: Sequence[str], y: str, pred: str) -> DataFrame:
    """Pearson of tie-averaged ranks; rows are counted per pair of values before any value is joined to its rank."""
    known = df.filter(col(y).isNotNull() & col(pred).isNotNull()).select(*keys, y, pred)
    pairs = known.groupBy(*keys, y, pred).agg(F.count(F.lit(1)).alias("n"))
    ranked = pairs.join(average_rank(known, keys, y, "__ry"), [*keys, y]).join(
        average_rank(known, keys, pred, "__rp"), [*keys, pred]
    )
    rows = F.sum("n").cast("double")
    # both ranks average to (rows + 1) / 2, whatever the ties
    about = lambda a, b: F.sum(F.col("n") * F.col(a) * F.col(b)) - rows * (rows + 1) * (rows + 1) / F.lit(4.0)
    varies = (F.max("__ry") > F.min("__ry")) & (F.max("__rp") > F.min("__rp"))
    value = F.try_divide(about("__ry", "__rp"), F.sqrt(about("__ry", "__ry")) * F.sqrt(about("__rp", "__rp")))
    return ranked.groupBy(*keys).agg(F.when(varies, value).alias("spearman"))


def derived_class_scores(df: DataFrame, keys: Sequence[str], y: str, pred: str, threshold: str) -> DataFrame:
    """Class scores of returns cut at +-threshold."""
    cut = lambda c: (
        F.when(col(c) > col(threshold), 1).when(col(c) < -col(threshold), -1).otherwise(0)
    )
    classed = df.withColumns({"__y": cut(y), "__p": cut(pred)})
    return class_scores(classed, keys, "__y", "__p").select(
        *keys,
        F.col("macro_f1").alias("derived_class_macro_f1"),
        F.col("balanced_accuracy").alias("derived_class_balanced_accuracy"),
    )


def regression_scores(df: DataFrame, keys: Sequence[str], y: str, pred: str, threshold: str) -> DataFrame:
    parts = [
        regression_errors(df, keys, y, pred),
        pearson(df, keys, y, pred),
        spearman(df, keys, y, pred),
        derived_class_scores(df, keys, y, pred, threshold),
    ]
    return joined_scores(parts, keys)


def joined_scores(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Small per-key metric tables side by side."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, list(keys), "left") if keys else out.join(F.broadcast(part))
    return out


def classification_scores(
    df: DataFrame, keys: Sequence[str], y: str, pred: str, p: str | None = None, classes: Sequence[int] = (0, 1)
) -> DataFrame:
    """Every classification metric that applies to the given columns."""
    parts = [class_scores(df, keys, y, pred)]
    if p is not None:
        parts.append(probability_losses(df, keys, y, p, classes))
        if len(classes) == 2:
            scored = df.withColumns(
                {"__s": F.element_at(col(p), 2), "__t": (col(y) == classes[1]).cast("int")}
            )
            parts.append(roc_auc(scored, keys, "__t", "__s"))
    return joined_scores(parts, keys)


def fold_summary(fold_scores: DataFrame, keys: Sequence[str], score: str = "macro_f1", penalty: float = 0.25) -> DataFrame:
    """Mean, population deviation, worst fold and the penalised mean."""
    return fold_scores.groupBy(*keys).agg(
        F.avg(score).alias(f"fold_{score}_mean"),
        F.stddev_pop(score).alias(f"fold_{score}_std"),
        F.min(score).alias(f"fold_{score}_worst"),
        (F.avg(score) - F.lit(penalty) * F.stddev_pop(score)).alias("robust_score"),
    )
