"""Task evaluation, two-stage models, refits and post analysis."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.rolling import SeriesWindow
from ..operators import decisions as D
from ..operators import joins as J
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import selection as SEL
from ..operators import splits as SP
from ..operators.cleaning import recent_window
from ..session import small_table, stored
from .crossval import KEYS, PARALLEL, Evaluation, _over_folds, _rows_key, _sides, classification_cv, pick_features, side_by_side
from .models import FactsCache, Fitted, ModelSpec, fit_classifier, predict_classes
from .registry import ModelRegistry


def covered(train: DataFrame, features: Sequence[str]) -> list[str]:
    """Coverage-selected features of one training table."""
    whole = train.agg(F.date_add(F.max("target_end_date"), 1).alias("valid_start")).select(
        F.lit(0).alias("fold"), "valid_start", F.col("valid_start").alias("valid_end"), F.lit(None).cast("date").alias("train_from")
    )
    rows = SEL.coverage_selected(SEL.train_stats(train, SP.fixed(whole), features)).select("feature").collect()
    return sorted(r["feature"] for r in rows)


def fit_final(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, classes: Sequence[int], spec: ModelSpec):
    """Coverage-select, fit on all training rows, aligned probabilities on the test rows."""
    chosen = covered(train, features)
    fitted = fit_classifier(train, chosen, target, spec)
    return fitted, predict_classes(fitted, test, KEYS, classes)


def evaluate_task(
    df: DataFrame,
    target: str,
    groups: Mapping[str, Sequence[str]],
    specs: Sequence[ModelSpec],
    n_splits: int = 5,
    members: int = 3,
    artifact: str | None = None,
) -> dict[str, DataFrame]:
    """Family x model grid, best refit and score-weighted ensemble on a purged holdout.

    Where no fold could be fitted only the empty comparison is returned.
    """
    spark = df.sparkSession
    classes = L.target_classes(target)
    cut = SP.fixed(SP.holdout_fold(df)).first()
    train, test = _sides(df, cut)
    train, test = stored(train, "train"), stored(test, "holdout")
    SP.assert_boundaries(SP.audit(df, SP.fixed(SP.holdout_fold(df))))
    folds = SP.fixed(SP.expanding_folds(train, n_splits))
    facts = FactsCache()
    grid = [(group, spec) for group in groups for spec in specs]
    each = _over_folds(lambda g: classification_cv(train, target, classes, groups[g[0]], g[1], folds, how="coverage", facts=facts), grid, PARALLEL)
    rows, store = [], {}
    for (group, spec), done in zip(grid, each):
        if done is None:
            continue
        s = done.summary
        rows.append((group, spec.name, s["accuracy"], s["balanced_accuracy"], s["macro_f1"], s["fold_macro_f1_mean"], s["fold_macro_f1_std"], s["oof_rows"]))
        store[(group, spec.name)] = (spec, groups[group])
    comparison = small_table(spark, rows,
        "feature_set string, model string, accuracy double, balanced_accuracy double, macro_f1 double, "
        "fold_macro_f1_mean double, fold_macro_f1_std double, oof_rows bigint",
    )
    ranked = sorted(rows, key=lambda r: (-r[4], r[6], r[0], r[1]))
    if not ranked:
        return {"comparison": comparison}
    best = ranked[0]
    parts = []
    finals = _over_folds(lambda r: fit_final(train, test, store[r[0], r[1]][1], target, classes, store[r[0], r[1]][0]), ranked[:members], PARALLEL)
    for r, (fitted, p) in zip(ranked, finals):
        spec = store[r[0], r[1]][0]
        if r is best and artifact:
            card = {"features": fitted.features, "classes": fitted.classes, "model": spec.name, "target": target}
            ModelRegistry(spark, artifact).publish(f"{target}-{r[0]}-{r[1]}", fitted, card)
        parts.append(p.withColumn("model", F.lit(f"{r[0]}/{r[1]}")))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    long = stored(long, "holdout_predictions")
    weights = small_table(spark, [(f"{r[0]}/{r[1]}", r[4]) for r in ranked[:members]], "model string, score double")
    ensemble = D.ensemble(long, weights, KEYS, len(classes))
    best_p = long.filter(F.col("model") == f"{best[0]}/{best[1]}").select(*KEYS, F.col("p").alias("best_p"))
    truth = test.select(*KEYS, F.col(target).cast("int").alias("y"))
    table = stored(
        truth.join(best_p, list(KEYS)).join(ensemble, list(KEYS)).withColumns(
            {"best_pred": A.class_of_max("best_p", classes), "ensemble_pred": A.class_of_max("p", classes)}
        ),
        "holdout_table",
    )
    holdout = (
        M.class_scores(table, [], "y", "best_pred").withColumn("member", F.lit("best"))
        .unionByName(M.class_scores(table, [], "y", "ensemble_pred").withColumn("member", F.lit("ensemble")))
    )
    return {"comparison": comparison, "holdout": holdout, "predictions": table, "members": D.member_weights(weights)}


def two_stage(
    df: DataFrame, features: Sequence[str], specs: Sequence[ModelSpec], n_splits: int = 5, least: int = 50, parallelism: int = PARALLEL
) -> dict[str, DataFrame]:
    """Move model and direction model (trained on moving rows), combined by a swept threshold.

    A fold whose direction model cannot be fitted still counts for the choice of the move model.  No parts are returned
    where no move model or no direction model could be fitted at all.
    """
    cut = SP.fixed(SP.holdout_fold(df)).first()
    train, test = _sides(df, cut)
    train, test = stored(train, "train"), stored(test, "holdout")
    folds = SP.fixed(SP.expanding_folds(train, n_splits))
    chosen = pick_features(train, folds, features, "target_move_dynamic", len(features), "coverage")
    facts = FactsCache()

    def fold_part(spec, fold):
        feats = chosen.get(fold["fold"], [])
        tr, va = _sides(train, fold)
        if len(feats) < 2:
            return None

        def of_moves():
            return fit_classifier(tr, feats, "target_move_dynamic", spec, facts.of(_rows_key(fold), tr, features, "target_move_dynamic"))

        def of_sides():
            moving = tr.filter(F.col("label_dynamic") != 0)
            known = facts.of((*_rows_key(fold), "moving"), moving, features, "target_direction")
            return fit_classifier(moving, feats, "target_direction", spec, known) if known.rows >= least else None

        move, side = side_by_side(of_moves, of_sides)
        if move is None:
            return None
        up_of = lambda fitted, name: predict_classes(fitted, va, KEYS, [0, 1]).select(*KEYS, F.col("p")[1].alias(name))
        truth = va.select(*KEYS, "label_dynamic", "target_move_dynamic", "target_direction")
        judged = truth.join(up_of(move, "move_p"), list(KEYS))
        judged = judged.withColumn("up_p", F.lit(None).cast("double")) if side is None else judged.join(up_of(side, "up_p"), list(KEYS))
        return judged.withColumn("model", F.lit(spec.name)), side is not None

    each = [(spec, fold) for spec in specs for fold in folds.collect()]  # one row per fold
    done = [p for p in _over_folds(lambda pair: fold_part(*pair), each, parallelism) if p is not None]
    if not any(has_side for _, has_side in done):
        return {}
    oof = done[0][0]
    for part, _ in done[1:]:
        oof = oof.unionByName(part)
    oof = stored(oof, "two_stage_oof")
    judged = oof.withColumns({"said_move": (F.col("move_p") >= 0.5).cast("int"), "said_up": (F.col("up_p") >= 0.5).cast("int")})
    pick = lambda rows, y, pred: M.class_scores(rows, ["model"], y, pred).agg(
        F.max_by("model", F.struct("macro_f1", "model")).alias("m")
    ).first()["m"]
    move_name = pick(judged, "target_move_dynamic", "said_move")
    dir_name = pick(judged.filter((F.col("label_dynamic") != 0) & F.col("up_p").isNotNull()), "target_direction", "said_up")
    mixed = oof.filter(F.col("model") == move_name).select(*KEYS, "label_dynamic", "move_p").join(
        oof.filter((F.col("model") == dir_name) & F.col("up_p").isNotNull()).select(*KEYS, "up_p"), list(KEYS)
    )
    sweep = stored(D.two_stage_scores(mixed, [], "label_dynamic", "move_p", "up_p"), "sweep")
    threshold = D.best_threshold(sweep, []).first()["decision_threshold"]
    by_name = {s.name: s for s in specs}
    feats = covered(train, features)
    move, side = side_by_side(
        lambda: fit_classifier(train, feats, "target_move_dynamic", by_name[move_name]),
        lambda: fit_classifier(train.filter(F.col("label_dynamic") != 0), feats, "target_direction", by_name[dir_name]),
    )
    pm = predict_classes(move, test, KEYS, [0, 1]).select(*KEYS, F.col("p")[1].alias("move_p"))
    pd = predict_classes(side, test, KEYS, [0, 1]).select(*KEYS, F.col("p")[1].alias("up_p"))
    table = stored(
        test.select(*KEYS, "label_dynamic").join(pm, list(KEYS)).join(pd, list(KEYS)).withColumn(
            "prediction", D.two_stage_prediction("move_p", "up_p", float(threshold))
        ),
        "two_stage_holdout",
    )
    active = table.agg(F.avg((F.col("move_p") >= threshold).cast("double")).alias("active_share"))
    scores = M.class_scores(table, [], "label_dynamic", "prediction").join(F.broadcast(active)).withColumns(
        {"move_model": F.lit(move_name), "direction_model": F.lit(dir_name), "decision_threshold": F.lit(float(threshold))}
    )
    return {"sweep": sweep, "holdout": scores, "predictions": table}


def scorecard(tasks: Mapping[str, dict[str, DataFrame]], staged: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per task: best out-of-fold choice and its holdout scores; tasks that could not be fitted have no row."""
    rows = None
    for task, parts in tasks.items():
        if "holdout" not in parts:
            continue
        best = parts["comparison"].agg(
            F.max_by(F.struct("model", "feature_set", "macro_f1"), F.struct("macro_f1", -F.col("fold_macro_f1_std"))).alias("b")
        )
        score = lambda member, col: parts["holdout"].filter(F.col("member") == member).select(F.col("macro_f1").alias(col), F.col("balanced_accuracy").alias(f"{col}_balanced"))
        row = best.join(F.broadcast(score("best", "best_holdout"))).join(F.broadcast(score("ensemble", "ensemble_holdout"))).select(
            F.lit(task).alias("task"), F.col("b.model").alias("best_model"), F.col("b.feature_set").alias("best_feature_set"),
            F.col("b.macro_f1").alias("best_oof_macro_f1"), F.col("best_holdout").alias("best_holdout_macro_f1"),
            F.col("ensemble_holdout").alias("ensemble_holdout_macro_f1"), F.col("ensemble_holdout_balanced").alias("holdout_balanced_accuracy"),
        )
        rows = row if rows is None else rows.unionByName(row)
    if staged:
        row = staged["holdout"].select(
            F.lit("two_stage").alias("task"), F.concat_ws(" -> ", "move_model", "direction_model").alias("best_model"),
            F.lit("all").alias("best_feature_set"), F.lit(None).cast("double").alias("best_oof_macro_f1"),
            F.col("macro_f1").alias("best_holdout_macro_f1"), F.lit(None).cast("double").alias("ensemble_holdout_macro_f1"),
            F.col("balanced_accuracy").alias("holdout_balanced_accuracy"),
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


def refit_locked(df: DataFrame, config: Mapping[str, object], features: Sequence[str], spec: ModelSpec, path: str) -> tuple[Fitted, DataFrame]:
    """Refit a chosen configuration on its trailing window and store the artifact."""
    window = config.get("train_window_days")
    train = recent_window(df, window)
    span = train.agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    whole = small_table(df.sparkSession, [(0, span["hi"], span["hi"], None)], "fold int, valid_start date, valid_end date, train_from date"
    ).withColumns({"valid_start": F.date_add("valid_start", 366), "valid_end": F.date_add("valid_end", 366)})
    target = str(config["target"])
    chosen = pick_features(train, whole, features, target, int(config.get("top_k", 100)))[0]
    fitted = fit_classifier(train, chosen, target, spec)
    card = {
        **config, "model": spec.name, "features": chosen, "classes": fitted.classes,
        "train_first_date": span["lo"], "train_last_date": span["hi"], "train_rows": span["n"],
    }
    ModelRegistry(df.sparkSession, path).publish(str(config.get("config_hash") or spec.name), fitted, card)
    summary = small_table(df.sparkSession, [(spec.name, len(chosen), str(span["lo"]), str(span["hi"]), span["n"], sorted(chosen))],
        "model string, feature_count int, train_first_date string, train_last_date string, train_rows bigint, features array<string>",
    )
    return fitted, summary


def seed_stability(df: DataFrame, target: str, features: Sequence[str], spec: ModelSpec, folds: DataFrame, seeds: Sequence[int] | None = None) -> DataFrame:
    """Summary per seed of one configuration."""
    classes, seeds = L.target_classes(target), SEEDS if seeds is None else seeds
    rows, facts = [], FactsCache()
    each = _over_folds(lambda seed: classification_cv(df, target, classes, features, spec.seeded(seed), folds, facts=facts), seeds, PARALLEL)
    for seed, done in zip(seeds, each):
        if done:
            s = done.summary
            rows.append((spec.name, seed, s["macro_f1"], s["robust_score"], s["oof_rows"]))
    return small_table(df.sparkSession, rows, "model string, seed int, macro_f1 double, robust_score double, oof_rows bigint")


SEEDS = (11, 42, 73, 104, 137)


def post_analysis(df: DataFrame, target: str, features: Sequence[str], specs: Sequence[ModelSpec], folds: DataFrame, vol_rank: str, trend: str, seeds: Sequence[int] = SEEDS) -> dict[str, DataFrame]:
    """Members re-run out of fold, weighted ensemble, confidence curve, regimes and seeds of the best member.

    ``ensemble_improved`` says whether the ensemble's robust score is above that of the best member.
    """
    spark = df.sparkSession
    classes = L.target_classes(target)
    folds = SP.fixed(folds)
    runs: dict[str, Evaluation] = {}
    facts = FactsCache()
    each = _over_folds(lambda spec: classification_cv(df, target, classes, features, spec, folds, facts=facts), specs, PARALLEL)
    for spec, done in zip(specs, each):
        if done:
            runs[spec.name] = done
    long = None
    for name, done in runs.items():
        part = done.predictions.withColumn("model", F.lit(name))
        long = part if long is None else long.unionByName(part)
    weights = small_table(spark, [(n, d.summary["robust_score"]) for n, d in runs.items()], "model string, score double")
    shared = J.common_support(long, KEYS, "model", len(runs))
    first = next(iter(runs))
    facts = long.filter(F.col("model") == first).select(*KEYS, "fold", "y")
    context = df.select(*KEYS, F.col(vol_rank).alias("vol_rank"), F.col(trend).alias("trend"))
    table = D.ensemble(shared.select("model", *KEYS, "p"), weights, KEYS, len(classes)).join(facts, list(KEYS)).join(context, list(KEYS))
    table = stored(table.withColumns({"pred": A.class_of_max("p", classes), "confidence": A.confidence("p")}), "ensemble")
    fold_scores = M.class_scores(table, ["fold"], "y", "pred")
    best_member = max(d.summary["robust_score"] for d in runs.values())
    whole = M.classification_scores(table, [], "y", "pred", "p", classes).join(F.broadcast(M.fold_summary(fold_scores, [])))
    out = {
        "members": D.member_weights(weights),
        "ensemble": whole.withColumns({"best_member_robust": F.lit(best_member), "ensemble_improved": F.col("robust_score") > F.lit(best_member)}),
        "folds": fold_scores,
        "selective": D.selective_curve(table, [], "y", "pred", "confidence"),
        "regimes": D.regime_scores(table, "y", "pred", "vol_rank", "trend"),
        "predictions": D.prediction_table(table, KEYS, "p", classes),
    }
    if seeds:
        best = max(runs, key=lambda n: (runs[n].summary["robust_score"], n))
        out["seeds"] = seed_stability(df, target, features, next(s for s in specs if s.name == best), folds, seeds)
    return out
