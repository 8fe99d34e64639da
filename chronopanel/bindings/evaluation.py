"""Split, metric, threshold, ensemble, baseline and ranking queries over a labelled panel.

Scores stand in for model output: they are exact functions of the bar (its
close, open or volume in cents), so both engines see the same numbers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.rolling import SeriesWindow
from ..operators import decisions as D
from ..operators import joins as J
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import price as P
from ..operators import ranking as RK
from ..operators import splits as SP
from ..session import stored
from .base import BASE, S, enough, line_bars, out, query, table
from .price import LABELS

W = SeriesWindow()


def dataset(spark, sf_dir):
    """Labelled rows with a known target."""
    df = L.standard_labels(L.forward_target(P.base_columns(line_bars(spark, sf_dir), W), W), W)
    return stored(df.filter(F.col("target_end_date").isNotNull() & F.col("target_return_1d").isNotNull()), "dataset")


DATA = LABELS + """, data AS (SELECT * FROM labelled WHERE target_end_date IS NOT NULL AND target_return_1d IS NOT NULL),
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, lead(date) OVER (ORDER BY date) AS next_date FROM (SELECT DISTINCT date FROM data)),
n AS (SELECT count(*) AS n FROM cal)"""


def rolling_sql(window, k=6, valid=180):
    start = f"s.date - {window}" if window else "CAST(NULL AS DATE)"
    return f""", fold0 AS (SELECT f, CASE WHEN n - {valid * k} < 400 THEN greatest(60, (n - 400) // {k}) ELSE {valid} END AS len, n FROM n, (SELECT unnest(range({k})) AS f)),
folds AS (SELECT f + 1 AS fold, s.date AS valid_start, e.date AS valid_end, {start} AS train_from FROM fold0
  JOIN cal s ON s.i = n - len * ({k} - f) JOIN cal e ON e.i + 1 = n - len * ({k} - f - 1))"""


def expanding_sql(k=5):
    return f""", folds AS (SELECT f + 1 AS fold, s.date AS valid_start, e.date AS valid_end, CAST(NULL AS DATE) AS train_from FROM n, (SELECT unnest(range({k})) AS f)
  JOIN cal s ON s.i = n - (n // ({k} + 1)) * ({k} - f) JOIN cal e ON e.i + 1 = n - (n // ({k} + 1)) * ({k} - f - 1))"""


HOLDOUT = """, folds AS (SELECT 0 AS fold, s.date AS valid_start, e.date AS valid_end, CAST(NULL AS DATE) AS train_from FROM n
  JOIN cal s ON s.i = floor(n * 0.8) JOIN cal e ON e.i + 1 = n)"""

ASSIGN = """, marked AS (SELECT d.*, fold, CASE WHEN date BETWEEN valid_start AND valid_end THEN 'valid'
    WHEN date < valid_start AND target_end_date < valid_start THEN 'train' WHEN date < valid_start THEN 'purged' END AS role
  FROM data d JOIN folds ON date <= valid_end AND (train_from IS NULL OR date >= train_from))"""

AUDIT = """SELECT fold, count(*) FILTER (role IN ('train', 'purged')) AS raw_train_rows, count(*) FILTER (role = 'train') AS train_rows_after_purge,
  count(*) FILTER (role = 'purged') AS purged_rows, count(*) FILTER (role = 'valid') AS valid_rows,
  min(date) FILTER (role = 'train') AS train_first_feature_date, max(date) FILTER (role = 'train') AS train_last_feature_date,
  max(target_end_date) FILTER (role = 'train') AS train_last_target_end_date,
  min(date) FILTER (role = 'valid') AS valid_first_feature_date, max(date) FILTER (role = 'valid') AS valid_last_feature_date FROM marked GROUP BY fold"""
AUDIT_DATES = "train_first_feature_date train_last_feature_date train_last_target_end_date valid_first_feature_date valid_last_feature_date"
AUDIT_COUNTS = "fold raw_train_rows train_rows_after_purge purged_rows valid_rows"


@query("expanding_folds", "V02 V03 V07 J05", out(AUDIT, "", AUDIT_DATES, (), AUDIT_COUNTS, ctes=DATA + expanding_sql() + ASSIGN))
def _(spark, sf_dir):
    df = dataset(spark, sf_dir)
    return SP.assert_boundaries(SP.audit(df, SP.expanding_folds(df)))


@query("rolling_folds", "V05 V07 J05", out(AUDIT, "", AUDIT_DATES, (), AUDIT_COUNTS, ctes=DATA + rolling_sql(730) + ASSIGN))
def _(spark, sf_dir):
    df = dataset(spark, sf_dir)
    return SP.audit(df, SP.rolling_folds(df, 730))


@query("rolling_folds_expanding", "V05", out("SELECT * FROM folds", "", "valid_start valid_end train_from", (), "fold", ctes=DATA + rolling_sql(None, 4)))
def _(spark, sf_dir):
    return SP.rolling_folds(dataset(spark, sf_dir), None, n_splits=4)


@query("holdout_split", "V04 V03", out(AUDIT, "", AUDIT_DATES, (), AUDIT_COUNTS, ctes=DATA + HOLDOUT + ASSIGN))
def _(spark, sf_dir):
    df = dataset(spark, sf_dir)
    return SP.audit(df, SP.holdout_fold(df))


@query(
    "fold_roles", "J05 V05",
    out("SELECT series_id, date, fold, role FROM marked WHERE role IN ('train', 'valid')", "series_id role", "date", (), "fold", ctes=DATA + rolling_sql(365) + ASSIGN),
)
def _(spark, sf_dir):
    df = dataset(spark, sf_dir)
    return SP.assign(df.select("series_id", "date", "target_end_date"), SP.rolling_folds(df, 365)).drop("target_end_date")


@query(
    "split_audit_by_task", "V07",
    out(f"SELECT 'move' AS task, * FROM ({AUDIT})", "task", AUDIT_DATES, (), AUDIT_COUNTS, ctes=DATA + rolling_sql(1095) + ASSIGN),
)
def _(spark, sf_dir):
    df = dataset(spark, sf_dir)
    return SP.task_audit(SP.audit(df, SP.rolling_folds(df, 1095)), "move")


@query(
    "boundary_problems", "V03",
    out(
        f"""SELECT fold FROM ({AUDIT}) WHERE train_rows_after_purge = 0 OR valid_rows = 0 OR train_last_feature_date >= valid_first_feature_date
            OR train_last_target_end_date >= valid_first_feature_date""",
        "", "", (), "fold", ctes=DATA + rolling_sql(730) + ASSIGN.replace("AND target_end_date < valid_start THEN", "THEN"),
    ),
)
def _(spark, sf_dir):
    """An audit that skipped the purge is caught: training rows include targets that reach validation."""
    df = dataset(spark, sf_dir)
    folds = SP.rolling_folds(df, 730)
    leaky = df.withColumn("real_end", F.col("target_end_date")).withColumn("target_end_date", F.col("date"))
    marked = SP.assign(leaky.select("date", "target_end_date", "real_end"), folds)
    audits = marked.groupBy("fold").agg(
        F.count_if(F.col("role") == "train").alias("train_rows_after_purge"),
        F.count_if(F.col("role") == "valid").alias("valid_rows"),
        F.max(F.when(F.col("role") == "train", F.col("date"))).alias("train_last_feature_date"),
        F.max(F.when(F.col("role") == "train", F.col("real_end"))).alias("train_last_target_end_date"),
        F.min(F.when(F.col("role") == "valid", F.col("date"))).alias("valid_first_feature_date"),
    )
    return SP.boundary_problems(audits).select("fold")


@query(
    "stratified_split", "V01",
    out(
        """SELECT label, split, count(*) AS rows, min(o_orderkey) AS first_key, sum(o_orderkey) AS key_sum FROM (
          SELECT o_orderstatus AS label, o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || '|42'), o_orderkey)
            <= round(0.2 * count(*) OVER (PARTITION BY o_orderstatus)) THEN 'test' ELSE 'train' END AS split FROM orders) GROUP BY 1, 2""",
        "label split", "", (), "rows first_key key_sum",
    ),
)
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").withColumnRenamed("o_orderstatus", "label")
    s = SP.stratified_split(o, "label", "o_orderkey")
    return s.groupBy("label", "split").agg(
        F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("first_key"), F.sum("o_orderkey").alias("key_sum")
    )


# --- predictions --------------------------------------------------------------------------

CENTS = {"ma": "close", "mb": "open", "mc": "volume"}


def predictions(spark, sf_dir):
    """Three stand-in models over the validation rows of the rolling folds."""
    df = dataset(spark, sf_dir)
    rows = df.select(
        "series_id", "date", "target_end_date", "target_return_1d", "r1", "threshold_dynamic",
        F.col("label_dynamic").alias("y3"), F.col("target_move_dynamic").alias("y2"),
        F.array(
            *[
                F.struct(F.lit(m).alias("model"), F.round(F.col(c) * 100).cast("long").alias("cents"))
                for m, c in CENTS.items()
            ]
        ).alias("__m"),
    )
    valid = SP.assign(rows, SP.fixed(SP.rolling_folds(df, 730))).filter(F.col("role") == "valid").drop("role")
    long = valid.withColumn("__x", F.explode("__m")).select("*", "__x.model", "__x.cents").drop("__m", "__x")
    # mb has no opinion in the first fold
    long = long.filter((F.col("model") != "mb") | (F.col("fold") > 1))
    a, b, c = (F.col("cents") % m + 1 for m in (997, 499, 251))
    s = (a + b + c).cast("double")
    scored = long.withColumns(
        {
            "p3": F.array(a / s, b / s, c / s),
            "move_p": (F.col("cents") % 1000) / F.lit(1000.0),
            "up_p": (F.col("cents") % 101) / F.lit(101.0),
        }
    )
    return stored(scored, "predictions")


PRED = DATA + rolling_sql(730) + ASSIGN + """, models AS (
  SELECT series_id, date, target_end_date, target_return_1d, r1, threshold_dynamic, label_dynamic AS y3, target_move_dynamic AS y2, fold, model,
    CAST(round(CASE model WHEN 'ma' THEN close WHEN 'mb' THEN open ELSE volume END * 100) AS BIGINT) AS cents
  FROM marked, (VALUES ('ma'), ('mb'), ('mc')) AS m(model) WHERE role = 'valid' AND (model <> 'mb' OR fold > 1)),
pred0 AS (SELECT *, cents % 997 + 1 AS a, cents % 499 + 1 AS b, cents % 251 + 1 AS c, (cents % 1000) / 1000.0::DOUBLE AS move_p, (cents % 101) / 101.0::DOUBLE AS up_p FROM models),
pred AS (SELECT *, a / (a + b + c)::DOUBLE AS pa, b / (a + b + c)::DOUBLE AS pb, c / (a + b + c)::DOUBLE AS pc,
  CASE WHEN a >= b AND a >= c THEN -1 WHEN b >= c THEN 0 ELSE 1 END AS pred3 FROM pred0)"""


def score_sql(src, keys, y="y", pred="pred"):
    """Accuracy, balanced accuracy, macro F1 from rows with y and pred."""
    k = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}sum(truth) AS samples, sum(tp) / sum(truth) AS accuracy, avg(CASE WHEN truth > 0 THEN tp / truth END) AS balanced_accuracy,
      avg(2.0 * tp / (truth + said)) AS macro_f1 FROM (
        SELECT {k}cls, sum(t)::DOUBLE AS truth, sum(s)::DOUBLE AS said, sum(h)::DOUBLE AS tp FROM (
          SELECT {k}{y} AS cls, 1 AS t, 0 AS s, CASE WHEN {y} = {pred} THEN 1 ELSE 0 END AS h FROM {src}
          UNION ALL SELECT {k}{pred}, 0, 1, 0 FROM {src}) GROUP BY {k}cls) {by}"""


SCORES = "accuracy balanced_accuracy macro_f1"


def three(spark, sf_dir):
    return predictions(spark, sf_dir).withColumn("pred3", A.class_of_max("p3", L.THREE_CLASSES))


@query("class_scores", "E01", out(score_sql("pred", "model, fold", "y3", "pred3"), "model", "", SCORES, "fold samples", ctes=PRED))
def _(spark, sf_dir):
    return M.class_scores(three(spark, sf_dir), ["model", "fold"], "y3", "pred3")


@query(
    "probability_losses", "E02 E04",
    out(
        """SELECT model, -avg(ln(CASE y3 WHEN -1 THEN pa WHEN 0 THEN pb ELSE pc END)) AS log_loss3,
          -avg(ln(least(greatest(CASE y2 WHEN 1 THEN move_p ELSE 1 - move_p END, 2.220446049250313e-16), 1 - 2.220446049250313e-16))) AS log_loss2,
          avg((move_p - y2) * (move_p - y2)) AS brier FROM pred GROUP BY 1""",
        "model", "", "log_loss3 log_loss2 brier", ctes=PRED,
    ),
)
def _(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("p2", F.array(1 - F.col("move_p"), F.col("move_p")))
    l3 = M.probability_losses(p, ["model"], "y3", "p3", L.THREE_CLASSES).withColumnRenamed("log_loss", "log_loss3")
    l2 = M.probability_losses(p, ["model"], "y2", "p2", L.TWO_CLASSES).withColumnRenamed("log_loss", "log_loss2")
    return l3.join(l2, "model")


AUC_SQL = """SELECT model, (sum(rk) FILTER (y2 = 1) - count(*) FILTER (y2 = 1) * (count(*) FILTER (y2 = 1) + 1) / 2.0)
  / nullif(count(*) FILTER (y2 = 1) * count(*) FILTER (y2 = 0), 0) AS roc_auc FROM (
    SELECT model, y2, rank() OVER (PARTITION BY model ORDER BY move_p) + (count(*) OVER (PARTITION BY model, move_p) - 1) / 2.0 AS rk FROM pred) GROUP BY 1"""


@query("roc_auc", "E03", out(AUC_SQL, "model", "", "roc_auc", ctes=PRED))
def _(spark, sf_dir):
    return M.roc_auc(predictions(spark, sf_dir), ["model"], "y2", "move_p")


AP_SQL = """SELECT model, sum(pos * tp / said) / sum(pos) AS pr_auc FROM (
  SELECT model, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS said FROM (
    SELECT model, move_p, sum(y2)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM pred GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY model ORDER BY move_p DESC)) GROUP BY 1"""


@query("average_precision", "E05", out(AP_SQL, "model", "", "pr_auc", ctes=PRED))
def _(spark, sf_dir):
    return M.average_precision(predictions(spark, sf_dir), ["model"], "y2", "move_p")


REG = PRED + """, reg AS (SELECT *, move_p - 0.4 AS yhat, CASE WHEN target_return_1d > threshold_dynamic THEN 1 WHEN target_return_1d < -threshold_dynamic THEN -1 ELSE 0 END AS yc,
  CASE WHEN move_p - 0.4 > threshold_dynamic THEN 1 WHEN move_p - 0.4 < -threshold_dynamic THEN -1 ELSE 0 END AS pc3 FROM pred)"""
REG_SQL = f"""SELECT model, mae, rmse, sign_accuracy, pearson, spearman, s.macro_f1 AS derived_class_macro_f1, s.balanced_accuracy AS derived_class_balanced_accuracy FROM (
  SELECT model, avg(abs(yhat - target_return_1d)) AS mae, sqrt(avg((yhat - target_return_1d) * (yhat - target_return_1d))) AS rmse,
    avg(CASE WHEN sign(yhat) = sign(target_return_1d) THEN 1.0 ELSE 0 END) AS sign_accuracy, corr(target_return_1d, yhat) AS pearson, corr(ry, rp) AS spearman FROM (
    SELECT *, rank() OVER (PARTITION BY model ORDER BY target_return_1d) + (count(*) OVER (PARTITION BY model, target_return_1d) - 1) / 2.0 AS ry,
      rank() OVER (PARTITION BY model ORDER BY yhat) + (count(*) OVER (PARTITION BY model, yhat) - 1) / 2.0 AS rp FROM reg) GROUP BY 1) m
  JOIN ({score_sql('reg', 'model', 'yc', 'pc3')}) s USING (model)"""


@query(
    "regression_scores", "E06 E07 E08 E09",
    out(REG_SQL, "model", "", "mae rmse sign_accuracy pearson spearman derived_class_macro_f1 derived_class_balanced_accuracy", ctes=REG),
)
def _(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("yhat", F.col("move_p") - 0.4)
    return M.regression_scores(p, ["model"], "target_return_1d", "yhat", "threshold_dynamic")


@query(
    "fold_summary", "A09",
    out(
        f"""SELECT model, avg(macro_f1) AS fold_macro_f1_mean, stddev_pop(macro_f1) AS fold_macro_f1_std, min(macro_f1) AS fold_macro_f1_worst,
          avg(macro_f1) - 0.25 * stddev_pop(macro_f1) AS robust_score FROM ({score_sql('pred', 'model, fold', 'y3', 'pred3')}) GROUP BY 1""",
        "model", "", "fold_macro_f1_mean fold_macro_f1_std fold_macro_f1_worst robust_score", ctes=PRED,
    ),
)
def _(spark, sf_dir):
    return M.fold_summary(M.class_scores(three(spark, sf_dir), ["model", "fold"], "y3", "pred3"), ["model"])


@query(
    "aligned_probabilities", "M10 M11 M26 F06",
    out(
        """SELECT model, series_id, date, CASE WHEN pa >= pc THEN -1 ELSE 1 END AS pred, greatest(pa, pc) / (pa + pc) AS confidence, pa / (pa + pc) AS prob_minus_1,
          0.0 AS prob_0, pc / (pa + pc) AS prob_1 FROM pred""",
        "model series_id", "date", "confidence prob_minus_1 prob_0 prob_1", "pred", ctes=PRED,
    ),
)
def _(spark, sf_dir):
    """A model that knows only the outer classes, aligned to the full list."""
    p = predictions(spark, sf_dir).withColumn("known", F.array(F.col("p3")[0], F.col("p3")[2]))
    p = p.withColumn("p", A.align_classes("known", [-1, 1], L.THREE_CLASSES))
    return D.prediction_table(p, ["model", "series_id", "date"], "p", L.THREE_CLASSES)


COMMON = PRED + ", common AS (SELECT * FROM pred WHERE (series_id, date) IN (SELECT (series_id, date) FROM pred GROUP BY series_id, date HAVING count(DISTINCT model) = 3))"


@query("common_support", "J06", out("SELECT model, series_id, date FROM common", "model series_id", "date", ctes=COMMON))
def _(spark, sf_dir):
    return J.common_support(predictions(spark, sf_dir), ["series_id", "date"], "model", 3).select("model", "series_id", "date")


ENSEMBLE = COMMON + f""", raww AS (SELECT model, greatest(macro_f1, 1e-6) AS w FROM ({score_sql('pred', 'model', 'y3', 'pred3')})),
wt AS (SELECT model, w / (SELECT sum(w) FROM raww) AS weight, w AS score FROM raww),
ens0 AS (SELECT series_id, date, any_value(fold) AS fold, any_value(y3) AS y3, sum(weight * pa) AS pa, sum(weight * pb) AS pb, sum(weight * pc) AS pc FROM common JOIN wt USING (model) GROUP BY 1, 2),
ens AS (SELECT *, CASE WHEN pa >= pb AND pa >= pc THEN -1 WHEN pb >= pc THEN 0 ELSE 1 END AS pred3, greatest(pa, pb, pc) AS conf FROM ens0)"""


def ensembled(spark, sf_dir):
    p = predictions(spark, sf_dir)
    scores = M.class_scores(p.withColumn("pred3", A.class_of_max("p3", L.THREE_CLASSES)), ["model"], "y3", "pred3")
    weights = scores.select("model", F.col("macro_f1").alias("score"))
    shared = J.common_support(p, ["series_id", "date"], "model", 3)
    return D.ensemble(shared.select("model", "series_id", "date", "p3"), weights, ["series_id", "date"], len(L.THREE_CLASSES), "p3"), p, weights


@query(
    "ensemble", "M17 F06",
    out("SELECT series_id, date, pa, pb, pc, pred3 FROM ens", "series_id", "date", "pa pb pc", "pred3", ctes=ENSEMBLE),
)
def _(spark, sf_dir):
    e, _, _ = ensembled(spark, sf_dir)
    p = F.col("p3")
    return e.select(
        "series_id", "date", p[0].alias("pa"), p[1].alias("pb"), p[2].alias("pc"), A.class_of_max("p3", L.THREE_CLASSES).alias("pred3")
    )


@query("ensemble_members", "M17", out("SELECT model, score, weight FROM wt", "model", "", "score weight", ctes=ENSEMBLE))
def _(spark, sf_dir):
    _, _, weights = ensembled(spark, sf_dir)
    return D.member_weights(weights)


@query(
    "ensemble_fold_scores", "J07 E01",
    out(score_sql("ens", "fold", "y3", "pred3"), "", "", SCORES, "fold samples", ctes=ENSEMBLE),
)
def _(spark, sf_dir):
    e, p, _ = ensembled(spark, sf_dir)
    keys = p.filter(F.col("model") == "ma").select("series_id", "date", "fold", "y3")
    judged = e.join(keys, ["series_id", "date"]).withColumn("pred3", A.class_of_max("p3", L.THREE_CLASSES))
    return M.class_scores(judged, ["fold"], "y3", "pred3")


def _values(grid):
    return ", ".join(f"({i}, {t!r}::DOUBLE, {round(t, 3)!r}::DOUBLE)" for i, t in enumerate(grid))


MOVE_T = f", tgrid(i, t, threshold) AS (VALUES {_values(D.MOVE_GRID)}), tp AS (SELECT model, threshold, y2, CASE WHEN move_p >= t THEN 1 ELSE 0 END AS hit FROM pred, tgrid)"


@query(
    "threshold_scores", "J09 E10",
    out(score_sql("tp", "model, threshold", "y2", "hit"), "model", "", "threshold " + SCORES, "samples", ctes=PRED + MOVE_T),
)
def _(spark, sf_dir):
    return D.threshold_scores(predictions(spark, sf_dir), ["model"], "y2", "move_p")


TWO_T = f""", tgrid(i, t, threshold) AS (VALUES {_values(D.TWO_STAGE_GRID)}),
tp AS (SELECT model, threshold, y3, CASE WHEN move_p >= t THEN CASE WHEN up_p >= 0.5 THEN 1 ELSE -1 END ELSE 0 END AS hit FROM pred, tgrid)"""


@query(
    "two_stage_thresholds", "M19 E10 J09",
    out(score_sql("tp", "model, threshold", "y3", "hit"), "model", "", "threshold " + SCORES, "samples", ctes=PRED + TWO_T),
)
def _(spark, sf_dir):
    return D.two_stage_scores(predictions(spark, sf_dir), ["model"], "y3", "move_p", "up_p")


@query(
    "two_stage_prediction", "M19",
    out(
        "SELECT model, series_id, date, CASE WHEN move_p >= 0.45 THEN CASE WHEN up_p >= 0.5 THEN 1 ELSE -1 END ELSE 0 END AS prediction FROM pred",
        "model series_id", "date", (), "prediction", ctes=PRED,
    ),
)
def _(spark, sf_dir):
    return predictions(spark, sf_dir).select("model", "series_id", "date", D.two_stage_prediction("move_p", "up_p", 0.45).alias("prediction"))


CUT = PRED + """, one AS (SELECT * FROM pred WHERE model = 'ma'), oc AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM one)),
late AS (SELECT date AS late FROM oc WHERE i = (SELECT least(greatest(60, floor(count(*) * 0.6)), count(*) - 30) FROM oc)),
parts AS (SELECT one.*, CASE WHEN date < late THEN 'select' ELSE 'verify' END AS part FROM one, late)"""


@query(
    "selection_cut", "V06",
    out("SELECT part, count(*) AS rows, min(date) AS first, max(date) AS last FROM parts GROUP BY 1", "part", "first last", (), "rows", ctes=CUT),
)
def _(spark, sf_dir):
    one = predictions(spark, sf_dir).filter(F.col("model") == "ma")
    return SP.selection_cut(one).groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"))


VERIFY = CUT + f""", tgrid(i, t, threshold) AS (VALUES {_values(D.MOVE_GRID)}),
tp AS (SELECT threshold, y2, CASE WHEN move_p >= t THEN 1 ELSE 0 END AS hit FROM parts, tgrid WHERE part = 'select'),
chosen AS (SELECT threshold AS decision_threshold FROM ({score_sql('tp', 'threshold', 'y2', 'hit')}) ORDER BY round(macro_f1, 12) DESC, round(balanced_accuracy, 12) DESC, threshold LIMIT 1),
late_rows AS (SELECT 'ma' AS model, y2, move_p, CASE WHEN move_p >= decision_threshold THEN 1 ELSE 0 END AS hit FROM parts, chosen WHERE part = 'verify')"""
VERIFY_SQL = f"""SELECT c.decision_threshold, s.*, a.roc_auc, p.pr_auc, b.brier FROM chosen c, ({score_sql('late_rows', '', 'y2', 'hit')}) s,
  ({AUC_SQL.replace('FROM pred)', 'FROM late_rows)')}) a, ({AP_SQL.replace('FROM pred GROUP', 'FROM late_rows GROUP')}) p,
  (SELECT avg((move_p - y2) * (move_p - y2)) AS brier FROM late_rows) b"""


@query(
    "threshold_verification", "E10 V06 E05",
    out(VERIFY_SQL, "", "", "decision_threshold " + SCORES + " roc_auc pr_auc brier", "samples", ctes=VERIFY),
)
def _(spark, sf_dir):
    parts = SP.selection_cut(predictions(spark, sf_dir).filter(F.col("model") == "ma"))
    early, late = parts.filter(F.col("part") == "select"), parts.filter(F.col("part") == "verify")
    chosen = D.best_threshold(D.threshold_scores(early, [], "y2", "move_p"), [])
    return D.verify_threshold(late, chosen, "y2", "move_p")


@query(
    "three_class_baselines", "M22",
    out(
        f"""SELECT * FROM ({score_sql('b', 'fold, baseline', 'y3', 'hit')})""", "baseline", "", SCORES, "fold samples",
        ctes=PRED + """, b AS (SELECT fold, y3, 'always_neutral' AS baseline, 0 AS hit FROM pred WHERE model = 'ma' UNION ALL
          SELECT fold, y3, 'previous_day_momentum', CASE WHEN r1 > threshold_dynamic THEN 1 WHEN r1 < -threshold_dynamic THEN -1 ELSE 0 END FROM pred WHERE model = 'ma')""",
    ),
)
def _(spark, sf_dir):
    one = predictions(spark, sf_dir).filter(F.col("model") == "ma")
    return D.three_class_baselines(one, "y3", "r1", "threshold_dynamic")


@query(
    "move_baselines", "M22",
    out(
        score_sql("b", "baseline", "y2", "hit"), "baseline", "", SCORES, "samples",
        ctes=PRED + """, b AS (SELECT y2, 'always_no_move' AS baseline, 0 AS hit FROM pred WHERE model = 'ma' UNION ALL
          SELECT y2, 'previous_day_move', CASE WHEN abs(r1) > threshold_dynamic THEN 1 ELSE 0 END FROM pred WHERE model = 'ma')""",
    ),
)
def _(spark, sf_dir):
    one = predictions(spark, sf_dir).filter(F.col("model") == "ma")
    return D.move_baselines(one, "y2", "r1", "threshold_dynamic")


SEL_T = f""", tgrid(i, t, threshold) AS (VALUES {', '.join(f'({i}, {t!r}::DOUBLE, {round(t, 2)!r}::DOUBLE)' for i, t in enumerate(D.CONFIDENCE_GRID))}),
tp AS (SELECT model, threshold AS confidence_threshold, y3, pred3 FROM pred, tgrid WHERE greatest(pa, pb, pc) >= t)"""


@query(
    "selective_curve", "M23 J09",
    out(
        f"""SELECT s.*, s.samples / a.n AS coverage FROM ({score_sql('tp', 'model, confidence_threshold', 'y3', 'pred3')}) s
            JOIN (SELECT model, count(*) AS n FROM pred GROUP BY 1) a USING (model) WHERE samples >= 30""",
        "model", "", "confidence_threshold coverage " + SCORES, "samples", ctes=PRED + SEL_T,
    ),
)
def _(spark, sf_dir):
    p = three(spark, sf_dir).withColumn("conf", A.confidence("p3"))
    return D.selective_curve(p, ["model"], "y3", "pred3", "conf")


REGIME = PRED + """, rg AS (SELECT y3, pred3, CASE WHEN move_p < 0.33 THEN 'vol_low' WHEN move_p < 0.67 THEN 'vol_mid' ELSE 'vol_high' END AS regime FROM pred
  UNION ALL SELECT y3, pred3, CASE WHEN r1 >= 0 THEN 'trend_above_ema90' ELSE 'trend_below_ema90' END FROM pred WHERE r1 IS NOT NULL)"""


@query("regime_scores", "M24 J10", out(score_sql("rg", "regime", "y3", "pred3"), "regime", "", SCORES, "samples", ctes=REGIME))
def _(spark, sf_dir):
    return D.regime_scores(three(spark, sf_dir), "y3", "pred3", "move_p", "r1")


LOG = PRED + """, lg AS (SELECT date, series_id, y2, CASE WHEN move_p >= 0.5 THEN 1 ELSE 0 END AS hit FROM pred WHERE model = 'mc'),
ld AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM lg)),
rv AS (SELECT d AS review_days, y2, hit FROM lg JOIN ld USING (date), (VALUES (30), (60), (90), (180), (365)) AS r(d) WHERE i < d AND d <= (SELECT count(*) FROM ld))"""


@query(
    "prospective_reviews", "E11",
    out(
        f"""SELECT s.*, true_move, false_move, missed_move, true_quiet, move_prevalence FROM ({score_sql('rv', 'review_days', 'y2', 'hit')}) s JOIN (
          SELECT review_days, count(*) FILTER (y2 = 1 AND hit = 1) AS true_move, count(*) FILTER (y2 = 0 AND hit = 1) AS false_move,
            count(*) FILTER (y2 = 1 AND hit = 0) AS missed_move, count(*) FILTER (y2 = 0 AND hit = 0) AS true_quiet, avg(y2) AS move_prevalence FROM rv GROUP BY 1) c USING (review_days)""",
        "", "", SCORES + " move_prevalence", "review_days samples true_move false_move missed_move true_quiet", ctes=LOG,
    ),
)
def _(spark, sf_dir):
    p = predictions(spark, sf_dir).filter(F.col("model") == "mc")
    said = p.select("series_id", "date", F.col("move_p").alias("move_probability"))
    outcomes = p.select("series_id", "date", F.col("y2").alias("actual_label"))
    return D.prospective_reviews(D.prospective_log(said, outcomes, ["series_id", "date"], 0.5))


# --- rankings -----------------------------------------------------------------------------

SC = PRED + f", sc AS ({score_sql('pred', 'model, fold', 'y3', 'pred3')})"


def fold_scores(spark, sf_dir):
    return M.class_scores(three(spark, sf_dir), ["model", "fold"], "y3", "pred3")


@query(
    "config_ranking", "O02 O01",
    out(
        "SELECT model, fold, row_number() OVER (ORDER BY round(macro_f1, 9) DESC, round(accuracy, 9) DESC, model, fold) AS place FROM sc",
        "model", "", (), "fold place", ctes=SC,
    ),
)
def _(spark, sf_dir):
    """Score table (models x folds) ranked by several keys."""
    from pyspark.sql import Window

    s = fold_scores(spark, sf_dir)
    order = Window.orderBy(F.round("macro_f1", 9).desc(), F.round("accuracy", 9).desc(), "model", "fold")
    return s.select("model", "fold", F.row_number().over(order).alias("place"))


@query(
    "top_values", "O03",
    out("SELECT fold, max(macro_f1) AS macro_f1 FROM sc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2", "", "", "macro_f1", "fold", ctes=SC),
)
def _(spark, sf_dir):
    return RK.top_values(fold_scores(spark, sf_dir), "fold", "macro_f1", 2)


@query(
    "promoted_configs", "O04",
    out(
        "SELECT model, fold, rank FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY macro_f1 DESC, fold) AS rank FROM sc) WHERE rank <= 3",
        "model", "", (), "fold rank", ctes=SC,
    ),
)
def _(spark, sf_dir):
    return RK.top_per_group(fold_scores(spark, sf_dir), ["model"], [F.col("macro_f1").desc(), F.col("fold")], 3).select("model", "fold", "rank")


@query(
    "best_config", "O05",
    out("SELECT model, arg_max(fold, row(macro_f1, accuracy)) AS fold, max(macro_f1) AS macro_f1 FROM sc GROUP BY 1", "model", "", "macro_f1", "fold", ctes=SC),
)
def _(spark, sf_dir):
    return RK.best_per_group(fold_scores(spark, sf_dir), ["model"], [F.col("macro_f1"), F.col("accuracy")], ["fold", "macro_f1"])


@query(
    "scorecard", "E12",
    out(
        f"""SELECT 'three_class' AS task, best_model, best_macro_f1 FROM (SELECT arg_max(model, macro_f1) AS best_model, max(macro_f1) AS best_macro_f1 FROM ({score_sql('pred', 'model', 'y3', 'pred3')}))
            UNION ALL SELECT 'move', best_model, best_macro_f1 FROM (SELECT arg_max(model, macro_f1) AS best_model, max(macro_f1) AS best_macro_f1
              FROM ({score_sql('(SELECT model, y2, CASE WHEN move_p >= 0.5 THEN 1 ELSE 0 END AS hit FROM pred)', 'model', 'y2', 'hit')}))""",
        "task best_model", "", "best_macro_f1", ctes=PRED,
    ),
)
def _(spark, sf_dir):
    p = three(spark, sf_dir).withColumn("hit", (F.col("move_p") >= 0.5).cast("int"))
    best = lambda task, y, pred: M.class_scores(p, ["model"], y, pred).agg(
        F.max_by("model", "macro_f1").alias("best_model"), F.max("macro_f1").alias("best_macro_f1")
    ).select(F.lit(task).alias("task"), "best_model", "best_macro_f1")
    return best("three_class", "y3", "pred3").unionByName(best("move", "y2", "hit"))
