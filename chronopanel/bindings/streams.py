"""Streaming queries: each is drained over the whole table and checked like a batch query."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators.ewm import span_alpha
from ..session import scratch_path, stored
from ..streaming import bars as SB
from ..streaming import labels as SL
from ..streaming import sinks as SK
from ..streaming import stateful as SS
from .base import out, query, table
from .evaluation import PRED, predictions, score_sql
from .price import EVENT_BARS, event_bars


def event_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")


@query(
    "streaming_bars", "T01 A11",
    out(
        """SELECT series_id, date, open, high, low, close, volume FROM (
          SELECT event_type AS series_id, CAST(ts AS DATE) AS date, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low,
            arg_max(value, event_id) AS close, count(*) AS volume FROM events GROUP BY 1, 2)
          WHERE date + 1 <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
        "series_id", "date", "open high low close", "volume",
    ),
)
def _(spark, sf_dir):
    s = SB.streaming_bars(event_stream(spark, sf_dir), F.col("event_type"), "ts", F.col("event_id"), F.col("value"), F.lit(1))
    return SK.drained(s, "bars").select("series_id", F.to_date("period").alias("date"), "open", "high", "low", "close", "volume")


@query(
    "streaming_sentiment", "T02",
    out(
        """SELECT date, count(*) AS x_post_count, avg(c) AS x_sentiment_mean, quantile_disc(c, 0.5) AS x_sentiment_median, avg(CASE WHEN c >= 0.05 THEN 1.0 ELSE 0 END) AS x_positive_share,
             sum(user_id) AS x_engagement, sum(c * wt) / sum(wt) AS x_sentiment_weighted FROM (
               SELECT CAST(ts AS DATE) AS date, (value - 50) / sqrt((value - 50) * (value - 50) + 15) AS c, user_id, 1 + ln(1 + user_id) AS wt FROM events) GROUP BY 1
           HAVING date + 1 <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
        "", "date", "x_sentiment_mean x_sentiment_median x_positive_share x_engagement x_sentiment_weighted", "x_post_count",
    ),
)
def _(spark, sf_dir):
    """Events as scored posts: the centred value is the raw polarity, the user number the engagement."""
    s = F.col("value") - 50
    scored = event_stream(spark, sf_dir).select(
        F.col("ts").cast("timestamp").alias("time"), (s / F.sqrt(s * s + 15)).alias("compound"),
        F.col("user_id").cast("double").alias("engagement"), (1 + F.log1p("user_id")).alias("sentiment_weight"),
    )
    done = SK.drained(SB.streaming_sentiment(scored, "time"), "sentiment")
    return done.select(
        F.to_date("period").alias("date"), "x_post_count", "x_sentiment_mean", "x_sentiment_median", "x_positive_share", "x_engagement", "x_sentiment_weighted"
    )


@query(
    "streaming_review", "T03 E11",
    out(
        f"""WITH one AS (SELECT date, y2, CASE WHEN move_p >= 0.5 THEN 1 ELSE 0 END AS hit FROM pred WHERE model = 'mc'),
            cum AS (SELECT d.date AS upto, o.y2, o.hit FROM (SELECT DISTINCT date FROM one) d JOIN one o ON o.date <= d.date)
            SELECT upto AS date, samples, accuracy, balanced_accuracy, macro_f1 FROM ({score_sql('cum', 'upto', 'y2', 'hit')})""",
        "", "date", "accuracy balanced_accuracy macro_f1", "samples", ctes=PRED,
    ),
)
def _(spark, sf_dir):
    log = predictions(spark, sf_dir).filter(F.col("model") == "mc").select(
        "date", F.col("y2").alias("y"), (F.col("move_p") >= 0.5).cast("int").alias("pred")
    )
    landed = scratch_path(spark, "log")
    log.repartition(4, "date").write.parquet(landed)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    path = scratch_path(spark, "review")
    SK.review_stream(stream, path, scratch_path(spark, "review-progress"))
    return SK.review_scores(spark, path)


IND = f"""b AS ({EVENT_BARS}), nb AS (SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS pc, close - lag(close) OVER w AS step FROM b WINDOW w AS (PARTITION BY series_id ORDER BY hour)),
e AS (SELECT series_id, rn, close AS y, CAST(0 AS DOUBLE) AS gain, CAST(0 AS DOUBLE) AS loss FROM nb WHERE rn = 1
  UNION ALL SELECT q.series_id, q.rn, e.y * (1 - {span_alpha(20)!r}) + {span_alpha(20)!r} * q.close,
    CASE WHEN q.rn <= 15 THEN e.gain + greatest(q.step, 0) / 14 ELSE e.gain + (greatest(q.step, 0) - e.gain) / 14 END,
    CASE WHEN q.rn <= 15 THEN e.loss + greatest(-q.step, 0) / 14 ELSE e.loss + (greatest(-q.step, 0) - e.loss) / 14 END
  FROM e JOIN nb q ON q.series_id = e.series_id AND q.rn = e.rn + 1)"""
#: Days of bars that land together, and how late a bar may come: odd hours land one slice after their own.
SLICE_DAYS, LATE_DAYS = 3, 5
#: Files that the bars of a slice land in.
SLICE_FILES = 4


@query(
    "streaming_indicators", "T04",
    out(
        """SELECT nb.series_id, nb.hour AS period, nb.close, e.y AS ema, sum(coalesce(sign(nb.close - pc), 0) * volume) OVER (PARTITION BY nb.series_id ORDER BY hour) AS obv,
             CASE WHEN rn > 14 AND e.gain + e.loss > 0 THEN 100 * e.gain / (e.gain + e.loss) END AS rsi,
             CASE WHEN rn >= 20 THEN avg(nb.close) OVER (PARTITION BY nb.series_id ORDER BY hour ROWS 19 PRECEDING) END AS sma
           FROM nb JOIN e USING (series_id, rn)""",
        "series_id", "period", "close ema obv rsi sma", ctes=IND,
    ),
)
def _(spark, sf_dir):
    """Hourly bars as files that land one after another, out of order, the files of a slice together in one micro-batch.

    Last lands a closing bar beyond the lateness: the watermark passes every bar of the table, and the closing one, which it
    does not pass, is never given out.
    """
    b = event_bars(spark, sf_dir).select("series_id", F.col("hour").cast("timestamp").alias("period"), "close", F.col("volume").cast("double").alias("volume"))
    late = F.expr("hour(period) % 2")
    first = F.lit(b.agg(F.min("period").alias("at")).first()["at"])
    b = stored(b.withColumn("slice", F.floor(F.datediff("period", first) / SLICE_DAYS) + late), "bars-sliced")
    bars, landed = b.drop("slice"), scratch_path(spark, "bars")
    slices = b.agg(F.coalesce(F.max("slice"), F.lit(-1))).first()[0] + 1
    after = F.max("period") + F.expr(f"INTERVAL {LATE_DAYS} DAYS 1 SECOND")
    closing = bars.agg(F.min("series_id").alias("series_id"), after.alias("period"), F.lit(0.0).alias("close"), F.lit(0.0).alias("volume"))
    land = lambda part: part.write.mode("append").parquet(landed)
    land(bars.limit(0))
    parts = [b.filter(F.col("slice") == k).drop("slice").repartition(SLICE_FILES) for k in range(slices)] + [closing.filter("period IS NOT NULL")]
    stream = spark.readStream.schema(bars.schema).parquet(landed)
    done = SK.drained(SS.streaming_indicators(stream, lateness=f"{LATE_DAYS} days"), "indicators", [partial(land, p) for p in parts])
    return done.select("series_id", "period", "close", "ema", "obv", "rsi", "sma")


#: Days after which a label is looked for no longer; labels come up to 28 days after their prediction, those of every seventh
#: volume later still, and count as unknown.
HORIZON_DAYS, BATCH_DAYS, LONGEST_DAYS = 30, 400, 45
DELAY = f"CASE WHEN units % 7 = 0 THEN {LONGEST_DAYS} ELSE 1 + units % 28 END"


@query(
    "streaming_late_labels", "T03 E11",
    out(
        f"""WITH one AS (SELECT date, y2, CASE WHEN move_p >= 0.5 THEN 1 ELSE 0 END AS hit, cents // 100 % 7 = 0 AS never
              FROM pred WHERE model = 'mc'),
            cum AS (SELECT d.date AS upto, o.y2, o.hit FROM (SELECT DISTINCT date FROM one WHERE NOT never) d JOIN one o ON o.date <= d.date AND NOT o.never),
            lost AS (SELECT d.date AS upto, count(*) FILTER (never) AS n FROM (SELECT DISTINCT date FROM one WHERE NOT never) d JOIN one o ON o.date <= d.date GROUP BY 1)
            SELECT s.upto AS date, samples, lost.n AS unlabelled, accuracy, balanced_accuracy, macro_f1 FROM ({score_sql('cum', 'upto', 'y2', 'hit')}) s JOIN lost USING (upto)""",
        "", "date", "accuracy balanced_accuracy macro_f1", "samples unlabelled", ctes=PRED,
    ),
)
def _(spark, sf_dir):
    """Predictions and labels are files of two streams; the label of a prediction lands days after it, in another file.

    The review is that of the batch queries: cumulative scores up to each day with a known label, and how many predictions
    up to then never got one.
    """
    p = stored(
        predictions(spark, sf_dir).filter(F.col("model") == "mc").select(
            "series_id", "date", (F.col("move_p") >= 0.5).cast("int").alias("pred"), F.col("y2").alias("y"), F.expr("cents DIV 100").alias("units")
        ),
        "predicted",
    )
    made = F.col("date").cast("timestamp").alias("made")
    said = p.select("series_id", "date", "pred", made)
    truth = p.select("series_id", "date", "y", (F.col("date").cast("timestamp") + F.make_dt_interval(F.expr(DELAY))).alias("known"))
    first, last = p.agg(F.min("date"), F.max("date")).first()
    if first is None:
        return SK.cumulative_review(p.groupBy("date", "y", "pred").agg(F.count(F.lit(1)).alias("n")))
    paths = scratch_path(spark, "said"), scratch_path(spark, "truth")
    slice_of = lambda c: F.floor(F.datediff(c, F.lit(first)) / BATCH_DAYS)
    # far ahead, so that the watermarks pass all horizons; of no series (a null key would be filtered before the watermark sees it)
    beyond = F.lit(last).cast("timestamp") + F.make_dt_interval(F.lit(4 * HORIZON_DAYS))
    closing = {"series_id": F.lit("no series"), "date": beyond, "made": beyond, "known": beyond}
    none = F.lit(None)
    ends = [
        d.limit(1).select(*[F.concat(closing[c], F.lit(f" {i}")).alias(c) if c == "series_id" else closing.get(c, none).cast(d.schema[c].dataType).alias(c) for c in d.columns])
        for i, d in enumerate((said, truth))
    ]
    for d, path in zip((said, truth), paths):
        d.limit(0).write.parquet(path)

    def land(k):
        for d, path, at, end in zip((said, truth), paths, ("made", "known"), ends):
            part = end if k is None else d.filter(slice_of(F.col(at)) == k)
            part.write.mode("append").parquet(path)

    slices = ((last - first).days + LONGEST_DAYS) // BATCH_DAYS + 1
    streams = [spark.readStream.schema(d.schema).parquet(path) for d, path in zip((said, truth), paths)]
    joined = SL.late_labels(*streams, ["series_id", "date"], "made", "known", f"{HORIZON_DAYS} DAYS")
    done = SK.drained(joined, "late-labels", [partial(land, k) for k in [*range(slices), None]])
    return SK.cumulative_review(done.groupBy("date", "y", "pred").agg(F.count(F.lit(1)).alias("n")))
