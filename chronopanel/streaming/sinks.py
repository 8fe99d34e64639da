"""Draining a stream to files and reviewing predictions incrementally."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.metrics import scores_from_confusion
from ..session import scratch_path


PARTITIONS = "spark.sql.shuffle.partitions"


@contextmanager
def state_partitions(spark: SparkSession) -> Iterator[None]:
    """No more state partitions than there are cores: each of them opens and commits its stores in every micro-batch.

    A stream keeps the number that it began with in its checkpoint.
    """
    before = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(PARTITIONS, before)


def drained(stream: DataFrame, label: str, landings: Iterable[Callable[[], None]] = (lambda: None,)) -> DataFrame:
    """Run a stream over everything that is available, into files, and read them back.

    Each of ``landings`` adds input; the stream goes on where it was after each of them, so files that land together are one
    micro-batch, however many there are.
    """
    spark = stream.sparkSession
    path, progress = scratch_path(spark, label), scratch_path(spark, f"{label}-progress")
    for land in landings:
        land()
        with state_partitions(spark):
            run = (
                stream.writeStream.format("parquet").outputMode("append")
                .option("path", path).option("checkpointLocation", progress)
                .trigger(availableNow=True).start()
            )
            run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def review_stream(stream: DataFrame, path: str, progress: str) -> None:
    """Confusion counts per day of each micro-batch.

    ``stream``: date, y (NULL while unknown), pred.  A batch owns its folder,
    so a replayed batch overwrites itself and counts stay exact.  Only counts
    are kept; scores are derived from them at any time.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.filter(F.col("y").isNotNull()).groupBy("date", "y", "pred").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def review_scores(spark: SparkSession, path: str) -> DataFrame:
    """Cumulative scores up to each labelled day (one row per calendar day) from the counts of all batches."""
    counts = spark.read.parquet(path).groupBy("date", "y", "pred").agg(F.sum("n").alias("n"))
    return cumulative_review(counts).drop("unlabelled")


def cumulative_review(counts: DataFrame) -> DataFrame:
    """Cumulative scores up to each labelled day, and how many predictions up to it have no label.

    ``counts``: date, y (NULL where no label came), pred, n.  Windows hold one row per calendar day and cell.
    """
    counts = counts.withColumn("y", F.col("y").cast("int"))
    labelled = counts.filter(F.col("y").isNotNull())
    days = labelled.select("date").distinct()
    cells = labelled.select("y", "pred").distinct()
    grid = days.join(F.broadcast(cells)).join(labelled, ["date", "y", "pred"], "left")
    running = Window.partitionBy("y", "pred").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    total = grid.withColumn("n", F.coalesce(F.sum("n").over(running), F.lit(0))).filter(F.col("n") > 0)
    lost = counts.groupBy("date").agg(F.sum(F.when(F.col("y").isNull(), F.col("n")).otherwise(0)).alias("n"))
    so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    lost = lost.select("date", F.sum("n").over(so_far).alias("unlabelled"))
    return scores_from_confusion(total, ["date"]).join(lost, "date")
