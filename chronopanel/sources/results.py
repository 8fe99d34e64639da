"""Stored experiment results and model artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tabular import exists
from ..session import small_table

RESULT_SCHEMA = (
    "config_hash string, kind string, phase string, train_window_days int, vol_window int, k double, "
    "feature_set string, model string, top_k int, n_splits int, seed int, task string, "
    "accuracy double, balanced_accuracy double, macro_f1 double, log_loss double, roc_auc double, brier double, "
    "fold_macro_f1_mean double, fold_macro_f1_std double, fold_macro_f1_worst double, robust_score double, "
    "oof_rows bigint, selected_features array<array<string>>"
)


#: Log of the stages that asked for a configuration.
STAGE_SCHEMA = "run string, position int, stage string, phase string, config_hash string"


class ResultStore:
    """Append-only experiment table: a finished configuration is never computed again.

    Beside it lie the out-of-fold predictions of each configuration and the log of stages.  A configuration's row is appended
    after its predictions are written, so the row is the commit: a run that was killed before it writes the predictions again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return small_table(self.spark, [], RESULT_SCHEMA)
        return self.spark.read.schema(RESULT_SCHEMA).parquet(self.path).dropDuplicates(["config_hash"])

    def predictions_path(self, config_hash: str) -> str:
        return f"{self.path}-predictions/{config_hash}"

    def predictions(self, config_hash: str) -> DataFrame:
        """Out-of-fold rows of a finished configuration: series_id, date, y, p, fold, pred."""
        return self.spark.read.parquet(self.predictions_path(config_hash))

    def note(self, run: str, position: int, stage: str, phase: str, grid: DataFrame) -> None:
        """Log which configurations a stage asks for (one small row each)."""
        rows = grid.select(
            F.lit(run).alias("run"), F.lit(position).alias("position"), F.lit(stage).alias("stage"), F.lit(phase).alias("phase"), "config_hash"
        )
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}-stages")

    def stages(self, run: str) -> DataFrame:
        """Stages of a run with the results of their configurations; a stage that a restarted run logged again counts once."""
        path = f"{self.path}-stages"
        log = self.spark.read.schema(STAGE_SCHEMA).parquet(path) if exists(self.spark, path) else small_table(self.spark, [], STAGE_SCHEMA)
        log = log.filter(F.col("run") == run).dropDuplicates(["position", "stage", "config_hash"])
        return log.join(self.load().drop("phase", "kind"), "config_hash")

    def append(self, rows: list[dict]) -> None:
        """Add finished summaries (one small row per experiment)."""
        if rows:
            names = [f.split()[0] for f in RESULT_SCHEMA.split(", ")]
            data = [tuple(r.get(n) for n in names) for r in rows]
            small_table(self.spark, data, RESULT_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
