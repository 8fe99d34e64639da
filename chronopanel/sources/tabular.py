"""Table scans and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import file_stem
from ..operators.cleaning import normalise_table, rename, tidy_columns, to_numbers

PANEL_SCHEMA = T.StructType(
    [
        T.StructField("series_id", T.StringType(), False),
        T.StructField("date", T.DateType(), False),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adj_close", "volume")],
    ]
)

# Column names of the classic export and of the provider payload.
CLASSIC_NAMES = {
    "Opening Price": "open",
    "Highest Price": "high",
    "Lowest Price": "low",
    "Closing Price": "close",
    "Adjusted Closing Price": "adj_close",
    "Trading Volume": "volume",
}
PROVIDER_FIELDS = {
    "Date": "date",
    "Open": "open",
    "High": "high",
    "Low": "low",
    "Close": "close",
    "Adj Close": "adj_close",
    "Volume": "volume",
}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches the path, on whatever file system it names."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(target)
    return found is not None and len(found) > 0


def read_text_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header as text columns, plus the file and an arrival key.

    Arrival orders rows by file name, by split offset inside the file and then by
    Spark's row id, which grows along a split.
    """
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    arrival = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return df.withColumns({"source_file": F.col("_metadata.file_path"), "ingest_order": arrival})


def read_optional(spark: SparkSession, path: str, date_col: str = "date") -> DataFrame | None:
    """A dated table, or None when the file or its date column is missing."""
    if not exists(spark, path):
        return None
    df = read_text_table(spark, path)
    if date_col not in df.columns:
        return None
    clean = normalise_table(df, date_col, "ingest_order")
    return clean.drop("source_file", "ingest_order")


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """Reload a stored panel or dataset with its types."""
    return spark.read.parquet(path)


def read_instruments(
    spark: SparkSession, glob: str, names: Mapping[str, str] = CLASSIC_NAMES, suffix: str = "", pattern: str | None = None
) -> DataFrame:
    """One CSV (or CSV folder) per instrument; the series comes from the path.

    By default the file stem without ``suffix``; ``pattern`` gives another first group.
    """
    df = rename(read_text_table(spark, glob), names)
    series = F.regexp_extract("source_file", pattern, 1) if pattern else file_stem("source_file", suffix)
    return tidy_columns(df.withColumn("series_id", series).drop("source_file", "ingest_order"))


def provider_bars(raw: DataFrame, series: Column, ingest_order: str, fields: Mapping[str, str] = PROVIDER_FIELDS) -> DataFrame:
    """Provider payload to the panel: known fields picked, renamed and typed, first row per date kept."""
    kept = [c for c in fields if c in raw.columns]
    df = raw.select(series.alias("series_id"), F.col(ingest_order).alias("__in"), *[F.col(c).alias(fields[c]) for c in kept])
    numbers = [fields[c] for c in kept if fields[c] != "date"]
    return normalise_table(to_numbers(df, numbers), "date", "__in", keys=["series_id"]).drop("__in")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Small summary tables as JSON lines."""
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)
