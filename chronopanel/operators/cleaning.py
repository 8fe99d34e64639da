"""Cleaning, coercion, deduplication and validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import col, finite_frame, to_double


class InvalidPanel(ValueError):
    """A temporal dataset breaks one of its rules."""


def utc_date(c: str | Column) -> Column:
    """Timestamp text to its UTC calendar date; unreadable text becomes NULL."""
    return F.to_date(F.try_to_timestamp(col(c).cast("string")))


def epoch_date(seconds: str | Column) -> Column:
    return F.to_date(F.timestamp_seconds(col(seconds).try_cast("long")))


def to_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_double(c) for c in columns})


def tidy_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def first_synonym(df: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame | None:
    """Rename the first present synonym of each name; None when one has no match."""
    for target, names in wanted.items():
        found = next((n for n in names if n in df.columns), None)
        if found is None:
            return None
        df = df if found == target else df.withColumnRenamed(found, target)
    return df


def keep_first(df: DataFrame, keys: Sequence[str], ingest_order: str) -> DataFrame:
    """First arrival per key; aggregated map-side so a hot key never meets in one task."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.col(ingest_order)).alias("__first"))
        .select(*keys, "__first.*")
        .select(*df.columns)
    )


def normalise_table(df: DataFrame, date_col: str, ingest_order: str, keys: Sequence[str] = ()) -> DataFrame:
    """Dates coerced, rows without a date dropped, first arrival per date kept."""
    dated = df.withColumn(date_col, utc_date(date_col)).na.drop(subset=[date_col])
    return keep_first(dated, [*keys, date_col], ingest_order)


def drop_unknown(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)


def finite_only(df: DataFrame) -> DataFrame:
    return finite_frame(df)


def recent_window(df: DataFrame, days: int | None, date: str = "date") -> DataFrame:
    """Rows no older than ``days`` before the last date."""
    if days is None:
        return df
    edge = df.agg(F.date_sub(F.max(date), days).alias("__edge"))
    return df.join(F.broadcast(edge), F.col(date) >= F.col("__edge")).drop("__edge")


def after_review(df: DataFrame, reviewed: DataFrame, date: str = "date", target_end: str = "target_end_date") -> DataFrame:
    """Rows from the day after the last reviewed target."""
    edge = reviewed.agg(F.date_add(F.max(target_end), 1).alias("__edge"))
    return df.join(F.broadcast(edge), F.col(date) >= F.col("__edge")).drop("__edge")


REQUIRED = ("date", "target_end_date", "target_return_1d")


def temporal_violations(df: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """One row of violation counts: null_key, duplicate_key, target_not_after."""
    nulls = F.col("date").isNull() | F.col("target_end_date").isNull() | F.col("target_return_1d").isNull()
    known = df.filter(~nulls)
    dup = known.groupBy(*keys, "date").count().agg(
        F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count") - 1)), F.lit(0)).alias("duplicate_key")
    )
    rules = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(nulls).alias("null_key"),
        F.count_if(~nulls & (F.col("target_end_date") <= F.col("date"))).alias("target_not_after"),
    )
    return rules.join(F.broadcast(dup))


def validated(df: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Drop rows without key or target, then raise when order or targets are unsound."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise InvalidPanel(f"missing columns: {sorted(missing)}")
    clean = df.na.drop(subset=list(REQUIRED))
    found = temporal_violations(clean, keys).first()
    if found["duplicate_key"]:
        raise InvalidPanel(f"{found['duplicate_key']} repeated dates")
    if found["target_not_after"]:
        raise InvalidPanel(f"{found['target_not_after']} targets do not end after their date")
    return clean
