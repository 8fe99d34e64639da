"""What arrived: per-source status and row counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from ..session import small_table


def source_status(panel: DataFrame, expected: Sequence[str], key: str = "series_id", value: str = "close") -> DataFrame:
    """ok / empty / missing for each expected series."""
    want = small_table(panel.sparkSession, [(s,) for s in expected], f"{key} string")
    seen = panel.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.count(value).alias("__known"))
    joined = want.join(seen, key, "left")
    status = F.when(F.col("rows").isNull(), "missing").when(F.col("__known") == 0, "empty").otherwise("ok")
    return joined.select(key, status.alias("status"), F.coalesce("rows", F.lit(0)).alias("rows"))


def collection_inventory(sources: Mapping[str, DataFrame | None]) -> DataFrame:
    """Rows per named source; an absent source counts 0."""
    parts = []
    spark = next(df.sparkSession for df in sources.values() if df is not None)
    for name, df in sources.items():
        if df is None:
            parts.append(small_table(spark, [(name, 0)], "source string, rows bigint"))
        else:
            parts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("source"), "rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
