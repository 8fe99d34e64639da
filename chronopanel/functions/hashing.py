"""Stable identifiers for configurations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(columns: list[str]) -> Column:
    """JSON of the named columns with keys in alphabetical order; NULL stays explicit."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def config_hash(columns: list[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)
