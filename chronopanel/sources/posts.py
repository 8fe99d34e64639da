"""Post tables with varying column names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.cleaning import first_synonym

# Accepted names, first hit wins.
TEXT_NAMES = ("text", "content", "tweet", "post")
TIME_NAMES = ("created_at", "date", "timestamp", "time")


def resolve_posts(df: DataFrame) -> DataFrame | None:
    """Posts with ``text`` and ``created_at``, or None when either has no known name."""
    return first_synonym(df, {"text": TEXT_NAMES, "created_at": TIME_NAMES})
