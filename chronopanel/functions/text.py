"""Text expressions for posts and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col

# Patterns removed from a post before scoring.
URL_PATTERN = r"https?://\S+"
MENTION_PATTERN = r"@\w+"
HASH_MARK = r"#"
SPACE_RUN = r"\s+"


def clean_post(c: str | Column) -> Column:
    text = F.coalesce(col(c).cast("string"), F.lit(""))
    text = F.regexp_replace(text, URL_PATTERN, " ")
    text = F.regexp_replace(text, MENTION_PATTERN, " ")
    text = F.regexp_replace(text, HASH_MARK, "")
    return F.trim(F.regexp_replace(text, SPACE_RUN, " "))


def tidy_name(c: str | Column) -> Column:
    return F.lower(F.trim(col(c)))


def file_stem(path: str | Column, suffix: str = "") -> Column:
    """Base name of a path without its extension and an optional suffix."""
    base = F.regexp_extract(col(path), r"([^/\\]+)$", 1)
    stem = F.regexp_replace(base, r"\.[A-Za-z0-9]+$", "")
    return F.regexp_replace(stem, f"{suffix}$", "") if suffix else stem


def replace_suffix(c: str | Column, old: str, new: str) -> Column:
    return F.regexp_replace(col(c), f"{old}$", new)
