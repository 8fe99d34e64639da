"""Exact duplicates by distributed radix partitioning from the first bytes on; texts are compared by their bytes alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

#: Bytes looked at on the first level; every further level looks at so many times more.
DIGIT, GROWTH = 64, 128
SPACES = "[\\x20\\x09-\\x0D]+"


def normalised(text):
    """White-space runs become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _refine(active: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of at least two rows with equal keys, each with a number of its own, its size and smallest document id.

    The written table fixes the numbers and lets the join back split a hot key.  It is as large as the repeated texts, so it
    is merged by its keys at every size and never sent whole to all executors.
    """
    groups = active.groupBy(*keys).agg(F.count("*").alias("n"), F.min("doc_id").alias("low")).filter("n > 1")
    return stored(groups.withColumn("next", F.monotonically_increasing_id()), "radix-groups").hint("merge")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, text_sha256) per row of ``docs``.

    Level 0 splits by byte length and the first ``DIGIT`` bytes, later levels by the next bytes; a group leaves when it is a
    singleton or its texts have ended.  Only undecided rows carry the rest of their text to the next level.  A group is
    counted by partial aggregation and never gathered.  ``row`` numbers the rows of the result uniquely.

    Null texts equal empty ones.  Of equal texts the smallest doc_id stays (null ids come last); if several rows share it,
    exactly one of them stays.  An empty table gives no rows; other columns are ignored.
    """
    c = F.col
    bytes_of = docs.select(docs[id_col].alias("doc_id"), normalised(docs[text_col]).cast("binary").alias("bytes"))
    keyed = bytes_of.select("doc_id", "bytes", F.octet_length("bytes").alias("size"), F.substring("bytes", 1, DIGIT).alias("digit"))
    groups = _refine(keyed.select("doc_id", "size", "digit"), ["size", "digit"])
    level = keyed.join(groups, ["size", "digit"], "left").select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "size", F.sha2("bytes", 256).alias("text_sha256"), "n", "low", "next",
        F.when(c("next").isNotNull() & (c("size") > DIGIT), F.expr(f"substring(bytes, {DIGIT + 1})")).alias("rest"),
    )
    level = stored(level, "radix-level")
    done, seen, step = [], DIGIT, DIGIT
    while True:
        going = c("next").isNotNull() & (c("size") > seen)
        done.append(level.filter(~going).drop("rest"))
        if level.filter(going).isEmpty():
            break
        step *= GROWTH
        active = level.filter(going).select(
            "row", "doc_id", "size", "text_sha256", c("next").alias("group"), F.substring("rest", 1, step).alias("digit"), "rest"
        )
        groups = _refine(active.select("doc_id", "group", "digit"), ["group", "digit"])
        seen += step
        level = active.join(groups, ["group", "digit"], "left").select(
            "row", "doc_id", "size", "text_sha256", "n", "low", "next",
            F.when(c("next").isNotNull() & (c("size") > seen), F.expr(f"substring(rest, {step + 1})")).alias("rest"),
        )
        level = stored(level, "radix-level")
    # numbers of groups are unique within a level only
    ended = reduce(DataFrame.unionByName, [d.withColumn("level", F.lit(i)) for i, d in enumerate(done)])
    first = ended.filter(c("next").isNotNull() & c("doc_id").eqNullSafe(c("low"))).groupBy("level", "next").agg(F.min("row").alias("row"))
    out = ended.join(first.select("row", F.lit(True).alias("first")), "row", "left")
    alone = c("next").isNull()
    return out.select(
        "row", "doc_id", F.when(alone, c("doc_id")).otherwise(c("low")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast(T.LongType())).alias("group_size"), (alone | c("first").isNotNull()).alias("kept"), "text_sha256",
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows that repeat an id and its text stay once.

    Ids that repeat are told apart by digest and reduced by partial aggregation; all others are found by their id alone.
    """
    kept = stored(duplicates(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")), "kept")
    many = docs.groupBy(docs[id_col].alias("_many")).count().filter("count > 1").select("_many")
    many = stored(many, "repeated-ids")
    same = docs[id_col].eqNullSafe(F.col("_many"))
    single = docs.join(many, same, "left_anti")
    single = single.join(kept.select("_id").hint("merge"), single[id_col].eqNullSafe(F.col("_id")), "left_semi")
    several = docs.join(many, same, "left_semi").withColumn("_digest", F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    several = several.join(kept, several[id_col].eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_sha")), "left_semi")
    return single.union(several.dropDuplicates([id_col, "_digest"]).drop("_digest"))
