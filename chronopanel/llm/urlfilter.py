"""URL filters by dated lists: validity intervals of the entries, and an as-of join at the time of the fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import stored


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; null where the url has none."""
    place = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(place, "^.*@", ""), ":[0-9]*$", ""))
    return F.when(host != "", host)


def first_folder(url: Column) -> Column:
    """The path's first folder with its slash; null without one."""
    folder = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)/", 1)
    return F.when(folder != "", F.concat(folder, F.lit("/")))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, spans): when each pattern is on any list, from entries (list, pattern, day, added, seq).

    ``added`` is false for a removal.  Of several entries for a pattern on one list and day the one with the largest ``seq``
    counts, an addition at equal numbers.  An entry holds from its day until the day of the pattern's next entry on that list.
    Lists have dates, so a pattern has at most one interval per list and day, which bounds ``spans``.  Entries without
    pattern or day are ignored.
    """
    c = F.col
    order = F.coalesce(c("seq"), F.lit(-1)) * 2 + F.coalesce(c("added"), F.lit(False)).cast("long")
    last = entries.filter(c("pattern").isNotNull() & c("day").isNotNull()).groupBy("list", "pattern", "day").agg(F.max(order).alias("o"))
    turn = Window.partitionBy("list", "pattern").orderBy("day")
    held = last.withColumn("until", F.lead("day").over(turn)).filter(c("o") % 2 == 1)
    return held.groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct(c("day").alias("since"), "until", "list"))).alias("spans"))


def evaluated(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day") -> DataFrame:
    """(id, host, day, n_active, blocked, first_pattern) per capture.

    A capture meets the entries for its host, for every parent domain of it and for the host with the first folder, as they
    stood on the day of the fetch.  The list side has one row per pattern, so the join adds no rows, and being a written
    table it lets a hot host be split.  A capture without host or day is met by none; repeated rows count each; an empty
    table gives no rows, an empty list blocks nothing; other columns are ignored.
    """
    c = F.col
    known = stored(intervals(entries), "intervals")
    row = captures.select(
        F.monotonically_increasing_id().alias("row"), captures[id_col].alias("id"), host_of(captures[url_col]).alias("host"),
        first_folder(captures[url_col]).alias("folder"), captures[day_col].alias("day"),
    )
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = F.when(c("host").isNull(), F.array()).otherwise(
        F.array_compact(F.concat(parents, F.array(F.concat("host", F.lit("/"), "folder"))))
    )
    asked = row.withColumn("key", F.explode_outer(keys))
    active = F.filter(c("spans"), lambda s: (s["since"] <= c("day")) & (s["until"].isNull() | (c("day") < s["until"])))
    met = asked.join(known, c("key") == c("pattern"), "left").select(
        "row", "id", "host", "day", F.coalesce(F.size(active), F.lit(0)).alias("n"), "pattern"
    )
    return met.groupBy("row", "id", "host", "day").agg(
        F.sum(F.greatest("n", F.lit(0))).alias("n_active"), F.min(F.when(c("n") > 0, c("pattern"))).alias("first_pattern")
    ).select("id", "host", "day", "n_active", (c("n_active") > 0).alias("blocked"), "first_pattern")
