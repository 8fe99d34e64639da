"""Registration of queries over the supplied tables, and SQL text helpers for their checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.panel import bars

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    build: Builder
    sql: str | None


REGISTRY: dict[str, Query] = {}
#: The supplied tables.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
    "labels", "conversations",
)


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, dates as text, so that two engines print the same values."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, ids: str, sql: str | None = None, digits: int = 6):
    def register(fn: Builder) -> Builder:
        build = lambda spark, sf_dir: tidy(fn(spark, sf_dir), digits)
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, ids, build, sql)
        return fn

    return register


def out(body: str, keys: str = "", dates: str = "", doubles: Sequence[str] | str = (), longs: str = "", ctes: str = "", digits: int = 6) -> str:
    """Outer SELECT that prints values the way ``tidy`` does."""
    split = lambda names: names.split() if isinstance(names, str) else list(names)
    cols = [f'"{k}"' for k in split(keys)]
    cols += [f'CAST("{d}" AS VARCHAR) AS "{d}"' for d in split(dates)]
    cols += [f'round(CAST("{d}" AS DOUBLE), {digits}) + 0.0 AS "{d}"' for d in split(doubles)]
    cols += [f'CAST("{n}" AS BIGINT) AS "{n}"' for n in split(longs)]
    head = f"WITH RECURSIVE {ctes}\n" if ctes else ""
    return f"{head}SELECT {', '.join(cols)} FROM ({body}) AS result"


def frame(n: int, key: str = "series_id", order: str = "date") -> str:
    return f"(PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def enough(c: str, n: int, least: int, expr: str, key: str = "series_id", order: str = "date") -> str:
    """``expr`` contains ``{w}`` for the frame."""
    w = frame(n, key, order)
    return f"CASE WHEN count({c}) OVER {w} >= {least} THEN {expr.format(w=w)} END"


def corr_sql(x: str, y: str, n: int, least: int, key: str = "series_id", order: str = "date") -> str:
    px = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)"
    py = f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    w = frame(n, key, order)
    return (
        f"CASE WHEN count({px}) OVER {w} >= {least} AND max({px}) OVER {w} > min({px}) OVER {w} "
        f"AND max({py}) OVER {w} > min({py}) OVER {w} "
        f"THEN covar_samp({px}, {py}) OVER {w} / nullif(stddev_samp({px}) OVER {w} * stddev_samp({py}) OVER {w}, 0) END"
    )


# --- bindings of roles to the supplied tables -------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def line_order(key: str = "l_orderkey", line: str = "l_linenumber", price: str = "l_extendedprice"):
    """Trade order as one fixed-width number: order key, line, then price in cents to break ties."""
    dec = lambda c: F.col(c).cast("decimal(18,0)")
    cents = F.round(F.col(price) * 100).cast("decimal(12,0)")
    return (
        (dec(key) * F.lit(10**14).cast("decimal(15,0)")).cast("decimal(38,0)")
        + (dec(line) * F.lit(10**12).cast("decimal(13,0)")).cast("decimal(38,0)")
        + cents
    ).cast("decimal(38,0)")


def line_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the six flag/status series."""
    raw = table(
        spark, sf_dir, "lineitem",
        "l_returnflag", "l_linestatus", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity",
    )
    return bars(
        raw,
        F.concat("l_returnflag", "l_linestatus"),
        F.to_date("l_shipdate"),
        line_order(),
        F.col("l_extendedprice"),
        F.col("l_quantity"),
    )


BARS = """raw AS (
  SELECT l_returnflag || l_linestatus AS series_id, CAST(l_shipdate AS DATE) AS date,
         l_extendedprice AS p, l_quantity AS q, row(l_orderkey, l_linenumber, l_extendedprice) AS o
  FROM lineitem),
bars AS (
  SELECT series_id, date, arg_min(p, o) AS open, max(p) AS high, min(p) AS low, arg_max(p, o) AS close,
         arg_max(p, o) AS adj_close, sum(q) AS volume
  FROM raw GROUP BY series_id, date)"""

S = "(PARTITION BY series_id ORDER BY date)"

BASE = (
    BARS
    + f""",
base0 AS (
  SELECT *, ln(close) AS log_price, ln(1 + volume) AS log_volume, ln(high / low) AS range_log FROM bars),
base AS (
  SELECT *, close / lag(close) OVER {S} - 1 AS r1, log_price - lag(log_price) OVER {S} AS log_r1,
         log_volume - lag(log_volume) OVER {S} AS volume_log_change,
         lead(date) OVER {S} AS target_end_date, lead(close) OVER {S} / close - 1 AS target_return_1d
  FROM base0)"""
)

ANCHOR = "AF"
PEERS = ("AO", "NF", "NO", "RF", "RO")


def sparse_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as sparsely observed series: last order value of the day."""
    orders = table(spark, sf_dir, "orders", "o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice")
    return (
        orders.groupBy(F.col("o_orderpriority").alias("macro_id"), F.to_date("o_orderdate").alias("date"))
        .agg(F.max_by("o_totalprice", "o_orderkey").alias("close"))
    )


SPARSE = """sparse AS (
  SELECT o_orderpriority AS macro_id, CAST(o_orderdate AS DATE) AS date, arg_max(o_totalprice, o_orderkey) AS close
  FROM orders GROUP BY 1, 2),
span AS (SELECT min(date) AS lo, max(date) AS hi FROM sparse),
days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM span),
grid AS (SELECT macro_id, date FROM (SELECT DISTINCT macro_id FROM sparse), days),
sp AS (SELECT g.macro_id, g.date, s.close FROM grid g LEFT JOIN sparse s USING (macro_id, date))"""


def status_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statuses as exogenous metrics: value of the day's orders."""
    orders = table(spark, sf_dir, "orders", "o_orderstatus", "o_orderdate", "o_totalprice")
    return orders.groupBy(F.col("o_orderstatus").alias("metric"), F.to_date("o_orderdate").alias("date")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value")
    )


METRICS = """metrics AS (
  SELECT o_orderstatus AS metric, CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM orders GROUP BY 1, 2),
span AS (SELECT min(date) AS lo, max(date) AS hi FROM metrics),
days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM span),
grid AS (SELECT metric, date FROM (SELECT DISTINCT metric FROM metrics), days),
mx AS (SELECT g.metric, g.date, m.value FROM grid g LEFT JOIN metrics m USING (metric, date))"""
