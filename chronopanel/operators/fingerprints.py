"""Content fingerprints of tables and run signatures."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Kinds of columns in a fingerprint's schema, so that engines that name their types otherwise agree.
KINDS = {
    T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "int", T.FloatType: "real", T.DoubleType: "real", T.StringType: "text",
    T.DateType: "day", T.TimestampType: "time", T.TimestampNTZType: "time", T.BooleanType: "bool", T.BinaryType: "bytes",
}


def kind_of(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return f"list of {kind_of(kind.elementType)}"
    return KINDS.get(type(kind), kind.simpleString())


def _finite(x: Column) -> Column:
    """Neither zero, infinite nor not a number; the last is the largest to Spark."""
    return (F.abs(x) > 0) & (F.abs(x) < float("inf"))


def _exponent(x: Column) -> Column:
    """Exponent of two of a finite number, by the logarithm: it may be off by one next to a power of two."""
    return F.when(_finite(x), F.floor(F.log2(F.abs(x))).cast("int"))


def _scaled(x: Column, exponent: Column) -> Column:
    """The number times a power of two, in two steps that neither overflow nor round: from 2^51 to 2^54."""
    shift = F.lit(52) - exponent
    half = F.shiftright(shift, 1)
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    return F.abs(x) * power(half) * power(shift - half)


def _real(x: Column, exponent: Column, scaled: Column) -> Column:
    """A finite number as whole mantissa and exponent of two: exact, and the same wherever doubles are."""
    low, high = scaled < 2.0**52, scaled >= 2.0**53
    mantissa = F.when(low, scaled * 2).when(high, scaled / 2).otherwise(scaled).cast("long").cast("string")
    power = F.when(low, exponent - 53).when(high, exponent - 51).otherwise(exponent - 52).cast("string")
    text = F.concat(F.when(x < 0, "-").otherwise(""), mantissa, F.lit("p"), power)
    special = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == -float("inf"), "-inf").when(x == 0, "0")
    return special.otherwise(text)


def _reals(values: Column) -> Column:
    """Texts of an array of numbers; what a step computes, the next one refers to, as lambdas compute an expression as often as it is written."""
    steps = F.transform(values, lambda v: F.struct(v.cast("double").alias("x"), _exponent(v.cast("double")).alias("e")))
    steps = F.transform(steps, lambda s: F.struct(s["x"].alias("x"), s["e"].alias("e"), _scaled(s["x"], s["e"]).alias("m")))
    return F.transform(steps, lambda s: F.coalesce(_real(s["x"], s["e"], s["m"]), F.lit("N")))


REAL = (T.FloatType, T.DoubleType)


def canonical(value: Column, kind: T.DataType) -> Column:
    """Text of a value that differs where values differ; a null is N, and texts carry their length."""
    if isinstance(kind, T.ArrayType):
        inner = _reals(value) if isinstance(kind.elementType, REAL) else F.transform(value, lambda v: canonical(v, kind.elementType))
        text = F.concat(F.lit("["), F.array_join(inner, ","), F.lit("]"))
    elif isinstance(kind, REAL):
        text = _reals(F.array(value))[0]
    elif isinstance(kind, T.StringType):
        text = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
    elif isinstance(kind, T.DateType):
        text = F.unix_date(value).cast("string")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.unix_micros(value.cast("timestamp")).cast("string")
    elif isinstance(kind, T.BinaryType):
        text = F.hex(value)
    elif isinstance(kind, (T.StructType, T.MapType)):
        text = F.to_json(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("N"))


def fingerprint(df: DataFrame, name: str = "table") -> DataFrame:
    """Order-independent digest of all rows: one pass, partial aggregates only.

    A row is the canonical text of its columns by name, its digest 128 bits; the four words of all digests are summed exactly,
    so that repeated rows count and their order does not.  Numbers are written in steps, each of which refers to columns of the
    one before, and texts are joined as an array: written out at once, they make methods too large for Java's compiler.
    """
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    c, at = lambda k, i: F.col(f"{k}{i}"), range(len(fields))
    real = [i for i in at if isinstance(fields[i].dataType, REAL)]
    values = df.select(*[F.col(f"`{f.name}`").cast("double").alias(f"x{i}") if i in real else canonical(F.col(f"`{f.name}`"), f.dataType).alias(f"x{i}") for i, f in enumerate(fields)])
    values = values.select("*", *[_exponent(c("x", i)).alias(f"e{i}") for i in real])
    values = values.select("*", *[_scaled(c("x", i), c("e", i)).alias(f"m{i}") for i in real])
    texts = F.array(*[_real(c("x", i), c("e", i), c("m", i)) if i in real else c("x", i) for i in at])
    row = F.array_join(F.transform(texts, lambda t: F.coalesce(t, F.lit("N"))), "|")
    hashed = values.select(F.md5(row).alias("h"))
    longs = hashed.select(*[F.conv(F.substring("h", 1 + 16 * i, 16), 16, -10).cast("long").alias(f"v{i}") for i in range(2)])
    schema = ",".join(f"{f.name}:{kind_of(f.dataType)}" for f in fields)
    # sums of 16 bits: whole numbers that fit for 2^47 rows
    quarter = lambda i: F.shiftrightunsigned(c("v", i // 4), 48 - 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF))
    sums = longs.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(quarter(i)), F.lit(0)).cast("decimal(20,0)").alias(f"q{i}") for i in range(8)])
    words = [c("q", 2 * i) * F.lit(1 << 16) + c("q", 2 * i + 1) for i in range(4)]
    digest = F.sha2(F.concat_ws("|", F.lit(schema), "rows", *words), 256)
    return sums.select(F.lit(name).alias("name"), "rows", digest.alias("digest"))


def manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One fingerprint row per table."""
    parts = [fingerprint(df, name) for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reproducibility_id(rows: DataFrame) -> DataFrame:
    """Digest of the sorted manifest (one row per table)."""
    listed = F.array_sort(F.collect_list(F.concat_ws("=", "name", "digest")))
    return rows.agg(F.count(F.lit(1)).alias("tables"), F.sha2(F.array_join(listed, ";"), 256).alias("run_id"))


def signature(inputs: DataFrame, params: Mapping[str, object], schema: str = "v1") -> DataFrame:
    """Signature of input digests and parameters."""
    fixed = ";".join(f"{k}={params[k]}" for k in sorted(params))
    listed = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "name", "digest"))), ";")
    return inputs.agg(F.sha2(F.concat_ws("|", F.lit(schema), F.lit(fixed), listed), 256).alias("signature"))
