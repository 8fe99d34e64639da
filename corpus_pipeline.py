"""From raw documents to packed training sequences: language, exact and near duplicates, secrets, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.llm import langid, packing, radix, secrets, simhash
from chronopanel.llm.queries import PACKING_MODEL, RADIUS, SHINGLE
from chronopanel.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter.  ``lang`` is filled in where it was null; if no language could be learned it stays as it is."""
    known = langid.learned(docs)
    if not known:
        return docs.filter(langid.lettered("text")).select(*COLUMNS)
    # the prediction travels with its row: rows need no key
    return langid.tagged(docs, known).filter(F.col("lang_pred") != langid.UNKNOWN).withColumn(
        "lang", F.coalesce("lang", "lang_pred")
    ).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    return radix.without_duplicates(docs).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    return simhash.one_of_each(docs, SHINGLE, RADIUS).select(*COLUMNS)


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and ``n_chars`` as it then is."""
    return secrets.redacted(docs, "text", "n_chars").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2,048 tokens, with their token ids."""
    return packing.packed(docs, public_tokenizers.path(PACKING_MODEL), with_ids=True)


STAGES = [("language", language), ("exact_duplicates", exact), ("near_duplicates", near), ("secrets", secret), ("packing", pack)]

#: Fitted profiles, fingerprints and token ids are beyond SQL; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
