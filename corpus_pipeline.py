"""Training-corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

STAGES lists (name, function); a function takes (spark, docs, sf_dir), works on all rows of docs,
and returns a DataFrame that is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents; the last adds shard and slot.

Defined cases are those of the operators. Language ID rejects texts without a letter and those
whose best language has less than LEAST_SCORE; mixing drops documents that the mix does not take
and repeats those that it takes twice, so that an id may come twice from there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from elsetspark.llm import decontaminate, language_id, mixing, near_copies, sharding
from elsetspark.llm.common import Scratch, table

LEAST_SCORE = 0.35


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the byte network gives a language. It learns from the labelled rows that are not held out."""
    net = language_id.fit(docs.where(~F.coalesce(language_id.held_out(), F.lit(False))))
    named = language_id.identify(docs, net)
    return named.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*[f"`{c}`" for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that of the smallest id."""
    return near_copies.one_per_group(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that matches a benchmark item."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*[f"`{c}`" for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as fair queueing takes them."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their slot in it."""
    return sharding.shard_rows(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: A trained network and SimHash components cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs, last = Scratch(spark), table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
        if last is not None:
            scratch.drop(last)
        last = docs
    return docs
