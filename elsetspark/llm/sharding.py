"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt to virtual partitions by a hash of the whole row. How many rows of each virtual
partition go to each shard is drawn exactly (multivariate hypergeometric, row by row of the
matrix), so that every assignment of rows to shards with these sizes is equally likely. Rows are
permuted inside their partition, exchanged by the matrix, and permuted again inside their shard.

Only counts reach the driver: one number for each virtual partition, MAX_PARTITIONS at most.

Defined cases: null text counts as empty; null ids, ties and wholly repeated rows are rows like
any other, each with its own slot; an empty table gives an empty result; columns named like the
added ones are replaced in the output.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS, SEED = 40, 20_240_301
ROWS_PER_PARTITION, MAX_PARTITIONS = 2048, 8192


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """One exact draw. numpy's own covers populations under 10**9; beyond, inversion from the mode."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, take)) if take and good + bad else 0
    lo, hi = max(0, take - bad), min(take, good)
    at = min(max((take + 1) * (good + 1) // (good + bad + 2), lo), hi)
    lg = math.lgamma
    p = math.exp(lg(good + 1) - lg(at + 1) - lg(good - at + 1) + lg(bad + 1) - lg(take - at + 1) - lg(bad - take + at + 1) - lg(good + bad + 1) + lg(take + 1) + lg(good + bad - take + 1))
    u, left, right, pl, pr = rng.random() - p, at, at, p, p
    while u > 0 and (left > lo or right < hi):
        if right < hi:
            pr *= (good - right) / (right + 1) * (take - right) / (bad - take + right + 1)
            right += 1
            u -= pr
            if u <= 0:
                return right
        if left > lo:
            pl *= left / (good - left + 1) * (bad - take + left) / (take - left + 1)
            left -= 1
            u -= pl
            if u <= 0:
                return left
    return at


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Matrix of partition-to-shard counts with these row and column sums, drawn exactly."""
    rng, left = np.random.default_rng(seed), np.array(sizes, dtype=np.int64)
    out = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for i, n in enumerate(counts):
        rest, take = int(left.sum()), int(n)
        if rest < 1_000_000_000:
            out[i] = rng.multivariate_hypergeometric(left, take, method="marginals")
        else:
            for j, size in enumerate(left):
                rest -= int(size)
                out[i, j] = got = _hypergeometric(rng, int(size), rest, take) if take else 0
                take -= got
        left -= out[i]
    return out


def shard_rows(df: DataFrame, shards: int = SHARDS, seed: int = SEED, identity: list[Column] | None = None) -> DataFrame:
    """df with shard (int) and slot (long, gapless from 0 inside each shard). Shard sizes differ by one at most."""
    spark = df.sparkSession
    rows = df.drop("shard", "slot")
    keys = identity or [rows[f"`{c}`"] for c in rows.columns]
    rows = rows.withColumn("__h", F.xxhash64(F.lit(seed), *keys))
    n = rows.count()
    parts = max(1, min(MAX_PARTITIONS, -(-n // ROWS_PER_PARTITION)))
    rows = rows.withColumn("__vp", F.pmod(F.col("__h"), F.lit(parts)).cast("int"))
    counted = {r["__vp"]: r["n"] for r in rows.groupBy("__vp").agg(F.count("*").alias("n")).collect()}
    sizes = [n // shards + (j < n % shards) for j in range(shards)]
    ends = np.cumsum(communication_matrix([counted.get(i, 0) for i in range(parts)], sizes, seed), axis=1)
    matrix = spark.createDataFrame([(i, [int(x) for x in e]) for i, e in enumerate(ends)], "__vp int, __ends array<bigint>")  # MAX_PARTITIONS rows at most

    local = Window.partitionBy("__vp").orderBy(F.xxhash64(F.col("__h"), F.lit(seed + 1)), "__h")
    dealt = rows.withColumn("__r", F.row_number().over(local).cast("long")).join(F.broadcast(matrix), "__vp")
    dealt = dealt.withColumn("shard", F.size(F.filter("__ends", lambda e: e < F.col("__r"))).cast("int")).drop("__ends")

    bits = max(0, min(20, math.ceil(math.log2(max(1, n / shards / ROWS_PER_PARTITION)))))
    dealt = dealt.withColumn("__h2", F.xxhash64(F.col("__h"), F.lit(seed + 2)))
    dealt = dealt.withColumn("__sub", F.pmod(F.shiftright("__h2", 40), F.lit(1 << bits)).cast("int"))
    before = Window.partitionBy("shard").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "__sub").agg(F.count("*").alias("__n")).select("shard", "__sub", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    again = Window.partitionBy("shard", "__sub").orderBy("__h2", "__r", "__vp")
    out = dealt.join(offsets, ["shard", "__sub"]).withColumn("slot", (F.col("__before") + F.row_number().over(again) - 1).cast("long"))
    return out.select(*[f"`{c}`" for c in df.columns if c not in ("shard", "slot")], "shard", "slot")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 of documents, with the shard and slot that shard_rows gives."""
    light = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    out = shard_rows(light)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
