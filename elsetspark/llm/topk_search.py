"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights. Candidates and queries are dealt to blocks of bounded
size by a hash of their id; every pair of a query block and a candidate block is a cell. A cell
inverts its candidates to postings (for each dimension: candidates with a weight there, and the
weights), and for each term of a tile of queries scatters the weighted postings into dense score
arrays. Partition selection keeps each query's k best of the cell, ties to the smaller id; one
window merges the cells.

Memory: a cell holds BLOCK_MOST candidates and twice as many queries at most (about; ids are
hashed), fewer of long vectors so that CELL_NUMBERS weights are not passed, and the dense scores of
one tile of TILE queries, whose k best are selected before the next tile. All that whatever the size
of the tables; the work is the product of the two sides, by definition.

Defined cases: vectors that are null or hold null or non-finite components, and null ids, take no
part; vectors of different lengths meet in the dimensions they share; rows that repeat an id are
candidates each by itself, except for queries of that id, and queries of one id share one ranking;
fewer than k candidates give fewer ranks; empty tables give an empty result; extra columns are
ignored. Scores outside 64 bits raise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE, K, EVERY = 256, 5, 50
BLOCK_LEAST, BLOCK_MOST, CELL_NUMBERS, TILE = 512, 16384, 1 << 22, 64


def quantised(vector: Column) -> Column:
    """floor(SCALE * x) of each component, null if the vector cannot take part."""
    usable = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)))


def matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def postings(candidates: np.ndarray, kind: type) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """For each dimension the candidates with a weight there (None: all) and the weights."""
    out = []
    for t in range(candidates.shape[1]):
        hit = np.flatnonzero(candidates[:, t])
        out.append((hit if len(hit) < len(candidates) else None, candidates[hit, t].astype(kind)))
    return out


def number_type(queries: int, candidates: int, width: int) -> type:
    """The type that holds every partial sum exactly, of the largest weights of either side."""
    most = float(queries) * float(candidates) * max(1, width)
    if most >= 2**63:
        raise OverflowError("an inner product may not fit 64 bits")
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def accumulate(queries: np.ndarray, lists: list[tuple[np.ndarray | None, np.ndarray]], n: int, kind: type) -> np.ndarray:
    """Scores of a tile of queries with n candidates, term by term."""
    q, scores = queries.astype(kind), np.zeros((len(queries), n), dtype=kind)
    spare = np.empty_like(scores)
    for t, (hit, weights) in enumerate(lists):
        asks = q[:, t]
        if not len(weights) or not asks.any():
            continue
        if hit is None:
            scores += np.multiply(asks[:, None], weights[None, :], out=spare)
        else:
            scores[:, hit] += asks[:, None] * weights[None, :]
    return scores


def cell(k: int):
    def best(key, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(candidates):
            candidates = candidates.sort_values("vec_id")
            ids, asked = candidates["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
            width = max(max(map(len, queries["w"])), max(map(len, candidates["w"])))
            largest = lambda rows: max((int(np.abs(r).max(initial=0)) for r in rows), default=0)
            kind = number_type(largest(queries["w"]), largest(candidates["w"]), width)
            lists = postings(matrix(candidates["w"], width), kind)
            firsts, ends = np.searchsorted(ids, asked), np.searchsorted(ids, asked, side="right")
            for lo in range(0, len(asked), TILE):
                scores = accumulate(matrix(queries["w"].iloc[lo : lo + TILE], width), lists, len(ids), kind)
                for q, a, b, row in zip(asked[lo : lo + TILE], firsts[lo : lo + TILE], ends[lo : lo + TILE], scores, strict=True):
                    if b > a:  # rows of the query's own id
                        row = np.delete(row, np.s_[a:b])
                    if not len(row):
                        continue
                    hit = np.arange(len(row))
                    if len(row) > k:
                        hit = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
                    where = ids[np.where(hit < a, hit, hit + (b - a))]
                    chosen = np.lexsort((where, -row[hit]))[:k]
                    out["query_id"] += [q] * len(chosen)
                    out["vec_id"] += where[chosen].tolist()
                    out["score"] += row[hit[chosen]].astype(np.int64).tolist()
        return pd.DataFrame(out).astype("int64")

    return best


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows of vectors. Both sides: vec_id long, w array<bigint>."""
    left, right = (df.where("vec_id is not null and w is not null").select("vec_id", "w") for df in (queries, vectors))
    size = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("w")), F.lit(1)).alias("width")).first()
    n, m = size(right), size(left)
    rows = lambda x, w: min(BLOCK_MOST, CELL_NUMBERS // max(1, w), max(BLOCK_LEAST, x // 128)) or 1
    across, down = max(1, -(-n["n"] // rows(n["n"], n["width"]))), max(1, -(-m["n"] // (2 * rows(m["n"], m["width"]))))
    # Rows of one id go to different blocks, so that an id with many rows is no block of its own.
    block = lambda parts: F.pmod(F.xxhash64("vec_id", "w"), F.lit(parts)).cast("int")
    left = left.withColumns({"down": block(down), "across": F.explode(F.sequence(F.lit(0), F.lit(across - 1)))})
    right = right.withColumns({"across": block(across), "down": F.explode(F.sequence(F.lit(0), F.lit(down - 1)))})
    found = left.groupBy("across", "down").cogroup(right.groupBy("across", "down")).applyInPandas(cell(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("w"))
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
