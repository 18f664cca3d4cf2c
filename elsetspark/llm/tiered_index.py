"""Ranked lexical search with an impact-tiered index: each item's k best documents, exactly.

Terms are runs of ASCII letters and digits and of characters above ASCII, A-Z lower-cased. A term's
weight is w = floor(1000 ln((2N + 2) / (2 df + 1))); a posting's impact is
w * (10^9 tf div (1000 tf + 20 m)), m = 50 + 50 n N div L; a score sums an item's impacts.

Index. One pass writes a forward row a document (its length, and its terms among those that are
asked for). Documents are dealt to segments of bounded size by a hash of their row. A segment's
postings are cut into tiers by impact: at least 1/16 of the largest possible impact, 1/32, and the
rest. Each tier also holds, for every term with postings below it, the largest impact left there:
the residual bound.

Search. The first tier alone gives each item a set of good documents, whose exact scores (from
forward rows) set a threshold: the k-th of them. Then, tier by tier, a segment adds up an item's
postings so far, every missing term at its residual bound. If the bounds of a document that no tier
has shown stay below the threshold, and few others (CANDIDATES) reach it, the segment is proved exact
for the item: those few are scored by their forward rows. Items without the proof fall through to
the next tier, which reads only the segments that still have some; the last tier's sums are scores.
One window ranks what reaches the threshold.

Items are taken in blocks of BLOCK_BYTES of text: the terms of one block are what tasks and driver hold,
and documents are read once a block. Memory of a task: a segment (SEGMENT_DOCS documents or
SEGMENT_POSTINGS postings on average), one dense array of sums. Every table survives lost executors.

Defined cases: a null text has no term, nor has one without letters and digits; such documents count
nowhere, such items have no rows. Null doc_ids rank last among equal scores; rows of equal doc_id are
documents each by itself, rows of equal item_id items each by itself. Fewer than k documents
with a score give fewer ranks; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches

K, SHARES, CANDIDATES = 50, (16, 32), 1024
BLOCK_BYTES, SEGMENT_DOCS, SEGMENT_POSTINGS = 16 << 20, 16384, 2_000_000
#: Bytes of terms stay, A-Z in lower case; all others become spaces.
TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
FORWARD = "doc_id long, n long, terms binary, counts binary"
TIER = "segment int, tier int, uids binary, ids binary, no_ids binary, terms binary, ends binary, docs binary, impacts binary, below binary, bounds binary"
FOUND = "segment int, item int, uid long, doc_id long, score long, state string"
OPEN, CANDIDATE, EXACT = "open", "candidate", "exact"


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(TERM).split() if text else []


class Corpus:
    """What tasks know of a block of items: its terms, and after the first pass weights and totals."""

    def __init__(self, items: list[set[bytes]]):
        self.places = {t: i for i, t in enumerate(sorted(set().union(*items)))}
        self.candidates = CANDIDATES
        self.items = [np.array(sorted(self.places[t] for t in x), dtype=np.int64) for x in items]

    def weigh(self, n: int, length: int, df: np.ndarray) -> None:
        self.n, self.length = n, length
        self.weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
        most = int(self.weights[df > 0].max(initial=0)) * 10**6
        self.cuts = [most // s for s in SHARES]

    def impacts(self, terms: np.ndarray, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Impacts of postings in documents of n terms; n is exact in Python's integers, whatever the totals."""
        lengths, which = np.unique(n, return_inverse=True)
        m = np.array([50 + 50 * x * self.n // self.length for x in lengths.tolist()], dtype=np.int64)[which]
        return self.weights[terms] * ((10**9 * counts) // (1000 * counts + 20 * m))


def ints(data: bytes, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(data, dtype=kind)


def _forward(places: dict[bytes, int]):
    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = places.keys()
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = terms_of(text)
                if words:
                    counts = Counter(words)
                    hit = sorted((places[t], counts[t]) for t in counts.keys() & asked)
                    table = np.array(hit, dtype=np.int64).reshape(-1, 2)
                    rows.append((key, len(words), table[:, 0].astype("<i4").tobytes(), table[:, 1].astype("<i8").tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "terms", "counts"]).astype({"doc_id": "Int64", "n": "int64"})

    return forward


def _frequencies(size: int):
    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(size, dtype=np.int64)
        for batch in batches:
            if len(batch):
                df += np.bincount(ints(b"".join(batch["terms"]), "<i4"), minlength=size)
        hit = np.flatnonzero(df)
        yield pd.DataFrame({"term": hit, "df": df[hit]})

    return frequencies


def _build(corpus: Corpus):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        """The tiers of one segment."""
        rows = rows.assign(no=rows["doc_id"].isna()).sort_values(["no", "doc_id", "uid"])
        held = np.array([len(x) // 4 for x in rows["terms"]])
        docs = np.repeat(np.arange(len(rows)), held)
        terms, counts = ints(b"".join(rows["terms"]), "<i4").astype(np.int64), ints(b"".join(rows["counts"]))
        impacts = corpus.impacts(terms, counts, np.repeat(rows["n"].to_numpy(), held))
        tier = sum((impacts < cut).astype(np.int64) for cut in corpus.cuts) if len(impacts) else impacts
        who = [rows["uid"].to_numpy("<i8").tobytes(), rows["doc_id"].fillna(0).to_numpy("<i8").tobytes(), rows["no"].to_numpy("u1").tobytes()]
        out = []
        for t in range(len(corpus.cuts) + 1):
            mine, lower = np.flatnonzero(tier == t), np.flatnonzero(tier > t)
            mine = mine[np.lexsort((-impacts[mine], terms[mine]))]
            names, starts = np.unique(terms[mine], return_index=True)
            ends = np.append(starts[1:], len(mine)) if len(mine) else starts
            below = np.unique(terms[lower])
            bounds = np.zeros(len(corpus.weights), dtype=np.int64)
            np.maximum.at(bounds, terms[lower], impacts[lower])
            arrays = (names.astype("<i4"), ends.astype("<i8"), docs[mine].astype("<i4"), impacts[mine].astype("<i8"), below.astype("<i4"), bounds[below].astype("<i8"))
            out.append((int(rows["segment"].iloc[0]), t, *who, *[a.tobytes() for a in arrays]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in TIER.split(", ")])

    return build


class Segment:
    """Tiers of a segment up to one of them."""

    def __init__(self, tiers: list):
        self.lists: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for x in tiers:
            docs, impacts, at = ints(x.docs, "<i4"), ints(x.impacts), 0
            for t, end in zip(ints(x.terms, "<i4").tolist(), ints(x.ends).tolist(), strict=True):
                self.lists.setdefault(t, []).append((docs[at:end], impacts[at:end]))
                at = end
        deepest = max(tiers, key=lambda x: x.tier)
        self.bounds = dict(zip(ints(deepest.below, "<i4").tolist(), ints(deepest.bounds).tolist(), strict=True))
        self.uids, self.ids, self.no_ids = ints(tiers[0].uids), ints(tiers[0].ids), ints(tiers[0].no_ids, "u1")

    def sums(self, item: np.ndarray, bounded: bool) -> tuple[int, np.ndarray]:
        """Score of each document from the postings here; if bounded, with what may be missing, which alone is the first number."""
        rest = sum(self.bounds.get(t, 0) for t in item.tolist()) if bounded else 0
        out = np.full(len(self.uids), rest, dtype=np.int64)
        for t in item.tolist():
            less = self.bounds.get(t, 0) if bounded else 0
            for docs, impacts in self.lists.get(t, ()):
                out[docs] += impacts - less
        return rest, out

    def best(self, scores: np.ndarray, least: int, k: int) -> np.ndarray:
        """Places of the k best scores of at least `least`, ties to the smaller id (documents stand in that order)."""
        hit = np.flatnonzero(scores >= max(1, least))
        if len(hit) > k:
            edge = np.partition(scores[hit], len(hit) - k)[len(hit) - k]
            hit = hit[scores[hit] >= edge]
        return hit[np.lexsort((hit, -scores[hit]))][:k]

    def rows(self, segment: int, item: int, hit: np.ndarray, scores: np.ndarray, state: str) -> pd.DataFrame:
        ids = pd.array(self.ids[hit], dtype="Int64")
        ids[self.no_ids[hit].astype(bool)] = pd.NA
        return pd.DataFrame({"segment": segment, "item": item, "uid": self.uids[hit], "doc_id": ids, "score": scores[hit], "state": state})


def frames(rows: list[pd.DataFrame]) -> pd.DataFrame:
    columns = [c.split()[0] for c in FOUND.split(", ")]
    return pd.concat(rows, ignore_index=True)[columns] if rows else pd.DataFrame(columns=columns).astype({"segment": "int32", "item": "int32", "uid": "Int64", "doc_id": "Int64", "score": "int64", "state": "object"})


def _leaders(corpus: Corpus, k: int):
    """The k best of each item by the first tier alone."""

    def leaders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in batch.itertuples(index=False):
                segment, rows = Segment([x]), []
                for i, item in enumerate(corpus.items):
                    scores = segment.sums(item, False)[1]
                    rows.append(segment.rows(x.segment, i, segment.best(scores, 1, k), scores, CANDIDATE))
                yield frames(rows)

    return leaders


def decided(corpus: Corpus, segment: Segment, number: int, items: list[int], least: list[int], last: bool, k: int) -> pd.DataFrame:
    """For each item: exact rows (last tier), or candidates that make the segment exact, or one open row."""
    rows = []
    for i in items:
        unseen, upper = segment.sums(corpus.items[i], not last)
        if last:
            rows.append(segment.rows(number, i, segment.best(upper, least[i], k), upper, EXACT))
            continue
        hit = np.flatnonzero(upper >= least[i])
        if unseen < least[i] and len(hit) <= corpus.candidates:
            rows.append(segment.rows(number, i, hit, upper, CANDIDATE))
        else:
            rows.append(pd.DataFrame({"segment": [number], "item": [i], "uid": pd.array([None], "Int64"), "doc_id": pd.array([None], "Int64"), "score": [0], "state": [OPEN]}))
    return frames(rows)


def _first(corpus: Corpus, least: list[int], last: bool, k: int):
    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in batch.itertuples(index=False):
                yield decided(corpus, Segment([x]), x.segment, range(len(corpus.items)), least, last, k)

    return first


def _next(corpus: Corpus, least: list[int], last: bool, k: int):
    def next_tier(rows: pd.DataFrame) -> pd.DataFrame:
        tiers = list(rows.itertuples(index=False))
        return decided(corpus, Segment(tiers), tiers[0].segment, sorted(tiers[0].open), least, last, k)

    return next_tier


def _score(corpus: Corpus):
    """Exact scores of candidates (uid, items) from their forward rows."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        value = np.zeros(len(corpus.weights), dtype=np.int64)
        for batch in batches:
            rows = []
            for x in batch.itertuples(index=False):
                terms, counts = ints(x.terms, "<i4"), ints(x.counts)
                value[terms] = corpus.impacts(terms, counts, np.full(len(terms), x.n))
                rows += [(i, x.uid, x.doc_id, int(value[corpus.items[i]].sum())) for i in x.items]
                value[terms] = 0
            yield pd.DataFrame(rows, columns=["item", "uid", "doc_id", "score"]).astype({"doc_id": "Int64", "item": "int64", "uid": "int64", "score": "int64"})

    return score


def scored(corpus: Corpus, forward: DataFrame, candidates: DataFrame) -> DataFrame:
    asked = candidates.groupBy("uid").agg(F.collect_list("item").alias("items"))
    return forward.join(asked, "uid").mapInPandas(_score(corpus), "item int, uid long, doc_id long, score long")


def top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "uid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_block(scratch: Scratch, docs: DataFrame, items: list[tuple[int | None, set[bytes]]], k: int, progress: list | None) -> DataFrame | None:
    """item_id, rank, doc_id, score for the items of one block."""
    spark = docs.sparkSession
    corpus = Corpus([x for _, x in items])
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    forward = scratch.write(plain.mapInPandas(_forward(corpus.places), FORWARD).withColumn("uid", F.monotonically_increasing_id()))
    total = forward.agg(F.count("*").alias("docs"), F.sum("n").alias("length"), F.sum(F.octet_length("terms") / 4).cast("long").alias("postings")).first()
    if not total["docs"]:
        return None
    df = np.zeros(len(corpus.places), dtype=np.int64)
    for r in forward.select("terms").mapInPandas(_frequencies(len(df)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    corpus.weigh(total["docs"], total["length"], df)

    segments = max(-(-total["docs"] // SEGMENT_DOCS), -(-total["postings"] // SEGMENT_POSTINGS), 1)
    dealt = forward.withColumn("segment", F.pmod(F.xxhash64("uid"), F.lit(segments)).cast("int"))
    path, last = f"{scratch.root}/index-{scratch.n}", len(corpus.cuts)
    dealt.groupBy("segment").applyInPandas(_build(corpus), TIER).write.partitionBy("tier").option("compression", "none").parquet(path)
    index = spark.read.schema(TIER).parquet(path)

    leaders = scratch.write(scored(corpus, forward, top(index.where("tier = 0").mapInPandas(_leaders(corpus, k), FOUND), k)))
    least = [0] * len(items)
    for r in leaders.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).collect():
        if r["n"] >= k:
            least[r["item"]] = r["least"]

    parts = []
    for tier in range(last + 1):
        if tier == 0:
            found = index.where("tier = 0").mapInPandas(_first(corpus, least, tier == last, k), FOUND)
        else:
            open_ = parts[-1].where(F.col("state") == OPEN).groupBy("segment").agg(F.collect_list("item").alias("open"))
            found = index.where(F.col("tier") <= tier).join(open_, "segment").groupBy("segment").applyInPandas(_next(corpus, least, tier == last, k), FOUND)
        parts.append(scratch.write(found))
        if progress is not None:
            progress.append({r["state"]: r["n"] for r in parts[-1].groupBy("state").agg(F.countDistinct("segment", "item").alias("n")).collect()})
    candidates = parts[0].where(F.col("state") == CANDIDATE)
    for p in parts[1:last]:
        candidates = candidates.unionByName(p.where(F.col("state") == CANDIDATE))
    exact = parts[last].where(F.col("state") == EXACT).select("item", "uid", "doc_id", "score")
    ranked = top(exact.unionByName(scored(corpus, forward, candidates).where("score > 0")), k)
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(items)], "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, progress: list | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) for each item (item_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    blocks, out = max(1, -(-size // BLOCK_BYTES)), spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        named = [(r["item_id"], set(terms_of(r["text"]))) for r in rows]
        found = search_block(scratch, docs, [x for x in named if x[1]], k, progress) if any(x[1] for x in named) else None
        out = out if found is None else found if blocks == 1 else out.unionByName(found)
    return out


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


ORACLE = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM d),
m AS (SELECT doc_id, 50 + (50 * n * big_n) // big_l AS m FROM d, c),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, big_n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
"""
