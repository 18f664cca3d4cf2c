"""Removal of long repeated byte strings with run-length compressed Burrows-Wheeler indexes.

Every byte covered by a WINDOW-byte string that starts anywhere else (same text included) goes.

1. Anchors. In every window of WINDOW bytes the leftmost smallest hash of ANCHOR bytes is its
   anchor; equal windows have equal anchors. The windows of a text that share an anchor form one
   context (their bytes, contiguous). Texts with equal bytes are one text with a multiplicity.
2. Contexts whose anchor hash occurs once hold no repeated window. The others are cut from the
   texts, equal ones merged with their weight, and brought together by anchor hash.
3. Each task builds an index of its contexts: suffix order, Burrows-Wheeler transform, its runs,
   and the suffixes sampled at both sides of every run boundary with the length they share. A
   match that goes on to the left keeps its neighbour through equal characters, so the samples at
   run boundaries give all matching statistics: streamed along the text, each position's longest
   match elsewhere is the largest of a sample there and its left neighbour's value less one.
   Windows whose match reaches WINDOW bytes, and all windows of contexts that occur twice, repeat.
4. An anchor hash whose contexts pass HOT_BYTES is not indexed in one task: the 128-bit digests of its
   windows are dealt to buckets of about BUCKET_WINDOWS, where equal ones meet. That is exact too.
5. Marks go back to the texts, where covered bytes merge to spans.

Each repeated window meets its equals: they share the anchor hash, and so the task. Contexts are
cut so that no place of a text lies in two of them; hence no window meets itself.

Memory: a task indexes INDEX_BYTES of contexts at a time and HOT_BYTES more at most, or holds a
bucket of windows. What several texts share inside a passage merges to one context; anchor hashes
pass HOT_BYTES only by the edges of a passage that is very common in ever new surroundings.

Defined cases: null text is empty; texts under WINDOW bytes stay; invalid sequences cannot occur in
strings; repeated rows are copies like any other; null ids are kept as rows; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_shuffles, small_batches

WINDOW, ANCHOR, PIECE, INDEX_BYTES = 400, 128, 1 << 22, 3 << 19  # ANCHOR: a power of two
HOT_BYTES, BUCKET_WINDOWS = 4 << 20, 200_000
MARKS = "ch binary, lo array<long>, hi array<long>"
PACKED = "bucket int, digests binary, names binary, offsets binary, weights binary"
BASE = np.uint64(0x9E3779B97F4A7C15)
ANCHORS = "doc_id long, tid binary, x long, n long, sha string, hs array<long>, starts array<long>, ends array<long>"
NAMED = "tid binary, copies long, text string, hs array<long>, starts array<long>, ends array<long>, chs array<binary>"


def anchor_keys(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each ANCHOR bytes: as an ordering key (40 bits), and whole."""
    h, step, by = data.astype(np.uint64) + np.uint64(1), 1, BASE
    while step < ANCHOR:
        h = h[:-step] * by + h[step:]
        step, by = 2 * step, np.uint64(int(by) ** 2 & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h >> np.uint64(24), h


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    n = len(keys)
    rows = -(-n // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[:n] = keys
    grid = full.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def contexts(text: bytes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window start of each context of a text."""
    data = np.frombuffer(text, dtype=np.uint8)
    width = window - ANCHOR + 1
    hs, starts, ends = [], [], []
    for lo in range(0, max(0, len(data) - window + 1), PIECE):
        part = data[lo : lo + PIECE + window - 1]
        key, whole = anchor_keys(part)
        key = key << np.uint64(24) | np.arange(len(key), dtype=np.uint64)
        at = (_sliding_min(key, width) & np.uint64((1 << 24) - 1)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate([[0], cuts])
        hs.append(whole[at[first]].astype(np.int64))
        starts.append(first + lo)
        ends.append(np.concatenate([cuts, [len(at)]]) - 1 + lo)
    if not hs:
        return (np.zeros(0, dtype=np.int64),) * 3
    return np.concatenate(hs), np.concatenate(starts), np.concatenate(ends)


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "replace") if text else b""


def tid(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def _find_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each text; of equal texts in one task only the first has its anchors and digest."""
    seen: set[bytes] = set()
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            data = _bytes(text)
            doc_id, name, x = None if pd.isna(doc_id) else int(doc_id), tid(data), np.int64(np.uint64(xxhash.xxh64_intdigest(data, 42)))
            if name in seen:
                rows.append((doc_id, name, x, len(data), None, None, None, None))
                continue
            if len(seen) < 1_000_000:
                seen.add(name)
            rows.append((doc_id, name, x, len(data), hashlib.sha256(data).hexdigest(), *contexts(data)))
        yield pd.DataFrame(rows, columns=["doc_id", "tid", "x", "n", "sha", "hs", "starts", "ends"]).astype({"doc_id": "Int64"})


def _name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the digest of each wanted context."""
    for batch in batches:
        names = []
        for text, hs, starts, ends in batch[["text", "hs", "starts", "ends"]].itertuples(index=False):
            data = _bytes(text)
            names.append([xxhash.xxh3_128_digest(data[a : b + WINDOW], h & 0xFFFFFFFFFFFFFFFF) for h, a, b in zip(hs.tolist(), starts.tolist(), ends.tolist(), strict=True)])
        yield batch.assign(chs=names)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct contexts (h, ch, weight, ctx) of a task's texts."""
    held: dict[bytes, list] = {}
    size = 0

    def out() -> pd.DataFrame:
        frame = pd.DataFrame([(v[0], k, v[1], v[2]) for k, v in held.items()], columns=["h", "ch", "weight", "ctx"])
        held.clear()
        return frame

    for batch in batches:
        for copies, text, hs, starts, ends, chs in batch[["copies", "text", "hs", "starts", "ends", "chs"]].itertuples(index=False):
            data = _bytes(text)
            for h, a, b, ch in zip(hs.tolist(), starts.tolist(), ends.tolist(), chs, strict=True):
                if (x := held.get(ch)) is not None:
                    x[1] = 2
                else:
                    held[ch] = [h, min(2, copies), data[a : b + WINDOW]]
                    size += b + WINDOW - a
            if size > 8 * INDEX_BYTES:
                yield out()
                size = 0
    yield out()


PACK = 7  # bytes in the first sorting key


class RunIndex:
    """Run-length Burrows-Wheeler index of contexts, with the suffixes at run boundaries sampled."""

    def __init__(self, parts: list[bytes]):
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        self.text = np.frombuffer(b"".join(parts), dtype=np.uint8)
        n = len(self.text)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.rest = (np.repeat(self.ends, lengths) - np.arange(n)).astype(np.int64)  # bytes to the end of the context
        self.ranks: list[tuple[int, np.ndarray]] = []
        order = self._suffix_order(n, int(lengths.max(initial=0)))
        before = np.zeros(n, dtype=np.int16)
        before[1:] = self.text[:-1].astype(np.int16) + 1
        before[self.starts[lengths > 0]] = 0
        bwt = before[order]
        # A run ends where the next character differs; what precedes a context's start differs from anything.
        edge = np.flatnonzero((bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)) if n else np.zeros(0, dtype=np.int64)
        self.runs = len(edge) + 1
        self.run_end, self.run_start = order[edge], order[edge + 1] if n else edge
        self.shared = self._shared(self.run_end, self.run_start)

    def _suffix_order(self, n: int, longest: int) -> np.ndarray:
        """Suffixes in order, each ending with its context; equal ones by position. Ranks are kept for self._shared."""
        key = np.zeros(n, dtype=np.int64)
        for k in range(PACK):
            key = key << 9
            m = max(0, n - k)
            key[:m] |= np.where(self.rest[:m] > k, self.text[n - m :].astype(np.int64) + 1, 0)
        depth, place = PACK, np.arange(n)
        order = np.argsort(key)
        ordered = key[order]
        packed = n < (1 << 21) - 1  # two ranks and a position fit 63 bits: plain sorting gives the order
        while True:
            rank = np.empty(n, dtype=np.int32)
            rank[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]), dtype=np.int32)[:n]
            self.ranks.append((depth, rank))
            if not n or int(rank[order[-1]]) == n:
                return order
            if depth >= longest:
                return np.argsort(rank.astype(np.int64) * n + place)
            key = np.zeros(n, dtype=np.int64)
            m = max(0, n - depth)
            key[:m] = rank[n - m :]
            key[self.rest <= depth] = 0
            if packed:
                key |= rank.astype(np.int64) << 21
                key = key << 21 | place
                key.sort()
                order, ordered = key & ((1 << 21) - 1), key >> 21
            else:
                key += rank.astype(np.int64) << 31
                order = np.argsort(key)
                ordered = key[order]
            depth *= 2

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes a and b, inside their contexts."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        most = np.minimum(self.rest[a], self.rest[b])
        got = np.zeros(len(a), dtype=np.int64)
        for depth, rank in reversed(self.ranks):
            open_ = got < most
            i, j = np.where(open_, a + got, a), np.where(open_, b + got, b)
            same = open_ & (rank[i] == rank[j])
            got = np.minimum(np.where(same, got + depth, got), most)
        for _ in range(PACK):
            open_ = got < most
            i, j = np.where(open_, a + got, a), np.where(open_, b + got, b)
            got += open_ & (self.text[i] == self.text[j])
            most = np.where(open_ & (self.text[i] != self.text[j]), got, most)
        return got

    def matching_statistics(self) -> np.ndarray:
        """For each position, the longest match that starts anywhere else: samples streamed from left to right."""
        reach = np.zeros(len(self.text), dtype=np.int64)
        np.maximum.at(reach, self.run_end, self.run_end + self.shared)
        np.maximum.at(reach, self.run_start, self.run_start + self.shared)
        return np.clip(np.maximum.accumulate(reach) - np.arange(len(reach)), 0, self.rest)


def covered(parts: list[bytes], weights: list[int], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """Covered byte ranges of each context: windows that occur in another place, or context weight over 1."""
    index = RunIndex(parts)
    repeated = index.matching_statistics() >= window
    out = []
    for a, b, w in zip(index.starts.tolist(), index.ends.tolist(), weights, strict=True):
        if w > 1:
            out.append([(0, b - a)])
            continue
        at = np.flatnonzero(repeated[a:b])
        if not len(at):
            out.append([])
            continue
        cuts = np.flatnonzero(np.diff(at) > window) + 1
        firsts, lasts = at[np.concatenate([[0], cuts])], at[np.concatenate([cuts - 1, [len(at) - 1]])]
        out.append([(int(x), int(y) + window) for x, y in zip(firsts, lasts, strict=True)])
    return out


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Marks (ch, lo, hi) of the contexts of each anchor hash; rows sorted by h."""
    held: dict[bytes, list] = {}
    size, last = 0, None

    def out() -> pd.DataFrame:
        names = list(held)
        marks = covered([held[k][1] for k in names], [held[k][0] for k in names])
        held.clear()
        rows = [(k, [r[0] for r in m], [r[1] for r in m]) for k, m in zip(names, marks, strict=True) if m]
        return pd.DataFrame(rows, columns=["ch", "lo", "hi"])

    for batch in batches:
        for h, ch, weight, ctx in batch[["h", "ch", "weight", "ctx"]].itertuples(index=False):
            if size >= INDEX_BYTES and h != last:
                yield out()
                size = 0
            last = h
            if (x := held.get(ch)) is not None:
                x[0] = 2
            else:
                held[ch] = [weight, ctx]
                size += len(ctx)
    if held:
        yield out()


def window_hasher(buckets: int):
    def hash_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """128-bit digests of all windows of hot contexts, packed by bucket: digest, context, offset, weight."""
        names = ["digests", "names", "offsets", "weights"]
        for batch in batches:
            digests, of, offsets, weights = [], [], [], []
            for ch, weight, ctx in batch[["ch", "weight", "ctx"]].itertuples(index=False):
                n = len(ctx) - WINDOW + 1
                digests += [xxhash.xxh3_128_digest(ctx[i : i + WINDOW]) for i in range(n)]
                of += [ch] * n
                offsets.append(np.arange(n, dtype="<u4"))
                weights.append(np.full(n, weight, dtype=np.uint8))
            if not digests:
                continue
            d, o = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2), np.frombuffer(b"".join(of), dtype="<u8").reshape(-1, 2)
            at, w = np.concatenate(offsets), np.concatenate(weights)
            bucket = (d[:, 0] % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            yield pd.DataFrame([(int(bucket[k[0]]), d[k].tobytes(), o[k].tobytes(), at[k].tobytes(), w[k].tobytes()) for k in np.split(order, cuts)], columns=["bucket", *names])

    return hash_windows


def _repeated_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Marks of the windows whose digest weighs over 1 in all; rows sorted by bucket, one bucket in memory."""
    held: list[tuple] = []
    last = None

    def out() -> pd.DataFrame:
        d, o, at, w = (np.concatenate([np.frombuffer(r[k], dtype=t) for r in held]) for k, t in enumerate(("<u8", "<u8", "<u4", np.uint8)))
        held.clear()
        _, same = np.unique(d.reshape(-1, 2), axis=0, return_inverse=True)
        same = same.reshape(-1)
        hit = np.flatnonzero(np.bincount(same, weights=w)[same] > 1)
        marks: dict[bytes, list[int]] = {}
        for name, i in zip(o.reshape(-1, 2)[hit], at[hit].tolist(), strict=True):
            marks.setdefault(name.tobytes(), []).append(i)
        return pd.DataFrame([(k, v, [i + WINDOW for i in v]) for k, v in marks.items()], columns=["ch", "lo", "hi"])

    for batch in batches:
        for bucket, *blobs in batch[["bucket", "digests", "names", "offsets", "weights"]].itertuples(index=False):
            if held and bucket != last:
                yield out()
            last = bucket
            held.append(tuple(blobs))
    if held:
        yield out()


def merge(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    order = np.lexsort((hi, lo))
    out: list[list[int]] = []
    for a, b in zip(lo[order].tolist(), hi[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for name, text, lo, hi in batch[["tid", "text", "lo", "hi"]].itertuples(index=False):
            data = _bytes(text)
            spans = merge(np.asarray(lo), np.asarray(hi))
            rest = kept_bytes(data, spans)
            rows.append((name, [{"lo": a, "hi": b} for a, b in spans], hashlib.sha256(rest).hexdigest(), rest))
        yield pd.DataFrame(rows, columns=["tid", "spans", "kept_sha256", "kept"])


FINISHED = "tid binary, spans array<struct<lo:long,hi:long>>, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, whole_sha256, spans (removed byte ranges, merged), kept_sha256 and kept (the remaining bytes) of each row of docs (doc_id, text).

    Where nothing is removed spans is empty, kept null (the text stays) and kept_sha256 that of the text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    anchored = scratch.write(rows.mapInPandas(_find_anchors, ANCHORS), "zstd")
    one = lambda c: F.first(c, True).alias(c)
    texts = scratch.write(anchored.groupBy("tid").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), *map(one, ("x", "n", "sha", "hs", "starts", "ends"))), "zstd")

    each = texts.select("tid", F.posexplode("hs").alias("i", "h"))
    # A table of its own, so that both sides of the join are exchanged and a hot hash can be split.
    often = scratch.write(each.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h"))
    shared = each.join(often, "h").groupBy("tid").agg(F.sort_array(F.collect_list("i")).alias("at"))
    pick = lambda c: F.transform("at", lambda i: F.get(F.col(c), i)).alias(c)
    wanted = scratch.write(texts.join(shared, "tid").select("copies", "tid", F.col("rep").alias("rep"), F.col("x").alias("wx"), pick("hs"), pick("starts"), pick("ends")), "zstd")
    scratch.drop(often)

    with_text = rows.withColumn("x", F.xxhash64("text")).join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("x") == F.col("wx")))
    with_text = scratch.write(with_text.select("tid", "copies", "text", "hs", "starts", "ends").mapInPandas(_name, NAMED), "zstd")
    scratch.drop(wanted)
    free_shuffles(spark)

    cut = scratch.write(with_text.mapInPandas(_cut, "h long, ch binary, weight int, ctx binary"), "zstd")
    hot = scratch.write(cut.groupBy("h").agg(F.sum(F.octet_length("ctx")).alias("bytes")).where(F.col("bytes") > HOT_BYTES))
    hot_bytes = hot.agg(F.sum("bytes")).first()[0] or 0
    cold = cut.join(hot, "h", "left_anti") if hot_bytes else cut
    marks = cold.repartition("h").sortWithinPartitions("h").mapInPandas(_index, MARKS)
    if hot_bytes:
        packed = cut.join(hot, "h", "left_semi").mapInPandas(window_hasher(1 + hot_bytes // BUCKET_WINDOWS), PACKED)
        marks = marks.unionByName(packed.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_repeated_windows, MARKS))
    marks = scratch.write(marks, "zstd")
    scratch.drop(cut, hot)
    free_shuffles(spark)

    alone = with_text.where("copies = 1")
    places = alone.select("tid", F.inline(F.arrays_zip("chs", "starts"))).toDF("tid", "ch", "at")
    shift = lambda c: F.flatten(F.collect_list(F.transform(c, lambda v: v + F.col("at")))).alias(c)
    spans = places.join(marks, "ch").groupBy("tid").agg(shift("lo"), shift("hi"))
    finished = alone.select("tid", "text").join(spans.hint("shuffle_hash"), "tid").mapInPandas(_finish, FINISHED).dropDuplicates(["tid"])

    whole = (F.col("copies") > 1) & (F.col("n") >= WINDOW)
    span = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi")))
    done = texts.select("tid", "copies", "n", "sha").join(finished, "tid", "left").select(
        "tid",
        F.col("n").alias("n_bytes"),
        F.col("sha").alias("whole_sha256"),
        F.when(whole, span).otherwise(F.coalesce("spans", F.expr("cast(array() as array<struct<lo:bigint,hi:bigint>>)"))).alias("spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(whole, F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept"),
    )
    return anchored.select("doc_id", "tid").join(done, "tid").drop("tid")


def digest(docs: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["hi"] - x["lo"])
    return remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
