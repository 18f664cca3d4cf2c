"""SimHash fingerprints of texts and near-duplicate groups by Golay-code fuzzy hashing.

Fingerprint: A-Z lower-cased, words are runs of anything but ASCII white space, shingles of
SHINGLE words joined by a space (fewer words: the whole sequence; none: fingerprint 0); a bit is 1
if set in over half of the shingles' XXH64 (seed 42).

Search: a fingerprint is two segments of 23 bits, A and B, and one of 18, C. The perfect binary
Golay code maps each 23-bit word to the one codeword within 3 bits; the codewords of a word and of
its 23 neighbours at one bit (5.3 on average) are its keys, and two words at most 2 bits apart
share a key, that of a word between them. Of at most RADIUS = 4 errors, one of these holds:
  C has none, and A or B has at most 2:  keys (C, codeword of A), (C, codeword of B)
  A and B have at most 2 each:           keys (codeword of A, codeword of B)
  A has none or B has none (3 in the other): keys (A), (B)
so that linked fingerprints always meet under a key. Only distinct fingerprints are keyed, so
exact copies cost one. Under a key every pair is verified by its differing bits, but only a
spanning forest of the links is kept, and each task joins its links into one forest: what is
written grows with the fingerprints, not with their pairs.

Memory: a task holds the distinct fingerprints of one key (8 bytes each); keys with over WIDE of
them are split again by the exact 13-bit blocks of which one must agree.

Defined cases: null and empty texts have fingerprint 0 and link like any other; repeated rows
share a component; a component without any id has a null component_id; an empty table gives an
empty result; extra columns are ignored by group(), kept by one_per_group().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import Scratch, small_batches
from .components import components

SHINGLE, RADIUS, SEED, WIDE, FEW = 4, 4, 42, 8192, 8
GENERATOR = 0xC75  # generator polynomial of the (23, 12) Golay code
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SLICE = 1 << 15  # shingles counted at a time


def majority(hashes: np.ndarray) -> int:
    """The 64-bit word of the bits set in over half of hashes (uint64)."""
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), SLICE):
        part = hashes[lo : lo + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 (uint64) of each shingle of a text, in order."""
    words = text.encode("utf-8", "replace").translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, stops, strict=True)), dtype=np.uint64, count=n)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text."""
    got = hashes(text, shingle)
    return majority(got) if len(got) else 0


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).astype(np.int64))


def fingerprints(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with fp, the fingerprint as a signed 64-bit integer."""
    small_batches(docs.sparkSession)
    return docs.withColumn("fp", _fingerprints(F.coalesce(F.col(column), F.lit(""))))


@cache
def codewords() -> np.ndarray:
    """Index (0 to 4095) of the codeword within 3 bits, of every 23-bit word."""
    message = np.arange(4096, dtype=np.uint32) << 11
    rest = message.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ np.uint32(GENERATOR << (bit - 11)), rest)
    words = message | rest
    one = [1 << i for i in range(23)]
    errors = [0, *one, *(a | b for i, a in enumerate(one) for b in one[:i]), *(a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j])]
    out = np.empty(1 << 23, dtype=np.uint16)
    for e in errors:
        out[words ^ np.uint32(e)] = np.arange(4096, dtype=np.uint16)
    return out


FLIPS = np.array([0, *(1 << i for i in range(23))], dtype=np.int64)


def nearby(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of 23-bit words and their neighbours: n x 24 sorted, and where an entry is new in its row."""
    got = np.sort(codewords()[words[:, None] ^ FLIPS[None, :]], axis=1)
    new = np.ones(got.shape, dtype=bool)
    new[:, 1:] = got[:, 1:] != got[:, :-1]
    return got.astype(np.int64), new


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) rows of distinct fingerprints (int64)."""
    u = fps.astype(np.uint64)
    a, b, c = ((u >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in ((0, 23), (23, 23), (46, 18)))
    (ka, na), (kb, nb) = nearby(a), nearby(b)
    out, of = [], []

    def add(tag: int, key: np.ndarray, row: np.ndarray) -> None:
        out.append(key | tag << 60)
        of.append(row)

    for tag, (k, new) in ((0, (ka, na)), (1, (kb, nb))):
        row, at = np.nonzero(new)
        add(tag, c[row] << 12 | k[row, at], row)
    row, at = np.nonzero(na)
    per = nb.sum(axis=1)
    left, lrow = np.repeat(ka[row, at], per[row]), np.repeat(row, per[row])
    firsts = np.cumsum(per) - per
    flat = kb[nb]
    index = np.repeat(firsts[row] - (np.cumsum(per[row]) - per[row]), per[row]) + np.arange(len(lrow))
    add(2, left << 12 | flat[index], lrow)
    every = np.arange(len(fps))
    add(3, a, every)
    add(4, b, every)
    return np.concatenate(out), fps[np.concatenate(of)]


def _emit_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        fps = batch["fp"].to_numpy()
        for lo in range(0, len(fps), 4096):
            k, f = keys(fps[lo : lo + 4096])
            yield pd.DataFrame({"key": k, "fp": f})


class Forest:
    """Union-find that knows which links joined two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r and p != x:
            up[x] = r
            x = p
        return r

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> pd.DataFrame:
        return pd.DataFrame({"a": list(self.up), "b": [self.root(x) for x in self.up]}, dtype="int64")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).astype(np.uint64))


def spanning(fps: np.ndarray, radius: int, forest: Forest) -> None:
    """Links a bucket of distinct fingerprints at radius: one scan of what is left for each fingerprint reached."""
    if len(fps) > WIDE:
        width = 64 // (radius + 1)
        for block in range(radius + 1):
            part = (fps.astype(np.uint64) >> np.uint64(block * width)) & np.uint64((1 << (width if block < radius else 64 - radius * width)) - 1)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            for group in np.split(fps[order], cuts):
                if 1 < len(group):
                    _scan(group, radius, forest)
        return
    _scan(fps, radius, forest)


def _scan(fps: np.ndarray, radius: int, forest: Forest) -> None:
    left = fps
    queue: list[int] = []
    while len(left):
        if not queue:
            if len(left) == 1:
                return
            queue.append(int(left[0]))
            left = left[1:]
        at = queue.pop()
        near = differing(left, np.int64(at)) <= radius
        if near.any():
            for x in left[near].tolist():
                forest.link(at, x)
                queue.append(x)
            left = left[~near]


def verifier(radius: int = RADIUS):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by key. The last key of a batch waits, as the next may go on with it."""
        forest = Forest()
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def settle(k: np.ndarray, f: np.ndarray) -> None:
            if not len(k):
                return
            cuts = np.flatnonzero(np.diff(k)) + 1
            sizes = np.diff(np.concatenate([[0], cuts, [len(k)]]))
            size = np.repeat(sizes, sizes)
            few = np.flatnonzero((size > 1) & (size <= FEW))
            kf, ff = k[few], f[few]
            for d in range(1, FEW):
                if len(kf) <= d:
                    break
                near = (kf[:-d] == kf[d:]) & (differing(ff[:-d], ff[d:]) <= radius)
                for a, b in zip(ff[:-d][near].tolist(), ff[d:][near].tolist(), strict=True):
                    forest.link(a, b)
            starts = np.concatenate([[0], cuts])
            for at, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
                spanning(np.unique(f[at : at + n]), radius, forest)

        for batch in batches:
            k, f = batch["key"].to_numpy(), batch["fp"].to_numpy()
            if not len(k):
                continue
            if kept and kept[0][0][0] != k[0]:
                settle(*map(np.concatenate, zip(*kept, strict=True)))
                kept = []
            at = int(np.searchsorted(k, k[-1]))
            if at:
                settle(*map(np.concatenate, zip(*kept, (k[:at], f[:at]), strict=True)))
                kept = []
            kept.append((k[at:], f[at:]))
        if kept:
            settle(*map(np.concatenate, zip(*kept, strict=True)))
        yield forest.edges()

    return verify


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links that join every pair of fingerprints (fp) within radius, directly or through others."""
    keyed = distinct.select("fp").mapInPandas(_emit_keys, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInPandas(verifier(radius), "a long, b long")


def rooted(distinct: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """distinct (fp, more columns) with root, the smallest fingerprint that it is linked to."""
    found = components(links(distinct, radius), scratch)
    return distinct.join(found, distinct["fp"] == found["node"], "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root"))


def group(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every row of docs (doc_id, text)."""
    if radius != RADIUS:
        raise ValueError("the keys are laid out for a radius of 4")
    scratch = Scratch(docs.sparkSession)
    marked = scratch.write(fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"))
    distinct = scratch.write(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    placed = rooted(distinct, scratch, radius)
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest id (of rows without one, the smallest hash)."""
    keys_ = {"__id": F.col("doc_id"), "__x": F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])}
    scratch = Scratch(docs.sparkSession)
    marked = scratch.write(fingerprints(docs.withColumns(keys_).select("__id", "__x", "text")).select("__id", "__x", "fp"))
    order = F.struct(F.col("__id").isNull().alias("no"), F.col("__id").alias("id"), F.col("__x").alias("x"))
    distinct = scratch.write(marked.groupBy("fp").agg(F.min(order).alias("first")))
    kept = scratch.write(rooted(distinct, scratch).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("k_id"), F.col("first.x").alias("k_x")))
    rows = docs.withColumns(keys_)
    out = rows.join(kept.hint("shuffle_hash"), rows["__id"].eqNullSafe(kept["k_id"]) & (rows["__x"] == kept["k_x"]), "left_semi")
    again = marked.groupBy("__id", "__x").count().where("count > 1").join(kept, F.col("__id").eqNullSafe(F.col("k_id")) & (F.col("__x") == F.col("k_x")), "left_semi")
    if not again.isEmpty():  # wholly repeated rows that would stay together
        out = out.dropDuplicates(["__id", "__x"])
    return out.select(*[f"`{c}`" for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    return group(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
