"""Benchmark decontamination: item-sized windows, SimHash candidates, exact verification.

Texts and items are lower-cased and cut to words (runs of letters, digits and underscores); both
are multisets of SHINGLE-word shingles (items of fewer words: their one whole sequence). Every
window of a document as long as an item, that shares a shingle with an item of that length, is
fingerprinted by the majority bits of its shingles' hashes (running sums over the positions). A
similarity above zero needs a shared shingle, so windows without one need no fingerprint.

Multi-index: a fingerprint is BLOCKS blocks of 16 bits. A window within RADIUS bits of an item is
within RADIUS // BLOCKS bits of it in one block at least. For each block and item length a postings
list leads from every value that is so near to an item to those items: a window's candidates are the
items in the lists of its blocks (4 in a hundred of the items of its length, where fingerprints are
spread evenly), and no other item is compared with it. Candidates within RADIUS bits are verified
exactly: the weighted Jaccard similarity of the two shingle multisets must reach SIMILARITY. At that similarity a bit differs with a chance of about 0.15, so that a few in a
hundred of the barely similar windows lie beyond RADIUS = 15 of 64; in a test of items edited down to
it 0.994 of what the exact search finds is found.

The items are sent to the executors in blocks of about BLOCK_BYTES of text and MOST_ITEMS items at
most, one pass over the documents a block; a usual benchmark is one block. Of several blocks the
driver holds one at a time, and each pass is written to the shared folder. An index takes some 60
bytes for each of its words; a worker adds 11 KB of postings an item when it first needs them: below
150 MB for the postings and the words of a block.

Defined cases: null or empty texts, and documents in no pass, are clean with similarity 0; items
that are null or have no word match nothing; documents shorter than an item are one window; of
repeated items each is reported; repeated rows get equal results; empty tables give an empty
result or clean documents; extra columns are kept, columns named like the added ones replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import Scratch, small_batches

SHINGLE, SIMILARITY, RADIUS, BLOCKS, BLOCK_BYTES, MOST_ITEMS = 5, 0.8, 15, 4, 8 << 20, 8192
#: Candidates that one step of the lookup holds.
PAIRS = 1 << 18
WORD = re.compile(r"\w+")
ADDED = ["contaminated", "items", "similarity"]
SPREAD = np.array([xxhash.xxh64_intdigest(f"place {i}") | 1 for i in range(SHINGLE)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit word over all its bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codes(ids: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width word ids."""
    n = len(ids) - width + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    for k in range(width):
        out += ids[k : k + n] * SPREAD[k]
    return mix(out + np.uint64(width))


def bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def packed(votes: np.ndarray, n) -> np.ndarray:
    return np.packbits(2 * votes > n, axis=-1, bitorder="little").view("<u8").reshape(votes.shape[:-1])


def bag(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A multiset of hashes: sorted distinct ones, and how often each is in it."""
    return np.unique(h, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    shared = int(np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum())
    return shared / (int(a[1].sum()) + int(b[1].sum()) - shared)


def sixteens(prints: np.ndarray) -> np.ndarray:
    """The blocks of fingerprints: n x BLOCKS."""
    return prints.astype("<u8").view("<u2").reshape(-1, BLOCKS)


class Items:
    """The items of one length: ids, multisets of shingles, fingerprints, and the postings of each block: near values, and the items near each."""

    def __init__(self, items: list[tuple[int, np.ndarray]], radius: int):
        self.radius, self.ids = radius, [i for i, _ in items]
        self.bags = [bag(h) for _, h in items]
        self.prints = np.array([packed(bits(h).sum(axis=0, dtype=np.int64), len(h)) for _, h in items], dtype=np.uint64)
        self.postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None  # made where they are first needed

    def _lists(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each block: sorted values, where the list of each begins, and the lists."""
        if self.postings is None:
            every = np.arange(1 << 16, dtype=np.uint16)
            flips = every[np.bitwise_count(every) <= self.radius // BLOCKS]
            self.postings = []
            for values in sixteens(self.prints).T:
                near = (values[:, None] ^ flips).ravel()
                order = np.argsort(near, kind="stable")
                distinct, first = np.unique(near[order], return_index=True)
                self.postings.append((distinct, np.append(first, len(near)), (order // len(flips)).astype(np.int32)))
        return self.postings

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(item, fingerprint) by number, in this order, of all within the radius; how many candidates were compared, and fingerprints with none."""
        found, compared, reached = [np.zeros(0, dtype=np.int64)], 0, np.zeros(len(prints), dtype=bool)
        step = max(1, PAIRS // len(self.ids))
        for lo in range(0, len(prints), step):
            some = prints[lo : lo + step]
            for (distinct, first, lists), values in zip(self._lists(), sixteens(some).T, strict=True):
                at = np.minimum(np.searchsorted(distinct, values), len(distinct) - 1)
                begin, times = first[at], np.where(distinct[at] == values, first[at + 1] - first[at], 0)
                reached[lo : lo + step] |= times > 0
                n = int(times.sum())
                compared += n
                item = lists[np.repeat(begin - (np.cumsum(times) - times), times) + np.arange(n)]
                keep = np.flatnonzero(np.bitwise_count(np.repeat(some, times) ^ self.prints[item]) <= self.radius)
                which = np.searchsorted(np.cumsum(times), keep, side="right")
                found.append(item[keep].astype(np.int64) * len(prints) + which + lo)
        item, which = np.divmod(np.unique(np.concatenate(found)), max(1, len(prints)))
        return item, which, compared, len(prints) - int(reached.sum())


class Index:
    """Items by length in words, and for each shingle the lengths of items that have it."""

    def __init__(self, items: list[tuple[int, str | None]], radius: int = RADIUS, threshold: float = SIMILARITY):
        self.radius, self.threshold, self.vocabulary = radius, threshold, {}
        self.seen = self.left = self.compared = 0  # windows with a fingerprint, those of them without a candidate, and candidates
        by: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for item, text in items:
            words = WORD.findall((text or "").lower())
            if words:
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.uint64)
                by[len(words)].append((item, codes(ids, min(SHINGLE, len(words)))))
        self.sizes = {size: Items(xs, radius) for size, xs in by.items()}
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in {min(SHINGLE, s) for s in by}:
            having = [(size, np.unique(np.concatenate([h for _, h in xs]))) for size, xs in by.items() if min(SHINGLE, size) == width]
            code, size = np.concatenate([h for _, h in having]), np.concatenate([np.full(len(h), s, dtype=np.int64) for s, h in having])
            order = np.lexsort((size, code))
            distinct, first = np.unique(code[order], return_index=True)
            self.known[width] = distinct, np.concatenate([first, [len(code)]]), size[order]

    def matches(self, text: str | None) -> dict[int, float]:
        """Best similarity of each item that a window of text matches."""
        words = WORD.findall(text.lower()) if text else []
        found: dict[int, float] = {}
        if not words:
            return found
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))
        known = ids > 0
        for width, (distinct, firsts, sizes) in self.known.items():
            if len(words) < width:
                continue
            run = np.cumsum(np.concatenate([[0], known]))
            inside = np.flatnonzero(run[width:] - run[:-width] == width)
            if not len(inside):
                continue
            here = codes(ids, width)[inside]
            at = np.minimum(np.searchsorted(distinct, here), len(distinct) - 1)
            hit = distinct[at] == here
            if not hit.any():
                continue
            # A row for each place of a shingle and each length of items that have it.
            place, at = inside[hit], at[hit]
            times = firsts[at + 1] - firsts[at]
            which = np.repeat(firsts[at] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
            place, size = np.repeat(place, times), sizes[which]
            # Words outside the vocabulary are told apart by position for hashing; they match no item.
            full = codes(np.where(known, ids, np.arange(len(ids), dtype=np.uint64) + np.uint64(1 << 40)), width)
            for s in np.unique(size).tolist():
                self._windows(full, len(words), width, s, place[size == s], found)
        return found

    def _windows(self, h: np.ndarray, n_words: int, width: int, size: int, places: np.ndarray, found: dict[int, float]) -> None:
        span = min(size, n_words) - width + 1  # shingles of a window
        last = len(h) - span
        ahead = np.zeros(len(h) + 1, dtype=np.int64)  # starts of windows that hold a place, as steps up and down
        np.add.at(ahead, np.maximum(0, places - span + 1), 1)
        np.add.at(ahead, np.minimum(places, last) + 1, -1)
        starts = np.flatnonzero(np.cumsum(ahead)[: last + 1] > 0)
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1):
            for lo in range(0, len(part), 4096):
                some = part[lo : lo + 4096]
                first = int(some[0])
                votes = np.zeros((int(some[-1]) + span - first + 1, 64), dtype=np.int32)
                np.cumsum(bits(h[first : int(some[-1]) + span]), axis=0, dtype=np.int32, out=votes[1:])
                prints = packed(votes[some - first + span] - votes[some - first], span)
                self._lookup(h, some, prints, span, self.sizes[size], found)

    def _lookup(self, h: np.ndarray, starts: np.ndarray, prints: np.ndarray, span: int, items: Items, found: dict[int, float]) -> None:
        item, which, compared, left = items.near(prints)
        self.seen, self.left, self.compared = self.seen + len(prints), self.left + left, self.compared + compared
        for part in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1):
            if not len(part):
                continue
            at, own = which[part], int(item[part[0]])
            number, (distinct, times) = items.ids[own], items.bags[own]
            # A window cannot be more similar than the number of its shingles that the item has allows.
            first = int(starts[at[0]])
            here = h[first : int(starts[at[-1]]) + span]
            inside = np.zeros(len(here) + 1, dtype=np.int64)
            np.cumsum(distinct[np.minimum(np.searchsorted(distinct, here), len(distinct) - 1)] == here, out=inside[1:])
            most = inside[starts[at] - first + span] - inside[starts[at] - first]
            n = int(times.sum())
            at = at[np.minimum(most, n) >= self.threshold * (span + n) / (1 + self.threshold) - 1e-9]
            for s in starts[at].tolist():
                score = similarity(bag(h[s : s + span]), (distinct, times))
                if score >= self.threshold and score > found.get(number, 0.0):
                    found[number] = score


KIND = StructType([StructField("items", ArrayType(LongType())), StructField("similarity", DoubleType())])


def scan(docs: DataFrame, index: Index, name: str) -> DataFrame:
    @F.pandas_udf(KIND)
    def look(texts: pd.Series) -> pd.DataFrame:
        found = [index.matches(t) for t in texts]
        return pd.DataFrame({"items": [sorted(x) for x in found], "similarity": [max(x.values(), default=0.0) for x in found]})

    return docs.withColumn(name, look("text"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with contaminated (boolean), items (ids, sorted) and similarity (the best)."""
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    size, n = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    blocks = max(-(-2 * have // most) if have > most else 1 for have, most in ((size, BLOCK_BYTES), (n, MOST_ITEMS)))
    kept = [c for c in docs.columns if c not in ADDED]
    held = "__found"
    while held in kept:
        held += "_"
    out = docs.select(*[f"`{c}`" for c in kept]).withColumns({"items": F.array().cast("array<bigint>"), "similarity": F.lit(0.0)})
    scratch, last = Scratch(docs.sparkSession) if blocks > 1 else None, None
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        index = Index(sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"]) for r in part.collect()))
        out = scan(out, index, held).select(*[f"`{c}`" for c in kept], F.array_sort(F.array_union("items", f"{held}.items")).alias("items"), F.greatest("similarity", f"{held}.similarity").alias("similarity"))
        if scratch is not None:
            out = scratch.write(out)
            if last is not None:
                scratch.drop(last)
            last = out
    return out.select(*[f"`{c}`" for c in kept], (F.size("items") > 0).alias("contaminated"), "items", "similarity")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs.select("doc_id", "text"), benchmark).select("doc_id", *ADDED)
