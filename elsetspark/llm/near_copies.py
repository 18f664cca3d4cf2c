"""One document of each group of near copies: sets of SHINGLE-word shingles with Jaccard similarity of 0.8 or more.

Words are those of the SimHash fingerprint (A-Z lower-cased, cut at ASCII white space); a text is
the set of the XXH64 of its shingles (fewer words: the whole sequence; none: the empty set). Texts
of one set count once.

Search in two parts, whose pairs are verified together on the whole sets.
1. simhash: fingerprints of the SHINGLE-word shingles, Golay keys and components of the operator
   in simhash.py; every set is paired with the first one of its component.
2. At similarity 0.8 a fingerprint differs in some ten bits, far beyond those keys. What they leave
   is found exactly: with the shingles of every set in one common order, two sets of similarity
   0.8 or more share one of their first n - ceil(0.8 n) + 1 shingles (prefix filter). Rare shingles
   come first; how often one occurs is read from a sample of the sets, which decides how many pairs
   are looked at and never which are found. Under a shingle, pairs that their sizes or the places
   of the shingle rule out are left.

Verification: each set has a sketch, a bit for every shingle among 4 to 8 times as many. The bits
two sets share, and what falls together in them, bound the shingles they share from above, so that
most pairs go without a look at the sets; the others are compared exactly. Sets are not stored:
only texts of such pairs are read again. Groups are the components of what stays.

A shingle of more than FEW sets is read twice: first each set with one other of them. Then the sets
under it come together with their sketches, and pairs of sets that are not linked yet and may be
alike go to the verification. Where there are more than DENSE such pairs a set (a large group of
near copies, or of texts that nearly are), they are not written; the sets come together once more
with their shingles (5 bytes of each), the task compares them, and gives one link for each two
groups that it joins. A large group of near copies then costs about one pair a set.

Memory: a task holds the rows of one shingle (32 bytes each, then their sketches, of a dense one
their shingles) and BATCH_BYTES of sets.

Defined cases: null and empty texts are one group; repeated rows are one group; a row without
doc_id comes after all that have one; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType

from .common import Scratch, free_shuffles, small_batches
from .components import components
from .simhash import SEED, hashes, majority, rooted

SHINGLE, FEW, DENSE = 5, 8, 4
SAMPLE, OFTEN, MOST_COMMON = 20_000, 4, 200_000  # sets read for the order, times a shingle is seen there to count, shingles kept


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes (uint64) of a text's shingles."""
    return np.unique(hashes(text, SHINGLE))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is 0.8 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def prefix(own: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The shingles of a set that any set alike shares one of, rare ones first. common: sorted shingles seen often, so many times."""
    times = np.zeros(len(own), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        times = np.where(common[at] == own, often[at], 0)
    return own[np.lexsort((own, times))][: len(own) + 4 * -len(own) // 5 + 1]


def sketch(own: np.ndarray) -> bytes:
    """A bit for each shingle of a set, of 4 to 8 times as many (a power of two, 64 at least)."""
    size = max(64, 1 << (4 * len(own) - 1).bit_length()) if len(own) else 64
    bits = np.zeros(size, dtype=np.uint8)
    bits[(own % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_be_alike(n: int, a: bytes, m: int, b: bytes) -> bool:
    """False only if sets of n and m shingles with sketches a and b cannot be alike.

    What two sets share sets bits in both; of it no more falls together than of either set."""
    x, y = np.frombuffer(a, dtype="<u8"), np.frombuffer(b, dtype="<u8")
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    ones = lambda v: int(np.bitwise_count(v).sum())
    most = ones(x & y) + min(n - ones(x), m - ones(y))
    return 9 * min(most, n, m) >= 4 * (n + m)


def _marked(common: np.ndarray, often: np.ndarray):
    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every = [hashes(t, SHINGLE) for t in batch["text"]]
            fp = np.array([majority(h) for h in every], dtype=np.uint64).astype(np.int64)
            sets = [np.unique(h) for h in every]
            sig = np.array([xxhash.xxh64_intdigest(s.astype("<u8").tobytes(), SEED) for s in sets], dtype=np.uint64).astype(np.int64)
            firsts = [prefix(s, common, often).astype("<u8").tobytes() for s in sets]
            yield pd.DataFrame({"__id": batch["__id"], "__x": batch["__x"], "sig": sig, "fp": fp, "n": np.array([len(s) for s in sets], dtype=np.int32), "firsts": firsts, "sketch": [sketch(s) for s in sets]})

    return mark


def _each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for t in batch["text"]:
            yield pd.DataFrame({"key": shingle_set(t).astype(np.int64)})


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        firsts = [np.frombuffer(s, dtype="<u8").astype(np.int64) for s in batch["firsts"]]
        sizes = np.array([len(f) for f in firsts], dtype=np.int64)
        if sizes.sum():
            yield pd.DataFrame({
                "key": np.concatenate(firsts), "sig": np.repeat(batch["sig"].to_numpy(), sizes),
                "n": np.repeat(batch["n"].to_numpy(), sizes), "pos": np.concatenate([np.arange(x, dtype=np.int32) for x in sizes]),
            })


def _possible(n: np.ndarray, pos: np.ndarray, i, j) -> np.ndarray:
    """Whether sets i and j (rows of one shingle) may be alike, by their sizes and what follows the shingle if it is the first shared one."""
    least, most = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    return (5 * least >= 4 * most) & (9 * np.minimum(n[i] - pos[i], n[j] - pos[j]) >= 4 * (n[i] + n[j]))


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by key, cut between keys. The last key of a batch waits, as the next may go on with it."""
    kept: list[list[np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        rows = [batch[c].to_numpy() for c in batch.columns]
        if kept and kept[0][0][0] != rows[0][0]:
            yield [np.concatenate(x) for x in zip(*kept, strict=True)]
            kept = []
        at = int(np.searchsorted(rows[0], rows[0][-1]))
        if at:
            yield [np.concatenate(x) for x in zip(*kept, [x[:at] for x in rows], strict=True)]
            kept = []
        kept.append([x[at:] for x in rows])
    if kept:
        yield [np.concatenate(x) for x in zip(*kept, strict=True)]


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _first_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All possible pairs of a key with FEW sets at most; else each set with one that the key picks, and the key's rows (wide)."""
    for key, sig, n, pos in _whole(batches):
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        size = np.repeat(sizes, sizes)
        few, found = np.flatnonzero((size > 1) & (size <= FEW)), []
        for d in range(1, FEW):
            i, j = few[:-d], few[d:]
            same = key[i] == key[j]
            i, j = i[same], j[same]
            ok = _possible(n, pos, i, j)
            found.append((sig[i[ok]], sig[j[ok]]))
        for at, m in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
            i = np.arange(at, at + m)
            mask = np.uint64(int(key[at]) % 4 * 0x9E3779B97F4A7C15 % 2**64)  # one of four orders, so that sets meet few others whatever the shingles they share
            j = np.full(m, at + int(np.argmin(sig[i].astype(np.uint64) ^ mask)))
            ok = (i != j) & _possible(n, pos, i, j)
            found.append((sig[i[ok]], sig[j[ok]]))
        many = size > FEW
        yield _pairs(found).assign(key=0, n=0, pos=0, wide=False)
        if many.any():
            yield pd.DataFrame({"a": sig[many], "b": 0, "key": key[many], "n": n[many], "pos": pos[many], "wide": True})


class Sketches:
    """The sketches of one shingle's sets, as matrices: of every size those of this size and, folded, of twice the size."""

    def __init__(self, n: np.ndarray, sketches: list[bytes]):
        self.n, own = n, [np.frombuffer(x, dtype="<u8") for x in sketches]
        self.size = np.array([len(x) for x in own])
        self.at: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(self.size).tolist():
            rows = np.flatnonzero((self.size == size) | (self.size == 2 * size))
            bits = np.stack([np.bitwise_or.reduce(own[k].reshape(-1, size), axis=0) for k in rows.tolist()])
            place = np.full(len(n), -1)
            place[rows] = np.arange(len(rows))
            self.at[size] = place, bits, n[rows] - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)

    def may(self, i: int, j: np.ndarray) -> np.ndarray:
        """Those of sets j that may be alike set i; sizes of sets alike are equal or one twice the other."""
        out = []
        size = int(self.size[i])
        for at, some in ((size, j[(self.size[j] == size) | (self.size[j] == 2 * size)]), (size // 2, j[2 * self.size[j] == size])):
            if len(some):
                place, bits, lost = self.at[at]
                own, rows = place[i], place[some]
                most = np.bitwise_count(bits[rows] & bits[own]).sum(axis=1, dtype=np.int64) + np.minimum(lost[rows], lost[own])
                most = np.minimum(most, np.minimum(self.n[some], self.n[i]))
                out.append(some[9 * most >= 4 * (self.n[some] + self.n[i])])
        return np.concatenate(out) if out else j[:0]


def _other_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs under each key that are of different groups and may be alike; the rows of keys with too many of them (dense). Rows sorted by key."""
    for key, sig, n, pos, root, sketches in _whole(batches):
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        for every in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key)) + 1):
            names, which, sizes = np.unique(root[every], return_inverse=True, return_counts=True)
            if len(names) < 2:
                continue
            own = Sketches(n[every], sketches[every].tolist())
            found, total = [], 0
            for i in np.flatnonzero(which != sizes.argmax()).tolist():
                j = np.flatnonzero(which != which[i])
                j = own.may(i, j[_possible(n[every], pos[every], i, j)])
                total += len(j)
                if total > DENSE * len(every):
                    break
                found.append((np.full(len(j), sig[every[i]]), sig[every[j]]))
            if total > DENSE * len(every):
                yield pd.DataFrame({"a": sig[every], "b": 0, "key": key[every], "n": n[every], "pos": pos[every], "root": root[every], "dense": True})
            elif total:
                yield _pairs(found).assign(key=0, n=0, pos=0, root=0, dense=False)


def shortened(own: np.ndarray) -> bytes:
    """The upper 5 bytes of each shingle of a set, in order."""
    return (own >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def lengthened(data: bytes) -> np.ndarray:
    parts = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    out = np.zeros((len(parts), 8), dtype=np.uint8)
    out[:, :5] = parts
    return out.view("<u8").reshape(-1)


def bridges(n: np.ndarray, pos: np.ndarray, root: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Places (i, j) of links between the groups (root) of one shingle's sets: as many as join all groups with sets alike."""
    root, out = root.copy(), []
    flat, ends = np.concatenate(sets), np.cumsum([len(x) for x in sets])
    starts = np.concatenate([[0], ends[:-1]])
    names, sizes = np.unique(root, return_counts=True)
    largest = names[sizes.argmax()]
    for i in np.flatnonzero(root != largest).tolist():
        j = np.flatnonzero(root != root[i])
        j = j[_possible(n, pos, i, j)]
        if not len(j):
            continue
        if 4 * len(j) < len(sets):
            both = np.array([len(np.intersect1d(sets[i], sets[k])) for k in j.tolist()])
        else:
            own = sets[i]
            both = np.add.reduceat((own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat).astype(np.int64), starts)[j]
        for k in j[9 * both >= 4 * (n[i] + n[j])].tolist():
            if root[k] != root[i]:
                out.append((i, k))
                root[root == root[k]] = root[i]
    return out


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between the groups under each key; rows sorted by key."""
    for key, sig, n, pos, root, shingles in _whole(batches):
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        for every in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key)) + 1):
            if len(np.unique(root[every])) > 1 and (found := bridges(n[every], pos[every], root[every], [lengthened(x) for x in shingles[every]])):
                i, j = every[[x for x, _ in found]], every[[y for _, y in found]]
                yield _pairs([(sig[i], sig[j])])


@F.pandas_udf(BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([alike(np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")) for x, y in zip(a, b, strict=True)], dtype=bool)


@F.pandas_udf(BooleanType())
def _may(n: pd.Series, a: pd.Series, m: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([may_be_alike(*x) for x in zip(n.tolist(), a, m.tolist(), b, strict=True)], dtype=bool)


@F.pandas_udf(BinaryType())
def _shingles(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t).astype("<u8").tobytes() for t in texts], dtype=object)


@F.pandas_udf(BinaryType())
def _shortened(texts: pd.Series) -> pd.Series:
    return pd.Series([shortened(shingle_set(t)) for t in texts], dtype=object)


def _read_again(named: DataFrame, sets: DataFrame, rows: DataFrame, scratch: Scratch, how) -> DataFrame:
    """sig, shingles (by how, of the text) of the sets named (sig, distinct)."""
    where = scratch.write(sets.select("sig", F.col("first.id").alias("k_id"), F.col("first.x").alias("k_x")).join(named, "sig"))
    texts = rows.join(where.hint("shuffle_hash"), rows["__id"].eqNullSafe(where["k_id"]) & (rows["__x"] == where["k_x"]))
    held = scratch.write(texts.select("sig", how(F.coalesce("text", F.lit(""))).alias("shingles")).dropDuplicates(["sig"]))
    scratch.drop(where)
    free_shuffles(rows.sparkSession)
    return held


def _verified(pairs: DataFrame, sets: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of pairs (a, b) whose sets are alike. Only texts of pairs that their sketches leave open are read again."""
    some = scratch.write(pairs.where("a <> b").distinct())
    of = lambda c: sets.select(F.col("sig").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    pairs = scratch.write(some.join(of("a"), "a").join(of("b"), "b").where(_may("na", "sa", "nb", "sb")).select("a", "b"))
    scratch.drop(some)
    free_shuffles(rows.sparkSession)
    named = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    held = _read_again(named, sets, rows, scratch, _shingles)
    both = pairs.join(held.select(F.col("sig").alias("a"), F.col("shingles").alias("sa")), "a").join(held.select(F.col("sig").alias("b"), F.col("shingles").alias("sb")), "b")
    out = scratch.write(both.where(_alike("sa", "sb")).select("a", "b"))
    scratch.drop(pairs, held)
    free_shuffles(rows.sparkSession)
    return out


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles seen often in a sample of rows, sorted, and how often."""
    share = min(1.0, SAMPLE / max(1, rows.count()))
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20)).select("text").mapInPandas(_each, "key long")
    seen = some.groupBy("key").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "key").limit(MOST_COMMON).collect()
    common = np.array([r["key"] for r in seen], dtype=np.int64).astype(np.uint64)
    order = np.argsort(common)
    return common[order], np.array([r["count"] for r in seen], dtype=np.int64)[order]


def by_fingerprint(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: each set (sig, fp) with the first of those whose fingerprints are linked to its own."""
    placed = sets.select("sig", "fp").join(rooted(sets.select("fp").distinct(), scratch), "fp")
    return placed.join(placed.groupBy("root").agg(F.min("sig").alias("b")), "root").select(F.col("sig").alias("a"), "b").where("a <> b")


def links(sets: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: links that join every pair of sets (sig, fp, n, firsts, sketch) that are alike, directly or through others."""
    close = scratch.write(by_fingerprint(sets, scratch))
    free_shuffles(rows.sparkSession)
    keyed = sets.select("sig", "n", "firsts").mapInPandas(_keys, "key long, sig long, n int, pos int")
    near = keyed.repartition("key").sortWithinPartitions("key").mapInPandas(_first_pairs, "a long, b long, key long, n int, pos int, wide boolean")
    near = scratch.write(near)
    free_shuffles(rows.sparkSession)
    first = _verified(near.where("not wide").select("a", "b").unionByName(close.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a"))), sets, rows, scratch)
    found = components(first, scratch)
    wide = near.where("wide").join(found, F.col("a") == F.col("node"), "left").select("key", F.col("a").alias("sig"), "n", "pos", F.coalesce("root", "a").alias("root"))
    open_ = wide.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    left = wide.join(open_, "key").join(sets.select("sig", "sketch"), "sig").select("key", "sig", "n", "pos", "root", "sketch")
    left = left.repartition("key").sortWithinPartitions("key").mapInPandas(_other_pairs, "a long, b long, key long, n int, pos int, root long, dense boolean")
    left = scratch.write(left)
    free_shuffles(rows.sparkSession)
    dense = left.where("dense").select("key", F.col("a").alias("sig"), "n", "pos", "root")
    held = _read_again(dense.select("sig").distinct(), sets, rows, scratch, _shortened)
    met = dense.join(held, "sig").select("key", "sig", "n", "pos", "root", "shingles")
    met = met.repartition("key").sortWithinPartitions("key").mapInPandas(_joined, "a long, b long")
    more = scratch.write(met.unionByName(left.where("not dense").select("a", "b")))
    scratch.drop(left, held)
    free_shuffles(rows.sparkSession)
    out = first.unionByName(_verified(more, sets, rows, scratch))
    scratch.drop(near, close, more)
    return out


def one_per_group(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest id (of rows without one, the smallest hash)."""
    keys_ = {"__id": F.col("doc_id"), "__x": F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])}
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    small_batches(spark)
    rows = docs.withColumns(keys_)
    kind = f"__id {rows.schema['__id'].dataType.simpleString()}, __x long, sig long, fp long, n int, firsts binary, sketch binary"
    named = scratch.write(rows.select("__id", "__x", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(_marked(*_common(rows)), kind))
    order = F.struct(F.col("__id").isNull().alias("no"), F.col("__id").alias("id"), F.col("__x").alias("x"))
    sets = scratch.write(named.groupBy("sig").agg(F.min(order).alias("first"), *[F.first(c).alias(c) for c in ("fp", "n", "firsts", "sketch")]))
    marked = scratch.write(named.select("__id", "__x"))
    scratch.drop(named)
    free_shuffles(spark)
    found = components(links(sets, rows, scratch), scratch)
    rooted = sets.join(found, sets["sig"] == found["node"], "left").select("first", F.coalesce("root", "sig").alias("root"))
    kept = scratch.write(rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("k_id"), F.col("first.x").alias("k_x")))
    out = rows.join(kept.hint("shuffle_hash"), rows["__id"].eqNullSafe(kept["k_id"]) & (rows["__x"] == kept["k_x"]), "left_semi")
    again = marked.groupBy("__id", "__x").count().where("count > 1").join(kept, F.col("__id").eqNullSafe(F.col("k_id")) & (F.col("__x") == F.col("k_x")), "left_semi")
    if not again.isEmpty():  # wholly repeated rows that would stay together
        out = out.dropDuplicates(["__id", "__x"])
    return out.select(*[f"`{c}`" for c in docs.columns])
