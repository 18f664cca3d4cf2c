"""Merkle manifest of a table: leaf, subroot of its group, root, proof and fold of every row.

H is the lowercase hex SHA-256 of its inputs concatenated (digests as hex text). A leaf is H of the
row's fields, each `-` if null, else its UTF-8 bytes, `:` and the value. In a group (language) the
leaves stand in ascending order of the id; while several nodes remain, every FAN consecutive ones
become their H (the last run may be shorter, one even). What remains is the subroot; the subroots,
nulls first and in UTF-8 order, give the root likewise.

Broadcast upper tree. Rows get their position in their group by one range sort and the counts of its
runs. Blocks of FAN ** HEIGHT consecutive leaves become rows of a written table: their ids and digests,
reduced inside the task. If the nodes above them are TOP at most, the driver builds the tree over them
and sends the suffix of every block's path (siblings and places of all levels above) by a broadcast
join; else a further round reduces the nodes as it did the leaves, and its paths come down by a join
on the block. Executors then finish each row's proof and fold its leaf up to the root.

Memory: a block, and on the driver TOP nodes. Ranges, blocks and joins do not depend on the size of
a group, of equal rows or of the number of groups.

Defined cases: null ids come first in their group, rows of equal id are ordered by their leaf, equal
rows are leaves each by itself; a null field is `-`, an empty one `0:`; an empty table gives no rows; extra columns
take no part and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches

FAN, HEIGHT, TOP, TAMPER_EVERY, DIGEST = 8, 4, 4096, 3, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROW = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in fields]), 256)


def tampered(docs: DataFrame) -> Column:
    """The leaf after the test's tampering: lower case of A-Z in the text of a third of the rows."""
    mild = F.translate("text", UPPER, UPPER.lower())
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(TAMPER_EVERY)) == 0
    return F.when(hit, leaf([mild if c == "text" else F.col(c) for c in FIELDS])).otherwise(F.col("leaf"))


def h(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def runs(nodes: list[str]) -> list[list[str]]:
    return [nodes[i : i + FAN] for i in range(0, len(nodes), FAN)]


def levels(leaves: list[str], height: int | None) -> list[list[str]]:
    """Levels of a tree from its leaves up: height of them, or (None) up to a single node."""
    out = [leaves]
    while (height is None and len(out[-1]) > 1) or (height is not None and len(out) <= height):
        out.append([h("".join(r)) for r in runs(out[-1])])
    return out


def path(tree: list[list[str]], at: int) -> str:
    """Steps from leaf `at` to the top of tree: for each, place in the run, length of the run, siblings."""
    steps = []
    for nodes in tree[:-1]:
        first = at - at % FAN
        run = nodes[first : first + FAN]
        steps.append(f"{at - first}{len(run)}" + "".join(run[: at - first]) + "".join(run[at - first + 1 :]))
        at //= FAN
    return "".join(steps)


def steps(path: str) -> Iterator[tuple[str, str]]:
    """Siblings left and right of each step."""
    at = 0
    while at < len(path):
        place, n = int(path[at]), int(path[at + 1])
        middle, end = at + 2 + place * DIGEST, at + 2 + (n - 1) * DIGEST
        yield path[at + 2 : middle], path[middle:end]
        at = end


def siblings(path: str) -> str:
    return "".join(a + b for a, b in steps(path))


def fold(leaf: str, path: str) -> str:
    for a, b in steps(path):
        leaf = h(a + leaf + b)
    return leaf


def split(digests: str) -> list[str]:
    return [digests[i : i + DIGEST] for i in range(0, len(digests), DIGEST)]


def block_tree(digests: str, n: int, height: int) -> list[list[str]]:
    """Tree of a block of a group of n nodes: height levels where the group has other blocks, else up to one node."""
    return levels(split(digests), None if n <= FAN**height else height)


def reducer(height: int):
    def reduced(digests: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([block_tree(d, k, height)[-1][0] for d, k in zip(digests, n, strict=True)])

    return F.pandas_udf(reduced, "string")


def ranked(scratch: Scratch, rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with p, the position in their group from 0, and n, the size of the group.

    One range sort over group and order, a number for each place in its partition, and sums over the
    runs: a run is what a partition holds of a group, so that a group has as many runs as partitions.
    """
    kept = scratch.write(rows)
    # Equal keys spread by their place in the file, so that repeated rows are no partition of their own.
    salted = kept.withColumn("salt", F.hash(F.col("_metadata.file_path"), F.col("_metadata.row_index")))
    ranges = salted.repartitionByRange(group, *order, "salt").sortWithinPartitions(group, *order, "salt").drop("salt")
    placed = scratch.write(ranges.withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", 33))
    w = Window.partitionBy(group)
    found = placed.groupBy("part", group).agg(F.min("at").alias("first"), F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = found.select("part", group, (before - F.col("first")).alias("shift"), F.sum("k").over(w).alias("n"))
    scratch.drop(kept)
    return placed.join(found, ["part", group]).withColumn("p", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def blocked(scratch: Scratch, nodes: DataFrame, extra: dict[str, str], height: int) -> DataFrame:
    """Nodes (g, n, p, digest, extra columns) as rows of blocks: g, n, b, members in order, root. Written."""
    size = FAN**height
    member = F.struct("p", "digest", *extra)
    blocks = nodes.groupBy("g", "n", F.expr(f"p div {size}").alias("b")).agg(F.sort_array(F.collect_list(member)).alias("m"))
    packed = {"digest": F.array_join("m.digest", ""), **{c: F.array_join(f"m.{c}", "") if kind == "hex" else F.col(f"m.{c}") for c, kind in extra.items()}}
    return scratch.write(blocks.select("g", "n", "b", *[v.alias(k) for k, v in packed.items()]).withColumn("root", reducer(height)("digest", "n")))


def above(blocks: DataFrame, height: int) -> DataFrame:
    """The nodes that blocks leave: n of the group, p, digest."""
    size = FAN**height
    return blocks.select("g", F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("b").alias("p"), F.col("root").alias("digest"))


def upper_tree(nodes: list[tuple[str, int, str]]) -> tuple[list[tuple[str, int, str, str]], str]:
    """The tree over at most TOP nodes (g, p, digest): (g, p, path, subroot) of each, and the root."""
    groups: dict[str, list[str]] = {}
    for g, _, digest in sorted(nodes, key=lambda x: (x[0].encode(), x[1])):
        groups.setdefault(g, []).append(digest)
    trees = {g: levels(x, None) for g, x in groups.items()}
    top = levels([t[-1][0] for t in trees.values()] or [h("")], None)
    out = []
    for i, (g, tree) in enumerate(trees.items()):
        last = path(top, i)
        out += [(g, p, path(tree, p) + last, tree[-1][0]) for p in range(len(tree[0]))]
    return out, top[-1][0]


def _down(height: int):
    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Paths of the members of blocks that have their own path."""
        for batch in batches:
            for x in batch.itertuples(index=False):
                tree = block_tree(x.digest, x.n, height)
                for lo in range(0, len(tree[0]), 512):  # few long paths at once
                    at = range(lo, min(lo + 512, len(tree[0])))
                    yield pd.DataFrame({"g": x.g, "p": [x.b * FAN**height + i for i in at], "path": [path(tree, i) + x.path for i in at], "subroot": x.subroot})

    return down


def _finish(root: str, height: int):
    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in batch.itertuples(index=False):
                tree, rows = block_tree(x.digest, x.n, height), []
                for i, (key, one, other) in enumerate(zip(x.doc_id, tree[0], split(x.again), strict=True)):
                    whole = path(tree, i) + x.path
                    folded = fold(other, whole)
                    rows.append((None if x.no_id[i] else key, one, x.subroot, root, h(siblings(whole)), folded, folded == root))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in ROW.split(", ")])
                yield out.astype({"doc_id": "Int64"})

    return finish


def join_up(lower: DataFrame, paths: DataFrame, small: bool) -> DataFrame:
    """Blocks with their own path; paths (g, p, path, subroot) are broadcast where their number is known to be TOP at most."""
    paths = paths.withColumnRenamed("p", "b")
    return lower.join(F.broadcast(paths) if small else paths, ["g", "b"])


def proofs(docs: DataFrame, height: int = HEIGHT, most: int = TOP) -> DataFrame:
    """Of every document: doc_id, leaf, subroot, root, proof_sha256, and its tampered leaf folded up: folded_root, verified."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    rows = docs.select(*[F.col(c) for c in FIELDS]).withColumn("leaf", leaf([F.col(c) for c in FIELDS]))
    # A group's key keeps null apart from every text and before it.
    key = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    light = rows.select(key.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), F.col("leaf").alias("digest"), tampered(rows).alias("again"))
    nodes = ranked(scratch, light, "g", ["doc_id", "digest"])
    nodes = nodes.withColumns({"no_id": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0))})
    base = blocked(scratch, nodes, {"again": "hex", "doc_id": "array", "no_id": "array"}, height)
    rounds, top, of_group = [], above(base, height), None
    while top.count() > most:
        if of_group is None and top.where("n > 1").isEmpty():
            # Only subroots are left, and they are many: they become the leaves of a tree of one group.
            ranks = ranked(scratch, top.select("g", F.lit("").alias("all"), "digest"), "all", ["g"])
            of_group = scratch.write(ranks.select("g", "n", "p", "digest"))
            top = of_group.select(F.lit("").alias("g"), "n", "p", "digest")
        blocks = blocked(scratch, top, {}, height)
        rounds.append((blocks, of_group is not None))
        top = above(blocks, height)
    found, root = upper_tree([tuple(r) for r in top.select("g", "p", "digest").collect()])
    kind = "g string, p long, path string, subroot string"
    paths, small = spark.createDataFrame(found, kind), True
    for blocks, among_groups in reversed(rounds):
        if not among_groups and of_group is not None:
            paths, of_group = _to_groups(scratch, paths, of_group), None
        paths, small = scratch.write(join_up(blocks, paths, small).mapInPandas(_down(height), kind)), False
    if of_group is not None:
        paths = _to_groups(scratch, paths, of_group)
    return join_up(base, paths, small).mapInPandas(_finish(root, height), ROW)


def _to_groups(scratch: Scratch, paths: DataFrame, of_group: DataFrame) -> DataFrame:
    """Paths of the tree of subroots, by rank, as paths of the groups' only nodes."""
    named = of_group.select("g", "p", F.col("digest").alias("subroot")).join(paths.select("p", "path"), "p")
    return named.select("g", F.lit(0).cast("long").alias("p"), "path", "subroot")


def digest(docs: DataFrame) -> DataFrame:
    return proofs(docs)


ORACLE = """
WITH RECURSIVE f AS (SELECT doc_id, lang, text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, z: CASE WHEN u % 2 = 1 THEN xor(u // 2, CAST(3988292384 AS BIGINT)) ELSE u // 2 END)), CAST(4294967295 AS BIGINT)) AS crc
  FROM documents),
a AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-'))
         ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS again,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM f),
lv(level, lang, p, n, h) AS (SELECT 0, lang, p, n, leaf FROM a
  UNION ALL SELECT level + 1, lang, p // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY p)) FROM lv WHERE n > 1 GROUP BY level, lang, p // 8, n),
sub AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS n FROM lv WHERE n = 1),
up(level, p, n, h) AS (SELECT 0, g, n, subroot FROM sub
  UNION ALL SELECT level + 1, p // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY p)) FROM up WHERE n > 1 GROUP BY level, p // 8, n),
steps AS (
  SELECT a.doc_id, v.level AS step, coalesce(string_agg(v.h, '' ORDER BY v.p) FILTER (v.p < a.p // (1 << (3 * v.level))), '') AS l,
         coalesce(string_agg(v.h, '' ORDER BY v.p) FILTER (v.p > a.p // (1 << (3 * v.level))), '') AS r
  FROM a JOIN lv v ON v.lang IS NOT DISTINCT FROM a.lang AND v.n > 1 AND v.p // 8 = a.p // (1 << (3 * v.level + 3)) GROUP BY a.doc_id, v.level
  UNION ALL
  SELECT a.doc_id, 1000 + v.level, coalesce(string_agg(v.h, '' ORDER BY v.p) FILTER (v.p < s.g // (1 << (3 * v.level))), ''),
         coalesce(string_agg(v.h, '' ORDER BY v.p) FILTER (v.p > s.g // (1 << (3 * v.level))), '')
  FROM a JOIN sub s ON s.lang IS NOT DISTINCT FROM a.lang JOIN up v ON v.n > 1 AND v.p // 8 = s.g // (1 << (3 * v.level + 3)) GROUP BY a.doc_id, v.level),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS i FROM steps),
folds(doc_id, i, h) AS (SELECT doc_id, CAST(0 AS BIGINT), again FROM a
  UNION ALL SELECT f.doc_id, f.i + 1, sha256(k.l || f.h || k.r) FROM folds f JOIN k ON k.doc_id = f.doc_id AND k.i = f.i + 1),
z AS (SELECT doc_id, arg_max(h, i) AS folded_root FROM folds GROUP BY doc_id),
o AS (SELECT a.doc_id, sha256(coalesce(string_agg(k.l || k.r, '' ORDER BY k.i), '')) AS proof_sha256 FROM a LEFT JOIN k ON k.doc_id = a.doc_id GROUP BY a.doc_id)
SELECT a.doc_id, a.leaf, s.subroot, t.h AS root, o.proof_sha256, z.folded_root, z.folded_root = t.h AS verified
FROM a JOIN sub s ON s.lang IS NOT DISTINCT FROM a.lang JOIN (SELECT h FROM up WHERE n = 1) t ON true JOIN z ON z.doc_id = a.doc_id JOIN o ON o.doc_id = a.doc_id
"""
