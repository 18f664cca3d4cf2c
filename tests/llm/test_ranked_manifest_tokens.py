"""Merkle manifest, token frames and tiered search against brute force."""

import hashlib
import math
import os
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from elsetspark.llm import merkle, queries, tiered_index, token_frames
from elsetspark.llm.common import shared_dir

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = ["Alpha", "beta,", "gamma", "naïve", "don't", "x1", "ÉTÉ", "zeta\neta", "the", "the", "the", "of"] + [f"w{i}" for i in range(60)]
    out = []
    for i in range(700):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))
        out.append([i if i % 41 else None, rng.choice([text] * 12 + [None, "", "  ", "...!"]), rng.choice(["en"] * 5 + ["de", "é", None, "", f"l{i % 40}"]), rng.choice(["s", None]), rng.choice([None, 3])])
    out += [[5, "same row", "en", "s", 1]] * 30 + [[900 + i, "one copy of the text", "en", "s", 1] for i in range(80)] + [[2000, "the w1 " * 9000, "en", "s", 1]]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# 11 Merkle manifest


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H("".join(map(field, (r[0], r[3], r[2], r[4], text))))
    groups = defaultdict(list)
    for r in rows:
        one = leaf(r, r[1])
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
        groups[r[2]].append((r[0] is not None, r[0] or 0, one, leaf(r, re.sub("[A-Z]", lambda m: m[0].lower(), r[1])) if hit else one))

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(at):
                first = p // 8 * 8
                paths[i].append((nodes[first:p], nodes[p + 1 : first + 8]))
                at[i] = p // 8
            nodes = [H("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        return nodes[0], paths

    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree([x[2] for x in groups[k].sort() or groups[k]]) for k in names}
    root, last = tree([trees[k][0] for k in names])
    out = []
    for k, end in zip(names, last, strict=True):
        for (has, i, one, other), path in zip(groups[k], trees[k][1], strict=True):
            folded = other
            for a, b in path + end:
                folded = H("".join(a) + folded + "".join(b))
            out.append((i if has else None, one, trees[k][0], root, H("".join("".join(a + b) for a, b in path + end)), folded, folded == root))
    return out


def in_order(out):
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[4]))


@pytest.mark.parametrize(("height", "most"), [(4, 4096), (1, 30), (1, 2), (2, 5)])
def test_manifest_against_plain_tree(docs, rows, height, most):
    """One round, several rounds inside groups, and rounds among the groups' subroots."""
    got = [tuple(r) for r in merkle.proofs(docs, height, most).collect()]
    assert in_order(got) == in_order(plain_manifest(rows))
    assert 0 < sum(not r[-1] for r in got) < len(got) / 2


def test_manifest_single_leaf_and_empty(spark):
    one = merkle.digest(spark.createDataFrame([[7, "Text", "en", None, None]], DOCS)).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == H("")
    assert merkle.digest(spark.createDataFrame([], DOCS)).count() == 0


def test_manifest_ignores_other_columns(docs):
    named = docs.withColumns({c: F.lit("x") for c in ("p", "n", "g", "b", "at", "part", "leaf", "root", "digest", "again", "path")})
    assert in_order(map(tuple, merkle.digest(named).collect())) == in_order(map(tuple, merkle.digest(docs).collect()))


def test_every_altered_leaf_is_found(docs):
    for r in merkle.digest(docs).where("not verified").collect():
        assert zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["folded_root"] != r["root"]


# 12 token frames


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def test_encoder_equals_the_library(tokenizer):
    rng, encoder = random.Random(3), token_frames.Encoder(TOKENIZER)
    parts = [" ", " ", " ", "a", "the", "The", "'s", "'", "'ll", "1", "23", ".", "!", "\n", "\n\n", "\t", "\r\n", "\xa0", "　", "é", "ß", "中", "😀", "​", "́", "\x85", "\x1c", " ", "<|endoftext|>", "_", "-", "٣", "²", "ÿ", "\xad", "\x00", "  "]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 30)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_special_strings_as_text(tokenizer):
    plain = token_frames.Encoder(TOKENIZER, special=False)
    assert 50256 in np.frombuffer(token_frames.Encoder(TOKENIZER).encode("a <|endoftext|> b"), "<u4") and 50256 not in np.frombuffer(plain.encode("a <|endoftext|> b"), "<u4")


def plain_ids(rows, tokenizer):
    """(doc_id, start, ids) in the order of ids, null last; equal ids in any order."""
    out, start = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        out.append((r[0], start, ids))
        start += len(ids)
    return out


def test_tokens_round_trip(spark, docs, rows, tokenizer):
    unique = [r for r in rows if r[0] is not None and r[0] != 5]
    root = shared_dir(spark)
    token_frames.write_tokens(spark.createDataFrame(unique, DOCS), root, TOKENIZER, part=8000, roll=3000, most=40)
    expected = plain_ids(unique, tokenizer)
    assert sorted((r["doc_id"], r["start"], list(r["ids"])) for r in token_frames.read_tokens(spark, root).collect()) == expected
    got = sorted(tuple(r) for r in token_frames.digest(spark.createDataFrame(unique, DOCS), TOKENIZER).collect())
    assert got == [(i, s, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for i, s, x in expected]
    wanted = [rows[3][0], 2000, 12, 77777]
    assert {r["doc_id"]: list(r["ids"]) for r in token_frames.fetch(spark, root, [w for w in wanted if w is not None]).collect()} == {i: x for i, _, x in expected if i in wanted}
    assert len([n for n in os.listdir(root) if n.endswith(".zst")]) > 10 and not [n for n in os.listdir(root) if n.endswith(".tmp")]


def test_tokens_of_null_and_repeated_ids(spark, docs, rows, tokenizer):
    got = token_frames.digest(docs, TOKENIZER).collect()
    expected = plain_ids(rows, tokenizer)
    assert len(got) == len(rows) and Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, len(x)) for i, _, x in expected)
    spans = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    assert min(r["start"] for r in got if r["doc_id"] is None) == sum(r["n_tokens"] for r in got if r["doc_id"] is not None)
    assert token_frames.digest(docs.where("doc_id = -1"), TOKENIZER).count() == 0


def test_long_documents_take_several_frames(spark, monkeypatch, tmp_path):
    raw = np.arange(5000, dtype="<u4").tobytes()
    monkeypatch.setattr(token_frames, "FRAME_BYTES", 4096)
    frames, sizes, sums = token_frames.packed(raw, zstandard.ZstdCompressor(write_checksum=True))
    writer = token_frames.Writer(str(tmp_path), 0, 1 << 30, 1 << 30)
    for key in (1, 4, 9):
        writer.add(key, False, 5000, frames, sizes, sums)
    writer.close()
    path = tmp_path / writer.done[0][0]
    import pyarrow as pa

    with pa.OSFile(str(path)) as file:
        reader = token_frames.Reader(file)
        assert reader.find(4) == range(1, 2) and reader.find(5) == range(2, 2) and reader.docs == 3
        assert [b"".join(f) for _, f in reader.documents(1, 3)] == [raw, raw]
    whole = path.read_bytes()
    # Any zstandard reader that knows many frames reads the file: skippable frames hold index and seek table.
    out, rest = b"", zstandard.ZstdDecompressor().decompressobj(read_across_frames=True)
    out = rest.decompress(whole)
    assert out == raw * 3
    broken = bytearray(whole)
    broken[-9 - 12 * len(frames) * 3 + 8] ^= 1  # the checksum of the first frame in the seek table
    path.write_bytes(bytes(broken))
    with pa.OSFile(str(path)) as file, pytest.raises(ValueError, match="checksum"):
        [b"".join(f) for _, f in token_frames.Reader(file).documents(0, 1)]


# 13 tiered search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = [(1, "the alpha w1 w2 naïve été"), (2, "The the THE of"), (3, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (4, None), (5, "!!"), (6, "nowhere1"), (7, "one copy of the text"), (None, "w20 w21 zeta")]


def plain_search(rows, items, k):
    low = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(r[0], Counter(low(r[1]))) for r in rows]
    counts = [x for x in counts if x[1]]
    n, length, df = len(counts), sum(sum(c.values()) for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(low(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank + 1, None if no else i, -s) for rank, (s, no, i) in enumerate(sorted(scored)[:k])]
    return out


def ranks(out):
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize(("segment", "candidates"), [(16384, 1024), (50, 3), (120, 1024)])
def test_search_against_brute_force(spark, docs, rows, monkeypatch, segment, candidates):
    monkeypatch.setattr(tiered_index, "SEGMENT_DOCS", segment)
    monkeypatch.setattr(tiered_index, "CANDIDATES", candidates)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for k in (5, 50):
        assert ranks(map(tuple, tiered_index.search(docs, items, k).collect())) == ranks(plain_search(rows, ITEMS, k))


def test_tiers_prove_and_fall_through(spark):
    """Some items are exact after the first tier, some after the second, some need all postings; none is decided twice."""
    progress: list = []
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    tiered_index.search(docs, items, 50, progress)
    first, second, last = progress
    assert first["candidate"] and first["open"] and second["candidate"] and last["exact"]
    assert first["candidate"] + first["open"] == 40 and second["candidate"] + second["open"] == first["open"] and last["exact"] == second["open"]


def test_blocks_of_items_change_nothing(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(tiered_index, "BLOCK_BYTES", 200)
    items = spark.createDataFrame(ITEMS + [(1, "w1 alpha")], "item_id long, text string").withColumn("score", F.lit("x"))
    got = tiered_index.search(docs.withColumns({"rank": F.lit(1), "uid": F.lit("u"), "n": F.lit("n")}), items, 4)
    text = lambda out: sorted(map(str, map(tuple, out)))
    assert text(got.collect()) == text(plain_search(rows, ITEMS + [(1, "w1 alpha")], 4))


def test_search_of_empty_tables(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert tiered_index.digest(docs.where("doc_id = -1"), items).count() == 0
    assert tiered_index.digest(docs, items.where("item_id = -1")).count() == 0


def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for n in ("documents", "benchmark"):
        c.sql(f"create view {n} as select * from '{SF}/{n}.parquet'")
    for name in ("op11_broadcast_upper_tree", "op13_tiered_search"):
        out = queries.QUERIES[name](spark, SF)
        expected = c.sql(queries.ORACLES[name])
        assert sorted(map(tuple, out.select(*expected.columns).collect())) == sorted(expected.fetchall()), name
