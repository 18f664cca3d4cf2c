"""Training-data operators against brute force, on small fixtures with nulls, ties, repeats and clashing columns."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from elsetspark.llm import decontaminate, html_extract, language_id, line_dedup, mixing, queries, run_index, sharding, simhash, topk_search, warc
from elsetspark.llm.components import components
from elsetspark.llm.common import Scratch, shared_dir

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "la", "mu"]) + str(rng.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def fixture_docs():
    rng = random.Random(5)
    rows = []
    shared = " ".join(words(rng, 90))
    base = words(rng, 400)
    for i in range(60):
        text = " ".join(words(rng, rng.randrange(1, 300)))
        if i % 7 == 0:
            text = text[: rng.randrange(50)] + shared + text[50:]
        if i % 11 == 0:
            near = list(base)
            near[rng.randrange(len(near))] = "changed"
            text = " ".join(near)
        rows.append([i, text, ["en", "de", None][i % 3], f"s{i % 4}" if i % 9 else None, len(text)])
    rows += [[100, rows[3][1], "en", "s1", 1], [101, rows[3][1], "en", "s1", 1], [102, None, "en", "s0", None], [103, "", "de", None, 0], [104, "ab " * 700, "en", "s2", 5], [None, "no id here", None, "s3", 3]]
    rows += [list(rows[20])]  # a wholly repeated row
    rows += [[105, "x\ny\nz\nw", "en", "s2", 3], [106, "q\nx\ny\nz\nw\nx\ny\nz", "en", "s2", 3], [107, "\n\n\n\n", "en", "s2", 3], [108, "... 123 ---", "en", "s2", 3]]
    return rows


@pytest.fixture(scope="module")
def docs(spark, fixture_docs):
    return spark.createDataFrame(fixture_docs, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1 HTML extraction


def test_html_article_only():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>"</script></head><body>
    <header>Site <a href=/>home</a></header><nav><ul><li><a>One</a></li></ul></nav><div class="ad">Buy this, now.</div>
    <article><h1>Head &amp; line</h1><p>First   para, with <b>bold</b> text.<p>Second&nbsp;one.<br>Same block<ul><li>item one<li>item two</ul></article>
    <aside>Side, bar.</aside><form><label>Name</label></form><section class="comments"><p>Great read, really!</p></section><footer>&copy; x</footer></body></html>"""
    assert html_extract.main_text(page) == "Head & line\nFirst para, with bold text.\nSecond one. Same block\nitem one\nitem two"


def test_html_edges():
    assert [html_extract.main_text(x) for x in (None, "", "<html><body></body></html>", "<script>x")] == [""] * 4
    assert html_extract.main_text("just text &lt;b&gt;") == "just text <b>"
    assert html_extract.main_text("<body><p>" + "long text, here. " * 20 + "</p><div id='sidebar'><p>no</p></div>").startswith("long text, here.")
    assert html_extract.main_text("<article><p>cut off &am") == "cut off &am"


def test_html_query_matches_plain_reading(spark):
    def plain(page):
        m = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
        import html as h

        parts = [" ".join(h.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", m[1] if m else "")]
        return "\n".join(x for x in parts if x)

    got = {r["page_id"]: r for r in queries.op1_tag_path_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p["page_id"]]["text"] == plain(p["html"]) and got[p["page_id"]]["n_chars"] == len(plain(p["html"]))


def test_html_nulls_and_clashes(spark):
    df = spark.createDataFrame([(1, None, None, "old"), (1, None, None, "old"), (None, "u", "<p>hello, there</p>", "old")], "page_id long, url string, html string, text string")
    assert sorted((r["text"], r["n_chars"]) for r in html_extract.extract(df).collect()) == [("", 0), ("", 0), ("hello, there", 12)]
    assert html_extract.extract(df.where("page_id = 9")).count() == 0


# 2 top-k search


def test_topk_against_brute_force(spark, monkeypatch):
    """Repeated ids are rows of their own: each a candidate, for queries of other ids; queries of one id share a ranking."""
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)] if i % 5 else [0.0, 0.25, 0.0, 0.0, -0.5, 0.0], i) for i in range(300)]
    rows += [(300, None, 0), (301, [1.0, None], 0), (302, [float("nan")], 0), (303, [float("inf")], 0), (350, [0.5], 1), (None, [0.1], 2)]
    rows += [(7, [9.0] * 6, 0)] * 3 + [(100, [float(x) for x in rng.normal(size=6)], 5), (100, [2.0] * 6, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    vec = [(i, [int(np.floor(float(np.float32(x)) * 256)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for q in {i for i, _ in vec if i % 50 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for i, a in vec if i == q for c, b in vec if c != q)[:5]
        expected += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scored)]
    assert sorted(tuple(r) for r in topk_search.digest(df).collect()) == sorted(expected)
    assert topk_search.digest(df.where("label = 77")).count() == 0
    for name, value in (("TILE", 2), ("BLOCK_LEAST", 16), ("CELL_NUMBERS", 6 * 16)):
        monkeypatch.setattr(topk_search, name, value)
    assert sorted(tuple(r) for r in topk_search.digest(df).collect()) == sorted(expected)


def test_topk_number_types():
    for big in (1, 2**20, 2**28):
        q, c = np.array([[big, 0, -3]]), np.array([[big, 5, 1], [0, 0, 2]])
        kind = topk_search.number_type(big, max(big, 5), 3)
        assert topk_search.accumulate(q, topk_search.postings(c, kind), 2, kind).astype(np.int64).tolist() == (q @ c.T).tolist()
    with pytest.raises(OverflowError):
        topk_search.number_type(2**40, 2**40, 1)


# 3 sharding


def test_shards(spark, docs, fixture_docs, empty):
    out = sharding.digest(docs).collect()
    assert len(out) == len(fixture_docs)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert max(map(len, by.values())) - min(len(by.get(j, [])) for j in range(40)) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    expected = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in fixture_docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == expected
    assert {tuple(r) for r in out} == {tuple(r) for r in sharding.digest(docs.repartition(7)).collect()}
    assert sharding.digest(empty).count() == 0
    assert sharding.shard_rows(docs.withColumn("shard", F.lit("old"))).columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "shard", "slot"]


def test_communication_matrix_is_uniform():
    sizes, counts = [3, 3, 4], [5, 0, 5]
    seen = Counter()
    for seed in range(3000):
        m = sharding.communication_matrix(counts, sizes, seed)
        assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == sizes
        seen[tuple(m[0])] += 1
    from math import comb

    for row, n in seen.items():
        assert abs(n / 3000 - np.prod([comb(s, k) for s, k in zip(sizes, row)]) / comb(10, 5)) < 0.03
    rng = np.random.default_rng(1)
    big = [sharding._hypergeometric(rng, 10**9, 10**9, 1000) for _ in range(400)]
    assert abs(np.mean(big) - 500) < 4 and 10 < np.std(big) < 22


# 4 line dedup


def brute_lines(rows):
    seen, out = set(), []
    order = sorted({(r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest(), r[1]) for r in rows if r[1] is not None}, key=lambda x: x[:3])
    first, cov = {}, defaultdict(set)
    for key in order:
        lines = key[3].split("\n")
        for i in range(len(lines) - 2):
            w = "\n".join(lines[i : i + 3])
            if w == "\n\n":
                continue
            if w in first:
                cov[key] |= {i, i + 1, i + 2}
            else:
                first[w] = (key, i)
    for r in rows:
        if r[1] is None:
            out.append((r[0], None, 0, 0))
            continue
        key = (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest(), r[1])
        lines = r[1].split("\n")
        out.append((r[0], "\n".join(x for i, x in enumerate(lines) if i not in cov[key]) if cov[key] else r[1], len(lines), len(cov[key])))
    return Counter(out)


def test_line_windows(spark, docs, fixture_docs, empty):
    got = line_dedup.drop_repeated_lines(docs.withColumn("n_lines", F.lit("old")))
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()) == brute_lines(fixture_docs)
    assert sum(r["n_removed"] for r in got.collect()) > 0
    assert line_dedup.drop_repeated_lines(empty).count() == 0


# 5 language ID


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in queries.op5_byte_rnn_language(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2]
    assert len(out) == len(docs) and all(out[d["doc_id"]]["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2) for d in docs)
    assert np.mean([out[d["doc_id"]]["lang_pred"] == d["lang"] for d in held]) > 0.97


def test_language_edges(spark, docs, fixture_docs, empty):
    out = language_id.digest(docs).collect()
    assert len(out) == len(fixture_docs)
    by = {r["doc_id"]: r for r in out}
    for i in (102, 103, 107, 108):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und") for r in out)
    assert language_id.digest(empty).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.digest(unlabelled).collect()} == {"und"}


def test_language_learns_order_not_letters():
    """Two languages of the same letters that differ in their order only: what a network without recurrence could not tell."""
    rng = random.Random(3)
    text = lambda step: "".join("abcdefgh"[(rng.randrange(8) if not i % 9 else i) * step % 8] for i in range(4000)).encode()
    net = language_id.train([text(1), text(7)], [0, 1], ["up", "down"])
    assert language_id.predict(net, ["abcdefghabcdefgh", "hgfedcbahgfedcba", None, "12"])[0] == ["up", "down", "und", "und"]


# 6 WARC


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 900 + "</p>"
    rows = [(1, "http://a", big), (2, "http://b c\n", big), (5, None, big), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (None, "n", big), (5, "dup", big), (8, "l", "x" * 300_000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload_digest string")
    root = f"{shared_dir(spark)}/w"
    listed = lambda m: sorted(tuple(r) for r in m.collect())
    files = listed(warc.write_archives(df, root, roll=2000))
    assert len(files) > 2 and json.loads(open(root.replace("file://", "") + "/manifest.json").read()) == {"files": len(files), "records": len(rows), "bytes": sum(f[2] for f in files)}
    got = sorted(((r["page_id"] if r["page_id"] is not None else -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, root).collect()), key=str)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    size = lambda t: len((t or "").encode())
    revisit = {0, 1, 7, 8}
    expected = sorted(((r[0] if r[0] is not None else -1, size(r[2]), sha(r[2]), "revisit" if i in revisit else "response", 5 if i in revisit else None) for i, r in enumerate(rows)), key=str)
    assert got == expected
    again = f"{shared_dir(spark)}/w"
    assert listed(warc.write_archives(df.repartition(5), again, roll=2000)) == files
    named = lambda: sorted(p.name for p in Path(root).glob("*.warc.gz"))
    before = named()
    (Path(root) / ".shard-00000-00000.warc.gz.lost.tmp").write_bytes(b"x")
    table = spark.createDataFrame([(f".{f[0]}.again.tmp", *f) for f in files], warc.MANIFEST)
    assert listed(warc.commit(table, root)) == files and named() == before and not list(Path(root).glob(".*.tmp"))  # a repeated commit
    with pytest.raises(Exception, match="is lost"):
        warc.commit(spark.createDataFrame([(".a.tmp", "a", 1, 1, "")], warc.MANIFEST), root)
    assert warc.digest(df.where("page_id = 99")).count() == 0


def test_warc_rows_without_id_spread(spark, monkeypatch):
    monkeypatch.setattr(warc, "SHARD_BYTES", 4000)
    big = "same payload " * 100
    rows = [(None if i % 3 else 7, f"http://x/{i}", big if i % 2 else f"{i} {big}") for i in range(60)]
    root = f"{shared_dir(spark)}/w"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), root)
    shards = {p.name.split("-")[1] for p in Path(root).glob("*.warc.gz")}
    assert len(shards) > 8
    got = [(r["url"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, root).collect()]
    first = min(u for i, u, h in rows if i == 7 and h == big)
    assert sorted(got) == sorted((u, "revisit", 7) if h == big and u != first else (u, "response", None) for _, u, h in rows)


# 7 run-length index


def brute_repeats(texts, width):
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        gone = gone[:-1]
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)), hashlib.sha256(kept).hexdigest()))
    return out


def test_run_index_against_brute_force(spark, docs, fixture_docs, empty):
    expected = brute_repeats([(r[1] or "").encode() for r in fixture_docs], 400)
    assert sum(e[1] for e in expected) > 4000
    got = Counter(tuple(r) for r in run_index.digest(docs).collect())
    assert got == Counter((r[0], *e) for r, e in zip(fixture_docs, expected))
    assert run_index.digest(empty).count() == 0


def test_run_index_on_driver_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    expected = brute_repeats([r["text"].encode() for r in rows], 400)
    assert {tuple(r) for r in queries.op7_run_length_index(spark, "/root/testdata/sf0.01").collect()} == {(r["doc_id"], *e) for r, e in zip(rows, expected)}


def test_hot_anchors_take_the_other_way(spark, docs, fixture_docs, monkeypatch):
    """With every anchor hash hot, window digests alone give the same marks."""
    expected = Counter((r[0], *e) for r, e in zip(fixture_docs, brute_repeats([(r[1] or "").encode() for r in fixture_docs], 400)))
    monkeypatch.setattr(run_index, "HOT_BYTES", 0)
    assert Counter(tuple(r) for r in run_index.digest(docs).collect()) == expected
    monkeypatch.setattr(run_index, "HOT_BYTES", 3000)
    monkeypatch.setattr(run_index, "BUCKET_WINDOWS", 500)
    assert Counter(tuple(r) for r in run_index.digest(docs).collect()) == expected


def test_matching_statistics_small():
    rng = random.Random(1)
    for _ in range(60):
        parts = list({bytes(rng.choice(b"ab") for _ in range(rng.randrange(30))) for _ in range(4)})
        index = run_index.RunIndex(parts)
        ms, at = index.matching_statistics(), 0
        for k, p in enumerate(parts):
            for i in range(len(p)):
                best = 0
                for m, q in enumerate(parts):
                    for j in range(len(q)):
                        if (k, i) != (m, j):
                            n = 0
                            while i + n < len(p) and j + n < len(q) and p[i + n] == q[j + n]:
                                n += 1
                            best = max(best, n)
                assert ms[at + i] == best
            at += len(p)


# 8 mixing


def brute_mix(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    of = defaultdict(int)
    for r in rows:
        of[r[3]] += size(r[1])
    order = sorted(of, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(of.values()), {}, set(order)
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level > 2 * of[s]}
        if not over:
            return of, target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 2.0 * of[s]
            left -= target[s]
        open_ -= over


def test_mix(spark, docs, fixture_docs, empty):
    of, target = brute_mix(fixture_docs)
    out = mixing.mix(docs).collect()
    assert len(out) == len(fixture_docs)
    taken = defaultdict(int)
    for r in out:
        assert r["source_size"] == of[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    most = max(r["size"] for r in out)
    assert all(abs(taken[s] - target[s]) <= 2 * most for s in of)
    assert sum(taken.values()) <= 1.5 * sum(of.values()) < sum(taken.values()) + most
    assert {tuple(r) for r in mixing.digest(docs.repartition(5)).collect()} == {tuple(r) for r in mixing.digest(docs).collect()}
    assert mixing.digest(empty).count() == 0
    twice = Counter(r["doc_id"] for r in mixing.mixed(docs).collect())
    assert all(twice[r["doc_id"]] == r["taken"] // r["size"] for r in out if r["size"] and r["doc_id"] is not None and r["doc_id"] != 20)


# 9 SimHash


def brute_groups(rows):
    def print_of(text):
        w = (text or "").encode().translate(simhash.LOWER).split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [print_of(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], f"{f:016x}", least.get(root(i))) for i, (r, f) in enumerate(zip(rows, fps))]


def test_simhash_groups(spark, docs, fixture_docs, empty):
    expected = brute_groups(fixture_docs)
    assert Counter(tuple(r) for r in simhash.digest(docs).collect()) == Counter(expected)
    kept = simhash.one_per_group(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted({(e[2] is None, e[2] or 0) for e in expected})
    assert simhash.digest(empty).count() == 0 and simhash.one_per_group(empty).count() == 0


def test_simhash_on_driver_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert {tuple(r) for r in queries.op9_golay_simhash(spark, "/root/testdata/sf0.01").collect()} == set(brute_groups(rows))


def test_every_pair_within_radius_meets():
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 2000)
    other = base.copy()
    for i in range(len(other)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            other[i] ^= np.uint64(1 << int(b)).astype(np.int64)
    meets = lambda fps: {f: set(k[o].tolist()) for (k, g) in [simhash.keys(fps)] for f in fps.tolist() for o in [g == f]}
    a, b = meets(base[:300]), meets(other[:300])
    assert all(a[x] & b[y] for x, y in zip(base[:300].tolist(), other[:300].tolist()))


def test_golay_code_is_perfect():
    table = simhash.codewords()
    assert np.bincount(table, minlength=4096).tolist() == [2048] * 4096


def test_wide_buckets_and_split_batches():
    rng = np.random.default_rng(4)
    fps = np.unique(np.concatenate([rng.integers(0, 2**62, 9000), 7 ^ (1 << np.arange(20)), rng.integers(0, 2**62, 1)]))
    forest = simhash.Forest()
    simhash.spanning(fps, 4, forest)
    assert len(forest.edges()) == 19
    batches = [pd.DataFrame({"key": [1, 2, 2], "fp": [5, 1, 2]}), pd.DataFrame({"key": [2] * 12, "fp": [3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]}), pd.DataFrame({"key": [3], "fp": [99]})]
    out = next(simhash.verifier()(iter(batches)))
    assert set(out["a"]) | set(out["b"]) == set(range(1, 15)) and set(out["b"]) == {1}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(200, 260)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(map(tuple, components(df, Scratch(spark)).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {x: 100 for x in range(200, 260)}


# 10 decontamination


def brute_leaks(text, items):
    w = re.findall(r"\w+", (text or "").lower())
    out = set()
    for i, t in items:
        b = re.findall(r"\w+", (t or "").lower())
        if not b or not w:
            continue
        k, n = min(5, len(b)), min(len(b), len(w))
        if len(w) < k:
            continue
        bag = Counter(tuple(b[j : j + k]) for j in range(len(b) - k + 1))
        for s in range(len(w) - n + 1):
            mine = Counter(tuple(w[s + j : s + j + k]) for j in range(n - k + 1))
            shared = sum((mine & bag).values())
            if shared / (sum(mine.values()) + sum(bag.values()) - shared) >= 0.8:
                out.add(i)
                break
    return out


def test_decontamination(spark, docs, empty, monkeypatch):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, rng.randrange(20, 70)))) for i in range(12)] + [(50, "tiny one"), (51, None), (52, ""), (53, "Tiny ONE!")]
    rows = []
    for i in range(60):
        t = words(rng, rng.randrange(5, 200))
        if i % 3 == 0:
            copy = items[i % 12][1].split()
            for _ in range(i % 4):
                copy[rng.randrange(len(copy))] = "edited"
            at = rng.randrange(len(t))
            t[at:at] = copy
        if i % 10 == 1:
            t[2:2] = ["TINY,", "one"]
        rows.append((i, " ".join(t)))
    rows += [(70, None), (71, ""), (72, items[0][1].upper()), (72, items[0][1].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, items string"), bench).collect()
    got = sorted((r["doc_id"], tuple(r["items"]), r["contaminated"]) for r in out)
    expected = sorted((i, tuple(sorted(x := brute_leaks(t, items))), bool(x)) for i, t in rows)
    assert got == expected and sum(e[2] for e in expected) > 15
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)  # several passes over the documents
    out = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((r["doc_id"], tuple(r["items"]), r["contaminated"]) for r in out) == expected
    assert not any(r["contaminated"] for r in decontaminate.contamination(docs, bench.where("item_id > 99")).collect())
    assert decontaminate.contamination(empty, bench).count() == 0


def test_sql_texts_are_registered():
    assert set(queries.ORACLES) <= set(queries.QUERIES) and len({re.match(r"op(\d+)_", k)[1] for k in queries.QUERIES}) == 10


def test_language_sample_holds_each_text_once(spark, monkeypatch):
    """A group of copies does not fill the training sample."""
    held = []
    monkeypatch.setattr(language_id, "train", lambda texts, labels, languages: held.extend(texts))
    rows = [(i, "copied words", "en") for i in range(40)] + [(100 + i, f"own words {i}", "en") for i in range(5)] + [(200, None, "en"), (201, "text", None)]
    language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(held) == sorted([b"copied words", *[f"own words {i}".encode() for i in range(5)]])


def test_line_windows_in_long_texts(spark):
    """Many lines on either side of a covered passage are kept in order."""
    shared = ["one", "two", "three"]
    own = [[f"{d} line {i}" for i in range(3000)] for d in "ab"]
    rows = [(1, "\n".join([*shared, *own[0]]), "x"), (2, "\n".join([*own[1][:1500], *shared, *own[1][1500:]]), "y")]
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, __lines string")).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["n_removed"] == 0
    assert got[2]["text"] == "\n".join(own[1]) and (got[2]["n_lines"], got[2]["n_removed"]) == (3003, 3)
    assert got[2]["__lines"] == "y"


def test_language_sample_is_whole_beside_copies(spark, monkeypatch):
    """A group of copies does not make the share of its language's other texts smaller."""
    held = []
    monkeypatch.setattr(language_id, "train", lambda texts, labels, languages: held.extend(zip(texts, labels, strict=True)))
    copies = spark.range(40000).select(F.lit("copied words").alias("text"), F.lit("en").alias("lang"))
    own = spark.range(200).select(F.concat(F.lit("own words "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    language_id.fit(copies.unionByName(own))
    assert len(held) == 201


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "train", lambda texts, labels, languages: (labels, languages))
    rows = [(f"text {i} {k}", f"l{k:03}") for k in range(230) for i in range(2)]
    labels, languages = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert languages == [f"l{k:03}" for k in range(230)] and sorted(labels) == sorted(2 * list(range(230)))


def test_html_without_article_keeps_what_is_outside_the_largest_container():
    long = "".join(f"<p>A long sentence, number {i}, with some words and points.</p>" for i in range(17))
    page = f"<body><div class=wrap><h1>Title</h1><div class=one>{long}</div><div class=two>{long[: len(long) // 17 * 3]}</div></div></body>"
    lines = html_extract.main_text(page).split("\n")
    assert lines[0] == "Title" and sum(x.startswith("A long sentence, number 1,") for x in lines) == 2


def test_html_attributes_are_compared_whole():
    text = "A sentence with some words, and a point."
    for attribute in ('title="the hidden valley"', 'data-overflow="hidden"', 'data-testid="ad"', "title='id=ad'", "aria-label=hidden"):
        assert html_extract.main_text(f"<article><div {attribute}><p>{text}</p></div></article>") == text
    for attribute in ("hidden", 'HIDDEN=""', 'id="ad"', "x=1 class = 'nav'", 'title="a" aria-hidden="true"'):
        assert html_extract.main_text(f"<article><div {attribute}><p>other</p></div><p>{text}</p></article>") == text


ANNOTATED = """<html><body><div class=site><ul><li>Home<li>News<li>About us</ul>
<div class=wrap><h1>Tide tables</h1><div class=intro><p>Short intro.</p></div>
<div class=text><p>{0}</p><h2>Second part</h2><p>{0}</p><table><tr><td>1<td>2</table><ul><li>one item<li>two</ul></div>
<div class=tail><p>Ends here, at last, with a few more words, in all.</p></div></div><div><span>Powered by something</span></div></div></body></html>"""


def test_html_scores_decide():
    """Paths are chosen by their score: what the thresholds let in differs on a page without any telling name."""
    page = ANNOTATED.format("Long prose, with commas, and with a full stop. " * 6)
    usual = html_extract.main_text(page).split("\n")
    assert usual[0] == "Tide tables" and {"Second part", "1", "2", "one item", "two", "Ends here, at last, with a few more words, in all."} <= set(usual)
    assert not {"Home", "News", "Powered by something"} & set(usual)
    every, few = (html_extract.main_text(page, t).split("\n") for t in (-1.0, 0.95))
    assert {"Home", "Powered by something"} <= set(every) and len(few) < len(usual) < len(every)
    assert "1" not in html_extract.main_text(page, inside=0.5).split("\n")


def test_html_names_are_a_prior_only():
    text = "Good prose, of some length, with stops. " * 5
    whole = f"<h1>Title</h1><p>{text}</p>"
    bare = f"Title\n{text.strip()}"
    for page in (f"<form id=f action=x>{whole}<input></form>", f"<article><div class='ad-free'>{whole}</div></article>", f"<body><form><nav><a>Menu</a></nav><div>{whole}</div></form><footer>End, of all.</footer></body>"):
        assert html_extract.main_text(page) == bare
    assert html_extract.main_text(f"<article>{whole}<section class=related-work><h2>Earlier</h2><p>{text}</p></section></article>") == f"{bare}\nEarlier\n{text.strip()}"
    for name in ("ad", "related-posts", "comment-list", "cookie notice", "site-header", "sidebar_left", "newsletter-signup box"):
        assert html_extract.main_text(f"<div>{whole}<div class='{name}'><p>{text}</p></div></div>") == bare, name


PROSE = [
    "The river rose by two metres overnight, and the lower fields stood under water until noon. Nobody was hurt, said the council.",
    "Repairs to the bridge will take a month, according to the engineers; they had warned of this, twice, in the spring.",
    "Farmers moved their cattle to higher ground. Some barns were lost, and with them the hay of the whole season.",
    "The school opened again on Thursday, with half of its pupils. The rest came back in the week that followed.",
    "In the end the damage was less than feared, and the insurers paid, after some delay, nearly all of it.",
]
ASIDE = "<p>Read more stories from our site, and follow us, today.</p><p>All rights reserved, 2020. Contact us, please.</p>"
SHARED = {
    "classes": '<div class="col content">{0}</div><div class="col sidebar">{1}</div>',
    "ids": '<div id="content">{0}</div><div id="footer">{1}</div>',
    "class_and_id": '<div class="col" id="main">{0}</div><div class="col" id="sidebar">{1}</div>',
    "rows": '<div class="row"><div class="cell">{0}</div></div><div class="row" id="footer"><div class="cell">{1}</div></div>',
    "comment": '<article>{0}<p id="comment">Nice one, thanks.</p></article>',
    "alert": '<article>{0}<p role="alert">Please, accept this.</p></article>',
    "promo": '<article>{2}<p class="para promo">Buy this, now.</p></article>',
    "sections": '<section>{0}</section><section id="related">{1}</section>',
    "nested_comment": '<article>{0}<article class="comment"><p>' + PROSE[1] + "</p></article></article>",
    "comment_beside": '<article>{0}</article><article class="comment"><p>' + PROSE[1] + "</p></article>",
    "link_lists": '<article>{0}<ul class="menu"><li><a href=x>One</a><li><a href=y>Two</a></ul><div class="share">Share this, on all sites</div></article>',
}


@pytest.mark.parametrize("wrap", ["<html><body>{}</body></html>", "<html><body><header><a href=/>Home</a></header><div class=wrap>{}</div><footer>end, of it</footer></body></html>"])
@pytest.mark.parametrize("name", SHARED)
def test_html_boilerplate_on_the_path_of_the_article(name, wrap):
    """A block of boilerplate that shares tags and first class with the article's blocks goes alone."""
    page = SHARED[name].format("".join(f"<p>{x}</p>" for x in PROSE), ASIDE, "".join(f'<p class="para">{x}</p>' for x in PROSE))
    assert html_extract.main_text(wrap.format(page)) == "\n".join(PROSE)


def test_html_nothing_else_is_dropped():
    whole, text = "".join(f"<p>{x}</p>" for x in PROSE), "\n".join(PROSE)
    read = html_extract.main_text
    assert read(f'<div id="header"><p>Site name, slogan.</p></div><div id="content"><h1>T</h1>{whole}</div>') == f"T\n{text}"
    assert read(f'<article>{whole}<h2 class="section-header">Part two</h2>{whole}</article>') == f"{text}\nPart two\n{text}"
    for inner in ('<div class="menu">', '<div class="social">'):
        assert read(f"<article>{whole}{inner}<p>{PROSE[0]}</p></div></article>") == f"{text}\n{PROSE[0]}"
    assert read(f"<article>{whole * 6}</article><article>{whole}</article>") == "\n".join([text] * 7)
    assert read(f"<article>{whole}<p>Press the <button>Save</button> key, and <label>wait</label> for it.</p></article>") == f"{text}\nPress the Save key, and wait for it."
    assert read(f"<article>{whole}<button>Save</button><form><p>Your <label>name</label></p></form></article>") == text
    assert read(f'<article class="promo">{whole}</article>') == text


UNSEEN = """<html><body><div class=top><span>Harbour gazette</span><ul><li>Towns<li>Weather<li>Sport</ul></div><div class=shell><div class=lead><p>{0}</p></div>
<div class=copy><p>{1}</p><p>{2}</p><blockquote>{3}</blockquote><dl><dt>Depth<dd>2 m</dl></div><div class=close><p>{4}</p></div><div class=tail><span>Set in Plantin</span><span>Page 4</span></div></div></body></html>"""


def test_html_thresholds_on_a_page_they_were_not_set_on():
    page = UNSEEN.format(*PROSE)
    lines = html_extract.main_text(page).split("\n")
    assert [x for x in lines if x in PROSE] == PROSE and not {"Towns", "Harbour gazette", "Weather"} & set(lines)
    assert html_extract.main_text(page, 0.05) != html_extract.main_text(page) != html_extract.main_text(page, 0.99)


def test_html_deep_and_long_pages():
    text = "Deep prose, at the end. "
    assert html_extract.main_text("<div>x " * 50_000 + f"<p>{text * 20}</p>").endswith((text * 20).strip())
    assert html_extract.main_text("<b>" * 50_000 + text + "</i>" * 50_000) == text.strip()
    long = "".join(f"<p>{text * 3}{i}</p>" for i in range(20_000))
    assert html_extract.main_text(f"<article>{long}</article>").count("\n") == 19_999


def test_decontamination_recall_and_pruning():
    """Items edited down to a similarity of 0.8: the radius finds all but a few of what the exact search finds, and the blocks leave most windows out."""
    rng = random.Random(21)
    word = lambda: f"v{rng.randrange(4000)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(20, 121)))) for i in range(150)]
    index, every = decontaminate.Index(items), decontaminate.Index(items, radius=64)
    found = wanted = 0
    for i, text in items * 4:
        copy = text.split()
        for _ in range(rng.randrange(1, max(2, len(copy) // 40 + 1))):
            copy[rng.randrange(len(copy))] = word()
        page = " ".join([*(word() for _ in range(90)), *copy, *(word() for _ in range(90))])
        wanted += len(every.matches(page))
        found += len(index.matches(page))
    assert wanted > 200 and found >= 0.98 * wanted
    assert index.left > 0.3 * index.seen
    alone = decontaminate.Index(items)
    for _, text in items:  # only a piece of an item
        assert not alone.matches(" ".join([*(word() for _ in range(90)), *text.split()[:8], *(word() for _ in range(90))]))
    assert alone.seen > 1000 and alone.left > 0.6 * alone.seen


def test_decontamination_in_long_texts():
    rng = random.Random(22)
    items = [(i, " ".join(f"v{rng.randrange(4000)}" for _ in range(40))) for i in range(3)]
    noise = " ".join(f"v{rng.randrange(4000)}" for _ in range(200_000))
    assert decontaminate.Index(items).matches(f"{noise} {items[1][1]} {noise}") == {1: 1.0}


def test_near_values_of_blocks_miss_nothing_within_the_radius():
    rng = np.random.default_rng(6)
    items = decontaminate.Items([(i, rng.integers(0, 2**63, 30).astype(np.uint64)) for i in range(5)], decontaminate.RADIUS)
    for _ in range(3000):
        flips = sum(1 << int(b) for b in rng.choice(64, decontaminate.RADIUS, replace=False))
        k = rng.integers(5)
        item, which, *_ = items.near(np.array([items.prints[k] ^ np.uint64(flips)]))
        assert k in item and set(which) == {0}


def test_block_postings_equal_a_scan_of_all_items(monkeypatch):
    """Within the radius the index finds what comparing with every item finds, over steps of any size, with few candidates."""
    rng = np.random.default_rng(7)
    items = decontaminate.Items([(i, rng.integers(0, 2**63, 30).astype(np.uint64)) for i in range(2000)], decontaminate.RADIUS)
    near = items.prints[rng.integers(0, 2000, 300)]
    for _ in range(9):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    prints = np.concatenate([near, rng.integers(0, 2**63, 200).astype(np.uint64)])
    i, w = np.nonzero(np.bitwise_count(items.prints[:, None] ^ prints) <= decontaminate.RADIUS)
    assert len(i) >= 300
    for pairs in (1, 1 << 12, 1 << 22):
        monkeypatch.setattr(decontaminate, "PAIRS", pairs)
        item, which, compared, _ = items.near(prints)
        assert item.tolist() == i.tolist() and which.tolist() == w.tolist()
        assert compared < 0.12 * 2000 * len(prints)
    assert [len(x) for x in items.near(np.zeros(0, dtype=np.uint64))[:2]] == [0, 0]


@pytest.mark.parametrize(("common", "share"), [(6, 0.08), (12, 0.25)])
def test_many_items_of_one_length(common, share):
    """Candidates, not items, are compared with a window; the more words all items have in common, the closer their fingerprints and the more candidates."""
    rng = random.Random(31)
    shared = [f"s{i}" for i in range(common)]
    items = [(i, " ".join([f"w{rng.randrange(50_000)}" for _ in range(40 - common)] + shared)) for i in range(4000)]
    index = decontaminate.Index(items)
    page = " ".join(" ".join([*shared, *(f"n{rng.randrange(9000)}" for _ in range(60))]) for _ in range(20))
    assert index.matches(f"{page} {items[77][1]} {page}") == {77: 1.0}
    assert index.seen > 1000 and index.compared < share * index.seen * len(items)


def test_passes_over_many_items(spark, monkeypatch):
    """More items than one pass takes, a repeated row among them, and a column with the name that holds a pass's result."""
    rng = random.Random(32)
    items = [(i, " ".join(words(rng, 30))) for i in range(40)]
    bench = spark.createDataFrame(items + [items[3]] * 50, "item_id long, text string")
    frame = spark.createDataFrame([(i, f"{' '.join(words(rng, 40))} {items[i][1]}", "old") for i in range(40)], "doc_id long, text string, __found string")
    once = sorted((r["doc_id"], tuple(r["items"]), r["__found"]) for r in decontaminate.contamination(frame, bench).collect())
    monkeypatch.setattr(decontaminate, "MOST_ITEMS", 16)
    assert sorted((r["doc_id"], tuple(r["items"]), r["__found"]) for r in decontaminate.contamination(frame, bench).collect()) == once
    assert all(i in found and old == "old" for i, found, old in once)


def test_language_gradient_equals_slopes():
    """Backpropagation through time against central differences of the loss, in double precision."""
    rng = np.random.default_rng(1)
    weights = [rng.standard_normal(s) * 0.4 for s in ((2, 256, 6), (2, 3, 6), (6, 3), (3,))]
    pieces, y = rng.choice(np.frombuffer(b"abc 1", dtype=np.uint8), (9, 4)), np.array([0, 2, 1, 2])

    def loss():
        ahead, back = (language_id._run(p, weights[0][d], weights[1][d]) for d, p in enumerate((pieces, pieces[::-1])))
        p = language_id._softmax(np.concatenate([ahead, back[::-1]], axis=2) @ weights[2] + weights[3])
        mask = language_id.LETTER[pieces]
        return -(np.log(p[:, np.arange(4), y]) * mask).sum() / mask.sum()

    for w, g in zip(weights, language_id.gradients(weights, pieces, y), strict=True):
        for at in [i for i in np.ndindex(w.shape) if w.ndim < 3 or w.shape[1] < 256 or i[1] in b"ab1z"]:
            was = w[at]
            w[at] = was + 1e-5
            up = loss()
            w[at] = was - 1e-5
            slope = (up - loss()) / 2e-5
            w[at] = was
            assert abs(slope - g[at]) < 1e-7


@pytest.mark.parametrize("piece", [401, 700, 4096])
def test_contexts_do_not_depend_on_the_piece(monkeypatch, piece):
    """Every window start keeps its anchor hash where a text is read in pieces."""
    rng = random.Random(piece)
    for size in (399, 400, piece, piece + 399, piece + 400, 3 * piece + 17):
        text = bytes(rng.choice(b"abcd") for _ in range(size))

        def anchors():
            hs, starts, ends = run_index.contexts(text)
            return {at: h for h, lo, hi in zip(hs, starts, ends) for at in range(lo, hi + 1)}

        whole = anchors()
        with monkeypatch.context() as m:
            m.setattr(run_index, "PIECE", piece)
            assert anchors() == whole
        assert sorted(whole) == list(range(size - 399))


def test_repeats_across_the_seam_of_a_long_text(spark):
    """A text longer than a piece: a passage over the seam, and again near the start and in another document."""
    rng, seam = random.Random(2), run_index.PIECE
    filler = rng.randbytes((seam + 9000) // 2).hex()
    passage = "G" + rng.randbytes(299).hex() + "H"
    long = filler[:1000] + passage + filler[1000 : seam - 1000] + passage + "-" + filler[seam - 1000 :]
    assert long.index(passage, 2000) < seam < long.index(passage, 2000) + len(passage)
    other = "x" * 50 + passage + "y" * 50
    got = {r["doc_id"]: r for r in run_index.digest(spark.createDataFrame([(1, long), (2, other), (3, passage[:399])], "doc_id long, text string")).collect()}
    assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) for i in (1, 2, 3)] == [(len(long), 1200, 2), (700, 600, 1), (399, 0, 0)]
    assert got[1]["kept_sha256"] == hashlib.sha256(long.replace(passage, "").encode()).hexdigest()


def test_long_texts(spark, docs, fixture_docs):
    """Some megabytes in one text count whole in sharding, mixing, fingerprints and language."""
    text = " ".join(words(random.Random(8), 400_000))
    rows = [*fixture_docs, [900, text, "en", "s1", 1], [901, text + " end", "en", "s1", 1]]
    more = spark.createDataFrame(rows, DOCS)
    sized = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in sharding.digest(more).collect()}
    assert sized[900] == (len(text) + 16, zlib.crc32(text.encode()))
    mixed = {r["doc_id"]: r["size"] for r in mixing.digest(more).collect()}
    assert (mixed[900], mixed[901]) == (400_000, 400_001)
    prints = {r["doc_id"]: r for r in simhash.digest(more.where("doc_id >= 900")).collect()}
    alone = brute_groups([r for r in rows if (r[0] or 0) >= 900])
    assert Counter(tuple(r) for r in prints.values()) == Counter(alone) and prints[901]["component_id"] == 900
    named = {r["doc_id"]: r["lang_pred"] for r in language_id.digest(more).collect()}
    assert named[900] in ("en", "de") and named[900] == named[901]


def test_clashing_columns_change_nothing(spark, docs):
    names = ["size", "source_size", "target", "taken", "shard", "slot", "law", "text_crc32", "fingerprint", "component_id", "lang_pred", "score", "held_out", "n_bytes", "tid", "h", "k", "key", "n"]
    more = docs.withColumns({n: F.lit("other") for n in names})
    for digest in (language_id.digest, mixing.digest, simhash.digest, run_index.digest):
        assert Counter(tuple(r) for r in digest(more).collect()) == Counter(tuple(r) for r in digest(docs).collect()), digest.__module__
    plain = lambda d: Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in sharding.digest(d).collect())
    assert plain(more) == plain(docs)
