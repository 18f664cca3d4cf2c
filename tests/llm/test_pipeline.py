"""The pipeline: stages keep the columns, decisions take effect, clean documents stay."""

import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from elsetspark.llm import mixing, near_copies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, f in corpus_pipeline.STAGES:
        last, docs = docs, f(spark, docs, sf).cache()
        out.append((last, docs))
    return out


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "mix_sources", "shard"]


def test_columns(stages):
    for last, docs in stages[:-1]:
        assert docs.columns == last.columns
    assert stages[-1][1].columns == [*stages[-1][0].columns, "shard", "slot"]


def test_decisions(stages):
    ids = [[r[0] for r in d.select("doc_id").collect()] for _, d in stages]
    first = {r[0] for r in stages[0][0].select("doc_id").collect()}
    assert set(ids[0]) <= first and len(first - set(ids[0])) <= 0.02 * len(first)
    assert set(ids[1]) < set(ids[0]) and len(ids[1]) == len(set(ids[1]))
    assert set(ids[2]) < set(ids[1])
    assert set(ids[3]) <= set(ids[2])
    assert sorted(ids[4]) == sorted(ids[3])


def test_mix_has_its_budget(stages):
    before, after = stages[3]
    total = lambda d: d.select(mixing.words().alias("n")).groupBy().sum("n").first()[0]
    assert abs(total(after) - 1.5 * total(before)) < 0.05 * total(before)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_in_every_column(spark, tmp_path):
    rows = [(None, None, None, None, None)] * 2 + [(1, "some words here that stay", None, None, None), (2, "", "en", "s", 0), (None, "other words of some text", "en", None, 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["text"] for r in out} <= {"some words here that stay", "other words of some text"}


@pytest.mark.parametrize("dense", [0, 4, 10**6])
def test_near_copies_against_brute_force(spark, monkeypatch, dense):
    """Groups are those of all pairs of five-word shingle sets with similarity 0.8 or more, in few and in many sets a shingle."""
    monkeypatch.setattr(near_copies, "DENSE", dense)
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    base, passage, rows = fresh(200), fresh(40), []
    for i in range(60):  # about 0.75 to 0.95 from the base, and so among themselves at times
        near = list(base)
        for _ in range(rng.randrange(1, 8)):
            near[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(near)))
    for i in range(60, 110):
        rows.append((i, " ".join([*fresh(rng.randrange(1, 60)), *passage, *fresh(rng.randrange(1, 30))])))
    for i in range(110, 150):
        near = rows[i - 90][1].split()
        at = rng.randrange(len(near))
        rows.append((i, " ".join([*near[:at], "inserted", *near[at:]])))
    rows += [(200, None), (201, ""), (202, "two words"), (203, "TWO  words"), (204, "other two"), (None, "two words"), (202, "two words")]
    sets = [near_copies.shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(set(a.tolist()) & set(b.tolist()))
            if both * 5 >= 4 * (len(a) + len(b) - both):
                root = [root[j] if r == root[i] else r for r in root]
    groups = defaultdict(list)
    for (i, _), r in zip(rows, root, strict=True):
        groups[r].append(float("inf") if i is None else i)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in near_copies.one_per_group(docs).collect())
    assert got == sorted(min(g) for g in groups.values())
    assert 5 < len(got) < 130


def test_prefixes_of_sets_alike_meet():
    rng = np.random.default_rng(4)
    for n in range(1, 80):
        own = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for k in range(len(own)):
            other = np.unique(np.concatenate([own[k:], rng.integers(0, 2**63, rng.integers(0, 9)).astype(np.uint64)]))
            common = np.sort(rng.choice(own, len(own) // 2, replace=False))
            often = rng.integers(1, 9, len(common))
            if near_copies.alike(own, other):
                assert set(near_copies.prefix(own, common, often).tolist()) & set(near_copies.prefix(other, common, often).tolist())


def test_sketches_never_rule_out_sets_alike():
    rng = np.random.default_rng(5)
    ruled_out = 0
    for n in [*range(0, 40), 100, 500, 513, 3000]:
        own = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for part in (0.0, 0.05, 0.1, 0.12, 0.2, 0.5, 1.0):
            k = int(part * len(own))
            other = np.unique(np.concatenate([own[k:], rng.integers(0, 2**63, int(rng.integers(0, k + 1))).astype(np.uint64)]))
            may = near_copies.may_be_alike(len(own), near_copies.sketch(own), len(other), near_copies.sketch(other))
            assert may or not near_copies.alike(own, other)
            ruled_out += not may
    assert ruled_out > 60


def test_sketches_of_a_shingle_agree_with_pairs():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 140).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(140) > rng.choice([0.05, 0.2])], rng.integers(0, 2**63, int(rng.integers(0, 30))).astype(np.uint64)])) for _ in range(60)]
    n, drawn = np.array([len(x) for x in sets]), [near_copies.sketch(x) for x in sets]
    assert len({len(x) for x in drawn}) > 1
    own = near_copies.Sketches(n, drawn)
    for i in range(60):
        j = np.array([k for k in range(60) if k != i])
        assert set(own.may(i, j).tolist()) == {k for k in j.tolist() if near_copies.may_be_alike(n[i], drawn[i], n[k], drawn[k])}


def test_bridges_join_what_is_alike():
    """Sets of one shingle, in groups: the links join the groups as all pairs of sets alike would."""
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 2**63, 100).astype(np.uint64))
    sets = []
    for _ in range(40):
        own = base[rng.random(len(base)) > rng.choice([0.02, 0.1, 0.15, 0.4])]
        sets.append(np.unique(np.concatenate([own, rng.integers(0, 2**63, int(rng.integers(0, 12))).astype(np.uint64)])))
    short = [near_copies.lengthened(near_copies.shortened(x)) for x in sets]
    assert all((a == b >> np.uint64(24)).all() for a, b in zip(short, sets, strict=True))
    n, pos = np.array([len(x) for x in sets]), np.zeros(40, dtype=np.int64)

    def groups(links, root):
        root = list(root)
        for i, j in links:
            root = [root[i] if x == root[j] else x for x in root]
        return [[a == b for b in root] for a in root]

    for start in (np.arange(40), np.arange(40) // 8 * 8):
        every = [(i, j) for i in range(40) for j in range(i) if near_copies.alike(sets[i], sets[j])]
        got = near_copies.bridges(n, pos, start, short)
        assert groups(got, start) == groups(every, start) and 0 < len(got) < 40
