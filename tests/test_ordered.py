"""Ranks, running values and order statistics over ranges, against plain Python; the as-of join of labels and gaps."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from elsetspark.operators import calibrate, labels, ordered


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", "b"]), float(rng.choice([1, 2, 2, 2, 3]) if rng.random() < 0.4 else rng.gauss(0, 50)), i) for i in range(6000)]
    rows += [("one", 7.0, 9001), ("same", 5.0, 9002), ("same", 5.0, 9003), ("two", 1.0, 9004), ("two", 4.0, 9005)]
    return rows, spark.createDataFrame(rows, "g string, value double, id long").repartition(6)


@pytest.mark.parametrize("most", [10, 200, 10**6])
def test_order_statistics(values, most):
    """Also where brackets stay too wide and are narrowed again, and where ties fill them."""
    rows, df = values
    by = defaultdict(list)
    for g, v, _ in rows:
        by[g].append(v)
    at = {"q1": lambda n: F.floor(0.25 * (n - 1)), "median": lambda n: F.floor(0.5 * (n - 1)), "first": lambda n: F.lit(0), "last": lambda n: n - 1, "past": lambda n: n}
    got = {(r["g"], r["name"]): (r["low"], r["high"], r["n"]) for r in ordered.order_statistics(df, ["g"], at, most).collect()}
    assert len(got) == 5 * len(by)
    for g, v in by.items():
        v.sort()
        for name, k in (("q1", int(0.25 * (len(v) - 1))), ("median", int(0.5 * (len(v) - 1))), ("first", 0), ("last", len(v) - 1)):
            assert got[g, name] == (v[k], v[min(k + 1, len(v) - 1)], len(v)), (g, name)
        assert got[g, "past"] == (None, None, len(v))


@pytest.mark.parametrize("most", [1000, 10**6])
def test_column_statistics_equal_single_ones(values, spark, most):
    """Columns side by side, with nulls, ties and a column without values: what order_statistics gives of each; no value outside a bracket becomes a row."""
    _, df = values
    wide = ordered.kept(df.select("g", "value", F.when(F.col("id") % 3 > 0, -F.col("value")).alias("part"), F.lit(None).cast("double").alias("none"), F.lit(2.0).alias("flat")))
    at = {"q1": lambda n: F.floor(0.25 * (n - 1)), "q3": lambda n: F.floor(0.75 * (n - 1))}
    got = {(r["channel"], r["g"], r["name"]): (r["n"], r["low"], r["high"]) for r in ordered.column_statistics(wide, "g", ["value", "part", "none", "flat"], at, most).collect()}
    for c in ("value", "part", "flat"):
        for r in ordered.order_statistics(wide.select("g", F.col(c).alias("value")), ["g"], at, most).collect():
            assert got[c, r["g"], r["name"]] == (r["n"], r["low"], r["high"])
    assert {v for k, v in got.items() if k[0] == "none"} == {(0, None, None)}


def test_order_statistics_of_nothing(spark):
    empty = spark.createDataFrame([("a", None)], "g string, value double")
    assert ordered.order_statistics(empty, ["g"], {"x": lambda n: F.lit(0)}).count() == 0


def test_numbered(values, spark):
    rows, df = values
    out = ordered.numbered(df, ["g"], [F.col("value").desc(), F.col("id").asc()], {"total": ("sum", F.col("id")), "top": ("max", F.col("id"))})
    got = {r["id"]: (r["rank"], r["total"], r["top"]) for r in out.collect()}
    assert out.columns == ["g", "value", "id", "rank", "total", "top"] and len(got) == len(rows)
    for g in {r[0] for r in rows}:
        seen: list[int] = []
        for k, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))):
            assert got[i] == (k + 1, sum(seen) if seen else None, max(seen) if seen else None)
            seen.append(i)


def test_ranks_are_dealt_to_ranges_not_classes(values, spark):
    """A class of most rows is in several partitions: the window's key holds the range."""
    _, df = values
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ordered.numbered(df, ["g"], [F.col("value").asc(), F.col("id").asc()])
        assert "hashpartitioning(__part" in out._jdf.queryExecution().executedPlan().toString()
        held = spark.read.parquet(out.inputFiles()[0].rsplit("/", 1)[0]).groupBy(F.shiftright("__at", 33).alias("part"), "g").count().collect()
        assert len([r for r in held if r["g"] == "hot"]) >= 3 and max(r["count"] for r in held) < df.count() / 2
        placed = ordered.numbered(df, [], [F.col("id").asc()])
        assert sorted(r["rank"] for r in placed.collect()) == list(range(1, df.count() + 1))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_conformal_quantile_by_ranges(spark):
    rows = [("LEO", i / 1000, i % 2) for i in range(1000)] + [("GEO", 0.5, 1)] * 3
    got = {r["orbit_class"]: (r["q"], r["n"]) for r in calibrate.conformal_quantile(spark.createDataFrame(rows, "orbit_class string, confidence double, outcome int")).collect()}
    scores = sorted(1 - p if y else p for _, p, y in rows[:1000])
    assert got["LEO"] == (pytest.approx(scores[901 - 1]), 1000) and got["GEO"] == (1.0, 3)


def test_label_gaps_as_of(spark):
    """Gap starts count as inside, ends as outside; labels before, at and after the series' end have none; columns stay."""
    series = spark.createDataFrame([(1, t) for t in (10, 20, 20, 40)] + [(2, 5), (None, 1), (None, 9)], "norad_id long, t long")
    asked = [(1, 9), (1, 10), (1, 19), (1, 20), (1, 39), (1, 40), (1, 50), (2, 5), (3, 5), (None, 5), (1, None)]
    rows = spark.createDataFrame([(i, n, e, "x") for i, (n, e) in enumerate(asked)], "label_id long, norad_id long, epoch long, t0x string")
    got = {r["label_id"]: (r["t0"], r["t1"], r["tol_start"], r["tol_end"]) for r in labels.map_to_gaps(rows, series).collect()}
    assert got == {1: (10, 20, 10, 20), 2: (10, 20, 10, 20), 3: (20, 40, 20, 40), 4: (20, 40, 20, 40)}
    joined = labels.map_to_gaps(rows, series)
    assert joined.columns == [*rows.columns, "t0", "t1", "tol_start", "tol_end"]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # as many rows as labels and gaps together, in one order
