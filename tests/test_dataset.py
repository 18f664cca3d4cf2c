"""The dataset job: canonical digests, windows of the recipe, derived labels, artifacts, verification, commands."""

import hashlib
import json
from datetime import UTC, datetime, timedelta

import pytest

from elsetspark import cli
from elsetspark.operators import dataset
from elsetspark.operators.series import SIGNATURE
from elsetspark.sources import documents

DAY, T0 = 86_400_000_000, 1_704_067_200_000_000  # 2024-01-01
AWKWARD = (1e-5, 1e-4, 1e16, 123456789.123, 0.1 + 0.2, -0.0, 5e-324, 1e22, 2.0**-44, 0.001)
LABELS = "label_id long, norad_id long, epoch long, window_start long, window_end long, maneuver_type string, delta_v double, orbit_class string, source string, source_ref string"


def plain_digest(rows):
    """By the definition, in one piece: rows of (norad_id, t, *values)."""
    at = lambda us: (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=us)).isoformat()
    text = json.dumps([{"norad_id": i, "epoch": at(t), **dict(zip(SIGNATURE, v, strict=True))} for i, t, *v in sorted(rows)], separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, *v) for i, t, *v in rows], "norad_id long, t long, element_set_no long, " + ", ".join(f"{c} double" for c in SIGNATURE))


def elset(norad, t, n=15.0, e=0.001, i=66.0):
    return (norad, t, n, e, i, 10.0, 90.0, 10.0, 1e-4, 0.0, 0.0)


def test_digest_equals_plain_python(spark):
    rows = [(i, T0 + k * 1_234_567, *[AWKWARD[(i + k + j) % len(AWKWARD)] for j in range(9)]) for i in (1, 2, 3) for k in range(50)]
    want = sorted((i, 50, plain_digest([r for r in rows if r[0] == i])) for i in (1, 2, 3))
    df = frame(spark, rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in ("7", "50", before):  # objects begin, end and go on at the seams of batches
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            assert sorted(map(tuple, dataset.series_digests(df.repartition(3)).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert dataset.series_digests(df.where("norad_id = 9")).count() == 0


def test_digest_of_nulls_and_one_exchange(spark):
    df = frame(spark, [(None, T0, *[1.0] * 9), (4, T0, *[None] * 9)])
    got = {r["norad_id"]: r["sha256"] for r in dataset.series_digests(df).collect()}
    assert got == {None: plain_digest([(None, T0, *[1.0] * 9)]), 4: plain_digest([(4, T0, *[None] * 9)])}
    plan = dataset.series_digests(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def entries(spark, rows):
    named = "norad_id long, orbit_class string, object_name string, catalogue_source string, label_source string, label_ref string, start string, end string"
    return spark.createDataFrame([(i, kind, f"object {i}", "spacetrack", source, "", lo, hi) for i, kind, source, lo, hi in rows], named)


def test_windows_bound_series_and_labels(spark):
    rows = [elset(i, T0 + k * DAY) for i in (1, 2) for k in range(20)]
    told = spark.createDataFrame([(k, 1, T0 + k * 2 * DAY + 5, T0, T0, "in-track", None, "LEO", "s", "r") for k in range(10)] + [(99, 2, T0 + 30 * DAY, T0, T0, None, None, "LEO", "s", "r"), (98, None, T0, T0, T0, None, None, "LEO", "s", "r"), (97, 7, T0, T0, T0, None, None, "LEO", "s", "r")], LABELS)
    recipe = entries(spark, [(1, "LEO", "s", "2024-01-05", "2024-01-10T00:00:00Z"), (2, "LEO", "s", None, None), (3, "LEO", "s", None, None)])
    got = dataset.rebuild(recipe, frame(spark, rows), told, "1")
    assert sorted((r["norad_id"], (r["t"] - T0) // DAY) for r in got.series.collect()) == [(1, k) for k in range(4, 10)] + [(2, k) for k in range(20)]
    assert sorted((r["label_id"], (r["t0"] - T0) // DAY) for r in got.intervals.collect()) == [(2, 4), (3, 6), (4, 8)]
    assert [r["label_id"] for r in got.unmatched.collect()] == [99]
    digests = {r["norad_id"]: (r["n_elsets"], r["sha256"]) for r in got.digests.collect()}
    assert digests == {1: (6, plain_digest(rows[4:10])), 2: (20, plain_digest(rows[20:])), 3: (0, hashlib.sha256(b"[]").hexdigest())}


@pytest.mark.parametrize(("lo", "hi", "said"), [("2024-02-01", "2024-01-01", "after end"), ("soon", None, "no time")])
def test_bounds_that_make_no_sense_raise(spark, lo, hi, said):
    with pytest.raises(Exception, match=said):
        dataset.bounded(entries(spark, [(1, "LEO", "s", lo, hi)])).collect()


def test_objects_that_label_themselves(spark):
    """An inclination step of a geosynchronous object is a derived label in the middle of its gap; announced labels of it do not count."""
    rows = [elset(5, T0 + k * DAY, 1.0027, 0.0002, 0.05 + 0.0001 * (k % 2) - (0.04 if k >= 15 else 0.0)) for k in range(30)]
    told = spark.createDataFrame([(1, 5, T0 + DAY + 5, T0, T0, None, None, "GEO", "s", "r")], LABELS)
    got = dataset.rebuild(entries(spark, [(5, "GEO", "SELF-GEO", None, None)]), frame(spark, rows), told, "1").labels.collect()
    assert [(r["epoch"], r["maneuver_type"], r["source"], r["source_ref"], r["label_id"]) for r in got] == [(T0 + 14 * DAY + DAY // 2, "cross-track", "SELF-GEO", "longitude-shift gap 2024-01-15..2024-01-16", None)]
    outside = entries(spark, [(5, "GEO", "SELF-GEO", None, "2024-01-15T00:00:00")])
    assert dataset.rebuild(outside, frame(spark, rows), told, "1").labels.count() == 0


def record(norad_id, day, n=15.0):
    return {"NORAD_CAT_ID": str(norad_id), "EPOCH": f"2024-01-{day:02d}T00:00:00.000000", "MEAN_MOTION": str(n), "ECCENTRICITY": "0.001", "INCLINATION": "66.0", "RA_OF_ASC_NODE": "10.0", "ARG_OF_PERICENTER": "90.0", "MEAN_ANOMALY": "10.0", "BSTAR": "0.0001", "MEAN_MOTION_DOT": "0.0", "MEAN_MOTION_DDOT": "0.0", "ELEMENT_SET_NO": "999", "EPHEMERIS_TYPE": "0"}


def land(folder, norad_id, **more):
    at = folder / f"norad_id={norad_id}"
    at.mkdir(parents=True, exist_ok=True)
    (at / "part-0.txt").write_text(json.dumps([record(norad_id, d, **more) for d in range(1, 21)]) + "\n")


def test_commands_build_and_verify(spark, tmp_path, capsys):
    answers, out, recipe = tmp_path / "answers", tmp_path / "out", tmp_path / "recipe.json"
    for i in (5, 9):
        land(answers, i)
    documents.write_recipe(entries(spark, [(9, "LEO", "s", None, None), (5, "LEO", "s", None, "2024-01-10")]), "1", str(recipe))
    common = ["--recipe", str(recipe), "--landed", str(answers)]
    assert cli.main(["dataset", "build", *common, "--version", "1", "--out", str(out)]) == 0
    assert capsys.readouterr().out.splitlines()[:2] == [f"2 objects in {out}", "events in all: 0"]
    manifest = json.loads((out / "manifest.json").read_text())
    assert manifest["dataset_version"] == "1" and [(d["norad_id"], d["n_elsets"]) for d in manifest["digests"]] == [(5, 10), (9, 20)]
    assert manifest["digests"][0]["sha256"] == plain_digest([elset(5, T0 + k * DAY) for k in range(10)])
    assert (out / "recipe.json").read_text() == recipe.read_text() and json.loads((out / "labels.json").read_text()) == []
    again = ["dataset", "verify", str(out / "manifest.json"), *common]
    assert cli.main([*again, "--version", "1"]) == 0
    assert "that of the manifest" in capsys.readouterr().out
    land(answers, 9, n=15.5)
    assert cli.main([*again, "--version", "2"]) == 1
    assert capsys.readouterr().err.strip() == "error: version 1 became 2; object 9: hash"


def test_models_command(capsys):
    assert cli.main(["models"]) == 0 and "classical" in capsys.readouterr().out.split()
