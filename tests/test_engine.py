"""The engine against its definitions: synthetic series, the golden scoring scenario, parsers, plans and SQL oracles."""

import datetime
import json
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from elsetspark import available_models, detect, get_detector, register_detector
from elsetspark.cli import main as cli
from elsetspark.constants import ORBIT_CLASSES
from elsetspark.functions import physics
from elsetspark.functions.sgp4 import sane_at_epoch
from elsetspark.functions.stats import bin_of
from elsetspark.operators import bench, calibrate, evaluate, features, labels, learned, partition, series
from elsetspark.operators.detect import detect_rule, prepared
from elsetspark.plans import QUERIES, SQL
from elsetspark.sources import catalogue, documents, fetch, landed, notices, omm, tle

SF = "/root/testdata/sf0.001"
DAY = 86_400_000_000
START = 1_704_067_200_000_000
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(round(r[i], 5) + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in SQL:
        rel = duck.sql(SQL[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert norm(rows, df.columns) == norm(rel.fetchall(), list(rel.columns))
    else:
        assert rows


def synthetic(seed, n=120, burns=(), noise=1.0, a0=6778.0, e0=0.001, i0=66.0, norad=1):
    """Drift, wobble and noise with impulses at true anomaly 0.7 (component, m/s) from a gap on."""
    rng, mu, j2, re = np.random.default_rng(seed), 398600.8, 1.082616e-3, 6378.135
    d = np.arange(n, dtype=float)
    rate = math.sqrt(mu / a0**3)
    k = rate * j2 * (re / (a0 * (1 - e0**2))) ** 2 * 86400
    c = math.cos(math.radians(i0))
    draw = lambda s: rng.normal(0, s * noise, n)
    a = a0 - 0.002 * d + draw(0.006)
    e = e0 + 1e-4 * np.sin(0.3 * d) * noise + draw(1e-5)
    i = i0 + 5e-3 * np.sin(0.2 * d) * noise + draw(3e-4)
    o = 30 + np.degrees(-1.5 * k * c) * d + draw(3e-4)
    w = 90 + np.degrees(0.75 * k * (5 * c * c - 1)) * d + draw(1e-2)
    for gap, kind, dv in burns:
        s, p, nu = math.sqrt(1 - e0**2), a0 * (1 - e0**2), 0.7
        r = p / (1 + e0 * math.cos(nu))
        if kind == "in-track":
            a[gap:] += 2 / (rate * s) * p / r * dv * 1e-3
            e[gap:] += s / (rate * a0) * (math.cos(nu) + (e0 + math.cos(nu)) / (1 + e0 * math.cos(nu))) * dv * 1e-3
        else:
            u, h = nu + math.radians(90), math.sqrt(mu * p)
            i[gap:] += np.degrees(r * math.cos(u) / h * dv * 1e-3)
            o[gap:] += np.degrees(r * math.sin(u) / (h * math.sin(math.radians(i0))) * dv * 1e-3)
    return [(norad, START + int(x) * DAY, float(a[x]), float(e[x]), float(i[x]), float(o[x] % 360), float(w[x] % 360)) for x in range(n)]


COLUMNS = "norad_id long, t long, a double, e double, inc double, raan double, argp double"


def test_synthetic_positives_and_negatives(spark):
    plans = {1: [(60, "in-track", 2.0)], 2: [(60, "cross-track", 3.0)], 3: [(40, "in-track", 2.5), (90, "cross-track", 3.0)], 4: [], 5: [], 6: []}
    rows = [r for k, b in plans.items() for r in synthetic(k, n=130, burns=b, norad=k)]
    rows += synthetic(8, norad=7)[:8]
    rows += [(1, START + DAY * 200, float("nan"), 0.001, 66.0, 30.0, 90.0)]
    spike = [list(r) for r in synthetic(9, norad=8)]
    spike[60][2] += 0.3
    out = detect_rule(spark.createDataFrame(rows + [tuple(r) for r in spike], COLUMNS)).collect()
    got = {(r["norad_id"], r["type"], (r["t_after"] - START) // DAY) for r in out}
    assert got == {(k, kind, gap) for k, b in plans.items() for gap, kind, _ in b}
    for r in out:
        true = next(dv for gap, kind, dv in plans[r["norad_id"]] if kind == r["type"])
        assert r["delta_v_estimate"] == pytest.approx(true, rel=0.25) and r["confidence"] > 0.5
        assert r["epoch_ns"] == (r["t_before"] + r["t_after"]) * 500


def test_rule_edges(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert detect_rule(empty).count() == 0 and "delta_v_estimate" in detect_rule(empty).columns
    ramp = [(1, START + x * DAY, 6778.0, 0.001, 66.0, float(50 * x % 360), 90.0) for x in range(80)]
    assert detect_rule(spark.createDataFrame(ramp, COLUMNS)).count() == 0
    with pytest.raises(ValueError):
        prepared(empty.drop("raan"))


def test_series_plan_has_one_exchange(spark):
    df = series.scaled(series.local_steps(prepared(spark.createDataFrame(synthetic(1), COLUMNS))))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_rule_detector_scans_once(spark, tmp_path):
    spark.createDataFrame(synthetic(1), COLUMNS).write.parquet(f"{tmp_path}/s")
    df = detect_rule(spark.read.parquet(f"{tmp_path}/s"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan parquet") == 1 and "Python" not in plan and "Pandas" not in plan


# Golden scoring scenario


def at(day, hour=0):
    return START + (day - 1) * DAY + hour * 3_600_000_000


def golden(spark):
    lab = [(1, 11111, 3, "in-track", 0.5, True), (2, 11111, 6, "cross-track", 0.3, True), (3, 11111, 9, "in-track", 0.001, False), (4, 11111, 13, "radial", 0.4, True), (5, 22222, 4, None, None, True)]
    labs = spark.createDataFrame([(i, n, at(g, 12), at(g - 1), at(g + 2), t, dv, f) for i, n, g, t, dv, f in lab], "label_id long, norad_id long, epoch long, tol_start long, tol_end long, maneuver_type string, delta_v double, above_floor boolean")
    det = [(1, 11111, 3, 0.9, "in-track"), (2, 11111, 21, 0.7, "in-track"), (3, 11111, 6, 0.6, "in-track"), (4, 11111, 9, 0.5, "in-track"), (5, 22222, 4, 0.6, "cross-track"), (6, 33333, 2, 0.55, "radial")]
    dets = spark.createDataFrame([(i, n, at(d, 12), c, t) for i, n, d, c, t in det], "det_id long, norad_id long, epoch long, confidence double, type string")
    expo = spark.createDataFrame([(11111, "LEO", 2.0), (22222, "MEO", 1.0), (33333, "GEO", 0.5)], "norad_id long, orbit_class string, observation_years double")
    return dets, labs, expo


def test_golden_report(spark):
    dets, labs, expo = golden(spark)
    scored = bench.outcomes(dets, labs, bench.match(dets, labs), expo)
    got = bench.report(scored, labs, expo)
    leo = got["LEO"]
    assert (leo["n_detections"], leo["n_above"], leo["n_total"]) == (4, 3, 4)
    assert [p["recall"] for p in leo["pr_curve"]] == [1 / 3, 2 / 3, 2 / 3] and [p["precision"] for p in leo["pr_curve"]] == [1.0, 2 / 3, 2 / 3]
    assert leo["recall_ci"] == pytest.approx([0.20765960080204782, 0.9385080552796038], abs=1e-14)
    assert leo["pr_curve"][0]["recall_ci"] == pytest.approx([0.06149194472039632, 0.7923403991979523], abs=1e-14)
    assert leo["full_population_recall"] == 0.75 and leo["operating_point_confidence"] == 0.5
    assert leo["confusion"]["in-track"]["in-track"] == 1 and leo["confusion"]["cross-track"]["in-track"] == 1
    assert got["MEO"]["recall"] == 1.0 and got["MEO"]["recall_ci"][0] == pytest.approx(0.20654931437723745, abs=1e-14) and got["MEO"]["operating_point_confidence"] == 0.6
    assert got["GEO"]["recall"] is None and [p["precision"] for p in got["GEO"]["pr_curve"]] == [None, None, 0.0]
    assert list(got) == list(ORBIT_CLASSES) and got["HEO"]["n_detections"] == 0
    assert json.loads(bench.to_json(got))["LEO"]["confusion"]["radial"] == {"in-track": 0, "cross-track": 0, "radial": 0}
    with pytest.raises(Exception, match="scored population"):
        bench.outcomes(dets, labs, bench.match(dets, labs), expo.where("norad_id <> 33333")).collect()


def test_match_is_nearest_and_one_to_one(spark):
    labs = spark.createDataFrame([(1, 1, 100, 0, 200), (2, 1, 110, 0, 200), (3, None, 100, 0, 200)], "label_id long, norad_id long, epoch long, tol_start long, tol_end long")
    dets = spark.createDataFrame([(1, 1, 105, 0.9), (2, 1, 105, 0.8), (3, 1, 200, 0.7), (4, 1, 201, 0.95), (5, 2, 100, 0.9)], "det_id long, norad_id long, epoch long, confidence double")
    assert {tuple(r) for r in bench.match(dets, labs).collect()} == {(1, 1), (2, 2), (3, None), (4, None), (5, None)}


def test_label_gaps(spark):
    rows = spark.createDataFrame([(1, at(d, 12)) for d in range(1, 7)], "norad_id long, t long")
    labs = spark.createDataFrame([(1, 1, at(3, 18)), (2, 1, at(2, 12)), (3, 1, at(1)), (4, 1, at(6, 12)), (5, 1, at(7))], "label_id long, norad_id long, epoch long")
    got = {r["label_id"]: ((r["t0"] - START) / DAY, (r["tol_start"] - START) / DAY, (r["tol_end"] - START) / DAY) for r in labels.map_to_gaps(labs, rows).collect()}
    assert got == {1: (2.5, 1.5, 4.5), 2: (1.5, 0.5, 3.5)}
    assert {r["label_id"] for r in labels.unmatched(labs, rows).collect()} == {3, 4, 5}


def test_derived_labels(spark):
    n0 = 86400 / 86164.0905
    geo = [(1, START + d * DAY, n0 + (0.02 if d < 6 else -0.02) / 360, 0.05 + 0.0002 * d) for d in range(12)] + [(2, START + d * DAY, n0 + 0.02 / 360, 0.05 + 0.0002 * d - (0.04 if d >= 6 else 0)) for d in range(12)] + [(3, START + d * DAY, n0 + 0.02 / 360, 0.05) for d in range(12)] + [(4, START, n0, 0.05), (4, START + DAY, -n0, 0.01)]
    got = {(r["norad_id"], r["maneuver_type"], (r["window_end"] - START) // DAY) for r in labels.derive_geo(spark.createDataFrame(geo, "norad_id long, t long, mean_motion double, inc double")).collect()}
    assert got == {(1, "in-track", 6), (2, "cross-track", 6)}
    heo = [(1, START + d * DAY, 65000.0 + (5 if d >= 20 else 0), 0.7) for d in range(40)] + [(2, START + d * DAY, 65000.0, 0.7 + (0.001 if d >= 20 else 0)) for d in range(40)]
    got = {(r["norad_id"], r["maneuver_type"]) for r in labels.derive_heo(spark.createDataFrame(heo, "norad_id long, t long, a double, e double")).collect()}
    assert got == {(1, "in-track"), (2, "radial")}


def test_channel_smear(spark):
    rows = [(1, START + d * DAY, 7000 - 0.002 * d + (5.0 if d >= 40 else 0.0), 0.001, 66.0, float(5 * d % 360), 90.0) for d in range(80)]
    out = {r["idx"]: r for r in features.channels(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert out[40]["dlt_a"] == pytest.approx(5 * 20 / 21, abs=1e-6) and out[35]["dlt_a"] == pytest.approx(-5 / 21, abs=1e-6)
    assert abs(out[20]["dlt_a"]) < 1e-6 and abs(out[20]["res_raan"]) < 1e-6
    assert len(features.CHANNELS) == 32


def test_channels_over_small_batches(spark):
    """Residuals and their changes equal the windows' whatever the batches; one exchange, and no sliding fit in the plan."""
    rows = [r for k in range(1, 5) for r in synthetic(k, n=7 * k * k, norad=k)] + [(9, START, 6778.0 + k, 0.001, 66.0, 5.0, 90.0) for k in range(4)]
    enc = features.levels(spark.createDataFrame(rows, COLUMNS).coalesce(1))
    lined = enc.withColumn("res", F.col("lvl_a") - series.local_trend(enc, "lvl_a")).select("norad_id", "idx", "lvl_a", "res")
    want = {(r["norad_id"], r["idx"]): r["res"] for r in lined.collect() if r["norad_id"] < 9}
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("3", "25", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            found = features.channels(spark.createDataFrame(rows, COLUMNS))
            got = {(r["norad_id"], r["idx"]): r for r in found.collect()}
            assert len(got) == len(rows)
            for (k, i), x in want.items():
                assert abs(got[k, i]["res_a"] - x) < 1e-8 and abs(got[k, i]["dlt_a"] - (x - want[k, i - 1] if i else 0.0)) < 1e-8
            assert sorted(got[9, i]["res_a"] for i in range(4)) == pytest.approx([-1.5, -0.5, 0.5, 1.5])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "regr_" not in plan


def test_rounding_half_away_from_zero(spark):
    from elsetspark.plans.queries import rounded

    rows = [(0.5,), (-2.5,), (-0.2,), (1e300,), (float("inf"),), (None,), (12.4999,)]
    got = [r[0] for r in rounded(spark.createDataFrame(rows, "x double").coalesce(1), 0).collect()]
    assert got == [1.0, -3.0, 0.0, 1e300, float("inf"), None, 12.0] and str(got[2]) == "0.0"


def test_standardise(spark):
    enc = features.channels(spark.createDataFrame([r for k in (1, 2) for r in synthetic(k, norad=k)], COLUMNS))
    q = features.class_quartiles(enc)
    out = features.standardise(enc, q)
    assert abs(out.agg(F.percentile("lvl_a", 0.5)).first()[0]) < 1e-5
    with pytest.raises(Exception, match="no scaler"):
        features.standardise(enc, q.where("orbit_class = 'GEO'")).collect()


# Calibration


def test_bins_follow_edges(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 0.3, 0.1 * 3, 0.6, 0.7, 0.9999, 1.0)], "p double")
    assert [r[0] for r in rows.select(bin_of(F.col("p"))).collect()] == [int(np.clip(np.digitize(x, np.linspace(0, 1, 11)[1:-1]), 0, 9)) for x in (0.0, 0.3, 0.1 * 3, 0.6, 0.7, 0.9999, 1.0)]


def test_temperature_helps_or_stays(spark):
    rng = np.random.default_rng(0)
    p = rng.uniform(0.05, 0.95, 4000)
    y = rng.uniform(size=4000) < p
    hot = 1 / (1 + np.exp(-1.6 * np.log(p / (1 - p))))
    df = spark.createDataFrame([(float(a), int(b), "LEO") for a, b in zip(hot, y)], "confidence double, outcome int, orbit_class string")
    assert calibrate.fit_temperature(df) == pytest.approx(1.6, rel=0.1)
    got = evaluate.calibration_bundle(df)
    assert got["ece_pooled"] < got["ece_raw"] and got["temperature"] > 1.4 and set(got["ece"]) == {"LEO"}
    curve = got["reliability"]["LEO"]
    assert [b["lo"] for b in curve] == [i / 10 for i in range(10)] and sum(b["count"] for b in curve) == 4000
    assert json.loads(json.dumps(got)) == got
    table = calibrate.reliability_table(curve).splitlines()
    assert len(table) == 2 + sum(b["count"] > 0 for b in curve) and table[2].startswith("| [0.")
    assert calibrate.reliability_table([b | {"count": 0} for b in curve]) == "_(no binned detections)_"
    cooled = evaluate.calibrated(lambda rows: rows, got)(df).first()["confidence"]
    assert cooled == pytest.approx(1 / (1 + math.exp(-math.log(hot[0] / (1 - hot[0])) / got["temperature"])))
    # One pooled quantile: the score of rank ceil((n + 1) 0.9) over all confidences as they came.
    scores = np.sort(np.where(y, 1 - hot, hot))
    assert got["conformal_q"] == pytest.approx(scores[math.ceil(4001 * 0.9) - 1])
    fine = spark.createDataFrame([(float(a), int(b), "LEO") for a, b in zip(p, y)], "confidence double, outcome int, orbit_class string")
    same = evaluate.calibration_bundle(fine)
    assert same["ece_pooled"] <= same["ece_raw"]
    with pytest.raises(ValueError):
        evaluate.calibration_bundle(df.limit(0))
    with pytest.raises(Exception, match="outside"):
        calibrate.guarded(df.withColumn("confidence", F.lit(1.5))).collect()


# Sources

ISS = ("1 25544U 98067A   24001.50000000  .00001234  00000-0  12345-4 0  9990", "2 25544  51.6400 208.9000 0001234 120.0000 240.0000 15.50000000 12345")


def pair(one, two):
    add = lambda s: s[:68] + str(sum(int(c) if c.isdigit() else c == "-" for c in s[:68]) % 10)
    return add(one.ljust(68)), add(two.ljust(68))


def test_tle_files(spark, tmp_path):
    one, two = pair(*ISS)
    (tmp_path / "a.tle").write_text(f"ISS (ZARYA)\n{one}\n{two}\n{one}\n{two}\n")
    rows = tle.parse(tle.read_files(spark, str(tmp_path / "a.tle"))).collect()
    assert len(rows) == 2
    r = rows[0]
    assert (r["norad_id"], r["eccentricity"], r["mean_motion"], r["object_id"], r["classification"]) == (25544, 0.0001234, 15.5, "1998-067A", "U")
    assert r["bstar"] == pytest.approx(1.2345e-5) and r["t"] == START + DAY // 2
    (tmp_path / "b.tle").write_text(f"{one}\n{one}\n{two}\n")
    with pytest.raises(Exception, match="orphan"):
        tle.read_files(spark, str(tmp_path / "b.tle")).collect()
    bad = spark.createDataFrame([(one[:68] + "x", two), (one[:30], two), (one, two.replace("25544", "25545"))], "line1 string, line2 string")
    assert tle.parse(bad, strict=False).count() == 0
    with pytest.raises(Exception, match="malformed"):
        tle.parse(bad).collect()


def test_omm(spark):
    base = {"NORAD_CAT_ID": "25544", "EPOCH": "2024-01-01T12:00:00", "MEAN_MOTION": 15.5, "ECCENTRICITY": 0.0001, "INCLINATION": 51.64, "RA_OF_ASC_NODE": 90, "ARG_OF_PERICENTER": 80, "MEAN_ANOMALY": 270, "BSTAR": 1.8e-4, "MEAN_MOTION_DOT": 1e-4, "MEAN_MOTION_DDOT": 0}
    spellings = ["2024-01-01T12:00:00", "2024-01-01 12:00:00", "2024-01-01T12:00:00Z", "2024-01-01T12:00:00.000000"]
    rows = omm.parse_payload(spark.createDataFrame([(json.dumps([base | {"EPOCH": s} for s in spellings]),)], "value string")).collect()
    assert {r["t"] for r in rows} == {START + DAY // 2} and {(r["element_set_no"], r["classification"], r["object_id"]) for r in rows} == {(0, "U", "")}
    for broken in ({"NORAD_CAT_ID": "1.5"}, {"BSTAR": None}, {"EPOCH": "yesterday"}):
        with pytest.raises(Exception, match="malformed"):
            omm.parse_payload(spark.createDataFrame([(json.dumps([base | broken]),)], "value string")).collect()
    with pytest.raises(Exception, match="array"):
        omm.parse_payload(spark.createDataFrame([('{"a": 1}',)], "value string")).collect()


def test_notice_rollover_and_errors(spark):
    text = "NANU TYPE: FCSTDV\nNANU NUMBER: 2023100\nNANU DTG: 281530Z DEC 2023\nSVN: 65\nPRN: 1\nSTART JDAY: 364\nSTART TIME ZULU: 2200\nSTOP JDAY: 002\nSTOP TIME ZULU: 1000\n"
    r = notices.nanu(spark.createDataFrame([(text + text.replace("FCSTDV", "UNUSABLE"),)], "text string")).collect()
    assert len(r) == 1 and r[0]["code"] == "SVN65" and r[0]["window_end"] == START + DAY + 10 * 3_600_000_000
    with pytest.raises(Exception, match="SVN"):
        notices.nanu(spark.createDataFrame([(text.replace("SVN: 65\n", ""),)], "text string")).collect()
    with pytest.raises(Exception, match="truncated"):
        notices.doris(spark.createDataFrame([("JASO2 2018 1 10 0 2018 1 11 0 006 2 2018 1 10 0",)], "text string")).collect()


def test_documents_round_trip(spark, tmp_path):
    rows = [(at(3, 12), 0.9, "in-track", None, 1, at(3), at(4)), (at(4, 12), 0.5, "radial", 0.25, 1, at(4), at(5))]
    df = spark.createDataFrame(rows, "epoch long, confidence double, type string, delta_v_estimate double, norad_id long, t_before long, t_after long")
    path = f"{tmp_path}/p.json"
    documents.write_predictions(df, path)
    assert [tuple(r) for r in documents.read_predictions(spark, path).orderBy("epoch").collect()] == rows
    doc = json.loads(open(path).read())
    open(path, "w").write(json.dumps([doc[0] | {"extra": 1}]))
    with pytest.raises(Exception, match="unknown"):
        documents.read_predictions(spark, path).collect()


def test_sane_elements():
    n, e, i, m = np.array([15.4916, 20.0, 15.0, 1.0027]), np.array([0.0005881, 0.001, 0.9999, 0.0002]), np.array([51.6, 51.6, 51.6, 2.0]), np.array([187.7, 0.0, 0.0, 10.0])
    assert sane_at_epoch(n, e, i, m).tolist() == [True, False, False, True]


# Splits, manifest, board, registry, command line


def test_splits():
    weights = [(k, 1 + k % 5) for k in range(40)]
    a = bench.pack_splits(weights, seed=3)
    assert a == bench.pack_splits(weights[::-1], seed=3) and set(a.values()) == {"train", "val", "test"}
    total = sum(n for _, n in weights)
    assert abs(sum(n for k, n in weights if a[k] == "train") / total - 0.7) < 0.05


def test_temporal_split(spark):
    rows = [(k, "LEO", e, 3) for k in range(30) for e in range(3) if (k + e) % 4]
    got = evaluate.temporal_split(spark.createDataFrame(rows, "norad_id long, orbit_class string, era int, n int"))
    assert len(got) == 30 and all(any(r[0] == k and ("train", "val", "test")[r[2]] == s for r in rows) for k, s in got.items())


def test_temporal_split_follows_what_is_placed(spark):
    """The first object of a class finds no deficit and goes to the earliest era it has; the next goes to the emptiest one."""
    rows = [(1, "LEO", 0, 9), (1, "LEO", 2, 1), (2, "LEO", 0, 4), (2, "LEO", 2, 4)]
    got = evaluate.temporal_split(spark.createDataFrame(rows, "norad_id long, orbit_class string, era int, n int"))
    assert got == {1: "train", 2: "test"}


def test_era_cuts_need_objects_and_two_times(spark):
    rows = spark.createDataFrame([(1, 10), (1, 20), (None, 1), (None, 2)], "norad_id long, epoch long")
    assert bench.era_cuts(rows, (0.0, 0.5)) == (10, 20)
    with pytest.raises(ValueError):
        bench.era_cuts(rows.where("norad_id is null"))
    with pytest.raises(ValueError):
        bench.era_cuts(rows.where("epoch <= 10"))


def test_stratified_split_balances_classes():
    found = [(k, {"LEO": 4}) for k in range(20)] + [(100 + k, {"GEO": 1}) for k in range(20)]
    got = bench.pack_stratified(found, seed=1)
    assert got == bench.pack_stratified(found[::-1], seed=1)
    for base in (0, 100):
        held = [sum(got[base + k] == s for k in range(20)) for s in ("train", "val", "test")]
        assert held == [14, 3, 3]


def test_learned_detector_inverts_at_peaks(spark):
    """A scorer that knows the gap: the step of a burn comes back as its velocity change."""
    rows = spark.createDataFrame(synthetic(5, burns=[(60, "in-track", 0.5)], noise=0.1), "norad_id long, t long, a double, e double, inc double, raan double, argp double")
    encoded = features.channels(rows)
    known = lambda tokens: tokens.select("norad_id", "idx", F.when(F.col("idx").isin(60, 61), 1 - F.abs(F.col("idx") - 60) / 10).otherwise(0.0).alias("p"))
    got = learned.detect_learned(rows, features.class_quartiles(encoded), known).collect()
    assert [(r["t_before"], r["t_after"], r["type"], r["confidence"]) for r in got] == [(START + 59 * DAY, START + 60 * DAY, "in-track", 1.0)]
    assert abs(got[0]["delta_v_estimate"] - 0.5) < 0.03


def test_steps_near_the_ends(spark):
    rows = learned.aligned_elements(features.channels(spark.createDataFrame(synthetic(6, n=12), "norad_id long, t long, a double, e double, inc double, raan double, argp double")))
    own = [r["a"] for r in rows.orderBy("idx").collect()]
    got = {r["idx"]: r for r in learned.around(rows, rows.where("idx > 0").select("norad_id", "idx")).collect()}
    assert [got[k]["width"] for k in range(1, 12)] == [1, 2, 3, 4, 4, 4, 4, 4, 3, 2, 1]
    for k, r in got.items():
        w, x = r["width"], np.arange(12.0)
        fit = lambda lo, hi: np.polyval(np.polyfit(x[lo:hi] - k, own[lo:hi], 1), -0.5)  # noqa: B023, E731
        assert abs(r["step_a"] - (own[k] - own[k - 1] if w < 2 else fit(k, k + w) - fit(k - w, k))) < 1e-6
        assert abs(r["ref_a"] - np.median(own[max(0, k - 4) : k])) < 1e-9


def test_steps_around_every_gap_take_one_exchange(spark, tmp_path):
    """No row is copied for the gaps near it, nor joined; chosen gaps get what they get among all, equal times a mean."""
    rows = [r for k in (1, 2) for r in synthetic(k, n=30, norad=k)] + [(3, START, 6778.0, 0.001, 66.0, 5.0 * d, 90.0) for d in range(9)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/s")
    lined = learned.aligned_elements(features.levels(spark.read.parquet(f"{tmp_path}/s")))
    every = learned.around(lined)
    got = {(r["norad_id"], r["idx"]): r for r in every.collect()}
    plan = every._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan and "Join" not in plan
    assert len(got) == 29 + 29 + 8
    some = lined.where("idx % 5 = 0").select("norad_id", "idx")
    chosen = [r for r in learned.around(lined, some).collect() if r["norad_id"] < 3]
    assert len(chosen) == 10 and all(r == got[r["norad_id"], r["idx"]] for r in chosen)
    assert {got[3, k]["step_a"] for k in range(1, 9)} == {0.0}


def test_targets_and_weight(spark):
    tokens = spark.createDataFrame([(1, 10, 0), (1, 20, 1), (1, 30, 2)], "norad_id long, t long, idx int")
    gaps = spark.createDataFrame([(1, 20), (1, 20), (1, 25)], "norad_id long, t1 long")
    marked = partition.token_targets(tokens, gaps)
    assert sorted((r["idx"], r["target"]) for r in marked.collect()) == [(0, 0.0), (1, 1.0), (2, 0.0)]
    assert [r["t1"] for r in partition.unaligned(tokens, gaps).collect()] == [25]
    assert partition.positive_weight(marked).first()[0] == 2.0
    assert partition.positive_weight(marked.where("target = 0")).first()[0] == 1.0


def test_manifest(spark):
    s = spark.createDataFrame([(k, at(d), float(d)) for k in (1, 2) for d in (3, 1, 2)], "norad_id long, t long, a double")
    d = evaluate.digests(s)
    assert {tuple(r) for r in d.collect()} == {tuple(r) for r in evaluate.digests(s.repartition(5)).collect()}
    changed = evaluate.digests(s.where("not (norad_id = 2 and a = 3)"))
    assert [tuple(r) for r in bench.manifest_verify(d, changed).collect()] == [(2, "hash")]


def test_board():
    board, report = evaluate.Board(), {"LEO": {"recall": 0.5, "n_above": 2}, "GEO": {"recall": None, "n_above": 0}}
    assert board.submit("u", "one", "2024-01-01", report) == 1
    with pytest.raises(ValueError):
        board.submit("u", "bad", "2024-01-01", {"GEO": report["GEO"]})
    assert [board.submit("u", f"n{k}", "2024-01-01", report | {"LEO": {"recall": 0.5 + k / 10, "n_above": 2}}) for k in range(1, 5)] == [1] * 4
    with pytest.raises(PermissionError):
        board.submit("u", "six", "2024-01-01", report)


def test_registry(spark):
    assert available_models() == ["bilstm-base", "chronos-residual", "classical", "drift-residual", "transformer-base"]
    with pytest.raises(ValueError):
        register_detector("classical", lambda x: x)
    with pytest.raises(ValueError):
        get_detector("nope")
    with pytest.raises(RuntimeError):
        detect(None, "bilstm-base")


def test_command_line(spark, tmp_path, capsys):
    lines = []
    for d in range(20):
        lines += pair(ISS[0].replace("24001.50000000", f"24{d + 1:03d}.50000000"), ISS[1])
    (tmp_path / "x.tle").write_text("\n".join(lines) + "\n")
    assert cli(["detect", str(tmp_path / "x.tle"), "--format", "csv"]) == 0
    assert capsys.readouterr().out == "epoch,norad_id,type,confidence,delta_v_estimate\n"
    assert cli(["detect", str(tmp_path / "none.tle")]) == 1
    with pytest.raises(SystemExit) as e:
        cli(["detect"])
    assert e.value.code == 2


def test_streaming_jumps(spark, tmp_path):
    from elsetspark.streaming.provisional import provisional_jumps

    rows = [(1, START + d * DAY, 7000.0 + 0.001 * (d % 3) + (5.0 if d == 15 else 0)) for d in range(16)]
    spark.createDataFrame(rows, "norad_id long, t long, a double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("norad_id long, t long, a double").parquet(f"{tmp_path}/in")
    q = provisional_jumps(stream).writeStream.format("memory").queryName("jumps").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["norad_id"], (r["t"] - START) // DAY) for r in spark.sql("select * from jumps").collect()] == [(1, 15)]


def test_entry_imports_without_training_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['elsetspark.llm'] = None; import __spark_entry__ as e; assert 'detect_rule' in e.queries() and 'pipeline' not in e.queries()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_times_are_utc():
    assert documents.iso(START) == datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc).isoformat()


# Guards, cleaning, windows, tuning


def test_exposure_guards(spark):
    dets, labs, expo = golden(spark)
    scored = bench.outcomes(dets, labs, bench.match(dets, labs), expo)
    with pytest.raises(Exception, match="duplicate exposure for object 11111"):
        bench.class_counts(scored, labs, expo.union(expo.where("norad_id = 11111"))).collect()
    with pytest.raises(Exception, match="duplicate exposure for object 22222"):
        bench.outcomes(dets, labs, bench.match(dets, labs), expo.union(expo.where("norad_id = 22222"))).collect()
    stray = labs.union(labs.where("label_id = 1").withColumn("norad_id", F.lit(99999).cast("long")))
    with pytest.raises(Exception, match="label outside the scored population: 99999"):
        bench.class_counts(scored, stray, expo).collect()
    free = labs.union(labs.where("label_id = 1").withColumn("norad_id", F.lit(None).cast("long")))
    assert sorted(map(str, bench.class_counts(scored, free, expo).collect())) == sorted(map(str, bench.class_counts(scored, labs, expo).collect()))


def test_cleaning_drops_what_cannot_be_propagated(spark):
    names = "mean_motion eccentricity inclination raan arg_perigee mean_anomaly bstar mean_motion_dot mean_motion_ddot".split()
    rows = [(1, 10, 1, 15.5, 0.001, 51.6), (1, 10, 2, 18.0, 0.001, 51.6), (1, 20, 1, 15.5, 1.2, 51.6), (1, 30, 1, 2.0, 0.9, 63.0), (1, 40, 1, 1.0027, 0.0002, 0.05), (1, 50, 1, float("nan"), 0.0, 1.0)]
    df = spark.createDataFrame([(i, t, k, *([n, e, inc] + [0.0] * 6)) for i, t, k, n, e, inc in rows], "norad_id long, t long, element_set_no long, " + ", ".join(f"{c} double" for c in names))
    got = evaluate.reconstruct(df).orderBy("t").select("t", "element_set_no").collect()
    assert [tuple(r) for r in got] == [(10, 1), (40, 1)]  # the decayed re-fit of the first epoch does not win


def test_windows_are_padded(spark):
    rows = [(1, 100 + k, k, "LEO", float(k + 1), 0.0 if k == 2 else 1.0) for k in range(70)] + [(2, 100 + k, k, "GEO", 9.0, 1.0) for k in range(3)]
    df = spark.createDataFrame(rows, "norad_id long, t long, idx int, orbit_class string, x double, elset_valid double")
    got = {(r["norad_id"], r["window_id"], r["position"]): r for r in features.padded_windows(df).collect()}
    assert len(got) == 64 * (3 + 1) == features.padded_windows(df).count()
    for (norad, w, p), r in got.items():
        k, n = 32 * w + p, 70 if norad == 1 else 3
        if k < n:
            assert (r["idx"], r["t"], r["valid"]) == (k, 100 + k, norad == 2 or k != 2)
        else:
            assert (r["idx"], r["t"], r["x"], r["valid"]) == (None, None, 0.0, False)
    assert features.padded_windows(df.where("norad_id = 9")).count() == 0
    with pytest.raises(ValueError):
        features.padded_windows(df, 4, 5)


def test_tuning_by_recall(spark):
    dets, labs, expo = golden(spark)
    found = {t: dets.where(F.col("confidence") >= t) for t in (0.4, 0.6, 0.95)}
    points = evaluate.recalls(found, labs, expo)
    got = {(r["threshold"], r["orbit_class"]): r["recall"] for r in points.collect()}
    assert got[0.4, "LEO"] == got[0.6, "LEO"] == 2 / 3 and got[0.95, "LEO"] == 0 and got[0.6, "MEO"] == 1 and got[0.4, "GEO"] is None
    assert evaluate.tune(points) == ({"threshold": 0.4, "value": 0.75}, {"LEO": 0.4, "MEO": 0.4})
    best, _ = evaluate.tune(points.where("threshold > 0.5"), "macro")
    assert best["threshold"] == 0.6 and abs(best["value"] - 5 / 6) < 1e-12
    with pytest.raises(ValueError):
        evaluate.objective(points, "other")
    with pytest.raises(ValueError):
        evaluate.recalls({}, labs, expo)


def test_board_starts_with_seeds_and_tells_aggregates_only():
    board, report = evaluate.Board(per_day=1, timing_floor={"LEO": 0.4}), {"LEO": {"recall": 0.5, "n_above": 2, "confusion": {}}, "GEO": {"recall": None, "n_above": 0}}
    assert [board.seed(f"base {k}", "2024-01-01", {"LEO": {"recall": k / 10, "n_above": 2}}) for k in (3, 7)] == [1, 1]
    assert board.submit("u", "mine", "2024-01-01", report) == 2
    with pytest.raises(PermissionError):
        board.submit("u", "more", "2024-01-01", report)
    assert [(r["name"], r["seed"]) for r in board.rows()] == [("base 7", True), ("mine", False), ("base 3", True)]
    assert board.public_result(report) == {"operating_point_fa_per_sat_year": 1.0, "headline_recall_above_floor": {"LEO": 0.5, "GEO": None}, "timing_only_floor_auc": {"LEO": 0.4}}


def test_board_place_is_that_of_the_submission():
    board, report = evaluate.Board(), {"LEO": {"recall": 0.5, "n_above": 2}}
    assert board.submit("u", "same", "2024-01-01", report) == 1
    assert board.submit("u", "same", "2024-01-02", {"LEO": {"recall": 0.1, "n_above": 2}}) == 2


def test_holt_is_linear_in_an_object(spark):
    """One object of 60,000 rows, against the plain recursion."""
    rng = np.random.default_rng(3)
    x, t = rng.normal(7000, 1, 60_000), np.cumsum(rng.uniform(0, 1, 60_000))
    df = spark.createDataFrame([(1, k, float(a), float(b)) for k, (a, b) in enumerate(zip(t, x))], "norad_id long, idx int, t_days double, a double").repartition(3)
    got = [r["level_a"] for r in series.holt(df, ("a",)).orderBy("idx").select("level_a").collect()]
    dt = max(t[1] - t[0], series.DT_FLOOR_DAYS)
    level, trend = x[0], (x[1] - x[0]) / dt
    for k in range(1, len(x)):
        dt = max(t[k] - t[k - 1], series.DT_FLOOR_DAYS)
        now = series.ALPHA * x[k] + (1 - series.ALPHA) * (level + trend * dt)
        trend, level = series.BETA * (now - level) / dt + (1 - series.BETA) * trend, now
        assert abs(got[k] - level) < 1e-6


def test_located_inversion_recovers_the_impulse(spark):
    given = [(0.003, -0.002, 0.7, 0.2), (-0.001, 0.004, 2.0, 0.01), (0.002, 0.0, 1.0, 0.0)]
    rows = spark.createDataFrame(given, "radial double, along double, nu double, e double")
    zero, a = F.lit(0.0), F.lit(7000.0)
    step = physics.gauss_forward(F.col("radial"), F.col("along"), zero, F.col("nu"), a, F.col("e"), F.lit(1.0), zero)
    got = rows.select(*[v.alias(k) for k, v in physics.invert(step["da"], step["de"], zero, zero, a, F.col("e"), F.lit(1.0), zero, F.col("nu")).items()]).collect()
    for (radial, along, *_), r in zip(given, got):
        assert (r["radial_ms"], r["in_track_ms"]) == pytest.approx((abs(radial) * 1e3, along * 1e3), abs=1e-6)
    # At perigee of a circle a radial impulse changes neither element: the estimate without a place is taken.
    flat = spark.range(1).select(*[v.alias(k) for k, v in physics.invert(F.lit(1.0), zero, zero, zero, a, zero, F.lit(1.0), zero, zero).items()]).first()
    assert flat["radial_ms"] == 0 and flat["in_track_ms"] > 0


@pytest.mark.parametrize("a, e, i, ok", [(7000.0, 0.0, 0.0, True), (7000.0, 0.5, math.pi, True), (0.0, 0.0, 1.0, False), (7000.0, 1.0, 1.0, False), (7000.0, -0.1, 1.0, False), (7000.0, 0.1, 3.2, False)])
def test_orbits_outside_their_range_are_errors(spark, a, e, i, ok):
    row = spark.createDataFrame([(a, e, i)], "a double, e double, i double").select(physics.orbit(F.col("a"), F.col("e"), F.col("i"), F.lit(0.0)).alias("o"))
    if ok:
        assert row.first()["o"]["p"] == pytest.approx(a * (1 - e * e))
    else:
        with pytest.raises(Exception, match="out of range"):
            row.collect()


def test_fetch_result_bounds_and_order(spark):
    rows = spark.createDataFrame([(1, 30), (1, 10), (2, 20), (1, None)], "norad_id long, t long")
    got = lambda lo, hi: [(r["norad_id"], r["t"], r["stale"]) for r in fetch.result(rows, "x", F.lit(5), lo, hi).coalesce(1).collect()]
    assert sorted(got(10, 20)) == [(1, 10, False), (2, 20, False)]
    assert sorted(got(None, 10)) == [(1, 10, False)]
    assert [t for n, t, _ in got(None, None) if n == 1] == [None, 10, 30]


def test_coverage_lines_without_labels(spark):
    empty = spark.createDataFrame([], "orbit_class string, delta_v double, norad_id long, source string")
    lines = [r["line"] for r in labels.coverage_lines(labels.coverage(empty)).orderBy("place").collect()]
    assert lines[0] == "events in all: 0" and len(lines) == 6 and lines[1] == "LEO 0, velocity change known for 0, object known for 0, no source"


def test_residual_detector(spark):
    rows = synthetic(0, burns=[(60, "in-track", 8.0)], norad=1) + synthetic(3, norad=2)
    got = detect(spark.createDataFrame(rows, COLUMNS), "drift-residual").where("confidence > 0.95").collect()
    hit = [r for r in got if r["norad_id"] == 1 and r["t_after"] == START + 60 * DAY]
    assert len(hit) == 1 and hit[0]["type"] == "in-track" and hit[0]["delta_v_estimate"] == pytest.approx(8.0, rel=0.3)
    assert hit[0]["epoch_ns"] == (hit[0]["t_before"] + hit[0]["t_after"]) * 500
    strict = learned.detect_residual(spark.createDataFrame(rows, COLUMNS), {"LEO": 1e9}).collect()
    assert strict == []
    short = learned.detect_residual(spark.createDataFrame(rows[:1], COLUMNS))
    assert short.collect() == [] and short.columns == learned.detect_residual(spark.createDataFrame(rows, COLUMNS)).columns


def test_recipe_and_crosswalks(spark):
    rows = catalogue.recipe(spark).collect()
    assert len(rows) == 92 and [r["norad_id"] for r in rows] == sorted({r["norad_id"] for r in rows})
    assert {r["orbit_class"] for r in rows} == {"LEO", "MEO", "GEO", "IGSO"}
    assert {r["code"]: r["norad_id"] for r in catalogue.crosswalk_of(spark, "NOAA-GOES").collect()}["GOES-16"] == 41866
    with pytest.raises(ValueError):
        catalogue.crosswalk_of(spark, "SELF-GEO")


def test_landed_archives(spark, tmp_path):
    """Files of three sources; unresolved objects go, snapshots count once, and the documents read back."""
    (tmp_path / "nagu").mkdir()
    for seq, gsat in ((1, "GSAT0101"), (2, "GSAT9999")):
        (tmp_path / "nagu" / f"{seq}.txt").write_text(f"NAGU TYPE: PLN_MANV\nNAGU NUMBER: {seq}\nSTART DATE EVENT (UTC): 2023-05-0{seq} 10:20\nEND DATE EVENT (UTC): 2023-05-0{seq} 11:00\nSATELLITE AFFECTED: {gsat}\n")
    snap = "Spacecraft : GOES-16\n last maneuver on 23/{}\n=====\nSpacecraft : GOES-1\n last maneuver on 23/7\n"
    goes = spark.createDataFrame([(snap.format(5),), (snap.format(5),), (snap.format(9),)], "text string")
    got = landed.all_labels({"GALILEO-NAGU": landed.files(spark, f"{tmp_path}/nagu"), "NOAA-GOES": goes})
    assert [(r["source"], r["norad_id"], r["orbit_class"], r["source_ref"]) for r in got.collect()] == [("GALILEO-NAGU", 37846, "MEO", "1"), ("NOAA-GOES", 41866, "GEO", "GOES-16"), ("NOAA-GOES", 41866, "GEO", "GOES-16")]
    documents.write_labels(got, f"{tmp_path}/labels.json")
    assert documents.read_labels(spark, f"{tmp_path}/labels.json").select(*got.columns).collect() == got.collect()
    for bad in ({}, {"SELF-GEO": goes}):
        with pytest.raises(ValueError):
            landed.all_labels(bad)
    with pytest.raises(ValueError):
        landed.labels("nope", goes)


def test_sequence_ends_after_a_run_of_misses(spark):
    found = [(2023, s) for s in (1, 2, 27, 28, 54, 55)] + [(2024, 26)] + [(2025, 25)]
    got = landed.in_sequence(spark.createDataFrame(found, "year int, seq int")).collect()
    brute = []
    for year in (2023, 2024, 2025):
        seq, misses = 0, 0
        while misses < 25:
            seq += 1
            misses = 0 if (year, seq) in found else misses + 1
            brute += [(year, seq)] if (year, seq) in found else []
    assert sorted(tuple(r) for r in got) == brute == [(2023, 1), (2023, 2), (2023, 27), (2023, 28), (2025, 25)]


def test_dataset_documents(spark, tmp_path):
    entries = catalogue.recipe(spark)
    documents.write_recipe(entries, catalogue.VERSION, f"{tmp_path}/r.json")
    back = documents.read_recipe(spark, f"{tmp_path}/r.json")
    assert back.drop("start", "end").collect() == entries.drop("code").collect()
    split = spark.createDataFrame([(3, "train"), (1, "val"), (2, "train")], "norad_id long, split string")
    documents.write_splits(split, "1", f"{tmp_path}/s.json", seed=0)
    assert sorted(map(tuple, documents.read_splits(spark, f"{tmp_path}/s.json").collect())) == [(1, "val"), (2, "train"), (3, "train")]
    labs = spark.createDataFrame([(7, 1, START, START - 5, START + 5, START - 9, START + 9, "radial", None, "s", "LEO", True)], "label_id long, norad_id long, epoch long, t0 long, t1 long, tol_start long, tol_end long, maneuver_type string, delta_v double, source string, orbit_class string, above_floor boolean")
    years = spark.createDataFrame([(1, "LEO", 2.5)], "norad_id long, orbit_class string, observation_years double")
    documents.write_fixture(labs, years, {"LEO": 0.5}, "1", f"{tmp_path}/f.json")
    first = open(f"{tmp_path}/f.json").read()
    labs2, years2, floor = documents.read_fixture(spark, f"{tmp_path}/f.json")
    assert floor == {"LEO": 0.5} and years2.collect() == years.collect()
    same = [c for c in labs.columns if c != "label_id"]
    assert labs2.select(*same).collect() == labs.select(*same).collect()
    documents.write_fixture(labs2, years2, floor, "1", f"{tmp_path}/f.json")
    assert open(f"{tmp_path}/f.json").read() == first


def test_summaries(spark):
    dets, labs, expo = golden(spark)
    doc = bench.report(bench.outcomes(dets, labs, bench.match(dets, labs), expo), labs, expo)
    assert bench.headline(doc) == {c: doc[c]["recall"] for c in ORBIT_CLASSES}
    lines = bench.summary(doc).splitlines()
    assert lines[0] == "at 1 false alarms a satellite and year, intervals of 95%" and lines[1].split()[0] == "class" and len(lines) == 7
    assert lines[2].split()[0] == "LEO" and lines[2].split()[3:7] == ["66.7", "20.8", "to", "93.9"] and "0.0 to 100.0" in lines[4]


def test_scaler_document(spark):
    q = spark.createDataFrame([("LEO", "lvl_a", 1.5, 0.25), ("MEO", "res_e", -1.0, 1e-12)], "orbit_class string, channel string, median double, iqr double")
    doc = json.loads(json.dumps(features.scaler_document(q)))
    assert sorted(features.scaler_of(spark, doc).collect()) == sorted(q.collect())


def test_tuning_calibrates_on_the_validation_split(spark):
    ser = spark.createDataFrame([(i, START + k * DAY, 6778.0, 0.001, 66.0, 0.0, 90.0) for i in (1, 2) for k in range(90)], COLUMNS)
    lab = spark.createDataFrame([(1, 2, START + 45 * DAY + 5, START + 45 * DAY, START + 46 * DAY, "in-track", None, "LEO", "s"), (2, 1, START + 5 * DAY, START + 5 * DAY, START + 6 * DAY, "in-track", None, "LEO", "s")], "label_id long, norad_id long, epoch long, window_start long, window_end long, maneuver_type string, delta_v double, orbit_class string, source string")
    mem = spark.createDataFrame([(1, "train"), (2, "val")], "norad_id long, split string")
    hits = spark.createDataFrame([(2, (START + 45 * DAY + 7) * 1000, 0.9, "in-track"), (2, (START + 52 * DAY) * 1000, 0.5, "radial")], "norad_id long, epoch_ns long, confidence double, type string")
    at = lambda rows, x: hits.where(F.col("confidence") >= x)
    got, tuned = evaluate.tuned_detector(at, [0.95, 0.4], ser, lab, mem, (START + 30 * DAY, START + 60 * DAY))
    assert got["threshold"] == 0.4 and got["value"] == 1.0 and got["by_class"] == {"LEO": 0.4} and got["calibration"] is not None
    assert tuned(ser).count() == 2
