"""Counts of what is left out, checks of the input, and the command line over a catalogue."""

import json
import math
import random
from datetime import datetime, timedelta

import pytest

from elsetspark import cli
from elsetspark.operators import guards

KINDS = "norad_id long, t long, a double, e double, inc double, raan double, argp double"
ROWS = [(1, 0, 7000.0, 0.1, 1.0, 1.0, 1.0), (1, 1, math.nan, 0.1, 1.0, 1.0, 1.0), (1, 2, None, 0.1, math.inf, 1.0, 1.0), (2, 3, 7000.0, 0.1, 1.0, 1.0, -math.inf)]


def test_dropped_rows_are_counted_in_the_pass(spark):
    rows, seen = guards.counted(spark.createDataFrame(ROWS, KINDS))
    assert [r["t"] for r in rows.collect()] == [0]
    assert seen.get == {"rows": 4, "dropped": 3, "a": 2, "e": 0, "inc": 1, "raan": 0, "argp": 1}
    with pytest.warns(UserWarning, match=r"3 of 4 rows .*: a \(2\), inc \(1\), argp \(1\)"):
        assert guards.warn_dropped(seen) == 3


def test_counts_by_object_and_nothing_to_count(spark):
    got = {r["norad_id"]: (r["rows"], r["dropped"], r["bad_a"], r["bad_inc"], r["bad_argp"]) for r in guards.non_finite(spark.createDataFrame(ROWS, KINDS)).collect()}
    assert got == {1: (3, 2, 2, 1, 0), 2: (1, 1, 0, 0, 1)}
    rows, seen = guards.counted(spark.createDataFrame([], KINDS))
    assert rows.count() == 0 and seen.get["dropped"] == 0 and guards.warn_dropped(seen) == 0


def test_one_object(spark):
    df = spark.createDataFrame(ROWS, KINDS)
    assert guards.one_object(df.where("norad_id = 1")).count() == 3 and guards.one_object(df.where("norad_id = 9")).count() == 0
    with pytest.raises(ValueError, match="more than one object"):
        guards.one_object(df)


def test_moments():
    assert cli.moment("2024-01-15") == cli.moment("2024-01-15T00:00:00Z") == cli.moment("1705276800000000") == 1_705_276_800_000_000
    assert cli.moment("2024-01-15T01:00:00+01:00") == 1_705_276_800_000_000
    with pytest.raises(ValueError):
        cli.moment("yesterday")


def test_command_line_over_landed_answers(spark, tmp_path, capsys):
    folder = tmp_path / "norad_id=5"
    folder.mkdir()
    fields = {"ECCENTRICITY": 0.001, "INCLINATION": 66, "RA_OF_ASC_NODE": 10, "ARG_OF_PERICENTER": 90, "MEAN_ANOMALY": 1, "BSTAR": 0, "MEAN_MOTION_DOT": 0, "MEAN_MOTION_DDOT": 0}
    noise, first = random.Random(2), datetime(2024, 1, 1, 12)
    rows = [{"NORAD_CAT_ID": 5, "EPOCH": (first + timedelta(days=d)).isoformat(), "MEAN_MOTION": 14.0 + noise.gauss(0, 1e-5) - (0.004 if d > 60 else 0), **fields} for d in range(120)]
    (folder / "part-0.txt").write_text(json.dumps(rows))
    assert cli.main(["detect", "5", "--source", "spacetrack", "--landed", str(tmp_path), "--format", "json", "--start", "2024-01-01"]) == 0
    found = json.loads(capsys.readouterr().out)
    best = max(found, key=lambda r: r["confidence"])
    assert best["norad_id"] == 5 and best["type"] == "in-track" and best["epoch"].startswith("2024-03-02")
    assert cli.main(["detect", "5", "--source", "spacetrack", "--landed", str(tmp_path), "--format", "json", "--end", "2024-02-01"]) == 0
    assert all(r["epoch"] < "2024-02-01" for r in json.loads(capsys.readouterr().out))
