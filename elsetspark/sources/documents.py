"""JSON documents of the benchmark: predictions, labels, recipe, manifest, splits. Small and canonical: written on the driver."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .omm import epoch_us

PREDICTION = ("epoch", "confidence", "type", "delta_v_estimate", "norad_id", "elset_epoch_before", "elset_epoch_after")
LABEL = ("norad_id", "epoch", "window_start", "window_end", "maneuver_type", "delta_v", "orbit_class", "source", "source_ref")
SPLITS = ("train", "val", "test")


def _maps(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "array<map<string,string>>", {"mode": "FAILFAST"})
    sound = F.when(F.ltrim("value").startswith("["), parsed).otherwise(F.raise_error(F.lit("not an array of objects")))
    return text.select(F.explode(sound).alias("m"))


def _utc(column):
    return epoch_us(F.regexp_replace(column, r"\+00:?00$", ""))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Exactly the seven fields: a missing or unknown one is an error. Times become microseconds."""
    fields = F.array(*[F.lit(c) for c in PREDICTION])
    wrong = F.concat(F.array_except(fields, F.map_keys("m")), F.array_except(F.map_keys("m"), fields))
    m = F.when(F.size(wrong) > 0, F.raise_error(F.concat(F.lit("missing or unknown fields: "), F.array_join(wrong, ",")))).otherwise(F.col("m"))
    rows = _maps(spark, path).select(m.alias("m"))
    at = lambda c: F.col("m")[c]
    return rows.select(_utc(at("epoch")).alias("epoch"), at("confidence").cast("double").alias("confidence"), at("type").alias("type"), at("delta_v_estimate").cast("double").alias("delta_v_estimate"), at("norad_id").cast("long").alias("norad_id"), _utc(at("elset_epoch_before")).alias("t_before"), _utc(at("elset_epoch_after")).alias("t_after"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    at = lambda c: F.col("m")[c]
    rows = _maps(spark, path).select(at("norad_id").cast("long").alias("norad_id"), *[_utc(at(c)).alias(c) for c in ("epoch", "window_start", "window_end")], at("maneuver_type").alias("maneuver_type"), at("delta_v").cast("double").alias("delta_v"), *[at(c).alias(c) for c in ("orbit_class", "source", "source_ref")])
    sound = (F.col("window_start") <= F.col("window_end")) & F.coalesce(F.col("delta_v") >= 0, F.lit(True))
    return rows.where(F.when(sound, F.lit(True)).otherwise(F.raise_error(F.lit("label window or velocity change out of order")).cast("boolean"))).orderBy("source", F.coalesce("norad_id", F.lit(-1)), "epoch")


def iso(us: int | None) -> str | None:
    import datetime

    return None if us is None else (datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(microseconds=us)).isoformat()


def write_predictions(maneuvers: DataFrame, path: str) -> None:
    """Canonical file of a result-sized frame: epoch (microseconds), confidence, type, delta_v_estimate, norad_id, t_before, t_after."""
    rows = maneuvers.orderBy("norad_id", "epoch").collect()
    out = [{"epoch": iso(r["epoch"]), "confidence": r["confidence"], "type": r["type"], "delta_v_estimate": r["delta_v_estimate"], "norad_id": r["norad_id"], "elset_epoch_before": iso(r["t_before"]), "elset_epoch_after": iso(r["t_after"])} for r in rows]
    Path(path).write_text(json.dumps(out, sort_keys=True, indent=2) + "\n")


def _canonical(document: object, path: str) -> None:
    Path(path).write_text(json.dumps(document, sort_keys=True, indent=2) + "\n")


def write_labels(labels: DataFrame, path: str) -> None:
    """Label document of a label-sized frame, by (source, object, epoch)."""
    times = ("epoch", "window_start", "window_end")
    rows = labels.select(*LABEL).orderBy("source", F.coalesce("norad_id", F.lit(-1)), "epoch").collect()
    _canonical([{c: iso(r[c]) if c in times else r[c] for c in LABEL} for r in rows], path)


def write_recipe(entries: DataFrame, version: str, path: str) -> None:
    """Recipe document: an entry an object, by catalogue number."""
    fields = ("norad_id", "orbit_class", "object_name", "catalogue_source", "label_source", "label_ref", "start", "end")
    have = [c for c in fields if c in entries.columns]
    rows = [r.asDict() for r in entries.select(*have).orderBy("norad_id").collect()]
    _canonical({"dataset_version": version, "entries": [{c: r.get(c) for c in fields} for r in rows]}, path)


def write_splits(membership: DataFrame, version: str, path: str, **settings) -> None:
    """Temporal split document of norad_id, split, with the settings (seed, ratios, cuts) that made it."""
    rows = membership.select("norad_id", "split").orderBy("norad_id").collect()
    _canonical({"kind": "temporal", "dataset_version": version, "splits": {s: [r["norad_id"] for r in rows if r["split"] == s] for s in SPLITS}} | settings, path)


INTERVAL = {"norad_id": "long", "epoch": "string", "elset_epoch_before": "string", "elset_epoch_after": "string", "tol_start": "string", "tol_end": "string", "maneuver_type": "string", "delta_v": "double", "source": "string", "source_ref": "string", "orbit_class": "string"}
TIMES = {"epoch": "epoch", "elset_epoch_before": "t0", "elset_epoch_after": "t1", "tol_start": "tol_start", "tol_end": "tol_end"}
FIXTURE = f"dataset_version string, labels array<struct<above_floor:boolean,interval:struct<{','.join(f'{k}:{t}' for k, t in INTERVAL.items())}>>>, exposure array<struct<norad_id:long,orbit_class:string,observation_years:double>>, timing_floor map<string,double>"


def write_fixture(labels: DataFrame, exposure: DataFrame, timing_floor: dict[str, float], version: str, path: str) -> None:
    """What a board scores against: the labels and exposure that partition.scoring_inputs gives for the held-out split."""
    rows = labels.orderBy("norad_id", "epoch", "label_id").collect()
    one = lambda r: {c: iso(r[TIMES[c]]) if c in TIMES else r[c] if c in r else None for c in INTERVAL}
    _canonical({
        "dataset_version": version,
        "labels": [{"above_floor": r["above_floor"], "interval": one(r.asDict())} for r in rows],
        "exposure": [r.asDict() for r in exposure.select("norad_id", "orbit_class", "observation_years").orderBy("norad_id").collect()],
        "timing_floor": timing_floor,
    }, path)


def read_fixture(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """Labels (times in microseconds, label_id by their order), exposure and timing floor of a fixture document."""
    parsed = F.from_json("value", FIXTURE, {"mode": "FAILFAST"})
    doc = spark.read.text(path, wholetext=True).select(parsed.alias("d")).select("d.*")
    rows = doc.select(F.posexplode("labels").alias("label_id", "x"))
    labels = rows.select(F.col("label_id").cast("long").alias("label_id"), "x.above_floor", *[_utc(F.col(f"x.interval.{c}")).alias(TIMES[c]) if c in TIMES else F.col(f"x.interval.{c}") for c in INTERVAL])
    floor = doc.first()["timing_floor"]
    return labels, doc.select(F.inline("exposure")), dict(floor)


def read_recipe(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a dataset recipe, by catalogue number."""
    doc = json.loads(Path(path).read_text())
    rows = [(e["norad_id"], e["orbit_class"], e["object_name"], e["catalogue_source"], e["label_source"], e["label_ref"], e.get("start"), e.get("end")) for e in doc["entries"]]
    return spark.createDataFrame(rows, "norad_id long, orbit_class string, object_name string, catalogue_source string, label_source string, label_ref string, start string, end string").orderBy("norad_id")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    doc = json.loads(Path(path).read_text())
    return spark.createDataFrame([(e["norad_id"], e["n_elsets"], e["sha256"]) for e in doc["digests"]], "norad_id long, n_elsets long, sha256 string")


def write_manifest(digests: DataFrame, version: str, path: str) -> None:
    rows = [r.asDict() for r in digests.select("norad_id", "n_elsets", "sha256").orderBy("norad_id").collect()]
    Path(path).write_text(json.dumps({"dataset_version": version, "digests": rows}, sort_keys=True, indent=2) + "\n")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """norad_id, split of a temporal split document; another kind is an error."""
    doc = json.loads(Path(path).read_text())
    if doc.get("kind") != "temporal" or set(doc["splits"]) != set(SPLITS):
        raise ValueError("not a temporal split document")
    return spark.createDataFrame([(i, s) for s in SPLITS for i in doc["splits"][s]], "norad_id long, split string")
