"""Domain tables projected from the driver's tables, by whole-number arithmetic that any SQL engine repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ORBIT_CLASSES, TYPES


BURN = 1_705_276_800_000_000  # 2024-01-15


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def series_ev(spark: SparkSession, sf_dir: str, quiet: bool = False) -> DataFrame:
    """norad_id, t, a, e, inc, raan, argp, mean_motion, event_id from events; from BURN on, every third object is
    2 km higher and every third is tilted by 0.05 degrees. quiet: without purchases and errors."""
    ev, i = read(spark, sf_dir, "events"), F.col("event_id")
    if quiet:
        ev = ev.where(~F.col("event_type").isin("purchase", "error"))
    after = micros("ts") >= BURN
    step = lambda k, by: F.when(after & (F.col("user_id") % 3 == k), by).otherwise(0.0)
    a = F.lit(6778.0) + F.col("value") / 1000 + step(0, 2.0)
    return ev.select(
        F.col("user_id").alias("norad_id"), micros("ts").alias("t"), a.alias("a"), (F.lit(0.001) + (i % 97) * F.lit(1e-6)).alias("e"), (F.lit(66.0) + ((i * 31) % 101) * F.lit(1e-4) + step(1, 0.05)).alias("inc"),
        ((i * 37) % 360).cast("double").alias("raan"), F.lit(90.0).alias("argp"), (F.lit(1.0) + F.col("value") / 100000).alias("mean_motion"), "event_id",
    )


def elsets_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw elsets with re-fits of the same epoch, some unphysical rows, and some (event_id % 90 = 7) that have decayed into the Earth."""
    ev, i = read(spark, sf_dir, "events"), F.col("event_id")
    copies = ev.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    return copies.select(
        F.col("user_id").alias("norad_id"), micros("ts").alias("t"), (F.when(i % 90 == 7, 18.0).otherwise(F.lit(15.0) + F.col("value") / 1000) + F.col("copy") * F.lit(0.001)).alias("mean_motion"),
        F.when(i % 50 == 0, 1.5).otherwise(F.lit(0.001) + (i % 97) * F.lit(1e-6)).alias("eccentricity"), F.when(i % 70 == 0, 200.0).otherwise(66.0).alias("inclination"),
        (i % 360).cast("double").alias("raan"), F.lit(90.0).alias("arg_perigee"), F.lit(10.0).alias("mean_anomaly"), F.lit(1e-4).alias("bstar"), F.lit(0.0).alias("mean_motion_dot"), F.lit(0.0).alias("mean_motion_ddot"),
        (F.lit(100) + F.when(i % 3 == 0, F.col("copy")).otherwise(0)).cast("long").alias("element_set_no"),
    )


def _class(column: str = "user_id"):
    return F.element_at(F.array(*[F.lit(c) for c in ORBIT_CLASSES]), (F.col(column) % 5 + 1).cast("int"))


def _type(column: str = "event_id"):
    return F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col(column) % 3 + 1).cast("int"))


def labels_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, i = read(spark, sf_dir, "events").where("event_type = 'purchase'"), F.col("event_id")
    t = micros("ts")
    return ev.select(
        i.alias("label_id"), F.when(i % 13 != 0, F.col("user_id")).alias("norad_id"), t.alias("epoch"), t.alias("window_start"), (t + 3_600_000_000).alias("window_end"),
        F.when(i % 5 != 0, _type()).alias("maneuver_type"), F.when(i % 3 != 0, F.col("value") / 100).alias("delta_v"), _class().alias("orbit_class"), F.concat(F.lit("src"), (i % 4).cast("string")).alias("source"),
    )


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a window of two days on either side and the floor rule of their class."""
    from ..functions.physics import above_floor, class_floor

    lab = labels_ev(spark, sf_dir)
    day = 86_400_000_000
    return lab.withColumns({"tol_start": F.col("epoch") - 2 * day, "tol_end": F.col("epoch") + 2 * day, "above_floor": above_floor(F.col("delta_v"), class_floor(F.col("orbit_class")) * 20)})


def detections_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events").where("event_type = 'error'")
    return ev.select(F.col("event_id").alias("det_id"), F.col("user_id").alias("norad_id"), micros("ts").alias("epoch"), (F.col("value") / (F.col("value") + 50)).alias("confidence"), _type().alias("type"))


def exposure_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events").select("user_id", micros("ts").alias("t"))
    years = (F.max("t") - F.min("t")) / F.lit(365.25 * 86_400_000_000) * 20
    return ev.groupBy("user_id").agg(years.alias("observation_years")).select(F.col("user_id").alias("norad_id"), _class().alias("orbit_class"), "observation_years")


def samples_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events")
    return ev.select((F.col("value") / (F.col("value") + 50)).alias("confidence"), (F.col("event_id") % 3 == 0).cast("int").alias("outcome"), _class().alias("orbit_class"))
