"""Rule detector: significant detrended steps, strongest first, transients dropped, inverted to velocity changes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import REVERT, THRESHOLD, WINDOW
from ..functions.physics import clamp_ecc, clamp_inc, class_floor, confidence, invert, orbit_class
from ..functions.stats import by_object
from .series import ELEMENTS, finite, holt_at, indexed, local_steps, regularize_daily, scaled

RAD = math.pi / 180
REQUIRED = ("norad_id", "t", *ELEMENTS)


def require(df: DataFrame, columns: tuple[str, ...] = REQUIRED) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing required columns: {missing}")


def prepared(series: DataFrame) -> DataFrame:
    """Finite rows, one a day, indexed and unwrapped, with the object's median orbit: one exchange by object."""
    require(series)
    rows = series.where(finite(*ELEMENTS)).select(*REQUIRED).repartition("norad_id")
    rows = indexed(regularize_daily(rows))
    return rows.withColumns({f"m_{c}": F.median(c).over(by_object()) for c in ("a", "e", "inc", "argp")})


def scored_gaps(rows: DataFrame, others: bool = False) -> DataFrame:
    """Gaps with the dominant channel (a on ties), its significance, and whether a neighbour takes the step back. others: as in local_steps."""
    gaps = scaled(local_steps(rows, others=others))
    za, zi = F.abs(F.col("step_a")) / F.col("scale_a"), F.abs(F.col("step_inc")) / F.col("scale_inc")
    gaps = gaps.withColumns({"z_a": za, "z_inc": zi})
    gaps = gaps.withColumns({"significance": F.greatest("z_a", "z_inc"), "channel": F.when(F.col("z_a") >= F.col("z_inc"), "a").otherwise("inc")})
    w = by_object("idx")

    def taken_back(c: str):
        step = F.col(f"step_{c}")
        near = [F.lag(step).over(w), F.lead(step).over(w)]
        return F.coalesce(sum(((x * step < 0) & (F.abs(x) >= REVERT * F.abs(step))).cast("int") for x in [F.coalesce(v, F.lit(0.0)) for v in near]) > 0, F.lit(False))

    return gaps.withColumn("transient", F.when(F.col("channel") == "a", taken_back("a")).otherwise(taken_back("inc")))


def candidates(gaps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return gaps.where(F.col("significance") >= threshold)


def _strongest(rows: Column, row_type: str, radius: int) -> Column:
    """Of an object's (s: -significance, i: gap, row), greedily from the smallest s: those that have no kept one within radius gaps."""
    far = lambda acc, c: F.forall(acc, lambda k: F.abs(k["i"] - c["i"]) > radius)
    one = lambda c: F.array(F.struct(c["i"].cast("int").alias("i"), c["row"].alias("row")))
    return F.aggregate(F.array_sort(rows), F.array().cast(f"array<struct<i:int,row:{row_type}>>"), lambda acc, c: F.when(far(acc, c), F.concat(acc, one(c))).otherwise(acc))


def _packed(df: DataFrame) -> tuple[Column, str]:
    row = F.struct(*df.columns)
    return F.struct((-F.col("significance")).alias("s"), F.col("idx").alias("i"), row.alias("row")), df.select(row).dtypes[0][1]


def suppress_neighbours(found: DataFrame, radius: int = WINDOW) -> DataFrame:
    """Greedy, strongest first (earlier gap on ties): what lies within radius gaps of a kept one goes. One fold an object."""
    packed, kind = _packed(found)
    return found.groupBy("norad_id").agg(F.collect_list(packed).alias("r")).select(F.inline(_strongest(F.col("r"), kind, radius))).select("row.*")


def with_floors(gaps: DataFrame) -> DataFrame:
    """Adds the smallest velocity change of each type that a THRESHOLD-sigma step shows, the class floor at least."""
    o = (F.col("m_a"), clamp_ecc(F.col("m_e")), clamp_inc(F.col("m_inc") * RAD), F.col("m_argp") * RAD)
    zero, s = F.lit(0.0), {c: THRESHOLD * F.col(f"scale_{c}") for c in ("a", "e", "inc", "raan")}
    dv = lambda *step: invert(*step, *o)["delta_v_ms"]
    nominal = class_floor(orbit_class(F.col("m_a")))
    return gaps.withColumns({
        "floor_in_track": F.greatest(dv(s["a"], zero, zero, zero), nominal),
        "floor_cross_track": F.greatest(F.least(dv(zero, zero, s["inc"] * RAD, zero), dv(zero, zero, zero, s["raan"] * RAD)), nominal),
        "floor_radial": F.greatest(dv(zero, s["e"], zero, zero), nominal),
    })


def object_floors(gaps: DataFrame) -> DataFrame:
    names = ("floor_in_track", "floor_cross_track", "floor_radial")
    one = gaps.groupBy("norad_id").agg(*[F.first(c).alias(c) for c in (*(f"m_{x}" for x in ("a", "e", "inc", "argp")), *(f"scale_{x}" for x in ("a", "e", "inc", "raan")))])
    return with_floors(one).select("norad_id", *names)


def detect_rule(series: DataFrame) -> DataFrame:
    """Manoeuvres: epoch_ns, confidence, type, delta_v_estimate (null below the floor), norad_id, t_before, t_after."""
    names = ("a", "e", "inc", "argp")
    gaps = scored_gaps(prepared(series), others=True)
    packed, kind = _packed(gaps)
    # One scan and one exchange: an object's candidates and its rows meet in one aggregate, and levels are folded only where a step stays.
    per = gaps.groupBy("norad_id").agg(F.collect_list(F.when(F.col("significance") >= THRESHOLD, packed)).alias("r"), F.sort_array(F.collect_list(F.struct("idx", "t_days", *names))).alias("rows"))
    per = per.where(F.size("r") > 0).select("rows", F.filter(_strongest(F.col("r"), kind, WINDOW), lambda k: ~k["row"]["transient"]).alias("kept")).where(F.size("kept") > 0)
    per = per.withColumn("levels", holt_at(F.col("rows"), F.transform("kept", lambda k: k["i"] - 1), names))
    kept = per.select("levels", F.inline("kept")).withColumn("level", F.filter("levels", lambda x: x["idx"] == F.col("i") - 1)[0])
    kept = kept.select("row.*", *[F.col(f"level.{c}").alias(f"level_{c}") for c in names])
    joined = with_floors(kept)
    got = invert(
        F.col("step_a"), F.col("step_e"), F.col("step_inc") * RAD, F.col("step_raan") * RAD,
        F.col("level_a"), clamp_ecc(F.col("level_e")), clamp_inc(F.col("level_inc") * RAD), F.col("level_argp") * RAD,
    )
    out = joined.withColumns({"type": got["type"], "dv": got["delta_v_ms"]})
    floor = F.when(F.col("type") == "in-track", F.col("floor_in_track")).when(F.col("type") == "cross-track", F.col("floor_cross_track")).otherwise(F.col("floor_radial"))
    return out.select(
        ((F.col("t0") + F.col("t")) * 500).alias("epoch_ns"),
        confidence(F.col("significance"), F.col("type")).alias("confidence"),
        "type",
        F.when(F.col("dv") >= floor, F.col("dv")).alias("delta_v_estimate"),
        "norad_id",
        F.col("t0").alias("t_before"),
        F.col("t").alias("t_after"),
    )


def drift_scores(series: DataFrame) -> DataFrame:
    """Residual score of each row: a and inc forecast one step ahead as the last value plus the median difference; largest centred-MAD z."""
    rows = indexed(series.where(finite(*ELEMENTS)).select(*REQUIRED).repartition("norad_id"))
    w, all_ = by_object("t"), by_object()
    score = None
    for c, floor, unit in (("a", 1e-6, 1.0), ("inc", 1e-9, RAD)):
        rows = rows.withColumn(f"d_{c}", (F.col(c) - F.lag(c).over(w)) * unit)
        rows = rows.withColumn(f"r_{c}", F.col(f"d_{c}") - F.median(f"d_{c}").over(all_))
        rows = rows.withColumn(f"c_{c}", F.median(f"r_{c}").over(all_))
        rows = rows.withColumn(f"q_{c}", F.greatest(1.4826 * F.median(F.abs(F.col(f"r_{c}") - F.col(f"c_{c}"))).over(all_), F.lit(floor)))
        z = F.coalesce(F.abs(F.col(f"r_{c}") - F.col(f"c_{c}")) / F.col(f"q_{c}"), F.lit(0.0))
        score = z if score is None else F.greatest(score, z)
    return rows.select("norad_id", "t", "idx", score.alias("z"))


def run_peaks(scores: DataFrame, threshold: float) -> DataFrame:
    """First largest score of each run of rows (from the second on) at or above the threshold."""
    w = by_object("idx")
    hit = (F.col("z") >= threshold) & (F.col("idx") > 0)
    marked = scores.withColumn("hit", hit).withColumn("new", (F.col("hit") & ~F.coalesce(F.lag("hit").over(w), F.lit(False))).cast("int"))
    marked = marked.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("hit")
    best = Window.partitionBy("norad_id", "run").orderBy(F.col("z").desc(), "idx")
    return marked.withColumn("k", F.row_number().over(best)).where("k = 1").select("norad_id", "t", "idx", "z")
