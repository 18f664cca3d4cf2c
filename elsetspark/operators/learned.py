"""Sequence-model detector around a scorer that the caller supplies: windows, averaged probabilities, peaks, inversion.

A scorer takes the windowed, standardised tokens (norad_id, idx, orbit_class, window_id, position,
32 channels) and returns norad_id, idx and p for each: a Column expression or mapInPandas keeps it
inside the plan. Only the rows around a peak are read again for the inversion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ORBIT_CLASSES, WINDOW
from ..functions.physics import clamp_ecc, clamp_inc, class_floor, invert, orbit_class, residual_confidence
from . import detect
from .features import channels, levels, standardise, token_windows
from .series import scaled, local_steps

Scorer = Callable[[DataFrame], DataFrame]
STEPPED = ("a", "e", "inc_rad", "raan_rad")
LEVELS = ("a", "e", "sin_i", "cos_i", "h", "k")


def aligned_elements(encoded: DataFrame) -> DataFrame:
    """norad_id, t, idx, n, t_days, orbit_class, the levels of LEVELS, and inclination and node in radians."""
    own = Window.partitionBy("norad_id")
    rows = encoded.withColumns({"n": F.count("*").over(own), "t_days": (F.col("t") - F.min("t").over(own)) / F.lit(86_400_000_000)})
    angles = {"inc_rad": F.atan2("lvl_sin_i", "lvl_cos_i"), "raan_rad": F.radians("lvl_raan")}
    return rows.select("norad_id", "t", "idx", "n", "t_days", "orbit_class", *[F.col(f"lvl_{c}").alias(c) for c in LEVELS], *[v.alias(k) for k, v in angles.items()])


def probabilities(encoded: DataFrame, quartiles: DataFrame, scorer: Scorer) -> DataFrame:
    """norad_id, idx, p: the scorer's probability of each token, averaged over the windows that hold it."""
    scored = scorer(token_windows(standardise(encoded, quartiles)))
    return scored.groupBy("norad_id", "idx").agg(F.avg("p").alias("p"))


def gate(thresholds: dict[str, float], default: float) -> Column:
    """Threshold of the class of a row."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c in ORBIT_CLASSES for x in (c, float(thresholds.get(c, default)))]), F.col("orbit_class")), F.lit(float(default)))


def gated_peaks(scored: DataFrame, thresholds: dict[str, float], default: float) -> DataFrame:
    """First largest p of each run at or above the threshold of the object's class. scored: norad_id, t, idx, orbit_class, p."""
    w = Window.partitionBy("norad_id").orderBy("idx")
    marked = scored.withColumn("hit", (F.col("p") >= gate(thresholds, default)) & (F.col("idx") > 0))
    marked = marked.withColumn("run", F.sum((F.col("hit") & ~F.coalesce(F.lag("hit").over(w), F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy("norad_id", "run").orderBy(F.col("p").desc(), "idx")
    return marked.where("hit").withColumn("k", F.row_number().over(best)).where("k = 1").drop("hit", "run", "k")


def around(rows: DataFrame, gaps: DataFrame | None = None, half: int = WINDOW) -> DataFrame:
    """Per gap (norad_id, idx; none: every gap of rows): the step of each element across it and the median orbit of up to half rows before it.

    Steps are fits of width min(half, idx, n - idx) on either side, plain differences where that is below 2.
    Neighbours come by windows over the rows of an object, so that no row is copied for the gaps near it.
    """
    w = Window.partitionBy("norad_id").orderBy("idx")
    if gaps is not None:
        rows = rows.join(gaps.select("norad_id", "idx").distinct().withColumn("wanted", F.lit(True)), ["norad_id", "idx"], "left")
    row = F.struct("t", "t_days", *STEPPED, *[c for c in LEVELS if c not in STEPPED])
    near = rows.withColumns({f"l{k}": F.lag(row, k).over(w) for k in range(1, half + 1)} | {f"r{k}": F.lead(row, k).over(w) for k in range(1, half)} | {"r0": row})
    near = near.where(F.col("idx") > 0 if gaps is None else F.col("wanted") & (F.col("idx") > 0)).withColumn("width", F.least(F.lit(half), F.col("idx"), F.col("n") - F.col("idx")))
    sides = {"l": [f"l{k}" for k in range(1, half + 1)], "r": [f"r{k}" for k in range(half)]}
    # Of each side the first width rows, as days and values from the row next to the gap.
    held = lambda side, k, of: F.when(F.col("width") > k, of(F.col(sides[side][k]), F.col(sides[side][0]))).otherwise(0.0)
    total = lambda side, of: sum((held(side, k, of) for k in range(1, half)), F.lit(0.0))
    day = lambda x, x0: x["t_days"] - x0["t_days"]
    sums = {f"{s}_t": total(s, day) / F.col("width") for s in sides} | {f"{s}_y_{c}": total(s, lambda x, x0: x[c] - x0[c]) / F.col("width") for s in sides for c in STEPPED}  # noqa: B023
    near = near.withColumns(sums | {"mid": (F.col("l1.t_days") + F.col("r0.t_days")) / 2})
    spread = lambda s, of: sum((F.when(F.col("width") > k, of(F.col(sides[s][k]), F.col(sides[s][0]))).otherwise(0.0) for k in range(half)), F.lit(0.0))
    off = lambda s, x, x0: day(x, x0) - F.col(f"{s}_t")
    moments = {f"{s}_tt": F.when(total(s, lambda x, x0: F.abs(day(x, x0))) > 0, spread(s, lambda x, x0: off(s, x, x0) * off(s, x, x0))) for s in sides}  # noqa: B023
    moments |= {f"{s}_ty_{c}": spread(s, lambda x, x0: off(s, x, x0) * (x[c] - x0[c] - F.col(f"{s}_y_{c}"))) for s in sides for c in STEPPED}  # noqa: B023
    near = near.withColumns(moments)
    first = lambda s: F.col(sides[s][0])
    # Without two times there is no slope: the mean.
    value = lambda s, c: first(s)[c] + F.col(f"{s}_y_{c}") + F.coalesce(F.col(f"{s}_ty_{c}") / F.col(f"{s}_tt"), F.lit(0.0)) * (F.col("mid") - first(s)["t_days"] - F.col(f"{s}_t"))
    steps = {f"step_{c}": F.when(F.col("width") >= 2, value("r", c) - value("l", c)).otherwise(first("r")[c] - first("l")[c]) for c in STEPPED}
    before = {f"ref_{c}": F.sort_array(F.array_compact(F.array(*[F.col(x)[c] for x in sides["l"]]))) for c in LEVELS}
    near = near.select("norad_id", "idx", F.col("l1.t").alias("t0"), F.col("r0.t").alias("t1"), "width", *[v.alias(k) for k, v in (steps | before).items()])
    middle = lambda c: 0.5 * F.get(c, F.shiftright(F.size(c) - 1, 1)) + 0.5 * F.get(c, F.shiftright(F.size(c), 1))
    return near.select("norad_id", "idx", "t0", "t1", "width", *steps, *[middle(c).alias(c) for c in before])


def inverted(found: DataFrame) -> dict[str, Column]:
    """Velocity change and type of what around() returns."""
    return invert(
        *[F.col(f"step_{c}") for c in STEPPED], F.col("ref_a"), clamp_ecc(F.col("ref_e")),
        clamp_inc(F.atan2("ref_sin_i", "ref_cos_i")), F.atan2("ref_k", "ref_h"),
    )


def floors(series: DataFrame) -> DataFrame:
    """Floors of every object: of its own noise where it has gaps to score, else of its class."""
    own = detect.object_floors(scaled(local_steps(detect.prepared(series))))
    names = [c for c in own.columns if c != "norad_id"]
    nominal = series.groupBy("norad_id").agg(class_floor(orbit_class(F.median("a"))).alias("nominal"))
    return nominal.join(own, "norad_id", "left").select("norad_id", *[F.coalesce(c, "nominal").alias(c) for c in names])


def floor_of(kind: str) -> Column:
    """Floor of a row's type; in-track where the type is null."""
    return F.when(F.col(kind) == "cross-track", F.col("floor_cross_track")).when(F.col(kind) == "radial", F.col("floor_radial")).otherwise(F.col("floor_in_track"))


def detect_learned(series: DataFrame, quartiles: DataFrame, scorer: Scorer, thresholds: dict[str, float] | None = None, default: float = 0.5, encoded: DataFrame | None = None) -> DataFrame:
    """Manoeuvres in the columns of detect_rule; confidence is the peak's probability. encoded: the stored channels of series, where a caller has them."""
    encoded = channels(series) if encoded is None else encoded
    rows = aligned_elements(encoded)
    scored = probabilities(encoded, quartiles, scorer).join(rows.select("norad_id", "idx", "t", "orbit_class"), ["norad_id", "idx"])
    return at_peaks(rows, gated_peaks(scored, thresholds or {}, default), series)


def at_peaks(rows: DataFrame, peaks: DataFrame, series: DataFrame) -> DataFrame:
    """Manoeuvres at peaks (norad_id, idx, p: their confidence), in the columns of detect_rule. rows: aligned_elements."""
    found = around(rows, peaks)
    got = inverted(found)
    out = found.withColumns({"type": got["type"], "dv": got["delta_v_ms"]}).join(peaks.select("norad_id", "idx", "p"), ["norad_id", "idx"]).join(floors(series), "norad_id")
    return out.select(
        ((F.col("t0") + F.col("t1")) * 500).alias("epoch_ns"), F.col("p").alias("confidence"), "type",
        F.when(F.col("dv") >= floor_of("type"), F.col("dv")).alias("delta_v_estimate"), "norad_id", F.col("t0").alias("t_before"), F.col("t1").alias("t_after"),
    )


def residual_peaks(series: DataFrame, rows: DataFrame, thresholds: dict[str, float], default: float, scores: Scorer = detect.drift_scores) -> DataFrame:
    """norad_id, idx, z, p: peaks of the forecast residual at the threshold of each class, p the confidence."""
    scored = scores(series).join(rows.select("norad_id", "idx", "orbit_class"), ["norad_id", "idx"])
    peaks = gated_peaks(scored.withColumn("p", F.col("z")), thresholds, default)
    return peaks.select("norad_id", "idx", "z", residual_confidence(F.col("z"), gate(thresholds, default)).alias("p"))


def detect_residual(series: DataFrame, thresholds: dict[str, float] | None = None, default: float = 4.0, scores: Scorer = detect.drift_scores) -> DataFrame:
    """Manoeuvres where a forecast one row ahead misses: scores gives norad_id, idx and z of each row (the drift forecast
    unless another is given), a threshold for each class gates it, and the gap before each peak is inverted."""
    rows = aligned_elements(levels(series))
    return at_peaks(rows, residual_peaks(series, rows, thresholds or {}, default, scores), series)


def rolling_context(rows: DataFrame, column: str, length: int = 64) -> DataFrame:
    """rows after the first with context: up to length earlier values of the object, oldest first."""
    w = Window.partitionBy("norad_id").orderBy("idx").rowsBetween(-length, -1)
    return rows.withColumn("context", F.collect_list(column).over(w)).where("idx > 0")
