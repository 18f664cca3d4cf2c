"""Membership of objects in splits: scoring inputs of a partition, training targets, scopes of a recipe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ORBIT_CLASSES, US_PER_DAY
from ..functions.physics import orbit_class
from . import bench, labels as lab
from .learned import floor_of, floors

ERA_OF = {"train": 0, "val": 1, "test": 2}
YEAR_US = 365.25 * US_PER_DAY


def members(rows: DataFrame, membership: DataFrame) -> DataFrame:
    """rows of the objects that are in a split, with split. Rows without an object and objects in no split go."""
    return rows.join(membership.select("norad_id", "split"), "norad_id")


def eligible_eras(labels: DataFrame, cuts: tuple[int, int], guard_days: int = bench.GUARD_DAYS) -> DataFrame:
    """Labels with an object whose whole window lies in one era, with era."""
    first, last = (bench.era(F.col(c), *cuts, guard_days=guard_days) for c in ("window_start", "window_end"))
    return labels.where("norad_id is not null").withColumns({"era": first, "__last": last}).where("era = __last").drop("__last")


def assign(labels: DataFrame, membership: DataFrame, cuts: tuple[int, int], guard_days: int = bench.GUARD_DAYS) -> DataFrame:
    """Labels whose window lies in the era of their object's split, with split."""
    era = F.element_at(F.create_map(*[F.lit(x) for kv in ERA_OF.items() for x in kv]), F.col("split"))
    return members(eligible_eras(labels, cuts, guard_days), membership).where(F.col("era") == era).drop("era")


def scoring_inputs(series: DataFrame, labels: DataFrame, membership: DataFrame, split: str, cuts: tuple[int, int], guard_days: int = bench.GUARD_DAYS) -> tuple[DataFrame, DataFrame]:
    """Scored labels on the full series (with above_floor) and exposure of the split's objects, which need a row in its era.

    The class of an object is that of its first label in the split (by epoch), else by its median orbit.
    """
    inside = series.where(bench.era(F.col("t"), *cuts, guard_days=guard_days) == ERA_OF[split])
    spans = members(inside, membership.where(F.col("split") == split)).groupBy("norad_id").agg(((F.max("t") - F.min("t")) / F.lit(YEAR_US)).alias("observation_years"))
    own = assign(labels, membership, cuts, guard_days).where(F.col("split") == split).join(spans.select("norad_id"), "norad_id", "left_semi")
    mapped = lab.map_to_gaps(own, series).join(floors(series), "norad_id")
    above = F.coalesce(F.col("delta_v") >= floor_of("maneuver_type"), F.lit(True))
    scored = mapped.select(*own.columns, "t0", "t1", "tol_start", "tol_end", above.alias("above_floor"))
    named = own.groupBy("norad_id").agg(F.min_by("orbit_class", F.struct("epoch", "label_id")).alias("named"))
    shape = series.groupBy("norad_id").agg(orbit_class(F.median("a")).alias("by_orbit"))
    exposure = spans.join(shape, "norad_id").join(named, "norad_id", "left")
    return scored, exposure.select("norad_id", F.coalesce("named", "by_orbit").alias("orbit_class"), "observation_years")


def detections_in_era(found: DataFrame, membership: DataFrame, split: str, cuts: tuple[int, int], guard_days: int = bench.GUARD_DAYS) -> DataFrame:
    """Detections (epoch_ns) on full series of the split's objects that fall in its era."""
    at = F.col("epoch_ns") / 1000
    return members(found, membership.where(F.col("split") == split)).where(bench.era(at, *cuts, guard_days=guard_days) == ERA_OF[split]).drop("split")


def token_targets(tokens: DataFrame, intervals: DataFrame) -> DataFrame:
    """tokens (norad_id, t, ...) with target: 1.0 where a labelled gap ends. intervals: norad_id, t1."""
    ends = intervals.select("norad_id", F.col("t1").alias("t")).distinct().withColumn("target", F.lit(1.0))
    return tokens.join(ends, ["norad_id", "t"], "left").fillna(0.0, ["target"])


def unaligned(tokens: DataFrame, intervals: DataFrame) -> DataFrame:
    """Labelled gaps that end at no token."""
    return intervals.join(tokens.select("norad_id", F.col("t").alias("t1")), ["norad_id", "t1"], "left_anti")


def positive_weight(windows: DataFrame) -> DataFrame:
    """One row, weight: negatives a positive over the windows' tokens, 1 at least and where there is no positive."""
    hits, n = F.coalesce(F.sum("target"), F.lit(0.0)), F.count("*")
    return windows.agg(F.when(hits > 0, F.greatest((n - hits) / hits, F.lit(1.0))).otherwise(1.0).alias("weight"))


def scope(rows: DataFrame, recipe: DataFrame, column: str = "epoch") -> DataFrame:
    """rows inside the window of their object's recipe entry (norad_id, start, end): both ends count, a null end is open."""
    window = recipe.select("norad_id", F.col("start").alias("__lo"), F.col("end").alias("__hi"))
    inside = F.coalesce(F.col(column) >= F.col("__lo"), F.lit(True)) & F.coalesce(F.col(column) <= F.col("__hi"), F.lit(True))
    return rows.join(window, "norad_id").where(inside).drop("__lo", "__hi")


def recipe_counts(recipe: DataFrame) -> DataFrame:
    """Objects of each class, zero rows included."""
    return lab.class_dim(recipe).join(recipe.groupBy("orbit_class").agg(F.count("*").alias("n")), "orbit_class", "left").fillna(0, ["n"])


def merged_labels(*sources: DataFrame, per_day: bool = False) -> DataFrame:
    """Labels of all sources by (source, object, epoch); per_day keeps the first of an object and UTC day."""
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more)
    if per_day:
        w = Window.partitionBy("norad_id", F.floor(F.col("window_start") / US_PER_DAY)).orderBy("window_start", "source", "label_id")
        out = out.where("norad_id is not null").withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    return out.orderBy("source", F.coalesce("norad_id", F.lit(-1)), "epoch")


def components(labels: DataFrame) -> list[tuple[int, list[int], dict[str, int]]]:
    """Smallest id, ids and events a class of each overlap component: one row an object and class reaches the driver."""
    counts = labels.where("norad_id is not null").groupBy("norad_id", "orbit_class").count().join(bench.overlap_components(labels), "norad_id").collect()
    held: dict[int, tuple[set[int], dict[str, int]]] = {}
    for r in counts:
        ids, by = held.setdefault(r["component"], (set(), {}))
        ids.add(r["norad_id"])
        by[r["orbit_class"]] = by.get(r["orbit_class"], 0) + r["count"]
    return [(k, sorted(ids), {c: by[c] for c in ORBIT_CLASSES if c in by}) for k, (ids, by) in sorted(held.items())]


def split_objects(labels: DataFrame, seed: int = 0, stratified: bool = False) -> DataFrame:
    """norad_id, split: whole components, towards the ratios over all events or within each class."""
    found = components(labels)
    placed = bench.pack_stratified([(k, by) for k, _, by in found], seed) if stratified else bench.pack_splits([(k, sum(by.values())) for k, _, by in found], seed)
    return labels.sparkSession.createDataFrame([(i, placed[k]) for k, ids, _ in found for i in ids], "norad_id long, split string")


def temporal_split_objects(labels: DataFrame, cuts: tuple[int, int], seed: int = 0, guard_days: int = bench.GUARD_DAYS) -> DataFrame:
    """norad_id, split of the objects with an eligible label; an object's class is that of its last one."""
    from .evaluate import temporal_split

    rows = eligible_eras(labels, cuts, guard_days)
    named = rows.groupBy("norad_id").agg(F.max_by("orbit_class", F.struct("epoch", "label_id")).alias("orbit_class"))
    counts = rows.groupBy("norad_id", "era").agg(F.count("*").alias("n")).join(named, "norad_id")
    return labels.sparkSession.createDataFrame(sorted(temporal_split(counts, seed).items()), "norad_id long, split string")
