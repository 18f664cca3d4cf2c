"""Composed jobs: reconstruction of a dataset, temporal evaluation, threshold sweeps, calibration bundles, the board."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import OPERATING_POINT, ORBIT_CLASSES, US_PER_DAY
from . import bench, calibrate, dataset, detect, labels, partition
from .series import assemble, clean

YEAR_US = 365.25 * US_PER_DAY


def reconstruct(elsets: DataFrame) -> DataFrame:
    """Cleaned and assembled series of all objects in one job."""
    return assemble(clean(elsets))


def digests(series: DataFrame) -> DataFrame:
    """norad_id, n_elsets and a digest of each object's ordered rows, all columns included."""
    return dataset.series_digests(series, tuple(c for c in series.columns if c not in ("norad_id", "t")))


def temporal_split(events: DataFrame, seed: int = 0) -> dict[int, str]:
    """events: norad_id, orbit_class, era, n. Per class, objects with the fewest eligible eras first, each into the
    eligible era with the greatest deficit against what the class has placed so far. On the driver: one row an object and era."""
    rows = events.where("era is not null").collect()
    by: dict[str, dict[int, Counter]] = {}
    for r in rows:
        by.setdefault(r["orbit_class"], {}).setdefault(r["norad_id"], Counter())[r["era"]] += r["n"]
    out: dict[int, str] = {}
    for name in ORBIT_CLASSES:
        objects = by.get(name, {})
        total, held = 0, [0, 0, 0]
        for norad, eras in sorted(objects.items(), key=lambda kv: (len(kv[1]), -sum(kv[1].values()), bench.tiebreak(seed, kv[0]))):
            k = max(sorted(eras), key=lambda e: (bench.RATIOS[e] * total - held[e], -e))
            held[k] += eras[k]
            total += eras[k]
            out[norad] = ("train", "val", "test")[k]
    return out


def exposure(series: DataFrame, classes: DataFrame, era: int, cuts: tuple[int, int]) -> DataFrame:
    """Observation years of each object inside an era."""
    rows = series.where(bench.era(F.col("t"), *cuts) == era)
    return rows.groupBy("norad_id").agg(((F.max("t") - F.min("t")) / F.lit(YEAR_US)).alias("observation_years")).join(classes, "norad_id")


def score_on_era(series: DataFrame, events: DataFrame, classes: DataFrame, era: int, cuts: tuple[int, int], detections: DataFrame | None = None) -> dict:
    """Report of detections on the full series, kept where they fall in the era. events: labels with label_id and above_floor."""
    inside = events.where((bench.era(F.col("window_start"), *cuts) == era) & (bench.era(F.col("window_end"), *cuts) == era))
    mapped = labels.map_to_gaps(inside, series)
    found = detect.detect_rule(series) if detections is None else detections
    found = found.withColumn("epoch", F.floor(F.col("epoch_ns") / 1000)).where(bench.era(F.col("epoch"), *cuts) == era).withColumn("det_id", F.xxhash64("norad_id", "epoch_ns"))
    years = exposure(series, classes, era, cuts)
    scored = bench.outcomes(found, mapped, bench.match(found, mapped), years)
    return bench.report(scored, mapped, years)


def sweep(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """Peaks of one persisted score table at every threshold: one job, not one for each."""
    held, out = scores.persist(), None
    for t in thresholds:
        part = detect.run_peaks(held, t).withColumn("threshold", F.lit(float(t)))
        out = part if out is None else out.unionByName(part)
    return out


def recalls(found: dict[float, DataFrame], labels_: DataFrame, exposure_: DataFrame, rate: float = OPERATING_POINT) -> DataFrame:
    """threshold, orbit_class, tp_above, n_above, recall at the operating point, of the detections at each of a few thresholds."""
    out = None
    for threshold, dets in found.items():
        scored = bench.outcomes(dets, labels_, bench.match(dets, labels_), exposure_)
        points = bench.budget_points(scored, bench.class_counts(scored, labels_, exposure_), (rate,))
        part = points.select(F.lit(float(threshold)).alias("threshold"), "orbit_class", "tp_above", "n_above", "recall")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no candidate threshold")
    return out


def objective(points: DataFrame, kind: str = "pooled") -> DataFrame:
    """threshold, value: above-floor recall over all labels (pooled) or the mean over classes that have some (macro), 0 without any."""
    values = {"pooled": F.sum("tp_above") / F.nullif(F.sum("n_above"), F.lit(0)), "macro": F.avg("recall")}
    if kind not in values:
        raise ValueError(f"unknown objective {kind!r}")
    return points.groupBy("threshold").agg(F.coalesce(values[kind], F.lit(0.0)).alias("value"))


def tune(points: DataFrame, kind: str = "pooled") -> tuple[dict, dict[str, float]]:
    """From recalls(): the best threshold of all (threshold, value), and of each class with above-floor labels; ties to the lower threshold."""
    points = points.persist()
    try:
        best = calibrate.best_thresholds(objective(points, kind)).first().asDict()
        by = calibrate.best_thresholds(points.where("recall is not null").select("orbit_class", "threshold", F.col("recall").alias("value")), "orbit_class")
        return best, {r["orbit_class"]: r["threshold"] for r in by.collect()}
    finally:
        points.unpersist()


def calibration_bundle(samples: DataFrame, alpha: float = 0.1) -> dict:
    """What a published detector carries, as a JSON document: the pooled temperature, kept only if the pooled error falls (1 otherwise);
    the conformal quantile of the pooled confidences; and the curve and error of each class after the temperature."""
    samples = calibrate.guarded(samples)
    t = calibrate.fit_temperature(samples)
    cooled = lambda t: samples.withColumn("confidence", calibrate.apply_temperature(F.col("confidence"), t))
    raw, new = (x.first()["ece"] for x in (calibrate.ece(samples), calibrate.ece(cooled(t))))
    better = new < raw
    kept = cooled(t) if better else samples
    pooled = calibrate.conformal_quantile(samples.withColumn("orbit_class", F.lit("")), alpha).first()["q"]
    curves: dict[str, list] = {}
    for r in calibrate.reliability(kept, "orbit_class").orderBy("orbit_class", "bin").collect():  # ten rows a class
        curves.setdefault(r["orbit_class"], []).append({"lo": r["bin"] / calibrate.BINS, "hi": (r["bin"] + 1) / calibrate.BINS, "count": r["n"], "mean_confidence": r["mean_confidence"], "empirical_precision": r["precision"]})
    errors = {r["orbit_class"]: r["ece"] for r in calibrate.ece(kept, "orbit_class").collect()}
    return {"temperature": t if better else 1.0, "ece_raw": raw, "ece_pooled": new if better else raw, "conformal_q": pooled, "conformal_alpha": alpha, "reliability": curves, "ece": errors}


def calibrated(detector: Callable[[DataFrame], DataFrame], bundle: dict) -> Callable[[DataFrame], DataFrame]:
    """The detector with its confidences mapped by the bundle's temperature."""
    t = float(bundle["temperature"])
    if t == 1.0:
        return detector
    return lambda series: detector(series).withColumn("confidence", calibrate.apply_temperature(F.col("confidence"), t))


def tuned_detector(detect_at: Callable[[DataFrame, float], DataFrame], thresholds: list[float], series: DataFrame, labels_: DataFrame, membership: DataFrame, cuts: tuple[int, int], kind: str = "pooled") -> tuple[dict, Callable[[DataFrame], DataFrame]]:
    """The threshold with the best recall on the validation split, and the detector there with confidences calibrated on the same split.

    detect_at(series, threshold) gives detections. Without a matched detection to calibrate on, the confidences stay as they are. The test split is not read.
    """
    found = {}
    scored_labels, years = (x.persist() for x in partition.scoring_inputs(series, labels_, membership, "val", cuts))  # label- and object-sized
    for x in thresholds:
        inside = partition.detections_in_era(detect_at(series, x), membership, "val", cuts)
        found[x] = inside.withColumn("epoch", F.floor(F.col("epoch_ns") / 1000)).withColumn("det_id", F.xxhash64("norad_id", "epoch_ns")).persist()
    best, by = tune(recalls(found, scored_labels, years), kind)
    at = best["threshold"]
    samples = calibrate.samples_of(bench.outcomes(found[at], scored_labels, bench.match(found[at], scored_labels), years))
    bundle = None if samples.isEmpty() else calibration_bundle(samples)
    for held in (scored_labels, years, *found.values()):
        held.unpersist()
    detector = lambda rows: detect_at(rows, at)
    return {"threshold": at, "value": best["value"], "by_class": by, "calibration": bundle}, detector if bundle is None else calibrated(detector, bundle)


class Board:
    """Submissions: five a user and UTC day, counted only if valid; aggregates only in what is shown.

    timing_floor: by class, what guessing from the times alone reaches, as the fixture document has it; it is published beside every result.
    """

    def __init__(self, per_day: int = 5, timing_floor: dict[str, float] | None = None):
        self.per_day, self.timing_floor, self.entries, self.used = per_day, dict(timing_floor or {}), [], Counter()

    def public_result(self, report: dict) -> dict:
        """All that a submitter is told of the hidden labels. The names of its fields are fixed values."""
        return {"operating_point_fa_per_sat_year": OPERATING_POINT, "headline_recall_above_floor": bench.headline(report), "timing_only_floor_auc": dict(self.timing_floor)}

    def seed(self, name: str, day: str, report: dict) -> int:
        """The place of a baseline that the board starts with: scored like any other, without a limit."""
        return self._placed(name, day, report, True)

    def submit(self, user: str, name: str, day: str, report: dict) -> int:
        if self.used[user, day] >= self.per_day:
            raise PermissionError(f"{user} has used the {self.per_day} submissions of {day}")
        place = self._placed(name, day, report, False)
        self.used[user, day] += 1
        return place

    def _placed(self, name: str, day: str, report: dict, seed: bool) -> int:
        shares = [(c["recall"], c["n_above"]) for c in report.values() if c["recall"] is not None]
        if not shares:
            raise ValueError("the report has no recall")
        pooled = sum(r * n for r, n in shares) / sum(n for _, n in shares)
        own = (-pooled, day, name, {c: v["recall"] for c, v in report.items()}, seed)
        self.entries.append(own)
        self.entries.sort(key=lambda e: e[:3])
        return next(i for i, e in enumerate(self.entries) if e is own) + 1

    def rows(self) -> list[dict]:
        return [{"place": i + 1, "name": e[2], "submitted_at": e[1], "recall": -e[0], "by_class": e[3], "seed": e[4]} for i, e in enumerate(self.entries)]
