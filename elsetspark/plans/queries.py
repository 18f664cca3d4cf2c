"""Driver queries of the engine's operators. Results are rounded for comparison only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import THRESHOLD
from ..functions import physics
from ..functions.stats import wilson
from ..operators import bench, calibrate, detect, evaluate, features, guards, labels, ordered, series
from ..sources import catalogue_source, fetch, landing, notices, omm, tle
from . import adapters as ad

RAD = math.pi / 180
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded half away from zero, and -0.0 as 0.0. In doubles, as F.round makes a decimal of every value; beyond 2 ** 52 there is nothing to round."""
    scale, x = float(10**places), F.col
    near = lambda c: F.when(F.abs(x(c)) * scale < 2.0**52, F.signum(x(c)) * F.floor(F.abs(x(c)) * scale + 0.5) / scale + 0.0).otherwise(x(c))
    return df.select(*[near(c).alias(c) if t == "double" else x(c) for c, t in df.dtypes])


# Series


@query
def proj_series(s: SparkSession, d: str) -> DataFrame:
    return rounded(series.assemble(ad.series_ev(s, d)).select("norad_id", "t", "semi_major_axis", "dt_days"))


@query
def pred_physical(s: SparkSession, d: str) -> DataFrame:
    return series.physical(ad.elsets_dup(s, d)).groupBy("norad_id").agg(F.count("*").alias("n"))


@query
def pred_in_range(s: SparkSession, d: str) -> DataFrame:
    ev = ad.series_ev(s, d).where(F.col("t").between(1_704_672_000_000_000, 1_705_276_800_000_000))
    return ev.groupBy("norad_id").agg(F.count("*").alias("n"), F.min("t").alias("first_t"))


@query
def src_fetch_result(s: SparkSession, d: str) -> DataFrame:
    """A week of elements as a fetch returns them, here out of an old copy."""
    got = fetch.result(ad.series_ev(s, d), "history", F.lit(1_704_931_200_000_000), 1_704_672_000_000_000, 1_705_276_800_000_000, stale=True)
    return got.select("norad_id", "t", "a", "source", (F.col("t") > F.col("fetched_at")).alias("after_fetch"), "stale")


@query
def pred_non_finite(s: SparkSession, d: str) -> DataFrame:
    """Events as a series in which every 17th semi-major axis is not a number, every 19th eccentricity null, every 23rd inclination infinite."""
    i, rows = F.col("event_id"), ad.series_ev(s, d)
    spoiled = rows.withColumns({"a": F.when(i % 17 == 0, F.lit(float("nan"))).otherwise(F.col("a")), "e": F.when(i % 19 != 0, F.col("e")), "inc": F.when(i % 23 == 0, F.lit(float("inf"))).otherwise(F.col("inc"))})
    return guards.non_finite(spoiled)


@query
def src_catalogue(s: SparkSession, d: str) -> DataFrame:
    """Events landed as one answer an object, then read by the data source with bounds of the epoch in its requests."""
    ev, us = ad.read(s, d, "events"), ad.micros("ts")
    fields = {"NORAD_CAT_ID": F.col("user_id"), "EPOCH": F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "MEAN_MOTION": F.lit(15) + F.col("event_id") % 1000 / 1000, "ECCENTRICITY": F.lit(0.001), "INCLINATION": F.lit(66), "RA_OF_ASC_NODE": F.col("event_id") % 360, "ARG_OF_PERICENTER": F.lit(90), "MEAN_ANOMALY": F.lit(10), "BSTAR": F.lit(0.0001), "MEAN_MOTION_DOT": F.lit(0), "MEAN_MOTION_DDOT": F.lit(0), "REV_AT_EPOCH": F.col("event_id")}
    record = F.to_json(F.struct(*[v.cast("string").alias(k) for k, v in fields.items()]))
    path = ordered.shared_folder(s)
    answers = ev.groupBy(F.col("user_id").alias("norad_id")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(record)), ","), F.lit("]")).alias("value"))
    catalogue_source.land(answers, path)
    found = catalogue_source.read(s, "spacetrack", path=path).where((F.col("t") >= ad.BURN) & (F.col("t") < ad.BURN + 5 * 86_400_000_000))
    return rounded(catalogue_source.elsets(found).select("norad_id", "t", "mean_motion", "raan", "rev_at_epoch", F.regexp_extract("request", "EPOCH/([^/]*)/", 1).alias("epoch"), "stale"))


def _snapshots(s: SparkSession, d: str) -> DataFrame:
    """Each event a snapshot of its user, in turn from two sources; every seventh is cut off, every eleventh no array."""
    i = F.col("event_id")
    body = F.when(i % 7 == 0, F.concat(F.lit('[{"EVENT": '), i.cast("string"))).when(i % 11 == 0, F.lit("{}")).otherwise(F.concat(F.lit('[{"EVENT": '), i.cast("string"), F.lit("}]")))
    return ad.read(s, d, "events").select(F.when(i % 2 == 0, "spacetrack").otherwise("celestrak").alias("source"), F.col("user_id").alias("norad_id"), ad.micros("ts").alias("fetched_at"), body.alias("payload"))


@query
def src_landing_as_of(s: SparkSession, d: str) -> DataFrame:
    return landing.as_of(_snapshots(s, d), ad.BURN)


@query
def src_landing_served(s: SparkSession, d: str) -> DataFrame:
    """Every customer asked of either source; answers by their number: new, unchanged, failed, cut off or none."""
    key = F.col("c_custkey")
    asked = ad.read(s, d, "customer").select(F.explode(F.array(F.lit("spacetrack"), F.lit("celestrak"))).alias("source"), key.alias("norad_id"))
    k = F.col("norad_id") % 5
    status = F.when(k.isin(0, 3), 200).when(k == 1, 304).otherwise(503)
    answers = asked.where(k < 4).select("source", "norad_id", status.alias("status"), F.when(k == 0, F.concat(F.lit('[{"NEW": '), F.col("norad_id").cast("string"), F.lit("}]"))).otherwise("[cut").alias("payload"))
    return landing.served(_snapshots(s, d), asked, answers, ad.BURN)


@query
def txt_epoch_predicate(s: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey") % 4, ad.micros("o_orderdate")
    lo, hi = F.when(k.isin(0, 1), day), F.when(k.isin(0, 2), day + 36 * 3_600_000_000)
    return ad.read(s, d, "orders").select("o_orderkey", fetch.epoch_predicate(lo, hi).alias("predicate"))


@query
def agg_dedup_epoch(s: SparkSession, d: str) -> DataFrame:
    return rounded(series.dedup_epoch(ad.elsets_dup(s, d)).select("norad_id", "t", "mean_motion", "element_set_no"))


@query
def agg_clean(s: SparkSession, d: str) -> DataFrame:
    return rounded(series.assemble(series.clean(ad.elsets_dup(s, d))).select("norad_id", "t", "semi_major_axis", "dt_days"))


@query
def win_regularize_daily(s: SparkSession, d: str) -> DataFrame:
    return series.regularize_daily(ad.series_ev(s, d)).select("norad_id", "t", "event_id")


@query
def win_unwrap(s: SparkSession, d: str) -> DataFrame:
    return rounded(detect.prepared(ad.series_ev(s, d)).select("norad_id", "t", "idx", "t_days", "raan"))


@query
def proj_orbit_class(s: SparkSession, d: str) -> DataFrame:
    return ad.series_ev(s, d).groupBy("norad_id").agg(physics.orbit_class(F.median(F.col("a") * (1 + F.col("norad_id") % 3 * 2.6))).alias("orbit_class"))


@query
def win_local_step(s: SparkSession, d: str) -> DataFrame:
    return rounded(series.local_steps(detect.prepared(ad.series_ev(s, d))).select("norad_id", "idx", "step_a", "step_inc"))


@query
def win_local_trend(s: SparkSession, d: str) -> DataFrame:
    rows = series.indexed(ad.series_ev(s, d))
    return rounded(rows.select("norad_id", "idx", series.local_trend(rows, "a").alias("trend_a")))


@query
def agg_mad_scale(s: SparkSession, d: str) -> DataFrame:
    gaps = series.scaled(series.local_steps(detect.prepared(ad.series_ev(s, d))))
    return rounded(gaps.groupBy("norad_id").agg(F.first("scale_a").alias("scale_a"), F.first("scale_inc").alias("scale_inc")))


@query
def det_candidates(s: SparkSession, d: str) -> DataFrame:
    gaps = detect.candidates(detect.scored_gaps(detect.prepared(ad.series_ev(s, d))))
    return rounded(gaps.select("norad_id", "idx", "channel", "significance"), 4)


@query
def fn_transient(s: SparkSession, d: str) -> DataFrame:
    return detect.scored_gaps(detect.prepared(ad.series_ev(s, d))).select("norad_id", "idx", "channel", "transient")


@query
def topk_nms(s: SparkSession, d: str) -> DataFrame:
    gaps = detect.scored_gaps(detect.prepared(ad.series_ev(s, d)))
    return detect.suppress_neighbours(detect.candidates(gaps, THRESHOLD / 4)).select("norad_id", "idx")


@query
def win_holt(s: SparkSession, d: str) -> DataFrame:
    return rounded(series.holt(series.indexed(ad.series_ev(s, d)), ("a", "inc")).select("norad_id", "idx", "level_a", "level_inc"))


@query
def fn_invert(s: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    rows = ad.series_ev(s, d).select("event_id", *[f.alias(c) for c, f in physics.invert((i % 41 - 20) * F.lit(0.1), (i % 7 - 3) * F.lit(1e-4), (i % 5 - 2) * F.lit(1e-5), (i % 3 - 1) * F.lit(1e-5), F.col("a"), F.col("e"), F.col("inc") * RAD, F.col("raan") * RAD).items()])
    return rounded(rows)


@query
def fn_gauss_round_trip(s: SparkSession, d: str) -> DataFrame:
    """In-track impulses put through the forward model and recovered from the element steps."""
    i = F.col("event_id")
    zero = F.lit(0.0)
    rows = ad.series_ev(s, d).withColumn("dv", (i % 41 + 1) * F.lit(1e-4))
    g = physics.gauss_forward(zero, F.col("dv"), zero, F.lit(0.7), F.col("a"), F.lit(0.0), F.lit(1.0), zero)
    got = physics.invert(g["da"], g["de"], g["di"], g["draan"], F.col("a"), F.lit(0.0), F.lit(1.0), zero)
    return rounded(rows.select("event_id", (F.col("dv") * 1000).alias("dv_ms"), got["in_track_ms"].alias("in_track_ms")), 5)


@query
def fn_invert_located(s: SparkSession, d: str) -> DataFrame:
    """In-plane inversion with a known true anomaly, and without one in every third row."""
    i, zero = F.col("event_id"), F.lit(0.0)
    nu = F.when(i % 3 != 0, (i % 63) * F.lit(0.1))
    got = physics.invert((i % 41 - 20) * F.lit(0.1), (i % 7 - 3) * F.lit(1e-4), zero, zero, F.col("a"), (i % 20) * F.lit(0.04), F.lit(1.0), zero, nu)
    return rounded(ad.series_ev(s, d).select("event_id", *[got[c].alias(c) for c in ("radial_ms", "in_track_ms")]), 5)


@query
def fn_orbit(s: SparkSession, d: str) -> DataFrame:
    orbit = physics.orbit(F.col("a"), F.col("e"), F.col("inc") * RAD, F.col("argp") * RAD)
    rows = ad.series_ev(s, d).select("event_id", orbit.alias("o"))
    return rounded(rows.select("event_id", "o.p", "o.h", (F.col("o.mean_motion") * 1e4).alias("rate")))


@query
def fn_j2_rates(s: SparkSession, d: str) -> DataFrame:
    rates = physics.j2_rates(F.col("a"), F.col("e"), F.col("inc") * RAD)
    return rounded(ad.series_ev(s, d).select("event_id", *[(v * 1e7).alias(k) for k, v in rates.items()]))


@query
def fn_speeds(s: SparkSession, d: str) -> DataFrame:
    a, e = F.col("a"), F.col("e")
    return rounded(ad.series_ev(s, d).select("event_id", (physics.mean_motion(a) * 1e3).alias("n_mrad_s"), physics.circular_speed(a).alias("v_circular"), physics.orbital_speed(a, physics.radius_at(a, e, F.col("raan") * RAD)).alias("v")))


@query
def agg_object_floor(s: SparkSession, d: str) -> DataFrame:
    rows = detect.prepared(ad.series_ev(s, d))
    return rounded(detect.object_floors(series.scaled(series.local_steps(rows))), 5)


@query
def detect_rule(s: SparkSession, d: str) -> DataFrame:
    return rounded(detect.detect_rule(ad.series_ev(s, d)), 4)


@query
def fc_drift(s: SparkSession, d: str) -> DataFrame:
    return rounded(detect.drift_scores(ad.series_ev(s, d)).select("norad_id", "idx", "z"), 4)


@query
def win_run_peak(s: SparkSession, d: str) -> DataFrame:
    return rounded(detect.run_peaks(detect.drift_scores(ad.series_ev(s, d)), 2.0).select("norad_id", "idx", "z"), 4)


@query
def det_residual(s: SparkSession, d: str) -> DataFrame:
    peaks = detect.run_peaks(detect.drift_scores(ad.series_ev(s, d)), 4.0)
    return rounded(peaks.select("norad_id", "t", physics.residual_confidence(F.col("z"), 4.0).alias("confidence")), 5)


# Labels


@query
def join_label_gap(s: SparkSession, d: str) -> DataFrame:
    return labels.map_to_gaps(ad.labels_ev(s, d), ad.series_ev(s, d, quiet=True)).select("label_id", "t0", "t1", "tol_start", "tol_end")


@query
def join_label_unmatched(s: SparkSession, d: str) -> DataFrame:
    return labels.unmatched(ad.labels_ev(s, d).where("norad_id is not null"), ad.series_ev(s, d, quiet=True)).select("label_id", "norad_id")


@query
def agg_coverage(s: SparkSession, d: str) -> DataFrame:
    return labels.coverage(ad.labels_ev(s, d))


@query
def txt_coverage(s: SparkSession, d: str) -> DataFrame:
    return labels.coverage_lines(labels.coverage(ad.labels_ev(s, d)))


@query
def lab_geo_self(s: SparkSession, d: str) -> DataFrame:
    return labels.derive_geo(ad.series_ev(s, d))


@query
def lab_heo_self(s: SparkSession, d: str) -> DataFrame:
    return labels.derive_heo(ad.series_ev(s, d).withColumns({"a": F.col("a") * 1000, "e": F.when(F.col("event_id") % 29 == 0, F.col("e") + 0.01).otherwise(F.col("e"))}))


@query
def pred_above_floor(s: SparkSession, d: str) -> DataFrame:
    return ad.scored_labels(s, d).select("label_id", "above_floor")


# Benchmark


def _scored(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    dets, labs, exposure = ad.detections_ev(s, d), ad.scored_labels(s, d), ad.exposure_ev(s, d)
    return bench.outcomes(dets, labs, bench.match(dets, labs), exposure), labs, exposure


@query
def join_match(s: SparkSession, d: str) -> DataFrame:
    return bench.match(ad.detections_ev(s, d), ad.scored_labels(s, d))


@query
def win_budget_walk(s: SparkSession, d: str) -> DataFrame:
    return bench.ranked(_scored(s, d)[0]).select("orbit_class", "rank", "det_id", "outcome", "cum_fp")


@query
def bench_class_counts(s: SparkSession, d: str) -> DataFrame:
    return rounded(bench.class_counts(*_scored(s, d)), 5)


@query
def bench_class_metrics(s: SparkSession, d: str) -> DataFrame:
    scored, labs, exposure = _scored(s, d)
    points = bench.budget_points(scored, bench.class_counts(scored, labs, exposure))
    return rounded(points.select("orbit_class", "rate", "tp_above", "tp_below", "fp", "recall", "recall_lo", "recall_hi", "precision", "precision_lo", "precision_hi", "full_recall", "cut_confidence"))


@query
def agg_confusion(s: SparkSession, d: str) -> DataFrame:
    scored, labs, exposure = _scored(s, d)
    return bench.confusion(scored, bench.class_counts(scored, labs, exposure))


@query
def agg_pooled_recall(s: SparkSession, d: str) -> DataFrame:
    scored, labs, exposure = _scored(s, d)
    p = bench.budget_points(scored, bench.class_counts(scored, labs, exposure), (1.0,))
    return rounded(p.agg(F.coalesce(F.sum("tp_above") / F.sum("n_above"), F.lit(0.0)).alias("pooled"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("macro")))


@query
def fn_wilson(s: SparkSession, d: str) -> DataFrame:
    ev = ad.read(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("hits"), F.count("*").alias("total"))
    lo, hi = wilson(F.col("hits"), F.col("total"), 0.95)
    return rounded(ev.select("user_id", lo.alias("lo"), hi.alias("hi")))


@query
def bench_temporal_eras(s: SparkSession, d: str) -> DataFrame:
    lab = ad.labels_ev(s, d)
    cuts = bench.era_cuts(lab)
    return lab.select("label_id", bench.era(F.col("window_start"), *cuts, guard_days=1).alias("era"))


@query
def win_overlap_islands(s: SparkSession, d: str) -> DataFrame:
    return bench.overlap_islands(ad.labels_ev(s, d)).select("label_id", "island")


@query
def graph_components(s: SparkSession, d: str) -> DataFrame:
    lab = ad.labels_ev(s, d).withColumn("window_end", F.col("window_start") + 60_000_000)
    return bench.overlap_components(lab)


@query
def fn_tiebreak(s: SparkSession, d: str) -> DataFrame:
    return ad.read(s, d, "customer").select("c_custkey", F.sha2(F.concat(F.lit("0:"), F.col("c_custkey").cast("string")), 256).alias("tiebreak"))


@query
def agg_split_counts(s: SparkSession, d: str) -> DataFrame:
    split = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("norad_id") % 3 + 1).cast("int"))
    lab = ad.labels_ev(s, d).where("norad_id is not null").withColumn("split", split)
    agg = lab.groupBy("split", "orbit_class").agg(F.countDistinct("norad_id").alias("n_objects"), F.count("*").alias("n_events"))
    dim = labels.class_dim(lab).select("orbit_class", F.explode(F.array(F.lit("train"), F.lit("val"), F.lit("test"))).alias("split"))
    return dim.join(agg, ["split", "orbit_class"], "left").fillna(0, ["n_objects", "n_events"])


@query
def join_manifest_verify(s: SparkSession, d: str) -> DataFrame:
    o = ad.read(s, d, "orders")
    digest = lambda rows: rows.groupBy(F.col("o_custkey").alias("norad_id")).agg(F.count("*").alias("n_elsets"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ","), 256).alias("sha256"))
    return bench.manifest_verify(digest(o.where("o_orderkey % 97 <> 0 and o_custkey % 50 <> 0")), digest(o.where("o_custkey % 41 <> 0")))


@query
def agg_digest(s: SparkSession, d: str) -> DataFrame:
    o = ad.read(s, d, "orders")
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ","), 256).alias("sha256"))


@query
def sort_board(s: SparkSession, d: str) -> DataFrame:
    entries = ad.read(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("name"), (F.col("s_suppkey") % 7 / 7).alias("recall"), (F.col("s_suppkey") % 5).alias("submitted_at"))
    return rounded(bench.board(entries))


# Features


@query
def feat_channels(s: SparkSession, d: str) -> DataFrame:
    return rounded(features.channels(ad.series_ev(s, d)).drop("t"))


@query
def feat_windows(s: SparkSession, d: str) -> DataFrame:
    """All 64 positions of every window, padded past the end, with the validity mask."""
    rows = features.padded_windows(series.indexed(ad.series_ev(s, d)).select("norad_id", "idx"))
    return rows.select("norad_id", *[F.col(c).cast("long").alias(c) for c in ("window_id", "position", "idx")], "valid")


@query
def agg_class_quartiles(s: SparkSession, d: str) -> DataFrame:
    return rounded(features.class_quartiles(features.channels(ad.series_ev(s, d))), 5)


@query
def win_overlap_average(s: SparkSession, d: str) -> DataFrame:
    rows = features.token_windows(series.indexed(ad.series_ev(s, d)).select("norad_id", "idx"))
    return rounded(rows.groupBy("norad_id", F.col("idx").cast("long").alias("idx")).agg(F.avg(1 / (1 + F.col("window_id") + F.col("position"))).alias("p")))


# Calibration


@query
def agg_reliability(s: SparkSession, d: str) -> DataFrame:
    return rounded(calibrate.reliability(calibrate.guarded(ad.samples_ev(s, d)), "orbit_class"))


@query
def agg_ece(s: SparkSession, d: str) -> DataFrame:
    return rounded(calibrate.ece(ad.samples_ev(s, d), "orbit_class"))


@query
def agg_brier(s: SparkSession, d: str) -> DataFrame:
    return rounded(calibrate.brier(ad.samples_ev(s, d), "orbit_class"))


@query
def calib_conformal(s: SparkSession, d: str) -> DataFrame:
    return rounded(calibrate.conformal_quantile(ad.samples_ev(s, d)))


@query
def calib_temperature(s: SparkSession, d: str) -> DataFrame:
    """Fitted on the driver's samples, then applied; Newton steps have no short SQL form."""
    t = calibrate.fit_temperature(ad.samples_ev(s, d))
    return rounded(ad.samples_ev(s, d).groupBy("orbit_class").agg(F.avg(calibrate.apply_temperature(F.col("confidence"), t)).alias("mean_calibrated")))


@query
def fn_temperature(s: SparkSession, d: str) -> DataFrame:
    return rounded(ad.read(s, d, "events").select("event_id", calibrate.apply_temperature(F.col("value") / (F.col("value") + 50), 2.0).alias("p")))


@query
def tune_threshold(s: SparkSession, d: str) -> DataFrame:
    scores = detect.drift_scores(ad.series_ev(s, d))
    grid = scores.select("*", F.explode(F.array(*[F.lit(x / 2) for x in range(2, 13)])).alias("threshold"))
    values = grid.groupBy("threshold").agg((F.sum((F.col("z") >= F.col("threshold")).cast("int")) % 17).cast("double").alias("value"))
    return rounded(calibrate.best_thresholds(values))


@query
def tune_recall(s: SparkSession, d: str) -> DataFrame:
    """Above-floor recall of each class at every threshold of the residual score; the best thresholds are evaluate.tune's."""
    scores, labs, exposure = detect.drift_scores(ad.series_ev(s, d)), ad.scored_labels(s, d), ad.exposure_ev(s, d)
    found = {}
    for x in (2.0, 3.0, 4.0):
        peaks = detect.run_peaks(scores, x)
        found[x] = peaks.select(F.xxhash64("norad_id", "t").alias("det_id"), "norad_id", F.col("t").alias("epoch"), physics.residual_confidence(F.col("z"), x).alias("confidence"), F.lit("in-track").alias("type"))
    return rounded(evaluate.recalls(found, labs, exposure))


LEVELS = (0.2, 0.5, 0.8)


def _points(s: SparkSession, d: str) -> DataFrame:
    found, labs, exposure = ad.detections_ev(s, d), ad.scored_labels(s, d), ad.exposure_ev(s, d)
    return evaluate.recalls({x: found.where(F.col("confidence") >= x) for x in LEVELS}, labs, exposure)


@query
def tune_points(s: SparkSession, d: str) -> DataFrame:
    """Recall of each class at the operating point, of the detections at or above each level of confidence."""
    return rounded(_points(s, d).withColumns({c: F.col(c).cast("long") for c in ("tp_above", "n_above")}))


@query
def tune_best(s: SparkSession, d: str) -> DataFrame:
    """Level with the best recall over all labels (class null), and of each class with above-floor labels."""
    points = _points(s, d)
    own = points.where("recall is not null").select("orbit_class", "threshold", F.col("recall").alias("value"))
    every = evaluate.objective(points).select(F.lit(None).cast("string").alias("orbit_class"), "threshold", "value")
    return rounded(calibrate.best_thresholds(every.unionByName(own), "orbit_class"))


# Sources


def _order_text(s: SparkSession, d: str) -> DataFrame:
    return ad.read(s, d, "orders").select("o_orderkey", "o_custkey")


@query
def src_tle_checksum(s: SparkSession, d: str) -> DataFrame:
    line = F.rpad(F.concat(F.lit("1 "), F.lpad(F.col("o_custkey").cast("string"), 5, "0"), F.lit("U 98067A   -"), F.col("o_orderkey").cast("string"), F.lit("-")), 68, " ")
    return _order_text(s, d).select("o_orderkey", tle.checksum(line).cast("long").alias("checksum"))


@query
def src_tle_pair(s: SparkSession, d: str) -> DataFrame:
    """Line pairs written from orders and parsed back."""
    k, n = F.col("o_orderkey"), F.lpad(F.pmod("o_custkey", F.lit(100000)).cast("string"), 5, "0")
    day = F.concat(F.lpad((k % 365 + 1).cast("string"), 3, "0"), F.lit(".50000000"))
    one = F.concat(F.lit("1 "), n, F.lit("U 98067A   24"), day, F.lit("  .00001234  00000-0  12345-4 0  999"))
    two = F.concat(F.lit("2 "), n, F.lit("  51.6400 208.9000 "), F.lpad((k % 9999999).cast("string"), 7, "0"), F.lit(" 120.0000 240.0000 15.50000000 1234"))
    whole = lambda c: F.concat(F.rpad(c, 68, " "), tle.checksum(F.rpad(c, 68, " ")).cast("string"))
    lines = tle.held(_order_text(s, d).repartition("o_orderkey"), one.alias("one"), two.alias("two")).select(whole(F.col("one")).alias("line1"), whole(F.col("two")).alias("line2"))
    return rounded(tle.parse(lines).select("norad_id", "t", "eccentricity", "mean_motion", F.col("bstar").alias("bstar"), "object_id"), 9)


@query
def src_omm(s: SparkSession, d: str) -> DataFrame:
    """One message a customer, written as JSON and parsed back."""
    k = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit('[{"NORAD_CAT_ID":"'), F.col("o_custkey").cast("string"), F.lit('","EPOCH":"2024-01-0'), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit('T12:00:00.25Z","MEAN_MOTION":15.5,"ECCENTRICITY":0.0001,"INCLINATION":51.64,"RA_OF_ASC_NODE":90,"ARG_OF_PERICENTER":80,"MEAN_ANOMALY":270,"BSTAR":0.00018,"MEAN_MOTION_DOT":0.0001,"MEAN_MOTION_DDOT":0,"REV_AT_EPOCH":'), k, F.lit("}]"))
    return omm.parse_payload(_order_text(s, d).select(text.alias("value"))).select("norad_id", "t", "rev_at_epoch", "element_set_no", "classification", "object_id")


@query
def txt_nanu(s: SparkSession, d: str) -> DataFrame:
    """Notices written from orders: day of year k % 360 + 1, sent on 20 December 2023."""
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "FCSTDV").otherwise("UNUSUFN")
    day = lambda x: F.lpad((x % 360 + 1).cast("string"), 3, "0")
    text = F.concat(F.lit("1. NANU TYPE: "), kind, F.lit("\n   NANU NUMBER: "), k.cast("string"), F.lit("\n   NANU DTG: 201530Z DEC 2023\n   SVN: "), (k % 80).cast("string"), F.lit("\n   START JDAY: "), day(k), F.lit("\n   START TIME ZULU: 0130\n   STOP JDAY: "), day(k + 1), F.lit("\n   STOP TIME ZULU: 1330\n"))
    return notices.nanu(_order_text(s, d).select(text.alias("text"))).select("code", "number", "window_start", "window_end", "epoch")


@query
def txt_nagu(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.lpad((k % 28 + 1).cast("string"), 2, "0")
    text = F.concat(F.lit("NAGU TYPE: "), F.when(k % 4 == 0, "PLN_MANV").otherwise("GENERAL"), F.lit("\nNAGU NUMBER: "), k.cast("string"), F.lit("\nSTART DATE EVENT (UTC): 2023-05-"), day, F.lit(" 10:20\nEND DATE EVENT (UTC): 2023-06-"), day, F.lit(" 11:00\nSATELLITE AFFECTED: GSAT"), (k % 50).cast("string"), F.lit("\n"))
    return notices.nagu(_order_text(s, d).select(text.alias("text"))).select("code", "number", "window_start", "window_end", "epoch")


@query
def txt_navsum(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Spacecraft : GOES-"), k.cast("string"), F.lit("\r\n last maneuver on 23/"), (k % 365 + 1).cast("string"), F.lit("\r\n=====\r\nSpacecraft : GOES-1\r\n no footer\r\n"))
    return notices.navsum(_order_text(s, d).select(text.alias("text"))).select("code", "window_start", "window_end", "epoch")


@query
def txt_qzss(s: SparkSession, d: str) -> DataFrame:
    """Two burns of one day and a null row in every file."""
    k = F.col("o_orderkey")
    day = F.concat(F.lit("2023-03-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))
    burn = lambda h, mark, x: F.concat(day, F.lit(f" {h}:00:00,"), day, F.lit(f" {h}:10:00,600,{mark},{x},0.0,0.4\n"))
    text = F.concat(F.lit("#+SATELLITE/ATTITUDE\n1,2\n#-SATELLITE/ATTITUDE\n#+SATELLITE/MANEUVER\n# head\n"), burn("04", "EW", "0.3"), burn("09", "NS", "3.0"), F.lit("0000-00-00 00:00:00,0000-00-00 00:00:00,0,NS,0,0,0\n#-SATELLITE/MANEUVER\n"))
    files = _order_text(s, d).select(k.cast("string").alias("code"), text.alias("text"))
    return rounded(notices.burn_events(notices.qzss_burns(files)))


@query
def txt_doris(s: SparkSession, d: str) -> DataFrame:
    """One burn a line in 2018 (37 leap seconds), a window-only line for every fifth."""
    k = F.col("o_orderkey")
    day = (k % 360 + 1).cast("string")
    window = F.concat(F.lit("JASO2 2018 "), day, F.lit(" 10 00 2018 "), day, F.lit(" 11 00"))
    burn = F.concat(F.lit(" 006 1 2018 "), day, F.lit(" 10 30 15.5 60.0 "), (k % 7).cast("string"), F.lit(".5 -0.25 "), (k % 3).cast("string"), F.lit(".0 0 0 0 0 0 0"))
    files = _order_text(s, d).select(F.concat(F.lit("# head\n\n"), F.when(k % 5 == 0, window).otherwise(F.concat(window, burn))).alias("text"))
    return rounded(notices.doris(files))


@query
def win_burn_events(s: SparkSession, d: str) -> DataFrame:
    """Campaigns over the purchases of each user."""
    lab = ad.labels_ev(s, d).where("norad_id is not null")
    burns = lab.select(F.col("norad_id").alias("code"), F.col("label_id").alias("seq"), F.col("window_start").alias("start"), F.col("window_end").alias("end"), F.coalesce("delta_v", F.lit(0.0)).alias("magnitude"), F.when(F.col("maneuver_type") == "in-track", "EW").otherwise("NS").alias("marker"))
    return rounded(notices.burn_events(burns).drop("epoch"))


@query
def join_crosswalk(s: SparkSession, d: str) -> DataFrame:
    lab = ad.labels_ev(s, d).select("label_id", F.coalesce(F.col("norad_id"), F.lit(-1)).alias("code"))
    dim = ad.read(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("code"), F.col("c_custkey").alias("norad_id"))
    return notices.crosswalk(lab, dim).select("label_id", "norad_id")
