"""Driver queries of sequence models, splits and partitions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physics
from ..operators import bench, calibrate, dataset, detect, features, labels, learned, ordered, partition, sequence, series
from ..sources import catalogue, landed
from . import adapters as ad
from .oracle import CHAN, DAY, DETECT, DRIFT, ELEMENT_CHANNELS, ELS, EV, FLAG_CHANNELS, FLOORS, LAB, RAD, SAMPLES, SCORED, TIME_CHANNELS, TYPE, indexed, invert, peaks, rnd
from .oracle import SQL as ENGINE_SQL
from .queries import _scored, rounded

QUERIES: dict = {}
GUARD = 1  # days: the driver's events span a month


def query(f):
    QUERIES[f.__name__] = f
    return f


def membership(s: SparkSession, d: str) -> DataFrame:
    """Objects but every seventh, dealt to the splits by their number."""
    split = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("norad_id") % 3 + 1).cast("int"))
    return ad.series_ev(s, d).select("norad_id").distinct().where("norad_id % 7 <> 0").withColumn("split", split)


def recipe(s: SparkSession, d: str) -> DataFrame:
    k = F.col("norad_id")
    day = 86_400_000_000
    ids = ad.series_ev(s, d).select("norad_id").distinct()
    classes = F.element_at(F.array(*[F.lit(c) for c in bench.ORBIT_CLASSES]), (k % 4 + 1).cast("int"))
    return ids.select("norad_id", F.when(k % 4 != 0, ad.BURN - 5 * day).alias("start"), F.when(k % 3 != 0, ad.BURN + 7 * day).alias("end"), classes.alias("orbit_class"))


def stand_in(tokens: DataFrame) -> DataFrame:
    """A fixed formula in the place of a trained network."""
    x = F.abs(F.col("dlt_a").cast("double")) + F.abs(F.col("dlt_sin_i").cast("double")) - 3
    return tokens.select("norad_id", "idx", (calibrate.sigmoid(x) * (1 - F.col("position") / 1000)).alias("p"))


def _peaks(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    encoded = ordered.kept(features.channels(ad.series_ev(s, d)))
    rows = learned.aligned_elements(encoded)
    scored = learned.probabilities(encoded, features.class_quartiles(encoded, stored=True), stand_in)
    scored = scored.join(rows.select("norad_id", "idx", "t", "orbit_class"), ["norad_id", "idx"])
    return rows, learned.gated_peaks(scored, {"LEO": 0.6}, 0.5)


@query
def det_learned_peaks(s: SparkSession, d: str) -> DataFrame:
    return rounded(_peaks(s, d)[1].select("norad_id", "idx", "t", "p"), 4)


@query
def det_learned_invert(s: SparkSession, d: str) -> DataFrame:
    """Steps and median orbits around every gap, the ends of a series included."""
    found = learned.around(learned.aligned_elements(features.levels(ad.series_ev(s, d))))
    got = learned.inverted(found)
    return rounded(found.select("norad_id", "idx", "width", (F.col("step_a") * 100).alias("step_a"), (F.col("ref_a") * 100).alias("ref_a"), (F.col("ref_e") * 1000).alias("ref_e"), got["in_track_ms"].alias("in_track_ms"), got["cross_track_ms"].alias("cross_track_ms")), 4)


@query
def det_residual_invert(s: SparkSession, d: str) -> DataFrame:
    """Peaks of the drift forecast's residual at a threshold a class, and the velocity change over each."""
    ser = ad.series_ev(s, d)
    rows = learned.aligned_elements(features.levels(ser))
    peaks = learned.residual_peaks(ser, rows, {"LEO": 5.0}, 4.0)
    found = learned.around(rows, peaks)
    got = learned.inverted(found)
    out = found.select("norad_id", "idx", (F.col("step_a") * 100).alias("step_a"), got["in_track_ms"].alias("in_track_ms"), got["cross_track_ms"].alias("cross_track_ms"))
    return rounded(out.join(peaks.select("norad_id", "idx", F.col("p").alias("confidence")), ["norad_id", "idx"]), 4)


@query
def src_landed_labels(s: SparkSession, d: str) -> DataFrame:
    """Labels of two archives written from orders (GPS notices, GOES summaries of one day each), resolved by the pinned recipe."""
    k = F.col("o_orderkey")
    day = lambda x: F.lpad((x % 300 + 60).cast("string"), 3, "0")
    gps = F.concat(F.lit("NANU TYPE: FCSTDV\nNANU NUMBER: "), k.cast("string"), F.lit("\nNANU DTG: 010000Z FEB 2023\nSVN: "), (k % 90).cast("string"), F.lit("\nSTART JDAY: "), day(k), F.lit("\nSTART TIME ZULU: 0130\nSTOP JDAY: "), day(k), F.lit("\nSTOP TIME ZULU: 1330\n"))
    goes = F.concat(F.lit("Spacecraft : GOES-"), (k % 20).cast("string"), F.lit("\n last maneuver on 23/"), (k % 200 + 1).cast("string"), F.lit("\n"))
    orders = ad.read(s, d, "orders").select("o_orderkey")
    out = landed.all_labels({"GPS-NANU": orders.select(gps.alias("text")), "NOAA-GOES": orders.select(goes.alias("text"))})
    return out.select("norad_id", "epoch", "window_start", "window_end", "orbit_class", "source", "source_ref")


@query
def src_notice_sequence(s: SparkSession, d: str) -> DataFrame:
    """Numbers of each year up to the first long run of missing ones: a customer as a year, line counts as numbers."""
    found = ad.read(s, d, "orders").select(F.col("o_custkey").alias("year"), (F.col("o_orderkey") % 211 + 1).alias("seq")).distinct()
    return landed.in_sequence(found)


@query
def src_recipe(s: SparkSession, d: str) -> DataFrame:
    """The pinned objects of each class and label source beside the events of the class."""
    events = ad.samples_ev(s, d).groupBy("orbit_class").agg(F.count("*").alias("n_events"), F.sum("outcome").alias("n_hits"))
    pinned = catalogue.recipe(s).groupBy("orbit_class", "label_source").agg(F.count("*").alias("n"), F.min("norad_id").alias("first_id"), F.max("norad_id").alias("last_id"))
    return pinned.join(events, "orbit_class", "left")


def _entries(s: SparkSession, d: str) -> DataFrame:
    """An entry an object of events: every third from BURN on, every fifth up to it, the others whole; object 1000001 has no element sets."""
    i = F.col("norad_id")
    rows = ad.read(s, d, "events").select(F.col("user_id").alias("norad_id")).distinct().unionByName(s.createDataFrame([(1_000_001,)], "norad_id long"))
    return rows.withColumns({"label_source": F.lit("announced"), "start": F.when(i % 3 == 0, ad.BURN).cast("long"), "end": F.when((i % 5 == 0) & (i % 3 != 0), ad.BURN).cast("long")})


def _dataset(s: SparkSession, d: str) -> dataset.Dataset:
    named = ad.labels_ev(s, d).withColumn("source_ref", F.lit("event"))
    return dataset.rebuild(_entries(s, d), ad.elsets_dup(s, d), named, "1")


@query
def data_digest(s: SparkSession, d: str) -> DataFrame:
    """Digest of the canonical text of every object's cleaned element sets."""
    return dataset.series_digests(series.clean(ad.elsets_dup(s, d)))


@query
def data_rebuild(s: SparkSession, d: str) -> DataFrame:
    """Every label of the rebuilt dataset with its gap, or none."""
    built = _dataset(s, d)
    label = ("label_id", "norad_id", "epoch", "orbit_class", "source")
    return built.intervals.select(*label, "t0", "t1", "tol_start", "tol_end").unionByName(built.unmatched.select(*label), allowMissingColumns=True)


@query
def data_verify(s: SparkSession, d: str) -> DataFrame:
    """A manifest of all element sets as version 1 against the rebuilt one of their windows as version 2."""
    pinned = dataset.series_digests(series.clean(ad.elsets_dup(s, d)))
    return dataset.differences(pinned, "1", _dataset(s, d).digests, "2")


@query
def det_learned(s: SparkSession, d: str) -> DataFrame:
    rows = ad.series_ev(s, d)
    encoded = ordered.kept(features.channels(rows))
    return rounded(learned.detect_learned(rows, features.class_quartiles(encoded, stored=True), stand_in, {"LEO": 0.6}, encoded=encoded), 4)


NETWORK = sequence.Network(hidden_size=8, num_layers=1, dropout=0.0)


@query
def net_bilstm(s: SparkSession, d: str) -> DataFrame:
    """Probability of every token by a network with the weights that training starts from, averaged over its windows."""
    encoded = ordered.kept(features.channels(ad.series_ev(s, d)))
    scorer = sequence.scorer(NETWORK.start(7), NETWORK)
    return rounded(learned.probabilities(encoded, features.class_quartiles(encoded, stored=True), scorer))


@query
def train_bilstm(s: SparkSession, d: str) -> DataFrame:
    """Manoeuvres by a detector trained on seven objects in ten, with the epoch chosen by two more, on all objects."""
    rows = ad.series_ev(s, d)
    place = F.col("norad_id") % 10
    membership = rows.select("norad_id").distinct().withColumn("split", F.when(place < 7, "train").when(place < 9, "val").otherwise("test"))
    gaps = labels.map_to_gaps(ad.labels_ev(s, d), rows).select("norad_id", "t1")
    return sequence.fit_detector(rows, gaps, membership, NETWORK, sequence.Training(rate=0.02, positive_weight=4.0, epochs=2, batches=4)).detect(rows)


@query
def win_rolling_context(s: SparkSession, d: str) -> DataFrame:
    rows = learned.rolling_context(series.indexed(ad.series_ev(s, d)).select("norad_id", "idx", "a"), "a")
    n = F.size("context")
    total = F.aggregate("context", F.lit(0.0), lambda x, y: x + y)
    return rounded(rows.select("norad_id", "idx", n.cast("long").alias("n"), F.col("context")[0].alias("oldest"), F.element_at("context", -1).alias("latest"), total.alias("total")))


@query
def agg_median_orbit(s: SparkSession, d: str) -> DataFrame:
    rows = detect.prepared(ad.series_ev(s, d)).groupBy("norad_id").agg(*[F.first(f"m_{c}").alias(c) for c in ("a", "e", "inc", "argp")])
    return rounded(rows.select("norad_id", "a", physics.clamp_ecc(F.col("e")).alias("e"), physics.clamp_inc(F.col("inc") * F.lit(float(RAD))).alias("inc_rad"), "argp"), 8)


@query
def fn_standardise(s: SparkSession, d: str) -> DataFrame:
    encoded = ordered.kept(features.channels(ad.series_ev(s, d)))
    out = features.standardise(encoded, features.class_quartiles(encoded, stored=True))
    return rounded(out.select("norad_id", "idx", *[F.col(c).cast("double").alias(c) for c in features.CHANNELS]), 3)


@query
def fn_confidence(s: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(t) for t in ("in-track", "cross-track", "radial")]), (F.col("event_id") % 3 + 1).cast("int"))
    ev = ad.read(s, d, "events")
    return rounded(ev.select("event_id", physics.confidence(F.col("value"), kind).alias("rule"), physics.residual_confidence(F.col("value"), 40.0).alias("residual")))


@query
def fn_conformal_set(s: SparkSession, d: str) -> DataFrame:
    rows = ad.samples_ev(s, d)
    sets = rows.join(calibrate.conformal_quantile(rows).select("orbit_class", "q"), "orbit_class").select("orbit_class", F.array_join(calibrate.conformal_set(F.col("confidence"), F.col("q")), ",").alias("labels"))
    return sets.groupBy("orbit_class", "labels").agg(F.count("*").alias("n"))


@query
def calib_samples(s: SparkSession, d: str) -> DataFrame:
    rows = calibrate.samples_of(_scored(s, d)[0])
    return rounded(rows.groupBy("orbit_class").agg(F.count("*").alias("n"), F.sum("outcome").alias("hits"), F.avg("confidence").alias("mean_confidence")))


@query
def join_split_membership(s: SparkSession, d: str) -> DataFrame:
    return partition.members(ad.labels_ev(s, d), membership(s, d)).select("label_id", "split")


@query
def join_objects_by_split(s: SparkSession, d: str) -> DataFrame:
    rows = partition.members(ad.series_ev(s, d), membership(s, d))
    return rows.groupBy("split").agg(F.countDistinct("norad_id").alias("n_objects"), F.count("*").alias("n_rows"))


@query
def join_temporal_assign(s: SparkSession, d: str) -> DataFrame:
    lab = ad.labels_ev(s, d)
    return partition.assign(lab, membership(s, d), bench.era_cuts(lab), GUARD).select("label_id", "split")


@query
def eval_inputs(s: SparkSession, d: str) -> DataFrame:
    lab = ad.labels_ev(s, d)
    scored, _ = partition.scoring_inputs(ad.series_ev(s, d), lab, membership(s, d), "train", bench.era_cuts(lab), GUARD)
    return scored.select("label_id", "norad_id", "t0", "t1", "tol_start", "tol_end", "above_floor")


@query
def agg_exposure_years(s: SparkSession, d: str) -> DataFrame:
    lab = ad.labels_ev(s, d)
    _, years = partition.scoring_inputs(ad.series_ev(s, d), lab, membership(s, d), "train", bench.era_cuts(lab), GUARD)
    return rounded(years)


@query
def eval_detections(s: SparkSession, d: str) -> DataFrame:
    found = detect.detect_rule(ad.series_ev(s, d))
    cuts = bench.era_cuts(ad.labels_ev(s, d))
    return rounded(partition.detections_in_era(found, membership(s, d), "train", cuts, GUARD), 4)


@query
def join_token_target(s: SparkSession, d: str) -> DataFrame:
    rows = series.indexed(ad.series_ev(s, d)).select("norad_id", "t", "idx")
    gaps = labels.map_to_gaps(ad.labels_ev(s, d), ad.series_ev(s, d))
    return partition.token_targets(rows, gaps).select("norad_id", F.col("idx").cast("long").alias("idx"), "target")


@query
def agg_pos_weight(s: SparkSession, d: str) -> DataFrame:
    rows = series.indexed(ad.series_ev(s, d)).select("norad_id", "t", "idx")
    gaps = labels.map_to_gaps(ad.labels_ev(s, d), ad.series_ev(s, d))
    return rounded(partition.positive_weight(features.token_windows(partition.token_targets(rows, gaps))))


@query
def join_series_labels(s: SparkSession, d: str) -> DataFrame:
    return partition.scope(ad.labels_ev(s, d), recipe(s, d)).select("label_id", "norad_id")


@query
def agg_recipe_counts(s: SparkSession, d: str) -> DataFrame:
    return partition.recipe_counts(recipe(s, d))


@query
def set_merged_labels(s: SparkSession, d: str) -> DataFrame:
    lab = ad.labels_ev(s, d)
    return partition.merged_labels(*[lab.where(F.col("source") == f"src{k}") for k in range(4)], per_day=True).select("label_id", "norad_id", "source", "epoch")


def _minute(s: SparkSession, d: str) -> DataFrame:
    return ad.labels_ev(s, d).withColumn("window_end", F.col("window_start") + 60_000_000)


@query
def bench_splits(s: SparkSession, d: str) -> DataFrame:
    return partition.split_objects(_minute(s, d))


@query
def bench_splits_stratified(s: SparkSession, d: str) -> DataFrame:
    """The sums of squares over five classes and three splits have no short SQL form; tested against a plain fold."""
    return partition.split_objects(_minute(s, d), stratified=True)


@query
def bench_temporal_split(s: SparkSession, d: str) -> DataFrame:
    lab = ad.labels_ev(s, d)
    return partition.temporal_split_objects(lab, bench.era_cuts(lab), guard_days=GUARD)


@query
def pred_sgp4_sane(s: SparkSession, d: str) -> DataFrame:
    rows = series.valid(ad.elsets_dup(s, d))
    return rows.groupBy("norad_id").agg(F.count("*").alias("n"))


MEM = "mem AS (SELECT DISTINCT user_id AS norad_id, ['train', 'val', 'test'][CAST(user_id % 3 + 1 AS INTEGER)] AS split FROM events WHERE user_id % 7 <> 0)"
CUTS = """o AS (SELECT epoch, row_number() OVER (ORDER BY epoch) - 1 AS k, count(*) OVER () AS n FROM lab WHERE norad_id IS NOT NULL),
c AS (SELECT max(epoch) FILTER (WHERE k = least(CAST(floor(0.70::DOUBLE * n) AS BIGINT), n - 1)) AS c1, max(epoch) FILTER (WHERE k = least(CAST(floor(0.85::DOUBLE * n) AS BIGINT), n - 1)) AS c2 FROM o)"""


def era(x: str) -> str:
    return f"CASE WHEN {x} < c1 - {DAY} THEN 0 WHEN {x} > c1 + {DAY} AND {x} < c2 - {DAY} THEN 1 WHEN {x} > c2 + {DAY} THEN 2 END"


ERAS = f"{CUTS}, er AS (SELECT lab.*, {era('window_start')} AS era FROM lab, c WHERE norad_id IS NOT NULL AND {era('window_start')} = {era('window_end')})"
ASSIGNED = f"{MEM}, {ERAS}, asg AS (SELECT er.*, split FROM er JOIN mem USING (norad_id) WHERE era = CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END)"
SPANS = f"spans AS (SELECT norad_id, (max(t) - min(t)) / CAST(365.25 * {DAY} AS DOUBLE) AS observation_years, min(t) AS lo FROM ev JOIN mem USING (norad_id), c WHERE split = 'train' AND {era('t')} = 0 GROUP BY 1)"
QUART = "qt AS (SELECT orbit_class, " + ", ".join(f"quantile_cont({v}, [0.25, 0.5, 0.75]) AS q_{n}" for n, v in ELEMENT_CHANNELS.items()) + " FROM ch GROUP BY 1)"


def std(name: str, value: str) -> str:
    return f"CAST(CAST(({value} - q_{name}[2]) / greatest(q_{name}[3] - q_{name}[1], 1e-12) AS FLOAT) AS DOUBLE)"


WINDOWS = "unnest(range(greatest(CAST(floor((idx - 64) / 32) AS BIGINT) + 1, 0), idx // 32 + 1))"
TARGET = f"{EV}, {LAB}, {indexed('ev')}, gp AS (SELECT norad_id, t AS t0, lead(t) OVER (PARTITION BY norad_id ORDER BY t) AS t1 FROM ev), tg AS (SELECT DISTINCT gp.norad_id, t1 AS t FROM gp JOIN lab ON lab.norad_id = gp.norad_id AND epoch >= t0 AND epoch < t1), tk AS (SELECT ix.norad_id, ix.idx, CASE WHEN tg.t IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS target FROM ix LEFT JOIN tg ON tg.norad_id = ix.norad_id AND tg.t = ix.t)"


def side(c: str, where: str) -> str:
    slope = f"regr_slope({c}, t_days) FILTER (WHERE {where})"
    return f"(avg({c}) FILTER (WHERE {where}) + CASE WHEN isfinite({slope}) THEN coalesce({slope}, 0) ELSE 0 END * (any_value(mid) - avg(t_days) FILTER (WHERE {where})))"


def step(c: str) -> str:
    return f"CASE WHEN any_value(width) >= 2 THEN {side(c, 'off >= 0 AND off < width')} - {side(c, 'off < 0 AND off >= -width')} ELSE max({c}) FILTER (WHERE off = 0) - max({c}) FILTER (WHERE off = -1) END AS s_{c}"


AROUND = f"""{EV}, {indexed('ev')},
el AS (SELECT ix.norad_id, ix.idx, ix.n, ix.t_days, ev.a, ev.e, sin(ev.inc * {RAD}) AS sin_i, cos(ev.inc * {RAD}) AS cos_i, ev.e * cos(ev.argp * {RAD}) AS h, ev.e * sin(ev.argp * {RAD}) AS k,
  atan2(sin(ev.inc * {RAD}), cos(ev.inc * {RAD})) AS inc_rad, radians(ix.raan) AS raan_rad, (ix.t_days + lag(ix.t_days) OVER (PARTITION BY ix.norad_id ORDER BY ix.idx)) / 2 AS mid FROM ix JOIN ev USING (event_id)),
nr AS (SELECT g.norad_id, g.idx, el.idx - g.idx AS off, least(4, g.idx, g.n - g.idx) AS width, g.mid, el.* EXCLUDE (norad_id, idx, mid) FROM el g JOIN el ON el.norad_id = g.norad_id AND el.idx BETWEEN g.idx - 4 AND g.idx + 3 WHERE g.idx > 0),
ar AS (SELECT norad_id, idx, any_value(width) AS width, {", ".join(step(c) for c in ("a", "e", "inc_rad", "raan_rad"))}, {", ".join(f"median({c}) FILTER (WHERE off < 0) AS m_{c}" for c in ("a", "e", "sin_i", "cos_i", "h", "k"))} FROM nr GROUP BY 1, 2)"""

SQL = {
    "det_learned_peaks": f"""WITH {CHAN}, {QUART},
pr AS (SELECT norad_id, t, idx, orbit_class, 1 / (1 + exp(-least(greatest(abs({std('dlt_a', 'dlt_a')}) + abs({std('dlt_sin_i', 'dlt_sin_i')}) - 3, -700), 700))) AS p FROM ch JOIN qt USING (orbit_class)),
pw AS (SELECT norad_id, t, idx, orbit_class, avg(p * (1 - (idx - w * 32) / CAST(1000 AS DOUBLE))) AS p FROM (SELECT *, {WINDOWS} AS w FROM pr) GROUP BY 1, 2, 3, 4),
p0 AS (SELECT *, p >= CASE WHEN orbit_class = 'LEO' THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AND idx > 0 AS hit FROM pw),
p1 AS (SELECT *, CASE WHEN hit AND NOT coalesce(lag(hit) OVER (PARTITION BY norad_id ORDER BY idx), false) THEN 1 ELSE 0 END AS fresh FROM p0),
p2 AS (SELECT *, sum(fresh) OVER (PARTITION BY norad_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM p1)
SELECT norad_id, idx, t, {rnd('p', 4)} AS p FROM (SELECT *, row_number() OVER (PARTITION BY norad_id, run ORDER BY p DESC, idx) AS k FROM p2 WHERE hit) WHERE k = 1""",
    "det_learned_invert": f"WITH {AROUND} SELECT norad_id, idx, width, {rnd('s_a * 100', 4)} AS step_a, {rnd('m_a * 100', 4)} AS ref_a, {rnd('m_e * 1000', 4)} AS ref_e, {rnd('in_track_ms', 4)} AS in_track_ms, {rnd('cross_track_ms', 4)} AS cross_track_ms FROM {invert('s_a', 's_e', 's_inc_rad', 's_raan_rad', 'm_a', 'least(greatest(m_e, 0), 0.999999)', 'least(greatest(atan2(m_sin_i, m_cos_i), 0), pi())', 'atan2(m_k, m_h)', 'ar', 'norad_id, idx, width, s_a, m_a, m_e')}",
    "win_rolling_context": f"WITH {EV}, {indexed('ev')} SELECT norad_id, idx, n, {rnd('oldest')} AS oldest, {rnd('latest')} AS latest, {rnd('total')} AS total FROM (SELECT norad_id, idx, count(*) OVER w AS n, first_value(a) OVER w AS oldest, last_value(a) OVER w AS latest, sum(a) OVER w AS total FROM ix WINDOW w AS (PARTITION BY norad_id ORDER BY idx ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING)) WHERE idx > 0",
    "agg_median_orbit": f"WITH {DETECT} SELECT norad_id, {rnd('median(a)', 8)} AS a, {rnd('least(greatest(median(e), 0), 0.999999)', 8)} AS e, {rnd(f'least(greatest(median(inc) * {RAD}, 0), pi())', 8)} AS inc_rad, {rnd('median(argp)', 8)} AS argp FROM ix GROUP BY 1",
    "fn_standardise": f"WITH {CHAN}, {QUART} SELECT norad_id, idx, {', '.join(f'{rnd(std(n, v), 3)} AS {n}' for n, v in ELEMENT_CHANNELS.items())}, {', '.join(f'{rnd(f"CAST(CAST({v} AS FLOAT) AS DOUBLE)", 3)} AS {n}' for n, v in (TIME_CHANNELS | FLAG_CHANNELS).items())} FROM ch JOIN qt USING (orbit_class)",
    "fn_confidence": f"SELECT event_id, {rnd(f'least(1, greatest(0, value / (value + 6) * CASE WHEN {TYPE} = $$radial$$ THEN 0.6::DOUBLE ELSE 1 END))')} AS rule, {rnd('1 - exp(-value / 40)')} AS residual FROM events",
    "fn_conformal_set": f"WITH {SAMPLES}, r AS (SELECT orbit_class, score, row_number() OVER (PARTITION BY orbit_class ORDER BY score) AS k, count(*) OVER (PARTITION BY orbit_class) AS n FROM (SELECT orbit_class, CASE WHEN outcome = 1 THEN 1 - confidence ELSE confidence END AS score FROM smp)), q AS (SELECT orbit_class, coalesce(min(score) FILTER (WHERE k = ceil((n + 1) * (1 - 0.1::DOUBLE))), 1) AS q FROM r GROUP BY 1) SELECT orbit_class, array_to_string(list_filter([CASE WHEN confidence >= 1 - q THEN '1' END, CASE WHEN 1 - confidence >= 1 - q THEN '0' END], lambda x: x IS NOT NULL), ',') AS labels, count(*) AS n FROM smp JOIN q USING (orbit_class) GROUP BY 1, 2",
    "calib_samples": f"WITH RECURSIVE {SCORED} SELECT orbit_class, count(*) AS n, CAST(sum(CASE WHEN outcome = 'tp_above' THEN 1 ELSE 0 END) AS BIGINT) AS hits, {rnd('avg(confidence)')} AS mean_confidence FROM scored WHERE outcome <> 'tp_below' GROUP BY 1",
    "join_split_membership": f"WITH {LAB}, {MEM} SELECT label_id, split FROM lab JOIN mem USING (norad_id)",
    "join_objects_by_split": f"WITH {MEM} SELECT split, count(DISTINCT norad_id) AS n_objects, count(*) AS n_rows FROM events JOIN mem ON user_id = norad_id GROUP BY 1",
    "join_temporal_assign": f"WITH {LAB}, {ASSIGNED} SELECT label_id, split FROM asg",
    "eval_inputs": f"""WITH {DETECT}, {FLOORS}, {LAB}, {ASSIGNED}, {SPANS},
gp AS (SELECT norad_id, t AS t0, lead(t) OVER w AS t1, coalesce(lag(t) OVER w, t) AS tol_start, coalesce(lead(t, 2) OVER w, lead(t) OVER w) AS tol_end FROM ev WINDOW w AS (PARTITION BY norad_id ORDER BY t)),
nm AS (SELECT norad_id, CASE WHEN median(a) < 8378 THEN 0.01 WHEN median(a) >= 35000 THEN 0.1 ELSE 0.03 END AS nom FROM ev GROUP BY 1)
SELECT label_id, norad_id, t0, t1, tol_start, tol_end, coalesce(delta_v >= coalesce(CASE WHEN maneuver_type = 'cross-track' THEN floor_cross_track WHEN maneuver_type = 'radial' THEN floor_radial ELSE floor_in_track END, nom), true) AS above_floor
FROM (SELECT * FROM asg WHERE split = 'train' AND norad_id IN (SELECT norad_id FROM spans)) l JOIN gp USING (norad_id) JOIN nm USING (norad_id) LEFT JOIN floors USING (norad_id) WHERE epoch >= t0 AND epoch < t1""",
    "agg_exposure_years": f"""WITH {EV}, {LAB}, {ASSIGNED}, {SPANS}, nm AS (SELECT norad_id, CASE WHEN median(a) < 8378 THEN 'LEO' WHEN median(a) >= 35000 THEN 'GEO' ELSE 'MEO' END AS shape FROM ev GROUP BY 1),
fl AS (SELECT norad_id, first(orbit_class ORDER BY epoch, label_id) AS named FROM asg GROUP BY 1) SELECT norad_id, coalesce(named, shape) AS orbit_class, {rnd('observation_years')} AS observation_years FROM spans JOIN nm USING (norad_id) LEFT JOIN fl USING (norad_id)""",
    "join_token_target": f"WITH {TARGET} SELECT norad_id, idx, target FROM tk",
    "agg_pos_weight": f"WITH {TARGET} SELECT {rnd('greatest((count(*) - sum(target)) / sum(target), 1)')} AS weight FROM (SELECT *, {WINDOWS} AS w FROM tk)",
    "join_series_labels": f"WITH {LAB} SELECT label_id, norad_id FROM lab WHERE norad_id IS NOT NULL AND (norad_id % 4 = 0 OR epoch >= 1705276800000000 - 5 * {DAY}) AND (norad_id % 3 = 0 OR epoch <= 1705276800000000 + 7 * {DAY})",
    "agg_recipe_counts": "SELECT c.orbit_class, count(r.id) AS n FROM (SELECT unnest(['LEO', 'MEO', 'GEO', 'IGSO', 'HEO']) AS orbit_class) c LEFT JOIN (SELECT DISTINCT user_id AS id, ['LEO', 'MEO', 'GEO', 'IGSO'][CAST(user_id % 4 + 1 AS INTEGER)] AS orbit_class FROM events) r USING (orbit_class) GROUP BY 1",
    "set_merged_labels": f"WITH {LAB} SELECT label_id, norad_id, source, epoch FROM (SELECT *, row_number() OVER (PARTITION BY norad_id, window_start // {DAY} ORDER BY window_start, source, label_id) AS k FROM lab WHERE norad_id IS NOT NULL) WHERE k = 1",
    "bench_temporal_split": f"""WITH RECURSIVE {LAB}, {ERAS},
ob AS (SELECT norad_id, any_value(orbit_class) AS orbit_class, count(*) FILTER (WHERE era = 0) AS n0, count(*) FILTER (WHERE era = 1) AS n1, count(*) FILTER (WHERE era = 2) AS n2 FROM er GROUP BY 1),
od AS (SELECT *, row_number() OVER (PARTITION BY orbit_class ORDER BY (n0 > 0)::INT + (n1 > 0)::INT + (n2 > 0)::INT, -(n0 + n1 + n2), sha256('0:' || norad_id)) AS k FROM ob),
gr AS (SELECT DISTINCT orbit_class, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS h0, CAST(0 AS BIGINT) AS h1, CAST(0 AS BIGINT) AS h2, CAST(NULL AS BIGINT) AS norad_id, -1 AS e FROM od
 UNION ALL SELECT orbit_class, k, h0 + CASE WHEN e = 0 THEN n0 ELSE 0 END, h1 + CASE WHEN e = 1 THEN n1 ELSE 0 END, h2 + CASE WHEN e = 2 THEN n2 ELSE 0 END, norad_id, e FROM (
  SELECT *, CASE WHEN d0 >= d1 AND d0 >= d2 THEN 0 WHEN d1 >= d2 THEN 1 ELSE 2 END AS e FROM (SELECT od.orbit_class, od.k, gr.h0, gr.h1, gr.h2, od.norad_id, n0, n1, n2,
   {", ".join(f"CASE WHEN n{i} > 0 THEN {r}::DOUBLE * (h0 + h1 + h2) - h{i} ELSE -1e18 END AS d{i}" for i, r in enumerate((0.7, 0.15, 0.15)))} FROM gr JOIN od ON od.orbit_class = gr.orbit_class AND od.k = gr.k + 1)))
SELECT norad_id, CASE e WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM gr WHERE k > 0""",
    "bench_splits": f"""WITH RECURSIVE {LAB}, q AS (SELECT norad_id, window_start, CASE WHEN window_start <= max(window_start + 60000000) OVER (ORDER BY window_start, label_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh, label_id FROM lab WHERE norad_id IS NOT NULL),
i AS (SELECT norad_id, sum(fresh) OVER (ORDER BY window_start, label_id ROWS UNBOUNDED PRECEDING) AS island FROM q),
pr AS (SELECT DISTINCT x.norad_id AS a, y.norad_id AS b FROM i x JOIN i y USING (island)),
rc AS (SELECT a, b FROM pr UNION SELECT rc.a, pr.b FROM rc JOIN pr ON rc.b = pr.a), cp AS (SELECT a AS norad_id, min(b) AS component FROM rc GROUP BY 1),
od AS (SELECT component, n, row_number() OVER (ORDER BY n DESC, sha256('0:' || component)) AS k, sum(n) OVER () AS total FROM (SELECT component, count(*) AS n FROM i JOIN cp USING (norad_id) GROUP BY 1)),
gr AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS h0, CAST(0 AS BIGINT) AS h1, CAST(0 AS BIGINT) AS h2, CAST(NULL AS BIGINT) AS component, -1 AS e
 UNION ALL SELECT k, h0 + CASE WHEN e = 0 THEN n ELSE 0 END, h1 + CASE WHEN e = 1 THEN n ELSE 0 END, h2 + CASE WHEN e = 2 THEN n ELSE 0 END, component, e FROM (
  SELECT *, CASE WHEN d0 >= d1 AND d0 >= d2 THEN 0 WHEN d1 >= d2 THEN 1 ELSE 2 END AS e FROM (SELECT od.k, od.n, od.component, h0, h1, h2, {", ".join(f"{r}::DOUBLE * total - h{i} AS d{i}" for i, r in enumerate((0.7, 0.15, 0.15)))} FROM gr JOIN od ON od.k = gr.k + 1)))
SELECT norad_id, CASE e WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM gr JOIN cp USING (component)""",
}
SQL["eval_detections"] = f"WITH {LAB}, {MEM}, {CUTS}, found AS ({ENGINE_SQL['detect_rule']}) SELECT found.* FROM found JOIN mem USING (norad_id), c WHERE split = 'train' AND {era('epoch_ns / 1000')} = 0"
SQL["det_residual_invert"] = f"WITH {DRIFT}, {peaks(5.0)} SELECT norad_id, idx, {rnd('1 - exp(-z / 5)', 4)} AS confidence, step_a, in_track_ms, cross_track_ms FROM pk JOIN ({SQL['det_learned_invert']}) USING (norad_id, idx)"
SQL["src_notice_sequence"] = """WITH f AS (SELECT DISTINCT o_custkey AS year, o_orderkey % 211 + 1 AS seq FROM orders),
g AS (SELECT *, seq - coalesce(lag(seq) OVER w, 0) > 25 AS ended FROM f WINDOW w AS (PARTITION BY year ORDER BY seq))
SELECT year, seq FROM (SELECT *, bool_or(ended) OVER (PARTITION BY year ORDER BY seq ROWS UNBOUNDED PRECEDING) AS past FROM g) WHERE NOT past"""
SQL["src_recipe"] = """SELECT v.*, n_events, n_hits FROM (VALUES ('LEO', 'DORIS-IDS', CAST(15 AS BIGINT), CAST(20436 AS BIGINT), CAST(46984 AS BIGINT)), ('MEO', 'GPS-NANU', 32, 26407, 68791), ('MEO', 'GALILEO-NAGU', 33, 37846, 67162),
('IGSO', 'QZSS-OHI', 3, 42738, 49336), ('GEO', 'QZSS-OHI', 2, 42917, 62876), ('GEO', 'NOAA-GOES', 4, 41866, 60133), ('GEO', 'SELF-GEO', 3, 38552, 40732)) v(orbit_class, label_source, n, first_id, last_id)
LEFT JOIN (SELECT ['LEO', 'MEO', 'GEO', 'IGSO', 'HEO'][user_id % 5 + 1] AS orbit_class, count(*) AS n_events, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_hits FROM events GROUP BY 1) e ON e.orbit_class = v.orbit_class"""
#: Vehicle and catalogue numbers of the recipe, written out so that the query is held against them and not against its own table.
_GPS = """(44, 26407), (48, 32711), (50, 35752), (52, 29486), (53, 28874), (55, 32260), (56, 27663), (57, 32384),
(58, 29601), (59, 28190), (61, 28474), (62, 36585), (64, 39533), (65, 38833), (66, 39166), (67, 39741),
(68, 40105), (69, 40294), (70, 41328), (71, 40534), (72, 40730), (73, 41019), (74, 43873), (75, 44506),
(76, 45854), (77, 46826), (78, 48859), (79, 55268), (80, 62339), (81, 64202), (82, 67588), (83, 68791)"""
SQL["src_landed_labels"] = f"""WITH gps AS (SELECT svn, CAST(norad_id AS BIGINT) AS norad_id FROM (VALUES {_GPS}) v(svn, norad_id)), goes(k, norad_id) AS (VALUES (16, CAST(41866 AS BIGINT)), (17, 43226), (18, 51850), (19, 60133)),
d AS (SELECT o_orderkey, o_orderkey % 90 AS svn, epoch_us(TIMESTAMP '2023-01-01') + (o_orderkey % 300 + 59) * {DAY} AS day FROM orders)
SELECT norad_id, day + 27000000000 AS epoch, day + 5400000000 AS window_start, day + 48600000000 AS window_end, 'MEO' AS orbit_class, 'GPS-NANU' AS source, CAST(o_orderkey AS VARCHAR) AS source_ref FROM d JOIN gps USING (svn)
UNION ALL SELECT DISTINCT norad_id, t + 43200000000, t, t + {DAY}, 'GEO', 'NOAA-GOES', 'GOES-' || k FROM (SELECT o_orderkey % 20 AS k, epoch_us(TIMESTAMP '2023-01-01') + (o_orderkey % 200) * {DAY} AS t FROM orders) JOIN goes USING (k)"""
_TEXT = "".join(f""" || ',"{c}":' || CAST({v} AS DOUBLE)""" for c, v in {"mean_motion": "mean_motion", "eccentricity": "eccentricity", "inclination": "inclination", "raan": "raan", "arg_perigee": "90", "mean_anomaly": "10", "bstar": "1e-4", "mean_motion_dot": "0", "mean_motion_ddot": "0"}.items())
_CLEANED = f"""{ELS}, cl AS (SELECT *, '{{"norad_id":' || norad_id || ',"epoch":"' || strftime(make_timestamp(t), '%Y-%m-%dT%H:%M:%S') || CASE WHEN t % 1000000 = 0 THEN '' ELSE strftime(make_timestamp(t), '.%f') END || '+00:00"'{_TEXT} || '}}' AS rec
  FROM (SELECT *, row_number() OVER (PARTITION BY norad_id, t ORDER BY element_set_no DESC, mean_motion DESC) AS k FROM els WHERE eccentricity < 1 AND inclination <= 180 AND mean_motion < 17) WHERE k = 1)"""
_DIGESTS = "SELECT norad_id, count(*) AS n_elsets, sha256('[' || string_agg(rec, ',' ORDER BY t) || ']') AS sha256 FROM"
_WINDOW = lambda c: f"(norad_id % 3 <> 0 OR {c} >= {ad.BURN}) AND (norad_id % 5 <> 0 OR norad_id % 3 = 0 OR {c} <= {ad.BURN})"
SQL["data_digest"] = f"WITH {_CLEANED} {_DIGESTS} cl GROUP BY 1"
SQL["data_rebuild"] = f"""WITH {_CLEANED}, {LAB}, sr AS (SELECT norad_id, t AS t0, lead(t) OVER w AS t1, coalesce(lag(t) OVER w, t) AS tol_start, coalesce(lead(t, 2) OVER w, lead(t) OVER w) AS tol_end FROM cl WHERE {_WINDOW("t")} WINDOW w AS (PARTITION BY norad_id ORDER BY t)),
lb AS (SELECT label_id, norad_id, epoch, orbit_class, source FROM lab WHERE {_WINDOW("epoch")} AND norad_id IS NOT NULL)
SELECT lb.*, t0, t1, CASE WHEN t0 IS NOT NULL THEN tol_start END AS tol_start, CASE WHEN t0 IS NOT NULL THEN tol_end END AS tol_end FROM lb LEFT JOIN sr ON sr.norad_id = lb.norad_id AND t0 <= epoch AND epoch < t1"""
SQL["data_verify"] = f"""WITH {_CLEANED}, p AS ({_DIGESTS} cl GROUP BY 1), w AS ({_DIGESTS} cl WHERE {_WINDOW("t")} GROUP BY 1),
r AS (SELECT i.norad_id, coalesce(n_elsets, 0) AS n_elsets, coalesce(w.sha256, sha256('[]')) AS sha256 FROM (SELECT DISTINCT user_id AS norad_id FROM events UNION ALL SELECT 1000001) i LEFT JOIN w ON w.norad_id = i.norad_id)
SELECT CAST(coalesce(p.norad_id, r.norad_id) AS BIGINT) AS norad_id, CASE WHEN p.norad_id IS NULL THEN 'unexpected' WHEN r.norad_id IS NULL THEN 'missing' WHEN p.sha256 <> r.sha256 THEN 'hash' ELSE 'count' END AS problem
FROM p FULL JOIN r ON p.norad_id = r.norad_id WHERE p.norad_id IS NULL OR r.norad_id IS NULL OR p.sha256 <> r.sha256 OR p.n_elsets <> r.n_elsets
UNION ALL SELECT NULL, 'version 1 became 2'"""
