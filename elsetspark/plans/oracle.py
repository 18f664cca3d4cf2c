"""DuckDB SQL of the driver queries, written from the operators' definitions."""

RAD = "0.017453292519943295"
MU = "398600.8"
DAY = "86400000000"

EV = f"""ev AS (SELECT user_id AS norad_id, epoch_us(ts) AS t,
  CAST(6778.0 AS DOUBLE) + value / 1000 + CASE WHEN epoch_us(ts) >= 1705276800000000 AND user_id % 3 = 0 THEN CAST(2.0 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS a,
  CAST(0.001 AS DOUBLE) + (event_id % 97) * CAST(1e-6 AS DOUBLE) AS e,
  CAST(66 AS DOUBLE) + ((event_id * 31) % 101) * CAST(1e-4 AS DOUBLE) + CASE WHEN epoch_us(ts) >= 1705276800000000 AND user_id % 3 = 1 THEN CAST(0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS inc,
  CAST((event_id * 37) % 360 AS DOUBLE) AS raan, CAST(90 AS DOUBLE) AS argp, CAST(1 AS DOUBLE) + value / 100000 AS mean_motion, event_id, event_type FROM events)"""
ELS = """els AS (SELECT user_id AS norad_id, epoch_us(ts) AS t, CASE WHEN event_id % 90 = 7 THEN CAST(18 AS DOUBLE) ELSE CAST(15 AS DOUBLE) + value / 1000 END + copy * CAST(0.001 AS DOUBLE) AS mean_motion,
  CASE WHEN event_id % 50 = 0 THEN CAST(1.5 AS DOUBLE) ELSE CAST(0.001 AS DOUBLE) + (event_id % 97) * CAST(1e-6 AS DOUBLE) END AS eccentricity,
  CASE WHEN event_id % 70 = 0 THEN 200.0 ELSE 66.0 END AS inclination,
  CAST(event_id % 360 AS DOUBLE) AS raan, CAST(100 + CASE WHEN event_id % 3 = 0 THEN copy ELSE 0 END AS BIGINT) AS element_set_no
  FROM events, (SELECT unnest([0, 1]) AS copy))"""
LANDED = """snap AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'spacetrack' ELSE 'celestrak' END AS source, user_id AS norad_id, epoch_us(ts) AS fetched_at, event_id % 7 <> 0 AND event_id % 11 <> 0 AS good, '[{"EVENT": ' || event_id || '}]' AS body FROM events WHERE epoch_us(ts) <= 1705276800000000),
new AS (SELECT source, norad_id, arg_max(body, (fetched_at, body)) FILTER (good) AS payload, max(fetched_at) FILTER (good) AS fetched_at, count(*) FILTER (NOT good) AS n_corrupt FROM snap GROUP BY ALL),
now AS (SELECT *, CAST((1705276800000000 - fetched_at) // 1000000 AS BIGINT) AS age_s, CASE WHEN source = 'spacetrack' THEN 86400 ELSE 7200 END AS ttl FROM new)"""
DAILY = f"""daily AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norad_id, t // {DAY} ORDER BY abs((t % {DAY}) / CAST({DAY} AS DOUBLE) - 0.5), t) AS k FROM ev) WHERE k = 1)"""


def indexed(source: str) -> str:
    """idx, n, t_days and unwrapped angles of a series."""
    d = lambda c: f"({c} - lag({c}) OVER w)"
    fold = lambda c: f"({d(c)} + 180 - 360 * floor(({d(c)} + 180) / 360) - 180)"
    fix = lambda c: f"coalesce(CASE WHEN abs({d(c)}) < 180 THEN 0 ELSE (CASE WHEN {fold(c)} = -180 AND {d(c)} > 0 THEN 180 ELSE {fold(c)} END) - {d(c)} END, 0) AS f_{c}"
    return f"""ix0 AS (SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY norad_id) AS n, (t - min(t) OVER (PARTITION BY norad_id)) / CAST({DAY} AS DOUBLE) AS t_days,
  {", ".join(map(fix, ("inc", "raan", "argp")))} FROM {source} WINDOW w AS (PARTITION BY norad_id ORDER BY t)),
ix AS (SELECT norad_id, t, event_id, idx, n, t_days, a, e, {", ".join(f"{c} + sum(f_{c}) OVER (PARTITION BY norad_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS {c}" for c in ("inc", "raan", "argp"))} FROM ix0)"""


def fit(y: str, frame: str) -> str:
    w = f"(PARTITION BY norad_id ORDER BY t ROWS BETWEEN {frame})"
    slope = f"regr_slope({y}, t_days) OVER {w}"
    return f"(avg({y}) OVER {w} + CASE WHEN isfinite({slope}) THEN coalesce({slope}, 0) ELSE 0 END * (mid - avg(t_days) OVER {w}))"


CHANNELS = ("a", "e", "inc", "raan")
STEPS = f"""mids AS (SELECT *, (lag(t_days) OVER w + t_days) / 2 AS mid, lag(t) OVER w AS t0 FROM ix WINDOW w AS (PARTITION BY norad_id ORDER BY t)),
st0 AS (SELECT *, {", ".join(f"{fit(c, 'CURRENT ROW AND 3 FOLLOWING')} - {fit(c, '4 PRECEDING AND 1 PRECEDING')} AS step_{c}" for c in CHANNELS)} FROM mids),
st AS (SELECT * FROM st0 WHERE n >= 9 AND idx >= 4 AND idx < n - 4)"""
SCALES = f"""md AS (SELECT norad_id, {", ".join(f"median(step_{c}) AS m_{c}, stddev_pop(step_{c}) AS s_{c}" for c in CHANNELS)} FROM st GROUP BY norad_id),
sc AS (SELECT norad_id, {", ".join(f"CASE WHEN mad_{c} > 0 THEN mad_{c} ELSE greatest(s_{c}, 1e-12) END AS scale_{c}" for c in CHANNELS)}
  FROM (SELECT st.norad_id, {", ".join(f"1.4826 * median(abs(step_{c} - m_{c})) AS mad_{c}, any_value(s_{c}) AS s_{c}" for c in CHANNELS)} FROM st JOIN md USING (norad_id) GROUP BY st.norad_id)),
g0 AS (SELECT st.*, {", ".join(f"scale_{c}" for c in CHANNELS)}, abs(step_a) / scale_a AS z_a, abs(step_inc) / scale_inc AS z_inc FROM st JOIN sc USING (norad_id)),
g1 AS (SELECT *, greatest(z_a, z_inc) AS significance, CASE WHEN z_a >= z_inc THEN 'a' ELSE 'inc' END AS channel, CASE WHEN z_a >= z_inc THEN step_a ELSE step_inc END AS s,
  CASE WHEN z_a >= z_inc THEN lag(step_a) OVER w ELSE lag(step_inc) OVER w END AS s_before, CASE WHEN z_a >= z_inc THEN lead(step_a) OVER w ELSE lead(step_inc) OVER w END AS s_after FROM g0 WINDOW w AS (PARTITION BY norad_id ORDER BY idx)),
gaps AS (SELECT *, coalesce(s_before * s < 0 AND abs(s_before) >= 0.5 * abs(s), false) OR coalesce(s_after * s < 0 AND abs(s_after) >= 0.5 * abs(s), false) AS transient FROM g1)"""
SERIES = f"{EV}, {DAILY}, {indexed('daily')}, {STEPS}"
DETECT = f"{SERIES}, {SCALES}"


def nms(threshold: float) -> str:
    return f"""kl AS (SELECT norad_id, list(CAST(idx AS BIGINT) ORDER BY significance DESC, idx) AS l FROM gaps WHERE significance >= {threshold} GROUP BY norad_id),
kept AS (SELECT norad_id, unnest(list_reduce(l, lambda acc, c: CASE WHEN len(list_filter(acc, lambda k: abs(k - c[1]) <= 4)) = 0 THEN list_append(acc, c[1]) ELSE acc END, CAST([] AS BIGINT[]))) AS idx
  FROM (SELECT norad_id, list_transform(l, lambda x: [x]) AS l FROM kl))"""


def invert(da: str, de: str, di: str, do: str, a: str, e: str, i: str, w: str, source: str, keep: str) -> str:
    """Subquery with keep and radial_ms, in_track_ms, cross_track_ms, delta_v_ms, type."""
    return f"""(SELECT *, sqrt(radial_ms * radial_ms + in_track_ms * in_track_ms + cross_track_ms * cross_track_ms) AS delta_v_ms,
  CASE WHEN abs(in_track_ms) >= cross_track_ms AND abs(in_track_ms) >= radial_ms THEN 'in-track' WHEN cross_track_ms >= radial_ms THEN 'cross-track' ELSE 'radial' END AS type
 FROM (SELECT *, 1000 * CASE WHEN q_sig > 1e-12 THEN sqrt({MU} * q_a * (1 - q_e * q_e)) / q_r * q_sig ELSE 0 END AS cross_track_ms, 1000 * q_s AS in_track_ms,
   1000 * sqrt(greatest((q_v * q_de) * (q_v * q_de) - (2 * q_s) * (2 * q_s), 0)) AS radial_ms
  FROM (SELECT *, ({MU} / (q_a * q_a * q_a)) * q_a / (2 * q_v) * q_da AS q_s
   FROM (SELECT *, sqrt({MU} * (2 / q_r - 1 / q_a)) AS q_v
    FROM (SELECT *, CASE WHEN q_sig > 1e-12 THEN q_a * (1 - q_e * q_e) / (1 + q_e * cos(atan2(q_n, q_di) - q_w)) ELSE q_a END AS q_r
     FROM (SELECT *, sqrt(q_di * q_di + q_n * q_n) AS q_sig
      FROM (SELECT {keep}, CAST({da} AS DOUBLE) AS q_da, CAST({de} AS DOUBLE) AS q_de, CAST({di} AS DOUBLE) AS q_di, sin({i}) * ({do}) AS q_n, CAST({a} AS DOUBLE) AS q_a, CAST({e} AS DOUBLE) AS q_e, CAST({w} AS DOUBLE) AS q_w FROM {source}))))))) """


FLOORS = "".join(
    f"""fo_{name} AS (SELECT norad_id, delta_v_ms AS dv FROM {invert(*step, 'm_a', 'least(greatest(m_e, 0), 0.999999)', f'least(greatest(m_inc * {RAD}, 0), pi())', f'm_argp * {RAD}', 'orb', 'norad_id')}),
"""
    for name, step in {"a": ("6 * scale_a", "0", "0", "0"), "i": ("0", "0", f"6 * scale_inc * {RAD}", "0"), "o": ("0", "0", "0", f"6 * scale_raan * {RAD}"), "e": ("0", "6 * scale_e", "0", "0")}.items()
)
FLOORS = f"""orb AS (SELECT m.*, sc.scale_a, sc.scale_e, sc.scale_inc, sc.scale_raan FROM (SELECT norad_id, median(a) AS m_a, median(e) AS m_e, median(inc) AS m_inc, median(argp) AS m_argp FROM ix GROUP BY norad_id) m JOIN sc USING (norad_id)),
{FLOORS}floors AS (SELECT o.norad_id, greatest(a.dv, nom) AS floor_in_track, greatest(least(i.dv, n.dv), nom) AS floor_cross_track, greatest(e.dv, nom) AS floor_radial
  FROM (SELECT norad_id, CASE WHEN m_a < 8378 THEN 0.01 WHEN m_a >= 35000 THEN 0.1 ELSE 0.03 END AS nom FROM orb) o JOIN fo_a a USING (norad_id) JOIN fo_i i USING (norad_id) JOIN fo_o n USING (norad_id) JOIN fo_e e USING (norad_id))"""


def holt(columns: tuple[str, ...]) -> str:
    dt = "greatest(x.t_days - h.t_days, 1.0 / 1440)"
    level = lambda c: f"(0.5 * x.{c} + 0.5 * (h.l_{c} + h.r_{c} * {dt}))"
    return f"""h AS (SELECT x.norad_id, CAST(0 AS BIGINT) AS idx, x.t_days, {", ".join(f"x.{c} AS l_{c}, coalesce((y.{c} - x.{c}) / greatest(y.t_days - x.t_days, 1.0 / 1440), 0) AS r_{c}" for c in columns)}
  FROM ix x LEFT JOIN ix y ON y.norad_id = x.norad_id AND y.idx = 1 WHERE x.idx = 0
 UNION ALL SELECT x.norad_id, x.idx, x.t_days, {", ".join(f"{level(c)}, 0.1 * ({level(c)} - h.l_{c}) / {dt} + 0.9 * h.r_{c}" for c in columns)}
  FROM h JOIN ix x ON x.norad_id = h.norad_id AND x.idx = h.idx + 1)"""


def rnd(x: str, places: int = 6) -> str:
    return f"round({x}, {places}) + 0.0"


CLASS = "['LEO', 'MEO', 'GEO', 'IGSO', 'HEO'][CAST(user_id % 5 + 1 AS INTEGER)]"
TYPE = "['in-track', 'cross-track', 'radial'][CAST(event_id % 3 + 1 AS INTEGER)]"
LAB = f"""lab AS (SELECT event_id AS label_id, CASE WHEN event_id % 13 <> 0 THEN user_id END AS norad_id, epoch_us(ts) AS epoch, epoch_us(ts) AS window_start, epoch_us(ts) + 3600000000 AS window_end,
  CASE WHEN event_id % 5 <> 0 THEN {TYPE} END AS maneuver_type, CASE WHEN event_id % 3 <> 0 THEN value / 100 END AS delta_v, {CLASS} AS orbit_class, 'src' || (event_id % 4) AS source FROM events WHERE event_type = 'purchase')"""
SLAB = f"""{LAB}, slab AS (SELECT *, epoch - 2 * {DAY} AS tol_start, epoch + 2 * {DAY} AS tol_end,
  coalesce(delta_v >= 20 * CASE orbit_class WHEN 'LEO' THEN CAST(0.01 AS DOUBLE) WHEN 'MEO' THEN CAST(0.03 AS DOUBLE) WHEN 'HEO' THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END, true) AS above_floor FROM lab)"""
DET = f"""det AS (SELECT event_id AS det_id, user_id AS norad_id, epoch_us(ts) AS epoch, value / (value + 50) AS confidence, {TYPE} AS type FROM events WHERE event_type = 'error')"""
EXP = f"""expo AS (SELECT user_id AS norad_id, {CLASS} AS orbit_class, (max(epoch_us(ts)) - min(epoch_us(ts))) / CAST(365.25 * 86400000000 AS DOUBLE) * 20 AS observation_years FROM events GROUP BY user_id)"""
MATCH = f"""{SLAB}, {DET},
dr AS (SELECT *, row_number() OVER (PARTITION BY norad_id ORDER BY confidence DESC, epoch, det_id) AS k FROM det),
ll AS (SELECT norad_id, list({{'t': epoch, 'id': label_id, 'lo': tol_start, 'hi': tol_end}}) AS labs FROM slab WHERE norad_id IS NOT NULL GROUP BY norad_id),
mm AS (SELECT norad_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS claimed, CAST(NULL AS BIGINT) AS det_id, CAST(NULL AS BIGINT) AS label_id FROM (SELECT DISTINCT norad_id FROM det)
 UNION ALL SELECT norad_id, k, CASE WHEN best IS NULL THEN claimed ELSE list_append(claimed, best) END, det_id, best FROM (
  SELECT mm.norad_id, d.k, mm.claimed, d.det_id,
   list_sort(list_transform(list_filter(l.labs, lambda x: x.lo <= d.epoch AND d.epoch <= x.hi AND NOT list_contains(mm.claimed, x.id)), lambda x: {{'far': abs(x.t - d.epoch), 't': x.t, 'id': x.id}}))[1].id AS best
  FROM mm JOIN dr d ON d.norad_id = mm.norad_id AND d.k = mm.k + 1 LEFT JOIN ll l ON l.norad_id = mm.norad_id)),
mt AS (SELECT det_id, label_id FROM mm WHERE k > 0)"""
SCORED = f"""{MATCH}, {EXP},
scored AS (SELECT d.det_id, d.norad_id, x.orbit_class, d.confidence, d.type, CASE WHEN m.label_id IS NULL THEN 'fp' WHEN s.above_floor THEN 'tp_above' ELSE 'tp_below' END AS outcome, CASE WHEN s.above_floor THEN s.maneuver_type END AS true_type
  FROM det d JOIN mt m USING (det_id) LEFT JOIN slab s ON s.label_id = m.label_id JOIN expo x ON x.norad_id = d.norad_id),
rk AS (SELECT *, row_number() OVER w AS rank, sum(CASE WHEN outcome = 'fp' THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS cum_fp FROM scored WINDOW w AS (PARTITION BY orbit_class ORDER BY confidence DESC, outcome, type, det_id)),
cls AS (SELECT unnest(['LEO', 'MEO', 'GEO', 'IGSO', 'HEO']) AS orbit_class),
cc AS (SELECT c.orbit_class, coalesce(y.sat_years, 0) AS sat_years, coalesce(y.n_objects, 0) AS n_objects, coalesce(d.n, 0) AS n_detections, coalesce(l.above, 0) AS n_above, coalesce(l.total, 0) AS n_total
  FROM cls c LEFT JOIN (SELECT orbit_class, sum(observation_years) AS sat_years, count(*) AS n_objects FROM expo GROUP BY 1) y USING (orbit_class)
  LEFT JOIN (SELECT orbit_class, count(*) AS n FROM scored GROUP BY 1) d USING (orbit_class)
  LEFT JOIN (SELECT x.orbit_class, count(*) FILTER (WHERE s.above_floor) AS above, count(*) AS total FROM slab s JOIN expo x ON s.norad_id = x.norad_id GROUP BY 1) l USING (orbit_class))"""
POINTS = f"""{SCORED},
pt0 AS (SELECT cc.*, r.rate FROM cc, (SELECT unnest([0.3, 1.0, 3.0]::DOUBLE[]) AS rate) r),
pt AS (SELECT p.orbit_class, p.rate, any_value(p.n_above) AS n_above, any_value(p.n_total) AS n_total, count(*) FILTER (WHERE outcome = 'tp_above') AS tp_above, count(*) FILTER (WHERE outcome = 'tp_below') AS tp_below, count(*) FILTER (WHERE outcome = 'fp') AS fp, min(confidence) AS cut_confidence
  FROM pt0 p LEFT JOIN rk ON rk.orbit_class = p.orbit_class AND rk.cum_fp <= p.rate * p.sat_years GROUP BY 1, 2)"""
Z = "1.959963984540054"


def wilson(k: str, n: str) -> tuple[str, str]:
    p = f"(CAST({k} AS DOUBLE) / {n})"
    half = f"{Z} * sqrt({p} * (1 - {p}) / {n} + {Z} * {Z} / (4 * CAST({n} AS DOUBLE) * {n}))"
    mid, scale = f"({p} + {Z} * {Z} / (2 * CAST({n} AS DOUBLE)))", f"(1 + {Z} * {Z} / {n})"
    return f"CASE WHEN {n} > 0 THEN greatest(0, ({mid} - {half}) / {scale}) END", f"CASE WHEN {n} > 0 THEN least(1, ({mid} + {half}) / {scale}) END"


DRIFT = f"""{EV}, {indexed('ev')},
df AS (SELECT *, a - lag(a) OVER w AS d_a, (inc - lag(inc) OVER w) * {RAD} AS d_i FROM ix WINDOW w AS (PARTITION BY norad_id ORDER BY t)),
dm AS (SELECT norad_id, median(d_a) AS m_a, median(d_i) AS m_i FROM df GROUP BY 1),
re AS (SELECT df.*, d_a - m_a AS r_a, d_i - m_i AS r_i FROM df JOIN dm USING (norad_id)),
rm AS (SELECT norad_id, median(r_a) AS c_a, median(r_i) AS c_i FROM re GROUP BY 1),
rq AS (SELECT re.norad_id, any_value(c_a) AS c_a, any_value(c_i) AS c_i, greatest(1.4826 * median(abs(r_a - c_a)), 1e-6) AS q_a, greatest(1.4826 * median(abs(r_i - c_i)), 1e-9) AS q_i FROM re JOIN rm USING (norad_id) GROUP BY 1),
zs AS (SELECT norad_id, t, idx, greatest(coalesce(abs(r_a - c_a) / q_a, 0), coalesce(abs(r_i - c_i) / q_i, 0)) AS z FROM re JOIN rq USING (norad_id))"""


def peaks(threshold: float) -> str:
    return f"""p0 AS (SELECT *, z >= {threshold} AND idx > 0 AS hit FROM zs),
p1 AS (SELECT *, CASE WHEN hit AND NOT coalesce(lag(hit) OVER w, false) THEN 1 ELSE 0 END AS fresh FROM p0 WINDOW w AS (PARTITION BY norad_id ORDER BY idx)),
p2 AS (SELECT *, sum(fresh) OVER (PARTITION BY norad_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM p1),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norad_id, run ORDER BY z DESC, idx) AS k FROM p2 WHERE hit) WHERE k = 1)"""


def self_labels(along: str, other: str, kind: str) -> str:
    return f"SELECT norad_id, t0 AS window_start, t AS window_end, CASE WHEN along >= other THEN 'in-track' ELSE '{kind}' END AS maneuver_type FROM (SELECT *, {along} AS along, {other} AS other FROM z WHERE t0 IS NOT NULL) WHERE along > 0 OR other > 0"


BASE = {"a": "ix.a", "e": "ix.e", "sin_i": f"sin(ev.inc * {RAD})", "cos_i": f"cos(ev.inc * {RAD})", "h": f"ix.e * cos(ev.argp * {RAD})", "k": f"ix.e * sin(ev.argp * {RAD})", "raan": "ix.raan"}
TREND = "(avg({c}) OVER w + CASE WHEN isfinite(regr_slope({c}, t_days) OVER w) THEN coalesce(regr_slope({c}, t_days) OVER w, 0) ELSE 0 END * (t_days - avg(t_days) OVER w))"
CHAN = f"""{EV}, {indexed('ev')},
b AS (SELECT ix.norad_id, ix.t, ix.idx, ix.t_days, {", ".join(f"{v} AS x_{k}" for k, v in BASE.items())} FROM ix JOIN ev ON ev.event_id = ix.event_id),
r AS (SELECT *, {", ".join(f"x_{c} - {TREND.format(c='x_' + c)} AS res_{c}" for c in BASE)} FROM b WINDOW w AS (PARTITION BY norad_id ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
ch AS (SELECT *, {", ".join(f"coalesce(res_{c} - lag(res_{c}) OVER w, 0) AS dlt_{c}" for c in BASE)}, coalesce(t_days - lag(t_days) OVER w, 0) AS gap,
  CASE WHEN median(x_a) OVER (PARTITION BY norad_id) < 8378 THEN 'LEO' WHEN median(x_a) OVER (PARTITION BY norad_id) >= 35000 THEN 'GEO' ELSE 'MEO' END AS orbit_class FROM r WINDOW w AS (PARTITION BY norad_id ORDER BY t))"""
ELEMENT_CHANNELS = {f"{kind}_{c}": f"{column}_{c}" for kind, column in (("lvl", "x"), ("res", "res"), ("dlt", "dlt")) for c in BASE}
TIME_CHANNELS = {"t_dt": "least(gap, 2.5) / 2.5"} | {f"t_{f}{p}": f"{f}(2 * pi() * gap / {p})" for p in (1, 2, 4, 8) for f in ("sin", "cos")}
FLAG_CHANNELS = {"elset_valid": "CAST(1 AS DOUBLE)", "dt_saturated": "CAST(CASE WHEN gap > 2.5 THEN 1 ELSE 0 END AS DOUBLE)"}
SAMPLES = f"smp AS (SELECT value / (value + 50) AS confidence, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS outcome, {CLASS} AS orbit_class FROM events)"
BINS = "(" + " + ".join(f"CASE WHEN confidence >= CAST({i * 0.1!r} AS DOUBLE) THEN 1 ELSE 0 END" for i in range(1, 10)) + ")"
RELY = f"""{SAMPLES}, ag AS (SELECT orbit_class, {BINS} AS bin, count(*) AS n, avg(confidence) AS mean_confidence, avg(CAST(outcome AS DOUBLE)) AS precision FROM smp GROUP BY 1, 2)"""
DIGEST = "sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey))"
US = "epoch_us(CAST({} AS TIMESTAMP))"
DOY = "(epoch_us(TIMESTAMP '{}-01-01') + (o_orderkey % 360{}) * 86400000000)"

SQL = {
    "proj_series": f"WITH {EV} SELECT norad_id, t, {rnd(f'pow({MU} / pow(mean_motion * 2 * pi() / 86400, 2), 1.0 / 3)')} AS semi_major_axis, {rnd(f'(t - lag(t) OVER (PARTITION BY norad_id ORDER BY t)) / CAST({DAY} AS DOUBLE)')} AS dt_days FROM ev",
    "pred_physical": f"WITH {ELS} SELECT norad_id, count(*) AS n FROM els WHERE eccentricity < 1 AND inclination <= 180 AND mean_motion > 0 GROUP BY 1",
    "pred_in_range": "SELECT user_id AS norad_id, count(*) AS n, min(epoch_us(ts)) AS first_t FROM events WHERE epoch_us(ts) BETWEEN 1704672000000000 AND 1705276800000000 GROUP BY 1",
    "agg_dedup_epoch": f"WITH {ELS} SELECT norad_id, t, {rnd('mean_motion')} AS mean_motion, element_set_no FROM (SELECT *, row_number() OVER (PARTITION BY norad_id, t ORDER BY element_set_no DESC, mean_motion DESC) AS k FROM els) WHERE k = 1",
    "agg_clean": f"WITH {ELS}, g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norad_id, t ORDER BY element_set_no DESC, mean_motion DESC) AS k FROM els WHERE eccentricity < 1 AND inclination <= 180 AND mean_motion < 17) WHERE k = 1) SELECT norad_id, t, {rnd(f'pow({MU} / pow(mean_motion * 2 * pi() / 86400, 2), 1.0 / 3)')} AS semi_major_axis, {rnd(f'(t - lag(t) OVER (PARTITION BY norad_id ORDER BY t)) / CAST({DAY} AS DOUBLE)')} AS dt_days FROM g",
    "win_regularize_daily": f"WITH {EV}, {DAILY} SELECT norad_id, t, event_id FROM daily",
    "win_unwrap": f"WITH {EV}, {DAILY}, {indexed('daily')} SELECT norad_id, t, idx, {rnd('t_days')} AS t_days, {rnd('raan')} AS raan FROM ix",
    "proj_orbit_class": f"WITH {EV} SELECT norad_id, CASE WHEN m < 8378 THEN 'LEO' WHEN m >= 35000 THEN 'GEO' ELSE 'MEO' END AS orbit_class FROM (SELECT norad_id, median(a * (1 + norad_id % 3 * CAST(2.6 AS DOUBLE))) AS m FROM ev GROUP BY 1)",
    "win_local_step": f"WITH {SERIES} SELECT norad_id, idx, {rnd('step_a')} AS step_a, {rnd('step_inc')} AS step_inc FROM st",
    "win_local_trend": f"WITH {EV}, {indexed('ev')} SELECT norad_id, idx, {rnd(TREND.format(c='a'))} AS trend_a FROM ix WINDOW w AS (PARTITION BY norad_id ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)",
    "agg_mad_scale": f"WITH {DETECT} SELECT norad_id, {rnd('scale_a')} AS scale_a, {rnd('scale_inc')} AS scale_inc FROM sc",
    "det_candidates": f"WITH {DETECT} SELECT norad_id, idx, channel, {rnd('significance', 4)} AS significance FROM gaps WHERE significance >= 6",
    "fn_transient": f"WITH {DETECT} SELECT norad_id, idx, channel, transient FROM gaps",
    "topk_nms": f"WITH {DETECT}, {nms(1.5)} SELECT norad_id, idx FROM kept",
    "win_holt": f"WITH RECURSIVE {EV}, {indexed('ev')}, {holt(('a', 'inc'))} SELECT norad_id, idx, {rnd('l_a')} AS level_a, {rnd('l_inc')} AS level_inc FROM h",
    "fn_invert": f"WITH {EV} SELECT event_id, {rnd('radial_ms')} AS radial_ms, {rnd('in_track_ms')} AS in_track_ms, {rnd('cross_track_ms')} AS cross_track_ms, {rnd('delta_v_ms')} AS delta_v_ms, type FROM {invert('(event_id % 41 - 20) * CAST(0.1 AS DOUBLE)', '(event_id % 7 - 3) * CAST(1e-4 AS DOUBLE)', '(event_id % 5 - 2) * CAST(1e-5 AS DOUBLE)', '(event_id % 3 - 1) * CAST(1e-5 AS DOUBLE)', 'a', 'e', f'inc * {RAD}', f'raan * {RAD}', 'ev', 'event_id')}",
    "fn_gauss_round_trip": f"WITH {EV} SELECT event_id, {rnd('(event_id % 41 + 1) * CAST(1e-4 AS DOUBLE) * 1000', 5)} AS dv_ms, {rnd('(event_id % 41 + 1) * CAST(1e-4 AS DOUBLE) * 1000', 5)} AS in_track_ms FROM ev",
    "fn_invert_located": f"""WITH {EV}, x AS (SELECT event_id, a, (event_id % 20) * CAST(0.04 AS DOUBLE) AS e, (event_id % 63) * CAST(0.1 AS DOUBLE) AS nu, event_id % 3 = 0 AS blind, (event_id % 41 - 20) * CAST(0.1 AS DOUBLE) AS da, (event_id % 7 - 3) * CAST(1e-4 AS DOUBLE) AS de FROM ev),
y AS (SELECT *, sqrt({MU} / (a * a * a)) AS n, sqrt(1 - e * e) AS s, CASE WHEN blind THEN a ELSE a * (1 - e * e) / (1 + e * cos(nu)) END AS r FROM x),
m AS (SELECT *, 2 * e * sin(nu) / (n * s) AS ar, 2 * a * s / (n * r) AS al, s * sin(nu) / (n * a) AS er, s * (cos(nu) + (e + cos(nu)) / (1 + e * cos(nu))) / (n * a) AS et, sqrt({MU} * (2 / r - 1 / a)) AS v FROM y),
z AS (SELECT *, ar * et - al * er AS det, n * n * a / (2 * v) * da AS along FROM m)
SELECT event_id, {rnd('1000 * CASE WHEN NOT blind AND abs(det) > 1e-15 THEN abs((da * et - al * de) / det) ELSE sqrt(greatest(v * de * v * de - 4 * along * along, 0)) END', 5)} AS radial_ms, {rnd('1000 * CASE WHEN NOT blind AND abs(det) > 1e-15 THEN (ar * de - da * er) / det ELSE along END', 5)} AS in_track_ms FROM z""",
    "fn_orbit": f"WITH {EV} SELECT event_id, {rnd('a * (1 - e * e)')} AS p, {rnd(f'sqrt({MU} * a * (1 - e * e))')} AS h, {rnd(f'sqrt({MU} / (a * a * a)) * 1e4')} AS rate FROM ev",
    "src_fetch_result": f"WITH {EV} SELECT norad_id, t, a, 'history' AS source, t > epoch_us(TIMESTAMP '2024-01-11') AS after_fetch, true AS stale FROM ev WHERE t BETWEEN epoch_us(TIMESTAMP '2024-01-08') AND epoch_us(TIMESTAMP '2024-01-15')",
    "txt_epoch_predicate": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN lo || '--' || hi WHEN 1 THEN '>' || lo WHEN 2 THEN '<' || hi ELSE '' END AS predicate FROM (SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS lo, strftime(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') AS hi FROM orders)",
    "txt_coverage": f"""WITH {LAB}, c AS (SELECT orbit_class, place, count(label_id) AS n, count(delta_v) AS dv, count(norad_id) AS cat, coalesce('from ' || string_agg(DISTINCT source, ' and ' ORDER BY source), 'no source') AS src FROM (SELECT unnest(['LEO', 'MEO', 'GEO', 'IGSO', 'HEO']) AS orbit_class, unnest(range(1, 6)) AS place) LEFT JOIN lab USING (orbit_class) GROUP BY 1, 2)
SELECT CAST(0 AS INTEGER) AS place, 'events in all: ' || sum(n) AS line FROM c UNION ALL SELECT CAST(place AS INTEGER), orbit_class || ' ' || n || ', velocity change known for ' || dv || ', object known for ' || cat || ', ' || src FROM c""",
    "fn_j2_rates": f"WITH {EV}, q AS (SELECT event_id, sqrt({MU} / pow(a, 3)) * 1.082616e-3 * pow(6378.135 / (a * (1 - e * e)), 2) AS k, e, cos(inc * {RAD}) AS c FROM ev) SELECT event_id, {rnd('-1.5 * k * c * 1e7')} AS raan_rate, {rnd('0.75 * k * (5 * c * c - 1) * 1e7')} AS argp_rate, {rnd('0.75 * k * (3 * c * c - 1) * sqrt(1 - e * e) * 1e7')} AS anomaly_rate FROM q",
    "fn_speeds": f"WITH {EV} SELECT event_id, {rnd(f'sqrt({MU} / pow(a, 3)) * 1000')} AS n_mrad_s, {rnd(f'sqrt({MU} / a)')} AS v_circular, {rnd(f'sqrt({MU} * (2 * (1 + e * cos(raan * {RAD})) / (a * (1 - e * e)) - 1 / a))')} AS v FROM ev",
    "agg_object_floor": f"WITH {DETECT}, {FLOORS} SELECT norad_id, {rnd('floor_in_track', 5)} AS floor_in_track, {rnd('floor_cross_track', 5)} AS floor_cross_track, {rnd('floor_radial', 5)} AS floor_radial FROM floors",
    "detect_rule": f"""WITH RECURSIVE {DETECT}, {nms(6.0)}, {FLOORS}, {holt(('a', 'e', 'inc', 'argp'))},
c AS (SELECT g.norad_id, g.t0, g.t, g.significance, g.step_a, g.step_e, g.step_inc, g.step_raan, h.l_a, h.l_e, h.l_inc, h.l_argp FROM gaps g JOIN kept k ON g.norad_id = k.norad_id AND g.idx = k.idx JOIN h ON h.norad_id = g.norad_id AND h.idx = g.idx - 1 WHERE NOT g.transient),
v AS (SELECT * FROM {invert('step_a', 'step_e', f'step_inc * {RAD}', f'step_raan * {RAD}', 'l_a', 'least(greatest(l_e, 0), 0.999999)', f'least(greatest(l_inc * {RAD}, 0), pi())', f'l_argp * {RAD}', 'c', 'norad_id, t0, t, significance')})
SELECT (v.t0 + v.t) * 500 AS epoch_ns, {rnd("least(1, greatest(0, significance / (significance + 6) * CASE WHEN type = 'radial' THEN 0.6 ELSE 1 END))", 4)} AS confidence, type,
 CASE WHEN delta_v_ms >= CASE type WHEN 'in-track' THEN floor_in_track WHEN 'cross-track' THEN floor_cross_track ELSE floor_radial END THEN {rnd('delta_v_ms', 4)} END AS delta_v_estimate, v.norad_id, v.t0 AS t_before, v.t AS t_after
FROM v JOIN floors USING (norad_id)""",
    "fc_drift": f"WITH {DRIFT} SELECT norad_id, idx, {rnd('z', 4)} AS z FROM zs",
    "win_run_peak": f"WITH {DRIFT}, {peaks(2.0)} SELECT norad_id, idx, {rnd('z', 4)} AS z FROM pk",
    "det_residual": f"WITH {DRIFT}, {peaks(4.0)} SELECT norad_id, t, {rnd('1 - exp(-z / 4)', 5)} AS confidence FROM pk",
    "join_label_gap": f"""WITH {EV}, {LAB}, q AS (SELECT norad_id, t AS t0, lead(t) OVER w AS t1, coalesce(lag(t) OVER w, t) AS tol_start, coalesce(lead(t, 2) OVER w, lead(t) OVER w) AS tol_end FROM ev WHERE event_type NOT IN ('purchase', 'error') WINDOW w AS (PARTITION BY norad_id ORDER BY t))
SELECT label_id, t0, t1, tol_start, tol_end FROM lab JOIN q ON lab.norad_id = q.norad_id AND lab.epoch >= t0 AND lab.epoch < t1""",
    "join_label_unmatched": f"WITH {EV}, {LAB}, q AS (SELECT norad_id, min(t) AS lo, max(t) AS hi FROM ev WHERE event_type NOT IN ('purchase', 'error') GROUP BY 1) SELECT label_id, norad_id FROM lab WHERE norad_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM q WHERE q.norad_id = lab.norad_id AND epoch >= lo AND epoch < hi)",
    "agg_coverage": f"WITH {LAB} SELECT c.orbit_class, count(label_id) AS n_events, count(delta_v) AS n_with_dv, count(norad_id) AS n_with_norad, coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS sources FROM (SELECT unnest(['LEO', 'MEO', 'GEO', 'IGSO', 'HEO']) AS orbit_class) c LEFT JOIN lab USING (orbit_class) GROUP BY 1",
    "lab_geo_self": f"""WITH {EV}, d AS (SELECT *, 360 * (mean_motion - 86400 / 86164.0905::DOUBLE) AS drift FROM ev),
x AS (SELECT *, lag(t) OVER w AS t0, drift - lag(drift) OVER w AS dd, inc - lag(inc) OVER w AS di, lag(drift) OVER w AS drift0 FROM d WINDOW w AS (PARTITION BY norad_id ORDER BY t)),
m AS (SELECT norad_id, median(dd) AS md, median(di) AS mi FROM x GROUP BY 1 HAVING count(*) >= 3),
y AS (SELECT x.norad_id, greatest(6 * greatest(1.4826 * median(abs(dd - md)), 1e-12), 0.005) AS td, greatest(6 * greatest(1.4826 * median(abs(di - mi)), 1e-12), 0.005) AS ti FROM x JOIN m USING (norad_id) GROUP BY 1), z AS (SELECT x.*, td, ti FROM x JOIN y USING (norad_id))
{self_labels('CASE WHEN abs(dd) > td AND drift0 * drift <= 0 THEN abs(dd) / td ELSE 0 END', 'CASE WHEN -di > ti THEN -di / ti ELSE 0 END', 'cross-track')}""",
    "lab_heo_self": f"""WITH {EV}, x AS (SELECT norad_id, t, lag(t) OVER w AS t0, abs(a * 1000 - lag(a * 1000) OVER w) AS da, abs(e2 - lag(e2) OVER w) AS de FROM (SELECT *, CASE WHEN event_id % 29 = 0 THEN e + CAST(0.01 AS DOUBLE) ELSE e END AS e2 FROM ev) WINDOW w AS (PARTITION BY norad_id ORDER BY t)),
m AS (SELECT norad_id, median(da) AS ma, median(de) AS me FROM x GROUP BY 1 HAVING count(*) >= 3),
y AS (SELECT x.norad_id, greatest(6 * greatest(1.4826 * median(abs(da - ma)), 1e-12), 1) AS ta, greatest(6 * greatest(1.4826 * median(abs(de - me)), 1e-12), 1e-4) AS te FROM x JOIN m USING (norad_id) GROUP BY 1), z AS (SELECT x.*, ta, te FROM x JOIN y USING (norad_id))
{self_labels('CASE WHEN da > ta THEN da / ta ELSE 0 END', 'CASE WHEN de > te THEN de / te ELSE 0 END', 'radial')}""",
    "pred_above_floor": f"WITH {SLAB} SELECT label_id, above_floor FROM slab",
    "join_match": f"WITH RECURSIVE {MATCH} SELECT det_id, label_id FROM mt",
    "win_budget_walk": f"WITH RECURSIVE {SCORED} SELECT orbit_class, rank, det_id, outcome, CAST(cum_fp AS BIGINT) AS cum_fp FROM rk",
    "bench_class_counts": f"WITH RECURSIVE {SCORED} SELECT orbit_class, {rnd('sat_years', 5)} AS sat_years, n_objects, n_detections, n_above, n_total FROM cc",
    "bench_class_metrics": f"WITH RECURSIVE {POINTS} SELECT orbit_class, rate, tp_above, tp_below, fp, {rnd('CASE WHEN n_above > 0 THEN tp_above / n_above END')} AS recall, {rnd(wilson('tp_above', 'n_above')[0])} AS recall_lo, {rnd(wilson('tp_above', 'n_above')[1])} AS recall_hi, {rnd('CASE WHEN tp_above + fp > 0 THEN tp_above / (tp_above + fp) END')} AS precision, {rnd(wilson('tp_above', '(tp_above + fp)')[0])} AS precision_lo, {rnd(wilson('tp_above', '(tp_above + fp)')[1])} AS precision_hi, {rnd('CASE WHEN n_total > 0 THEN (tp_above + tp_below) / n_total END')} AS full_recall, {rnd('cut_confidence')} AS cut_confidence FROM pt",
    "agg_confusion": f"WITH RECURSIVE {SCORED}, x AS (SELECT rk.orbit_class, true_type, type FROM rk JOIN cc USING (orbit_class) WHERE cum_fp <= sat_years AND outcome = 'tp_above') SELECT c.orbit_class, a.true_type, b.predicted_type, count(x.type) AS n FROM cls c CROSS JOIN (SELECT unnest(['in-track', 'cross-track', 'radial']) AS true_type) a CROSS JOIN (SELECT unnest(['in-track', 'cross-track', 'radial']) AS predicted_type) b LEFT JOIN x ON x.orbit_class = c.orbit_class AND x.true_type = a.true_type AND x.type = b.predicted_type GROUP BY 1, 2, 3",
    "agg_pooled_recall": f"WITH RECURSIVE {POINTS} SELECT {rnd('coalesce(sum(tp_above) / sum(n_above), 0)')} AS pooled, {rnd('coalesce(avg(CASE WHEN n_above > 0 THEN tp_above / n_above END), 0)')} AS macro FROM pt WHERE rate = 1.0",
    "fn_wilson": f"SELECT user_id, {rnd(wilson('k', 'n')[0])} AS lo, {rnd(wilson('k', 'n')[1])} AS hi FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS k, count(*) AS n FROM events GROUP BY 1)",
    "bench_temporal_eras": f"""WITH {LAB}, o AS (SELECT epoch, row_number() OVER (ORDER BY epoch) - 1 AS k, count(*) OVER () AS n FROM lab WHERE norad_id IS NOT NULL),
c AS (SELECT max(epoch) FILTER (WHERE k = least(CAST(floor(0.70::DOUBLE * n) AS BIGINT), n - 1)) AS c1, max(epoch) FILTER (WHERE k = least(CAST(floor(0.85::DOUBLE * n) AS BIGINT), n - 1)) AS c2 FROM o)
SELECT label_id, CAST(CASE WHEN window_start < c1 - {DAY} THEN 0 WHEN window_start > c1 + {DAY} AND window_start < c2 - {DAY} THEN 1 WHEN window_start > c2 + {DAY} THEN 2 END AS INTEGER) AS era FROM lab, c""",
    "win_overlap_islands": f"WITH {LAB}, q AS (SELECT *, CASE WHEN window_start <= max(window_end) OVER (ORDER BY window_start, window_end, label_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM lab) SELECT label_id, CAST(sum(fresh) OVER (ORDER BY window_start, window_end, label_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM q",
    "graph_components": f"""WITH RECURSIVE {LAB}, q AS (SELECT norad_id, window_start, CASE WHEN window_start <= max(window_start + 60000000) OVER (ORDER BY window_start, label_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh, label_id FROM lab WHERE norad_id IS NOT NULL),
i AS (SELECT DISTINCT norad_id, island FROM (SELECT norad_id, sum(fresh) OVER (ORDER BY window_start, label_id ROWS UNBOUNDED PRECEDING) AS island FROM q)),
pr AS (SELECT DISTINCT x.norad_id AS a, y.norad_id AS b FROM i x JOIN i y USING (island)),
rc AS (SELECT a, b FROM pr UNION SELECT rc.a, pr.b FROM rc JOIN pr ON rc.b = pr.a) SELECT a AS norad_id, min(b) AS component FROM rc GROUP BY 1""",
    "fn_tiebreak": "SELECT c_custkey, sha256('0:' || c_custkey) AS tiebreak FROM customer",
    "agg_split_counts": f"WITH {LAB}, x AS (SELECT *, ['train', 'val', 'test'][CAST(norad_id % 3 + 1 AS INTEGER)] AS split FROM lab WHERE norad_id IS NOT NULL) SELECT s.split, c.orbit_class, count(DISTINCT norad_id) AS n_objects, count(norad_id) AS n_events FROM (SELECT unnest(['LEO', 'MEO', 'GEO', 'IGSO', 'HEO']) AS orbit_class) c CROSS JOIN (SELECT unnest(['train', 'val', 'test']) AS split) s LEFT JOIN x ON x.split = s.split AND x.orbit_class = c.orbit_class GROUP BY 1, 2",
    "join_manifest_verify": f"""WITH p AS (SELECT o_custkey AS id, count(*) AS n, {DIGEST} AS h FROM orders WHERE o_orderkey % 97 <> 0 AND o_custkey % 50 <> 0 GROUP BY 1), r AS (SELECT o_custkey AS id, count(*) AS n, {DIGEST} AS h FROM orders WHERE o_custkey % 41 <> 0 GROUP BY 1)
SELECT coalesce(p.id, r.id) AS norad_id, CASE WHEN p.id IS NULL THEN 'unexpected' WHEN r.id IS NULL THEN 'missing' ELSE 'hash' END AS problem FROM p FULL JOIN r ON p.id = r.id WHERE p.id IS NULL OR r.id IS NULL OR p.h <> r.h""",
    "agg_digest": f"SELECT o_custkey, count(*) AS n, {DIGEST} AS sha256 FROM orders GROUP BY 1",
    "sort_board": f"SELECT CAST(s_suppkey AS VARCHAR) AS name, {rnd('(s_suppkey % 7) / 7')} AS recall, s_suppkey % 5 AS submitted_at, CAST(row_number() OVER (ORDER BY (s_suppkey % 7) / 7 DESC, s_suppkey % 5, CAST(s_suppkey AS VARCHAR)) AS INTEGER) AS place FROM supplier",
    "feat_channels": f"WITH {CHAN} SELECT norad_id, idx, orbit_class, {', '.join(f'{rnd(v)} AS {n}' for n, v in (ELEMENT_CHANNELS | TIME_CHANNELS | FLAG_CHANNELS).items())} FROM ch",
    "feat_windows": f"WITH {EV}, {indexed('ev')}, o AS (SELECT norad_id, CAST(count(*) AS BIGINT) AS n FROM ix GROUP BY 1), w AS (SELECT norad_id, n, unnest(range(0, n, 32)) AS start FROM o), p AS (SELECT *, unnest(range(0, 64)) AS position FROM w) SELECT norad_id, start // 32 AS window_id, position, CASE WHEN start + position < n THEN start + position END AS idx, start + position < n AS valid FROM p",
    "pred_non_finite": "SELECT user_id AS norad_id, count(*) AS rows, count(*) FILTER (event_id % 17 = 0 OR event_id % 19 = 0 OR event_id % 23 = 0) AS dropped, count(*) FILTER (event_id % 17 = 0) AS bad_a, count(*) FILTER (event_id % 19 = 0) AS bad_e, count(*) FILTER (event_id % 23 = 0) AS bad_inc, CAST(0 AS BIGINT) AS bad_raan, CAST(0 AS BIGINT) AS bad_argp FROM events GROUP BY 1",
    "src_catalogue": f"""SELECT user_id AS norad_id, epoch_us(ts) AS t, {rnd("15 + (event_id % 1000) / CAST(1000 AS DOUBLE)")} AS mean_motion, CAST(event_id % 360 AS DOUBLE) AS raan, event_id AS rev_at_epoch,
  '2024-01-15 00:00:00--2024-01-20 00:00:00' AS epoch, false AS stale FROM events WHERE epoch_us(ts) >= 1705276800000000 AND epoch_us(ts) < 1705276800000000 + 5 * {DAY}""",
    "src_landing_as_of": f"WITH {LANDED} SELECT source, norad_id, payload, fetched_at, age_s, coalesce(age_s <= ttl, false) AS fresh, n_corrupt FROM now",
    "src_landing_served": f"""WITH {LANDED}, asked AS (SELECT c_custkey AS norad_id, unnest(['spacetrack', 'celestrak']) AS source, c_custkey % 5 AS k FROM customer),
x AS (SELECT a.source, a.norad_id, k, n.payload, n.fetched_at, CASE WHEN coalesce(age_s <= ttl, false) THEN 'cached' WHEN k = 0 THEN 'fetched' WHEN k = 1 AND n.payload IS NOT NULL THEN 'unchanged' WHEN n.payload IS NOT NULL THEN 'stale' ELSE 'unreachable' END AS state
  FROM asked a LEFT JOIN now n ON n.source = a.source AND n.norad_id = a.norad_id)
SELECT source, norad_id, CASE WHEN state = 'fetched' THEN '[{{"NEW": ' || norad_id || '}}]' ELSE payload END AS payload, CASE WHEN state IN ('fetched', 'unchanged') THEN 1705276800000000 ELSE fetched_at END AS fetched_at, state = 'stale' AS stale, state FROM x""",
    "agg_class_quartiles": f"WITH {CHAN}, u AS ({' UNION ALL '.join(f'''SELECT orbit_class, '{n}' AS channel, quantile_cont({v}, [0.25, 0.5, 0.75]) AS q FROM ch GROUP BY 1''' for n, v in ELEMENT_CHANNELS.items())}) SELECT orbit_class, channel, {rnd('q[2]', 5)} AS median, {rnd('greatest(q[3] - q[1], 1e-12)', 5)} AS iqr FROM u",
    "win_overlap_average": f"WITH {EV}, {indexed('ev')}, w AS (SELECT norad_id, idx, unnest(range(greatest(CAST(floor((idx - 64) / 32) AS BIGINT) + 1, 0), idx // 32 + 1)) AS window_id FROM ix) SELECT norad_id, idx, {rnd('avg(1 / CAST(1 + window_id + idx - window_id * 32 AS DOUBLE))')} AS p FROM w GROUP BY 1, 2",
    "agg_reliability": f"WITH {RELY} SELECT c.orbit_class, CAST(b.bin AS INTEGER) AS bin, coalesce(n, 0) AS n, {rnd('mean_confidence')} AS mean_confidence, {rnd('precision')} AS precision FROM (SELECT DISTINCT orbit_class FROM smp) c CROSS JOIN (SELECT unnest(range(10)) AS bin) b LEFT JOIN ag ON ag.orbit_class = c.orbit_class AND ag.bin = b.bin",
    "agg_ece": f"WITH {RELY} SELECT orbit_class, {rnd('sum(n * abs(mean_confidence - precision)) / sum(n)')} AS ece FROM ag GROUP BY 1",
    "agg_brier": f"WITH {SAMPLES} SELECT orbit_class, {rnd('avg((confidence - outcome) * (confidence - outcome))')} AS brier FROM smp GROUP BY 1",
    "calib_conformal": f"WITH {SAMPLES}, r AS (SELECT orbit_class, score, row_number() OVER (PARTITION BY orbit_class ORDER BY score) AS k, count(*) OVER (PARTITION BY orbit_class) AS n FROM (SELECT orbit_class, CASE WHEN outcome = 1 THEN 1 - confidence ELSE confidence END AS score FROM smp)) SELECT orbit_class, {rnd('coalesce(min(score) FILTER (WHERE k = ceil((n + 1) * (1 - 0.1::DOUBLE))), 1)')} AS q, max(n) AS n FROM r GROUP BY 1",
    "fn_temperature": f"SELECT event_id, {rnd('1 / (1 + exp(-ln(p / (1 - p)) / 2))')} AS p FROM (SELECT event_id, least(greatest(value / (value + 50), 1e-300), 0.9999999999999999) AS p FROM events)",
    "tune_threshold": f"WITH {DRIFT}, g AS (SELECT threshold, CAST(count(*) FILTER (WHERE z >= threshold) % 17 AS DOUBLE) AS value FROM zs, (SELECT unnest(range(2, 13)) / 2 AS threshold) GROUP BY 1) SELECT threshold, value FROM g ORDER BY value DESC, threshold LIMIT 1",
    "src_tle_checksum": "SELECT o_orderkey, CAST(list_sum(list_transform(string_split(rpad('1 ' || lpad(CAST(o_custkey AS VARCHAR), 5, '0') || 'U 98067A   -' || o_orderkey || '-', 68, ' '), ''), lambda c: CASE WHEN c = '-' THEN 1 ELSE coalesce(TRY_CAST(c AS INTEGER), 0) END)) % 10 AS BIGINT) AS checksum FROM orders",
    "src_tle_pair": f"SELECT o_custkey % 100000 AS norad_id, epoch_us(TIMESTAMP '2024-01-01') + (o_orderkey % 365) * {DAY} + 43200000000 AS t, {rnd('(o_orderkey % 9999999) / CAST(10000000 AS DOUBLE)', 9)} AS eccentricity, CAST(15.5 AS DOUBLE) AS mean_motion, {rnd('CAST(0.000012345 AS DOUBLE)', 9)} AS bstar, '1998-067A' AS object_id FROM orders",
    "src_omm": f"SELECT o_custkey AS norad_id, epoch_us(TIMESTAMP '2024-01-01') + (o_orderkey % 9) * {DAY} + 43200250000 AS t, o_orderkey AS rev_at_epoch, CAST(0 AS BIGINT) AS element_set_no, 'U' AS classification, '' AS object_id FROM orders",
    "txt_nanu": f"""WITH n AS (SELECT *, o_orderkey % 360 + 1 AS d1, (o_orderkey + 1) % 360 + 1 AS d2 FROM orders WHERE o_orderkey % 3 = 0),
w AS (SELECT o_orderkey, epoch_us(CASE WHEN 354 - d1 >= 180 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2023-01-01' END) + (d1 - 1) * {DAY} + 5400000000 AS a, epoch_us(CASE WHEN (353 - (d2 - 1)) * 1440 + 930 - 810 > 180 * 1440 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2023-01-01' END) + (d2 - 1) * {DAY} + 48600000000 AS b FROM n)
SELECT 'SVN' || (o_orderkey % 80) AS code, CAST(o_orderkey AS VARCHAR) AS number, a AS window_start, b AS window_end, CAST(floor((a + b) / 2) AS BIGINT) AS epoch FROM w""",
    "txt_nagu": f"WITH w AS (SELECT o_orderkey, epoch_us(TIMESTAMP '2023-05-01 10:20:00') + (o_orderkey % 28) * {DAY} AS a, epoch_us(TIMESTAMP '2023-06-01 11:00:00') + (o_orderkey % 28) * {DAY} AS b FROM orders WHERE o_orderkey % 4 = 0) SELECT 'GSAT' || (o_orderkey % 50) AS code, CAST(o_orderkey AS VARCHAR) AS number, a AS window_start, b AS window_end, a AS epoch FROM w",
    "txt_navsum": f"SELECT 'GOES-' || o_orderkey AS code, a AS window_start, a + {DAY} AS window_end, a + 43200000000 AS epoch FROM (SELECT o_orderkey, epoch_us(TIMESTAMP '2023-01-01') + (o_orderkey % 365) * {DAY} AS a FROM orders)",
    "txt_qzss": f"SELECT CAST(o_orderkey AS VARCHAR) AS code, a + 14400000000 AS epoch, a + 14400000000 AS window_start, a + 33000000000 AS window_end, {rnd('sqrt(0.3 * 0.3::DOUBLE + 0.4 * 0.4::DOUBLE) + sqrt(3.0 * 3.0::DOUBLE + 0.4 * 0.4::DOUBLE)')} AS delta_v, 'cross-track' AS maneuver_type FROM (SELECT o_orderkey, epoch_us(TIMESTAMP '2023-03-01') + (o_orderkey % 28) * {DAY} AS a FROM orders)",
    "txt_doris": f"""WITH x AS (SELECT *, epoch_us(TIMESTAMP '2018-01-01') + (o_orderkey % 360) * {DAY} - 37000000 AS d, o_orderkey % 7 + CAST(0.5 AS DOUBLE) AS r, CAST(o_orderkey % 3 AS DOUBLE) AS c, o_orderkey % 5 = 0 AS short FROM orders)
SELECT 'JASO2' AS code, CASE WHEN short THEN d + 37800000000 ELSE d + 37815500000 END AS epoch, d + 36000000000 AS window_start, d + 39600000000 AS window_end, CASE WHEN short THEN NULL WHEN r >= c THEN 'radial' ELSE 'cross-track' END AS maneuver_type, CASE WHEN NOT short THEN {rnd('sqrt(r * r + 0.0625 + c * c)')} END AS delta_v FROM x""",
    "win_burn_events": f"""WITH {LAB}, b AS (SELECT *, CASE WHEN window_start - max(window_end) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 2 * {DAY} THEN 0 ELSE 1 END AS fresh, row_number() OVER w AS k FROM lab WHERE norad_id IS NOT NULL WINDOW w AS (PARTITION BY norad_id ORDER BY window_start, label_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY norad_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS event, coalesce(delta_v, 0) AS mag FROM b)
SELECT norad_id AS code, min(window_start) AS window_start, max(window_end) AS window_end, {rnd('sum(mag)')} AS delta_v, CASE WHEN first(maneuver_type ORDER BY mag DESC, k) = 'in-track' THEN 'in-track' ELSE 'cross-track' END AS maneuver_type FROM g GROUP BY norad_id, event""",
    "join_crosswalk": f"WITH {LAB} SELECT label_id, c_custkey AS norad_id FROM lab LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) c ON lab.norad_id = c.c_custkey",
}


def _level(at: float) -> str:
    """Recalls of the detections at or above a level of confidence."""
    points = POINTS.replace(DET, DET[:-1] + f" AND value / (value + 50) >= {at})")
    return f"SELECT CAST({at} AS DOUBLE) AS threshold, * FROM (WITH RECURSIVE {points} SELECT orbit_class, CAST(tp_above AS BIGINT) AS tp_above, n_above, CASE WHEN n_above > 0 THEN tp_above / n_above END AS recall FROM pt WHERE rate = 1.0)"


_LEVELS = " UNION ALL ".join(_level(x) for x in (0.2, 0.5, 0.8))
SQL["tune_points"] = f"SELECT threshold, orbit_class, tp_above, n_above, {rnd('recall')} AS recall FROM ({_LEVELS})"
SQL["tune_best"] = f"""WITH p AS ({_LEVELS}), v AS (SELECT NULL AS orbit_class, threshold, coalesce(sum(tp_above) / sum(n_above), 0) AS value FROM p GROUP BY threshold UNION ALL SELECT orbit_class, threshold, recall FROM p WHERE recall IS NOT NULL)
SELECT orbit_class, threshold, {rnd('value')} AS value FROM (SELECT *, row_number() OVER (PARTITION BY orbit_class ORDER BY value DESC, threshold) AS k FROM v) WHERE k = 1"""
