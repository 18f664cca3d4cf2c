"""Orbit mechanics as Column expressions: all stay inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CLASS_FLOOR, ECC_CLAMP, GEO_FROM, J2, LEO_BELOW, MU, EARTH_RADIUS, RADIAL_FACTOR, THRESHOLD, TYPES


def semi_major_axis(mean_motion: Column) -> Column:
    """km, from rev/day."""
    n = mean_motion * (2 * math.pi / 86400)
    return F.pow(F.lit(MU) / (n * n), 1 / 3)


def mean_motion(a: Column) -> Column:
    """rad/s."""
    return F.sqrt(F.lit(MU) / F.pow(a, 3))


def circular_speed(a: Column) -> Column:
    return F.sqrt(F.lit(MU) / a)


def radius_at(a: Column, e: Column, nu: Column) -> Column:
    return a * (1 - e * e) / (1 + e * F.cos(nu))


def orbital_speed(a: Column, r: Column) -> Column:
    return F.sqrt(F.lit(MU) * (2 / r - 1 / a))


def orbit_class(a: Column) -> Column:
    return F.when(a < LEO_BELOW, "LEO").when(a >= GEO_FROM, "GEO").otherwise("MEO")


def class_floor(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in CLASS_FLOOR.items() for x in kv]), name)


def j2_rates(a: Column, e: Column, i: Column) -> dict[str, Column]:
    """Secular rates (rad/s) of node, perigee and mean anomaly."""
    n, p = mean_motion(a), a * (1 - e * e)
    k = n * J2 * F.pow(F.lit(EARTH_RADIUS) / p, 2)
    c = F.cos(i)
    return {"raan_rate": -1.5 * k * c, "argp_rate": 0.75 * k * (5 * c * c - 1), "anomaly_rate": 0.75 * k * F.sqrt(1 - e * e) * (3 * c * c - 1)}


def gauss_forward(radial: Column, along: Column, cross: Column, nu: Column, a: Column, e: Column, i: Column, argp: Column) -> dict[str, Column]:
    """Element changes of an impulse (km/s) at true anomaly nu."""
    n, s, p = mean_motion(a), F.sqrt(1 - e * e), a * (1 - e * e)
    r, h, u = radius_at(a, e, nu), F.sqrt(MU * a * (1 - e * e)), nu + argp
    cos_ecc = (e + F.cos(nu)) / (1 + e * F.cos(nu))
    return {
        "da": 2 / (n * s) * (e * F.sin(nu) * radial + p / r * along),
        "de": s / (n * a) * (F.sin(nu) * radial + (F.cos(nu) + cos_ecc) * along),
        "di": r * F.cos(u) / h * cross,
        "draan": r * F.sin(u) / (h * F.sin(i)) * cross,
    }


def classify(radial: Column, along: Column, cross: Column) -> Column:
    """Largest component; ties in the order in-track, cross-track, radial."""
    s = F.abs(along)
    return F.when((s >= cross) & (s >= radial), TYPES[0]).when(cross >= radial, TYPES[1]).otherwise(TYPES[2])


def orbit(a: Column, e: Column, i: Column, argp: Column) -> Column:
    """Struct of an orbit (km, -, rad, rad) with semi-latus rectum p, angular momentum h and mean motion.
    a > 0, 0 <= e < 1 and 0 <= i <= pi, else an error; null where one of them is."""
    bad = F.when(a <= 0, "semi-major axis").when(~e.between(0, 1) | (e == 1), "eccentricity").when(~i.between(0, math.pi), "inclination")
    p = a * (1 - e * e)
    made = F.struct(a.alias("a"), e.alias("e"), i.alias("i"), argp.alias("argp"), p.alias("p"), F.sqrt(MU * p).alias("h"), mean_motion(a).alias("mean_motion"))
    return F.when(bad.isNotNull(), F.raise_error(F.concat(bad, F.lit(" out of range")))).when(a.isNotNull() & e.isNotNull() & i.isNotNull(), made)


def located(da: Column, de: Column, a: Column, e: Column, nu: Column) -> dict[str, Column]:
    """Radial and in-track change (km/s) that make the step at true anomaly nu; null where nu is or the two hardly differ in effect."""
    unit = lambda radial, along: gauss_forward(F.lit(radial), F.lit(along), F.lit(0.0), nu, a, e, F.lit(1.0), F.lit(0.0))
    by_radial, by_along = unit(1.0, 0.0), unit(0.0, 1.0)
    det = by_radial["da"] * by_along["de"] - by_along["da"] * by_radial["de"]
    solve = lambda x: F.when(F.abs(det) > 1e-15, x / det)
    return {"radial": solve(da * by_along["de"] - by_along["da"] * de), "along": solve(by_radial["da"] * de - da * by_radial["de"])}


def invert(da: Column, de: Column, di: Column, draan: Column, a: Column, e: Column, i: Column, argp: Column, nu: Column | None = None) -> dict[str, Column]:
    """Velocity change (m/s) and type of an element step (km, -, rad, rad) about an orbit.

    Where the true anomaly nu of the burn is given and tells radial from in-track, both are exact (radial without its sign).
    Elsewhere in-track follows from da, radial from what is left of de; an anomaly read off the node only sets the speed.
    """
    along_node = F.sin(i) * draan
    signal = F.sqrt(di * di + along_node * along_node)
    seen = signal > 1e-12
    crossing = F.atan2(along_node, di) - argp
    r = F.when(seen, radius_at(a, e, crossing)).otherwise(a)
    cross = F.when(seen, F.sqrt(MU * a * (1 - e * e)) / r * signal).otherwise(0.0) * 1e3
    n, v = mean_motion(a), orbital_speed(a, r if nu is None else F.coalesce(radius_at(a, e, nu), r))
    along = n * n * a / (2 * v) * da
    rest = (v * de) * (v * de) - (2 * along) * (2 * along)
    radial = F.when(rest > 0, F.sqrt(F.greatest(rest, F.lit(0.0)))).otherwise(0.0) * 1e3
    along = along * 1e3
    if nu is not None:
        exact = located(da, de, a, e, nu)
        radial, along = F.coalesce(F.abs(exact["radial"]) * 1e3, radial), F.coalesce(exact["along"] * 1e3, along)
    return {"radial_ms": radial, "in_track_ms": along, "cross_track_ms": cross, "delta_v_ms": F.sqrt(radial * radial + along * along + cross * cross), "type": classify(radial, along, cross)}


def clamp_ecc(e: Column) -> Column:
    return F.least(F.greatest(e, F.lit(0.0)), F.lit(ECC_CLAMP))


def clamp_inc(i: Column) -> Column:
    return F.least(F.greatest(i, F.lit(0.0)), F.lit(math.pi))


def confidence(significance: Column, kind: Column) -> Column:
    base = significance / (significance + THRESHOLD)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(kind == TYPES[2], base * RADIAL_FACTOR).otherwise(base)))


def residual_confidence(z: Column, threshold: float | Column) -> Column:
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(limit <= 0, F.lit(1.0)).otherwise(1 - F.exp(-z / limit))


def above_floor(delta_v: Column, floor: Column) -> Column:
    return F.coalesce(delta_v >= floor, F.lit(True))
