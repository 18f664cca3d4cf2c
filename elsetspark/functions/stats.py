"""Robust scales, local fits and score intervals as Column expressions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from ..constants import BIN_EDGES, MAD, SCALE_FLOOR


def unwrap_step(x: Column, order: WindowSpec) -> Column:
    """What unwrapping adds at this row: differences of half a turn or more are folded into (-180, 180]."""
    d = x - F.lag(x).over(order)
    folded = d + 180 - 360 * F.floor((d + 180) / 360) - 180
    folded = F.when((folded == -180) & (d > 0), 180.0).otherwise(folded)
    return F.coalesce(F.when(F.abs(d) < 180, 0.0).otherwise(folded - d), F.lit(0.0))


def fit_at(y: Column, t: Column, at: Column, frame: WindowSpec) -> Column:
    """Least-squares line over the frame at time at; the mean where all times are equal."""
    slope = F.coalesce(F.regr_slope(y, t).over(frame), F.lit(0.0))
    return F.avg(y).over(frame) + slope * (at - F.avg(t).over(frame))


def mad_scale(x: Column, centre: Column, group: WindowSpec) -> Column:
    """1.4826 MAD; where that is zero, the population deviation, SCALE_FLOOR at least. centre: median(x) over group, as a column."""
    mad = MAD * F.median(F.abs(x - centre)).over(group)
    return F.when(mad > 0, mad).otherwise(F.greatest(F.stddev_pop(x).over(group), F.lit(SCALE_FLOOR)))


def wilson(hits: Column, total: Column, level: float) -> tuple[Column, Column]:
    """Score interval; null where total is 0."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    n = F.when(total > 0, total.cast("double"))
    p = hits / n
    centre, half, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.greatest(F.lit(0.0), (centre - half) / scale), F.least(F.lit(1.0), (centre + half) / scale)


def bin_of(p: Column) -> Column:
    """0-based bin of p among ten equal bins of [0, 1], by the edges themselves; 1 is in the last."""
    inner = BIN_EDGES[1:-1]
    out = F.lit(0)
    for edge in inner:
        out = out + F.when(p >= edge, 1).otherwise(0)
    return out


def by_object(*order: str) -> WindowSpec:
    w = Window.partitionBy("norad_id")
    return w.orderBy(*order) if order else w
