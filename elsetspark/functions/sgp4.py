"""Vectorised check that an element set can be propagated at its own epoch.

From the published mean-element theory: the Brouwer mean motion and semi-major axis are recovered
from the Kozai mean motion, and a set is sane if these exist, eccentricity is in range and the
position at time zero is finite and outside the Earth's surface.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

KE, CK2 = 60.0 / np.sqrt(6378.135**3 / 398600.8), 0.5 * 1.082616e-3


def sane_at_epoch(mean_motion: np.ndarray, ecc: np.ndarray, inc: np.ndarray, anomaly: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        n0 = mean_motion * 2 * np.pi / 1440
        a1 = (KE / n0) ** (2 / 3)
        c = np.cos(np.radians(inc))
        beta = (1 - ecc * ecc) ** 1.5
        d1 = 1.5 * CK2 * (3 * c * c - 1) / (a1 * a1 * beta)
        a0 = a1 * (1 - d1 / 3 - d1 * d1 - 134 / 81 * d1**3)
        d0 = 1.5 * CK2 * (3 * c * c - 1) / (a0 * a0 * beta)
        a = a0 / (1 - d0)
        e, m = np.maximum(ecc, 1e-6), np.radians(anomaly)
        big = m.copy()
        for _ in range(30):
            big = big - (big - e * np.sin(big) - m) / (1 - e * np.cos(big))
        r = a * (1 - e * np.cos(big))
        return np.isfinite(r) & (ecc >= 0) & (ecc < 1) & (n0 > 0) & (a * (1 - e * e) > 0) & (r >= 1.0) & (a >= 1.0)


@F.pandas_udf(BooleanType())
def _sane(n: pd.Series, e: pd.Series, i: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series(sane_at_epoch(*[x.to_numpy(dtype=float) for x in (n, e, i, m)]))


def sane(mean_motion: Column, ecc: Column, inc: Column, anomaly: Column) -> Column:
    """Arrow-batched; put it after the cheap bounds (operators.series.physical)."""
    return _sane(mean_motion, ecc, inc, anomaly)
