"""Provisional jumps on a stream of elsets: an extra, and not the rule detector, which needs whole series.

Each object keeps its last rows in state; a new row is reported when it leaves the median of the
kept ones by more than a threshold of robust deviations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

KEEP, THRESHOLD = 16, 6.0
RESULT = "norad_id long, t long, a double, z double"


def _jumps(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    held = list(state.get[0]) if state.exists else []
    rows = pd.concat(list(batches)).sort_values("t")
    out = []
    for t, a in zip(rows["t"], rows["a"], strict=True):
        if len(held) >= 8:
            centre = float(np.median(held))
            scale = max(1.4826 * float(np.median(np.abs(np.array(held) - centre))), 1e-6)
            if (z := abs(a - centre) / scale) >= THRESHOLD:
                out.append((key[0], int(t), float(a), z))
        held = [*held, float(a)][-KEEP:]
    state.update((held,))
    yield pd.DataFrame(out, columns=["norad_id", "t", "a", "z"])


def provisional_jumps(stream: DataFrame) -> DataFrame:
    """stream: norad_id, t, a. Append mode."""
    return stream.groupBy("norad_id").applyInPandasWithState(_jumps, RESULT, "held array<double>", "append", "NoTimeout")
