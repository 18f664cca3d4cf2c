"""What a step leaves out, counted in the same pass, and checks of its input."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .series import ELEMENTS, finite


def counted(series: DataFrame, columns: tuple[str, ...] = ELEMENTS) -> tuple[DataFrame, Observation]:
    """The rows whose columns are all finite, and an observation filled by the first action on them: rows, dropped, and what each column made drop.

    Spark counts while it filters: no second pass. A row may count for several columns. The action must read these rows
    to the end: where a later step is found to be empty, Spark may leave the branch out and nothing is counted.
    """
    seen = Observation()
    rows = series.observe(seen, F.count("*").alias("rows"), F.count_if(~finite(*columns)).alias("dropped"), *[F.count_if(~finite(c)).alias(c) for c in columns])
    return rows.where(finite(*columns)), seen


def warn_dropped(seen: Observation) -> int:
    """After the action: how many rows were dropped, with a warning that names their columns if there were any."""
    found = seen.get
    if found["dropped"]:
        columns = ", ".join(f"{c} ({n})" for c, n in found.items() if c not in ("rows", "dropped") and n)
        warnings.warn(f"{found['dropped']} of {found['rows']} rows are not finite and were left out: {columns}", stacklevel=2)
    return found["dropped"]


def non_finite(series: DataFrame, columns: tuple[str, ...] = ELEMENTS) -> DataFrame:
    """Of each object: rows, dropped, and the rows that each column makes drop (null, not a number or infinite)."""
    return series.groupBy("norad_id").agg(F.count("*").alias("rows"), F.count_if(~finite(*columns)).alias("dropped"), *[F.count_if(~finite(c)).alias(f"bad_{c}") for c in columns])


def one_object(series: DataFrame) -> DataFrame:
    """series itself where it holds one object at most; more of them raise. A job that ends at the second object it sees."""
    found = [r["norad_id"] for r in series.select("norad_id").distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"the series holds more than one object (such as {found[0]} and {found[1]})")
    return series
