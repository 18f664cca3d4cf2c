"""What a fetch of elements returns, whatever brought them: rows of a window, their source and age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def epoch_predicate(lo: Column, hi: Column) -> Column:
    """Window of µs as a request writes it: `lo--hi`, `>lo`, `<hi`, or empty where both are null. UTC whatever the session's zone."""
    start = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    text = lambda t: F.date_format(F.timestamp_add("MICROSECOND", t, start), "yyyy-MM-dd HH:mm:ss")
    return (
        F.when(lo.isNotNull() & hi.isNotNull(), F.concat(text(lo), F.lit("--"), text(hi)))
        .when(lo.isNotNull(), F.concat(F.lit(">"), text(lo))).when(hi.isNotNull(), F.concat(F.lit("<"), text(hi))).otherwise("")
    )


def result(elsets: DataFrame, source: str, fetched_at: Column, lo: int | None = None, hi: int | None = None, stale: bool = False) -> DataFrame:
    """elsets with lo <= t <= hi (µs; None: open), an object's rows together and in order of t, with source, fetched_at and stale
    (read from a copy that is out of date because the source failed)."""
    for bound, keep in ((lo, F.col("t") >= F.lit(lo)), (hi, F.col("t") <= F.lit(hi))):
        elsets = elsets if bound is None else elsets.where(keep)
    rows = elsets.withColumns({"source": F.lit(source), "fetched_at": fetched_at, "stale": F.lit(stale)})
    return rows.repartition("norad_id").sortWithinPartitions("norad_id", "t")
