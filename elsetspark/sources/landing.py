"""A landing table of catalogue answers: every snapshot is kept, and is read as of a time.

Rows: source, norad_id, fetched_at (µs), payload (JSON). Written by appending, so that a reader never sees
half a snapshot and a rerun adds the same rows again (which changes nothing: the newest wins). What a
cache would answer is a query: the newest sound snapshot at or before a time, its age, and whether the
source's time to live still holds. Payloads that are no JSON array are passed over and counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalogue_source import CATALOGUES

US = 1_000_000
KEY = ["source", "norad_id"]


def land(snapshots: DataFrame, path: str) -> None:
    snapshots.select(*KEY, "fetched_at", "payload").write.mode("append").partitionBy("source").parquet(path)


def sound(payload: Column) -> Column:
    return F.coalesce(F.json_array_length(payload).isNotNull(), F.lit(False))


def time_to_live(source: Column) -> Column:
    """Seconds an answer of the source stays fresh; null for an unknown source, whose answers are never fresh."""
    out = F.lit(None).cast("long")
    for name, about in CATALOGUES.items():
        out = F.when(source == name, F.lit(about.ttl).cast("long")).otherwise(out)
    return out


def as_of(landed: DataFrame, when: int) -> DataFrame:
    """source, norad_id, payload, fetched_at, age_s, fresh, n_corrupt: of each object the newest sound snapshot at or before `when` (µs).

    Equal times go to the greater payload. An object with corrupt snapshots alone has null payload, time
    and age and is not fresh. One aggregate: a map side sends one snapshot an object.
    """
    good = sound(F.col("payload"))
    newest = F.max(F.when(good, F.struct("fetched_at", "payload"))).alias("x")
    found = landed.where(F.col("fetched_at") <= when).groupBy(*KEY).agg(newest, F.count_if(~good).alias("n_corrupt"))
    age = F.floor((F.lit(when) - F.col("x.fetched_at")) / US)
    return found.select(*KEY, "x.payload", "x.fetched_at", age.alias("age_s"), F.coalesce(age <= time_to_live(F.col("source")), F.lit(False)).alias("fresh"), "n_corrupt")


def wanted(landed: DataFrame, asked: DataFrame, when: int) -> DataFrame:
    """Of asked (source, norad_id), once each, those to request at `when`: nothing fresh is landed. since: the time for a conditional request, or null."""
    now = as_of(landed, when)
    return asked.select(*KEY).distinct().join(now, KEY, "left").where(~F.coalesce("fresh", F.lit(False))).select(*KEY, F.col("fetched_at").alias("since"))


def served(landed: DataFrame, asked: DataFrame, answers: DataFrame, when: int) -> DataFrame:
    """source, norad_id, payload, fetched_at, stale, state of each object asked for.

    answers: source, norad_id, status, payload of the requests made at `when`, one an object.
    * cached: what is landed is fresh (an answer is not looked at);
    * fetched: status 200 with a JSON array;
    * unchanged: status 304, the landed snapshot counts as of now;
    * stale: anything else, or no answer at all, where a sound snapshot is landed;
    * unreachable: the same without one; payload and time are null.
    """
    now = as_of(landed, when).drop("n_corrupt", "age_s")
    said = answers.select(*KEY, "status", F.col("payload").alias("body"))
    rows = asked.select(*KEY).distinct().join(now, KEY, "left").join(said, KEY, "left")
    held, code = F.col("payload").isNotNull(), F.coalesce("status", F.lit(0))
    state = F.when(F.coalesce("fresh", F.lit(False)), "cached").when((code == 200) & sound(F.col("body")), "fetched").when((code == 304) & held, "unchanged").when(held, "stale").otherwise("unreachable")
    rows = rows.withColumn("state", state)
    is_ = lambda *names: F.col("state").isin(*names)
    return rows.select(
        *KEY, F.when(is_("fetched"), F.col("body")).otherwise(F.col("payload")).alias("payload"),
        F.when(is_("fetched", "unchanged"), F.lit(when)).otherwise(F.col("fetched_at")).alias("fetched_at"), is_("stale").alias("stale"), "state",
    )


def after(shown: DataFrame) -> DataFrame:
    """Rows to land after serving: what was fetched, and unchanged answers with their new time."""
    return shown.where(F.col("state").isin("fetched", "unchanged")).select(*KEY, "fetched_at", "payload")
