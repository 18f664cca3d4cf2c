"""The labelled dataset as one job: recipe, element sets and labels to series, labels on gaps, digests and artifacts.

An entry of the recipe bounds the element sets and the labels of its object alike (both ends count, an
empty end is open). Labels of the objects that label themselves are derived from their series; others
are the announced ones. An object without element sets in its window counts, with the digest of none.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import documents
from . import bench, labels, partition
from .ordered import kept
from .series import SIGNATURE, assemble, clean

#: Sources of labels that are derived from the series itself, with their class and the fixed wording of their references.
DERIVED = {"SELF-GEO": ("GEO", "longitude-shift gap"), "SELF-HEO": ("HEO", "apogee/perigee-control gap")}
DIGEST = "norad_id long, n_elsets long, sha256 string"


def record_text(norad_id: int | None, t: int, values: dict) -> str:
    """Canonical text of an element set: number, ISO epoch, then the values as they were read; numbers in their shortest form that reads back the same."""
    return json.dumps({"norad_id": norad_id, "epoch": documents.iso(t), **values}, separators=(",", ":"))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of each object of sorted rows; one object's state is held at a time, whatever its length."""
    current, state, n = (), None, 0

    def done(out: list) -> None:
        if state is not None:
            state.update(b"]")
            out.append((current[0], n, state.hexdigest()))

    schema = pa.schema([("norad_id", pa.int64()), ("n_elsets", pa.int64()), ("sha256", pa.string())])
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
    for batch in batches:
        out: list = []
        for row in batch.to_pylist():
            norad, t = row.pop("norad_id"), row.pop("t")
            if (norad,) != current:
                done(out)
                current, state, n = (norad,), hashlib.sha256(b"["), 0
            state.update((b"," if n else b"") + record_text(norad, t, row).encode())
            n += 1
        if out:
            yield pack(out)
    out = []
    done(out)
    if out:
        yield pack(out)


def series_digests(elsets: DataFrame, fields: tuple[str, ...] = SIGNATURE) -> DataFrame:
    """norad_id, n_elsets and SHA-256 of each object's rows by epoch, as a JSON array of record_text.

    One exchange and one sort by object; tasks stream over sorted batches. Rows of one epoch follow their values.
    """
    rows = elsets.select(F.col("norad_id").cast("long").alias("norad_id"), F.col("t").cast("long").alias("t"), *fields)
    return rows.repartition("norad_id").sortWithinPartitions("norad_id", "t", *fields).mapInArrow(_digested, DIGEST)


def bounded(entries: DataFrame) -> DataFrame:
    """entries with start and end as microseconds since 1970; a malformed bound, or a start after its end, is an error."""

    def moment(c: str):
        if dict(entries.dtypes)[c] != "string":
            return F.col(c).cast("long")
        at = documents._utc(F.col(c))
        return F.when(F.col(c).isNotNull() & at.isNull(), F.raise_error(F.concat(F.lit(f"{c} of the recipe is no time: "), c))).otherwise(at)

    absent = {c: F.lit(None).cast("long") for c in ("start", "end") if c not in entries.columns}
    out = entries.withColumns(absent | {c: moment(c) for c in ("start", "end") if c in entries.columns})
    wrong = F.raise_error(F.concat(F.lit("start is after end in the recipe, object "), F.col("norad_id").cast("string"))).cast("long")
    return out.withColumn("start", F.when(F.col("start") > F.col("end"), wrong).otherwise(F.col("start")))


def self_labels(series: DataFrame, entries: DataFrame) -> DataFrame:
    """Labels derived from the series of the entries whose label_source is in DERIVED: the middle of the gap is the epoch."""
    named = series.withColumns({"a": F.col("semi_major_axis"), "e": F.col("eccentricity"), "inc": F.col("inclination")})
    out = None
    for source, (kind, wording) in DERIVED.items():
        own = named.join(entries.where(F.col("label_source") == source).select("norad_id"), "norad_id", "left_semi")
        found = labels.derive_geo(own) if source == "SELF-GEO" else labels.derive_heo(own)
        middle = F.col("window_start") + F.bround((F.col("window_end") - F.col("window_start")) / 2, 0).cast("long")
        day = lambda c: F.date_from_unix_date(F.floor(F.col(c) / 86_400_000_000).cast("int")).cast("string")
        value = {"epoch": middle, "delta_v": F.lit(None).cast("double"), "orbit_class": F.lit(kind), "source": F.lit(source), "source_ref": F.concat(F.lit(f"{wording} "), day("window_start"), F.lit(".."), day("window_end"))}
        part = found.withColumns(value).select(*documents.LABEL)
        out = part if out is None else out.unionByName(part)
    return out


@dataclass(frozen=True)
class Dataset:
    """A rebuilt dataset: series and labels of every object, labels with their gap (intervals) or without one, digests."""

    version: str
    entries: DataFrame
    series: DataFrame
    labels: DataFrame
    intervals: DataFrame
    unmatched: DataFrame
    digests: DataFrame


def rebuild(entries: DataFrame, elsets: DataFrame, announced: DataFrame, version: str) -> Dataset:
    """entries: norad_id, label_source and, if bounded, start, end. elsets: raw. announced: the columns of documents.LABEL and any others."""
    entries = bounded(entries)
    series = kept(assemble(clean(partition.scope(elsets, entries, "t"))))
    derive = entries.where(F.col("label_source").isin(*DERIVED))
    told = announced.join(derive.select("norad_id"), "norad_id", "left_anti").select(*[f"`{c}`" for c in announced.columns])
    found = partition.scope(told.unionByName(self_labels(series, entries), allowMissingColumns=True), entries)
    digests = entries.select("norad_id").join(series_digests(series), "norad_id", "left")
    empty = hashlib.sha256(b"[]").hexdigest()
    digests = digests.select("norad_id", F.coalesce("n_elsets", F.lit(0)).alias("n_elsets"), F.coalesce("sha256", F.lit(empty)).alias("sha256"))
    return Dataset(version, entries, series, found, labels.map_to_gaps(found, series), labels.unmatched(found, series), digests)


def differences(pinned: DataFrame, pinned_version: str, rebuilt: DataFrame, version: str) -> DataFrame:
    """norad_id, problem of two manifests: none if the dataset is the same to the byte. A changed version has no norad_id."""
    found = bench.manifest_verify(pinned, rebuilt)
    changed = rebuilt.sparkSession.createDataFrame([(None, f"version {pinned_version} became {version}")] if version != pinned_version else [], "norad_id long, problem string")
    return changed.unionByName(found.select(F.col("norad_id").cast("long").alias("norad_id"), "problem")).orderBy(F.col("norad_id").asc_nulls_first())


def verify(pinned_path: str, rebuilt: Dataset) -> DataFrame:
    """Differences of a rebuilt dataset from a manifest document."""
    pinned = documents.read_manifest(rebuilt.series.sparkSession, pinned_path)
    return differences(pinned, json.loads(Path(pinned_path).read_text())["dataset_version"], rebuilt.digests, rebuilt.version)


@dataclass(frozen=True)
class Report:
    """What a build wrote, and what it covers."""

    paths: dict[str, str]
    n_objects: int
    coverage: DataFrame


def build(entries: DataFrame, elsets: DataFrame, announced: DataFrame, version: str, out_dir: str) -> Report:
    """recipe.json, labels.json and manifest.json of a rebuilt dataset. The element sets themselves are not written."""
    Path(out_dir).mkdir(parents=True, exist_ok=True)
    paths = {name: f"{out_dir}/{name}.json" for name in ("recipe", "labels", "manifest")}
    dataset = rebuild(entries, elsets, announced, version)
    documents.write_recipe(entries, version, paths["recipe"])
    documents.write_labels(dataset.labels, paths["labels"])
    documents.write_manifest(dataset.digests, version, paths["manifest"])
    return Report(paths, entries.count(), labels.coverage(dataset.labels))
