"""Labels from landed notice archives: a row a file, whatever fetched it, to one label table of all sources.

Each source keeps the labels that resolve to an object of the recipe; the files of an archive are
read, parsed and resolved in one job a source, and the union is one DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import notices
from .catalogue import recipe

#: Consecutive missing numbers after which a year of sequentially numbered notices has ended.
MISS_RUN = 25
LABELS = {"norad_id": "long", "epoch": "long", "window_start": "long", "window_end": "long", "maneuver_type": "string", "delta_v": "double", "orbit_class": "string", "source": "string", "source_ref": "string"}
PARSERS = {
    "DORIS-IDS": notices.doris, "GPS-NANU": notices.nanu, "GALILEO-NAGU": notices.nagu,
    "QZSS-OHI": lambda files: notices.burn_events(notices.qzss_burns(files)), "NOAA-GOES": notices.navsum,
}


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each file below a folder."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def in_sequence(found: DataFrame, run: int = MISS_RUN) -> DataFrame:
    """found (year, seq, ...) up to the first `run` consecutive numbers of the year that are missing; numbers start at 1."""
    w = Window.partitionBy("year").orderBy("seq")
    ended = F.col("seq") - F.coalesce(F.lag("seq").over(w), F.lit(0)) > run
    out = found.withColumn("__ended", ended).withColumn("__any", F.max("__ended").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where(~F.col("__any")).drop("__ended", "__any")


def once(labels: DataFrame, order: str | None = None) -> DataFrame:
    """The first label (by order, else by epoch) of each object and start: snapshots of one state repeat it."""
    w = Window.partitionBy("norad_id", "window_start").orderBy(F.col(order or "epoch"), "epoch", "window_end")
    return labels.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def labels(source: str, landed: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Labels of one source from its landed files (text; code too for QZSS-OHI: the stem of the file), resolved by the recipe.

    Labels that resolve to no object are left out; GOES snapshots give each (object, start) once.
    """
    if source not in PARSERS:
        raise ValueError(f"unknown source {source!r}; known: {', '.join(PARSERS)}")
    entries = recipe(landed.sparkSession) if entries is None else entries
    dim = entries.where(F.col("label_source") == source).select("code", "norad_id", "orbit_class")
    rows = PARSERS[source](landed).join(F.broadcast(dim), "code")  # the recipe's rows of one source
    have = rows.columns
    value = {"source": F.lit(source), "source_ref": F.coalesce(F.col("number"), F.col("code")) if "number" in have else F.col("code")}
    out = rows.select(*[(value[c] if c in value else F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in LABELS.items()])
    return once(out) if source == "NOAA-GOES" else out


def all_labels(landed: dict[str, DataFrame], entries: DataFrame | None = None) -> DataFrame:
    """Labels of every source that has files, by (source, object, epoch)."""
    out = None
    for source in PARSERS:
        if source in landed:
            part = labels(source, landed[source], entries)
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no landed files of any known source")
    return out.orderBy("source", "norad_id", "epoch")
