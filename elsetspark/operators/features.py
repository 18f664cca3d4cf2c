"""The 32-channel encoding, its per-class quartiles, and fixed-stride windows of tokens."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DT_CAP, PERIODS, SCALE_FLOOR, STRIDE, TOKENS, US_PER_DAY
from ..functions.physics import orbit_class
from ..functions.stats import by_object
from .ordered import column_statistics, kept
from .series import ELEMENTS, detrended, finite, unwrapped

BASE = ("a", "e", "sin_i", "cos_i", "h", "k", "raan")
TIMING = ("dt", *[f"{f}{p}" for p in PERIODS for f in ("sin", "cos")])
CHANNELS = (*[f"lvl_{c}" for c in BASE], *[f"res_{c}" for c in BASE], *[f"dlt_{c}" for c in BASE], *[f"t_{c}" for c in TIMING], "elset_valid", "dt_saturated")


def levels(series: DataFrame) -> DataFrame:
    """norad_id, t, idx, t_days, gap (days, 0 on the first row), orbit_class and the levels lvl_<c> of each finite row: windows over one exchange by object."""
    w, all_ = by_object("t"), by_object()
    rows = series.where(finite(*ELEMENTS)).repartition("norad_id").withColumns({"idx": F.row_number().over(w) - 1, "t_days": (F.col("t") - F.min("t").over(all_)) / US_PER_DAY})
    rows = unwrapped(rows, "raan").withColumn("orbit_class", orbit_class(F.median("a").over(all_)))
    i, o = F.col("inc") * (math.pi / 180), F.col("argp") * (math.pi / 180)
    rows = rows.withColumns({"sin_i": F.sin(i), "cos_i": F.cos(i), "h": F.col("e") * F.cos(o), "k": F.col("e") * F.sin(o)})
    rows = rows.withColumn("gap", F.coalesce(F.col("t_days") - F.lag("t_days").over(w), F.lit(0.0)))
    return rows.select("norad_id", "t", "idx", "t_days", "gap", "orbit_class", *[F.col(c).alias(f"lvl_{c}") for c in BASE])


def channels(series: DataFrame) -> DataFrame:
    """norad_id, t, idx, orbit_class and the 32 channels of each finite row. Labels are no input."""
    timing = {"t_dt": F.least(F.col("gap"), F.lit(DT_CAP)) / DT_CAP}
    for p in PERIODS:
        timing |= {f"t_sin{p}": F.sin(2 * math.pi * F.col("gap") / p), f"t_cos{p}": F.cos(2 * math.pi * F.col("gap") / p)}
    rows = levels(series).withColumns(timing | {"elset_valid": F.lit(1.0), "dt_saturated": (F.col("gap") > DT_CAP).cast("double")})
    rows = detrended(rows.drop("gap"), tuple(f"lvl_{c}" for c in BASE)).withColumnsRenamed({f"{x}_lvl_{c}": f"{x}_{c}" for x in ("res", "dlt") for c in BASE})
    return rows.select("norad_id", "t", "idx", "orbit_class", *CHANNELS)


def class_quartiles(encoded: DataFrame, stored: bool = False) -> DataFrame:
    """Per class and element channel: exact quartiles and their range (SCALE_FLOOR at least). No task holds a class. stored: encoded is a table, else its channels are written first."""
    names = [c for c in CHANNELS if c[:4] in ("lvl_", "res_", "dlt_")]
    rows = encoded.select("orbit_class", *names)
    at = lambda q: lambda n: F.floor(q * (n - 1))
    shares = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    found = column_statistics(rows if stored else kept(rows), "orbit_class", names, {name: at(q) for name, q in shares.items()})
    place = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("name")) * (F.col("n") - 1) - F.col("k")
    found = found.withColumn("q", F.when(place == 0, F.col("low")).otherwise((1 - place) * F.col("low") + place * F.col("high")))
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("q")))
    return found.groupBy("orbit_class", "channel").agg(pick("q2").alias("median"), F.greatest(pick("q3") - pick("q1"), F.lit(SCALE_FLOOR)).alias("iqr"))


def standardise(encoded: DataFrame, quartiles: DataFrame) -> DataFrame:
    """(x - median) / range of the 21 element channels, as FLOAT; a class without quartiles is an error. The scaler has 21 rows a class."""
    names = [c for c in CHANNELS if c[:4] in ("lvl_", "res_", "dlt_")]
    scaler = quartiles.groupBy("orbit_class").agg(F.map_from_entries(F.collect_list(F.struct("channel", F.struct("median", "iqr")))).alias("s"))
    out = encoded.join(F.broadcast(scaler), "orbit_class", "left")
    s = F.when(F.col("s").isNull(), F.raise_error(F.concat(F.lit("no scaler for class "), F.col("orbit_class")))).otherwise(F.col("s"))
    scaled = [((F.col(c) - s[c]["median"]) / s[c]["iqr"]).cast("float").alias(c) for c in names]
    return out.select("norad_id", "t", "idx", "orbit_class", *scaled, *[F.col(c).cast("float") for c in CHANNELS if c not in names])


def token_windows(encoded: DataFrame, length: int = TOKENS, stride: int = STRIDE) -> DataFrame:
    """norad_id, window_id, position, idx of every token in every window that starts at 0, stride, 2 stride, ..."""
    last = F.floor(F.col("idx") / stride)
    first = F.greatest(F.floor((F.col("idx") - length) / stride) + 1, F.lit(0))
    out = encoded.select("*", F.explode(F.sequence(first, last)).alias("window_id"))
    return out.withColumn("position", F.col("idx") - F.col("window_id") * stride)


def padded_windows(encoded: DataFrame, length: int = TOKENS, stride: int = STRIDE) -> DataFrame:
    """All positions of the windows that start at 0, stride, ... inside an object's tokens: window_id, position, valid and the
    columns of encoded. A window past the end is padded: null t and idx, zero numbers, valid false. Real tokens are valid where elset_valid is."""
    if length < 1 or not 1 <= stride <= length:
        raise ValueError(f"a stride in [1, length] and a length of at least 1 are needed, got {stride} and {length}")
    number = {f.name for f in encoded.schema.fields if f.dataType.typeName() in ("double", "float")}
    rows = encoded.withColumn("n", F.count("*").over(by_object()))
    first = F.greatest(F.floor((F.col("idx") - length) / stride) + 1, F.lit(0))
    own = F.transform(F.sequence(first, F.floor(F.col("idx") / stride)), lambda w: F.struct(w.alias("window_id"), (F.col("idx") - w * stride).alias("position"), F.lit(True).alias("real")))
    # The last token brings the padding of the windows that run past it.
    past = F.filter(F.sequence(first, F.floor(F.col("idx") / stride)), lambda w: w * stride + length > F.col("n"))
    padding = F.flatten(F.transform(past, lambda w: F.transform(F.sequence(F.col("n") - w * stride, F.lit(length - 1).cast("bigint")), lambda p: F.struct(w.alias("window_id"), p.alias("position"), F.lit(False).alias("real")))))
    places = F.when(F.col("idx") == F.col("n") - 1, F.concat(own, padding)).otherwise(own)
    out = rows.select("*", F.inline(places))
    real = F.col("real")
    kept = [F.col(c) if c in ("norad_id", "orbit_class") else F.when(real, F.col(c)).otherwise(F.lit(0.0 if c in number else None)).cast(encoded.schema[c].dataType).alias(c) for c in encoded.columns]
    valid = real & (F.col("elset_valid") > 0) if "elset_valid" in encoded.columns else real
    return out.select("window_id", "position", valid.alias("valid"), *kept)


def scaler_document(quartiles: DataFrame) -> dict:
    """Quartiles as a JSON document {class: {channel: [median, iqr]}}: 21 numbers a class."""
    out: dict[str, dict] = {}
    for r in quartiles.orderBy("orbit_class", "channel").collect():
        out.setdefault(r["orbit_class"], {})[r["channel"]] = [r["median"], r["iqr"]]
    return out


def scaler_of(spark: SparkSession, document: dict) -> DataFrame:
    """The quartiles of scaler_document."""
    rows = [(c, k, float(m), float(q)) for c, by in document.items() for k, (m, q) in by.items()]
    return spark.createDataFrame(rows, "orbit_class string, channel string, median double, iqr double")
