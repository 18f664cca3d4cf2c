"""Orbit mean-elements messages (JSON) to elsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = {"NORAD_CAT_ID": "norad_id", "EPOCH": "t", "MEAN_MOTION": "mean_motion", "ECCENTRICITY": "eccentricity", "INCLINATION": "inclination", "RA_OF_ASC_NODE": "raan", "ARG_OF_PERICENTER": "arg_perigee", "MEAN_ANOMALY": "mean_anomaly", "BSTAR": "bstar", "MEAN_MOTION_DOT": "mean_motion_dot", "MEAN_MOTION_DDOT": "mean_motion_ddot"}
DEFAULTS = {"ELEMENT_SET_NO": ("element_set_no", "0"), "REV_AT_EPOCH": ("rev_at_epoch", "0"), "CLASSIFICATION_TYPE": ("classification", "U"), "OBJECT_ID": ("object_id", "")}
WHOLE = ("NORAD_CAT_ID", "ELEMENT_SET_NO", "REV_AT_EPOCH")
SCHEMA = ", ".join(f"{k} STRING" for k in (*REQUIRED, *DEFAULTS))


def epoch_us(text: Column) -> Column:
    """ISO time with T or space and an optional Z, UTC, to microseconds since 1970; null if malformed."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), "Z$", ""), "T", " ")
    return F.when(plain.rlike(r"^\d{4}-\d\d-\d\d( \d\d:\d\d(:\d\d(\.\d{1,9})?)?)?$"), _micros(plain))


def _micros(plain: Column) -> Column:
    day = F.unix_date(F.substring(plain, 1, 10).try_cast("date")).cast("long") * 86_400_000_000
    part = lambda at: F.coalesce(F.substring(plain, at, 2).try_cast("long"), F.lit(0))
    fraction = F.rpad(F.regexp_extract(plain, r"\.(\d+)$", 1), 6, "0").try_cast("long")
    return day + ((part(12) * 60 + part(15)) * 60 + part(18)) * 1_000_000 + F.coalesce(fraction, F.lit(0))


def parse(records: DataFrame, strict: bool = True) -> DataFrame:
    """Elsets of rows of strings named like the message's fields. Whole numbers must be whole ('1.5' is malformed)."""
    rows = parsed(records, [], strict)
    return rows if strict else rows.dropna()


def parsed(records: DataFrame, also: list[str], strict: bool = True) -> DataFrame:
    """The fields of parse, and the columns `also` as they are."""
    def number(name: str, default: str | None = None) -> Column:
        raw = F.trim(F.col(name)) if default is None else F.coalesce(F.trim(F.col(name)), F.lit(default))
        return F.when(raw.rlike(r"^[+-]?\d+$"), raw.try_cast("long")) if name in WHOLE else raw.try_cast("double")

    out = {new: epoch_us(F.col(k)) if k == "EPOCH" else number(k) for k, new in REQUIRED.items()}
    out |= {new: number(k, d) if k in WHOLE else F.coalesce(F.col(k), F.lit(d)) for k, (new, d) in DEFAULTS.items()}
    if strict:
        out = {c: F.when(v.isNull(), F.raise_error(F.lit(f"malformed or missing field: {c}"))).otherwise(v) for c, v in out.items()}
    return records.select(*[v.alias(c) for c, v in out.items()], *also)


def parse_payload(payloads: DataFrame, column: str = "value") -> DataFrame:
    """One record a row from JSON arrays of objects; anything else raises."""
    parsed = F.from_json(F.col(column), f"array<struct<{', '.join(f'{k}:STRING' for k in (*REQUIRED, *DEFAULTS))}>>", {"mode": "FAILFAST"})
    sound = F.when(F.ltrim(F.col(column)).startswith("["), parsed).otherwise(F.raise_error(F.lit("payload is not an array of objects")))
    return parse(payloads.select(F.inline(sound)))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse_payload(spark.read.text(path, wholetext=True))
