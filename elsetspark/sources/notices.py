"""Operator notices to labels: NANU, NAGU, QZSS OHI, GOES navsum, DORIS.

Input: a row a file with its text. Output: code (the operator's name of the satellite), epoch,
window_start, window_end (microseconds), maneuver_type, delta_v, and the notice's number where it
has one. crosswalk() resolves codes to catalogue numbers, missing ones to null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import US_PER_DAY
from .omm import epoch_us

# Fixed values of the notices.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
AXES = {"005": ("cross-track", "in-track", "radial"), "006": ("radial", "in-track", "cross-track"), "007": ("radial", "in-track", "cross-track")}
LEAP_DAYS = ("1972-01-01", "1972-07-01", "1973-01-01", "1974-01-01", "1975-01-01", "1976-01-01", "1977-01-01", "1978-01-01", "1979-01-01", "1980-01-01", "1981-07-01", "1982-07-01", "1983-07-01", "1985-07-01", "1988-01-01", "1990-01-01", "1991-01-01", "1992-07-01", "1993-07-01", "1994-07-01", "1996-01-01", "1997-07-01", "1999-01-01", "2006-01-01", "2009-01-01", "2012-07-01", "2015-07-01", "2017-01-01")
LOOKBACK_DAYS, CAMPAIGN_DAYS, BURN_TOKENS = 180, 2, 15


def field(block: Column, key: str) -> Column:
    """Value of an anchored 'KEY: value' line, with an optional list number; null if absent."""
    got = F.trim(F.regexp_extract(block, rf"(?m)^\s*(?:\d+\.\s+)?{key}:[ \t]*(.+)$", 1))
    return F.when(got != "", got)


def required(block: Column, key: str) -> Column:
    got = field(block, key)
    return F.when(got.isNull(), F.raise_error(F.lit(f"notice without {key}"))).otherwise(got)


def blocks(files: DataFrame, key: str) -> DataFrame:
    return files.select("*", F.explode(F.split("text", rf"(?m)(?=^\s*(?:\d+\.\s+)?{key}:)")).alias("block")).where(F.trim("block") != "")


def day_us(year: Column, day_of_year: Column) -> Column:
    return (F.unix_date(F.make_date(year, F.lit(1), F.lit(1))).cast("long") + day_of_year - 1) * US_PER_DAY


def nanu(files: DataFrame) -> DataFrame:
    """Forecast outages (FCSTDV). A day of year over 180 days before the notice belongs to the next year."""
    rows = blocks(files, "NANU TYPE").where(field(F.col("block"), "NANU TYPE") == "FCSTDV")
    b = F.col("block")
    dtg = F.upper(required(b, "NANU DTG"))
    part = lambda k: F.regexp_extract(dtg, r"^(\d{2})(\d{2})(\d{2})Z\s+([A-Z]{3})\s+(\d{4})$", k)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part(4)).cast("int")
    year = part(5).cast("int")
    said = F.unix_date(F.make_date(year, month, part(1).cast("int"))).cast("long") * US_PER_DAY + (part(2).cast("long") * 60 + part(3).cast("long")) * 60_000_000

    def when(side: str) -> Column:
        z = required(b, f"{side} TIME ZULU")
        clock = (F.substring(z, 1, 2).cast("long") * 60 + F.substring(z, 3, 2).cast("long")) * 60_000_000
        at = lambda y: day_us(y, required(b, f"{side} JDAY").cast("long")) + clock
        return F.when(said - at(year) > LOOKBACK_DAYS * US_PER_DAY, at(year + 1)).otherwise(at(year))

    out = rows.select(F.concat(F.lit("SVN"), required(b, "SVN")).alias("code"), field(b, "NANU NUMBER").alias("number"), when("START").alias("window_start"), when("STOP").alias("window_end"))
    return out.withColumn("epoch", F.floor((F.col("window_start") + F.col("window_end")) / 2))


def nagu(files: DataFrame) -> DataFrame:
    """Planned manoeuvres (PLN_MANV), at the start of their window."""
    rows, b = blocks(files, "NAGU TYPE").where(field(F.col("block"), "NAGU TYPE") == "PLN_MANV"), F.col("block")
    when = lambda side: epoch_us(required(b, rf"{side} DATE EVENT \(UTC\)"))
    out = rows.select(required(b, "SATELLITE AFFECTED").alias("code"), field(b, "NAGU NUMBER").alias("number"), when("START").alias("window_start"), when("END").alias("window_end"))
    return out.withColumn("epoch", F.col("window_start"))


def navsum(files: DataFrame) -> DataFrame:
    """The last manoeuvre day of each spacecraft that states one, at noon."""
    text = F.regexp_replace("text", r"\r\n?", "\n")
    rows = files.select("*", F.explode(F.split(text, "(?m)^=+$")).alias("block"))
    name, day = F.upper(F.regexp_extract("block", r"(?i)Spacecraft\s*:\s*(GOES-\d+)", 1)), r"(?i)last maneuver on\s+(\d{2})/(\d{1,3})"
    start = day_us(F.regexp_extract("block", day, 1).cast("int") + 2000, F.regexp_extract("block", day, 2).cast("long"))
    out = rows.where((name != "") & F.col("block").rlike(day)).select(name.alias("code"), start.alias("window_start"))
    return out.withColumns({"window_end": F.col("window_start") + US_PER_DAY, "epoch": F.floor(F.col("window_start") + US_PER_DAY / 2)})


def qzss_burns(files: DataFrame) -> DataFrame:
    """Rows of the manoeuvre section: code, start, end, magnitude, marker (null in six columns)."""
    section = F.regexp_extract("text", r"(?s)#\+SATELLITE/MANEUVER\s*\n(.*?)(?:#-SATELLITE/MANEUVER|\Z)", 1)
    lines = files.select("code", F.posexplode(F.split(section, r"\r?\n")).alias("seq", "line")).where((F.trim("line") != "") & ~F.ltrim("line").startswith("#"))
    f = F.transform(F.split("line", ","), lambda x: F.trim(x))
    rows = lines.withColumn("f", f).withColumn("k", F.when(F.size("f") >= 7, 1).otherwise(0))
    rows = rows.where(F.when(F.size("f") >= 6, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("too few fields: "), F.col("line"))).cast("boolean")))
    dv = [F.get("f", F.col("k") + 3 + i).cast("double") for i in range(3)]
    out = rows.where(~(F.get("f", F.lit(0)).startswith("0000-00-00") | F.get("f", F.lit(1)).startswith("0000-00-00")))
    return out.select("code", "seq", epoch_us(F.get("f", F.lit(0))).alias("start"), epoch_us(F.get("f", F.lit(1))).alias("end"), F.sqrt(dv[0] * dv[0] + dv[1] * dv[1] + dv[2] * dv[2]).alias("magnitude"), F.when(F.col("k") == 1, F.upper(F.get("f", F.lit(3)))).alias("marker"))


def burn_events(burns: DataFrame, gap_days: float = CAMPAIGN_DAYS) -> DataFrame:
    """Campaigns: a burn joins while it starts within gap_days of the latest end so far. Type by the largest burn's marker."""
    w = Window.partitionBy("code").orderBy("start", "seq")
    seen = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") - seen <= int(gap_days * US_PER_DAY), 0).otherwise(1)
    rows = burns.withColumn("new", new).withColumn("event", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("order", F.row_number().over(w))
    out = rows.groupBy("code", "event").agg(F.min("start").alias("window_start"), F.max("end").alias("window_end"), F.sum("magnitude").alias("delta_v"), F.max_by("marker", F.struct("magnitude", -F.col("order"))).alias("marker"))
    kind = F.when(F.col("marker") == "NS", "cross-track").when(F.col("marker") == "EW", "in-track")
    return out.select("code", F.col("window_start").alias("epoch"), "window_start", "window_end", "delta_v", kind.alias("maneuver_type"))


def tai_to_utc(us: Column) -> Column:
    """Subtracts the leap seconds in force: 10 s from 1972, one more from each later date."""
    import datetime

    begins = [(datetime.date.fromisoformat(d) - datetime.date(1970, 1, 1)).days * US_PER_DAY + (10 + k) * 1_000_000 for k, d in enumerate(LEAP_DAYS)]
    table = F.array(*[F.lit(b) for b in begins])
    return us - (9 + F.greatest(F.size(F.filter(table, lambda b: b <= us)), F.lit(1))) * 1_000_000


def doris(files: DataFrame) -> DataFrame:
    """Events of a manoeuvre history: velocity change of the summed burns, type by its largest axis, times from TAI."""
    lines = files.select(F.explode(F.split("text", r"\r?\n")).alias("line")).where((F.trim("line") != "") & ~F.ltrim("line").startswith("#"))
    rows = lines.select(F.split(F.trim("line"), r"\s+").alias("k"), "line")
    tok = lambda i: F.get("k", i if isinstance(i, Column) else F.lit(i))
    num = lambda i: tok(i).cast("long")
    clock = lambda i: tai_to_utc(day_us(num(i).cast("int"), num(i + 1)) + (num(i + 2) * 60 + num(i + 3)) * 60_000_000)
    base = F.when(tok(9).rlike(r"^\d+$"), 9).otherwise(10)
    rows = rows.withColumns({"short": F.size("k") == 9, "base": base}).withColumn("n", F.when(F.col("short"), 0).otherwise(F.get("k", F.col("base") + 1).cast("int")))
    sound = (F.size("k") >= 9) & (F.col("short") | (F.size("k") >= F.col("base") + 2 + F.col("n") * BURN_TOKENS))
    rows = rows.where(F.when(F.coalesce(sound, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("truncated line: "), F.col("line"))).cast("boolean")))
    at = lambda i, j: F.get("k", F.col("base") + 2 + i * BURN_TOKENS + j)
    total = lambda axis: F.aggregate(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0.0), lambda s, i: s + F.when(F.col("n") > 0, at(i, 6 + axis).cast("double")).otherwise(0.0))
    rows = rows.withColumns({f"s{a}": total(a) for a in range(3)} | {"code": F.upper(tok(0)), "window_start": clock(1), "window_end": clock(5), "param": F.get("k", F.col("base"))})
    z = F.lit(0)
    burn = tai_to_utc(day_us(at(z, 0).cast("int"), at(z, 1).cast("long")) + (at(z, 2).cast("long") * 60 + at(z, 3).cast("long")) * 60_000_000 + F.round(at(z, 4).cast("double") * 1e6).cast("long"))
    size = F.sqrt(F.col("s0") * F.col("s0") + F.col("s1") * F.col("s1") + F.col("s2") * F.col("s2"))
    a0, a1, a2 = (F.abs(f"s{i}") for i in range(3))
    axis = F.when((a0 >= a1) & (a0 >= a2), 0).when(a1 >= a2, 1).otherwise(2)
    kinds = F.create_map(*[F.lit(x) for p, names in AXES.items() for x in (p, ",".join(names))])
    kind = F.get(F.split(F.element_at(kinds, F.col("param")), ","), axis)
    has = F.col("n") > 0
    return rows.select(
        "code", F.when(has, burn).otherwise(F.floor((F.col("window_start") + F.col("window_end")) / 2)).alias("epoch"), "window_start", "window_end",
        F.when(has & (size > 0), kind).alias("maneuver_type"), F.when(has, size).alias("delta_v"),
    )


def crosswalk(labels: DataFrame, dim: DataFrame) -> DataFrame:
    """Adds norad_id by code; dim (code, norad_id) is a catalogue of satellites."""
    return labels.join(dim, "code", "left")
