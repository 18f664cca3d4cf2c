"""Two-line element sets by fixed columns, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import US_PER_DAY


def checksum(line: Column) -> Column:
    """Digits of columns 1 to 68 count their value, minus signs 1; modulo 10."""
    body = F.substring(line, 1, 68)
    count = lambda *c: F.length(body) - F.length(F.translate(body, "".join(map(str, c)), ""))
    # By the binary places of a digit: four counts in place of nine.
    return (count("-", *range(1, 10, 2)) + 2 * count(2, 3, 6, 7) + 4 * count(4, 5, 6, 7) + 8 * count(8, 9)) % 10


def implied(text: Column) -> Column:
    """Decimal with an implied leading point and an exponent: ' 12345-4' is 0.12345e-4."""
    t = F.trim(text)
    sign = F.when(t.startswith("-"), -1.0).otherwise(1.0)
    body = F.regexp_replace(t, "^[+-]", "")
    digits, power = F.regexp_extract(body, r"^(\d+)", 1), F.regexp_extract(body, r"([+-]\d)$", 1)
    return sign * F.concat(F.lit("0."), F.when(digits == "", "0").otherwise(digits)).cast("double") * F.pow(F.lit(10.0), F.when(power == "", 0.0).otherwise(power.cast("double")))


def epoch_us(year: Column, day: Column) -> Column:
    """Two-digit year (57 and later: 19yy) and fractional day of year to microseconds since 1970."""
    full = F.when(year >= 57, year + 1900).otherwise(year + 2000)
    return (F.unix_date(F.make_date(full, F.lit(1), F.lit(1))).cast("long") * US_PER_DAY + F.round((day - 1) * US_PER_DAY)).cast("long")


def held(df: DataFrame, *columns: Column) -> DataFrame:
    """df.select(*columns), evaluated once: what follows is not written into it, however often it names a column."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def parse(pairs: DataFrame, strict: bool = True) -> DataFrame:
    """Elsets of rows with line1, line2. strict: a malformed pair raises; else it is dropped."""
    pairs = held(pairs, F.col("line1"), F.col("line2"))
    a, b = F.col("line1"), F.col("line2")
    cut = lambda line, lo, hi: F.trim(F.substring(line, lo, hi - lo + 1))
    n = cut(b, 53, 63).try_cast("double")
    sound = (
        (F.length(a) >= 69) & (F.length(b) >= 69) & a.startswith("1 ") & b.startswith("2 ") & (cut(a, 3, 7) == cut(b, 3, 7))
        & (checksum(a) == F.substring(a, 69, 1).try_cast("int")) & (checksum(b) == F.substring(b, 69, 1).try_cast("int")) & (n > 0)
    )
    sound = F.coalesce(sound, F.lit(False))
    pairs = pairs.where("line1 is not null or line2 is not null")
    rows = pairs.where(F.when(sound | (a.isNull() & b.isNull()), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("malformed element set: "), a)).cast("boolean"))) if strict else pairs.where(sound)
    launch = cut(a, 10, 17)
    year = F.substring(launch, 1, 2).try_cast("int")
    objid = F.when(launch == "", "").otherwise(F.concat(F.when(year >= 57, year + 1900).otherwise(year + 2000).cast("string"), F.lit("-"), F.substring(launch, 3, 20)))
    return rows.select(
        cut(a, 3, 7).cast("long").alias("norad_id"), epoch_us(F.substring(a, 19, 2).cast("int"), F.substring(a, 21, 12).cast("double")).alias("t"),
        n.alias("mean_motion"), F.concat(F.lit("0."), cut(b, 27, 33)).try_cast("double").alias("eccentricity"), cut(b, 9, 16).try_cast("double").alias("inclination"), cut(b, 18, 25).try_cast("double").alias("raan"),
        cut(b, 35, 42).try_cast("double").alias("arg_perigee"), cut(b, 44, 51).try_cast("double").alias("mean_anomaly"), implied(F.substring(a, 54, 8)).alias("bstar"),
        (F.regexp_replace(F.substring(a, 34, 10), " ", "").cast("double") * 2).alias("mean_motion_dot"), (implied(F.substring(a, 45, 8)) * 6).alias("mean_motion_ddot"),
        F.coalesce(cut(a, 65, 68).try_cast("long"), F.lit(0)).alias("element_set_no"), F.coalesce(cut(b, 64, 68).try_cast("long"), F.lit(0)).alias("rev_at_epoch"), F.substring(a, 8, 1).alias("classification"), objid.alias("object_id"),
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of files with two or three lines a set, title lines skipped; an orphan line is an error."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    lines = text.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("i", "line")).where(F.col("line").rlike("^[12] "))
    w = Window.partitionBy("file").orderBy("i")
    named = lines.withColumns({"next": F.lead("line").over(w), "last": F.lag("line").over(w)})
    orphan = (F.col("line").startswith("1 ") & ~F.coalesce(F.col("next").startswith("2 "), F.lit(False))) | (F.col("line").startswith("2 ") & ~F.coalesce(F.col("last").startswith("1 "), F.lit(False)))
    checked = named.withColumn("line", F.when(orphan, F.raise_error(F.concat(F.lit("orphan line: "), F.col("line")))).otherwise(F.col("line")))
    first = F.col("line").startswith("1 ")
    return checked.where(first).select(F.when(first, F.col("line")).alias("line1"), F.when(first, F.col("next")).alias("line2"))
