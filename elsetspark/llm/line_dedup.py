"""Line dedup by overlapping three-line windows.

A text is its lines (split at \\n). Every three consecutive lines that are not all empty form a
window, named by the MD5 of its text. Of a window found anywhere else, in the same document or
another, the first occurrence by (doc_id, nulls last; MD5 of the text; position) stays; the lines
of every later one are covered, and covered lines go. Overlapping windows merge, as a covered
line counts once.

Texts are exchanged once, to meet what is covered, and stream past it: the covered positions are
the build side, so that no text is sorted.

Defined cases: null text stays null with zero lines; empty text has one empty line; texts of
fewer than three lines stay as they are; wholly repeated rows (same id and text) count as one
document and get the same result each; an empty table gives an empty result; extra columns are
kept, and columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 3


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with text replaced by the kept lines, and n_lines, n_removed (long)."""
    rows = docs.drop("n_lines", "n_removed").withColumns({"__tmd": F.md5(F.coalesce("text", F.lit(""))), "__no": F.col("doc_id").isNull(), "__id": F.col("doc_id")})
    lines = F.split("text", "\n", -1)
    windows = rows.select("__no", "__id", "__tmd", lines.alias("__l")).where(F.size("__l") >= WIDTH)
    at = F.sequence(F.lit(0), F.size("__l") - WIDTH)
    windows = windows.select("__no", "__id", "__tmd", F.posexplode(F.transform(at, lambda i: F.array_join(F.slice("__l", i + 1, WIDTH), "\n"))).alias("pos", "w"))
    windows = windows.where(F.col("w") != "\n" * (WIDTH - 1)).select("__no", "__id", "__tmd", "pos", F.unhex(F.md5("w")).alias("wh"))
    order = F.struct("__no", "__id", "__tmd", "pos")
    first = windows.groupBy("wh").agg(F.min(order).alias("first"), F.max(order).alias("last")).where(F.col("first") < F.col("last")).select("wh", "first")
    later = windows.join(first, "wh").where(order > F.col("first"))
    covered = later.groupBy("__no", "__id", "__tmd").agg(F.collect_set("pos").alias("at"))
    covered = covered.select("__no", "__id", "__tmd", F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + WIDTH - 1)))).alias("__cov"))
    key = (rows["__id"].eqNullSafe(covered["__id"])) & (rows["__tmd"] == covered["__tmd"]) & (rows["__no"] == covered["__no"])
    out = rows.join(covered.hint("shuffle_hash"), key, "left").select(rows["*"], F.coalesce("__cov", F.array().cast("array<int>")).alias("__cov"))
    held = "__lines"
    while held in docs.columns:
        held += "_"
    out = out.withColumn(held, lines)  # a column of its own: inside the lambda below it would be split again for every line
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(held) - 1), "__cov"), lambda i: F.element_at(held, i + 1))
    named = {
        "text": F.when(F.size("__cov") > 0, F.array_join(kept, "\n")).otherwise(F.col("text")),
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(held)).cast("long"),
        "n_removed": F.size("__cov").cast("long"),
    }
    return out.select(*[(named.get(c, F.col(f"`{c}`"))).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")], named["n_lines"].alias("n_lines"), named["n_removed"].alias("n_removed"))


ORACLE = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i AS pos, md5(l[i + 1] || chr(10) || l[i + 2] || chr(10) || l[i + 3]) AS wh
      FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS i FROM d WHERE len(l) >= 3)
      WHERE length(l[i + 1]) + length(l[i + 2]) + length(l[i + 3]) > 0),
late AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY wh ORDER BY doc_id, pos) AS k FROM w) WHERE k > 1),
cov AS (SELECT DISTINCT doc_id, pos + o AS pos FROM late, (SELECT unnest([0, 1, 2]) AS o)),
ln AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM d),
k AS (SELECT ln.doc_id, string_agg(CASE WHEN cov.pos IS NULL THEN line END, chr(10) ORDER BY ln.pos) AS text,
             count(*) AS n_lines, count(cov.pos) AS n_removed
      FROM ln LEFT JOIN cov ON ln.doc_id = cov.doc_id AND ln.pos = cov.pos GROUP BY ln.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN k USING (doc_id)
"""
