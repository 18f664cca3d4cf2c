"""Mixing sources to target weights by weighted fair queueing.

Sources in code-point order (null last) weigh 5, 2, 1, repeating. They share BUDGET times all
sizes; a source's target stops at REPEATS times its own size, and the excess is shared again by
weight until no target is above (water level, in closed form). Each source's documents are
shuffled by the MD5 of their id and offered REPEATS times over. The virtual finish time of a copy
is the source's cumulative words through it divided by the source's target. All copies in order
of finish time, cut where their cumulative words pass the budget, are the mix. As targets add up
to the budget, that cut lies where every source is at its target but for a document.

Skew: cumulative sums run over (source, leading digits of the shuffle key), joined with the sums
of the groups before; no task holds a whole source.

Defined cases: null text has size 0; documents of size 0 are never needed and have taken 0; null
sources form one source; null or repeated ids are told apart by size and text, wholly equal rows
each count; an empty table gives an empty result; columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WEIGHTS, BUDGET, REPEATS, SEED, DIGITS = (5, 2, 1), 1.5, 2, "mix-1", 3
ADDED = ["size", "source_size", "target", "taken"]


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shuffle_key() -> Column:
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) with rank and target. One row a source: the one global window has no more rows than that."""
    w = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(w))
    weight = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight.cast("long"), "cap": REPEATS * F.col("source_size")})
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    ranked = ranked.withColumns({
        "budget": F.sum("source_size").over(every) * F.lit(BUDGET),
        "caps": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
    })
    ranked = ranked.withColumn("level", (F.col("budget") - F.col("caps")) / F.col("rest"))
    ranked = ranked.withColumn("open", F.col("cap") / F.col("weight") > F.col("level"))
    water = F.max(F.when(F.col("open"), F.col("level"))).over(every)
    return ranked.withColumn("target", F.when(F.col("open"), F.col("weight") * water).otherwise(F.col("cap").cast("double"))).select("source", "source_size", "rank", "target", "budget")


def mix(docs: DataFrame) -> DataFrame:
    """docs with size, source_size (long), target (double) and taken (long): 0, 1 or REPEATS times the size."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.drop(*ADDED).withColumns({"size": words(), "__h": shuffle_key(), "__x": F.xxhash64("text")}).withColumn("__b", F.substring("__h", 1, DIGITS))
    light = scratch.write(rows.select("doc_id", "source", "size", "__h", "__x", "__b"))
    groups = light.groupBy("source", "__b").agg(F.sum("size").alias("n"))
    targets = source_targets(groups.groupBy("source").agg(F.sum("n").alias("source_size")))
    before = Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    groups = scratch.write(groups.join(targets, groups["source"].eqNullSafe(targets["source"])).select(groups["source"].alias("__s"), groups["__b"].alias("__gb"), "before", "source_size", "rank", "target", "budget"))

    def queued(part: DataFrame) -> DataFrame:
        inside = Window.partitionBy("source", "__b").orderBy("__h", F.col("doc_id").asc_nulls_last(), "size", "__x").rowsBetween(Window.unboundedPreceding, 0)
        joined = part.join(groups, part["source"].eqNullSafe(groups["__s"]) & (part["__b"] == groups["__gb"]))
        return joined.withColumn("__cum", F.col("before") + F.sum("size").over(inside))

    copies = queued(light).where("size > 0").select("rank", "size", "target", "budget", "source_size", "__cum", F.explode(F.array(*[F.lit(i) for i in range(REPEATS)])).alias("lap"))
    copies = copies.select("rank", "size", "budget", finish(F.col("lap")).alias("vft"), "lap", (F.col("lap") * F.col("source_size") + F.col("__cum")).alias("at"))
    # The cut is a little after 1: ranges of finish time, their sums, then the order inside the one range that crosses the budget.
    copies = copies.withColumn("range", F.least(F.floor(F.col("vft") * 4096), F.lit(1 << 14)).cast("int"))
    sums = copies.groupBy("range").agg(F.sum("size").alias("n"), F.max("budget").alias("budget"))
    upto = Window.orderBy("range")
    crossing = sums.withColumn("through", F.sum("n").over(upto)).where("through > budget").orderBy("range").select("range", (F.col("through") - F.col("n")).alias("before")).first()
    cut = None
    if crossing is not None:
        inside = Window.partitionBy("range").orderBy("vft", "rank", "at").rowsBetween(Window.unboundedPreceding, 0)
        held = copies.where(F.col("range") == crossing["range"]).withColumn("through", F.sum("size").over(inside) + crossing["before"])
        cut = held.where("through > budget").orderBy("vft", "rank", "at").select("vft", "rank", "at").first()
    out = queued(rows)
    laps = F.lit(0)
    for lap in range(REPEATS):
        mine = F.struct(finish(F.lit(lap)).alias("a"), F.col("rank").alias("b"), (F.lit(lap) * F.col("source_size") + F.col("__cum")).alias("c"))
        fits = F.lit(True) if cut is None else mine < F.struct(F.lit(cut["vft"]).alias("a"), F.lit(cut["rank"]).alias("b"), F.lit(cut["at"]).alias("c"))
        laps = laps + F.when(fits, 1).otherwise(0)
    out = out.withColumn("taken", F.when(F.col("size") > 0, F.col("size") * laps).otherwise(0).cast("long"))
    return out.select(*[f"`{c}`" for c in docs.columns if c not in ADDED], *ADDED)


def finish(lap: Column) -> Column:
    """Virtual finish time; sources without words have target 0 and no copies."""
    return (lap * F.col("source_size") + F.col("__cum")) / F.when(F.col("target") > 0, F.col("target"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns of docs."""
    out = mix(docs).where("taken > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))).select(*[f"`{c}`" for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", *ADDED)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM d GROUP BY source),
s2 AS (SELECT *, [5, 2, 1][CAST((rank - 1) % 3 + 1 AS INTEGER)] AS weight, 2 * source_size AS cap FROM s),
s3 AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget,
              coalesce(CAST(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0) AS caps,
              CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rest FROM s2),
s4 AS (SELECT *, (budget - caps) / rest AS level FROM s3),
s5 AS (SELECT *, CAST(cap AS DOUBLE) / weight > level AS open FROM s4),
t AS (SELECT source, source_size, rank, budget,
             CASE WHEN open THEN weight * max(CASE WHEN open THEN level END) OVER () ELSE CAST(cap AS DOUBLE) END AS target FROM s5),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.rank, t.budget,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT doc_id, size, rank, budget, lap * source_size + cum AS reach, CAST(lap * source_size + cum AS DOUBLE) / target AS vft
      FROM c, (SELECT unnest([0, 1]) AS lap) WHERE size > 0),
k AS (SELECT doc_id, sum(size) AS taken FROM (SELECT *, sum(size) OVER (ORDER BY vft, rank, reach ROWS UNBOUNDED PRECEDING) AS through FROM q)
      WHERE through <= budget GROUP BY doc_id)
SELECT c.doc_id, c.size, c.source_size, c.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken FROM c LEFT JOIN k USING (doc_id)
"""
