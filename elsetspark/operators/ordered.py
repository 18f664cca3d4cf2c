"""Ranks, running values and order statistics of groups of any size, without a window over a group.

A class is one of five and may hold most rows, so that a window over it is one task. Ranks come
from a range sort instead: partitions are ranges of (group, order), what precedes a partition is a
sum over runs (what one partition holds of one group), and windows stay inside runs. Order
statistics are narrowed first: mergeable quantile sketches bracket them, one pass counts what lies
below and inside the brackets, and only rows inside are sorted.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Rows inside a bracket that one task may sort; wider brackets are narrowed again.
MOST = 200_000
#: Sketched quantiles a group, and the accuracy of the sketch (ten times finer than a cell).
CELLS, ACCURACY = 128, 1280


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder, on a local master only (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(shared_folder, "local", None) or tempfile.mkdtemp(prefix="elsetspark-")
        shared_folder.local = base
    return f"{base.rstrip('/')}/ordered-{uuid.uuid4().hex}"


def kept(df: DataFrame, by: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: no later job repeats it, and no lost executor loses it. Removed when the process ends.

    by: a column of few values, of which a later filter reads one alone."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)

    def remove() -> None:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM may be gone already at exit
            pass

    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    atexit.register(remove)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, group: list[str], order: list[Column], before: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """df with rank (from 1) in its group, and for each name in before the sum or max ("sum", column) over the group's earlier rows (null for none).

    order must tell rows apart, or rank and running values of equal rows are exchanged. No group: one over all rows.
    """
    before = before or {}
    values = {f"__v_{name}": value for name, (_, value) in before.items()}
    how = {f"__v_{name}": F.sum if kind == "sum" else F.max for name, (kind, _) in before.items()}
    sort = [*[F.col(c).asc() for c in group], *order]
    placed = kept(df.withColumns(values).repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    runs = placed.groupBy("__part", *group).agg(F.count("*").alias("__k"), *[how[v](v).alias(f"{v}_run") for v in values])
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a run
    named = {"__k": F.coalesce(F.sum("__k").over(earlier), F.lit(0)), **{f"{v}_run": how[v](f"{v}_run").over(earlier) for v in values}}
    runs = runs.withColumns(named).select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__g_{c}") for c in group], *named)
    same = F.col("__part") == F.col("__p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    inside = Window.partitionBy("__part", *group).orderBy("__at")
    past = inside.rowsBetween(Window.unboundedPreceding, -1)
    both = {"sum": lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": lambda a, b: F.greatest(a, b)}
    out = placed.join(runs, same).withColumn("rank", F.col("__k") + F.row_number().over(inside))
    out = out.withColumns({name: both[kind](F.col(f"__v_{name}_run"), how[f"__v_{name}"](f"__v_{name}").over(past)) for name, (kind, _) in before.items()}) if before else out
    return out.select(*[f"`{c}`" for c in df.columns], "rank", *before)


def _grid(column: str) -> Column:
    return F.percentile_approx(column, F.array(*[F.lit(i / CELLS) for i in range(CELLS + 1)]), F.lit(ACCURACY)).alias("grid")


def _wanted(sketch: DataFrame, group: list[str], at: dict[str, Callable[[Column], Column]]) -> DataFrame:
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), k(F.col("n")).cast("long").alias("k")) for name, k in at.items()])).alias("w")
    return kept(sketch.select(*group, "n", "grid", wanted).select(*group, "n", "grid", "w.name", "w.k"))


def order_statistics(values: DataFrame, group: list[str], at: dict[str, Callable[[Column], Column]], most: int | None = None) -> DataFrame:
    """group, n, name, k, low, high: for each name the values at places k and k + 1 of the group in ascending order (from 0; high is low at the end).

    values: the group's columns and value, nulls left out; at: k from the group's size n. Places outside the group have null values.
    """
    values = kept(values.select(*group, "value").where("value is not null"))
    targets = _wanted(values.groupBy(*group).agg(F.count("*").alias("n"), _grid("value")), group, at)
    found = _narrowed(values, group, targets.where((F.col("k") >= 0) & (F.col("k") < F.col("n"))), MOST if most is None else most)
    return targets.drop("grid").join(found, [*group, "name"], "left")


def column_statistics(rows: DataFrame, group: str, columns: list[str], at: dict[str, Callable[[Column], Column]], most: int | None = None) -> DataFrame:
    """order_statistics of several columns: group, channel (the column), n, name, k, low, high. Nulls are left out.

    rows hold doubles and are read twice, wide as they are (store them first): an Arrow pass counts, and only values inside a bracket become rows.
    group is a column of few values: its brackets go to every task.
    """
    key = [group, "channel"]
    sketch = rows.where(F.col(group).isNotNull()).groupBy(group).agg(*[F.struct(F.count(c).alias("n"), _grid(c)).alias(c) for c in columns])
    long = sketch.select(group, F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c)["n"].alias("n"), F.col(c)["grid"].alias("grid")) for c in columns])))
    targets = _wanted(long, key, at)
    brackets = _brackets(targets.where((F.col("k") >= 0) & (F.col("k") < F.col("n"))), key)
    spark, ends = rows.sparkSession, [tuple(r) for r in brackets.select(*key, "name", "lo", "hi").collect()]  # a few numbers a class and column

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each batch and bracket: a row of counts without a value, and a row for each value inside."""
        for batch in batches:
            found: list[tuple[int, int, np.ndarray]] = []
            held: dict = {}
            for i, (g, c, _, lo, hi) in enumerate(ends):
                if (g, c) not in held:
                    held[g, c] = batch.column(c).filter(pc.equal(batch.column(group), g)).drop_null().to_numpy(zero_copy_only=False)
                v = held[g, c]
                below = np.zeros(len(v), dtype=bool) if lo is None else v < lo
                found.append((i, int(below.sum()), v[~below if hi is None else ~below & (v <= hi)]))
            at = np.concatenate([np.full(1 + (0 if ends[i][3] is not None and ends[i][3] == ends[i][4] else len(v)), i, dtype=np.int32) for i, _, v in found])
            first = np.concatenate([[True], at[1:] != at[:-1]])
            counts = [np.zeros(len(at), dtype=np.int64) for _ in range(2)]
            counts[0][first], counts[1][first] = [n for _, n, _ in found], [len(v) for _, _, v in found]
            value = np.zeros(len(at))
            value[~first] = np.concatenate([v for i, _, v in found if ends[i][3] is None or ends[i][3] != ends[i][4]] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(value, mask=first), pa.array(counts[0]), pa.array(counts[1])], ["cell", "value", "below", "inside"])

    if not ends:
        return targets.drop("grid").withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    cells = F.broadcast(spark.createDataFrame([(i, *x[:3]) for i, x in enumerate(ends)], StructType([StructField("cell", IntegerType()), *brackets.select(*key, "name").schema.fields])))
    sifted = kept(rows.select(group, *columns).mapInArrow(sift, "cell int, value double, below long, inside long"))
    counts = sifted.where("value is null").groupBy("cell").agg(F.sum("below").alias("below"), F.sum("inside").alias("inside")).join(cells, "cell").drop("cell")
    band = sifted.where("value is not null").join(cells, "cell").select(*key, "name", "value")
    found = _settled(band, brackets, counts, key, MOST if most is None else most)
    return targets.drop("grid").join(found, [*key, "name"], "left")


def _brackets(targets: DataFrame, group: list[str]) -> DataFrame:
    """group, name, n, k and the ends lo and hi (null: none) between which the values at k and k + 1 lie."""
    cell = lambda k: F.col(k) / F.greatest(F.col("n") - 1, F.lit(1)) * CELLS
    lo, hi = F.floor(cell("k")).cast("int") - 1, F.ceil(cell("k1")).cast("int") + 1
    edge = lambda i: F.when((i > 0) & (i < CELLS), F.get("grid", i))
    # The sketch's error is a tenth of a cell and the bracket a cell wider on both sides, so that it holds both places.
    return kept(targets.withColumn("k1", F.col("k") + 1).select(*group, "name", "n", "k", edge(lo).alias("lo"), edge(hi).alias("hi")))


def _narrowed(values: DataFrame, group: list[str], targets: DataFrame, most: int) -> DataFrame:
    """group, name, low, high of targets (group, name, n, k, grid)."""
    key = [*group, "name"]
    brackets = _brackets(targets, group)
    rows = values.join(brackets.drop("n", "k"), group)
    below = F.coalesce(F.col("value") < F.col("lo"), F.lit(False))
    inside = ~below & F.coalesce(F.col("value") <= F.col("hi"), F.lit(True))
    counts = rows.groupBy(*key).agg(F.count_if(below).alias("below"), F.count_if(inside).alias("inside"))
    one = F.coalesce(F.col("lo") == F.col("hi"), F.lit(False))
    return _settled(rows.where(inside & ~one).select(*key, "value"), brackets, counts, group, most)


def _settled(band: DataFrame, brackets: DataFrame, counts: DataFrame, group: list[str], most: int) -> DataFrame:
    """group, name, low, high of brackets. band: the values inside them; counts: how many lie below and inside."""
    key = [*group, "name"]
    state = brackets.join(counts, key).withColumn("k", F.col("k") - F.col("below"))
    sound = (F.col("k") >= 0) & (F.col("k") < F.col("inside")) & ((F.col("k") + 1 < F.col("inside")) | (F.col("below") + F.col("inside") == F.col("n")))
    state = kept(state.withColumn("k", F.when(sound, F.col("k")).otherwise(F.raise_error(F.lit("a bracket misses its order statistic")).cast("long"))))
    one = F.coalesce(F.col("lo") == F.col("hi"), F.lit(False))
    same = state.where(one).select(*key, F.col("lo").alias("low"), F.col("hi").alias("high"))
    wide = state.where(~one & (F.col("inside") > most)).select(*key, "k", F.col("inside").alias("m"))
    few = state.where(~one & (F.col("inside") <= most)).select(*key, "k")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("value")) - 1 - F.col("k")
    picked = band.join(few, key).withColumn("i", place).where(F.col("i").isin(0, 1)).groupBy(*key).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    out = same.unionByName(picked)
    if wide.isEmpty():
        return out
    # Bands that are still too wide are groups of their own, sketched again.
    held = f"__name{len(group)}"  # of its own at every depth
    named = [c if c != "name" else held for c in key]
    again = kept(band.join(wide.select(*key), key, "left_semi").withColumnRenamed("name", held))
    sketch = again.groupBy(*named).agg(_grid("value")).join(wide.withColumnRenamed("name", held), named)
    deeper = _narrowed(again, named, sketch.select(*named, F.lit("").alias("name"), F.col("m").alias("n"), "k", "grid"), most)
    return out.unionByName(deeper.drop("name").withColumnRenamed(held, "name"))
