"""Extensions over tables: as-of joins, the best rows of each group, and distinct counts that can be merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Log2 of the registers of a sketch: its standard error is 1.04 / sqrt(2 ** 14), below one percent.
SKETCH = 14


def asof_join(left: DataFrame, right: DataFrame, by: str, ts: str = "ts", tie: str | None = None, tolerance: str | None = None, span: str = "1 day") -> DataFrame:
    """Each row of ``left`` with ``match``, the last row of ``right`` of the same key that is not later, or null.

    Of rows of ``right`` at one time the one with the greatest ``tie`` counts. A match that is more than ``tolerance`` earlier is none. Rows
    are dealt by key and span of time, so a key with many rows is many groups; what a span hands on is one row, and those are few
    enough to be put in order by key. Null keys and null times match nothing; repeated rows of ``left`` are repeated.
    """
    other = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    part = F.window(F.col("_ts"), span)["start"]
    null = F.lit(None)
    l = left.select(F.col(by).alias("_by"), F.col(ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_l"))  # noqa: E741
    timed = F.col("_ts").isNotNull() & F.col("_by").isNotNull()
    order = F.col(f"`{tie}`") if tie else F.lit(0)
    r = right.select(F.col(by).alias("_by"), F.col(ts).alias("_ts"), F.lit(0).alias("_side"), other.alias("_r"), order.alias("_tie")).where(timed)
    both = l.where(timed).withColumn("_r", null.cast(r.schema["_r"].dataType)).withColumn("_tie", null.cast(r.schema["_tie"].dataType)).unionByName(r.withColumn("_l", null.cast(l.schema["_l"].dataType)))
    rows = both.withColumn("_part", part)
    within = Window.partitionBy("_by", "_part").orderBy("_ts", "_side", F.col("_tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("_near", F.last("_r", ignorenulls=True).over(within)).where("_side = 1")
    ends = rows.groupBy("_by", "_part").agg(F.max_by("_r", F.when(F.col("_side") == 0, F.struct("_ts", "_tie"))).alias("_end"))
    before = Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.withColumn("_far", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    found = near.join(handed, ["_by", "_part"], "left").withColumn("_m", F.coalesce("_near", "_far"))
    held = F.col("_m") if tolerance is None else F.when(F.col(f"_m.`{ts}`") >= F.col("_ts") - F.expr(f"INTERVAL {tolerance}"), F.col("_m"))
    untimed = l.where(~timed).select("_l", null.cast(r.schema["_r"].dataType).alias("match"))
    return found.select("_l", held.alias("match")).unionByName(untimed).select("_l.*", "match")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their ``rank``. ``order`` should decide all ties, so that the result is one.

    The optimizer keeps the first k of each group in every task before the shuffle, so a hot group sends k rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def distinct_sketches(df: DataFrame, by: list[str], value: str, n: Column | None = None, lg: int = SKETCH) -> DataFrame:
    """A sketch of the distinct values of each group, beside how many rows it has, or the sum of ``n``: by, n, sketch. Small, and mergeable: store these and not the values."""
    return df.groupBy(*by).agg((F.count(F.lit(1)) if n is None else F.sum(n)).alias("n"), F.hll_sketch_agg(value, F.lit(lg)).alias("sketch"))


def cube_of_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Rows and about how many distinct values under every grouping of ``by``; a column that is summed over is "*": by, n, about."""
    cubed = sketches.cube(*by).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"), *[F.grouping(c).alias(f"_{c}") for c in by])
    return cubed.select(*[F.when(F.col(f"_{c}") == 1, "*").otherwise(F.col(c).cast("string")).alias(c) for c in by], "n", "about")
