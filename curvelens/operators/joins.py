"""Joins by order and by interval, and comparisons of two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], on: str = "step", value: str = "value", into: str = "matched") -> DataFrame:
    """Each left row with the right value at the greatest place not after its own: one union, one window."""
    names = [c for c in left.columns if c not in keys and c != on]
    lefts = left.select(*keys, on, F.struct(*names).alias("__row"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__value"))
    rights = right.select(*keys, on, F.lit(None).cast(lefts.schema["__row"].dataType).alias("__row"), F.lit(0).alias("__side"), F.col(value).alias("__value"))
    w = Window.partitionBy(*keys).orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.last(F.when(F.col("__side") == 0, F.struct(F.col("__value").alias("v"), F.col(on).alias("at"))), ignorenulls=True).over(w)
    return lefts.unionByName(rights).withColumn("__found", found).filter("__side = 1").select(*keys, on, *(F.col("__row")[n].alias(n) for n in names), F.col("__found.v").alias(into), F.col("__found.at").alias(f"{into}_{on}"))


def first_overlap(findings: DataFrame, culprits: DataFrame, keys: list[str]) -> DataFrame:
    """Each finding with the first culprit (by ord) whose steps it meets, its end widened by its own length (1 at least)."""
    f, c = findings.alias("f"), culprits.alias("c")
    slack = F.greatest(F.lit(1), F.col("f.step_end") - F.col("f.step_start"))
    meets = (F.col("f.step_start") <= F.col("c.step_end")) & (F.col("c.step_start") <= F.col("f.step_end") + slack)
    same = [F.col(f"f.{k}") == F.col(f"c.{k}") for k in keys]
    joined = f.join(c, [*same, meets], "left")
    return joined.groupBy(*(F.col(f"f.{x}") for x in findings.columns)).agg(F.min("c.ord").alias("culprit"))


def shared_interval(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Steps that two series of a run have in common as a range, and readings of both in it."""
    span = lambda df, p: df.groupBy(*keys).agg(F.min("step").alias(f"{p}_first"), F.max("step").alias(f"{p}_last"))
    both = span(a, "a").join(span(b, "b"), keys).select(*keys, F.greatest("a_first", "b_first").alias("lo"), F.least("a_last", "b_last").alias("hi")).filter("lo <= hi")
    inside = lambda df, name: df.join(both, keys).filter("step between lo and hi").groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return both.join(inside(a, "a_n"), keys, "left").join(inside(b, "b_n"), keys, "left").fillna(0, ["a_n", "b_n"])


def not_inside(jumps: DataFrame, rebounds: DataFrame, keys: list[str]) -> DataFrame:
    """Jumps without those that rise within the latest rebound that begins no later."""
    latest = asof(jumps, rebounds.withColumnRenamed("step_end", "rebound_end"), keys, "step_start", "rebound_end", "rebound_end")
    return latest.filter(~((F.col("after") > F.col("before")) & F.col("rebound_end").isNotNull() & (F.col("step_end") <= F.col("rebound_end")))).select(*jumps.columns)


def new_findings(now: DataFrame, seen: DataFrame) -> DataFrame:
    """Findings whose identity or severity was not there before."""
    return now.join(seen, ["source_id", "run_id", "detector", "metric", "title", "step_start", "severity"], "left_anti")


def extends(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per source and run: whether the new snapshot begins with all of the old one, position by position."""
    keys = ["source_id", "run_id", "metric"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("step", "seq"))
    o = old.withColumn("pos", place).select(*keys, "pos", F.struct("step", "value", "wall_time").alias("old"))
    n = new.withColumn("pos", place).select(*keys, "pos", F.struct("step", "value", "wall_time").alias("new"))
    same = o.join(n, [*keys, "pos"], "left").withColumn("same", F.coalesce(F.col("old").eqNullSafe(F.col("new")), F.lit(False)))
    return same.groupBy("source_id", "run_id").agg(F.bool_and("same").alias("extends"), F.count_if(~F.col("same")).alias("changed"))
