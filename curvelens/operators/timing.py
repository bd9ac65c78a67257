"""Seconds per step early and late in every run, as windows and grouped percentiles: the rule of detectors.timing without Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvelens.model import SERIES, finite
from curvelens.operators import project

# What tells time, best first.
SOURCES = ["step_time", "throughput", "train/loss", "eval/loss"]


def intervals(observed: DataFrame) -> DataFrame:
    """Observations with their place, and seconds per step since the one before, null unless both clock and step advance."""
    w = Window.partitionBy(*SERIES).orderBy("step")
    passed, moved = F.col("wall_time") - F.lag("wall_time").over(w), F.col("step") - F.lag("step").over(w)
    return observed.withColumn("pos", F.row_number().over(w) - 1).withColumn("seconds", F.when((passed > 0) & ~F.isnan(passed) & (moved > 0), passed / moved))


def timings(readings: DataFrame, axis: str = "step", least: int = 5, part: float = 0.2) -> DataFrame:
    """Per run with a source of times: the source, its observations, invalid ones, and medians of the first and last ones.

    A run's best source counts even if it is poor. early, late and ratio are null where a first or last observation is invalid.
    """
    observed = project.observations(readings.filter(F.col("metric").isin(SOURCES)))
    series, run = Window.partitionBy(*SERIES), Window.partitionBy("source_id", "run_id")
    clocked = F.min((F.col("wall_time").isNotNull() & ~F.isnan("wall_time")).cast("int")).over(series) == 1
    rows = intervals(observed).withColumn("n", F.count(F.lit(1)).over(series)).withColumn("clocked", clocked)
    metric, logged = F.col("metric"), F.col("metric").isin(SOURCES[2:])
    usable = F.when(logged, F.lit(axis == "step") & F.col("clocked") & (F.col("n") >= 2 * least + 1)).otherwise(F.col("n") >= 2 * least)
    rank = F.when(usable, F.array_position(F.array(*map(F.lit, SOURCES)), metric))
    rows = rows.withColumn("rank", rank).withColumn("best", F.min("rank").over(run)).filter("rank = best")
    seconds = F.when(metric == "step_time", F.col("value")).when(metric == "throughput", F.when(finite(F.col("value")) & (F.col("value") > 0), 1 / F.col("value"))).otherwise(F.col("seconds"))
    first = F.when(logged, 1).otherwise(0)  # an interval needs the observation before it
    placed = rows.filter(F.col("pos") >= first).select("source_id", "run_id", "metric", "step", seconds.alias("s"), (F.col("pos") - first).alias("k"), (F.col("n") - first).alias("n"))
    width = F.least(F.greatest(F.lit(least), F.floor(F.col("n") * min(part, 0.5))), F.floor(F.col("n") / 2)).cast("long")
    placed = placed.withColumn("win", width).withColumn("bad", ~(finite(F.col("s")) & (F.col("s") > 0)))
    head, tail = F.col("k") < F.col("win"), F.col("k") >= F.col("n") - F.col("win")
    middle = lambda where: F.percentile(F.when(where, F.col("s")), F.lit(0.5))
    told = placed.groupBy("source_id", "run_id").agg(
        F.first("metric").alias("metric"), F.first("n").cast("long").alias("observations"), F.count_if("bad").alias("invalid"), F.first("win").alias("win"), middle(head).alias("early"), middle(tail).alias("late"),
        (F.count_if(F.col("bad") & (head | tail)) == 0).alias("good"), F.min(F.when(tail, F.col("step"))).alias("first_step"), F.max("step").alias("last_step"),
    )
    ratio = F.col("late") / F.col("early")
    fine = F.col("good") & finite(ratio) & (ratio > 0)
    return told.select("source_id", "run_id", "metric", "observations", "invalid", "win", "first_step", "last_step", *(F.when(fine, x).alias(name) for name, x in (("early", F.col("early")), ("late", F.col("late")), ("ratio", ratio))))
