"""From readings to observations: one row per series and step, nothing invented or merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvelens.functions.windows import by_step, island
from curvelens.model import SERIES, finite


def steps(readings: DataFrame) -> DataFrame:
    """Per series and step: readings, readable ones, whether readable values differ, the first value, the clock, whether clocks differ.

    Extremes tell whether values differ: unlike counts of distinct values they need no copy of every row per counted
    column. NaN is the greatest value and equal to itself.
    """
    n, clocks = F.count(F.lit(1)), F.count("wall_time")
    differ = lambda c: F.coalesce(F.min(c) < F.max(c), F.lit(False))
    return readings.groupBy(*SERIES, "step").agg(
        n.alias("n"), F.count("value").alias("readable"), differ("value").alias("unequal"), F.min_by("value", "seq").alias("first_value"),
        F.when((clocks == n) & ~differ("wall_time"), F.max("wall_time")).alias("wall_time"), F.min_by("epoch", "seq").alias("epoch"),
        (differ("wall_time") | ((clocks > 0) & (clocks < n))).alias("unequal_times"),
    )


def observations(readings: DataFrame) -> DataFrame:
    """One row per step of every series without conflicting values.

    A step with an unreadable reading is a gap (NULL); unequal clocks at a step are NULL; a
    series with two readable values at any step is left out as a whole.
    """
    # dealt by series once: the grouping by step and the window over the series both keep to that
    per_step = steps(readings.select(*SERIES, "step", "seq", "value", "wall_time", "epoch").repartition(*SERIES))
    kept = per_step.withColumn("conflict", F.max("unequal").over(Window.partitionBy(*SERIES))).filter("not conflict")
    return kept.select(*SERIES, "step", F.when(F.col("readable") == F.col("n"), F.col("first_value")).alias("value"), "wall_time", "epoch")


def conflicting(readings: DataFrame) -> DataFrame:
    """Series that have a step with unequal readable values."""
    return steps(readings).groupBy(*SERIES).agg(F.count_if("unequal").alias("conflicting_steps")).filter("conflicting_steps > 0")


def repeated_steps(readings: DataFrame) -> DataFrame:
    """Steps with several readings, and whether values or clocks disagree."""
    return steps(readings).filter("n > 1").select(*SERIES, "step", "n", F.col("unequal").alias("conflicting_values"), F.col("unequal_times").alias("conflicting_times"))


def summary(readings: DataFrame) -> DataFrame:
    """Per series: readings, readable ones, distinct steps, first and last step, unreadable steps, whether it is left out."""
    per_step = steps(readings)
    return per_step.groupBy(*SERIES).agg(
        F.sum("n").alias("readings"), F.sum("readable").alias("readable"), F.count(F.lit(1)).alias("distinct_steps"), F.min("step").alias("first_step"), F.max("step").alias("last_step"),
        F.count_if(F.col("readable") < F.col("n")).alias("unreadable_steps"), F.max("unequal").alias("excluded"),
    )


def promoted(readings: DataFrame, known: list[str]) -> DataFrame:
    """Readings of metrics that have a number or a known name; text columns go."""
    numeric = readings.groupBy("source_id", "run_id", "metric").agg(F.count("value").alias("numbers"))
    return readings.join(numeric.filter((F.col("numbers") > 0) | F.col("metric").isin(known)).select(*SERIES), SERIES, "left_semi")


def segments(observed: DataFrame) -> DataFrame:
    """Finite observations with their segment: its number, and place and size in it."""
    w = by_step()
    marked = observed.withColumn("pos", F.row_number().over(w) - 1).withColumn("gap", island(F.col("value"), w)).filter(finite(F.col("value")))
    own = Window.partitionBy(*SERIES, "gap").orderBy("step")
    seg = F.dense_rank().over(Window.partitionBy(*SERIES).orderBy("gap")) - 1
    return marked.withColumn("seg", seg).withColumn("seg_pos", F.row_number().over(own) - 1).withColumn("seg_n", F.count(F.lit(1)).over(Window.partitionBy(*SERIES, "gap"))).drop("gap")


def nonfinite(readings: DataFrame) -> DataFrame:
    """Per series with NaN or infinite readings: the first and last such step, readings, distinct steps."""
    bad = readings.filter(F.col("value").isNotNull() & ~finite(F.col("value")))
    return bad.groupBy(*SERIES).agg(F.min("step").alias("first_bad_step"), F.max("step").alias("last_bad_step"), F.count(F.lit(1)).alias("n_bad"), F.count_distinct("step").alias("bad_steps"))


def default_run(readings: DataFrame) -> DataFrame:
    """Of each source the run with the most readings, the first to appear on ties."""
    runs = readings.groupBy("source_id", "run_id").agg(F.count(F.lit(1)).alias("points"), F.min("seq").alias("ord"))
    best = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("points"), "ord", "run_id"))
    return runs.withColumn("place", best).filter("place = 1").select("source_id", "run_id", "points")


def select_run(readings: DataFrame, wanted: str) -> DataFrame:
    """Per source the run that is meant: the exact id, or the only one that begins so."""
    runs = readings.select("source_id", "run_id").distinct().filter(F.startswith(F.col("run_id"), F.lit(wanted)))
    counted = runs.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.min("run_id").alias("first"), F.count_if(F.col("run_id") == wanted).alias("exact"))
    return counted.filter("exact = 1 or n = 1").select("source_id", F.when(F.col("exact") == 1, F.lit(wanted)).otherwise(F.col("first")).alias("run_id"))


def complete(readings: DataFrame) -> DataFrame:
    """Per source: whether nothing is unreadable and no step has unequal values or clocks, with the counts."""
    per_step = steps(readings)
    told = per_step.groupBy("source_id").agg(F.sum(F.col("n") - F.col("readable")).alias("unreadable"), F.count_if("unequal").alias("conflicts"), F.count_if(F.col("n") > 1).alias("repeats"), F.count_if("unequal_times").alias("times"))
    return told.withColumn("complete", (F.col("unreadable") == 0) & (F.col("conflicts") == 0) & (F.col("times") == 0)).drop("times")
