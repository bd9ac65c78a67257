"""Aggregates of reports and studies: charts thinned for drawing, planted faults, how runs end."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvelens.model import SERIES, finite
from curvelens.operators.curves import excursions, levels
from curvelens.operators.detectors import RunView, grouped

#: Width of a chart; a column of it is half a pixel.
CHART = 920


def chart_columns(observed: DataFrame, width: int = CHART) -> DataFrame:
    """Observations with their half-pixel column over the steps of their run's series."""
    run = Window.partitionBy(*SERIES)
    lo, hi = F.min("step").over(run), F.max("step").over(run)
    x = F.when(hi > lo, (F.col("step") - lo) / (hi - lo)).otherwise(F.lit(0.0))
    return observed.filter(finite(F.col("value"))).withColumn("col", F.floor(x * (2 * width)).cast("long"))


def thinned(observed: DataFrame, width: int = CHART) -> DataFrame:
    """First, lowest, highest and last step of each column: what a line chart can show of them."""
    return chart_columns(observed, width).groupBy(*SERIES, "col").agg(
        F.count(F.lit(1)).alias("n"), F.min("step").alias("first_step"), F.min_by("step", F.struct("value", "step")).alias("low_step"),
        F.max_by("step", F.struct("value", (-F.col("step")).alias("s"))).alias("high_step"), F.max("step").alias("last_step"), F.min("value").alias("low"), F.max("value").alias("high"),
    )


def y_domain(observed: DataFrame) -> DataFrame:
    """Range of a chart: the maximum is cut at 1.5 times the 99th percentile where it exceeds that."""
    good = observed.filter(finite(F.col("value")) & (F.abs("value") < 1e150))
    return good.groupBy(*SERIES).agg(F.min("value").alias("low"), F.max("value").alias("max"), F.percentile("value", F.lit(0.99)).alias("p99")).select(*SERIES, "low", F.when(F.col("max") > 1.5 * F.col("p99"), 1.5 * F.col("p99")).otherwise(F.col("max")).alias("high"), (F.col("max") > 1.5 * F.col("p99")).alias("capped"))


def markers(observed: DataFrame, most: int = 200) -> DataFrame:
    """Of series with more than `most` points the highest of each of `most` columns, else all."""
    run = Window.partitionBy(*SERIES)
    placed = observed.filter(finite(F.col("value"))).withColumn("n", F.count(F.lit(1)).over(run)).withColumn("pos", F.row_number().over(run.orderBy("step")) - 1)
    col = F.when(F.col("n") > most, F.floor(F.col("pos") * most / F.col("n"))).otherwise(F.col("pos")).cast("long")
    return placed.withColumn("col", col).groupBy(*SERIES, "col").agg(F.max_by("step", F.struct("value", (-F.col("step")).alias("s"))).alias("step"), F.max("value").alias("value"))


# Planted faults, with where they begin and end as parts of a run and what they add in units of its progress.
FAULTS = [("nan_mid", 0.5, 0.5, None), ("nan_last", 1.0, 1.0, None), ("bump_0.5", 0.4, 0.55, 0.5), ("burst_0.5", 0.6, 0.62, 0.5), ("spike_1", 0.7, 0.7, 1.0)]


def fault_variants(observed: DataFrame, progress: float = 1.0) -> DataFrame:
    """Every curve once with each fault."""
    spark, run = observed.sparkSession, Window.partitionBy(*SERIES)
    placed = observed.withColumn("n", F.count(F.lit(1)).over(run)).withColumn("pos", F.row_number().over(run.orderBy("step")) - 1)
    faults = F.array(*(F.struct(F.lit(f).alias("fault"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(add).cast("double").alias("up")) for f, a, b, add in FAULTS))
    every = placed.select("*", F.explode(faults).alias("x")).select(*placed.columns, "x.*")
    first, last = F.least(F.floor(F.col("a") * F.col("n")), F.col("n") - 1), F.least(F.floor(F.col("b") * F.col("n")), F.col("n") - 1)
    hit = (F.col("pos") >= first) & (F.col("pos") <= last)
    return every.select(*SERIES, "fault", "step", F.when(hit & F.col("up").isNull(), float("nan")).when(hit, F.col("value") + F.col("up") * progress).otherwise(F.col("value")).alias("value"))


def endings(readings: DataFrame, metric: str = "train/loss") -> DataFrame:
    """How each run ends: short, bad, no progress, good or middling; with its tallest excursion."""

    def one(run: RunView, key: tuple) -> pd.DataFrame:
        curve = run.get(metric)
        label, share, tallest = "short", np.nan, 0.0
        if curve is not None and len(curve) >= 10:
            ok = np.isfinite(curve.value)
            lv = levels(curve.value[ok])
            if not ok[-1] or ok.sum() < 10:
                label = "bad" if not ok[-1] else "short"
            elif not lv.has_progress:
                label = "bad" if lv.start > 0 and lv.final >= 1.5 * lv.start else "no progress"
            else:
                share = lv.gave_back
                label = "good" if share < 0.1 else "bad" if share >= 0.5 else "middling"
                tallest = max((float((e.peak - e.base) / lv.progress) for e in excursions(lv)), default=0.0)
        return pd.DataFrame([{"source_id": key[0], "run_id": key[1], "ending": label, "gave_back": share, "tallest": tallest}])

    return grouped(readings, one, "source_id string, run_id string, ending string, gave_back double, tallest double")


def wilson(hits, n, z: float = 1.96):
    """95 % interval of a share, as expressions."""
    p, zz = hits / n, z * z
    mid, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))


def census(ends: DataFrame, found: DataFrame, planted: DataFrame) -> DataFrame:
    """Per ending and planted fault: runs, those with findings of their own, and those whose fault was found.

    ends has a row per run, found any number, planted (run, fault, caught) one per run and fault.
    """
    run = ["source_id", "run_id"]
    own = found.groupBy(*run).agg(F.count(F.lit(1)).alias("findings"))
    every = planted.groupBy(*run, "fault").agg(F.max("caught").alias("caught"))
    return ends.select(*run, "ending").join(own, run, "left").join(every, run).groupBy("ending", "fault").agg(F.count(F.lit(1)).alias("runs"), F.count("findings").alias("with_findings"), F.count_if("caught").alias("caught"))


def label_clusters(labels: DataFrame, keys: list[str], gap: float = 26.0) -> DataFrame:
    """Labels (x, text) of a chart in clusters, each less than `gap` pixels after the one before: one line of text each."""
    chart = Window.partitionBy(*keys).orderBy("x", "text")
    apart = F.coalesce(F.col("x") - F.lag("x").over(chart) >= gap, F.lit(True))
    numbered = labels.withColumn("apart", apart.cast("int")).withColumn("cluster", F.sum("apart").over(chart.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda p: p["text"]), " / ")
    return numbered.groupBy(*keys, "cluster").agg(F.min("x").alias("first_x"), F.max("x").alias("last_x"), F.count(F.lit(1)).alias("n"), text.alias("text"))


def purge_restarts(events: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (seq, step, restart) without those that a later restart at their step or before takes back; restarts go too."""
    later = Window.partitionBy(*keys).orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    return events.withColumn("__low", F.min("restart").over(later)).filter("restart is null and (__low is null or __low > step)").drop("__low")


def differences(old: DataFrame, new: DataFrame, keys: list[str], value: str, relative: float = 1e-10, absolute: float = 1e-12) -> DataFrame:
    """Rows of two reports that are missing on a side or differ by more than the tolerance."""
    both = old.select(*keys, F.col(value).alias("old")).join(new.select(*keys, F.col(value).alias("new")), keys, "full")
    far = F.abs(F.col("old") - F.col("new")) > F.greatest(F.lit(absolute), relative * F.greatest(F.abs("old"), F.abs("new")))
    return both.filter(F.col("old").isNull() | F.col("new").isNull() | far)
