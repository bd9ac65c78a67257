"""Formula-made histories of any length: a falling loss with a stall, a late spike and a changing cadence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cadence(spark: SparkSession, n: int, parts: int = 8) -> DataFrame:
    """One run of n readings: the clock slows in the last fifth, the level stalls from 40 to 60 %, one reading at 80 % is tenfold."""
    x = F.col("id") / F.lit(float(n))
    level = 0.3 + 2.0 / (1 + 30 * F.when(x < 0.4, x).when(x < 0.6, 0.4).otherwise(x - 0.2))
    noise = 1 + 0.02 * (F.pmod(F.col("id") * 7919, F.lit(1001)) / 500.0 - 1)
    value = F.when(F.col("id") == int(0.8 * n), 10 * level).otherwise(level * noise)
    clock = F.col("id") * 0.5 + F.when(x > 0.8, (F.col("id") - 0.8 * n) * 0.5).otherwise(0.0)
    return spark.range(0, n, 1, parts).select(F.lit("formula").alias("source_id"), F.lit("long").alias("run_id"), F.lit("train/loss").alias("metric"), F.lit("loss").alias("raw_metric"), F.col("id").alias("seq"), F.col("id").alias("step"), value.cast("double").alias("value"), clock.cast("double").alias("wall_time"), F.lit(None).cast("double").alias("epoch"))
