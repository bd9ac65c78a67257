"""Watching logs: new readings arrive as files; touched runs are judged anew, and what is new is told.

Findings can be taken back (a restart, a rewritten history), so there is no watermark and no
append: each batch adds its readings to a table, recomputes the runs it touched from all their
readings, and compares with the findings told before. Tables live in a folder that all
executors share; a batch writes under its own number, so a batch that is run again after a
failure writes the same place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from curvelens.model import FINDINGS, READINGS
from curvelens.operators import joins
from curvelens.operators.detectors import run_all

IDENTITY = ["source_id", "run_id", "detector", "metric", "title", "step_start", "severity"]


def _table(spark: SparkSession, path: str, schema: str, before: int) -> DataFrame:
    """Rows of all batches up to `before`."""
    try:
        rows = spark.read.option("basePath", path).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return spark.createDataFrame([], schema)
        raise
    return rows.filter(F.col("batch") < before).drop("batch")


def judge(batch: DataFrame, number: int, home: str, axis: str = "step") -> DataFrame:
    """Adds a batch of readings and gives the findings that are new or changed in severity since the last one."""
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(f"{home}/readings/batch={number}")
    batch = spark.read.parquet(f"{home}/readings/batch={number}")
    touched = batch.select("source_id", "run_id").distinct()
    earlier = _table(spark, f"{home}/readings", READINGS, number)
    # a later reading of a step with the same place in the log replaces the earlier one: a rewrite
    now = earlier.join(touched, ["source_id", "run_id"], "left_semi")
    kept = now.join(batch.select("source_id", "run_id", "metric", "seq").distinct(), ["source_id", "run_id", "metric", "seq"], "left_anti")
    rewritten = now.join(batch, ["source_id", "run_id", "metric", "seq"], "left_semi").select("source_id", "run_id").distinct()
    found = run_all(kept.unionByName(batch), axis=axis)
    # where history was rewritten, all findings of the run are told again
    told = _table(spark, f"{home}/findings", FINDINGS, number).join(rewritten, ["source_id", "run_id"], "left_anti")
    new = joins.new_findings(found, told.select(*IDENTITY).distinct())
    new.write.mode("overwrite").parquet(f"{home}/findings/batch={number}")
    return spark.read.parquet(f"{home}/findings/batch={number}")


def watch(readings: DataFrame, home: str, publish: Callable[[DataFrame, int], None], once: bool = False, interval: str = "2 seconds", axis: str = "step") -> StreamingQuery:
    """Starts a query over a stream of readings; publish gets the new findings of each batch."""
    writer = readings.writeStream.foreachBatch(lambda batch, number: publish(judge(batch, number, home, axis), number)).option("checkpointLocation", f"{home}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def follow(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of readings from Parquet files that appear under a path."""
    return spark.readStream.schema(READINGS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
