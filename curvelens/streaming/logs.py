"""Watching logs in any format: the logs are read anew at every poll, and what is new is told.

Logs grow, are cut short while they are written, and are rewritten by restarts, so a poll reads
them whole (each up to the size that it had when it was listed) and compares tables: the
readings with those of the poll before, the findings with those told. All state is Parquet in
a folder that the executors share; the driver holds names of tables and a status.

Defined results. A log that cannot be read keeps the readings and findings it had, and the
status is 2 until it can be read again. Where a run's readings no longer begin with those of the
poll before, all its findings are told again. A run that was asked for is looked up once and held.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelens import report
from curvelens.operators import detectors, joins, project
from curvelens.sources import load, load_sources

IDENTITY = ["source_id", "run_id", "detector", "metric", "title", "step_start", "severity"]
RUN = ["source_id", "run_id"]


@dataclass
class Poll:
    """What a poll found: findings that are new, the status of the gate, and a remark on the input or None."""

    new: DataFrame | None
    status: int
    notice: str | None
    rewritten: int = 0


class LogWatch:
    """The state of watching one path."""

    def __init__(self, spark: SparkSession, path: str, home: str, run: str | None = None, fail_on: str | None = None, require_timing: bool = False, **options):
        self.spark, self.path, self.home, self.options = spark, path, home, options
        self.run, self.fail_on, self.require_timing = run, fail_on, require_timing
        self.number, self.before, self.notice = 0, None, None

    def _at(self, name: str, number: int) -> str:
        return f"{self.home}/{name}-{number}"

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        path = self._at(name, self.number)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _removed(self, number: int) -> None:
        for name in ("sources", "fresh", "readings", "findings", "new"):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(name, number))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        """Removes the tables of the state."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.home)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _held(self, readings: DataFrame) -> DataFrame:
        """The readings of the run that was asked for, as it was first found."""
        if self.run is None:
            return readings
        chosen = self._at("chosen", 0)
        if self.before is None:
            project.select_run(readings, self.run).write.mode("overwrite").parquet(chosen)
        return readings.join(self.spark.read.parquet(chosen), RUN, "left_semi")

    def _told(self, notice: str | None) -> str | None:
        """A remark, unless it is that of the poll before."""
        same, self.notice = notice == self.notice, notice
        return None if same else notice

    def poll(self) -> Poll:
        self.number += 1
        try:
            sources = self._stored(load_sources(self.spark, self.path, **self.options), "sources")
            fresh = self._stored(load(self.spark, self.path, **self.options), "fresh")
        except Exception as e:  # a log that is being written, moved or made: the next poll reads it
            self._removed(self.number)
            return Poll(None, 2, self._told(f"skipped this read: {str(e).splitlines()[0]}"))
        failed = sources.filter("error is not null").select("source_id")
        now = self._held(fresh)
        if self.before is not None:
            earlier = self.spark.read.parquet(self._at("readings", self.before))
            now = now.unionByName(earlier.join(failed, "source_id", "left_semi"))
        now = self._stored(now, "readings")
        if not now.filter("value is not null").limit(1).count():
            error = sources.filter("error is not null").select(F.min("error")).first()[0]
            self._removed(self.number)
            return Poll(None, 2, self._told(f"skipped this read: {error or 'no metrics were found'}"))
        axes = [r["axis"] for r in sources.filter("error is null").select("axis").distinct().limit(2).collect()]
        axis = axes[0] if len(axes) == 1 else "step"
        found = self._stored(detectors.run_all(now, axis=axis), "findings")
        new, rewritten = found, 0
        if self.before is not None:
            changed = joins.extends(earlier, now).filter("not extends").select(*RUN)
            rewritten = changed.count()
            told = self.spark.read.parquet(self._at("findings", self.before)).join(changed, RUN, "left_anti")
            new = joins.new_findings(found, told.select(*IDENTITY).distinct())
        new = self._stored(new, "new")
        broken = sources.filter(report.INCOMPLETE).select(F.count(F.lit(1)).alias("n"), F.min("source_id").alias("first")).first()
        timing = report.timing_ratios(now, axis) if self.require_timing else None
        status = report.gate(found, sources, self.fail_on, timing, now)
        if failed.limit(1).count():
            status = 2
        if broken["n"]:
            notice = self._told(f"{broken['n']} logs are incomplete, the first is {broken['first']}")
        elif self.notice is not None:
            self._told(None)
            notice = "read recovered: all input was read"
        else:
            notice = None
        if self.before is not None:
            self._removed(self.before)
        self.before = self.number
        return Poll(new, status, notice, rewritten)
