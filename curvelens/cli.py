"""analyze and watch from a shell."""

from __future__ import annotations

import argparse
import json
import shutil
import sys
import tempfile
import time
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import curvelens
from curvelens import report
from curvelens.model import SEVERITIES
from curvelens.operators import detectors, project
from curvelens.sources import FORMATS, check_options, load, load_sources
from curvelens.sources.text import Unreadable
from curvelens.streaming.logs import LogWatch


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="curvelens", description="Diagnose training histories.")
    parser.add_argument("command", choices=["analyze", "watch"])
    parser.add_argument("path")
    parser.add_argument("--format", choices=[*FORMATS, "mlflow-files"])
    parser.add_argument("--run")
    parser.add_argument("--chart-single-run")
    parser.add_argument("--step-key")
    parser.add_argument("--output", choices=["terminal", "json", "html"], default="terminal")
    parser.add_argument("--out")
    parser.add_argument("--fail-on", choices=list(SEVERITIES))
    parser.add_argument("--require-timing", action="store_true")
    parser.add_argument("--no-color", action="store_true")
    parser.add_argument("--title")
    parser.add_argument("--interval", type=float, default=2.0, help="seconds between two polls of watch")
    parser.add_argument("--once", action="store_true", help="watch polls once")
    parser.add_argument("--home", help="watch keeps its tables in this folder, which all executors share")
    given = parser.parse_args(args)
    cloudpickle.register_pickle_by_value(curvelens)
    spark = spark or SparkSession.builder.appName("curvelens").getOrCreate()
    options = {"fmt": given.format, "step_key": given.step_key, "single_run": given.chart_single_run}
    if given.format is not None:
        try:
            check_options(given.format, given.step_key, given.chart_single_run, given.run)
        except Unreadable as e:
            print(e, file=sys.stderr)
            return 2
    if given.command == "watch":
        return _watch(spark, given, options)
    sources = load_sources(spark, given.path, run=given.run, **options).cache()
    readings = load(spark, given.path, run=given.run, **options).cache()
    axes = [r["axis"] for r in sources.select("axis").distinct().collect()]
    if not readings.filter("value is not null").limit(1).count():
        for r in sources.filter("error is not null").limit(10).collect():
            print(f"{r['source_id']}: {r['error']}", file=sys.stderr)
        print("no metrics were found", file=sys.stderr)
        return 2
    axis = axes[0] if len(axes) == 1 else "step"
    found = detectors.run_all(readings, axis=axis).cache()
    pages = report.documents(readings, found)
    if given.output == "json":
        text = json.dumps(pages if len(pages) > 1 else pages[0], indent=2) + "\n"
    elif given.output == "html":
        observed = project.observations(readings)
        text = "\n".join(report.page(p, report.charts(observed, p["run"]["source_id"], p["run"]["run_id"]), given.title) for p in pages)
    else:
        text = "\n".join(report.terminal(p, not given.no_color and given.out is None and sys.stdout.isatty()) for p in pages)
    if given.out:
        report.write(given.out, text, (given.path,))
    else:
        print(text, end="")
    timing = report.timing_ratios(readings, axis) if given.require_timing else None
    return report.gate(found, sources, given.fail_on, timing, readings)


def _watch(spark: SparkSession, given: argparse.Namespace, options: dict) -> int:
    """Polls until a gate fails or someone stops it; every finding is printed once."""
    home = given.home or spark.conf.get("spark.checkpoint.dir", None)
    if home is None and not spark.sparkContext.master.startswith("local"):
        print("set --home or spark.checkpoint.dir to a folder that all executors share", file=sys.stderr)
        return 2
    own = tempfile.mkdtemp(prefix="curvelens-watch-") if home is None else None
    state = LogWatch(spark, given.path, f"{home or 'file://' + own}/logs-{uuid.uuid4().hex}", given.run, given.fail_on, given.require_timing, **options)
    status = 2
    print(f"watching {report.visible(given.path)}", flush=True)
    try:
        while True:
            found = state.poll()
            status = found.status
            if found.notice:
                print(f"  ({report.visible(found.notice)})", flush=True)
            if found.rewritten:
                print(f"  (readings of {found.rewritten} runs changed: their findings are told again)", flush=True)
            if found.new is not None:
                for f in found.new.orderBy("source_id", "run_id", "sev_rank", "step_start", "detector_ord", "emit_ord").toLocalIterator():
                    print(f"[{f['severity']}] {report.visible(f['run_id'])} {f['step_start']}-{f['step_end']} {f['detector']} {f['title']}: {report.visible(f['message'])}", flush=True)
            if given.once or found.new is not None and status:
                return status
            time.sleep(given.interval)
    except KeyboardInterrupt:
        print("stopped", flush=True)
        return status
    finally:
        state.close()
        if own:
            shutil.rmtree(own, ignore_errors=True)


if __name__ == "__main__":
    sys.exit(main())
