"""Reports of runs as JSON, text and HTML, and the gate. Tables are made in Spark; a report of one run is rendered from its few findings."""

from __future__ import annotations

import html
import json
import math
import os
import tempfile
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelens.model import SEVERITIES
from curvelens.operators import project, studies, timing

SCHEMA_VERSION = 1


def safe(value: Any) -> Any:
    """NaN and infinities as strings; JSON has no such numbers."""
    if isinstance(value, float) and not math.isfinite(value):
        return "nan" if math.isnan(value) else "inf" if value > 0 else "-inf"
    if isinstance(value, dict):
        return {k: safe(v) for k, v in value.items()}
    return [safe(v) for v in value] if isinstance(value, (list, tuple)) else value


def visible(text: str) -> str:
    """Control and direction-changing characters as escapes."""
    return "".join(c if c.isprintable() and c not in "‪‫‬‭‮⁦⁧⁨⁩" or c == " " else f"\\u{ord(c):04x}" for c in text)


def json_rows(readings: DataFrame, findings: DataFrame) -> DataFrame:
    """(source_id, run_id, report): one JSON document per run, made in Spark."""
    metrics = project.summary(readings).groupBy("source_id", "run_id").agg(F.array_sort(F.collect_list(F.struct("metric", "readings", "readable", "distinct_steps", "first_step", "last_step", "unreadable_steps", "excluded"))).alias("metrics"))
    order = F.struct("sev_rank", "step_start", "detector_ord", "emit_ord", "detector", "title", "severity", "metric", "step_end", "message", "evidence")
    found = findings.withColumn("evidence", F.to_json("evidence")).groupBy("source_id", "run_id").agg(F.array_sort(F.collect_list(order)).alias("findings"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    joined = metrics.join(found, ["source_id", "run_id"], "left").fillna(0, list(SEVERITIES))
    counts = F.struct(*(F.col(s) for s in SEVERITIES)).alias("severities")
    body = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.struct("source_id", "run_id").alias("run"), F.struct(counts, "metrics").alias("summary"), F.coalesce("findings", F.array().cast(found.schema["findings"].dataType)).alias("findings"))
    return joined.select("source_id", "run_id", F.to_json(body).alias("report"))


def notes(source: dict, metrics: list[dict]) -> list[str]:
    """What a reader of a report must know about its input, in words."""
    unreadable = [m for m in metrics if m["unreadable_steps"]]
    repeated = [m for m in metrics if m["readings"] > m["distinct_steps"] and (m["metric"] != "epoch" or m["excluded"])]
    excluded = [m["metric"] for m in metrics if m["excluded"]]
    told = [
        (unreadable, f"unreadable values at {sum(m['unreadable_steps'] for m in unreadable)} steps are gaps"),
        (repeated, f"steps are logged several times in {', '.join(m['metric'] for m in repeated)}"),
        (excluded, f"conflicting values keep {', '.join(excluded)} out of trajectories"),
        (source.get("skipped_rows"), f"{source.get('skipped_rows')} records were skipped"),
        (source.get("skipped_values"), f"{source.get('skipped_values')} values were no numbers"),
        (source.get("unread_bytes"), f"{source.get('unread_bytes')} bytes at the end could not be read"),
        (source.get("overwritten"), f"{source.get('overwritten')} readings were taken back by a restart"),
        (source.get("axis") == "row_index", "there is no step column: positions are row numbers"),
        (source.get("axis") == "logging_step", "steps are logging steps, not training steps"),
        (source.get("error"), f"the log could not be read: {source.get('error')}"),
    ]
    return [text for there, text in told if there]


#: What makes a log incomplete: readings that are missing, doubtful or were taken back.
INCOMPLETE = "error is not null or skipped_rows > 0 or skipped_values > 0 or unread_bytes > 0 or overwritten > 0"


def gate(findings: DataFrame, sources: DataFrame | None = None, fail_on: str | None = None, timing: DataFrame | None = None, readings: DataFrame | None = None) -> int:
    """0 fine, 1 a finding of this severity or worse, 2 input that is incomplete or without the timing asked for.

    Input is complete if every log was read to its end, no record or value was skipped, nothing was taken back by a
    restart and, where readings are given, none is unreadable and no step has two values.
    """
    if fail_on is None and timing is None:
        return 0
    if sources is not None and sources.filter(INCOMPLETE).limit(1).count():
        return 2
    if readings is not None and project.complete(readings).filter("not complete").limit(1).count():
        return 2
    if timing is not None and timing.filter("ratio is null").limit(1).count():
        return 2
    return int(fail_on is not None and findings.filter(F.col("sev_rank") <= SEVERITIES[fail_on]).limit(1).count() > 0)


def timing_ratios(readings: DataFrame, axis: str = "step") -> DataFrame:
    """Per run the ratio of late to early seconds per step, null where they cannot be compared."""
    runs = readings.select("source_id", "run_id").distinct()
    return runs.join(timing.timings(readings, axis), ["source_id", "run_id"], "left").select("source_id", "run_id", "ratio")


def terminal(document: dict, colour: bool = False) -> str:
    """A run's report as text."""
    codes = {"error": "31", "warning": "33", "info": "36"}
    paint = lambda s, text: f"\033[{codes[s]}m{text}\033[0m" if colour else text
    counts = document["summary"]["severities"]
    lines = [f"{visible(document['run']['source_id'])}  run {visible(document['run']['run_id'])}", "  ".join(f"{n} {s}" for s, n in counts.items())]
    for m in document["summary"]["metrics"]:
        lines.append(f"  {visible(m['metric'])}: {m['readings']} readings, steps {m['first_step']}-{m['last_step']}" + (", left out: conflicting values" if m["excluded"] else "") + (f", {m['unreadable_steps']} unreadable" if m["unreadable_steps"] else ""))
    for f in document["findings"]:
        lines += [paint(f["severity"], f"[{f['severity']}] {f['title']} ({f['detector']}, steps {f['step_start']}-{f['step_end']})"), f"    {visible(f['message'])}"]
    return "\n".join(lines if document["findings"] else [*lines, "no findings"]) + "\n"


def _line(points: list[dict], low: float, high: float, width: int, height: int) -> str:
    span = high - low or 1.0
    last = max((p["col"] for p in points), default=1) or 1
    at = [(p["col"] / last * width, height - (min(v, high) - low) / span * height) for p in points for v in (p["low"], p["high"])]
    return " ".join(f"{x:.1f},{y:.1f}" for x, y in at)


def chart(points: list[dict], low: float, high: float, title: str, width: int = 920, height: int = 220) -> str:
    """A thinned curve as SVG."""
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" role="img"><title>{html.escape(title)}</title><polyline fill="none" stroke="#2a6f97" stroke-width="1.5" points="{_line(points, low, high, width, height)}"/></svg>'


def charts(observed: DataFrame, source_id: str, run_id: str) -> dict[str, str]:
    """SVG by metric of one run; the curves are thinned in Spark to a chart's columns."""
    own = observed.filter((F.col("source_id") == source_id) & (F.col("run_id") == run_id))
    domains = {r["metric"]: (r["low"], r["high"]) for r in studies.y_domain(own).collect()}
    points: dict[str, list[dict]] = {}
    for r in studies.thinned(own).orderBy("metric", "col").collect():
        points.setdefault(r["metric"], []).append(r.asDict())
    return {m: chart(p, *domains[m], m) for m, p in points.items() if m in domains}


def page(document: dict, drawn: dict[str, str] | None = None, title: str | None = None) -> str:
    """A run's report as one HTML file without outside references."""
    e = lambda x: html.escape(visible(str(x)))
    rows = "".join(f"<tr class={f['severity']}><td>{e(f['severity'])}<td>{e(f['title'])}<td>{e(f['metric'])}<td>{f['step_start']}-{f['step_end']}<td>{e(f['message'])}<td><code>{e(f.get('evidence') or '')}</code>" for f in document["findings"])
    metrics = "".join(f"<tr><td>{e(m['metric'])}<td>{m['readings']}<td>{m['first_step']}-{m['last_step']}<td>{m['unreadable_steps']}<td>{'left out' if m['excluded'] else ''}" for m in document["summary"]["metrics"])
    figures = "".join(f"<figure><figcaption>{e(m)}</figcaption>{svg}</figure>" for m, svg in (drawn or {}).items())
    return f"<!doctype html><meta charset=utf-8><meta http-equiv=Content-Security-Policy content=\"default-src 'none'; style-src 'unsafe-inline'\"><title>{e(title or document['run']['run_id'])}</title><style>body{{font:14px sans-serif;max-width:960px;margin:2em auto}}td,th{{padding:2px 8px;text-align:left;vertical-align:top}}.error{{color:#9b2226}}.warning{{color:#b35c00}}</style><h1>{e(title or document['run']['run_id'])}</h1>{figures}<table><tr><th>severity<th>finding<th>metric<th>steps<th>message<th>evidence{rows}</table><table><tr><th>metric<th>readings<th>steps<th>unreadable<th>{metrics}</table>"


def write(path: str, text: str, inputs: tuple[str, ...] = ()) -> None:
    """The whole file or none of it; never over an input."""
    if any(os.path.exists(path) and os.path.exists(i) and os.path.samefile(path, i) for i in inputs):
        raise ValueError(f"{path} is an input")
    handle, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


def documents(readings: DataFrame, findings: DataFrame) -> list[dict]:
    """The reports of a few runs on the driver, for rendering."""
    return [json.loads(r["report"]) for r in json_rows(readings, findings).orderBy("source_id", "run_id").collect()]
