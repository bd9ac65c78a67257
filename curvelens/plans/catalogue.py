"""Queries of the driver contract, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvelens.functions import names, parse, windows
from curvelens.model import DETECTORS
from curvelens.operators import curves as kernels
from curvelens.operators import detectors, joins, project, studies, timing
from curvelens.plans.series import CURVES, EVENTS, GAPPED, ORDERS, curves, event_readings, order_readings, table
from curvelens.sources import load
from curvelens.streaming.watch import follow, watch

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(column, name: str):
    return F.round(column, 6).alias(name)


# --- scans and parsing ---


@query(f"with {CURVES} select run_id, step, round(value, 6) as value from t")
def scan_readings(spark, d):
    return curves(spark, d).select("run_id", "step", _r(F.col("value"), "value"))


@query("select l_suppkey as run_id, l_orderkey as step, l_linenumber as line, metric, value from (select l_suppkey, l_orderkey, l_linenumber, l_quantity, l_discount, l_tax from lineitem) unpivot (value for metric in (l_quantity, l_discount, l_tax))")
def unpivot_metrics(spark, d):
    wide = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("run_id"), F.col("l_orderkey").alias("step"), F.col("l_linenumber").alias("line"), "l_quantity", "l_discount", "l_tax")
    return wide.unpivot(["run_id", "step", "line"], ["l_quantity", "l_discount", "l_tax"], "metric", "value")


@query("select event_id as seq, key as metric, cast(json_extract_string(props, '$.' || key) as double) as value from (select event_id, props, unnest(json_keys(props)) as key from events)")
def json_readings(spark, d):
    fields = F.from_json("props", "map<string,string>")
    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.explode(fields).alias("metric", "text"))
    return rows.select("seq", "metric", parse.float_value(F.col("text")).alias("value"))


_STEPS = [("100", 100), ("100.0", 100), ("1e2", 100), ("1.5", None), (" 7 ", 7), ("-3", -3), ("nan", None), ("9007199254740991", 9007199254740991), ("9007199254740992", None), ("1.0000000000000000001", None), ("", None), ("true", None), ("1250e-1", 125), ("1250e-2", None), ("1200e-2", 12), ("٣", None), ("0.0", 0)]
_FLOATS = [("1.5", 1.5), ("1d", None), ("1.5f", None), ("1_000", 1000.0), (" 2e3 ", 2000.0), (".5", 0.5), ("5.", 5.0), ("abc", None), ("", None), ("+4", 4.0), ("1__0", None), ("0x10", None)]


def _values(rows: list[tuple], *columns: str) -> str:
    lit = lambda x: "null" if x is None else repr(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"(values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({', '.join(columns)})"


@query(f"select text, cast(step as bigint) as step from {_values(_STEPS, 'text', 'step')}")
def step_parse(spark, d):
    return spark.createDataFrame([(t,) for t, _ in _STEPS], "text string").select("text", parse.step_value(F.col("text")).alias("step"))


@query(f"select text, cast(number as double) as number from {_values(_FLOATS, 'text', 'number')}")
def float_parse(spark, d):
    return spark.createDataFrame([(t,) for t, _ in _FLOATS], "text string").select("text", parse.float_value(F.col("text")).alias("number"))


_STATES = [("1.5", "value"), ("nan", "value"), ("-Infinity", "value"), ("", "absent"), (" None ", "absent"), ("null", "absent"), ("n/a", "unreadable"), ("1d", "unreadable"), (None, "absent")]


@query(f"select text, state from {_values(_STATES, 'text', 'state')}")
def value_three_state(spark, d):
    return spark.createDataFrame([(t,) for t, _ in _STATES], "text string").select("text", parse.value_state(F.col("text")).alias("state"))


_NAMES = [("a", "loss", "train/loss"), ("a", "eval_loss", "eval/loss"), ("a", "learning_rate", "lr"), ("a", "val/box_loss", "val/box_loss"), ("a", "loss_scale", "loss_scale"), ("a", "test/loss", "test/loss"), ("a", "grad_norm", "grad_norm"), ("a", "eval_accuracy", "eval/accuracy"), ("b", "train_loss_step", "train/loss"), ("b", "train/loss_epoch", "train/loss_epoch"), ("b", "valid_loss", "eval/loss"), ("b", "lr-AdamW/pg1", "lr"), ("b", "tokens per second", "throughput"), ("b", "lr_scheduler_steps", "lr_scheduler_steps"), ("c", "train/loss", "train/loss"), ("c", "loss", "loss")]


@query(f"select source_id, raw, metric from {_values(_NAMES, 'source_id', 'raw', 'metric')}")
def canonical_names(spark, d):
    rows = spark.createDataFrame([(s, r, k) for k, (s, r, _) in enumerate(_NAMES)], "source_id string, raw string, ord int")
    return names.key_map(rows).select("source_id", "raw", "metric")


# --- projection ---


@query(f"with {ORDERS} select run_id, metric, step, n, dv > 1 as conflicting_values from os where n > 1")
def repeated_steps(spark, d):
    return project.repeated_steps(order_readings(spark, d)).select("run_id", "metric", "step", "n", "conflicting_values")


@query(f"with {ORDERS} select run_id, metric, step, case when readable = n then fv end as value from (select *, max(dv) over (partition by run_id, metric) as worst from os) where worst <= 1")
def analysis_projection(spark, d):
    return project.observations(order_readings(spark, d)).select("run_id", "metric", "step", "value")


@query(f"with {ORDERS} select run_id, metric, count(*) filter (dv > 1) as conflicting_steps from os group by 1, 2 having count(*) filter (dv > 1) > 0")
def conflict_excluded(spark, d):
    return project.conflicting(order_readings(spark, d)).select("run_id", "metric", "conflicting_steps")


@query(f"with {ORDERS} select run_id, metric, cast(sum(n) as bigint) as readings, cast(sum(readable) as bigint) as readable, count(*) as distinct_steps, min(step) as first_step, max(step) as last_step, count(*) filter (readable < n) as unreadable_steps, max(dv) > 1 as excluded from os group by 1, 2")
def metric_summary(spark, d):
    return project.summary(order_readings(spark, d)).drop("source_id")


def _by_nation(spark, d):
    nation = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("run_id"), F.col("s_nationkey").cast("string").alias("nation"))
    return order_readings(spark, d).join(F.broadcast(nation) if nation.count() < 200_000 else nation, "run_id").withColumn("source_id", F.col("nation"))


@query(f"with {ORDERS}, c as (select cast(s_nationkey as varchar) as source_id, run_id, count(*) as points, min(seq) as ord from o join supplier on run_id = cast(s_suppkey as varchar) group by 1, 2) select source_id, run_id, points from (select *, row_number() over (partition by source_id order by points desc, ord, run_id) as r from c) where r = 1")
def default_run_selection(spark, d):
    return project.default_run(_by_nation(spark, d))


@query(f"with {ORDERS}, c as (select distinct cast(s_nationkey as varchar) as source_id, run_id from o join supplier on run_id = cast(s_suppkey as varchar) where starts_with(run_id, '3')) select source_id, case when bool_or(run_id = '3') then '3' else min(run_id) end as run_id from c group by 1 having bool_or(run_id = '3') or count(*) = 1")
def run_prefix_match(spark, d):
    return project.select_run(_by_nation(spark, d), "3")


@query(f"with {ORDERS} select 'orders' as source_id, cast(sum(n - readable) as bigint) as unreadable, count(*) filter (dv > 1) as conflicts, count(*) filter (n > 1) as repeats, sum(n - readable) = 0 and count(*) filter (dv > 1) = 0 as complete from os")
def input_complete_flags(spark, d):
    return project.complete(order_readings(spark, d))


_FINITE = "value is not null and not isnan(value) and abs(value) < 'inf'::double"
_SEGMENTS = f"""{GAPPED},
m as (select *, sum(case when {_FINITE} then 0 else 1 end) over (partition by run_id order by step) as gap from g),
s as (select run_id, step, value, pos, dense_rank() over (partition by run_id order by gap) - 1 as seg, row_number() over (partition by run_id, gap order by step) - 1 as seg_pos, count(*) over (partition by run_id, gap) as seg_n from m where {_FINITE})"""


@query(f"with {_SEGMENTS} select run_id, step, cast(pos as bigint) as pos, cast(seg as bigint) as seg, cast(seg_pos as bigint) as seg_pos, seg_n from s")
def finite_segments(spark, d):
    out = project.segments(project.observations(curves(spark, d, gaps=True)))
    return out.select("run_id", "step", *(F.col(c).cast("long").alias(c) for c in ("pos", "seg", "seg_pos", "seg_n")))


@query(f"with {GAPPED} select run_id, min(step) as first_bad_step, max(step) as last_bad_step, count(*) as n_bad, count(distinct step) as bad_steps from g where isnan(value) group by 1")
def observed_nonfinite(spark, d):
    return project.nonfinite(curves(spark, d, gaps=True)).drop("source_id", "metric")


# --- windows ---


def _windowed(spark, d, column):
    w = windows.by_step()
    return curves(spark, d).select("run_id", "step", _r(column(w), "x"))


for _n in (5, 21):
    _w = f"(partition by run_id order by step rows between {_n - 1} preceding and current row)"
    _QUERIES[f"trailing_median_{_n}"] = lambda spark, d, n=_n: _windowed(spark, d, lambda w: windows.trailing_median(F.col("value"), n, w))
    _SQL[f"trailing_median_{_n}"] = f"with {CURVES} select run_id, step, round(median(value) over {_w}, 6) as x from t"

_W21 = "(partition by run_id order by step rows between 20 preceding and current row)"
_MAD = f"h as (select run_id, step, value, median(value) over {_W21} as m, list(value) over {_W21} as held from t), md as (select run_id, step, value, m, list_median(list_transform(held, lambda x: abs(x - m))) as mad from h)".replace("list_median", "list_aggregate").replace("abs(x - m)))", "abs(x - m)), 'median')")


@query(f"with {CURVES}, {_MAD} select run_id, step, round(mad, 6) as x from md")
def rolling_mad_21(spark, d):
    return _windowed(spark, d, lambda w: windows.rolling_mad(F.col("value"), 21, w))


@query(f"with {CURVES}, {_MAD} select run_id, step, round(0.6745::double * (value - m) / greatest(mad, 1e-12) + 3e-7, 4) + 0.0 as x from md")
def robust_z_21(spark, d):
    w = windows.by_step()
    out = curves(spark, d).select("run_id", "step", windows.robust_z(F.col("value"), 21, w).alias("x"))
    return out.select("run_id", "step", (F.round(F.col("x") + 3e-7, 4) + 0.0).alias("x"))


_HALF = "cast(least(greatest(5, n // 25), 201) // 2 as bigint)"


@query(f"with {CURVES} select run_id, step, round(median(value) over (partition by run_id order by step rows between {_HALF} preceding and {_HALF} following), 6) as x from t")
def centered_median_var(spark, d):
    run = curves(spark, d).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("points"))
    width = F.least(F.greatest(F.lit(5), F.floor(F.size("points") / 25)), F.lit(201))
    smooth = windows.centred_median_of(F.col("points.value"), width)
    return run.select("run_id", F.explode(F.arrays_zip(F.col("points.step").alias("step"), smooth.alias("x"))).alias("z")).select("run_id", "z.step", _r(F.col("z.x"), "x"))


@query(f"with {CURVES} select run_id, step, round(lo, 6) as lo, round(hi, 6) as hi from (select run_id, step, min(value) over w as lo, max(value) over w as hi, count(*) over w as k from t window w as (partition by run_id order by step rows between current row and 29 following)) where k = 30")
def window_extrema_30(spark, d):
    lo, hi, k = windows.forward_extrema(F.col("value"), 30, windows.by_step())
    return curves(spark, d).select("run_id", "step", _r(lo, "lo"), _r(hi, "hi"), k.alias("k")).filter("k = 30").drop("k")


@query(f"with {_SEGMENTS} select run_id, step, round(max(value) over (partition by run_id, seg order by step rows between unbounded preceding and current row), 6) as peak from s")
def running_peak_reset(spark, d):
    seg = project.segments(project.observations(curves(spark, d, gaps=True)))
    return seg.select("run_id", "step", _r(F.max("value").over(Window.partitionBy("run_id", "seg").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)), "peak"))


@query(f"with {CURVES}, f as (select run_id, pos from t where value > 1.2), b as (select *, case when pos - lag(pos) over (partition by run_id order by pos) > 2 then 1 else 0 end as cut from f), c as (select *, sum(cut) over (partition by run_id order by pos) as grp from b) select run_id, cast(grp as bigint) as grp, min(pos) as first_pos, max(pos) as last_pos, count(*) as n from c group by 1, 2")
def consecutive_groups(spark, d):
    w = Window.partitionBy("run_id").orderBy("seq")
    cut = curves(spark, d).filter("value > 1.2").withColumn("cut", windows.session(F.col("seq"), 2, w))
    return cut.withColumn("grp", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("run_id", "grp").agg(F.min("seq").alias("first_pos"), F.max("seq").alias("last_pos"), F.count(F.lit(1)).alias("n"))


@query(f"with {EVENTS}, dd as (select run_id, step, value - lag(value) over (partition by run_id order by step) as x from e where metric = 'eval/loss'), nz as (select run_id, step, sign(x) as s from dd where x <> 0), fl as (select run_id, s, lag(s) over (partition by run_id order by step) as before from nz) select run_id, count(*) filter (before is not null and s <> before) as reversals from fl group by 1")
def sign_reversals(spark, d):
    w = Window.partitionBy("run_id").orderBy("step")
    moved = event_readings(spark, d).filter("metric = 'eval/loss'").withColumn("x", F.col("value") - F.lag("value").over(w)).filter("x <> 0")
    return moved.withColumn("turn", F.coalesce(F.signum("x") != F.lag(F.signum("x")).over(w), F.lit(False))).groupBy("run_id").agg(F.count_if("turn").alias("reversals"))


@query(f"with {CURVES} select run_id, round(regr_slope(value, step), 9) as slope, count(*) as n, round(sqrt(greatest(0, regr_syy(value, step) - regr_sxy(value, step) * regr_sxy(value, step) / regr_sxx(value, step)) / (count(*) - 2) / regr_sxx(value, step)), 9) as error from t group by 1")
def ols_slope(spark, d):
    rest = F.greatest(F.lit(0.0), F.regr_syy("value", "step") - F.regr_sxy("value", "step") * F.regr_sxy("value", "step") / F.regr_sxx("value", "step"))
    return curves(spark, d).groupBy("run_id").agg(F.round(F.regr_slope("value", "step"), 9).alias("slope"), F.count(F.lit(1)).alias("n"), F.round(F.sqrt(rest / (F.count(F.lit(1)) - 2) / F.regr_sxx("value", "step")), 9).alias("error"))


@query(f"with {CURVES} select run_id, step, round(regr_slope(value, step) over w, 6) + 0.0 as slope from t window w as (partition by run_id order by step rows between current row and 29 following) qualify count(*) over w = 30")
def ols_slope_window_30(spark, d):
    m = windows.moments(F.col("step"), F.col("value"), 30, windows.by_step())
    return curves(spark, d).select("run_id", "step", (F.round(m["sxy"] / m["sxx"], 6) + 0.0).alias("slope"), m["n"].alias("n")).filter("n = 30").drop("n")


_FLAT = windows.flat_constant(30, 0.2)


@query(f"with {CURVES}, mo as (select run_id, step, regr_sxx(value, step) over w as sxx, regr_syy(value, step) over w as syy, regr_sxy(value, step) over w as sxy, count(*) over w as k from t window w as (partition by run_id order by step rows between current row and 29 following)) select run_id, count(*) as windows, count(*) filter (sxy * sxy <= {_FLAT!r}::double * sxx * syy) as flat from mo where k = 30 group by 1")
def flat_windows_30(spark, d):
    m = windows.moments(F.col("step"), F.col("value"), 30, windows.by_step())
    rows = curves(spark, d).select("run_id", *(c.alias(k) for k, c in m.items())).filter("n = 30")
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("sxy") * F.col("sxy") <= _FLAT * F.col("sxx") * F.col("syy")).alias("flat"))


# --- levels and folds ---

_LEVELS = f"""{CURVES},
sm as (select *, median(value) over (partition by run_id order by step rows between {_HALF} preceding and {_HALF} following) as smooth, value - lag(value) over (partition by run_id order by step) as dv, greatest(3, n // 20) as edge, least(greatest(5, n // 25), 201) // 2 * 2 + 1 as win from t),
md as (select run_id, any_value(n) as n, any_value(win) as win, any_value(edge) as edge, median(value - smooth) as mr, median(dv) as mdv, median(ln(value / smooth)) as ml, min(smooth) as best, median(value) filter (pos < 3) as early, median(value) filter (pos < edge) as wide, median(value) filter (pos >= n - edge) as final from sm group by 1),
mad as (select run_id, median(abs(value - smooth - mr)) as a, median(abs(dv - mdv)) as b, median(abs(ln(value / smooth) - ml)) as c from sm join md using (run_id) group by 1),
lv as (select run_id, win, best, final, greatest(early, wide) as start, case when early > wide then 3 else edge end as cnt, greatest(1.4826 * a, 1.4826 * b / sqrt(2)) as scatter, 1.4826 * c as rel from md join mad using (run_id)),
lx as (select *, 1.2533 / sqrt(win) * scatter as noise, 1.2533 * greatest(scatter, rel * abs(start)) / sqrt(cnt) as start_noise from lv)"""


@query(f"with {_LEVELS} select run_id, cast(win as bigint) as win, round(start, 6) as start, round(best, 6) as best, round(final, 6) as final, round(noise, 6) as noise, round(start_noise, 6) as start_noise, start - best > greatest(6 * noise, 4 * start_noise) as has_progress, round((final - best) / (start - best), 6) as gave_back from lx")
def levels(spark, d):
    def one(run, key):
        lv = kernels.levels(run.get("train/loss").value)
        return pd.DataFrame([{"run_id": key[1], "win": lv.window, "start": lv.start, "best": lv.best, "final": lv.final, "noise": lv.noise, "start_noise": lv.start_noise, "has_progress": bool(lv.has_progress), "gave_back": lv.gave_back}] if lv else [])

    out = detectors.grouped(curves(spark, d), one, "run_id string, win long, start double, best double, final double, noise double, start_noise double, has_progress boolean, gave_back double")
    return out.select("run_id", "win", *(_r(F.col(c), c) for c in ("start", "best", "final", "noise", "start_noise")), "has_progress", _r(F.col("gave_back"), "gave_back"))


_FOLD = f"""{_LEVELS},
ln as (select run_id, start - best as progress, noise, 1.2533 / sqrt(win) * rel as rel_noise, win, scatter, rel from lx where start - best > greatest(6 * noise, 4 * start_noise)),
lo as (select sm.run_id, pos, smooth as level, ln.win as win, progress, ln.noise as noise, rel_noise, min(smooth) over (partition by sm.run_id order by pos rows between unbounded preceding and current row) as low from sm join ln using (run_id)),
mg as (select *, greatest(0.25 * progress, 4 * greatest(noise, rel_noise * abs(low))) as margin from lo),
ab as (select run_id, pos, low, margin from mg where level > low + margin),
cl as (select ab.run_id, ab.pos, any_value(ab.low) as base, min(mg.pos) as closed from ab left join mg on mg.run_id = ab.run_id and mg.pos > ab.pos and mg.level <= ab.low + 0.25 * ab.margin group by 1, 2),
nx as (select cl.run_id, cl.pos, any_value(cl.base) as base, any_value(cl.closed) as closed, min(ab.pos) as next from cl left join ab on ab.run_id = cl.run_id and ab.pos > cl.closed group by 1, 2),
ch as (select run_id, min(pos) as pos from ab group by 1 union all select ch.run_id, nx.next from ch join nx using (run_id, pos) where nx.next is not null),
ex as (select nx.run_id, ln.progress, ln.win, scatter, rel, {{'first': nx.pos, 'last': coalesce(nx.closed, e.last_pos), 'base': nx.base, 'peak': (select max(level) from mg where mg.run_id = nx.run_id and mg.pos between nx.pos and coalesce(nx.closed, e.last_pos)), 'recovered': nx.closed is not null}} as e
  from ch join nx using (run_id, pos) join ln using (run_id) join (select run_id, max(pos) as last_pos from mg group by 1) e using (run_id)),
es as (select ex.run_id, progress, win, scatter, rel, e."first" as i, e."last" as j, e.base, e.peak, e.recovered, a.step as first_step, b.step as last_step from ex join t a on a.run_id = ex.run_id and a.pos = e."first" join t b on b.run_id = ex.run_id and b.pos = e."last")"""


@query(f"with recursive {_FOLD} select run_id, first_step, last_step, round(base, 6) as base, round(peak, 6) as peak, recovered from es")
def excursions(spark, d):
    def one(run, key):
        curve = run.get("train/loss")
        lv = kernels.levels(curve.value)
        return pd.DataFrame([{"run_id": key[1], "first_step": int(curve.step[e.start]), "last_step": int(curve.step[e.end]), "base": e.base, "peak": e.peak, "recovered": e.recovered} for e in (kernels.excursions(lv) if lv else [])], columns=["run_id", "first_step", "last_step", "base", "peak", "recovered"])

    out = detectors.grouped(curves(spark, d), one, "run_id string, first_step long, last_step long, base double, peak double, recovered boolean")
    return out.select("run_id", "first_step", "last_step", _r(F.col("base"), "base"), _r(F.col("peak"), "peak"), "recovered")


@query(f"""with recursive {_FOLD}, sp as (select run_id, max(step) - min(step) as span, count(*) as n from t group by 1)
select run_id, case when i < n / 10.0 then 'Early rise' else 'Setback' end as title, case when (last_step - first_step)::double / span >= 0.05 then 'warning' else 'info' end as severity, first_step as step_start, last_step as step_end,
  round((peak - base) / progress, 6) as share_of_progress, last_step - first_step as steps_lost
from es join sp using (run_id) where recovered and j - i + 1 >= win and (last_step - first_step)::double / span >= 0.01""")
def curve_setbacks(spark, d):
    found = detectors.run_all(curves(spark, d), {"setbacks": detectors.setbacks}).filter("title in ('Setback', 'Early rise')")
    told = F.col("evidence")
    return found.select("run_id", "title", "severity", "step_start", "step_end", _r(told["share_of_progress"].cast("double"), "share_of_progress"), told["steps_lost"].cast("long").alias("steps_lost"))


_LOGS = f"hl as (select run_id, pos, median(ln(value)) over {_W21} as m, list(ln(value)) over {_W21} as held from t), ml as (select run_id, pos, list_aggregate(list_transform(held, lambda x: abs(x - m)), 'median') as mad from hl)"


@query(f"""with {_LEVELS}, {_LOGS}, lb as (select run_id, pos, median(value) over (partition by run_id order by step rows between 5 preceding and 1 preceding) as before from t),
z as (select sm.run_id, sm.step, sm.pos, ln(value / smooth) / greatest(1.4826 * ml.mad, greatest(rel, 1e-3)) as z, (value - greatest(smooth, before)) / (start - best) as share from sm join ml using (run_id, pos) join lb using (run_id, pos) join lx using (run_id) where start - best > greatest(6 * noise, 4 * start_noise))
select run_id, step, case when share >= 0.5 then 'large' else 'modest' end as kind, round(share, 6) as share from z where pos >= 3 and z > 3 and share >= 0.1""")
def curve_spike_points(spark, d):
    """Points of the spike rule, at a lower threshold than the detector's, in windows and one map of levels."""

    def one(run, key):
        curve = run.get("train/loss")
        lv = kernels.levels(curve.value)
        rows = []
        if lv is not None and lv.has_progress:
            z = np.log(curve.value / lv.smooth) / np.maximum(1.4826 * kernels.trailing_mad(np.log(curve.value), 21)[1], max(lv.relative_scatter, 1e-3))
            before = np.full(len(curve), np.inf)
            before[3:] = kernels.trailing_median(curve.value[:-1], 5)[2:]
            share = (curve.value - np.maximum(lv.smooth, before)) / lv.progress
            rows = [{"run_id": key[1], "step": int(curve.step[i]), "kind": "large" if share[i] >= 0.5 else "modest", "share": float(share[i])} for i in np.flatnonzero((z > 3) & (share >= 0.1) & (np.arange(len(z)) >= 3))]
        return pd.DataFrame(rows, columns=["run_id", "step", "kind", "share"])

    out = detectors.grouped(curves(spark, d), one, "run_id string, step long, kind string, share double")
    return out.select("run_id", "step", "kind", _r(F.col("share"), "share"))


_REBOUND = """{'i': step, 'v': value, 'peak': step, 'pv': value, 'low': -1::bigint, 'lv': 0::double, 'pend': false, 'pp': 0::bigint, 'pl': 0::bigint, 'pc': 0::bigint, 'found': []::struct(peak bigint, low bigint, confirmed bigint, high bigint)[]}"""


@query(f"""with {EVENTS}, r as (select run_id, list({_REBOUND} order by step) as p from e where metric = 'lr' group by 1),
f as (select run_id, list_reduce(p, lambda a, x:
  case when a.low < 0 and x.v >= a.pv then struct_update(a, i := x.i, v := x.v, peak := x.i, pv := x.v)
  when a.low < 0 and a.pv - x.v > 0.01 * a.pv then struct_update(a, i := x.i, v := x.v, low := x.i, lv := x.v, pend := false, found := case when a.pend then list_append(a.found, {{'peak': a.pp, 'low': a.pl, 'confirmed': a.pc, 'high': a.peak}}) else a.found end)
  when a.low < 0 then a
  when x.v <= a.lv then struct_update(a, i := x.i, v := x.v, low := x.i, lv := x.v)
  when x.v - a.lv > 0.01 * greatest(a.pv, x.v) then struct_update(a, i := x.i, v := x.v, peak := x.i, pv := x.v, low := -1::bigint, lv := 0::double, pend := true, pp := a.peak, pl := a.low, pc := x.i)
  else a end) as s from r),
o as (select run_id, unnest(case when s.pend then list_append(s.found, {{'peak': s.pp, 'low': s.pl, 'confirmed': s.pc, 'high': s.peak}}) else s.found end) as q from f)
select run_id, q.peak as peak_step, q.low as low_step, q.confirmed as confirmed_step, q.high as high_step from o""")
def lr_rebounds(spark, d):
    def one(run, key):
        curve = run.get("lr")
        rows = detectors.rebounds(curve.value, 0.01) if curve is not None else []
        return pd.DataFrame([{"run_id": key[1], "peak_step": int(curve.step[p]), "low_step": int(curve.step[a]), "confirmed_step": int(curve.step[c]), "high_step": int(curve.step[h])} for p, a, c, h in rows], columns=["run_id", "peak_step", "low_step", "confirmed_step", "high_step"])

    return detectors.grouped(event_readings(spark, d), one, "run_id string, peak_step long, low_step long, confirmed_step long, high_step long")


@query(f"with {EVENTS}, ev as (select run_id, seq, step, metric, case when metric = 'grad_norm' then step // 2 end as restart from e), low as (select *, min(restart) over (partition by run_id order by seq rows between 1 following and unbounded following) as lo from ev) select run_id, seq, step, metric from low where restart is null and (lo is null or lo > step)")
def restart_purge_v2(spark, d):
    rows = event_readings(spark, d).select("run_id", "seq", "step", "metric", F.when(F.col("metric") == "grad_norm", F.floor(F.col("step") / 2)).alias("restart"))
    return studies.purge_restarts(rows, ["run_id"]).drop("restart")


# --- joins ---


@query(f"with {EVENTS} select l.run_id, l.step, l.value, r.value as lr, r.step as lr_step from (select * from e where metric = 'train/loss') l asof left join (select * from e where metric = 'lr') r on l.run_id = r.run_id and l.step >= r.step")
def asof_lr(spark, d):
    rows = event_readings(spark, d)
    side = lambda m: rows.filter(F.col("metric") == m).select("run_id", "step", "value")
    return joins.asof(side("train/loss"), side("lr"), ["run_id"], into="lr")


_FINDS = f"{EVENTS}, fi as (select run_id, metric, min(step) as step_start, max(step) as step_end from e where metric in ('eval/loss', 'lr') group by 1, 2), cu as (select run_id, step as step_start, step as step_end, row_number() over (partition by run_id order by step) as ord from e where metric = 'grad_norm')"


@query(f"with {_FINDS} select fi.run_id, fi.metric, fi.step_start, fi.step_end, min(cu.ord) as culprit from fi left join cu on fi.run_id = cu.run_id and fi.step_start <= cu.step_end and cu.step_start <= fi.step_end + greatest(1, fi.step_end - fi.step_start) group by all")
def overlap_attribution(spark, d):
    rows = event_readings(spark, d)
    found = rows.filter("metric in ('eval/loss', 'lr')").groupBy("run_id", "metric").agg(F.min("step").alias("step_start"), F.max("step").alias("step_end"))
    culprits = rows.filter("metric = 'grad_norm'").select("run_id", F.col("step").alias("step_start"), F.col("step").alias("step_end"), F.row_number().over(Window.partitionBy("run_id").orderBy("step")).cast("long").alias("ord"))
    return joins.first_overlap(found, culprits, ["run_id"])


@query(f"with {EVENTS}, a as (select * from e where metric = 'train/loss'), b as (select * from e where metric = 'eval/loss'), sa as (select run_id, min(step) as f, max(step) as l from a group by 1), sb as (select run_id, min(step) as f, max(step) as l from b group by 1), i as (select run_id, greatest(sa.f, sb.f) as lo, least(sa.l, sb.l) as hi from sa join sb using (run_id) where greatest(sa.f, sb.f) <= least(sa.l, sb.l)) select run_id, lo, hi, (select count(*) from a where a.run_id = i.run_id and step between lo and hi) as a_n, (select count(*) from b where b.run_id = i.run_id and step between lo and hi) as b_n from i")
def shared_interval(spark, d):
    rows = event_readings(spark, d)
    return joins.shared_interval(rows.filter("metric = 'train/loss'"), rows.filter("metric = 'eval/loss'"), ["run_id"])


@query(f"with {EVENTS}, j as (select run_id, step as step_start, step + 2 as step_end, value as before, value + (step % 3) - 1 as after from e where metric = 'lr'), r as (select run_id, step as step_start, step + 4 as rebound_end from e where metric = 'grad_norm') select j.* from j asof left join r on j.run_id = r.run_id and j.step_start >= r.step_start where not (after > before and rebound_end is not null and step_end <= rebound_end)")
def jump_suppression(spark, d):
    rows = event_readings(spark, d)
    jumps = rows.filter("metric = 'lr'").select("run_id", F.col("step").alias("step_start"), (F.col("step") + 2).alias("step_end"), F.col("value").alias("before"), (F.col("value") + F.col("step") % 3 - 1).alias("after"))
    rises = rows.filter("metric = 'grad_norm'").select("run_id", F.col("step").alias("step_start"), (F.col("step") + 4).alias("step_end"))
    return joins.not_inside(jumps, rises, ["run_id"])


# --- detectors ---


def _all(spark, d) -> DataFrame:
    return curves(spark, d, gaps=True).unionByName(event_readings(spark, d))


def _shown(found: DataFrame) -> DataFrame:
    return found.select("source_id", "run_id", "detector", "title", "severity", "metric", "step_start", "step_end", F.to_json("evidence").alias("evidence"))


for _name in DETECTORS:
    _QUERIES[_name] = lambda spark, d, name=_name: _shown(detectors.run_all(_all(spark, d), {name: detectors.ALL[name]}))

_SQL["eval_noise"] = f"""with {EVENTS}, v as (select run_id, step, value from e where metric = 'eval/loss'), m as (select run_id, max(abs(value)) as scale, count(*) as n, min(step) as a, max(step) as b from v group by 1),
x as (select v.run_id, step, value / scale as s, value / scale - lag(value / scale) over (partition by v.run_id order by step) as dd from v join m using (run_id) where scale > 0),
nz as (select run_id, sign(dd) as g, lag(sign(dd)) over (partition by run_id order by step) as h from x where dd <> 0),
tu as (select run_id, count(*) filter (h is not null and g <> h) as turns from nz group by 1),
q as (select run_id, median(abs(dd)) as change, max(s) - min(s) as width, count(*) filter (dd > 0) as up, count(*) filter (dd < 0) as down from x group by 1)
select 'events' as source_id, run_id, 'eval_noise' as detector, 'Evaluation values fluctuate' as title, 'info' as severity, 'eval/loss' as metric, a as step_start, b as step_end, n as observations, turns as direction_changes, up as upward_intervals, down as downward_intervals, round(change / width, 6) as ratio
from m join tu using (run_id) join q using (run_id) where n >= 6 and turns >= 2 and change / width >= 0.15"""


def _eval_noise(spark, d):
    found = detectors.run_all(event_readings(spark, d), {"eval_noise": detectors.eval_noise})
    told = lambda k, t="long": F.col("evidence")[k].cast(t).alias(k)
    return found.select("source_id", "run_id", "detector", "title", "severity", "metric", "step_start", "step_end", *(told(k) for k in ("observations", "direction_changes", "upward_intervals", "downward_intervals")), _r(F.col("evidence")["ratio"].cast("double"), "ratio"))


_QUERIES["eval_noise"] = _eval_noise

_GW = "(partition by run_id order by step rows between 20 preceding and current row)"
_SQL["grad_norm"] = f"""with {EVENTS}, v as (select run_id, step, value, row_number() over (partition by run_id order by step) - 1 as pos, count(*) over (partition by run_id) as n from e where metric = 'grad_norm'),
h as (select *, median(value) over {_GW} as m, list(value) over {_GW} as held from v),
z as (select run_id, step, pos, value, case when m > 0 then value / m else 0 end as ratio, 0.6745 * (value - m) / greatest(list_aggregate(list_transform(held, lambda x: abs(x - m)), 'median'), 1e-12) as z from h where n >= 5),
f as (select *, case when pos - lag(pos) over (partition by run_id order by pos) <= 2 then 0 else 1 end as cut from z where z > 10 and ratio >= 10)
select 'events' as source_id, run_id, 'Gradient-norm explosion' as title, min(step) as step_start, max(step) as step_end, cast(sum(cut) as bigint) as groups, first(step order by ratio desc, step) as peak_step, round(max(ratio), 6) as ratio from f group by 2"""


def _grad_norm(spark, d):
    found = detectors.run_all(event_readings(spark, d).filter("metric = 'grad_norm'"), {"grad_norm": detectors.grad_norm}).filter("title = 'Gradient-norm explosion'")
    told = F.col("evidence")
    return found.select("source_id", "run_id", "title", "step_start", "step_end", told["count"].cast("long").alias("groups"), told["peak_step"].cast("long").alias("peak_step"), _r(told["ratio_to_median"].cast("double"), "ratio"))


_QUERIES["grad_norm"] = _grad_norm


@query(f"""with {EVENTS}, w as (select run_id, step, wall_time, step - lag(step) over o as ds, wall_time - lag(wall_time) over o as dt from e where metric = 'train/loss' window o as (partition by run_id order by step)),
i as (select run_id, step, case when dt > 0 and ds > 0 then dt / ds end as s, row_number() over (partition by run_id order by step) - 1 as k, count(*) over (partition by run_id) as n from w where ds is not null),
z as (select *, least(greatest(5, cast(floor(n * 0.2) as bigint)), n // 2) as win from i where n >= 10),
q as (select run_id, any_value(n) as observations, any_value(win) as win, median(s) filter (k < win) as early, median(s) filter (k >= n - win) as late, bool_and(s is not null) filter (k < win or k >= n - win) as good, count(*) filter (s is null) as invalid from z group by 1)
select run_id, observations, invalid, win, round(case when good then early end, 6) as early, round(case when good then late end, 6) as late, round(case when good then late / early end, 6) as ratio from q""")
def timing_evidence(spark, d):
    out = timing.timings(event_readings(spark, d).filter("metric = 'train/loss'"))
    return out.select("run_id", "observations", "invalid", "win", *(F.round(c, 6).alias(c) for c in ("early", "late", "ratio")))


_SQL["throughput"] = _SQL["timing_evidence"].replace("select run_id, observations, invalid, win, round(case when good then early end, 6) as early, round(case when good then late end, 6) as late, round(case when good then late / early end, 6) as ratio from q", "select run_id, 'Throughput regression' as title, win, round(late / early, 6) as ratio from q where good and late / early >= 1.4")


def _throughput(spark, d):
    found = timing.timings(event_readings(spark, d).filter("metric = 'train/loss'")).filter("ratio >= 1.4")
    return found.select("run_id", F.lit("Throughput regression").alias("title"), "win", _r(F.col("ratio"), "ratio"))


_QUERIES["throughput"] = _throughput
_SQL["loss_floor"] = f"""with {EVENTS}, v as (select run_id, step, value, first(value order by step) over w as f0, min(step) over w as s0, max(step) over w as s1, count(*) over w as n from e where metric = 'train/loss' window w as (partition by run_id)),
h as (select *, bool_and(value >= 0) over (partition by run_id) as good from v where step - s0 <= (s1 - s0) * 0.5), l as (select run_id, min(step) as step from h where n >= 5 and s1 > s0 and f0 > 0 and good and value <= 40 and value <= f0 * 0.5 group by 1)
select run_id, l.step, round(value, 6) as value from l join v using (run_id, step)"""


def _loss_floor(spark, d):
    """The rule at wider thresholds, since no loss of these tables starts near zero."""
    found = detectors.run_all(event_readings(spark, d).filter("metric = 'train/loss'"), {"loss_floor": _wide_floor})
    return found.select("run_id", F.col("evidence")["step"].cast("long").alias("step"), _r(F.col("evidence")["value"].cast("double"), "value"))


def _wide_floor(run):
    return detectors.loss_floor(run, early=0.5, floor=40, part=0.5)


_QUERIES["loss_floor"] = _loss_floor


@query()
def run_all_ordered(spark, d):
    found = detectors.run_all(_all(spark, d))
    order = Window.partitionBy("source_id", "run_id").orderBy("sev_rank", "step_start", "detector_ord", "emit_ord")
    return found.withColumn("place", F.row_number().over(order)).select("source_id", "run_id", "place", "detector", "title", "severity", "metric", "step_start", "step_end")


@query()
def severity_counts(spark, d):
    found = detectors.run_all(_all(spark, d))
    return found.groupBy("source_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run_id").alias("runs"))


# --- studies and charts ---

_FV = ", ".join(f"('{f}', {a}::double, {b}::double, {'null' if u is None else u}::double)" for f, a, b, u in studies.FAULTS)


@query(f"with {CURVES}, f(fault, a, b, up) as (values {_FV}), c as (select *, least(cast(floor(a * n) as bigint), n - 1) as lo, least(cast(floor(b * n) as bigint), n - 1) as hi from t, f) select run_id, fault, count(*) as points, count(*) filter (isnan(x)) as bad, round(sum(case when isnan(x) then 0 else x end), 3) as total from (select *, case when pos between lo and hi then case when up is null then 'nan'::double else value + up end else value end as x from c) group by 1, 2")
def fault_variants(spark, d):
    rows = studies.fault_variants(curves(spark, d))
    return rows.groupBy("run_id", "fault").agg(F.count(F.lit(1)).alias("points"), F.count_if(F.isnan("value")).alias("bad"), F.round(F.sum(F.nanvl("value", F.lit(0.0))), 3).alias("total"))


@query(f"""with recursive {_FOLD}, ta as (select run_id, max((peak - base) / progress) as tallest from es group by 1),
l as (select *, start - best > greatest(6 * noise, 4 * start_noise) as moved, (final - best) / (start - best) as back from lx)
select run_id, case when not moved then case when start > 0 and final >= 1.5 * start then 'bad' else 'no progress' end when back < 0.1 then 'good' when back >= 0.5 then 'bad' else 'middling' end as ending, round(case when moved then back end, 6) as gave_back, round(coalesce(tallest, 0), 6) as tallest from l left join ta using (run_id)""")
def run_endings(spark, d):
    return studies.endings(curves(spark, d)).select("run_id", "ending", F.round(F.nanvl("gave_back", F.lit(None).cast("double")), 6).alias("gave_back"), _r(F.col("tallest"), "tallest"))


@query(f"with {GAPPED} select run_id, 'Non-finite training loss' as title, 'error' as severity, min(step) as step_start, max(step) as step_end, count(*) as n from g where isnan(value) group by 1")
def nonfinite_findings(spark, d):
    found = detectors.run_all(curves(spark, d, gaps=True), {"divergence": detectors.divergence}).filter("title = 'Non-finite training loss'")
    return found.select("run_id", "title", "severity", "step_start", "step_end", F.col("evidence")["count"].cast("long").alias("n"))


@query(f"""with recursive {_FOLD}, sp as (select run_id, max(step) - min(step) as span from t group by 1),
  sb as (select run_id, count(*) as findings from es join sp using (run_id) where recovered and j - i + 1 >= win and (last_step - first_step)::double / span >= 0.01 group by 1),
  l as (select *, start - best > greatest(6 * noise, 4 * start_noise) as moved, (final - best) / (start - best) as back from lx),
  en as (select run_id, case when not moved then case when start > 0 and final >= 1.5 * start then 'bad' else 'no progress' end when back < 0.1 then 'good' when back >= 0.5 then 'bad' else 'middling' end as ending from l),
  f(fault, a, b, up) as (values {_FV})
  select ending, fault, count(*) as runs, count(findings) as with_findings, count(*) filter (up is null) as caught from en left join sb using (run_id) cross join f group by 1, 2""")
def endings_findings_faults(spark, d):
    """How runs end, whether they have setbacks, and whether a fault planted in them is found as no number."""
    rows = curves(spark, d)
    found = detectors.run_all(rows, {"setbacks": detectors.setbacks}).filter("title in ('Setback', 'Early rise')")
    variants = studies.fault_variants(rows)
    marked = variants.withColumn("run_id", F.concat_ws("|", "run_id", "fault")).withColumn("seq", F.col("step")).withColumn("wall_time", F.lit(None).cast("double"))
    caught = detectors.run_all(marked, {"divergence": detectors.divergence}).filter("title = 'Non-finite training loss'").select("source_id", F.split("run_id", "[|]")[0].alias("run_id"), F.split("run_id", "[|]")[1].alias("fault"), F.lit(True).alias("hit"))
    planted = variants.select("source_id", "run_id", "fault").distinct().join(caught, ["source_id", "run_id", "fault"], "left").select("source_id", "run_id", "fault", F.coalesce("hit", F.lit(False)).alias("caught"))
    return studies.census(studies.endings(rows), found, planted)


@query(f"""with {EVENTS}, c as (select metric, count(*) filter (value > 60)::double as k, count(*)::double as n from e group by 1), w as (select *, k / n as p, 1.96::double * 1.96::double as zz from c)
select metric, cast(k as bigint) as part, cast(n as bigint) as whole, round(100 * greatest(0, (p + zz / (2 * n)) / (1 + zz / n) - 1.96::double * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)), 4) as low, round(100 * least(1, (p + zz / (2 * n)) / (1 + zz / n) + 1.96::double * sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)), 4) as high from w""")
def wilson_shares(spark, d):
    counted = event_readings(spark, d).groupBy("metric").agg(F.count_if(F.col("value") > 60).alias("part"), F.count(F.lit(1)).alias("whole"))
    low, high = studies.wilson(F.col("part").cast("double"), F.col("whole").cast("double"))
    return counted.select("metric", "part", "whole", F.round(100 * low, 4).alias("low"), F.round(100 * high, 4).alias("high"))


@query(f"""with {EVENTS}, o as (select run_id, metric, max(value) as v from e where run_id::bigint % 13 <> 1 group by 1, 2), n as (select run_id, metric, max(value) * case when run_id::bigint % 7 = 0 then 1 + 1e-9::double when run_id::bigint % 7 = 1 then 1 + 1e-12::double else 1::double end as v from e where run_id::bigint % 11 <> 2 group by 1, 2, run_id)
select run_id, metric, round(o.v, 6) as old, round(n.v, 6) as new from o full join n using (run_id, metric) where o.v is null or n.v is null or abs(o.v - n.v) > greatest(1e-12, 1e-10 * greatest(abs(o.v), abs(n.v)))""")
def report_diff(spark, d):
    """Two reports of the runs' highest values: some runs are missing, some changed beyond the tolerance, some within it."""
    best = event_readings(spark, d).groupBy("run_id", "metric").agg(F.max("value").alias("value"))
    left = lambda by: F.col("run_id").cast("long") % by
    factor = F.when(left(7) == 0, 1 + 1e-9).when(left(7) == 1, 1 + 1e-12).otherwise(1.0)
    new = best.filter(left(11) != 2).withColumn("value", F.col("value") * factor)
    return studies.differences(best.filter(left(13) != 1), new, ["run_id", "metric"], "value").select("run_id", "metric", _r(F.col("old"), "old"), _r(F.col("new"), "new"))


@query(f"""with {EVENTS}, m as (select run_id, max(step) as last from e group by 1), l as (select run_id, step * 920.0::double / greatest(last, 1) as x, cast(event_key as varchar) as text from (select *, seq as event_key from e) join m using (run_id) where value > 50),
  a as (select *, case when x - lag(x) over w >= 26 then 1 when lag(x) over w is null then 1 else 0 end as apart from l window w as (partition by run_id order by x, text)), c as (select *, sum(apart) over (partition by run_id order by x, text rows between unbounded preceding and current row) as cluster from a)
  select run_id, cast(cluster as bigint) as cluster, round(min(x), 6) as first_x, round(max(x), 6) as last_x, count(*) as n, string_agg(text, ' / ' order by x, text) as text from c group by 1, 2""")
def label_clusters(spark, d):
    rows = event_readings(spark, d)
    last = F.greatest(F.max("step").over(Window.partitionBy("run_id")), F.lit(1))
    labels = rows.withColumn("x", F.col("step") * 920.0 / last).filter("value > 50").select("run_id", "x", F.col("seq").cast("string").alias("text"))
    return studies.label_clusters(labels, ["run_id"]).select("run_id", "cluster", _r(F.col("first_x"), "first_x"), _r(F.col("last_x"), "last_x"), "n", "text")


_CHART = f"{CURVES}, c as (select run_id, step, value, cast(floor(case when max(step) over (partition by run_id) > min(step) over (partition by run_id) then (step - min(step) over (partition by run_id))::double / (max(step) over (partition by run_id) - min(step) over (partition by run_id)) else 0 end * 200) as bigint) as col from t)"


@query(f"with {_CHART} select run_id, col, count(*) as n, min(step) as first_step, first(step order by value, step) as low_step, first(step order by value desc, step) as high_step, max(step) as last_step, round(min(value), 6) as low, round(max(value), 6) as high from c group by 1, 2")
def chart_m4(spark, d):
    out = studies.thinned(curves(spark, d), width=100)
    return out.select("run_id", "col", "n", "first_step", "low_step", "high_step", "last_step", _r(F.col("low"), "low"), _r(F.col("high"), "high"))


@query(f"with {CURVES}, q as (select run_id, min(value) as low, max(value) as mx, quantile_cont(value, 0.99) as p99 from t group by 1) select run_id, round(low, 6) as low, round(case when mx > 1.5 * p99 then 1.5 * p99 else mx end, 6) as high, mx > 1.5 * p99 as capped from q")
def chart_y_domain(spark, d):
    return studies.y_domain(curves(spark, d)).select("run_id", _r(F.col("low"), "low"), _r(F.col("high"), "high"), "capped")


@query(f"with {CURVES}, c as (select run_id, step, value, case when n > 200 then cast(floor((pos * 200)::double / n) as bigint) else pos end as col from t) select run_id, col, first(step order by value desc, step) as step, round(max(value), 6) as value from c group by 1, 2")
def marker_thin(spark, d):
    return studies.markers(curves(spark, d)).select("run_id", "col", "step", _r(F.col("value"), "value"))


@query(f"with {EVENTS}, f as (select run_id, metric, max(step) as step_start, case when max(step) > 60 then 'error' else 'info' end as severity from e group by 1, 2), o as (select run_id, metric, max(step) as step_start, case when max(step) > 60 then 'error' else 'info' end as severity from e where step < 55 group by 1, 2) select f.* from f where not exists (select 1 from o where o.run_id = f.run_id and o.metric = f.metric and o.step_start = f.step_start and o.severity = f.severity)")
def new_findings(spark, d):
    def told(rows):
        out = rows.groupBy("source_id", "run_id", "metric").agg(F.max("step").alias("step_start"))
        return out.select("*", F.lit("x").alias("detector"), F.lit("t").alias("title"), F.when(F.col("step_start") > 60, "error").otherwise("info").alias("severity"))

    rows = event_readings(spark, d)
    return joins.new_findings(told(rows), told(rows.filter("step < 55"))).select("run_id", "metric", "step_start", "severity")


@query(f"with {EVENTS} select run_id, count(*) filter (step = 10 and run_id::bigint % 7 = 0) = 0 as extends, count(*) filter (step = 10 and run_id::bigint % 7 = 0) as changed from e where step < 40 group by 1")
def history_extends(spark, d):
    rows = event_readings(spark, d)
    changed = rows.withColumn("value", F.when((F.col("step") == 10) & (F.col("run_id").cast("long") % 7 == 0), F.col("value") + 1).otherwise(F.col("value")))
    return joins.extends(rows.filter("step < 40"), changed).select("run_id", "extends", "changed")


@query()
def watch_batches(spark, d):
    """New findings by batch as the events' histories arrive in three parts."""
    home = shared_home(spark)
    rows = event_readings(spark, d)
    for low, high in ((-1, 20), (20, 45), (45, 1 << 53)):
        rows.filter((F.col("step") > low) & (F.col("step") <= high)).write.mode("append").parquet(f"{home}/in")
        watch(follow(spark, f"{home}/in"), f"{home}/home", lambda found, number: None, once=True).awaitTermination()
    told = spark.read.parquet(f"{home}/home/findings")
    return told.groupBy(F.col("batch").cast("int").alias("batch"), "detector").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run_id").alias("runs"))


def shared_home(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return f"{folder}/watch-{uuid.uuid4().hex}"
    own = tempfile.mkdtemp(prefix="curvelens-watch-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}/watch"


# --- readers: the events' histories as log files, one per run, read back ---


def _read_back(spark: SparkSession, texts: DataFrame, fmt: str) -> DataFrame:
    """Readings of the logs (name, value) that were written as one file each; run is the name."""
    home = shared_home(spark)
    texts.repartition("name").write.partitionBy("name").text(home)
    found = load(spark, home, fmt, pattern="*.txt")
    return found.withColumn("run", F.regexp_extract("source_id", "/name=([^/]+)/", 1))


def _lines(spark: SparkSession, d: str, metrics: list[str], line, head: str = "", tail: str = "", gap: str = "\n") -> DataFrame:
    """(name, value): the file of each run, a line per reading in order of steps."""
    rows = event_readings(spark, d).filter(F.col("metric").isin(metrics)).select("run_id", "step", line.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "line"))), lambda x: x["line"]), gap)
    return rows.groupBy(F.col("run_id").alias("name")).agg(F.concat(F.lit(head), body, F.lit(tail)).alias("value"))


def _cell(metric: str):
    return F.when(F.col("metric") == metric, F.col("value").cast("string")).otherwise("")


def _of(*metrics: str) -> str:
    listed = ", ".join(f"'{m}'" for m in metrics)
    return f"with {EVENTS} select run_id as run, metric, step, round(value, 6) as value from e where metric in ({listed})"


def _read_values(found: DataFrame) -> DataFrame:
    return found.select("run", "metric", "step", _r(F.col("value"), "value"))


@query(_of("train/loss", "lr"))
def read_csv_logs(spark, d):
    line = F.concat_ws(",", "step", _cell("train/loss"), _cell("lr"))
    return _read_values(_read_back(spark, _lines(spark, d, ["train/loss", "lr"], line, "step,loss,learning_rate\n"), "csv"))


@query(_of("train/loss"))
def read_decimal_comma_logs(spark, d):
    """Semicolons between cells and commas in numbers."""
    line = F.concat_ws(";", "step", F.translate(F.col("value").cast("decimal(18,6)").cast("string"), ".", ","))
    return _read_values(_read_back(spark, _lines(spark, d, ["train/loss"], line, "step;loss\n"), "csv"))


@query(_of("train/loss", "eval/loss"))
def read_jsonl_logs(spark, d):
    key = F.when(F.col("metric") == "train/loss", "loss").otherwise("eval_loss")
    line = F.concat(F.lit('{"step": '), "step", F.lit(', "'), key, F.lit('": '), F.col("value").cast("string"), F.lit("}"))
    return _read_values(_read_back(spark, _lines(spark, d, ["train/loss", "eval/loss"], line), "jsonl"))


@query(_of("train/loss", "eval/loss", "lr", "grad_norm"))
def read_trainer_state_logs(spark, d):
    key = F.create_map(*map(F.lit, ("train/loss", "loss", "eval/loss", "eval_loss", "lr", "learning_rate", "grad_norm", "grad_norm")))[F.col("metric")]
    line = F.concat(F.lit('{"step": '), "step", F.lit(', "'), key, F.lit('": '), F.col("value").cast("string"), F.lit("}"))
    return _read_values(_read_back(spark, _lines(spark, d, ["train/loss", "eval/loss", "lr", "grad_norm"], line, '{"log_history": [', "]}", ", "), "hf"))


@query(f"with {EVENTS} select run_id as run, metric, step, round(value, 6) as value, step * 2.5::double as wall_time from e where metric in ('train/loss', 'eval/loss')")
def read_history_logs(spark, d):
    """A tracker's history: logging steps, seconds since the start, bookkeeping columns."""
    line = F.concat_ws(",", "step", (F.col("step") * 2.5).cast("string"), F.lit("1"), _cell("train/loss"), _cell("eval/loss"))
    found = _read_back(spark, _lines(spark, d, ["train/loss", "eval/loss"], line, "_step,_runtime,_own,train/loss,eval/loss\n"), "wandb")
    return found.select("run", "metric", "step", _r(F.col("value"), "value"), "wall_time")


@query(f"with {EVENTS} select 'user ' || run_id as run_id, metric, step, round(value, 6) as value from e where metric = 'train/loss'")
def read_chart_logs(spark, d):
    """A chart's export: the run's name is in the header, beside bands that are left out."""
    rows = _lines(spark, d, ["train/loss"], F.concat_ws(",", "step", F.col("value").cast("string"), F.lit("0"), F.lit("9")))
    name = F.concat(F.lit("user "), "name", F.lit(" - train/loss"))
    head = F.concat(F.lit('Step,"'), name, F.lit('","'), name, F.lit('__MIN","'), name, F.lit('__MAX"\n'))
    return _read_back(spark, rows.select("name", F.concat(head, "value").alias("value")), "wandb").select("run_id", "metric", "step", _r(F.col("value"), "value"))


# --- the flagship: setbacks of every curve ---


def flagship(spark: SparkSession, d: str) -> DataFrame:
    found = detectors.run_all(curves(spark, d), {"setbacks": detectors.setbacks})
    return found.select("run_id", "title", "severity", "step_start", "step_end", F.col("evidence")["level_before"].cast("double").alias("level_before"), F.col("evidence")["peak_level"].cast("double").alias("peak_level"))
