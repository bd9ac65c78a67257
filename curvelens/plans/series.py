"""Readings made from the driver's tables: long curves from lineitem, short runs of many metrics from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The metric that each event type stands for.
EVENT_METRICS = {"view": "train/loss", "click": "eval/loss", "purchase": "lr", "signup": "grad_norm", "error": "unreadable"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def curves(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """One falling loss per supplier, a reading per day; every third run has a bump. With gaps: NULLs and NaNs."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("day"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    daily = items.groupBy("l_suppkey", "day").agg(F.floor(F.sum("cents") / F.count(F.lit(1))).cast("long").alias("cents"))
    run = Window.partitionBy("l_suppkey")
    placed = daily.select("l_suppkey", F.datediff("day", F.min("day").over(run)).cast("long").alias("step"), (F.row_number().over(run.orderBy("day")) - 1).cast("long").alias("pos"), F.count(F.lit(1)).over(run).alias("n"), (F.col("cents") / 100.0 / 110000.0).alias("p"))
    x = F.col("pos") / F.col("n")
    value = (0.2 + 1.8 / (1.0 + 20.0 * x)) * (0.8 + 0.4 * F.col("p")) + F.when((F.col("l_suppkey") % 3 == 1) & (x >= 0.4) & (x < 0.55), 1.0).otherwise(0.0)
    if gaps:
        value = F.when(F.col("pos") % 97 == 13, F.lit(None)).when(F.col("pos") % 211 == 50, float("nan")).otherwise(value)
    return placed.select(F.lit("lineitem").alias("source_id"), F.col("l_suppkey").cast("string").alias("run_id"), F.lit("train/loss").alias("metric"), F.lit("loss").alias("raw_metric"), F.col("pos").alias("seq"), "step", value.cast("double").alias("value"), F.lit(None).cast("double").alias("wall_time"), F.lit(None).cast("double").alias("epoch"))


#: The same as SQL: t(run_id, pos, n, step, value).
CURVES = """
items as (select l_suppkey, cast(l_shipdate as date) as day, cast(round(l_extendedprice * 100) as bigint) as cents from lineitem),
daily as (select l_suppkey, day, cast(floor(sum(cents)::double / count(*)) as bigint) as cents from items group by 1, 2),
placed as (select l_suppkey, cast(day - min(day) over (partition by l_suppkey) as bigint) as step, row_number() over (partition by l_suppkey order by day) - 1 as pos, count(*) over (partition by l_suppkey) as n, cents / 100.0::double / 110000.0::double as p from daily),
t as (select cast(l_suppkey as varchar) as run_id, pos, n, step, (0.2::double + 1.8::double / (1.0::double + 20.0::double * (pos::double / n))) * (0.8::double + 0.4::double * p)
  + case when l_suppkey % 3 = 1 and pos::double / n >= 0.4 and pos::double / n < 0.55 then 1.0::double else 0.0::double end as value from placed)"""
GAPPED = CURVES + """,
g as (select run_id, pos, n, step, case when pos % 97 = 13 then null when pos % 211 = 50 then 'nan'::double else value end as value from t)"""


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per user: the metric from the event type, steps in order of time."""
    events = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    metric = F.create_map(*(F.lit(x) for pair in EVENT_METRICS.items() for x in pair))[F.col("event_type")]
    return events.select(F.lit("events").alias("source_id"), F.col("user_id").cast("string").alias("run_id"), F.coalesce(metric, F.col("event_type")).alias("metric"), F.col("event_type").alias("raw_metric"), F.col("event_id").alias("seq"), (F.row_number().over(order) - 1).cast("long").alias("step"), F.col("value").cast("double").alias("value"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("wall_time"), F.lit(None).cast("double").alias("epoch"))


EVENTS = """
e as (select cast(user_id as varchar) as run_id, case event_type when 'view' then 'train/loss' when 'click' then 'eval/loss' when 'purchase' then 'lr' when 'signup' then 'grad_norm' when 'error' then 'unreadable' else event_type end as metric,
  event_id as seq, row_number() over (partition by user_id order by ts, event_id) - 1 as step, value, epoch_us(ts) / 1e6 as wall_time from events)"""


def order_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated and conflicting steps: a reading per line of a supplier's day, the quantity in tens."""
    items = table(spark, sf_dir, "lineitem")
    seq = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"))
    value = F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.when(F.col("l_suppkey") % 2 == 0, F.floor(F.col("l_quantity") / 10)).otherwise(F.lit(1.0)))
    return items.select(F.lit("orders").alias("source_id"), F.col("l_suppkey").cast("string").alias("run_id"), F.concat(F.lit("m"), (F.col("l_linenumber") % 2).cast("string")).alias("metric"), F.lit("m").alias("raw_metric"), seq.cast("long").alias("seq"), F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("long").alias("step"), value.cast("double").alias("value"), F.lit(None).cast("double").alias("wall_time"), F.lit(None).cast("double").alias("epoch"))


ORDERS = """
o as (select cast(l_suppkey as varchar) as run_id, 'm' || (l_linenumber % 2) as metric, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey) as seq,
  cast(cast(l_shipdate as date) - date '1992-01-01' as bigint) as step, case when l_linenumber = 7 then null when l_suppkey % 2 = 0 then floor(l_quantity / 10) else 1.0 end::double as value from lineitem),
os as (select run_id, metric, step, count(*) as n, count(value) as readable, count(distinct value) as dv, arg_min(value, seq) filter (value is not null) as fv0, first(value order by seq) as fv from o group by 1, 2, 3)"""
