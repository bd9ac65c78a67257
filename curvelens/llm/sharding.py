"""Operator 10, sharding: rendezvous hashing of stable keys over weighted shards.

Every shard scores a key by weight / -ln(u), u in (0, 1) from the MD5 of key and shard number;
the highest score wins, the lower number on ties. The key and the list of shards decide: a new
shard takes its share from all others and no row moves between old shards, and shares follow
the weights.

Slots number the rows of a shard from 0 without gaps, by key. A shard of any size is numbered
in stretches of keys between quantiles of the whole table: rows are counted by shard and
stretch, and a window numbers each (shard, stretch) from its offset, so no task gets a shard.
The offsets are shards * stretches rows and are broadcast up to OFFSETS of them.

Defined results. A null key is the empty string and numbers last; a null text has size 16 and
CRC-32 0; repeated rows get one shard and slots of their own. All columns are expressions of
built-in functions; other columns of the table are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvelens.llm.common import place, stored, table

SHARDS = 40
#: Rows of one shard and stretch, and stretches, at most; offsets that are broadcast.
STRETCH_ROWS = 20_000
STRETCHES = 8192
OFFSETS = 200_000


def unit(key: Column, shard: Column) -> Column:
    """Uniform in (0, 1): 52 bits of MD5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", key, shard.cast("string")).cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits + 0.5) / F.lit(float(1 << 52))


def scores(key: Column, weights: list[float]) -> Column:
    """array<double>: the score of each shard; a weight of 0 never wins against a positive one."""
    own = F.array(*(F.lit(float(w)) for w in weights))
    return F.transform(own, lambda w, i: w / -F.log(unit(key, i)))


def winner(scored: Column, n: int) -> Column:
    """Place of the highest of the first n scores."""
    first = F.slice(scored, 1, n)
    return (F.array_position(first, F.array_max(first)) - 1).cast("int")


def assign(docs: DataFrame, weights: list[float], id_col: str = "doc_id", text_col: str = "text", grown_by: float | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, and grown_shard: the shard with one more of weight grown_by."""
    text = F.col(f"`{text_col}`").cast("string")
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        scores(key, [*weights, *([] if grown_by is None else [grown_by])]).alias("scores"),
    )
    rows = rows.select("doc_id", "size", "text_crc32", winner(F.col("scores"), len(weights)).alias("shard"), (F.lit(None).cast("int") if grown_by is None else winner(F.col("scores"), len(weights) + 1)).alias("grown_shard"))
    n = docs.count()
    stretches = max(1, min(STRETCHES, -(-n // (STRETCH_ROWS * len(weights)))))
    if n > 64 * len(weights):
        stretches = max(stretches, 16)
    cuts = []
    if stretches > 1:
        shares = [i / stretches for i in range(1, stretches)]
        cuts = sorted({x for x in docs.select(F.percentile_approx(F.col(f"`{id_col}`").cast("long"), shares, 10_000)).first()[0] or [] if x is not None})
    stretch = F.lit(len(cuts))
    if cuts:
        stretch = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(place(F.col("doc_id"), cuts))
    # computed once: counts and slots both read it
    rows = stored(rows.withColumn("stretch", stretch.cast("int")), "assigned")
    counts = rows.groupBy("shard", "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "stretch", before.alias("before"))
    if len(weights) * (len(cuts) + 1) <= OFFSETS:
        offsets = F.broadcast(offsets)
    order = Window.partitionBy("shard", "stretch").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(order) - 1).join(offsets, ["shard", "stretch"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place")).cast("long").alias("slot"), "grown_shard")


def op10_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"), [1.0] * SHARDS, grown_by=1.0)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
