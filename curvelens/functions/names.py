"""Metric names: raw spellings to a canonical vocabulary of seven, best claim first."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Token sequences of each canonical metric, best first; E stands for any evaluation split.
SPLITS = ["eval", "val", "valid", "validation", "dev"]
VOCABULARY = {
    "train/loss": ["loss", "train loss", "training loss", "loss train", "loss training", "train loss step", "batch loss", "train batch loss", "train loss epoch", "epoch loss", "train epoch loss"],
    "eval/loss": ["E loss", "loss E", "E loss epoch", "E epoch loss", "E loss step"],
    "lr": ["lr", "learning rate", "train lr", "train learning rate", "optim lr", "optimizer lr", "trainer lr", "charts learning rate", "epoch learning rate", "epoch lr", "train epoch learning rate", "train epoch lr"],
    "grad_norm": ["grad norm", "gradient norm", "train grad norm", "train gradient norm", "grad norm global", "global grad norm", "total grad norm", "grad norm before clip"],
    "step_time": ["step time", "time per step", "iter time", "seconds per step", "train step time"],
    "throughput": ["samples per second", "train samples per second", "throughput", "tokens per second", "train tokens per second"],
    "epoch": ["epoch", "train epoch"],
}
GROUPED_LR = r"^lr[-/]([A-Za-z][A-Za-z0-9_]*)?(?:/?pg([0-9]+))?$"


@cache
def claims() -> list[tuple[str, str, int]]:
    """(tokens joined by blanks, canonical, rank)."""
    out = []
    for canonical, forms in VOCABULARY.items():
        spelled = [f.replace("E", s) for f in forms for s in (SPLITS if "E" in f else [""])]
        out += [(f, canonical, rank) for rank, f in enumerate(spelled)]
    return out


def tokens(raw: Column) -> Column:
    """Lower-case words of a name, joined by blanks."""
    return F.array_join(F.filter(F.split(F.lower(F.trim(raw)), r"[/_.\-\s]+"), lambda t: t != ""), " ")


def claim_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(claims(), "tokens string, canonical string, rank int")


def key_map(names: DataFrame) -> DataFrame:
    """Of (source_id, raw, ord) the stored name of each raw one.

    One raw name of a source gets each canonical name: an exact spelling, else the lowest rank,
    else the first to appear. Losers keep their own name (eval_x as eval/x); names that then
    collide get [2], [3], ... in order of appearance, a literal spelling first.
    """
    spark = names.sparkSession
    named = names.withColumn("tokens", tokens(F.col("raw"))).join(F.broadcast(claim_table(spark)), "tokens", "left")
    group = F.regexp_extract("raw", GROUPED_LR, 2)
    grouped = F.col("canonical").isNull() & F.col("raw").rlike(GROUPED_LR)
    named = named.withColumn("rank", F.when(F.col("raw").isin(list(VOCABULARY)), -2).when(grouped, 100 + F.coalesce(group.try_cast("int"), F.lit(0))).otherwise(F.col("rank")))
    named = named.withColumn("canonical", F.when(F.col("raw").isin(list(VOCABULARY)), F.col("raw")).when(grouped, F.lit("lr")).otherwise(F.col("canonical")))
    best = F.row_number().over(Window.partitionBy("source_id", "canonical").orderBy("rank", "ord"))
    won = F.col("canonical").isNotNull() & (F.col("best") == 1)
    plain = F.regexp_replace("raw", "^eval_", "eval/")
    kept = named.withColumn("best", best).withColumn("stored", F.when(won, F.col("canonical")).otherwise(plain))
    order = Window.partitionBy("source_id", "stored").orderBy(F.when(won, 0).when(F.col("stored") == F.col("raw"), 1).otherwise(2), "ord")
    kept = kept.withColumn("n", F.row_number().over(order))
    return kept.select("source_id", "raw", F.when(F.col("n") == 1, F.col("stored")).otherwise(F.concat("stored", F.lit("["), F.col("n").cast("string"), F.lit("]"))).alias("metric"), F.coalesce(won, F.lit(False)).alias("canonical"))


def stored_names(raws: list[str]) -> dict[str, str]:
    """The same for the header of one file, on the driver."""
    table = {t: (c, r) for t, c, r in claims()}
    best: dict[str, tuple] = {}
    for place, raw in enumerate(dict.fromkeys(raws)):
        key = " ".join(t for t in re.split(r"[/_.\-\s]+", raw.strip().lower()) if t)
        claim = (raw, -2) if raw in VOCABULARY else table.get(key)
        if claim is None and (m := re.match(GROUPED_LR, raw)):
            claim = ("lr", 100 + int(m[2] or 0))
        if claim and (claim[0] not in best or (claim[1], place) < best[claim[0]][:2]):
            best[claim[0]] = (claim[1], place, raw)
    out = {b[2]: c for c, b in best.items()}
    taken = set(out.values())
    rest = [r for r in dict.fromkeys(raws) if r not in out]
    for raw in sorted(rest, key=lambda r: r.startswith("eval_")):
        name, n = re.sub("^eval_", "eval/", raw), 2
        while (stored := name if n == 2 and name not in taken else f"{name}[{n}]") in taken:
            n += 1
        out[raw] = stored
        taken.add(stored)
    return out
