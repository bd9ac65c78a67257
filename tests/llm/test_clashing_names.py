"""Every stage's operator on tables whose extra columns have names that operators might use inside."""

from pyspark.sql import functions as F

from curvelens.llm import bpe, decontaminate, language, media, near_dedup, substring_dedup

NAMES = ["__text", "own", "id", "mark", "packed", "home", "node", "kept", "row", "n", "key", "hits", "items", "codes", "ids", "maps", "lang_pred", "score", "rejected", "a.b", "c`d", "blob", "media", "declared"]


def table(spark):
    prose = "the quick and the dead of this thing that is there when they "
    rows = [(k, prose * (1 + k % 4) + f"number {k}", "en") for k in range(30)] + [(None, None, None), (31, "", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.select("*", *(F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")).alias(c) for i, c in enumerate(NAMES)))


def unchanged(df, out):
    """Every row that is left has its own extra columns."""
    assert out.columns[: len(df.columns)] == df.columns
    for row in out.collect():
        for i in range(len(NAMES)):
            assert row[3 + i] == (None if row[0] is None else f"{i}:{row[0]}")
    return out.count()


def test_stages(spark):
    df = table(spark)
    items = spark.createDataFrame([(1, "number 3")], "item_id long, text string")
    assert unchanged(df, language.keep_known(df)) == 30
    assert unchanged(df, near_dedup.drop_near_duplicates(df)) >= 3
    assert unchanged(df, substring_dedup.remove_repeats(df)) == 32
    assert unchanged(df, decontaminate.drop_contaminated(df, items)) == 31
    assert unchanged(df, bpe.encode(df, {bytes([i]): i for i in range(256)})) == 32
    assert unchanged(df, media.sniff(df.withColumn("bytes", F.col("text").cast("binary")), "bytes")) == 32


def test_stages_on_an_empty_table(spark):
    df = table(spark).limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (language.keep_known(df), near_dedup.drop_near_duplicates(df), substring_dedup.remove_repeats(df), decontaminate.drop_contaminated(df, items), bpe.encode(df, {bytes([i]): i for i in range(256)})):
        assert out.count() == 0 and out.columns[: len(df.columns)] == df.columns
