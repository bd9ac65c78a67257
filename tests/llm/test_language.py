import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from curvelens.llm.language import DIMENSIONS, Model, OCTAVES, bounds_of, counts_of, has_letter, keep_known, nearest, op4_language, predict, train

TEXTS = {"en": "the quick and the dead of this thing that is there when they", "fr": "les enfants où étaient nous avons été très heureux à la maison", "de": "der schöne Garten und die großen Häuser über dem Fluß"}


def table(spark):
    rows = []
    for k in range(240):
        lang = ("en", "fr", "de")[k % 3]
        words = TEXTS[lang].split()
        rows.append((k, " ".join(words[(k * 7 + i * 5) % len(words)] for i in range(6 + k % 9)), lang, "s"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_ngrams_do_not_cross_texts():
    both = counts_of(pa.array(["ab Cd", None, "x"]))
    assert (both[0] == counts_of(pa.array(["AB  1 cd"]))[0]).all()
    assert both[1].sum() == 1 and both[2].sum() == 2 + 1 and both[0].sum() == sum(6 - k for k in range(4))
    assert has_letter(pa.array(["12", "a", "é1", None, "", "½"])).tolist() == [False, True, True, False, False, False]


def test_learns_and_rejects(spark):
    df = table(spark)
    found = predict(df, train(df.filter("doc_id < 180"))).filter("doc_id >= 180").collect()
    assert np.mean([x["__lang"] == x.lang for x in found]) > 0.95
    assert all(0 <= x["__score"] <= 1 for x in found)
    odd = spark.createDataFrame([(1, None, None, "a"), (1, "", "en", "b"), (None, "123 !!", "fr", "c"), (2, "中文字符測試", None, "d"), (3, TEXTS["en"], None, "e")], df.schema)
    kept = keep_known(df.unionByName(odd))
    assert kept.columns == df.columns
    assert [x.score for x in kept.filter("score in ('a','b','c','d','e')").collect()] == ["e"]
    assert kept.count() == 241


def test_without_labels_all_is_unknown(spark):
    df = table(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {x["__lang"] for x in predict(df, train(df)).collect()} == {"und"}
    assert predict(df.limit(0), train(df.limit(0))).count() == 0


def test_query_on_held_out_rows(spark, sf_dir):
    got = op4_language(spark, sf_dir).collect()
    truth = {x.doc_id: x.lang for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(truth)
    held = [x for x in got if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    assert np.mean([x.lang_pred == truth[x.doc_id] for x in held]) > 0.95
    assert not any(x.rejected for x in got if x.lang_pred != "und")


def test_the_nearest_centroid_by_plain_cosine(spark):
    r = np.random.default_rng(0)
    centroids = r.random((5, DIMENSIONS)).astype(np.float32)
    centroids /= np.linalg.norm(centroids, axis=1)[:, None]
    centroids[3] = centroids[1]  # a tie: the first language by name
    model = Model(r.random(DIMENSIONS).astype(np.float32), centroids, ["a", "b", "b", "c", "c"], np.full(OCTAVES, 0.2))
    df = table(spark)
    for x in predict(df, model).collect():
        counts = counts_of(pa.array([x.text]))[0].astype(float)
        v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * model.idf
        cosines = centroids @ (v / np.linalg.norm(v))
        assert x["__lang"] == model.languages[int(np.argmax(cosines))]
        assert abs(x["__score"] - cosines.max()) < 1e-5 and x["__rejected"] == (cosines.max() < 0.2)


def test_bounds_follow_the_length():
    octaves = np.repeat([5, 10], 500)
    bounds = bounds_of(octaves, np.where(octaves == 5, 0.3, 0.8))
    assert bounds[0] == 0.15 and abs(bounds[5] - 0.27) < 1e-9 and abs(bounds[8] - 0.27) < 1e-9 and abs(bounds[10] - 0.72) < 1e-9 and bounds[39] == bounds[11]


def test_long_junk_is_rejected_and_clean_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lang is not null and text is not null").limit(4000)
    r = np.random.default_rng(3)
    junk = ["".join(r.choice(list("0123456789abcdef"), 1500)), "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 1500)), "Привет мир и люди " * 40]
    odd = spark.createDataFrame([(10_000_000 + k, t, None, "junk", len(t)) for k, t in enumerate(junk)], docs.schema)
    left = keep_known(docs.unionByName(odd))
    assert left.filter("source = 'junk'").count() == 0
    assert left.count() >= 0.998 * docs.filter("text rlike '[A-Za-z]'").count()


def test_centroids_are_learned_from_every_labelled_text(spark):
    # each text has n-grams of its own, many of them in none of any few hundred other texts
    r = np.random.default_rng(5)
    texts = ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(3000)]
    df = spark.createDataFrame([(k, t, ("en", "fr")[k % 2]) for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = train(df.repartition(3))
    for lang in ("en", "fr"):
        own = [t for k, t in enumerate(texts) if ("en", "fr")[k % 2] == lang]
        learned = model.centroids[[x == lang for x in model.languages]].max(axis=0) > 0
        assert (learned == (counts_of(pa.array(own)) > 0).any(axis=0)).all()
    again = train(df.repartition(7))
    assert (again.centroids == model.centroids).all() and again.languages == model.languages


def test_the_centroids_by_plain_rounds(spark):
    df = table(spark)
    rows = sorted(df.collect())
    counts = counts_of(pa.array([x.text for x in rows])).astype(float)
    model = train(df, clusters=3, rounds=2)
    vectors = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * model.idf
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    for lang in TEXTS:
        mine = [k for k, x in enumerate(rows) if x.lang == lang]
        mean = (counts[mine] > 0).sum(axis=0) * model.idf
        mean /= np.linalg.norm(mean)
        centres = []
        for j in range(3):
            signs = np.random.default_rng(j).choice([-1.0, 1.0], DIMENSIONS)
            centres.append(signs - (signs @ mean) * mean)
        for _ in range(2):
            to = [int(np.argmax([vectors[k] @ c for c in centres])) for k in mine]
            sums = [sum(vectors[k] for k, own in zip(mine, to, strict=True) if own == j) for j in range(len(centres)) if j in to]
            centres = [s / np.linalg.norm(s) for s in sums]
        got = model.centroids[[x == lang for x in model.languages]]
        assert got.shape == np.shape(centres) and np.abs(got - centres).max() < 1e-4


def plain_bounds(octaves, cosines):
    out, bound = [], 0.5 * cosines.min()
    for k in range(OCTAVES):
        own = cosines[(octaves >= k - 1) & (octaves <= k + 1)]
        bound = 0.9 * np.quantile(own, 0.001) if len(own) >= 200 else bound
        out.append(bound)
    return np.array(out)


def test_bounds_come_from_every_labelled_text(spark):
    r = np.random.default_rng(6)
    words = ["".join(r.choice(list("abcdefghij"), 4)) for _ in range(300)]
    texts = [" ".join(words[x] for x in r.integers(0, 300, r.integers(1, 12))) for _ in range(9000)]
    model = train(spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string"))
    _, cosines, octaves = nearest(pa.array(texts), model)
    assert np.abs(model.bounds - plain_bounds(octaves, cosines)).max() < 1e-5
