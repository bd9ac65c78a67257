import random
import re

import numpy as np
import pyarrow as pa

from curvelens.llm import near_dedup
from curvelens.llm.components import components
from curvelens.llm.near_dedup import TREES, digests, drop_near_duplicates


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute(rows):
    sets = {k: shingles(t) for k, t in rows.items()}
    lead = {k: k for k in rows}

    def root(x):
        while lead[x] != x:
            x = lead[x]
        return x

    keys = sorted(rows)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                lead[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k), root(k) == k) for k in rows}


def fixture(seed):
    r = random.Random(seed)
    prose = lambda n: [f"{r.choice('abcdef')}{r.randrange(60)}" for _ in range(n)]
    rows, k = {}, 0
    for size, copies in ((150, 60), (80, 12), (40, 5), (300, 3)):
        base = prose(size)
        for _ in range(copies):
            words = list(base)
            for _ in range(r.randrange(size // 12)):
                words[r.randrange(size)] = r.choice(["X", "yy", "Zé"])
            rows[k] = " ".join(words)
            k += 1
    for _ in range(60):
        rows[k] = "\n".join(prose(r.randrange(30)))
        k += 1
    keys = list(rows)
    r.shuffle(keys)
    rows = {keys[i]: t for i, t in enumerate(rows.values())}
    return rows | {500: None, 501: "", 502: " \n", 503: "one", 504: "ONE", 505: "one two three", 506: rows[7].upper(), 507: "a " * 4000}


def test_matches_brute_force(spark):
    for seed, block in ((1, 4096), (2, 16)):  # a family in one block, in several
        rows = fixture(seed)
        df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
        got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in digests(df, block=block).collect()}
        assert got == brute(rows)


def test_kept_rows_repeats_and_clashing_columns(spark):
    text = "the same words over and over until there are enough of them"
    rows = [(3, text, "a"), (1, text.upper(), "b"), (1, text.upper(), "b"), (None, text, "c"), (None, "another text without an identity at all", "d"), (9, None, "e"), (9, "", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(2)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(x.node for x in kept.collect()) == ["b", "d", "e", "f"]
    assert {(x.doc_id, x.component_id) for x in digests(df).collect()} == {(3, 1), (1, 1), (None, 1), (None, None), (9, 9)}
    assert digests(df.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}


def test_same_components_whatever_the_batches(spark):
    rows = fixture(3)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    try:
        for size in (11, 4000):
            spark.conf.set(name, size)
            assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in digests(df).collect()} == brute(rows)
    finally:
        spark.conf.set(name, old)


def test_exact_on_a_middle_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = {x.doc_id: x.text for x in df.collect()}
    sets = {k: shingles(t) for k, t in rows.items()}
    by, lead = {}, {k: k for k in rows}

    def root(x):
        while lead[x] != x:
            x = lead[x]
        return x

    # all pairs that share a shingle, by an index of shingles
    for k in sorted(rows):
        both = {}
        for s in sets[k]:
            for other in by.setdefault(s, []):
                both[other] = both.get(other, 0) + 1
            by[s].append(k)
        for other, n in both.items():
            if 100 * n >= 75 * (len(sets[k]) + len(sets[other]) - n):
                x, y = root(k), root(other)
                lead[max(x, y)] = min(x, y)
    assert {x.doc_id: x.component_id for x in digests(df).collect()} == {k: root(k) for k in rows}


def test_minima_of_large_sets_use_all_their_bits():
    r = random.Random(5)
    texts = [" ".join(f"{r.getrandbits(40):x}" for _ in range(400)) for _ in range(150)]
    batch = pa.record_batch({"own": pa.array([{"none": 0}] * 150), "id": pa.array(range(150), pa.int64()), "text": pa.array(texts)})
    signs = [x for b in near_dedup._signatures(5)(iter([batch])) for x in b.column("sign").to_pylist()]
    first = np.frombuffer(b"".join(signs), np.uint8).reshape(150, TREES, -1)[:, :, :4]
    # 4800 values a byte: unrelated texts must not meet in a region because high bits are zero
    assert [len(np.unique(first[:, :, k])) for k in range(4)] == [256] * 4


def test_texts_without_a_family_are_not_shuffled(spark, monkeypatch, tmp_path):
    r = random.Random(6)
    rows = {k: " ".join(f"{r.getrandbits(64):x}" for _ in range(2500)) for k in range(120)}
    rows |= {200 + k: rows[k] + " and a tail" for k in range(4)}
    spark.createDataFrame(list(rows.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    context = spark.sparkContext._jsc.sc()

    def written() -> int:
        context.listenerBus().waitUntilEmpty()
        executors = context.statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    expected = brute(rows)
    name = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(name)
    try:
        spark.conf.set(name, -1)
        before = written()
        assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in digests(df).collect()} == expected
        # a hexadecimal digit takes half a byte: compressed, all texts are more than this
        assert written() - before < sum(map(len, rows.values())) / 4
        # a full map lets all texts through
        monkeypatch.setattr(near_dedup, "MARKS", 1)
        assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in digests(df).collect()} == expected
    finally:
        spark.conf.set(name, old)
