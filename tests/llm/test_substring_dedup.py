import hashlib
import random
import re

from curvelens.llm.substring_dedup import digests, remove_repeats


def brute(rows, width):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in rows.items()}
    seen, gone = set(), {k: set() for k in rows}
    for k in sorted(rows):
        for s in range(len(words[k]) - width + 1):
            key = tuple(words[k][s : s + width])
            if key in seen:
                gone[k].update(range(s, s + width))
            seen.add(key)
    return {
        k: (len(w), len(gone[k]), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone[k]).encode()).hexdigest())
        for k, w in words.items()
    }


def fixture(seed):
    r = random.Random(seed)
    passage = [f"p{i}é" for i in range(60)]
    rows = {}
    for k in range(60):
        words = [r.choice("abcdefgh") + str(r.randrange(4)) for _ in range(r.randrange(120))]
        if k % 3 == 0:
            at = r.randrange(len(words) + 1)
            words[at:at] = passage[r.randrange(20) : 40 + r.randrange(20)]
        rows[k] = "\n".join(" ".join(words[i : i + 7]) for i in range(0, len(words), 7))
    rows[60] = rows[3]
    rows[61] = rows[3] + " tail " + rows[3]
    rows[62], rows[63], rows[64] = None, "", " \t\n"
    rows[65] = "x " * 5000
    return rows


def test_matches_brute_force(spark):
    for width, size in ((20, 12 << 20), (3, 500)):
        rows = fixture(width)
        df = spark.createDataFrame([(k, t) for k, t in rows.items()], "doc_id long, text string").repartition(5)
        got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in digests(df, width, range_bytes=size).collect()}
        assert got == brute(rows, width)


def test_rows_repeated_null_ids_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "a"), (1, text, "b"), (1, "other " + text, "c"), (None, text, None), (2, "short", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(3)
    got = sorted((x.doc_id or 99, x.n_words, x.n_removed) for x in digests(df).collect())
    # the two texts of doc 1 stay apart; the one with the smaller hash counts as the earlier
    assert got == [(1, 30, 30), (1, 30, 30), (1, 31, 0), (2, 1, 0), (99, 30, 30)]
    kept = remove_repeats(df)
    assert kept.columns == df.columns
    assert sorted((x.n_words or "", x.text) for x in kept.collect()) == [("", ""), ("a", ""), ("b", ""), ("c", "other " + text), ("d", "short")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert digests(df).count() == 0
    assert remove_repeats(df).count() == 0


def test_without_any_repeat(spark):
    rows = {1: " ".join(f"a{i}" for i in range(30)), 2: " ".join(f"b{i}" for i in range(40))}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for size in (4 << 20, 50):
        assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in digests(df, range_bytes=size).collect()} == brute(rows, 20)
    assert {x.doc_id: x.text for x in remove_repeats(df).collect()} == rows


def test_null_ids_with_equal_short_hashes(spark):
    # zero-padded numbers until two texts share Spark's 32-bit hash: both keep their own identity
    tail = " " + " ".join(f"w{i}" for i in range(25))
    found = spark.range(200_000).selectExpr("id", f"hash(concat('t', id, '{tail}')) h").groupBy("h").agg({"id": "collect_set"}).filter("size(`collect_set(id)`) > 1").first()
    a, b = sorted(found[1])[:2]
    df = spark.createDataFrame([(None, f"t{a}{tail}"), (None, f"t{b}{tail}")], "doc_id long, text string")
    assert sorted(x.n_removed for x in digests(df).collect()) == [0, 25]


def test_a_task_remembers_repeated_windows():
    import numpy as np
    import pyarrow as pa

    from curvelens.llm import substring_dedup as sd

    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"x{k} {passage} y{k}" for k in range(60)]
    ids = np.random.default_rng(0).permutation(60)
    batch = lambda n: pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.zeros(60, np.int64)), pa.array([texts[i] for i in ids])], ["id", "mark", "text"]).slice(0, n)
    old, sd.PIECE_BYTES = sd.PIECE_BYTES, 700
    try:
        for limit in (0, 1 << 16):
            packs = pa.Table.from_batches(list(sd._packs(iter([batch(60)]), 20, 2, limit)))
            sent = sum(len(x) // 7 for x in packs.column("hashes").to_pylist())
            groups = {}
            for row in packs.to_pylist():
                groups.setdefault(row["range"] if row["range"] >= 0 else -1 - row["range"], []).append(row)
            gone = set()
            for rows in groups.values():
                for data in sd._later(pa.Table.from_pylist(rows, sd._PACK), 1).column("places").to_pylist():
                    i, _, counts, starts = sd._from_places(data)
                    gone |= set(zip(np.repeat(i, counts).tolist(), starts.tolist()))
            assert gone == {(i, s) for i in range(1, 60) for s in range(1, 22)}
            if limit:
                assert sent < 0.6 * first  # 120 windows are unique
            first = sent
    finally:
        sd.PIECE_BYTES = old
