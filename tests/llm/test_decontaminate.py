import hashlib
import random
import re

from curvelens.llm.decontaminate import digests, drop_contaminated


def split(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items, width):
    windows = {}
    for k, t in items:
        w = split(t)
        n = min(width, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = {}
    for k, t in docs.items():
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= x
        ids = ",".join(sorted(map(str, found - {None})))
        out[k] = (len(w), len(hit), len(found - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    return out


def fixture(r):
    word = lambda: r.choice(["The", "of", "été", "a1", "x", "thion", "And", "Ünd"])
    items = [(k, ", ".join(word() for _ in range(r.choice([0, 1, 2, 3, 9, 10, 11, 40])))) for k in range(3, 30)]
    items += [(7, items[0][1]), (None, "never seen words"), (50, None), (51, " ... ")]
    docs = {}
    for k in range(80):
        w = [word() for _ in range(r.randrange(500))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(w) + 1)
            w[at:at] = split(r.choice(items)[1]) if k % 2 else ["NEVER", "seen", "words"]
        docs[k] = r.choice([" ", "\n", "-"]).join(w)
    docs |= {100: None, 101: "", 102: "x " * 3000, 103: items[5][1]}
    return docs, items


def test_matches_brute_force(spark):
    for seed in range(3):
        docs, items = fixture(random.Random(seed))
        d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
        b = spark.createDataFrame(items, "item_id long, text string")
        want = brute(docs, items, 10)
        for size in (8 << 20, 700):  # one pass, several passes
            rows = digests(d, b, block_bytes=size).collect()
            assert {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in rows} == want
        left = {x.doc_id for x in drop_contaminated(d, b).collect()}
        assert left == {k for k, v in want.items() if not v[4]}


def test_empty_tables_repeats_and_clashing_columns(spark):
    text = "one two three four five six seven eight nine ten eleven"
    d = spark.createDataFrame([(1, text, 1), (1, text, 2), (None, text, 3), (2, None, 4)], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert sorted((x.doc_id or 0, x.n_hit) for x in digests(d, b).collect()) == [(0, 11), (1, 11), (1, 11), (2, 0)]
    assert drop_contaminated(d, b).collect() == [(2, None, 4)]
    assert digests(d.limit(0), b).count() == 0
    assert drop_contaminated(d, b.limit(0)).count() == 4
