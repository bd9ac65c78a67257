import random
import re

from curvelens.llm.licences import DICE, TEMPLATES, marks_of, op5_licence_scan, scan, whole_scan


def grams(text):
    w = re.findall("[a-z0-9]+", text.lower())
    return {*zip(w, w[1:], strict=False)}


def brute(text):
    own = []
    lines, parts = re.split("\r?\n", text or ""), re.split("\r?\n[ \t]*\r?\n", text or "")
    pieces = [text or "", *(lines if len(lines) > 1 else []), *(parts if len(parts) > 1 else [])]
    for k, piece in enumerate(pieces):
        a = grams(piece)
        scores = [(2 * len(a & grams(t)) / (len(a) + len(grams(t))), -i, n) for i, (n, t) in enumerate(TEMPLATES) if a]
        if scores and max(scores)[0] >= DICE:
            own.append((max(scores)[0], -k, max(scores)[2]))
    return (max(own)[2], round(max(own)[0], 6), len(own), ",".join(sorted({x[2] for x in own}))) if own else (None, 0.0, 0, "")


def test_matches_brute_force(spark):
    r = random.Random(1)
    rows = {0: None, 1: "", 2: "of the\n\n" + TEMPLATES[0][1].upper(), 3: "a\r\nReleased under the MIT License!\r\nb", 4: "Licensed under CC BY-NC 4.0.", 5: "x " * 3000, 6: "the the the the the"}
    for k in range(10, 80):
        words = r.choice(TEMPLATES)[1].split()
        for _ in range(r.randrange(6)):
            words[r.randrange(len(words))] = r.choice(["of", "the", "zzz"])
        sep = r.choice(["\n", "\n\n", " "])
        rows[k] = f"some prose of the author{sep}{' '.join(words)}{sep}and more of it"
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").withColumn("score", df_lit())
    got = {x.doc_id: (x.licence, x.score, x.n_matches, x.licences) for x in scan(df).collect()}
    assert got == {k: brute(t) for k, t in rows.items()}


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_repeats_null_ids_and_empty(spark):
    t = "Released under the MIT License."
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, "no")], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.licence or "", x.n_matches) for x in scan(df).collect()) == [(0, "MIT", 1), (1, "MIT", 1), (1, "MIT", 1), (2, "", 0)]
    assert scan(df.limit(0)).count() == 0


def test_plan_is_native(spark, sf_dir):
    plan = op5_licence_scan(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_licences_inside_longer_texts(spark):
    notice = {n: t for n, t in TEMPLATES if n in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0")}
    disclaimer = "This software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed. In no event shall the copyright holder be liable for any direct, indirect or incidental damages. " * 3
    header = lambda t: "/*\n" + "".join(f" * {' '.join(t.split()[i : i + 9])}\n" for i in range(0, len(t.split()), 9)) + " */\nint main() { return 0; }\n" * 40
    rows = {
        1: f"Copyright 2020 A. Person\n{notice['BSD-3-Clause']} {disclaimer}", 2: f"Copyright 2020 A. Person\n{notice['BSD-2-Clause']} {disclaimer}",
        3: header(notice["MIT"]), 4: header(notice["GPL-3.0"] + " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."),
        5: "The parser of this small project is licensed under the MIT License, as are its tests and most of the files.",
        6: "Released under the MIT License.\n" + header(notice["GPL-3.0"]), 7: "of the work and the use of this and of the License " * 50, 8: None,
    }
    got = {x.doc_id: (x.licence, x.licences, x.n_matches) for x in whole_scan(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    one = lambda n: (n, n, 1)
    assert got == {1: one("BSD-3-Clause"), 2: one("BSD-2-Clause"), 3: one("MIT"), 4: one("GPL-3.0"), 5: one("MIT"), 6: ("MIT", "GPL-3.0,MIT", 2), 7: (None, "", 0), 8: (None, "", 0)}


def test_same_as_segments_where_licences_stand_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(map(str, op5_licence_scan(spark, sf_dir).collect())) == sorted(map(str, scan(docs).collect()))


def test_no_text_without_a_mark_reaches_the_bound():
    marks, r = marks_of(TEMPLATES, DICE), random.Random(4)
    assert marks
    has = lambda text: any(m in text if len(m) > 2 else re.search(f"(?<![a-z0-9]){m}(?![a-z0-9])", text) for m in marks)
    for _, t in TEMPLATES:
        words = re.findall("[a-z0-9]+", t.lower())
        for _ in range(200):
            a, b = sorted(r.sample(range(len(words) + 1), 2))
            own = [w for w in words[a:b] if r.random() < 0.95]
            if 2 * len(grams(" ".join(own)) & grams(t)) >= DICE * (len(grams(" ".join(own))) + len(grams(t))):
                assert has(" ".join(own)), own
    assert marks_of([("X", "a 1 of 2")], DICE) == []
