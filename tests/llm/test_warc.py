import random

import pytest
from pyspark.sql import functions as F

from curvelens.llm.warc import PERMITTED, canonical_url, resolve

SCHEMA = "record_id long, url string, at long, revisit boolean, headers map<string,string>, digest string, length long, extra int"


def brute(records):
    out = {}
    for r in records:
        if not r[3]:
            continue
        earlier = [x for x in records if not x[3] and x[1] == r[1] and x[2] is not None and r[2] is not None and x[2] < r[2]]
        sent = {k.lower(): v for k, v in (r[4] or {}).items()}
        if not earlier:
            out[r[0]] = (None, "missing", None, None)
            continue
        o = max(earlier, key=lambda x: (x[2], x[0]))
        stored = {k.lower(): v for k, v in (o[4] or {}).items()}
        strip = lambda e: e.removeprefix("W/")
        if "etag" in sent and "etag" in stored:
            verdict = "resolved" if strip(sent["etag"]) == strip(stored["etag"]) else "changed"
        elif "last-modified" in sent and "last-modified" in stored:
            verdict = "resolved" if sent["last-modified"] == stored["last-modified"] else "changed"
        else:
            verdict = "unchecked"
        merged = stored | {k: v for k, v in sent.items() if k in PERMITTED}
        held = verdict in ("resolved", "unchecked")
        out[r[0]] = (o[0], verdict, merged if held else None, o[5] if held else None)
    return out


def test_matches_brute_force(spark):
    r = random.Random(3)
    records = []
    for k in range(4000):
        url = "hot.example/x" if k % 3 == 0 else f"h{r.randrange(40)}.example/{r.randrange(5)}"
        headers = {h: str(r.randrange(3)) for h in ("ETag", "Last-Modified", "Date", "Vary", "X-Own") if r.random() < 0.6}
        if "ETag" in headers and r.random() < 0.3:
            headers["ETag"] = "W/" + headers["ETag"]
        at = None if r.random() < 0.01 else r.randrange(1500)
        records.append((k, url, at, r.random() < 0.6, headers if k % 50 else None, f"d{k}", k, 1))
    df = spark.createDataFrame(records, SCHEMA).repartition(5)
    got = {x.record_id: (x.original_id, x.verdict, x.headers, x.digest) for x in resolve(df, block_rows=100).collect()}
    assert got == brute(records)
    assert resolve(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("HTTP://WWW.Ex.com:80/a/?utm_source=x&b=1#top", "ex.com/a?b=1"),
        ("https://ex.com/a/index.html", "ex.com/a"),
        ("https://ex.com", "ex.com"),
        ("https://ex.com/?ref=x&page=2", "ex.com?page=2"),
        ("", ""),
        ("ex.com/?xref=1", "ex.com?xref=1"),
        ("ex.com/?href=b&q=1&ref=2", "ex.com?href=b&q=1"),
        ("ex.com/?ref=2&q=1", "ex.com?q=1"),
    ],
)
def test_canonical_url(spark, url, key):
    assert spark.createDataFrame([(url,)], "url string").select(canonical_url(F.col("url"))).first()[0] == key


def test_null_urls_and_repeated_rows(spark):
    rows = [(1, None, 1, False, {"etag": "a"}, "d", 3, 0), (2, None, 2, True, {"etag": "a"}, None, None, 0), (3, "", 1, False, {}, "e", 3, 0), (4, "", 2, True, {}, None, None, 0), (4, "", 2, True, {}, None, None, 0)]
    got = sorted((x.record_id, x.url_key, x.original_id, x.verdict) for x in resolve(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(2, None, None, "missing"), (4, "", 3, "unchecked"), (4, "", 3, "unchecked")]
