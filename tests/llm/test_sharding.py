import hashlib
import math
import zlib
from collections import Counter

from curvelens.llm.sharding import assign


def shard_of(key, weights):
    def score(i):
        u = (int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return weights[i] / -math.log(u)

    return max(range(len(weights)), key=lambda i: (score(i), -i))


def test_matches_brute_force_and_slots_are_gapless(spark):
    rows = [(k, "été" * (k % 9)) for k in range(3000)] + [(None, "x"), (None, None), (5, ""), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = assign(df, [1.0] * 7, grown_by=1.0).collect()
    assert len(got) == len(rows)
    by_shard = {}
    for x in got:
        key = "" if x.doc_id is None else x.doc_id
        assert x.shard == shard_of(key, [1.0] * 7)
        assert x.grown_shard == shard_of(key, [1.0] * 8) and x.grown_shard in (x.shard, 7)
        by_shard.setdefault(x.shard, []).append((x.slot, x.doc_id))
    for rows_ in by_shard.values():
        assert sorted(s for s, _ in rows_) == list(range(len(rows_)))
        ids = [k for _, k in sorted(rows_, key=lambda r: r[0]) if k is not None]
        assert ids == sorted(ids)
    sizes = {x.doc_id: (x.size, x.text_crc32) for x in got if x.doc_id and x.doc_id > 5}
    assert all(v == (16 + 5 * (k % 9), zlib.crc32(("été" * (k % 9)).encode())) for k, v in sizes.items())


def test_shares_follow_weights_and_edges(spark):
    df = spark.range(8000).selectExpr("id doc_id", "string(id) text", "1 shard", "2 size")
    n = Counter(x.shard for x in assign(df, [1.0, 2.0, 0.0, 1.0]).collect())
    assert n[2] == 0 and abs(n[1] - 4000) < 250 and abs(n[0] - 2000) < 250
    assert assign(df.limit(0), [1.0, 1.0]).count() == 0
    assert assign(df.limit(1), [1.0]).first().slot == 0
