import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from curvelens.llm import bpe

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
TOKENIZER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CHARS = "aBs tmdrevl'\"!. \t\n\r09é ñß中٣½🙂́ 　<|>" + "   '"


def texts(seed, n=150):
    r = random.Random(seed)
    out = ["".join(r.choice(CHARS) for _ in range(r.randrange(40))) for _ in range(n)]
    return [*out, "I'll say 'tis we've don't'd  x", "<|endoftext|>", "", None, "  ", "a" * 300, " \n  b", "Straße " * 50]


@pytest.fixture(scope="module")
def classes():
    return bpe.char_classes()


def test_pattern_matches_tiktoken(classes):
    for seed in range(20):
        rows = [t or "" for t in texts(seed)]
        raw = [t.encode() for t in rows]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        buf = np.frombuffer(b"".join(raw), np.uint8)
        starts, ends, docs = bpe.pattern_words(buf, offsets, classes)
        one = tiktoken.Encoding("one", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
        for k, t in enumerate(rows):
            got = [bytes(buf[a:b]) for a, b in zip(starts[docs[k] : docs[k + 1]], ends[docs[k] : docs[k + 1]])]
            assert b"".join(got) == raw[k]
            assert [i for w in got for i in one._encode_single_piece(w)] == one.encode_ordinary(t), t


def test_digests_match_tiktoken(spark):
    rows = dict(enumerate(texts(99)))
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    for head in (bpe.HEAD, 20):  # all words in the dictionary, hardly any
        got = {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in bpe.digests(df, RANKS, head_words=head).collect()}
        for k, t in rows.items():
            ids = TOKENIZER.encode_ordinary(t or "")
            assert got[k] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_encode_then_decode_keeps_columns(spark):
    df = spark.createDataFrame([(1, "Ünder the sea's", "x"), (1, None, None), (None, "", "y")], "doc_id long, text string, n_tokens string")
    out = bpe.encode(df, RANKS)
    assert out.columns == [*df.columns, "token_ids"]
    back = bpe.decode(out, RANKS, into="back").collect()
    assert {(x["text"] or "", bytes(x["back"]).decode()) for x in back} == {("Ünder the sea's",) * 2, ("", "")}
    assert sorted(map(tuple, (x["token_ids"] for x in back))) == sorted([(), (), tuple(TOKENIZER.encode_ordinary("Ünder the sea's"))])
    assert bpe.digests(df.limit(0), RANKS).count() == 0
