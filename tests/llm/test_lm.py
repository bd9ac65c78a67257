import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from curvelens.llm import lm
from curvelens.llm.lm import Network, op2_lm_score, scores


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_network_gradients_and_probabilities():
    net = Network(np.array([5.0, 2, 9, 4, 1, 1, 3]), hidden=3, width=3)
    h = np.random.default_rng(0).normal(size=(4, 3)).astype(np.float32)
    p = sum(np.exp(net.log_probability(h, np.full(4, y))) for y in range(7))
    assert np.allclose(p, 1, atol=1e-4)
    x, y = np.array([[0, 3], [2, 0], [5, 1]]), np.array([[2, 0], [5, 1], [6, 2]])
    first = x == lm.END
    start = np.random.default_rng(1).normal(size=(2, 3)).astype(np.float32)

    def loss():
        h, total = start, 0.0
        for t in range(3):
            h = net.step(x[t], np.where(first[t][:, None], 0, h))[0]
            total -= net.log_probability(h.astype(np.float32), y[t]).sum()
        return total / 6

    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    g, _ = net._gradients(x, y, first, start)
    for name in ("x", "u", "b", "vc", "bc"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        old, eps = net.w[name][at], 1e-4
        net.w[name][at] = old + eps
        up = loss()
        net.w[name][at] = old - eps
        down = loss()
        net.w[name][at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 0.02 * abs(g[name][at]) + 1e-4


@pytest.mark.parametrize("head", [1 << 20, 40])
def test_counts_and_base_match_brute_force(spark, sf_dir, head, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "STEPS", 20)
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    out = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    c, ends = Counter(w for k, t in texts.items() if not out[k] for w in split(t)), sum(not x for x in out.values())
    n, v = sum(c.values()) + ends, len(c) + 1
    got = {x.doc_id: x for x in op2_lm_score(spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        words = split(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
        assert (got[k].held_out, got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (out[k], len(words) + 1, sum(w in c for w in words) + 1, n)
        assert abs(got[k].base_score - base) < 1e-6 * max(1, abs(base))
        assert got[k].score < 0


def test_repeats_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "A b", 0), (1, "A b", 0), (None, "a c", 0), (2, None, 0), (3, "", 0)], "doc_id long, text string, score int")
    got = scores(df).collect()
    assert len(got) == 5 and {x.n_tokens for x in got if x.doc_id in (2, 3)} == {1}
    assert len({(x.base_score, x.score) for x in got if x.doc_id == 1}) == 1
    assert scores(df.limit(0)).count() == 0
    assert [x.train_tokens for x in scores(df.filter("doc_id = 99").union(spark.createDataFrame([(11, "x", 0)], df.schema))).collect()][0] in (0, 2)


def test_training_reads_every_token_once():
    r = np.random.default_rng(2)
    texts = [np.append(r.integers(2, 7, r.integers(0, 90)), lm.END) for _ in range(61)]
    net, seen = Network(np.ones(7), hidden=3, width=3), []
    inner = net._gradients
    net._gradients = lambda x, y, first, h: (seen.extend(zip(x.ravel().tolist(), y.ravel().tolist(), strict=True)), inner(x, y, first, h))[1]
    net.train(texts, lanes=7, window=16)
    stream = np.concatenate([[lm.END], *texts])
    assert Counter(seen) == Counter(zip(stream[:-1].tolist(), stream[1:].tolist(), strict=True))


def test_all_texts_are_trained_on_in_rounds_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(lm, "TASK_TOKENS", 8000)
    models, inner = [], lm.learn
    monkeypatch.setattr(lm, "learn", lambda rows, model: (inner(rows, model), models.append(model)))
    rows = [(k, " ".join(f"{a} {a}next" for a in np.random.default_rng(k).choice(list("abcdefgh"), 6))) for k in range(5000)]
    got = scores(spark.createDataFrame(rows, "doc_id long, text string")).agg({"score": "sum", "base_score": "sum"}).first()
    assert models[0].seen == models[0].tokens
    assert got["sum(score)"] > 0.9 * got["sum(base_score)"]


def test_score_is_the_stepwise_log_likelihood(spark, monkeypatch):
    monkeypatch.setattr(lm, "MODEL_WORDS", 9)
    models, inner = [], lm.learn
    monkeypatch.setattr(lm, "learn", lambda rows, model: (inner(rows, model), models.append(model)))
    r = np.random.default_rng(5)
    texts = {k: " ".join(f"w{min(int(x), 40)}" for x in r.geometric(0.1, r.integers(0, 60))) for k in range(120)} | {200: None, 201: "never Seen w1 never", 202: "W2 " * 300}
    got = {x.doc_id: x.score for x in scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    train = [w for k, t in texts.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in split(t)]
    c, net = Counter(train), models[0].network
    w, width = net.w, net.width
    keys = {word: int(lm._words(lm.pa.array([word]))[0][0]) for word in c}
    top = {word: i + 2 for i, word in enumerate(sorted(c, key=lambda x: (-c[x], keys[x]))[:9])}
    rare = {x: n for x, n in c.items() if x not in top}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for k, text in texts.items():
        h, x, total = np.zeros(net.hidden), lm.END, 0.0
        for word in [*split(text), None]:
            a, u, n = w["e"][x] @ w["x"] + w["b"], h @ w["u"], net.hidden
            z, reset = sigmoid(a[:n] + u[:n]), sigmoid(a[n : 2 * n] + u[n : 2 * n])
            h = z * h + (1 - z) * np.tanh(a[2 * n :] + reset * u[2 * n :])
            x = lm.END if word is None else top.get(word, lm.RARE)
            group, slot = divmod(sorted(range(len(net.group)), key=lambda i: (net.group[i], net.slot[i])).index(x), width)
            classes, inside = np.exp(w["vc"] @ h + w["bc"]), np.exp(w["vw"][group] @ h + w["bw"][group])
            total += math.log10(classes[group] / classes.sum() * inside[slot] / inside.sum())
            if x == lm.RARE:
                total += math.log10((c.get(word, 0) + 1) / (sum(rare.values()) + len(rare) + 1))
        assert abs(total - got[k]) < 1e-4 * max(1, abs(total)), k
