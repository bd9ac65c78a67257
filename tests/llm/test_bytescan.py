import random
import tracemalloc

import numpy as np

from curvelens.llm import bytescan as scan

M = 1 << 64


def plain(word: bytes) -> int:
    """The hash of one word by its definition."""
    h = (sum((c + 1) * pow(scan._BASE, i, M) for i, c in enumerate(word)) + len(word) * 0xA24BAED4963EE407) % M
    return int(scan.mixed(np.array([h], np.uint64))[0])


def test_hashes_are_the_same_wherever_a_word_stands():
    rng = random.Random(3)
    some = ["".join(rng.choices("abcdé", k=rng.randint(1, 9))).encode() for _ in range(50)]
    text = [rng.choice(some) for _ in range(40_000)]
    buf = np.frombuffer(b" ".join(text), np.uint8)
    assert len(buf) > 3 * scan._BLOCK
    starts, ends, docs = scan.words(buf, np.array([0, len(buf)]), scan.space_words())
    hashes = scan.span_hashes(buf, starts, ends)
    of = {w: plain(w) for w in some}
    assert hashes.tolist() == [of[w] for w in text]

    at, h, per = scan.window_hashes(hashes, docs, 3)
    assert at.tolist() == list(range(len(text) - 2)) and per.tolist() == [0, len(text) - 2]
    seen = {}
    for i, x in enumerate(h.tolist()):
        assert seen.setdefault(tuple(text[i : i + 3]), x) == x
    assert len(set(seen.values())) == len(seen)


def test_hashing_a_long_text_holds_little_besides_its_sums():
    buf = np.full(8 << 20, 0x61, np.uint8)
    buf[1000::1000] = 0x20
    starts, ends, _ = scan.words(buf, np.array([0, len(buf)]), scan.space_words())
    tracemalloc.start()
    try:
        scan.span_hashes(buf, starts, ends)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 10 * len(buf)  # eight bytes of sums each; tables of powers and products took 40
