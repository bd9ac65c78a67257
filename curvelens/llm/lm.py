"""Operator 2, language-model scores: a gated recurrent network with a class-factored softmax.

Text is lower-cased (A-Z only); tokens are words [^\\x20\\x09-\\x0D]+ and one end.

The model. A GRU of HIDDEN units reads a text from its first word to its last, each item as a vector of HIDDEN numbers; its state is
carried across windows, so the score is the log-likelihood of the complete text. The next
token is predicted in two steps, its class and its place in the class: items are dealt by
frequency into classes of WIDTH. Items are the end, the MODEL_WORDS most frequent words, and
`rare`; a rare word w has P(rare | context) * (c + 1) / (R + U), with c its count, R the count
of all rare tokens and U their number of kinds and one. Output biases begin at the log counts
of the whole corpus, so that training starts from the unigram model.

Plan. (1) Words of all training texts are counted, per piece, then in Spark. (2) The HEAD most
frequent words with their counts are broadcast (bounded); their counts, those of items and of
classes and all totals are of all training texts. (3) One Arrow pass turns every text into
numbers of items, which are stored (two bytes a token), with all of the result but the network's
part. (4) Weights are fitted on all training texts, each token being a target once an epoch:
texts are dealt by a hash of id and text to rounds and, in a round, to tasks of about
TASK_TOKENS; a task goes through its texts by truncated backpropagation (numpy, windows of
LANES x WINDOW tokens) from the weights of the round before; weights and second moments of a
round's tasks are averaged in Spark, by tokens, and the driver gets the average only. A corpus of
less than TASK_TOKENS is one task, and is read up to EPOCHS times if that takes less than STEPS
windows; a larger one is read once. (5) One Arrow pass over the stored numbers scores all texts,
those of a piece side by side, one step for all at a time. (6) Words that are not in the head go
through a join with the table of counts; they are few, and shuffled as (text, hash, times).

Words are told apart by 64-bit hashes.

Defined results. A null or empty text is one end. A null doc_id is not held out. Rows with one
doc_id and one text count as often as they occur in training and get the same scores. Without
training texts N and V are 0. Other columns of the table are not looked at.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelens.llm import bytescan as scan
from curvelens.llm.common import NULL_ID, identity, in_small_batches, lean, merged, named, opened, share, stored, table

HEAD = 1 << 19
MODEL_WORDS, WIDTH, HIDDEN = 4094, 64, 16
#: A corpus of one task is read again, at most EPOCHS times in all, until about STEPS windows were seen.
STEPS, EPOCHS = 700, 3
LANES, WINDOW = 384, 16
#: Windows of a pass at least, with fewer lanes where texts are few.
LEAST = 40
#: Training tokens of a task and of a round, about; rounds of a corpus of several tasks, least and most.
TASK_TOKENS, ROUND_TOKENS, ROUNDS = 1_000_000, 12_000_000, (4, 64)
#: Floats of weights and moments in a row, where they are averaged.
SLICE = 1 << 14
COUNT_BYTES = 12 << 20
#: Bytes of text that are numbered together, and of item numbers that are scored side by side (a long text is less of a tail then).
NUMBER_BYTES, SIDE_BYTES = 3 << 20, 6 << 20
#: Tokens whose outputs are computed at a time.
SIDE_ROWS = 1 << 15
END, RARE = 0, 1


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(named(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, offsets = scan.text_bytes(texts)
    buf = scan.lower_table()[buf]
    starts, ends, docs = scan.words(buf, offsets, scan.space_words())
    return scan.span_hashes(buf, starts, ends), docs


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = texts = 0

    def flush() -> pa.RecordBatch:
        h, back = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        n = np.bincount(back, np.concatenate([x[1] for x in held])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.append(h.view(np.int64), 0)), pa.array(np.append(n, 0)), pa.array(np.append(np.zeros(len(h), np.int64), texts))], ["word", "n", "texts"])

    for batch in batches:
        for piece in scan.pieces(batch, "text"):
            h, _ = _words(piece.column("text"))
            held.append(np.unique(h, return_counts=True))
            texts += piece.num_rows
            size += len(h) * 6
            if size >= COUNT_BYTES:
                yield flush()
                held, size, texts = [], 0, 0
    if held:
        yield flush()


def _with_one(h: np.ndarray) -> np.ndarray:
    """A last column of ones, which takes the biases: one product instead of two passes."""
    out = np.ones((len(h), h.shape[1] + 1), h.dtype)
    out[:, :-1] = h
    return out


def _row_sums(p: np.ndarray) -> np.ndarray:
    return p @ np.ones(p.shape[1], p.dtype)


class Network:
    """Weights of the GRU and of its two-step output; training and scoring."""

    def __init__(self, frequency: np.ndarray, hidden: int = HIDDEN, width: int = WIDTH, seed: int = 1):
        r, n = np.random.default_rng(seed), len(frequency)
        self.hidden, self.width = hidden, width
        order = np.argsort(-frequency, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.group, self.slot = place // width, place % width
        groups = -(-n // width)
        inside = np.full((groups, width), -1e9, np.float32)
        inside[self.group, self.slot] = np.log(frequency + 0.1)
        mass = np.log(np.exp(inside.astype(float)).sum(axis=1)).astype(np.float32)
        small = lambda *shape: r.normal(0, 0.1, shape).astype(np.float32)
        self.w = {"e": small(n, hidden) * 3, "x": small(hidden, 3 * hidden) * 3, "u": small(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32), "vc": small(groups, hidden) * 0.1, "bc": mass - mass.max(), "vw": small(groups, width, hidden) * 0.1, "bw": inside - inside.max(axis=1, keepdims=True)}

    def _outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Output weights of the classes and inside them, each with its bias last."""
        w = self.w
        return np.column_stack([w["vc"], w["bc"]]), np.concatenate([w["vw"], w["bw"][:, :, None]], axis=2)

    def _move(self, a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step from the states h: a is what the inputs give."""
        k = self.hidden
        c = h @ self.w["u"]
        zr = a[:, : 2 * k] + c[:, : 2 * k]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r, c = zr[:, :k], zr[:, k:], c[:, 2 * k :]
        new = r * c
        new += a[:, 2 * k :]
        np.tanh(new, out=new)
        after = h - new
        after *= z
        after += new
        return after, z, r, new, c

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        return self._move(self.w["e"][x] @ self.w["x"] + self.w["b"], h)

    def log_probability(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of P(y) after each state."""
        (classes, inside), group = self._outputs(), self.group[y]
        h = _with_one(h)
        logits = h @ classes.T
        out = logits[np.arange(len(y)), group]
        out -= np.log(_row_sums(np.exp(logits, out=logits)))
        order = np.argsort(group.astype(np.uint16), kind="stable")
        cuts = np.searchsorted(group[order], np.arange(len(classes) + 1))
        hs, slots = h[order], self.slot[y[order]]
        part, total = np.empty(len(y), out.dtype), np.empty(len(y), out.dtype)
        for g in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[g], cuts[g + 1])
            logits = hs[own] @ inside[g].T
            part[own] = logits[np.arange(len(logits)), slots[own]]
            total[own] = _row_sums(np.exp(logits, out=logits))
        out[order] += part - np.log(total)
        return out

    def _gradients(self, x: np.ndarray, y: np.ndarray, first: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of one window (steps x lanes), back to its first step; the state is carried on."""
        k, w = self.hidden, self.w
        steps, lanes = x.shape
        items = x.reshape(-1)
        inputs = w["e"][items]
        moved = (inputs @ w["x"] + w["b"]).reshape(steps, lanes, 3 * k)
        trace, states = [], []
        for t in range(steps):
            if first[t].any():
                h = np.where(first[t][:, None], 0, h)
            after, z, r, new, c = self._move(moved[t], h)
            trace.append((h, z, r, new, c))
            states.append(after)
            h = after
        hs, target = np.concatenate(states), y.reshape(-1)
        group, slot, n = self.group[target], self.slot[target], len(target)
        ones, (classes, inside) = _with_one(hs), self._outputs()
        p = ones @ classes.T
        np.exp(p, out=p)
        p *= (1 / (n * _row_sums(p)))[:, None]
        p[np.arange(n), group] -= 1 / n
        of_classes, of_words = p.T @ ones, np.zeros_like(inside)
        back = p @ w["vc"]
        order = np.argsort(group.astype(np.uint16), kind="stable")
        cuts = np.searchsorted(group[order], np.arange(len(classes) + 1))
        by_class, of_class = ones[order], np.empty_like(ones)
        chosen = slot[order]
        for j in np.flatnonzero(np.diff(cuts)).tolist():
            mine = slice(cuts[j], cuts[j + 1])
            rows, weights = by_class[mine], inside[j]
            q = rows @ weights.T
            np.exp(q, out=q)
            q *= (1 / (n * _row_sums(q)))[:, None]
            q[np.arange(len(q)), chosen[mine]] -= 1 / n
            np.matmul(q.T, rows, out=of_words[j])
            np.matmul(q, weights, out=of_class[mine])
        g = {"vc": of_classes[:, :k], "bc": of_classes[:, k], "vw": of_words[:, :, :k], "bw": of_words[:, :, k]}
        back[order] += of_class[:, :k]
        back = back.reshape(steps, lanes, k)
        carry, ut = np.zeros((lanes, k), hs.dtype), np.ascontiguousarray(w["u"].T)
        das, dcs = np.empty((steps, lanes, 3 * k), hs.dtype), np.empty((steps, lanes, 3 * k), hs.dtype)
        for t in range(steps - 1, -1, -1):
            before, z, r, new, c = trace[t]
            d = back[t] + carry
            da, dc = das[t], dcs[t]
            carry = d * z
            dn = (d - carry) * (1 - new * new)
            dz = (before - new) * carry
            dz *= 1 - z
            dr = dn * c
            dr *= r * (1 - r)
            da[:, :k], da[:, k : 2 * k], da[:, 2 * k :] = dz, dr, dn
            dc[:, : 2 * k] = da[:, : 2 * k]
            np.multiply(dn, r, out=dc[:, 2 * k :])
            carry += dc @ ut
            if first[t].any():
                carry[first[t]] = 0
        da = das.reshape(-1, 3 * k)
        g["b"], g["u"], g["x"], g["e"] = da.sum(axis=0), np.concatenate([m[0] for m in trace]).T @ dcs.reshape(-1, 3 * k), inputs.T @ da, np.zeros_like(w["e"])
        order = np.argsort(items, kind="stable")
        starts = np.flatnonzero(np.diff(items[order], prepend=-1))
        g["e"][items[order][starts]] = np.add.reduceat((da @ w["x"].T)[order], starts, axis=0)
        return g, h

    def pack(self) -> np.ndarray:
        """All weights as one vector; `unpack` sets them from such a vector, as views of it."""
        return np.concatenate([v.reshape(-1) for v in self.w.values()]).astype(np.float32)

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for name, v in self.w.items():
            self.w[name] = flat[at : at + v.size].reshape(v.shape)
            at += v.size

    def train(self, texts: list[np.ndarray], lanes: int = LANES, window: int = WINDOW, square: np.ndarray | None = None, done: int = 0, span: tuple[float, float] = (0.0, 1.0)) -> tuple[np.ndarray, int]:
        """One pass of truncated backpropagation (Adam) over texts of item numbers, each ended by END.

        Every token is a target once. `square` are the second moments so far, of `done` steps; `span` is the part
        of the whole training that the pass is. Gives the second moments and the steps.
        """
        flat = self.pack()
        self.unpack(flat)
        square = np.zeros_like(flat) if square is None else square.copy()
        stream = np.concatenate([[END], *texts]).astype(np.int64)
        size = len(stream) - 1
        if not size:
            return square, done
        lanes = max(1, min(lanes, size // (LEAST * window)))
        even = size // lanes * lanes
        x, y = stream[:even].reshape(lanes, -1).T, stream[1 : even + 1].reshape(lanes, -1).T
        cuts = [(x[a : a + window], y[a : a + window]) for a in range(0, len(x), window)]
        if even < size:  # what is left over follows the last lane
            cuts += [(stream[a : min(a + window, size), None], stream[a + 1 : min(a + window, size) + 1, None]) for a in range(even, size, window)]
        mean, moved = np.zeros_like(flat), np.empty_like(flat)
        h = np.zeros((lanes, self.hidden), np.float32)
        for own, (inputs, targets) in enumerate(cuts):
            h = h[-inputs.shape[1] :]
            grads, h = self._gradients(inputs, targets, inputs == END, h)
            g = np.concatenate([grads[name].reshape(-1) for name in self.w])
            g *= min(1.0, 1.0 / max(float(np.sqrt(np.dot(g, g))), 1e-9)) * targets.size / (lanes * window)
            done += 1
            at = span[0] + (span[1] - span[0]) * (own + 1) / len(cuts)
            rate = 0.01 * min(1.0, done / 20) * (1 - 0.9 * at) * np.sqrt(1 - 0.999**done) / (1 - 0.9 ** (own + 1))
            for a in range(0, len(flat), SLICE):
                b = slice(a, a + SLICE)
                v, m, q, out = g[b], mean[b], square[b], moved[b]
                np.multiply(v, v, out=out)
                out -= q
                out *= 0.001
                q += out
                v -= m
                v *= 0.1
                m += v
                np.sqrt(q, out=out)
                out += 1e-8
                np.divide(m, out, out=out)
                out *= rate
                flat[b] -= out
        return square, done

    def score(self, items: np.ndarray, offsets: np.ndarray, window: int = 4) -> np.ndarray:
        """log10 probability of each text of item numbers, END included, from an empty state."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = offsets[:-1][order], lengths[order]
        total, h = np.zeros(len(order)), np.zeros((len(order), self.hidden), np.float32)
        x = np.full(len(order), END)
        longest = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(longest), "left")
        a = 0
        while a < longest:
            states, targets, who = [], [], []
            to = min(a + max(window, SIDE_ROWS // int(active[a])), longest)
            for t in range(a, to):
                n = int(active[t])
                h[:n] = self.step(x[:n], h[:n])[0]
                y = items[starts[:n] + t]
                states.append(h[:n].copy())
                targets.append(y)
                who.append(np.arange(n))
                x = y
            p = self.log_probability(np.concatenate(states), np.concatenate(targets))
            total += np.bincount(np.concatenate(who), p.astype(float), len(total))
            a = to
        out = np.empty(len(order))
        out[order] = total / np.log(10)
        return out


class Model:
    """Counts of the head and of items, totals of the corpus, and the network."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tokens: int, kinds: int, texts: int):
        self.index = scan.HashIndex(hashes)
        self.counts = counts[self.index.order]
        self.tokens, self.kinds = tokens, kinds
        top = np.lexsort((self.index.keys, -self.counts))[:MODEL_WORDS]
        self.item = np.full(len(hashes) + 1, RARE, np.uint16)  # the last is for words that are not here
        self.item[top] = np.arange(len(top)) + 2
        items = float(self.counts[top].sum())
        words = tokens - texts
        self.rare_total = words - items + (kinds - bool(texts) - len(top)) + 1
        self.network = Network(np.concatenate([[texts], [max(words - items, 0)], self.counts[top]]).astype(float))
        self.texts = texts
        del self.index.order

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + self.kinds + 1))

    def items_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words' hashes and places in the head, text offsets; items with an END for each text, and offsets."""
        h, docs = _words(texts)
        place = self.index.find(h)
        ends = docs + np.arange(len(docs))
        items = np.full(int(ends[-1]), END, np.int64)
        items[scan.spread(ends[:-1], np.diff(docs))] = self.item[place]
        return h, place, docs, items, ends


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of the training texts, and the table (word, n) of all their words."""
    own = in_small_batches(docs).filter(~held_out(id_col)).select(F.xxhash64(named(id_col).cast("string"), F.lit(2)).alias("hash"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    counted = own.select("text").mapInArrow(lean(_count), "word long, n long, texts long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    counted = stored(counted, "words")
    words = counted.filter("n > 0")
    sums = counted.agg(F.sum("n"), F.sum("texts"), F.count_if(F.col("n") > 0)).first()
    n, texts, kinds = (int(x or 0) for x in sums)
    least, total = 10_001, 0
    for row in words.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect():
        total += row["words"]
        if total > HEAD:
            break
        least = row["n"]
    head = words.filter(F.col("n") >= least).select("word", "n").toArrow()
    model = Model(head.column("word").to_numpy().astype(np.int64).view(np.uint64), head.column("n").to_numpy().astype(np.int64), n + texts, kinds + bool(texts), texts)
    return model, words.select("word", "n")


def learn(rows: DataFrame, model: Model) -> None:
    """Fits the network's weights on all rows (hash, items): items of whole training texts, as bytes."""
    network, tokens = model.network, model.tokens
    rounds = 1 if tokens <= TASK_TOKENS else max(ROUNDS[0], min(ROUNDS[1], -(-tokens // ROUND_TOKENS)))
    tasks = max(1, -(-tokens // (rounds * TASK_TOKENS)))
    epochs = max(1, min(EPOCHS, STEPS * LANES * WINDOW // max(tokens, 1))) if rounds == 1 else 1
    size = len(network.pack())
    square, done, model.seen = np.zeros(size, np.float32), 0, 0
    average = "slice int, tokens long, steps long, data binary"
    for r in range(rounds):
        shared = share(rows.sparkSession, (network, square, done))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, r=r) -> Iterator[pa.RecordBatch]:
            net, moments, steps = opened(shared)
            net, moments = copy.copy(net), moments.copy()
            net.w = dict(net.w)
            seen, held, held_tokens, left = 0, [], 0, True
            while left:
                batch = next(batches, None)
                left = batch is not None
                if left:
                    held += [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column("items")]
                    held_tokens = sum(len(x) for x in held)
                if held and (held_tokens >= 2 * TASK_TOKENS or not left):
                    for e in range(epochs):
                        moments, steps = net.train(held, square=moments, done=steps, span=((r + e / epochs) / rounds, (r + (e + 1) / epochs) / rounds))
                    seen, held, held_tokens = seen + held_tokens * epochs, [], 0
            if seen:
                both = np.concatenate([net.pack(), moments])
                cuts = range(0, len(both), SLICE)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts)), pa.int32()), pa.array([seen] * len(cuts), pa.int64()), pa.array([steps] * len(cuts), pa.int64()), pa.array([both[a : a + SLICE].tobytes() for a in cuts], pa.binary())], ["slice", "tokens", "steps", "data"])

        def averaged(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, tokens, steps, key = 0.0, 0, 0, 0
            for batch in group:
                for k, n, s, data in zip(*(batch.column(c).to_pylist() for c in ("slice", "tokens", "steps", "data")), strict=True):
                    total, tokens, steps, key = total + np.frombuffer(data, np.float32).astype(float) * n, tokens + n, max(steps, s), k
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([tokens]), pa.array([steps]), pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary())], ["slice", "tokens", "steps", "data"])

        own = rows.filter(F.pmod("hash", F.lit(rounds)) == r) if rounds > 1 else rows
        dealt = own.repartitionById(tasks, F.pmod(F.shiftrightunsigned("hash", 20), F.lit(tasks)).cast("int")).sortWithinPartitions("hash", "items").select("items")
        parts = dealt.mapInArrow(lean(run), average)
        if tasks > 1:
            parts = parts.groupBy("slice").applyInArrow(averaged, average)
        found = sorted(parts.collect(), key=lambda x: x["slice"])
        if found:
            both = np.frombuffer(b"".join(bytes(x["data"]) for x in found), np.float32).copy()
            network.unpack(both[:size])
            square, done, model.seen = both[size:], max(x["steps"] for x in found), model.seen + found[0]["tokens"]
        shared.destroy()


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    model, words = fit(docs, id_col, text_col)
    shared = share(docs.sparkSession, model)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(shared)
        for batch in batches:
            for piece in scan.pieces(batch, "text", NUMBER_BYTES):
                h, place, per, items, ends = m.items_of(piece.column("text"))
                n = piece.num_rows
                doc = np.repeat(np.arange(n), np.diff(per))
                known = place >= 0
                count = np.append(m.counts, 0)[place]
                base = np.bincount(doc, np.where(known, m.base(count), 0), n) + m.base(np.array([m.texts]))[0]
                rare = known & (m.item[place] == RARE)
                score = np.bincount(doc[rare], np.log10((count[rare] + 1) / m.rare_total), n).astype(float)
                other = np.flatnonzero(~known)
                pairs = np.lexsort((h[other], doc[other]))
                d, x = doc[other][pairs], h[other][pairs]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(d)))
                cuts = np.searchsorted(d[first], np.arange(n + 1)).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(x[first].view(np.int64)), pa.array(times.astype(np.int64))], ["word", "times"]))
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("mark"), piece.column("hash"), piece.column("held_out"), pa.array(np.diff(ends), pa.int64()), pa.array(np.bincount(doc, known, n).astype(np.int64) + (m.texts > 0)), pa.array(base), pa.array(score), rest, pa.array([items[a:b].astype(np.uint16).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["id", "mark", "hash", "held_out", "n_tokens", "n_known", "base", "score", "rest", "items"])

    text = named(text_col).cast("string")
    rows = docs.select(identity(id_col).alias("id"), F.xxhash64(text).alias("mark"), F.xxhash64(named(id_col).cast("string"), text, F.lit(2)).alias("hash"), held_out(id_col).alias("held_out"), text.alias("text"))
    numbers = stored(rows.mapInArrow(lean(numbered), "id long, mark long, hash long, held_out boolean, n_tokens long, n_known long, base double, score double, rest array<struct<word long, times long>>, items binary"), "scored")
    learn(numbers.filter(~F.col("held_out")).select("hash", "items"), model)
    network = share(docs.sparkSession, model.network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            texts = [np.frombuffer(x.as_buffer(), np.uint16) for b in held for x in b.column("items")]
            found = opened(network).score(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
            at = 0
            for b in held:
                columns = {c: b.column(c) for c in b.schema.names if c != "items"}
                columns["score"] = pa.array(b.column("score").to_numpy() + found[at : at + b.num_rows])
                at += b.num_rows
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        for batch in batches:
            for piece in scan.pieces(batch, "items", SIDE_BYTES):
                held.append(piece)
                size += scan.text_bytes(piece.column("items"))[1][-1]
                if size >= SIDE_BYTES:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    scored = numbers.drop("hash", "rest").mapInArrow(lean(run), "id long, mark long, held_out boolean, n_tokens long, n_known long, base double, score double")
    rest = numbers.select("id", "mark", F.explode("rest").alias("r")).select("id", "mark", "r.word", "r.times").distinct()
    c = F.coalesce(F.col("n"), F.lit(0)) + 1
    more = merged(rest, words, "word", "left").groupBy("id", "mark").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * F.log10(c / F.lit(float(model.tokens + model.kinds + 1)))).alias("base"), F.sum(F.col("times") * F.log10(c / F.lit(float(model.rare_total)))).alias("score"),
    )
    more = more.select("id", "mark", "known", F.col("base").alias("more_base"), F.col("score").alias("more_score"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return merged(scored, more, ["id", "mark"], "left").select(
        F.when(F.col("id") < NULL_ID, F.col("id")).alias("doc_id"), "held_out", "n_tokens", (F.col("n_known") + zero("known")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base")).alias("base_score"), (F.col("score") + zero("more_score")).alias("score"),
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
