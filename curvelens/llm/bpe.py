"""Operator 1, byte-level BPE: encoding and decoding by a file of ranks.

A text is cut by the tokenizer's pattern; each match (a word here) is merged on its own: the
adjacent pair of pieces with the lowest rank, leftmost first, until no pair has a rank.

Plan. (1) `merged_ids` folds the merges with Spark's higher-order functions over the byte
array of a word; the ranks are a literal of maps, dealt by CRC-32 of the key so that a lookup
reads a few entries. A fold costs tens of microseconds, so it runs on distinct words. (2) Words
are counted over all documents; the HEAD most frequent, of LONGEST bytes at most, that occur
twice or more are folded once. That dictionary is bounded by these two numbers whatever the input
and is broadcast: 16 bytes a word for looking up, 5 and two an id for putting together (30 MB).
(3) One narrow pass cuts texts, looks words up, and names what is not in the dictionary; these
words, distinct within a piece of a few megabytes, are folded in the same stage by the same
expression, and a second pass puts the ids together. Texts and tokens are never shuffled, only
counted words are. Words are looked up by 64-bit hashes.

Decoding concatenates the binary pieces of the ids.

Defined results. A null or empty text has no ids and decodes to no bytes. Special tokens are
ordinary text. Rows are independent: repeats, null ids and other columns do no harm. A fold
takes time in the square of a word's bytes (a word is one match of the pattern).
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelens.llm import bytescan as scan
from curvelens.llm.common import in_small_batches, lean, named, opened, own, restored, share, stored, table, text_of, with_own

#: Entries and bytes that bound the broadcast dictionary of frequent words.
HEAD = 1 << 20
LONGEST = 48
#: Bytes of text whose words are counted together before they are sent on.
COUNT_BYTES = 8 << 20
_BUCKETS = 8192
_NO_RANK = (1 << 31) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


# --- merges as higher-order functions ---


def rank_literal(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """array<map<hex, rank>>, dealt by CRC-32: one constant value.

    It is the value of a scalar subquery over a local row, which execution puts in as a literal;
    a projection of its own names it, and the optimizer merges that with the one that folds.
    Written into the plan itself, 50,000 entries are printed with every description of every
    plan: 0.5 GB of event log for one query.
    """
    dealt: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
    for piece, rank in ranks.items():
        dealt[zlib.crc32(piece) % _BUCKETS][piece.hex().upper()] = rank
    return _constant(spark, dealt, "array<map<string,int>>")


def _constant(spark: SparkSession, value, kind: str) -> Column:
    row = spark.createDataFrame([(json.dumps(value, separators=(",", ":")),)], "value string")
    return row.select(F.from_json("value", kind).alias("value")).scalar()


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rank(maps: Column, piece: Column) -> Column:
    return F.coalesce(F.get(maps, F.pmod(F.crc32(piece), F.lit(_BUCKETS)).cast("int"))[F.hex(piece)], F.lit(_NO_RANK))


def _merge(maps: Column, state: Column) -> Column:
    """One merge: state has the pieces p and, at i, the rank r of the pair (i, i + 1)."""

    def at(k: Column) -> Column:  # place, from 1, of the pair's left piece
        joined = F.concat(state["p"][k - 1], state["p"][k])
        pieces = F.concat(F.slice(state["p"], F.lit(1), k - 1), F.array(joined), F.slice(state["p"], k + 2, F.size(state["p"])))

        def ranked(p: Column) -> Column:
            left = F.when(k > 1, F.array(_rank(maps, F.concat(p[k - 2], p[k - 1])))).otherwise(F.array().cast("array<int>"))
            right = F.when(k < F.size(p), _rank(maps, F.concat(p[k - 1], p[k]))).otherwise(F.lit(_NO_RANK))
            ranks = F.concat(F.slice(state["r"], F.lit(1), F.greatest(k - 2, F.lit(0))), left, F.array(right), F.slice(state["r"], k + 2, F.size(state["r"])))
            return F.struct(p.alias("p"), ranks.alias("r"))

        return _let(pieces, ranked)

    return _let(F.array_min(state["r"]), lambda low: F.when(low == _NO_RANK, state).otherwise(_let(F.array_position(state["r"], low).cast("int"), at)))


def merged_ids(word: Column, maps: Column) -> Column:
    """The ids of one word (binary, not empty)."""
    n = F.octet_length(word)
    split = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1)))

    def fold(p: Column) -> Column:
        ranks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < n - 1, _rank(maps, F.concat(p[i], p[i + 1]))).otherwise(F.lit(_NO_RANK)))
        done = F.aggregate(F.sequence(F.lit(1), n), F.struct(p.alias("p"), ranks.alias("r")), lambda state, _: _merge(maps, state))
        return F.transform(done["p"], lambda piece: _rank(maps, piece))

    return _let(_rank(maps, word), lambda whole: F.when(whole < _NO_RANK, F.array(whole)).otherwise(_let(split, fold)))


def ids_of(words: Column, maps: Column) -> Column:
    """array<binary> to array<array<int>>."""
    return _let(maps, lambda m: F.transform(words, lambda w: merged_ids(w, m)))


# --- the pattern, over bytes ---


def char_classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, by code point, as the tiktoken library sees them."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    classes = np.zeros(0x110000, np.uint8)
    for k, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\s")):
        tokens = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={}).encode_ordinary(every)
        classes[np.frombuffer(bytes(tokens).decode().encode("utf-32-le"), np.uint32)] = k
    return classes


def _byte_classes(buf: np.ndarray, classes: np.ndarray) -> np.ndarray:
    table_ = np.zeros(256, np.uint8)
    table_[:128] = classes[:128]
    out = table_[buf]
    high = np.flatnonzero(buf >= 0xC0)
    if len(high):
        padded = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.int32)
        b0, b1, b2, b3 = (padded[high + k] & m for k, m in ((0, 0xFF), (1, 0x3F), (2, 0x3F), (3, 0x3F)))
        three, four = b0 >= 0xE0, b0 >= 0xF0
        point = np.where(four, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3, np.where(three, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 31) << 6 | b1))
        c = classes[point]
        out[high] = out[high + 1] = c
        out[high[three] + 2] = c[three]
        out[high[four] + 3] = c[four]
    return out


def pattern_words(buf: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the matches of the GPT-2 pattern in each document, and offsets into those.

    A match is a run of letters, numbers or other characters with one blank before it if there
    is one; of white space before another character, the last one stands alone (or is that
    blank); an apostrophe that begins a match takes s, t, m, d, re, ve or ll with it.
    """
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _byte_classes(buf, classes)
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    after = np.zeros(n, bool)
    after[1:] = start[1:] & ~first[1:] & (kind[:-1] == 3)
    after = np.flatnonzero(after & (kind != 3))
    blank = after - 1
    for _ in range(3):
        blank = blank - ((buf[blank] & 0xC0) == 0x80)
    start[blank] = True
    start[after[buf[blank] == 0x20]] = False
    mark = np.flatnonzero((buf == 0x27) & start)
    if len(mark):
        stop = offsets[np.searchsorted(offsets, mark, "right")]
        padded = np.concatenate([buf, np.zeros(3, np.uint8)])
        a, b = padded[mark + 1], padded[mark + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8)) & (mark + 1 < stop)
        two = (((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)) & (mark + 2 < stop)
        taken = one | two
        mark, stop, end = mark[taken], stop[taken], (mark + 2 + two)[taken]
        start[mark + 1] = False
        start[end[end < stop]] = True
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets)


# --- the passes ---


def _count_words(classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = classes.value
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            buf = np.concatenate([x[2] for x in held])
            lengths = np.concatenate([x[3] for x in held])
            ends = np.cumsum(lengths)
            _, at, back = np.unique(h, return_index=True, return_inverse=True)
            data, offsets = scan.gather(buf, (ends - lengths)[at], ends[at])
            word = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
            return pa.RecordBatch.from_arrays([word, pa.array(np.bincount(back, n).astype(np.int64))], ["word", "n"])

        for batch in batches:
            for piece in scan.pieces(batch, "text"):
                buf, offsets = scan.text_bytes(piece.column(0))
                starts, ends, _ = pattern_words(buf, offsets, kinds)
                h = scan.span_hashes(buf, starts, ends)
                h, at, n = np.unique(h, return_index=True, return_counts=True)
                data, _ = scan.gather(buf, starts[at], ends[at])
                held.append((h, n, data, ends[at] - starts[at]))
                size += len(buf)
                if size >= COUNT_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return lean(run)


class Pieces:
    """The ids of the words of a dictionary, in the order of its index."""

    def __init__(self, ids: pa.Array, order: np.ndarray):
        flat, starts, counts = flat_lists(ids)
        counts = counts[order]
        self.ids = flat[scan.spread(starts[order], counts)]
        if not len(flat) or flat.max() < 1 << 16:
            self.ids = self.ids.astype(np.uint16)
        self.counts = counts.astype(np.uint8)  # a word has LONGEST bytes at most
        self.starts = (np.cumsum(counts) - counts).astype(np.int32)


def dictionary(words: pa.Array, ids: pa.Array) -> tuple[scan.HashIndex, Pieces]:
    """Places of words by their hashes, and the ids of each."""
    h = [np.zeros(0, np.uint64)]
    for a in range(0, len(words), 50_000):
        buf, offsets = scan.text_bytes(words.slice(a, 50_000))
        h.append(scan.span_hashes(buf, offsets[:-1], offsets[1:]))
    index = scan.HashIndex(np.concatenate(h))
    pieces = Pieces(ids, index.order)
    del index.order
    return index, pieces


def flat_lists(ids: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offsets = ids.offsets.to_numpy().astype(np.int64)
    return ids.values.to_numpy(zero_copy_only=False).astype(np.int32), offsets[:-1], np.diff(offsets).astype(np.int32)


def _look_up(classes, head, texts: bool):
    """Per row the codes of its words: a place in the dictionary, or -1 - place in the piece's other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, known = classes.value, opened(head)
        for batch in batches:
            for piece in scan.pieces(batch, "text"):
                buf, offsets = scan.text_bytes(piece.column("text"))
                starts, ends, docs = pattern_words(buf, offsets, kinds)
                h = scan.span_hashes(buf, starts, ends)
                code = known.find(h)
                new = np.flatnonzero(code < 0)
                _, at, back = np.unique(h[new], return_index=True, return_inverse=True)
                code[new] = -1 - back
                data, cuts = scan.gather(buf, starts[new[at]], ends[new[at]])
                raw = data.tobytes()
                other = [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                codes = pa.Array.from_buffers(pa.large_binary(), piece.num_rows, [None, pa.py_buffer((docs * 4).astype(np.int64)), pa.py_buffer(code.astype(np.int32))])
                columns = {"own": piece.column("own")} | ({"text": piece.column("text")} if texts else {})
                columns |= {"codes": codes.cast(pa.binary()), "other": pa.array([other] + [None] * (piece.num_rows - 1), pa.list_(pa.binary()))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return lean(run)


def _put_together(pieces, finish):
    """Batches with the ids of each row: finish(other columns, ids, offsets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(pieces)
        other = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32))
        for batch in batches:
            cuts = np.flatnonzero(batch.column("ids").is_valid().to_numpy(zero_copy_only=False)).tolist()
            for a, b in zip(sorted({0, *cuts}), [*sorted({0, *cuts})[1:], batch.num_rows], strict=True):
                piece = batch.slice(a, b - a)
                if a in cuts:
                    own = piece.column("ids").slice(0, 1).flatten()
                    other = flat_lists(own) if len(own) else other
                raw, offsets = scan.text_bytes(piece.column("codes"))
                code = np.frombuffer(raw.tobytes(), np.int32)
                here = code >= 0
                starts, counts = np.zeros(len(code), np.int64), np.zeros(len(code), np.int32)
                starts[here], counts[here] = known.starts[code[here]], known.counts[code[here]]
                starts[~here], counts[~here] = other[1][-1 - code[~here]], other[2][-1 - code[~here]]
                at, first = scan.spread(starts, counts), np.repeat(here, counts)
                ids = np.empty(len(at), np.int32)
                ids[first], ids[~first] = known.ids[at[first]], other[0][at[~first]]
                ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[offsets // 4]
                yield finish(piece, ids, ends)

    return lean(run)


def _shared(docs: DataFrame, text_col: str, ranks: dict[bytes, int], head_words: int):
    """Character classes and the dictionary of frequent words, as broadcasts; the rank literal."""
    context, maps = docs.sparkSession.sparkContext, rank_literal(docs.sparkSession, ranks)
    classes = context.broadcast(char_classes())
    texts = in_small_batches(docs).select(text_of(text_col))
    counted = stored(texts.mapInArrow(_count_words(classes), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1"), "words")
    short = counted.filter(F.octet_length("word").between(1, LONGEST))
    # As many words for each count, the frequent first, until HEAD is full: the counts are few numbers below a cut.
    tally = short.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect()
    least, total = 10_001, 0
    for row in tally:
        total += row["words"]
        if total > head_words:
            break
        least = row["n"]
    spread_out = max(docs.sparkSession.sparkContext.defaultParallelism * 2, 8)
    frequent = short.filter(F.col("n") >= least).select("word").repartition(spread_out)
    found = frequent.withColumn("maps", maps).select("word", F.get(ids_of(F.array("word"), F.col("maps")), F.lit(0)).alias("ids")).toArrow().combine_chunks()
    words = pa.concat_arrays(found.column("word").chunks) if found.num_rows else pa.array([], pa.binary())
    ids = pa.concat_arrays(found.column("ids").chunks) if found.num_rows else pa.array([], pa.list_(pa.int32()))
    index, pieces = dictionary(words, ids)
    return classes, share(docs.sparkSession, index), share(docs.sparkSession, pieces), maps


def _encoded(docs: DataFrame, text_col: str, ranks: dict[bytes, int], head_words: int, keep: list[str], texts: bool, finish, made: str) -> DataFrame:
    """own, the text if asked for, and what finish makes of each piece's ids."""
    classes, head, pieces, maps = _shared(docs, text_col, ranks, head_words)
    also = "text string, " if texts else ""
    rows = docs.select(own(keep), text_of(text_col))
    coded = rows.mapInArrow(_look_up(classes, head, texts), with_own(docs, keep, f"{also}codes binary, other array<binary>"))
    folded = coded.withColumn("maps", maps).select("own", *(["text"] if texts else []), "codes", F.when(F.col("other").isNotNull(), ids_of(F.col("other"), F.col("maps"))).alias("ids"))
    return folded.mapInArrow(_put_together(pieces, finish), with_own(docs, keep, f"{also}{made}"))


def encode(docs: DataFrame, ranks: dict[bytes, int], text_col: str = "text", ids_col: str = "token_ids", head_words: int = HEAD) -> DataFrame:
    """The table with the ids of each text added (replaced, if the column is there)."""
    keep = [c for c in docs.columns if c not in (ids_col, text_col)]

    def finish(piece: pa.RecordBatch, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
        return pa.RecordBatch.from_arrays([piece.column("own"), piece.column("text"), lists], ["own", "text", "token_ids"])

    out = _encoded(docs, text_col, ranks, head_words, keep, True, finish, "token_ids array<int>")
    columns = [c for c in docs.columns if c != ids_col]
    return out.select(*restored(docs, columns, **{text_col: F.col("text")}), F.col("token_ids").alias(ids_col))


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "token_ids", into: str = "decoded") -> DataFrame:
    """The table with the binary pieces of the ids, one after the other; an unknown id gives null."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()

    def joined(n: Column) -> Column:
        found = F.transform(F.col("ids"), lambda i: F.nullif(F.get(n, i), F.lit("")))
        return F.when(~F.exists(found, lambda x: x.isNull()), F.unhex(F.array_join(found, "")))

    keep = [c for c in df.columns if c != into]
    held = df.select(own(keep), named(ids_col).alias("ids")).withColumn("pieces", _constant(df.sparkSession, pieces, "array<string>"))
    return held.select(*restored(df, keep), _let(F.col("pieces"), joined).alias(into))


def digests(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (decimal ids, one blank between), decoded_sha256."""
    size = max(ranks.values()) + 1
    pieces = np.full(size, b"", object)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    shared = docs.sparkSession.sparkContext.broadcast((np.array([str(i) for i in range(size)], object), pieces))

    def finish(piece: pa.RecordBatch, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        names, binary = shared.value
        shown, decoded = [], []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            part = ids[a:b]
            shown.append(hashlib.sha256(" ".join(names[part].tolist()).encode()).hexdigest())
            decoded.append(hashlib.sha256(b"".join(binary[part].tolist())).hexdigest())
        return pa.RecordBatch.from_arrays([piece.column("own"), pa.array(np.diff(ends), pa.int64()), pa.array(shown, pa.string()), pa.array(decoded, pa.string())], ["own", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = _encoded(docs, text_col, ranks, head_words, [id_col], False, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select(F.col("own.c0").cast("long").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
