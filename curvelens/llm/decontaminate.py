"""Operator 7, benchmark decontamination: Wu-Manber search for windows of benchmark words.

Text is lower-cased (A-Z only); words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. A window is
10 consecutive words of an item; an item of fewer words, but not none, is one window. A word
of a document inside any occurrence of a window is hit.

Plan. One narrow pass over the documents: no shuffle, no join. Windows of one length are a
Wu-Manber set over words: a block is two words (one, for windows of one word). A cursor
stands on the last word of a possible occurrence; the shift table, indexed by a hash of the
block there, says how far it can move, and only where that is 0 does the bucket of the
block's hash name the windows to test. A test looks at the first block, then compares the
words themselves. Documents are cut into stretches of cursor positions, and the cursors of
all stretches of a piece move together as one numpy array.

The items go to the executors in blocks of BLOCK_BYTES of text: their size is measured. A larger
benchmark is split by item over several passes. Each searches the texts for one block and writes the
documents with hits, by id and a hash of the text, before the next block is read, so one block is
in memory at a time; texts are read again but never written, and only hits are shuffled.

Defined results. Null and empty texts have no words; an item without words has no window; a
null item_id hits words but isn't listed. Repeated items count once, repeated documents each
get their result. Other columns, whatever their names, do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from curvelens.llm import bytescan as scan
from curvelens.llm.common import in_small_batches, lean, merged, named, restored, stored, table, text_of, text_size

WINDOW = 10
#: Bytes of item text that one pass searches for.
BLOCK_BYTES = 8 << 20
#: Cursor positions of one stretch.
STRETCH = 192
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def _normal(text: str | None) -> list[bytes]:
    buf = scan.lower_table()[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = scan.words(buf, np.array([0, len(buf)]), scan.plain_words())
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _block_hash(word_hashes: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
    return scan.mixed(word_hashes[at] * _MIX + (word_hashes[at - 1] if block == 2 else np.uint64(0)))


class WindowSet:
    """Windows of one length: shift table, buckets by the hash of the last block, words."""

    def __init__(self, windows: dict[bytes, set], length: int):
        self.length, self.block = length, min(2, length)
        self.texts = list(windows)
        self.items = [windows[t] for t in self.texts]
        joined = b" ".join(self.texts)
        buf = np.frombuffer(joined, np.uint8)
        starts, ends, _ = scan.words(buf, np.array([0, len(buf)]), scan.plain_words())
        h = scan.span_hashes(buf, starts, ends).reshape(len(self.texts), length)
        flat, row = h.reshape(-1), np.arange(len(self.texts)) * length
        bits = max(10, min(22, int(8 * len(self.texts) * length).bit_length()))
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, length - self.block + 1, np.int64)
        for end in range(self.block - 1, length):
            slot = (_block_hash(flat, row + end, self.block) & self.mask).astype(np.int64)
            np.minimum.at(self.shift, slot, length - 1 - end)
        last = _block_hash(flat, row + length - 1, self.block)
        self.order = np.argsort(last, kind="stable")
        self.last = last[self.order]
        self.first = _block_hash(flat, row + self.block - 1, self.block)[self.order]

    def occurrences(self, hashes: np.ndarray, docs: np.ndarray, same: "callable") -> tuple[np.ndarray, np.ndarray]:
        """Last words and windows of all occurrences; same(last, window) compares words."""
        spans = np.maximum(np.diff(docs) - self.length + 1, 0)
        stretches = -(-spans // STRETCH)
        doc = np.repeat(np.arange(len(spans)), stretches)
        at = docs[:-1][doc] + self.length - 1 + scan.spread(np.zeros(len(spans), np.int64), stretches) * STRETCH
        stop = np.minimum(at + STRETCH, docs[1:][doc])
        found = []
        while len(at):
            move = self.shift[(_block_hash(hashes, at, self.block) & self.mask).astype(np.int64)]
            if (zero := move == 0).any():
                found.append(at[zero])
                move[zero] = 1
            at = at + move
            live = at < stop
            at, stop = at[live], stop[live]
        none = np.zeros(0, np.int64)
        if not found:
            return none, none
        ends = np.concatenate(found)
        h = _block_hash(hashes, ends, self.block)
        low, high = np.searchsorted(self.last, h), np.searchsorted(self.last, h, "right")
        slot = scan.spread(low, high - low)
        ends = np.repeat(ends, high - low)
        first = _block_hash(hashes, ends - self.length + self.block, self.block)
        likely = first == self.first[slot]
        ends, windows = ends[likely], self.order[slot[likely]]
        sure = np.fromiter((same(e, self.texts[w], self.length) for e, w in zip(ends.tolist(), windows.tolist(), strict=True)), bool, len(ends))
        return ends[sure], windows[sure]


def window_sets(items: list[tuple], window: int = WINDOW) -> list[WindowSet]:
    """Of (item_id, text) pairs."""
    by_length: dict[int, dict[bytes, set]] = {}
    for item, text in items:
        words = _normal(text)
        length = min(window, len(words))
        for i in range(len(words) - length + 1) if words else ():
            by_length.setdefault(length, {}).setdefault(b" ".join(words[i : i + length]), set()).add(item)
    return [WindowSet(x, n) for n, x in sorted(by_length.items())]


def _search(sets: list[WindowSet], all_rows: bool, texts: bool):
    """own, the text if asked for, n_words, hits and items; of all rows, or of those with hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, lower = scan.plain_words(), scan.lower_table()
        for batch in batches:
            for piece in scan.pieces(batch, "text"):
                buf, offsets = scan.text_bytes(piece.column("text"))
                buf = lower[buf]
                starts, ends, docs = scan.words(buf, offsets, table_)
                hashes = scan.span_hashes(buf, starts, ends)

                def same(end: int, text: bytes, length: int) -> bool:
                    a = end - length + 1
                    return b" ".join(buf[s:e].tobytes() for s, e in zip(starts[a : end + 1].tolist(), ends[a : end + 1].tolist(), strict=True)) == text  # noqa: B023

                edge = np.zeros(len(starts) + 1, np.int32)
                listed: dict[int, set] = {}
                for s in sets:
                    last, which = s.occurrences(hashes, docs, same)
                    np.add.at(edge, last - s.length + 1, 1)
                    np.add.at(edge, last + 1, -1)
                    for d, w in zip((np.searchsorted(docs, last, "right") - 1).tolist(), which.tolist(), strict=True):
                        listed.setdefault(d, set()).update(s.items[w])
                places = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                cuts = np.searchsorted(places, docs)
                hits = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(places - np.repeat(docs[:-1], np.diff(cuts)), pa.int32()))
                items = [sorted(str(x) for x in listed.get(d, ()) if x is not None) for d in range(piece.num_rows)]
                columns = [piece.column("own"), *([piece.column("text")] if texts else []), pa.array(np.diff(docs), pa.int64()), hits, pa.array(items, pa.list_(pa.string()))]
                out = pa.RecordBatch.from_arrays(columns, ["own", *(["text"] if texts else []), "n_words", "hits", "items"])
                yield out if all_rows else out.filter(pa.array(np.diff(cuts) > 0))

    return lean(run)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list[tuple], bool]]:
    """The items in blocks whose measured size is near block_bytes, one at a time on the driver; and whether there are several."""
    rows, size = text_size(benchmark, text_col)
    blocks = max(1, -(-max(size, 64 * rows) // block_bytes))
    items = benchmark.select(named(id_col).alias("item"), text_of(text_col))
    for k in range(blocks):
        part = items.filter(F.pmod(F.hash("item", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        yield [(x["item"], x["text"]) for x in part.collect()], blocks > 1


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None, texts: bool = True) -> DataFrame:
    """own (a struct of the kept columns, by default all but the text), text if asked for, n_words, hits (places of hit words) and items."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    # hits follow from the text alone, so 128 bits of it name them
    key = [F.xxhash64(text_of(text_col)).alias("a"), F.xxhash64(text_of(text_col), F.lit(7)).alias("b")]
    fields = [named(c).alias(f"c{i}") for i, c in enumerate(keep)]
    kinds = "n_words long, hits array<int>, items array<string>"
    out, parts = None, []
    for block, several in item_blocks(benchmark, item_id_col, item_text_col, block_bytes):
        sets = window_sets(block, window)
        if out is None:
            rows = in_small_batches(docs).select(F.struct(*fields, *(key if several or not fields else [])).alias("own"), text_of(text_col))
            schema = StructType([rows.schema["own"], *_parse_datatype_string(f"{'text string, ' if texts else ''}{kinds}").fields])
            out = rows.mapInArrow(_search(sets, True, texts), schema)
        else:
            found = docs.select(F.struct(*key).alias("own"), text_of(text_col)).mapInArrow(_search(sets, False, False), f"own struct<a: long, b: long>, {kinds}")
            parts.append(stored(found.select("own.a", "own.b", "hits", "items").distinct(), "hits"))
    if not parts:
        return out
    more = parts[0]
    for part in parts[1:]:
        more = more.unionByName(part)
    more = more.groupBy("a", "b").agg(F.flatten(F.collect_list("hits")).alias("more_hits"), F.flatten(F.collect_list("items")).alias("more_items"))
    both = merged(out.withColumn("a", F.col("own.a")).withColumn("b", F.col("own.b")), more, ["a", "b"], "left")
    united = lambda x, y: F.array_sort(F.array_distinct(F.when(F.col(y).isNull(), F.col(x)).otherwise(F.concat(x, y)))).alias(x)
    return both.select("own", *(["text"] if texts else []), "n_words", united("hits", "more_hits"), united("items", "more_items"))


def digests(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    found = hits(docs, benchmark, keep=[id_col], texts=False, **options)
    return found.select(
        F.col("own.c0").cast("long").alias("doc_id"), "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents in which no word is hit, unchanged."""
    return hits(docs, benchmark, text_col=text_col, **options).filter(F.size("hits") == 0).select(*restored(docs, docs.columns, **{text_col: F.col("text")}))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
