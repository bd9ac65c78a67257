"""Operator 3, substring dedup: Rabin-Karp hashes of every window of consecutive words.

Words are [^\\x20\\x09-\\x0D]+, unchanged. A word goes if a window that covers it also
starts earlier: in a smaller doc_id, or earlier in the same document. Judged on the input.

Plan. (1) Each task hashes all windows of its texts, a few megabytes at a time. Of the equal
windows of one piece only the earliest goes on, and a task remembers the earliest place of up to
SEEN hashes that it met twice: a later piece's windows that are known to start earlier elsewhere
are marked at once. So a passage that a third of all documents share is a few entries per task, not
one per document. Entries are packed by range of the hash (7 bytes of hash, few of start, a
document table), since a row per window would cost several times the text in shuffle. (2) Spark
groups the packs by hash range, and each group sorts its entries and marks all but the earliest of
equal hashes. The number of ranges follows the bytes of text, so a group stays near RANGE_BYTES of
text whatever the input. (3) Marked starts go back to their documents, again packed, in a cogroup by
ranges of a hash of the document; overlapping windows merge into maximal intervals there.

Equality of windows is equality of 64-bit hashes (of 56 bits and the range, where ranges are
fewer than 256): with n windows, n * n / 2**65 pairs are expected to agree by chance, and at
most 256 / ranges times as many (0.002 for the 864 MB of text of the larger check tables).

Defined results. Null, empty and short texts have no window and lose nothing. A null doc_id
comes after all others. Rows with one doc_id and one text are one document and get the same
result; rows with one doc_id and different texts stay apart, in the order of a hash of the text (32
bits; 64 where the id is null, as many rows may share that). Other columns, whatever their names,
pass through `remove_repeats` unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelens.llm import bytescan as scan
from curvelens.llm.common import identity, in_small_batches, lean, named, own, power_of_two, restored, table, text_of, text_size, trimmed, with_own

WINDOW = 20
#: Bytes of text whose windows one group of step 2 holds on average.
RANGE_BYTES = 4 << 20
#: Bytes of text of which step 1 merges equal windows.
PIECE_BYTES = 3 << 20
#: Hashes whose earliest place a task remembers.
SEEN = 1 << 16

#: A document table and starts: ids, marks and counts, then starts, document by document.
_PACK = pa.schema([("range", pa.int32()), ("places", pa.binary()), ("hashes", pa.binary())])
_FOUND = pa.schema([("home", pa.int64()), ("places", pa.binary())])


def _places(ids: np.ndarray, marks: np.ndarray, starts: np.ndarray) -> bytes:
    """Places in order of document and start, as bytes."""
    head = np.ones(len(ids), bool)
    head[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])
    head = np.flatnonzero(head)
    own = ids[head]
    counts = np.diff(np.append(head, len(ids)))
    return own[:1].tobytes() + b"".join(scan.squeezed(x) for x in (np.diff(own), marks[head], counts, starts))


def _from_places(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and marks of the documents, how many places each has, and the starts."""
    steps, at = scan.unsqueezed(data, 8)
    marks, at = scan.unsqueezed(data, at)
    counts, at = scan.unsqueezed(data, at)
    starts, _ = scan.unsqueezed(data, at)
    ids = np.cumsum(np.concatenate([np.frombuffer(data, np.int64, 1), steps.astype(np.int64)]))
    return ids, marks.astype(np.int64), counts.astype(np.int64), starts.astype(np.int64)


def _low_bytes(hashes: np.ndarray) -> bytes:
    """The lower seven bytes of each hash; the range that it is sent to says the rest."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _from_low_bytes(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 7, 8), np.uint8)
    wide[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return wide.reshape(-1).view("<u8")


def _before(a: tuple, b: tuple) -> np.ndarray:
    """Where place a (id, mark, start) is strictly earlier than place b."""
    return (a[0] < b[0]) | (a[0] == b[0]) & ((a[1] < b[1]) | (a[1] == b[1]) & (a[2] < b[2]))


class _Seen:
    """The earliest sent place of hashes that a task met more than once."""

    def __init__(self, limit: int):
        self.limit, self.h = limit, np.zeros(0, np.uint64)
        self.place = tuple(np.zeros(0, np.int64) for _ in range(3))

    def judge(self, h: np.ndarray, place: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Which windows start earlier at a place that was sent, and which were sent themselves; earlier ones are noted."""
        later, same = np.zeros(len(h), bool), np.zeros(len(h), bool)
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            hit = np.flatnonzero(self.h[at] == h)
            at, mine = at[hit], tuple(x[hit] for x in place)
            known = tuple(x[at] for x in self.place)
            later[hit] = _before(known, mine)
            sooner = _before(mine, known)
            same[hit] = ~later[hit] & ~sooner
            for x, y in zip(self.place, mine, strict=True):
                x[at[sooner]] = y[sooner]
        return later, same

    def add(self, h: np.ndarray, place: tuple) -> None:
        """Hashes in ascending order, each with the earliest place that is sent now."""
        if len(self.h):
            new = self.h[np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)] != h
            h, place = h[new], tuple(x[new] for x in place)
        room = self.limit - len(self.h)
        if room > 0 and len(h):
            both = np.concatenate([self.h, h[:room]])
            by = np.argsort(both)
            self.h = both[by]
            self.place = tuple(np.concatenate([x, y[:room]])[by] for x, y in zip(self.place, place, strict=True))


def _packs(batches: Iterator[pa.RecordBatch], width: int, bits: int, limit: int = SEEN) -> Iterator[pa.RecordBatch]:
    """The earliest entry of each hash, by range; starts that are known to be later as range -1 - n."""
    lut = scan.space_words()
    held: list[pa.RecordBatch] = []
    size, seen = 0, _Seen(limit)

    def flush() -> Iterator[pa.RecordBatch]:
        ids, marks, where, hashes = [], [], [], []
        base = 0
        for b in held:
            for piece in scan.pieces(b, "text"):
                buf, offsets = scan.text_bytes(piece.column("text"))
                starts, ends, docs = scan.words(buf, offsets, lut)
                at, h, per = scan.window_hashes(scan.span_hashes(buf, starts, ends), docs, width)
                n = piece.num_rows
                ids.append(piece.column("id").to_numpy())
                marks.append(piece.column("mark").to_numpy())
                doc = np.repeat(np.arange(n), np.diff(per))
                where.append(((doc + base).astype(np.uint64) << np.uint64(32)) | (at - docs[:-1][doc]).astype(np.uint64))
                hashes.append(h)
                base += n
        if not base:
            return
        ids, marks, where, h = np.concatenate(ids), np.concatenate(marks), np.concatenate(where), np.concatenate(hashes)
        del hashes
        if not len(h):
            return
        rank = np.empty(base, np.uint64)
        order = np.lexsort((marks, ids))
        rank[order] = np.arange(base, dtype=np.uint64)
        ids, marks = ids[order], marks[order]
        # Rows of one id and text are one document: of their equal positions none is earlier.
        same = np.zeros(base, bool)
        same[1:] = (ids[1:] == ids[:-1]) & (marks[1:] == marks[:-1])
        whole = (np.cumsum(~same) - 1).astype(np.uint64)
        heads = np.flatnonzero(~same)
        ids, marks = ids[heads], marks[heads]
        where = (whole[rank[(where >> np.uint64(32)).astype(np.int64)].astype(np.int64)] << np.uint64(32)) | (where & np.uint64(0xFFFFFFFF))
        by = np.argsort(where, kind="stable")
        where, h = where[by], h[by]
        if len(heads) < base:
            keep = np.ones(len(where), bool)
            keep[1:] = where[1:] != where[:-1]
            where, h = where[keep], h[keep]

        def place(x: np.ndarray) -> tuple:
            doc = (x >> np.uint64(32)).astype(np.int64)
            return ids[doc], marks[doc], (x & np.uint64(0xFFFFFFFF)).astype(np.int64)

        by = np.argsort(h, kind="stable")
        where, h = where[by], h[by]
        del by
        later = np.zeros(len(h), bool)
        later[1:] = h[1:] == h[:-1]
        twice = np.zeros(len(h), bool)
        twice[:-1] = later[1:]
        gone, twice = [where[later]], twice[~later]
        where, h = where[~later], h[~later]
        known, sent = seen.judge(h, place(where))
        gone.append(where[known])
        seen.add(h[twice & ~known & ~sent], place(where[twice & ~known & ~sent]))
        where, h = where[~known & ~sent], h[~known & ~sent]
        del later, twice, known, sent
        part = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        by = np.lexsort((where, part))
        where, h, part = where[by], h[by], part[by]
        del by
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        out = [(int(part[a]), _places(*place(where[a:b])), _low_bytes(h[a:b])) for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True)]
        gone = np.sort(np.concatenate(gone))
        if len(gone):  # dealt over the ranges, so that no group gets them all
            out.append((-1 - int(gone[0] * np.uint64(0x9E3779B1) % np.uint64(1 << bits)), _places(*place(gone)), b""))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _PACK, strict=True)], schema=_PACK)

    for batch in batches:
        for piece in scan.pieces(batch, "text", PIECE_BYTES):
            n = scan.text_bytes(piece.column("text"))[1][-1]
            if held and size + n > PIECE_BYTES:
                yield from flush()
                held, size = [], 0
            held.append(piece)
            size += n
    yield from flush()


def _home(ids: np.ndarray, marks: np.ndarray, bits: int) -> np.ndarray:
    """The group in which a document and its marked starts meet."""
    h = scan.mixed(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + marks.astype(np.uint64))
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _later(group: pa.Table, bits: int) -> pa.Table:
    """Of the entries of a hash range, those that are not the earliest with their hash, packed by home."""
    ids, marks, docs, starts, hashes, gone = [], [], [], [], [], []
    base = 0
    for batch in group.to_batches():
        for key, data, h in zip(*(batch.column(k).to_pylist() for k in _PACK.names), strict=True):
            i, m, counts, s = _from_places(data)
            if key < 0:
                gone.append((np.repeat(i, counts), np.repeat(m, counts), s))
                continue
            ids.append(i)
            marks.append(m)
            docs.append(np.repeat(np.arange(base, base + len(i), dtype=np.int32), counts))
            starts.append(s.astype(np.uint32))
            hashes.append(_from_low_bytes(h))
            base += len(i)
    if hashes:
        h = np.concatenate(hashes)
        del hashes
        by = np.argsort(h)
        h = h[by]
        twice = np.zeros(len(h), bool)
        twice[1:] = h[1:] == h[:-1]
        twice[:-1] |= h[1:] == h[:-1]
        by, h = by[twice], h[twice]
        doc, s = np.concatenate(docs)[by], np.concatenate(starts)[by].astype(np.int64)
        i, m = np.concatenate(ids)[doc], np.concatenate(marks)[doc]
        by = np.lexsort((s, m, i, h))
        i, m, s, h = i[by], m[by], s[by], h[by]
        later = np.zeros(len(h), bool)
        later[1:] = h[1:] == h[:-1]
        # a place of one document that came from two pieces is not earlier than itself
        first = np.flatnonzero(~later)[np.cumsum(~later) - 1] if len(h) else np.zeros(0, np.int64)
        later &= (i != i[first]) | (m != m[first]) | (s != s[first])
        gone.append((i[later], m[later], s[later]))
    i, m, s = (np.concatenate([x[k] for x in gone]) for k in range(3)) if gone else (np.zeros(0, np.int64),) * 3
    if not len(i):
        return _FOUND.empty_table()
    home = _home(i, m, bits)
    by = np.lexsort((s, m, i, home))
    i, m, s, home = i[by], m[by], s[by], home[by]
    cuts = np.flatnonzero(np.diff(home, prepend=-1))
    out = [(int(home[a]), _places(i[a:b], m[a:b], s[a:b])) for a, b in zip(cuts, [*cuts[1:], len(home)], strict=True)]
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _FOUND.types, strict=True)], schema=_FOUND)


def _bits(docs: DataFrame, text_col: str, range_bytes: int) -> int:
    return power_of_two(text_size(docs, text_col)[1] / range_bytes).bit_length() - 1


def _mark(id_col: str, text_col: str):
    """Keeps rows with one doc_id and different texts apart: not negative, small where the id is not null."""
    text = named(text_col).cast("string")
    return F.when(named(id_col).isNull(), F.shiftrightunsigned(F.xxhash64(text), 1)).otherwise(F.hash(text).cast("long") + (1 << 31)).alias("mark")


def repeated_starts(docs: DataFrame, bits: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First words of the windows that start earlier elsewhere, packed by home, over 2**bits ranges of hashes."""
    rows = docs.select(identity(id_col).alias("id"), _mark(id_col, text_col), text_of(text_col))
    packs = rows.mapInArrow(lean(lambda it: _packs(it, window, bits)), "range int, places binary, hashes binary")
    keyed = packs.withColumn("key", F.when(F.col("range") < 0, -1 - F.col("range")).otherwise(F.col("range")))

    def later(group: pa.Table) -> pa.Table:
        with trimmed():
            return _later(group, bits)

    return keyed.groupBy("key").applyInArrow(later, "home long, places binary")


def _squeeze(bits: int):
    """Texts compressed for the shuffle to their homes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for piece in scan.pieces(b, "text"):
                texts = [None if x is None else pack.compress(x.encode()) for x in piece.column("text").to_pylist()]
                home = _home(piece.column("id").to_numpy(), piece.column("mark").to_numpy(), bits)
                yield pa.RecordBatch.from_arrays([piece.column("own"), piece.column("id"), piece.column("mark"), pa.array(texts, pa.binary()), pa.array(home)], ["own", "id", "mark", "packed", "home"])

    return lean(run)


def _covered(n: int, starts: list[np.ndarray], window: int) -> np.ndarray:
    """Which of n words the windows with these first words cover: maximal intervals."""
    edge = np.zeros(n + 1, np.int64)
    for s in starts:
        np.add.at(edge, s, 1)
        np.add.at(edge, s + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _at_home(docs: DataFrame, window: int, id_col: str, text_col: str, keep: list[str], range_bytes: int, finish, made: str) -> DataFrame:
    """own (the kept columns) and what finish(texts, starts of the windows to remove for each) gives, home by home."""
    bits = _bits(in_small_batches(docs), text_col, range_bytes)
    found = repeated_starts(docs, bits, window, id_col, text_col)
    side = docs.select(own(keep), identity(id_col).alias("id"), _mark(id_col, text_col), text_of(text_col))
    side = side.mapInArrow(_squeeze(bits), with_own(docs, keep, "id long, mark long, packed binary, home long"))

    def met(rows: pa.Table, marked: pa.Table) -> pa.Table:
        gone: dict[tuple, list] = {}
        for data in marked.column("places").to_pylist():
            ids, marks, counts, starts = _from_places(data)
            for doc, mark, part in zip(ids.tolist(), marks.tolist(), np.split(starts, np.cumsum(counts)[:-1]), strict=True):
                gone.setdefault((doc, mark), []).append(part)
        open_ = zstandard.ZstdDecompressor()
        texts = (None if x is None else open_.decompress(x) for x in rows.column("packed").to_pylist())
        keys = zip(rows.column("id").to_pylist(), rows.column("mark").to_pylist(), strict=True)
        columns = finish(texts, (gone.get(k, []) for k in keys))
        return pa.table({"own": rows.column("own")} | columns)

    def meet(rows: pa.Table, marked: pa.Table) -> pa.Table:
        with trimmed():
            return met(rows, marked)

    return side.groupBy("home").cogroup(found.groupBy("home")).applyInArrow(meet, with_own(docs, keep, made))


def digests(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    lut = scan.space_words()

    def finish(texts, gone) -> dict:
        counts, removed, shas = [], [], []
        for text, found in zip(texts, gone, strict=True):
            buf = np.frombuffer(text or b"", np.uint8)
            starts, ends, _ = scan.words(buf, np.array([0, len(buf)]), lut)
            out = _covered(len(starts), found, window)
            kept, _ = scan.gather(buf, starts[~out], ends[~out], 0x20)
            counts.append(len(starts))
            removed.append(int(out.sum()))
            shas.append(hashlib.sha256(kept[:-1].tobytes()).hexdigest())
        return {"n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}

    out = _at_home(docs, window, id_col, text_col, [id_col], range_bytes, finish, "n_words long, n_removed long, kept_sha256 string")
    return out.select(F.col("own.c0").cast("long").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def _cut(text: bytes, gone: list[np.ndarray], window: int, lut: np.ndarray) -> bytes:
    """The text without the covered words and the white space after them."""
    buf = np.frombuffer(text, np.uint8)
    starts, _, _ = scan.words(buf, np.array([0, len(buf)]), lut)
    covered = _covered(len(starts), gone, window)
    cuts = np.append(starts, len(buf))
    edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
    at, kept = 0, []
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        kept.append(text[at : cuts[a]])
        at = cuts[b]
    return b"".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The table with each removed interval cut out of its text; the white space around kept words stays.

    A text without a repeated window is unchanged, byte for byte.
    """
    lut = scan.space_words()
    others = [c for c in docs.columns if c != text_col]

    def finish(texts, gone) -> dict:
        return {"text": pa.array([None if text is None else (_cut(text, found, window, lut) if found else text).decode() for text, found in zip(texts, gone, strict=True)], pa.string())}

    out = _at_home(docs, window, id_col, text_col, others, range_bytes, finish, "text string")
    return out.select(*restored(docs, docs.columns, **{text_col: F.col("text")}))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
