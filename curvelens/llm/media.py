"""Operator 6, media columns: what bytes are, by signature and structure, whatever they are declared as.

An Aho-Corasick automaton over the magic bytes of all formats finds every place where a medium
could begin, in one pass over the bytes. At each a validator walks the format's structure
(chunks, boxes, pages, blocks, with their lengths and checksums) and gives the length of a
sound medium, or none. Sound media that lie inside an earlier one belong to it. A value whose
medium begins at its first byte has that type; others carry embedded media.

`sniff` adds the types and places of a binary column, `carve` gives the media as rows, and
`store` writes 8-bit samples as WAV, BMP or PNG for `read_back`, which sniffs, checks and
unpacks them. All are narrow Arrow passes: one row's bytes are in memory at a time.

Defined results. A null or empty value has no media and no type; a declared type is replaced
only where a medium begins at the first byte; damaged and cut media are not media. Rows are
independent; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelens.llm import bytescan as scan
from curvelens.llm.common import in_small_batches, lean, named, own, restored, table, text_of, with_own

WIDTH = 192


class Medium(NamedTuple):
    kind: str
    offset: int
    length: int


# --- validators: length of the sound medium that begins at `at`, or 0 ---


def _png(b: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or first != (kind == b"IHDR") or first and n != 13:
            return 0
        if zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return 0


def _bmp(b: bytes, at: int) -> int:
    if at + 54 > len(b):
        return 0
    size, reserved, start, head, width, height, planes, bits, packing = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if reserved or head not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or packing or width <= 0:
        return 0
    row = (width * bits + 31) // 32 * 4
    return size if start >= 14 + head and size == start + row * abs(height) and at + size <= len(b) else 0


def _riff(b: bytes, at: int, form: bytes, needs: tuple[bytes, ...]) -> int:
    if at + 12 > len(b) or b[at + 8 : at + 12] != form:
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    p, seen = at + 12, set()
    if end > len(b):
        return 0
    while p + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, p)
        seen.add(kind)
        p += 8 + n + n % 2
    return end - at if p == end and all(any(k.startswith(x) for k in seen) for x in needs) else 0


def _wav(b: bytes, at: int) -> int:
    return _riff(b, at, b"WAVE", (b"fmt ", b"data"))


def _webp(b: bytes, at: int) -> int:
    return _riff(b, at, b"WEBP", (b"VP8",))


def _avi(b: bytes, at: int) -> int:
    return _riff(b, at, b"AVI ", (b"LIST",))


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            own = b[p + 9]
            p = blocks(p + 10 + (3 << (own & 7) + 1 if own & 0x80 else 0) + 1)
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p, frame = at + 2, False
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return 0
        mark = b[p + 1]
        if mark == 0xFF:
            p += 1
            continue
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2:
            return 0
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if mark == 0xDA:  # entropy-coded data up to the next marker that isn't a restart
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 2
            if p < 0 or p + 1 >= len(b):
                return 0
            if b[p + 1] == 0xD9:
                return p + 2 - at if frame else 0
    return 0


def _ogg(b: bytes, at: int) -> int:
    p, last = at, False
    while p + 27 <= len(b) and b[p : p + 5] == b"OggS\0":
        n = b[p + 26]
        body = sum(b[p + 27 : p + 27 + n])
        if p + 27 + n + body > len(b):
            break
        last = bool(b[p + 5] & 4)
        p += 27 + n + body
        if last:
            return p - at
    return 0


def _gzip(b: bytes, at: int) -> int:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return 0
    unpack = zlib.decompressobj(31)
    try:
        p = at
        while not unpack.eof and p < len(b):
            unpack.decompress(b[p : p + 65536], 1 << 20)
            while unpack.unconsumed_tail:
                unpack.decompress(unpack.unconsumed_tail, 1 << 20)
            p = min(p + 65536, len(b))
    except zlib.error:
        return 0
    return p - len(unpack.unused_data) - at if unpack.eof else 0


def _pdf(b: bytes, at: int) -> int:
    end = b.find(b"%%EOF", at)
    return end + 5 - at if end >= 0 and b.find(b"startxref", at, end) >= 0 and b[at + 5 : at + 6].isdigit() else 0


def _mp4(b: bytes, at: int) -> int:
    p, seen = at, set()
    while p + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if n < 8 or p + n > len(b) or not kind.isalnum():
            break
        seen.add(kind)
        p += n
    return p - at if b"moov" in seen and b"ftyp" in seen else 0


# Magic bytes of each format, its type, and how many bytes before them the medium begins.
SIGNATURES = [
    (b"\x89PNG\r\n\x1a\n", "image/png", 0, _png),
    (b"BM", "image/bmp", 0, _bmp),
    (b"RIFF", "audio/wav", 0, _wav),
    (b"RIFF", "image/webp", 0, _webp),
    (b"RIFF", "video/avi", 0, _avi),
    (b"GIF87a", "image/gif", 0, _gif),
    (b"GIF89a", "image/gif", 0, _gif),
    (b"\xff\xd8\xff", "image/jpeg", 0, _jpeg),
    (b"OggS", "audio/ogg", 0, _ogg),
    (b"\x1f\x8b\x08", "application/gzip", 0, _gzip),
    (b"%PDF-", "application/pdf", 0, _pdf),
    (b"ftyp", "video/mp4", 4, _mp4),
]


def automaton():
    """Aho-Corasick over the magic bytes, each with its formats."""
    import ahocorasick

    by: dict[bytes, list] = {}
    for magic, kind, before, check in SIGNATURES:
        by.setdefault(magic, []).append((kind, before, check))
    found = ahocorasick.Automaton()
    for magic, formats in by.items():
        found.add_word(magic.decode("latin-1"), (len(magic), formats))
    found.make_automaton()
    return found


def media_in(blob: bytes | None, magic) -> list[Medium]:
    """Sound media of a value that don't lie in an earlier one, by offset."""
    found: list[Medium] = []
    end = 0
    if not blob:
        return found
    for last, (n, formats) in magic.iter(blob.decode("latin-1")):
        for kind, before, check in formats:
            at = last - n + 1 - before
            if at >= end and (length := check(blob, at)):
                found.append(Medium(kind, at, length))
                end = at + length
                break
    return found


def _sniffed(df: DataFrame, blob_col: str, declared_col: str | None) -> DataFrame:
    """own (a struct of the other columns), blob, kind (from the bytes, else as declared) and media."""
    others = [c for c in df.columns if c != blob_col]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        magic = automaton()
        for batch in batches:
            for piece in scan.pieces(batch, "blob"):
                media = [media_in(x, magic) for x in piece.column("blob").to_pylist()]
                types = [m[0].kind if m and m[0].offset == 0 else d for m, d in zip(media, piece.column("declared").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("own"), piece.column("blob"), pa.array(types, pa.string()), pa.array([[x._asdict() for x in m] for m in media], kind)], ["own", "blob", "kind", "media"])

    rows = df.select(own(others), named(blob_col).cast("binary").alias("blob"), (named(declared_col) if declared_col else F.lit(None)).cast("string").alias("declared"))
    return rows.mapInArrow(lean(run), with_own(df, others, "blob binary, kind string, media array<struct<kind: string, offset: long, length: long>>"))


def sniff(df: DataFrame, blob_col: str, declared_col: str | None = None, type_col: str = "__type", media_col: str = "__media") -> DataFrame:
    """Adds (or replaces) the type, from the bytes, else as declared, and an array of (kind, offset, length) of the media."""
    keep = [c for c in df.columns if c not in (type_col, media_col)]
    found = _sniffed(df, blob_col, declared_col)
    back = dict(zip(df.columns, restored(df, df.columns, **{blob_col: F.col("blob")}), strict=True))
    return found.select(*(back[c] for c in keep), F.col("kind").alias(type_col), F.col("media").alias(media_col))


def carve(df: DataFrame, blob_col: str) -> DataFrame:
    """A row for each medium of each value: the other columns (but for those of the names that follow), kind, offset, length and the bytes as medium."""
    rows = _sniffed(df, blob_col, None).select("own", "blob", F.explode("media").alias("m"))
    others = [c for c in df.columns if c != blob_col]
    keep = [x for c, x in zip(others, restored(df, others), strict=True) if c not in ("kind", "offset", "length", "medium")]
    return rows.select(*keep, "m.kind", "m.offset", "m.length", F.expr("substring(blob, int(m.offset + 1), int(m.length))").alias("medium"))


# --- 8-bit samples ---


def as_wav(samples: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + len(samples) % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)


def as_bmp(samples: bytes, width: int = WIDTH) -> bytes:
    rows = len(samples) // width
    grey = b"".join(bytes((i, i, i, 0)) for i in range(256))
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + 1024 + len(samples), 0, 54 + 1024, 40, width, -rows, 1, 8, 0, len(samples), 2835, 2835, 256, 0) + grey + samples


def as_png(samples: bytes, width: int = WIDTH) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + samples[i : i + width] for i in range(0, len(samples), width))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(samples) // width, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")


def samples_of(medium: bytes, kind: str) -> bytes:
    """The samples of a WAV, BMP or PNG as written above."""
    if kind == "audio/wav":
        p = 12
        while medium[p : p + 4] != b"data":
            p += 8 + (n := struct.unpack_from("<I", medium, p + 4)[0]) + n % 2
        return medium[p + 8 : p + 8 + struct.unpack_from("<I", medium, p + 4)[0]]
    if kind == "image/bmp":
        size, start = struct.unpack_from("<I", medium, 2)[0], struct.unpack_from("<I", medium, 10)[0]
        return medium[start:size]
    if kind == "image/png":
        p, width, data = 8, struct.unpack_from(">I", medium, 16)[0], []
        while p < len(medium):
            n, name = struct.unpack_from(">I4s", medium, p)
            data += [medium[p + 8 : p + 8 + n]] if name == b"IDAT" else []
            p += 12 + n
        raw = zlib.decompress(b"".join(data))
        return b"".join(raw[i + 1 : i + 1 + width] for i in range(0, len(raw), width + 1))
    raise ValueError(f"no samples in {kind}")


def store(payload: bytes) -> tuple[bytes, str]:
    """A payload of a multiple of 192 bytes as WAV, BMP or PNG (its CRC-32 decides), under one declared type."""
    write = (as_wav, as_bmp, as_png)[zlib.crc32(payload) % 3]
    return write(payload), "image/bmp"


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = in_small_batches(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text"))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in scan.pieces(batch, "text"):
                texts = [(x or "").encode() for x in piece.column("text").to_pylist()]
                media = [store(t + b" " * (-len(t) % WIDTH if t else WIDTH)) for t in texts]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([m for m, _ in media], pa.binary()), pa.array([d for _, d in media], pa.string())], ["doc_id", "n_bytes", "blob", "declared"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for blob, kind, declared, media in zip(*(batch.column(c).to_pylist() for c in ("blob", "__type", "declared", "__media")), strict=True):
                carved = blob[media[0]["offset"] : media[0]["offset"] + media[0]["length"]]
                payload = samples_of(carved, kind)
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-16:]))
                out["media_bytes"].append(len(carved))
                out["media_sha256"].append(hashlib.sha256(carved).hexdigest())
                out["feature"].append(f"{kind};declared={declared};{'kept' if kind == declared else 'corrected'};offset={media[0]['offset']};media={len(media)};rows={len(payload) // WIDTH}")
            kinds = {"payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64()}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(v, kinds.get(k, pa.string())) for k, v in out.items())], ["doc_id", "n_bytes", *out])

    blobs = docs.mapInArrow(lean(stored), "doc_id long, n_bytes long, blob binary, declared string")
    return sniff(blobs, "blob", "declared").mapInArrow(lean(features), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
