import gzip
import hashlib
import struct
import zlib

from curvelens.llm import media
from curvelens.llm.media import as_bmp, as_png, as_wav, automaton, carve, media_in, op6_media, samples_of, sniff

GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0" + b"\x3b"
JPEG = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x04cd\xff\xda\0\x04ef123\xff\x00456\xff\xd9"
OGG = b"OggS\0\x04" + b"\0" * 20 + b"\x01\x03abc"
PDF = b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF"
MP4 = struct.pack(">I4s4s", 12, b"ftyp", b"isom") + struct.pack(">I4s", 8, b"moov")
PAYLOAD = bytes(range(192)) * 3


def test_sound_media_are_found_and_damaged_ones_are_not():
    magic = automaton()
    sound = {"audio/wav": as_wav(PAYLOAD), "image/bmp": as_bmp(PAYLOAD), "image/png": as_png(PAYLOAD), "image/gif": GIF, "image/jpeg": JPEG, "audio/ogg": OGG, "application/gzip": gzip.compress(PAYLOAD), "application/pdf": PDF, "video/mp4": MP4}
    for kind, blob in sound.items():
        assert media_in(blob, magic) == [media.Medium(kind, 0, len(blob))]
        assert media_in(b"xBMRIFFftyp " + blob + b" tail", magic) == [media.Medium(kind, 12, len(blob))]
        assert media_in(blob[:-1], magic) == []
    both = as_wav(as_png(PAYLOAD)) + b"--" + GIF
    assert [m.kind for m in media_in(both, magic)] == ["audio/wav", "image/gif"]
    assert media_in(None, magic) == media_in(b"", magic) == media_in(b"plain BM text RIFF", magic) == []
    for write, kind in ((as_wav, "audio/wav"), (as_bmp, "image/bmp"), (as_png, "image/png")):
        assert samples_of(write(PAYLOAD), kind) == PAYLOAD


def test_sniff_and_carve(spark):
    rows = [(1, bytearray(GIF), "image/png", "a"), (1, bytearray(b"text"), "text/plain", None), (None, None, None, "c"), (2, bytearray(b"ab" + OGG), "text/plain", "d")]
    df = spark.createDataFrame(rows, "id long, blob binary, declared string, kind string")
    assert sorted((x["__type"] or "", len(x["__media"])) for x in sniff(df, "blob", "declared").collect()) == [("", 0), ("image/gif", 1), ("text/plain", 0), ("text/plain", 1)]
    assert {(x.id, x.kind, x.offset, bytes(x.medium)) for x in carve(df, "blob").collect()} == {(1, "image/gif", 0, GIF), (2, "audio/ogg", 2, OGG)}
    assert carve(df.limit(0), "blob").count() == 0


def test_query_reads_back_every_payload(spark, tmp_path):
    rows = {1: "Été " * 100, 2: "", 3: None, 4: "x" * 192, 5: "RIFF BM GIF89a", 6: "x" * 192}
    spark.createDataFrame(list(rows.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in op6_media(spark, str(tmp_path)).collect()}
    for k, t in rows.items():
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (got[k].n_bytes, got[k].payload_bytes, got[k].payload_sha256, got[k].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        blob = (as_wav, as_bmp, as_png)[zlib.crc32(payload) % 3](payload)
        assert (got[k].media_bytes, got[k].media_sha256) == (len(blob), hashlib.sha256(blob).hexdigest())
    assert got[4].feature == got[6].feature
