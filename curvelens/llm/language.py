"""Operator 4, language identification: nearest of several centroids per language.

A text's features are its byte n-grams (1 to 4 bytes, in lower case, runs of anything but
letters as one blank), hashed into DIMENSIONS. Weights are (1 + ln count) * idf, normalised to
length 1. Labelled texts of each language are clustered by spherical k-means into CLUSTERS
centroids; a text gets the language of the centroid with the largest cosine (the smaller
language name on ties). A text without letters is rejected, and one farther from all centroids
than a bound for its length: cosines grow with length, so each octave of letters has a bound of
its own, a little below what nearly all labelled texts of that octave and the two beside it have.

Plan. Document frequencies are counted over all labelled texts, by language, summed per task and then
in Spark by dimension. Centroids are learned from all labelled texts too: ROUNDS passes in which each text
goes to the nearest centroid of its own language and the next centroids are the means of theirs. The first
pass starts from fixed random directions at right angles to the language's mean; a cluster without texts goes. Sums are of
whole numbers (weights in steps of 1 / STEPS), so they don't depend on how rows are dealt. The driver
gets DIMENSIONS sums per centroid, no texts. Bounds come from all labelled texts: their octaves and cosines are
stored, and the driver gets counts of cosines by octave, coarse ones but where a bound lies, which makes the quantiles
exact. Prediction is one narrow Arrow pass with a broadcast matrix of DIMENSIONS x centroids.
Statistics and predictions use whole texts.

Defined results. Null texts and texts without a letter are `und` with score 0 and rejected.
Without labelled texts every text is. Repeated rows each get the same result. Other columns of
the table, whatever their names, pass through. Ties of the cosine go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelens.llm import bytescan as scan
from curvelens.llm.common import in_small_batches, lean, named, opened, own, restored, share, stored, table, text_of, with_own

DIMENSIONS = 1 << 13
#: The shape of the bounds of rejection.
FARTHEST, SLACK, LEAST_JUDGED = 0.001, 0.9, 200
OCTAVES = 40
CLUSTERS, ROUNDS = 4, 3
#: Texts whose dense counts are in memory at a time.
ROWS = 64
#: Steps of a weight in sums: those of ROWS texts are exact in single precision.
STEPS = 1 << 17
UNKNOWN = "und"
_FACTORS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def _letters_only(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters, other runs as one blank, and a blank before each text; offsets."""
    lower = scan.lower_table()[buf]
    letter = ((lower >= 0x61) & (lower <= 0x7A)) | (lower >= 0x80)
    lower = np.where(letter, lower, 0x20).astype(np.uint8)
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~letter[1:]
    keep[offsets[:-1][offsets[:-1] < offsets[1:]]] |= True
    cuts = np.concatenate([[0], np.cumsum(keep)])[offsets]
    starts = cuts[:-1] + np.arange(len(cuts) - 1)
    out = np.full(int(cuts[-1]) + len(cuts) - 1, 0x20, np.uint8)
    out[scan.spread(starts + 1, np.diff(cuts))] = lower[keep]
    return out, np.append(starts, len(out))


def count_blocks(texts: pa.Array, rows: int = ROWS) -> Iterator[np.ndarray]:
    """Counts of hashed n-grams, a row per text, in blocks of a few texts: a dense block stays in the cache."""
    buf, offsets = _letters_only(*scan.text_bytes(texts))
    for first in range(0, len(offsets) - 1, rows):
        cuts = offsets[first : first + rows + 1]
        own, cuts, n = buf[cuts[0] : cuts[-1]], cuts - cuts[0], len(cuts) - 1
        doc = np.repeat(np.arange(n, dtype=np.int64) * DIMENSIONS, np.diff(cuts))
        left = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(len(own))
        total = np.zeros(n * DIMENSIONS, np.int64)
        rolled = np.zeros(len(own), np.uint32)
        for k in range(4):
            rolled = rolled[: len(own) - k] if k else rolled
            rolled = rolled * np.uint32(257) + own[k:].astype(np.uint32) + np.uint32(k == 0)
            slot = ((rolled * _FACTORS[k]) >> np.uint32(19)).astype(np.int64) + doc[: len(rolled)]
            total += np.bincount(slot[left[: len(rolled)] > k] if k else slot, minlength=n * DIMENSIONS)
        yield total.reshape(n, DIMENSIONS)


def counts_of(texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros((0, DIMENSIONS), np.int64), *count_blocks(texts)])


def has_letter(texts: pa.Array) -> np.ndarray:
    buf, offsets = scan.text_bytes(texts)
    lower = scan.lower_table()[buf]
    plain = np.concatenate([[0], np.cumsum((lower >= 0x61) & (lower <= 0x7A))])
    found = plain[offsets[1:]] > plain[offsets[:-1]]
    for k in np.flatnonzero(~found).tolist():
        found[k] = any(c.isalpha() for c in texts[k].as_py() or "")
    return found


class Model(NamedTuple):
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    bounds: np.ndarray  # least cosine of each octave of letters


def octave(counts: np.ndarray) -> np.ndarray:
    """Of the number of n-grams of each text, which is about four times its letters."""
    return np.minimum(np.log2(np.maximum(counts.sum(axis=1), 1)).astype(np.int64), OCTAVES - 1)


def nearest(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the place of the nearest centroid, its cosine and the text's octave."""
    best, score, octaves = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
    for counts in count_blocks(texts):
        near = _weighed(counts, model.idf) @ model.centroids.T
        best.append(np.argmax(near, axis=1))
        score.append(np.clip(near.max(axis=1), 0, 1).astype(float))
        octaves.append(octave(counts))
    return np.concatenate(best), np.concatenate(score), np.concatenate(octaves)


def _around(octaves: np.ndarray, cosines: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float] | None]:
    """For each octave, of it and the two beside it: the two entries that the quantile lies between, and how far
    it is from the first; None without enough texts. Entries are in order of cosines."""
    out: list[tuple[np.ndarray, np.ndarray, float] | None] = []
    for k in range(OCTAVES):
        own = np.flatnonzero(np.abs(octaves - k) <= 1)
        upto = np.cumsum(counts[own])
        if not len(own) or upto[-1] < LEAST_JUDGED:
            out.append(None)
            continue
        at = FARTHEST * float(upto[-1] - 1)
        low, high = np.searchsorted(upto, [int(at), min(int(at) + 1, upto[-1] - 1)], "right")
        out.append((own[low], own[high], at - int(at)))
    return out


def bounds_of(octaves: np.ndarray, cosines: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """The least cosine of each octave; without enough texts that of the octave before."""
    order = np.argsort(cosines, kind="stable")
    octaves, cosines = octaves[order], cosines[order]
    counts = np.ones(len(order), np.int64) if counts is None else counts[order]
    out, bound = np.zeros(OCTAVES), 0.5 * float(cosines[0]) if len(cosines) else 0.0
    for k, around in enumerate(_around(octaves, cosines, counts)):
        if around is not None:
            low, high, part = around
            bound = SLACK * float(cosines[low] + part * (cosines[high] - cosines[low]))
        out[k] = bound
    return out


def _bounds(judged: DataFrame) -> np.ndarray:
    """The bounds from octave and bits (of a cosine in single precision, whose order they have) of any number of texts."""
    judged = stored(judged, "judged")
    coarse = judged.groupBy("octave", F.shiftright("bits", 16).alias("bits")).agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("bits")
    octaves, bits, counts = (coarse.column(c).to_numpy() for c in ("octave", "bits", "n"))
    if not len(bits):
        return np.zeros(OCTAVES)
    places = octaves.astype(np.int64) << 16 | bits
    asked = bits == bits[0]
    for k, around in enumerate(_around(octaves, bits, counts)):
        if around is not None:
            asked |= (np.abs(octaves - k) <= 1) & np.isin(bits, bits[list(around[:2])])
    place = F.shiftleft("octave", 16).bitwiseOR(F.shiftright("bits", 16))
    fine = judged.filter(place.isin(places[asked].tolist())).groupBy("octave", "bits").agg(F.count(F.lit(1)).alias("n")).toArrow()
    rest = ~asked
    octaves = np.concatenate([octaves[rest], fine.column("octave").to_numpy()])
    counts = np.concatenate([counts[rest], fine.column("n").to_numpy()])
    bits = np.concatenate([bits[rest].astype(np.int32) << 16, fine.column("bits").to_numpy().astype(np.int32)])
    return bounds_of(octaves, bits.astype(np.int32).view(np.float32).astype(float), counts)


def _weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = np.zeros(counts.shape, np.float32)
    some = counts > 0
    w[some] = 1 + np.log(counts[some])
    w *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", w, w))
    return w / np.maximum(norm, 1e-12)[:, None]


def _directions(mean: np.ndarray, k: int) -> np.ndarray:
    """Fixed random directions at right angles to the mean."""
    mean = mean / max(float(np.linalg.norm(mean)), 1e-12)
    signs = np.array([np.random.default_rng(j).choice([-1.0, 1.0], DIMENSIONS) for j in range(k)]).reshape(k, DIMENSIONS)
    return (signs - np.outer(signs @ mean, mean)).astype(np.float32)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each language the texts (slot -1) and the texts with each n-gram."""
    df: dict[str, np.ndarray] = {}
    for batch in batches:
        for piece in scan.pieces(batch, "text"):
            langs, at = np.array(piece.column("lang").to_pylist(), object), 0
            for counts in count_blocks(piece.column("text")):
                here, at = langs[at : at + len(counts)], at + len(counts)
                for lang in set(here.tolist()):
                    own = counts[here == lang]
                    total = df.setdefault(lang, np.zeros(DIMENSIONS + 1, np.int64))
                    total += np.concatenate([[len(own)], np.count_nonzero(own, axis=0)])
    for lang, total in df.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total), pa.string()), pa.array(np.arange(-1, DIMENSIONS), pa.int32()), pa.array(total)], ["lang", "slot", "n"])


def _sums(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each centroid the texts of its language nearest to it (slot -1) and the sums of their weights, in steps."""
    names, of = np.unique(np.array(model.languages, object), return_inverse=True)
    known = pa.array(names, pa.string())
    totals = np.zeros((len(of), DIMENSIONS + 1), np.int64)
    for batch in batches:
        for piece in scan.pieces(batch, "text"):
            own, at = pc.index_in(piece.column("lang"), known).to_numpy(zero_copy_only=False), 0
            for counts in count_blocks(piece.column("text")):
                here, at = own[at : at + len(counts)], at + len(counts)
                weights = _weighed(counts, model.idf)
                near = np.where(of == here[:, None], weights @ model.centroids.T, -np.inf)
                to = np.argmax(near, axis=1)
                some = np.unique(to)
                chosen = (some[:, None] == to).astype(np.float32)
                totals[some, 1:] += (chosen @ np.rint(weights * STEPS)).astype(np.int64)
                totals[some, 0] += chosen.sum(axis=1).astype(np.int64)
    for j in np.flatnonzero(totals[:, 0]).tolist():
        slots = np.flatnonzero(totals[j])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slots), j), pa.int32()), pa.array(slots - 1, pa.int32()), pa.array(totals[j, slots])], ["centroid", "slot", "total"])


def _next(rows: DataFrame, model: Model) -> Model:
    """The centroids' next places: the means of the texts that are nearest to them in their language."""
    shared = share(rows.sparkSession, model)
    sums = rows.select("lang", "text").mapInArrow(lean(lambda batches: _sums(opened(shared), batches)), "centroid int, slot int, total long")
    found = sums.groupBy("centroid", "slot").agg(F.sum("total").alias("total")).toArrow()
    shared.destroy()
    totals = np.zeros((len(model.languages), DIMENSIONS + 1))
    totals[found.column("centroid").to_numpy(), found.column("slot").to_numpy() + 1] = found.column("total").to_numpy()
    left = np.flatnonzero(totals[:, 0])
    centroids = totals[left, 1:]
    centroids /= np.maximum(np.linalg.norm(centroids, axis=1), 1e-12)[:, None]
    return model._replace(centroids=centroids.astype(np.float32), languages=[model.languages[j] for j in left])


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", clusters: int = CLUSTERS, rounds: int = ROUNDS) -> Model:
    rows = in_small_batches(labelled).select(named(lang_col).cast("string").alias("lang"), text_of(text_col)).filter("lang is not null and text is not null")
    sums = rows.select("lang", "text").mapInArrow(lean(_frequencies), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    frequencies: dict[str, np.ndarray] = {lang: np.zeros(DIMENSIONS + 1) for lang in sorted(sums.column("lang").unique().to_pylist())}
    for lang, own in frequencies.items():
        part = sums.filter(pc.equal(sums.column("lang"), lang))
        own[part.column("slot").to_numpy() + 1] = part.column("n").to_numpy()
    df = sum(frequencies.values(), np.zeros(DIMENSIONS + 1))
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype(np.float32)
    centroids = [np.zeros((0, DIMENSIONS), np.float32), *(_directions(own[1:] * idf, clusters) for own in frequencies.values())]
    model = Model(idf, np.concatenate(centroids), [lang for lang in frequencies for _ in range(clusters)], np.zeros(OCTAVES))
    if not frequencies:
        return model
    for _ in range(rounds):
        model = _next(rows, model)
    shared = share(labelled.sparkSession, model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in scan.pieces(batch, "text"):
                _, score, octaves = nearest(piece.column("text"), opened(shared))
                bits = (score + 0.0).astype(np.float32).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(octaves.astype(np.int32)), pa.array(bits)], ["octave", "bits"]).filter(pa.array(has_letter(piece.column("text"))))

    bounds = _bounds(rows.select("text").mapInArrow(lean(judged), "octave int, bits int"))
    shared.destroy()
    return model._replace(bounds=bounds)


def _predicted(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """own (a struct of the kept columns, by default all but the text), text, lang, score (cosine, 0 to 1) and rejected."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    shared = share(df.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(shared)
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            for piece in scan.pieces(batch, "text"):
                column = piece.column("text")
                known = has_letter(column) & (len(m.languages) > 0)
                best, score, far = np.full(len(known), len(m.languages)), np.zeros(len(known)), ~known
                if known.any():
                    place, cosine, octaves = nearest(column, m)
                    best, score = np.where(known, place, best), np.where(known, cosine, score)
                    far |= score < m.bounds[octaves]
                yield pa.RecordBatch.from_arrays([piece.column("own"), column, pa.array(names[best], pa.string()), pa.array(score), pa.array(far)], ["own", "text", "lang", "score", "rejected"])

    rows = in_small_batches(df).select(own(keep), text_of(text_col))
    return rows.mapInArrow(lean(run), with_own(df, keep, "text string, lang string, score double, rejected boolean"))


def predict(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "__lang", score_col: str = "__score", rejected_col: str = "__rejected") -> DataFrame:
    """Adds (or replaces) the language, its score and whether the text is rejected."""
    found = _predicted(df, model, text_col)
    made = {lang_col: "lang", score_col: "score", rejected_col: "rejected"}
    back = dict(zip(df.columns, restored(df, df.columns, **{text_col: F.col("text")}), strict=True))
    return found.select(*(x for c, x in back.items() if c not in made), *(F.col(x).alias(c) for c, x in made.items()))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(named(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that are not rejected, unchanged; learned from the rows that aren't held out."""
    model = train(docs.filter(~held_out(id_col)), text_col, lang_col)
    return _predicted(docs, model, text_col).filter("not rejected").select(*restored(docs, docs.columns, **{text_col: F.col("text")}))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = _predicted(docs, train(docs.filter(~held_out())), keep=["doc_id"])
    rows = found.select(F.col("own.c0").cast("long").alias("doc_id"), F.col("lang").alias("lang_pred"), "score", "rejected")
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
