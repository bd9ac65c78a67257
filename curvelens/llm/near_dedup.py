"""Operator 8, near duplicates: MinHash signatures in an LSH forest, links confirmed on full sets.

Text is lower-cased (A-Z only); words are [^\\x20\\x09-\\x0D]+. A document's set has its
distinct shingles of five words; with fewer words, the whole sequence is one; without words
the set is empty and linked with nothing. Two documents are linked if 100 * intersection >=
75 * union. Components of links are groups.

Plan. (1) One pass computes sets, a 128-bit key of each set, and 128 minima of it, of which low bits
are kept (a minimum's high bits are mostly zero, the more so the larger the set). Equal sets are one node
from here on, so thousands of copies cost one. (2) The forest: TREES orders of
the nodes, each sorted by DEPTH of the minima, dealt by range, so an order of any size and a
region of any size spread over tasks. Neighbours in an order with a long enough common prefix
are candidates, over the edges of batches and tasks too; the length asked for grows with the size of
the region (nodes that agree in the first minimum), as chance neighbours are many there. (3) In each region all nodes are also
compared with its centre, the node whose regions are largest: groups of near copies are stars
about a text they were made from, and neighbours alone would miss its links. Candidates that
few minima support are left. (4) Candidates with one centre are a family. A task confirms links
of a block of a family on the full sets: everyone with the centre, and those that are not
linked to it with all others. A family of more than BLOCK nodes or BLOCK_SHINGLES shingles is dealt
over several blocks that each get the centre; those not linked to it then visit the other blocks.
Texts are shuffled only if their node's bit is set in a map of the nodes in families.
(5) Components, by stars, in Spark.

Sets hold 64-bit hashes of shingles. Nothing is collected to the driver.

Defined results. Null doc_ids come after all others. Of equal rows one is kept. Rows with one
doc_id and different texts are judged each by its text. Other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvelens.llm import bytescan as scan
from curvelens.llm.common import NULL_ID, identity, in_small_batches, lean, merged, own, restored, stored, table, text_of, with_own
from curvelens.llm.components import components

SHINGLE = 5
#: Links are at 100 * intersection >= PERCENT * union.
PERCENT = 75
TREES = 32
DEPTH = 4
#: Least share of equal minima: with a region's centre, so that two nodes linked to each other
#: and one of them to the centre meet in its family (similarity 0.5 less the error), and with a neighbour.
CENTRE_SHARE, NEIGHBOUR_SHARE = 0.38, 0.58
#: Nodes, and shingles of all their sets, of a family that meet in one task.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
_MINIMA = TREES * DEPTH
#: Bytes kept of the first minimum of a tree, which names a region, and of each other one. Regions are shared
#: by chance once in 2^40 pairs, so that their number follows the nodes, not the square of them.
FIRST, OTHER = 5, 2
_PREFIX = FIRST + OTHER * (DEPTH - 1)
#: Bits of the map of nodes whose texts are needed: 2000 rows of 4 KB, which is 8 MB with what Spark adds (its table
#: doubles beyond). It does not grow with the input; the fuller it is, the more other texts are shuffled, too.
MARKS = 2000 << 15


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, their offsets, and word counts."""
    buf, offsets = scan.text_bytes(texts)
    buf = scan.lower_table()[buf]
    starts, ends, docs = scan.words(buf, offsets, scan.space_words())
    word_hashes = scan.span_hashes(buf, starts, ends)
    _, h, per = scan.window_hashes(word_hashes, docs, width)
    counts, sets = np.diff(docs), []
    for k, n in enumerate(counts.tolist()):
        if 0 < n < width:
            _, whole, _ = scan.window_hashes(word_hashes[docs[k] : docs[k + 1]], np.array([0, n]), n)
            sets.append(scan.mixed(whole + np.uint64(n)))
        else:
            sets.append(np.unique(h[per[k] : per[k + 1]]))
    return np.concatenate(sets) if sets else h, np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64), counts


def _factors() -> tuple[np.ndarray, np.ndarray]:
    seed = scan.mixed(np.arange(1, 2 * _MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seed[:_MINIMA] | np.uint64(1), seed[_MINIMA:]


def _low_bytes(minima: np.ndarray) -> np.ndarray:
    """A row of bytes for each set: by tree, the low FIRST bytes of its first minimum, and of its others the upper OTHER of these."""
    low = minima.view(np.uint8).reshape(len(minima), TREES, DEPTH, 8)[..., :FIRST]
    others = low[:, :, 1:, FIRST - OTHER :].reshape(len(minima), TREES, -1)
    return np.concatenate([low[:, :, 0], others], axis=2).reshape(len(minima), -1)


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multiply, add = _factors()
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for piece in scan.pieces(batch, "text"):
                column = piece.column("text")
                flat, offsets, _ = shingle_sets(column, width)
                sizes = np.diff(offsets)
                full = np.flatnonzero(sizes)
                minima = np.empty((len(full), _MINIMA), "<u8")
                for j in range(_MINIMA if len(full) else 0):
                    minima[:, j] = np.minimum.reduceat(flat * multiply[j] + add[j], offsets[:-1][full])
                minima = _low_bytes(minima)
                keys: list[bytes | None] = [None] * piece.num_rows
                signs: list[bytes | None] = [None] * piece.num_rows
                for k, i in enumerate(full.tolist()):
                    keys[i] = hashlib.blake2b(flat[offsets[i] : offsets[i + 1]].tobytes(), digest_size=16).digest()
                    signs[i] = minima[k].tobytes()
                packed = [None if x is None else pack.compress(x.encode()) for x in column.to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("own"), piece.column("id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary()), pa.array(packed, pa.binary())], ["own", "id", "n", "key", "sign", "packed"])

    return lean(run)


_PLACES = "region long, node long, beside long, common int, edge int, prefix binary"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one stretch of an order: each node with its region, the node after it and the length of their common prefix.

    Nodes alone in their region are left out. The first and the last row of the stretch come again with `edge`
    (even and odd numbers in the order of stretches) and their prefix, as their other neighbours are elsewhere.
    """
    part = TaskContext.get().partitionId()
    held = None

    def rows(region, node, beside, common) -> pa.RecordBatch:
        n = len(node)
        return pa.RecordBatch.from_arrays([pa.array(region), pa.array(node), pa.array(beside), pa.array(common, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["region", "node", "beside", "common", "edge", "prefix"])

    def regions(tree: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return (tree << 8 * FIRST) | (keys[:, :FIRST].astype(np.int64) << 8 * np.arange(FIRST)).sum(axis=1)

    def edge(number: int, tree: np.ndarray, keys: np.ndarray, node: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(regions(tree, keys)), pa.array([int(node)]), pa.array([-1]), pa.array([0], pa.int32()), pa.array([number], pa.int32()), pa.array([keys.tobytes()], pa.binary())], ["region", "node", "beside", "common", "edge", "prefix"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, _ = scan.text_bytes(batch.column("prefix"))
        keys = keys.reshape(-1, _PREFIX).copy()
        tree, node = batch.column("tree").to_numpy().astype(np.int64), batch.column("node").to_numpy()
        if held is None:
            yield edge(2 * part, tree[:1], keys[:1], node[0])
            shared = True  # with what may come before this stretch
        else:
            keys, tree, node, shared = np.concatenate([held[0], keys]), np.concatenate([held[1], tree]), np.concatenate([held[2], node]), held[3]
        same = np.logical_and.reduceat(keys[1:] == keys[:-1], [0, *range(FIRST, _PREFIX, OTHER)], axis=1)
        same = np.logical_and.accumulate(same, axis=1) & (tree[1:] == tree[:-1])[:, None]
        common = same.sum(axis=1)
        before = np.concatenate([[shared], common > 0])
        here = np.flatnonzero(before[:-1] | (common > 0))
        yield rows(regions(tree[here], keys[here]), node[here], np.where(common > 0, node[1:], -1)[here], common[here])
        held = keys[-1:], tree[-1:], node[-1:], bool(before[-1])
    if held is not None:
        keys, tree, node, _ = held
        yield rows(regions(tree, keys), node, np.array([-1]), np.array([0]))
        yield edge(2 * part + 1, tree, keys, node[0])


def _over_edges(edges: DataFrame) -> DataFrame:
    """The last node of each stretch with the first of the next one that has rows: two rows a task."""
    ahead = Window.orderBy("edge")
    after = {c: F.lead(c).over(ahead) for c in ("region", "node", "prefix")}
    pairs = edges.select("edge", "region", "node", "prefix", *(x.alias(f"next_{c}") for c, x in after.items())).filter("edge % 2 = 1 and next_region = region")
    parts = [F.when(F.substring("prefix", 1, k) == F.substring("next_prefix", 1, k), 1).otherwise(0) for k in range(FIRST, _PREFIX + 1, OTHER)]
    return pairs.select("region", "node", F.col("next_node").alias("beside"), sum(parts[1:], parts[0]).alias("common"))


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Share of equal minima, from one byte of each."""
    for batch in batches:
        if batch.num_rows:
            left, right = (scan.text_bytes(batch.column(c))[0].reshape(batch.num_rows, -1) for c in ("left", "right"))
            equal = (left == right).mean(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("centre"), batch.column("star"), pa.array((equal - 1 / 256) / (1 - 1 / 256))], ["node", "centre", "star", "share"])


def _open_sets(packed: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sets of compressed texts and their offsets, about a piece of texts at a time."""
    open_ = zstandard.ZstdDecompressor()
    flat, sizes, held, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], 0

    def flush() -> None:
        own, offsets, _ = shingle_sets(pa.array(held, pa.large_binary()), width)
        flat.append(own)
        sizes.append(np.diff(offsets))

    for batch in packed.chunks:
        for x in batch:
            held.append(open_.decompress(x.as_buffer()))
            size += len(held[-1])
            if size >= scan.PIECE_BYTES:
                flush()
                held, size = [], 0
    flush()
    return np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _roots(n: int):
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(x: int, y: int) -> None:
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)

    return root, join


def _confirm(group: pa.Table, percent: int, width: int) -> pa.Table:
    """Links of a block of one family: kind 0 centre, 1 member, 2 a visitor that was not linked in its own block.

    Gives an edge to the root of its part of the block for every node, and, as b = -1, the
    members not linked to the centre.
    """
    order = np.argsort(group.column("kind").to_numpy(), kind="stable")
    group = group.take(pa.array(order))
    node, kind = group.column("node").to_numpy(), group.column("kind").to_numpy()
    flat, offsets = _open_sets(group.column("packed"), width)
    sizes = np.diff(offsets)
    _, ids = np.unique(flat, return_inverse=True)
    here = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    members = np.flatnonzero(kind < 2)
    root, join = _roots(len(node))
    upto = int(offsets[len(members)])

    def linked(k: int) -> np.ndarray:
        own = ids[offsets[k] : offsets[k + 1]]
        here[own] = 1
        both = np.add.reduceat(here[ids[:upto]], offsets[: len(members)])
        here[own] = 0
        return np.flatnonzero(100 * both >= percent * (sizes[members] + sizes[k] - both))

    near = np.zeros(len(node), bool)
    if kind[0] == 0:
        for j in linked(0).tolist():
            join(0, j)
            near[j] = True
        near[0] = True
    visitors = (kind == 2).any()
    for k in range(len(node)):
        if kind[k] == 2 or not near[k] and not visitors:
            for j in linked(k).tolist():
                join(k, j)
    a, b = [], []
    for k in range(len(node)):
        if (r := root(k)) != k:
            a.append(int(node[k]))
            b.append(int(node[r]))
        if kind[k] == 1 and not near[k] and not visitors:
            a.append(int(node[k]))
            b.append(-1)
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _links(rows: DataFrame, nodes: DataFrame, percent: int, width: int, block: int) -> DataFrame:
    """Edges (a, b) between nodes, enough to connect whatever links connect."""
    signs = nodes.select("node", "sign")
    trees = signs.select("node", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "sign").select("tree", F.substring("sign", F.col("tree") * _PREFIX + 1, F.lit(_PREFIX)).alias("prefix"), "node")
    ordered = trees.repartitionByRange("tree", "prefix", "node").sortWithinPartitions("tree", "prefix", "node")
    found = stored(ordered.mapInArrow(lean(_neighbours), _PLACES), "places")
    places = found.filter("edge is null").select("region", "node", "beside", "common")

    sizes = places.groupBy("region").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stored(merged(places, sizes, "region"), "regions")
    asked = F.least(F.greatest(1 + F.ceil(F.log(F.col("size") / 8) / F.log(F.lit(4 / 3))), F.lit(1)), F.lit(DEPTH))
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = merged(members.select("region", "node"), weight, "node")
    centres = weighed.groupBy("region").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("top")).select("region", (-F.col("top.minus")).alias("centre"))
    star = merged(members.select("region", "node"), centres, "region").filter("node <> centre").select("node", "centre", F.lit(True).alias("star"))
    over = merged(_over_edges(found.filter("edge is not null")), sizes, "region")
    beside = members.filter("beside >= 0").unionByName(over).filter((F.col("common") > 0) & (F.col("common") >= asked))
    beside = beside.select(F.greatest("node", "beside").alias("node"), F.least("node", "beside").alias("centre"), F.lit(False).alias("star"))
    pairs = star.unionByName(beside).groupBy("node", "centre").agg(F.max("star").alias("star"))
    # one byte of each minimum is enough to tell near from far
    short = stored(signs.mapInArrow(lean(_bytes_of_minima), "node long, sign binary"), "signs")
    pairs = merged(merged(pairs, short.select("node", F.col("sign").alias("left")), "node"), short.select(F.col("node").alias("centre"), F.col("sign").alias("right")), "centre")
    pairs = stored(pairs.mapInArrow(lean(_shares), "node long, centre long, star boolean, share double"), "pairs")

    stars = pairs.filter(F.col("star") & (F.col("share") >= CENTRE_SHARE))
    main = stars.groupBy("node").agg(F.max_by("centre", F.struct("share", (-F.col("centre")).alias("minus"))).alias("main"))
    # neighbours that meet in a family anyway need no family of their own
    loose = pairs.filter(~F.col("star") & (F.col("share") >= NEIGHBOUR_SHARE)).select("node", "centre")
    loose = merged(merged(loose, main, "node", "left"), main.select(F.col("node").alias("centre"), F.col("main").alias("other")), "centre", "left")
    loose = loose.filter(~(F.coalesce(F.col("main"), F.col("node")) == F.coalesce(F.col("other"), F.col("centre"))))
    families = stored(stars.select("centre", "node").union(loose.select("centre", "node")).distinct(), "families")

    sized = merged(families, nodes.select("node", "n"), "node")
    blocks = sized.groupBy("centre").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = merged(families, blocks, "centre").select("centre", "node", "blocks", F.pmod(F.hash("node"), F.col("blocks")).alias("block"), F.lit(1).alias("kind"))
    heads = blocks.select("centre", F.col("centre").alias("node"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"))
    texts = rows.select(F.col("row").alias("node"), "packed")
    there = families.select("node").union(families.select("centre"))
    confirm = lambda group: _confirm(group, percent, width)
    seats = members.unionByName(heads)
    first = merged(seats, _marked(texts, there), "node").select("centre", "block", "node", "kind", "packed")
    found = stored(first.groupBy("centre", "block").applyInArrow(confirm, "a long, b long"), "links")
    edges = found.filter("b >= 0")
    if blocks.filter("blocks > 1").limit(1).count():
        alone = found.filter("b < 0").select(F.col("a").alias("node")).distinct()
        visits = merged(members.filter("blocks > 1"), alone, "node").select("centre", "node", F.col("block").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).filter("own <> block")
        seats = stored(members.filter("blocks > 1").select("centre", "node", "block", "kind").union(visits.select("centre", "node", "block", F.lit(2).alias("kind"))), "seats")
        more = merged(seats, _marked(texts, seats.select("node")), "node").select("centre", "block", "node", "kind", "packed")
        edges = edges.union(stored(more.groupBy("centre", "block").applyInArrow(confirm, "a long, b long"), "links").filter("b >= 0"))
    return edges


def _marked(texts: DataFrame, there: DataFrame) -> DataFrame:
    """The texts of these nodes, and some others: a node is known by its bit in a map of MARKS bits, which is broadcast."""
    place = F.pmod(F.xxhash64("node"), F.lit(MARKS)) + 1
    marks = there.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    near = texts.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(marks), "bucket")
    return near.filter(F.getbit(byte, (bit % 8).cast("int")) == 1).select("node", "packed")


def _bytes_of_minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            signs = scan.text_bytes(batch.column("sign"))[0].reshape(batch.num_rows, TREES, _PREFIX)
            last = signs[:, :, FIRST - 1 :: OTHER].reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.tobytes() for x in last], pa.binary())], ["node", "sign"])


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, percent: int = PERCENT, width: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """own (a struct of the kept columns, by default all but the text), id, n (set size), packed (the text, compressed), lead (smallest id of the group) and kept."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    side = in_small_batches(docs).select(own(keep), identity(id_col).alias("id"), text_of(text_col))
    signed = side.mapInArrow(_signatures(width), with_own(docs, keep, "id long, n long, key binary, sign binary, packed binary"))
    rows = stored(signed.withColumn("row", F.monotonically_increasing_id()), "signed")

    # signatures go along, as to fetch them afterwards would shuffle them for each use
    first = rows.filter("key is not null").groupBy("key").agg(F.min(F.struct("id", "row", "n", "sign")).alias("first"))
    first = stored(first.select("key", F.col("first.id").alias("first_id"), F.col("first.row").alias("node"), "first.n", "first.sign"), "nodes")
    linked = components(_links(rows, first.select("node", "n", "sign"), percent, width, block))
    label = merged(first.select("key", "first_id", "node"), linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lead = label.groupBy("component").agg(F.min(F.struct("first_id", "node")).alias("lead"))
    label = merged(label, lead, "component").select("key", F.col("lead.first_id").alias("lead"), F.col("lead.node").alias("lead_row"))
    out = merged(rows, label, "key", "left")
    return out.select("own", "id", "n", "packed", F.coalesce("lead", "id").alias("lead"), (F.coalesce("lead_row", "row") == F.col("row")).alias("kept"))


def digests(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    found = groups(docs, id_col, keep=[id_col], **options)
    return found.select(F.col("own.c0").cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("lead") < NULL_ID, F.col("lead")).alias("component_id"), "kept")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        texts = [None if x is None else open_.decompress(x).decode() for x in batch.column("packed").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(texts, pa.string())], ["own", "text"])


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The row with the smallest doc_id of each group; documents without words stay."""
    others = [c for c in docs.columns if c != text_col]
    kept = groups(docs, id_col, text_col, **options).filter("kept").select("own", "packed")
    return kept.mapInArrow(lean(_unpack), with_own(docs, others, "text string")).select(*restored(docs, docs.columns, **{text_col: F.col("text")}))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
