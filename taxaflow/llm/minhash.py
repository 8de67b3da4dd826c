"""Near copies by the segment-popcount join of SimHash fingerprints, MinHash bands for what differs more, and the exact Jaccard similarity.

A text is its set of shingles; texts with equal sets are one node. Nodes whose fingerprints the segment-popcount join puts in one class
share a cell. Two texts of similarity 0.8 differ in about 10 of the 64 bits, more than that grid can look around, so nodes that agree in
a band of minima share a cell too: a pair of similarity s shares one of `BANDS` bands of `ROWS` minima with probability
1 - (1 - s^ROWS)^BANDS, which is 0.9998 at 0.8. What shares a cell is compared on the sets themselves, in blocks of bounded size: links
come out, never the pairs that aren't any.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, connected_components, decisions, saved
from .simhash import NO_ID, drop_near_duplicates, fingerprint, fingerprint_components, numbered, shingle_hashes

SHINGLE, SIMILARITY, BANDS, ROWS, SEED = 5, 0.8, 28, 6, 42
#: Nodes of a block, and shingles in it; cells up to which what is known of them is broadcast.
BLOCK, BLOCK_SHINGLES, MAX_BROADCAST_CELLS = 128, 1 << 20, 400_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hashed_sets(texts: pa.Array, shingle: int, seed: int):
    import numpy as np
    import xxhash

    raw = texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())
    for t in raw:
        h = np.unique(shingle_hashes(t.as_py() or b"", shingle, seed))
        yield h, _signed(xxhash.xxh64_intdigest(h.tobytes(), seed))


def _arrow_bands(shingle: int, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np
    import xxhash

    rng = np.random.default_rng(seed)
    times, plus = (rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
    times |= np.uint64(1)

    def bands(h) -> list[int]:
        if not len(h):
            return []
        least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
        for i in range(0, len(h), 1024):
            least = np.minimum(least, (times * h[None, i : i + 1024] + plus).min(axis=1))
        raw = least.tobytes()
        return [_signed(xxhash.xxh64_intdigest(raw[8 * ROWS * k : 8 * ROWS * (k + 1)], k)) for k in range(BANDS)]

    for b in batches:
        found = [(value, len(h), _signed(fingerprint(h)), bands(h)) for h, value in _hashed_sets(b.column(1), shingle, seed)]
        values, sizes, fps, cells = zip(*found, strict=True) if found else ((), (), (), ())
        numbers = [pa.array(x, pa.int64()) for x in (values, sizes, fps)]
        yield pa.RecordBatch.from_arrays([b.column(0), *numbers, pa.array(cells, pa.list_(pa.int64()))], names=["doc_id", "value", "size", "fp", "bands"])


def _arrow_sets(shingle: int, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for b in batches:
        sets, values = zip(*_hashed_sets(b.column(0), shingle, seed), strict=True) if b.num_rows else ((), ())
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        flat = pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["value", "shingles"])


def _shared(a: list, b: list):
    """How many shingles each of the sets `a` shares with each of `b`, by products of their incidence matrices, some columns at a time."""
    import numpy as np

    if len(a) * len(b) <= 8:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a])
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.float32)

    def places(sets: list, flat):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        column = np.searchsorted(both, flat)
        known = column < len(both)
        known[known] = both[column[known]] == flat[known]
        order = np.argsort(column[known], kind="stable")
        return row[known][order], column[known][order]

    (row_a, col_a), (row_b, col_b) = places(a, flat_a), places(b, flat_b)
    for lo in range(0, len(both), 4096):
        parts = []
        for sets, row, column in ((a, row_a, col_a), (b, row_b, col_b)):
            at = slice(*np.searchsorted(column, (lo, lo + 4096)))
            m = np.zeros((len(sets), min(4096, len(both) - lo)), np.float32)
            m[row[at], column[at] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _arrow_links(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, i, j, side, node, class, shingles), a block's together, to the different pairs of classes that are linked in it."""
    import numpy as np

    def rows():
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in range(6)), strict=True))
            sets = b.column(6)
            for k, key in enumerate(keys):
                yield *key, sets[k].values.to_numpy()

    for _, block in groupby(rows(), key=lambda r: r[:3]):
        sides: tuple[list, list] = ([], [])
        for r in block:
            sides[r[3]].append(r[4:])
        if not (sides[0] and sides[1]):
            continue
        (node_a, class_a, a), (node_b, class_b, b) = (tuple(zip(*x, strict=True)) for x in sides)
        size = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None]
        shared = _shared(a, b)
        i, j = np.nonzero((100 * shared >= percent * (size - shared)) & (np.array(class_a)[:, None] != np.array(class_b)[None]))
        found = sorted({(class_a[x], class_b[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)})
        if found:
            u, v = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def linked_classes(a: DataFrame, b: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(u, v): pairs of classes that a node of `a` and one of `b` link in a cell. a, b: (cell, node, class, size); sets: (of_node, shingles).

    Each side of a cell is cut into blocks by a hash of the node; each block of one side meets each of the other, in a task of its own
    key, so a large cell is spread out and a task holds two blocks.
    """

    def blocks(x: DataFrame, name: str) -> DataFrame:
        n = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES))
        return x.groupBy(F.col("cell").alias(f"cell_{name}")).agg(n.cast("int").alias(name))

    counts = blocks(a, "n_a").join(blocks(b, "n_b"), F.col("cell_n_a") == F.col("cell_n_b")).select(F.col("cell_n_a").alias("of_cell"), "n_a", "n_b")
    counts = bounded_broadcast(saved(counts, "blocks"), MAX_BROADCAST_CELLS)
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def dealt(x: DataFrame, side: int, i: Column, j: Column) -> DataFrame:
        return x.join(counts, F.col("cell") == F.col("of_cell")).select("cell", i.alias("i"), j.alias("j"), F.lit(side).alias("side"), "node", "class")

    rows = dealt(a, 0, own("n_a"), every("n_b")).union(dealt(b, 1, every("n_a"), own("n_b")))
    rows = rows.join(sets, F.col("node") == F.col("of_node")).select("cell", "i", "j", "side", "node", "class", "shingles")
    rows = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side", "node")
    return rows.mapInArrow(partial(_arrow_links, round(100 * similarity)), "u long, v long")


def segment_cells(nodes: DataFrame) -> DataFrame:
    """(node, size, cell): nodes whose fingerprints the segment-popcount join puts in one class share a cell."""
    roots = fingerprint_components(saved(nodes.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints"))
    roots = roots.select(F.col("fp").alias("of_fp"), F.xxhash64("root", F.lit(BANDS)).alias("cell"))
    return nodes.join(roots, F.col("fp") == F.col("of_fp")).select("node", "size", "cell")


def band_cells(nodes: DataFrame) -> DataFrame:
    """(node, size, cell): a cell for each band of minima."""
    return nodes.select("node", "size", F.explode("bands").alias("cell"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for each row of `docs`: the smallest doc_id reachable by links of at least `similarity`, itself included.

    First the nodes of a cell are compared with its least and greatest (stars, so a dense group costs two rows a member). Then only those
    outside a cell's largest class are compared with the whole cell, and only links between different classes count. Texts of fewer
    words than a shingle are one shingle; null and empty texts are copies of each other. Repeated rows and null ids are as in
    `near_duplicates`. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    of = saved(rows.mapInArrow(partial(_arrow_bands, shingle, SEED), "doc_id long, value long, size long, fp long, bands array<long>"), "bands")
    nodes = saved(numbered(of, "value", *[F.first(c).alias(c) for c in ("size", "fp", "bands")]), "nodes")
    cells = segment_cells(nodes).union(band_cells(nodes))
    shared = decisions(cells.groupBy(F.col("cell").alias("of_cell")).agg(F.count("*").alias("n")).where("n > 1").select("of_cell", "n"), "shared-cells")
    close = saved(cells.join(shared, F.col("cell") == F.col("of_cell")).drop("of_cell"), "close")
    kinds = close.groupBy("cell").agg(F.max("n").alias("n"), F.min("node").alias("least"), F.max("node").alias("most"), F.bit_xor(F.xxhash64("node")).alias("who"))
    # Near copies share many cells: of cells with the same nodes one is enough.
    many = decisions(kinds.dropDuplicates(["n", "least", "most", "who"]).select(F.col("cell").alias("of_cell"), "least", "most"), "cells")
    members = saved(close.join(many, F.col("cell") == F.col("of_cell")).select("cell", "node", F.col("node").alias("class"), "size", "n", "least", "most"), "members")
    asked = decisions(members.select("node").distinct().join(nodes.select(F.col("node").alias("of_node"), "value"), F.col("node") == F.col("of_node")).select("of_node", F.col("value").alias("asked")), "asked")
    texts = rows.join(asked.select(F.col("of_node").alias("id")), F.col("doc_id") == F.col("id"), "left_semi").union(rows.where("doc_id is null"))
    sets = texts.select("text").mapInArrow(partial(_arrow_sets, shingle, SEED), "value long, shingles array<long>")
    sets = saved(sets.join(asked, F.col("value") == F.col("asked")).select("of_node", "shingles").dropDuplicates(["of_node"]), "sets")
    # The same two ends come in many cells: each node meets an end once.
    met = members.select(F.explode(F.array_distinct(F.array("least", "most"))).alias("cell"), "node", "class", "size").where("node <> cell").distinct()
    ends = members.where("node = least or node = most").select(F.col("node").alias("cell"), "node", "class", "size").distinct()
    first = connected_components(linked_classes(ends, met, sets, similarity)).select(F.col("node").alias("of_id"), F.col("root").alias("first"))
    tagged = members.where("n > 3").drop("class").join(first, F.col("node") == F.col("of_id"), "left").select("cell", "node", F.coalesce("first", "node").alias("class"), "size")
    tagged = saved(tagged, "classes")
    largest = tagged.groupBy("cell", "class").agg(F.count("*").alias("k")).groupBy(F.col("cell").alias("of_cell")).agg(F.max(F.struct("k", "class")).alias("x"), F.count("*").alias("classes"))
    largest = bounded_broadcast(saved(largest.where("classes > 1").select("of_cell", F.col("x.class").alias("largest")), "mixed"), MAX_BROADCAST_CELLS)
    mixed = tagged.join(largest, F.col("cell") == F.col("of_cell")).drop("of_cell")
    links = linked_classes(mixed.where("class <> largest"), mixed, sets, similarity)
    merged = connected_components(links).select(F.col("node").alias("of_class"), F.col("root").alias("second"))
    # A node is in the first classes, and a class in the second ones, only if it has a link.
    found = first.join(merged, F.col("first") == F.col("of_class"), "left").select("of_id", F.coalesce("second", "first").alias("root"))
    alone = merged.join(first, F.col("of_class") == F.col("of_id"), "left_anti").select(F.col("of_class").alias("of_id"), F.col("second").alias("root"))
    roots = nodes.select("value", "node").join(found.union(alone), F.col("node") == F.col("of_id"), "left").select(F.col("value").alias("of_value"), F.coalesce("root", "node").alias("root"))
    ids = roots.select("of_value", F.when(F.col("root") < NO_ID, F.col("root")).alias("component_id"))
    return of.select("doc_id", "value").join(ids, F.col("value") == F.col("of_value")).select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that have the smallest doc_id of their component, as in `drop_near_duplicates`."""
    return drop_near_duplicates(docs, near_copies, **options)
