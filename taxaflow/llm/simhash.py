"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

Each 64-bit fingerprint maps to 32 counts, the set bits of its 2-bit segments. The Manhattan distance of two count vectors is at most
the Hamming distance of the fingerprints, so fingerprints within `max_bits` lie within `max_bits` in the embedding. The vector is cut
into `parts`; with r = max_bits // parts, some part of such a pair is within Manhattan distance r (here 1), and the join looks up the
grid cells within that distance in each part. Every candidate is verified on the fingerprints themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_DECISIONS, bounded_broadcast, connected_components, decisions, saved

MAX_BITS, SHINGLE, SEED = 4, 4, 42
#: 2-bit segments of each of the three parts: 11, 11 and 10.
PARTS = ((0, 11), (11, 22), (22, 32))
ODD = 0x5555555555555555


def shingle_hashes(data: bytes, shingle: int = SHINGLE, seed: int = SEED):
    """The hashes of the shingles of UTF-8 `data`, with repeats: A-Z lowered, words between ASCII white space."""
    import numpy as np
    import xxhash

    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    text, n = memoryview(b" ".join(words)), len(words)
    if n <= shingle:
        cuts = [(0, len(text))]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        cuts = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], seed) for a, b in cuts], np.uint64)


def fingerprint(h) -> int:
    """The unsigned fingerprint of shingles' hashes: bits that over half of them have; without any it is 0."""
    import numpy as np

    count = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        count += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view(np.uint64)[0])


def simhash(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of UTF-8 `data`, by its shingles with repeats."""
    return fingerprint(shingle_hashes(data, shingle, seed))


def _arrow_fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary() if pa.types.is_string(b.column(1).type) else pa.large_binary())
            out = [simhash(t.as_py() or b"", shingle, seed) for t in texts]
            signed = [x - (1 << 64) if x >> 63 else x for x in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signed, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of each row's whole text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_arrow_fingerprints(shingle, seed), "doc_id long, fp long")


def _long(bits: int) -> Column:
    """A literal of 64 bits as a signed long."""
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")


def _counts() -> Column:
    """The embedding, packed: two bits for each segment's count (one bit set: 01, both: 10)."""
    fp, next_bit = F.col("fp"), F.shiftrightunsigned("fp", 1)
    one = fp.bitwiseXOR(next_bit).bitwiseAND(_long(ODD))
    both = fp.bitwiseAND(next_bit).bitwiseAND(_long(ODD))
    return one.bitwiseOR(F.shiftleft(both, 1))


def _cell(lo: int, hi: int) -> Column:
    return F.col("c").bitwiseAND(_long(sum(3 << 2 * i for i in range(lo, hi))))


def _cells(fps: DataFrame) -> DataFrame:
    """A row for each fingerprint and part, with the grid cell it lies in."""
    cells = F.array(*[F.struct(F.lit(p).alias("part"), _cell(*x).alias("cell")) for p, x in enumerate(PARTS)])
    return fps.withColumn("c", _counts()).select(*fps.columns, F.inline(cells))


def _probes(fps: DataFrame) -> DataFrame:
    """For each fingerprint and part: its own cell (step 0), and each with one more bit in one segment (step 1).

    If two parts differ by one, one of the two is the other with one more, so no cells with one less are needed.
    """
    found = []
    for p, (lo, hi) in enumerate(PARTS):
        found.append(F.struct(F.lit(p).alias("part"), _cell(lo, hi).alias("cell"), F.lit(0).alias("step")))
        for i in range(lo, hi):
            count = F.shiftrightunsigned("c", 2 * i).bitwiseAND(F.lit(3))
            more = _cell(lo, hi).bitwiseXOR(F.when(count == 0, _long(1 << 2 * i)).otherwise(_long(3 << 2 * i)))
            found.append(F.when(count < 2, F.struct(F.lit(p).alias("part"), more.alias("cell"), F.lit(1).alias("step"))))
    out = fps.withColumn("c", _counts()).select(*fps.columns, F.explode(F.array(*found)).alias("x")).where("x is not null")
    return out.select(*fps.columns, "x.part", "x.cell", "x.step")


#: Nodes from here on stand for fingerprints that no row with an id has; ids must be smaller.
NO_ID = 1 << 62


def numbered(of: DataFrame, value: str, *more: Column) -> DataFrame:
    """(value, node, ..) of the different values in `of` (doc_id, value, ..): node is the smallest doc_id, or a number of its own from NO_ID on."""
    least = of.groupBy(value).agg(F.min("doc_id").alias("least"), *more)
    return least.withColumn("node", F.coalesce("least", F.lit(NO_ID) + F.monotonically_increasing_id())).drop("least")


def fingerprint_components(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, node, root) for different fingerprints `fps` (fp, node): the classes that links of at most `max_bits` differing bits make, each
    by its smallest node. Without a column `node` the fingerprints number themselves.

    First each fingerprint is tied to the smallest of its cell if that is a link (a star, so a dense group costs a row a member, not a row
    a pair). The range-join then emits only links between different classes so far, and the classes are merged along them.
    """
    if max_bits // len(PARTS) > 1:
        raise ValueError("the grid looks one step around a cell: max_bits must be under 6")
    if "node" not in fps.columns:
        fps = fps.withColumn("node", F.col("fp"))
    link = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits
    cells = _cells(fps)
    least = cells.groupBy("part", "cell").agg(F.min(F.struct("node", "fp")).alias("least")).select("part", "cell", F.col("least.node").alias("to"), F.col("least.fp").alias("fp_to"))
    stars = cells.join(least, ["part", "cell"]).where((F.col("node") != F.col("to")) & link("fp", "fp_to")).select(F.col("node").alias("u"), F.col("to").alias("v"))
    first = connected_components(stars).withColumnRenamed("node", "of_node")
    tagged = saved(fps.join(first, fps["node"] == first["of_node"], "left").select("fp", "node", F.coalesce("root", "node").alias("class")), "classes")
    a = _probes(tagged).select(F.col("fp").alias("a"), F.col("class").alias("class_a"), "part", "cell", "step")
    b = _cells(tagged).select(F.col("fp").alias("b"), F.col("class").alias("class_b"), "part", "cell")
    near = a.join(b, (a["part"] == b["part"]) & (a["cell"] == b["cell"]) & link("a", "b") & (F.col("class_a") != F.col("class_b")) & ((F.col("step") == 1) | (F.col("a") < F.col("b"))))
    merged = saved(connected_components(near.select(F.col("class_a").alias("u"), F.col("class_b").alias("v"))), "merged")
    # Classes that merge are as few as the links found; where their number is bounded, they go to the members.
    merged = bounded_broadcast(merged.select(F.col("node").alias("of_class"), F.col("root").alias("to")), MAX_BROADCAST_DECISIONS)
    return saved(tagged.join(merged, F.col("class") == F.col("of_class"), "left").select("fp", "node", F.coalesce("to", "class").alias("root")), "roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """A row for each row of `docs`: doc_id, fp, component_id (the smallest doc_id reachable by links, itself included).

    Null and empty texts have fingerprint zero and link like any other. Repeated rows each give a row. A null id takes part in links
    and gets the component of the others; a component of null ids only has a null component_id. An empty table gives no rows.
    Texts of any length are read whole. Extra columns are ignored, whatever their names.
    """
    of = saved(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    roots = fingerprint_components(saved(numbered(of, "fp"), "nodes"), max_bits)
    ids = roots.select(F.col("fp").alias("of_fp"), F.when(F.col("root") < NO_ID, F.col("root")).alias("component_id"))
    return of.join(ids, F.col("fp") == F.col("of_fp")).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, find: Callable[..., DataFrame] = near_duplicates, **options) -> DataFrame:
    """The rows of `docs` that have the smallest doc_id of their component; of rows that repeat an id, one stays.

    A row without id stays only if its component has no id at all, and then one of them.
    """
    found = saved(find(docs, **options).select("doc_id", "component_id"), "near-duplicates")
    losers = found.where("component_id is not null and not (doc_id <=> component_id)").select(F.col("doc_id").alias("__lost")).distinct()
    again = found.groupBy(F.col("doc_id").alias("__again")).agg(F.count("*").alias("n")).where("n > 1").select("__again")
    losers, again = decisions(losers, "losers"), decisions(again, "repeated-ids")
    kept = docs.join(losers, docs["doc_id"].eqNullSafe(losers["__lost"]), "left_anti")
    # Only ids that come more than once need their rows together; the other rows stay where they are.
    repeats = kept["doc_id"].eqNullSafe(again["__again"])
    return kept.join(again, repeats, "left_anti").union(kept.join(again, repeats, "left_semi").dropDuplicates(["doc_id"]))
