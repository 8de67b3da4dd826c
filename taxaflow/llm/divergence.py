"""How the sources of a language differ in their words, by a minimal acyclic transducer of each language's kept terms.

Terms that enough documents of a language hold are put in order and cut into ranges; of each range a task builds the minimal acyclic
transducer, whose outputs add up to a term's place in the order. Texts are then read once more and recounted through the transducers: what
leaves a task is ordinals with counts. Ordinals break ties, as their order is the terms' own, and the few terms reported are spelt from them.

Shares are whole numbers, so sums are exact. The gap of two sources over all terms is that of a term that neither has, times their number,
and what the terms that either has add to that; the latter is summed in blocks of sources and terms.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_broadcast, forget, saved

MIN_DOCUMENTS, TOP_TERMS, SCALE, ADDED = 30, 50, 1_000_000_000, 5
#: Terms of one transducer, and bytes of transducers that a pass over the texts takes along: beyond, there are more passes.
SHARD_TERMS, PASS_BYTES = 100_000, 48 << 20
#: Sources and terms in a block of gaps, and statistics of groups (a row each) up to which they are broadcast.
SOURCE_BLOCK, TERM_BLOCK, MAX_BROADCAST_GROUPS = 64, 512, 200_000
#: Bytes as they stand in terms: ASCII letters in lower case, all but letters below 128 a space.
_AS_TERM = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and of whatever lies beyond ASCII, in UTF-8, A-Z in lower case."""
    return text.translate(_AS_TERM).split()


class Transducer:
    """A minimal acyclic automaton with outputs that add up to a term's ordinal. Edges are sorted by state and byte."""

    def __init__(self, edges: np.ndarray, targets: np.ndarray, outputs: np.ndarray, final: np.ndarray):
        self.edges, self.targets, self.outputs, self.final = edges, targets, outputs, final

    @classmethod
    def build(cls, ordered: list[bytes]) -> Transducer:
        """From different terms in order. A term's states beyond what the next one shares with it are final, and equal ones become one."""
        known: dict[tuple, int] = {}  # (final, edges) of each finished state
        finished: list[tuple[bool, tuple, int]] = []  # final, edges (byte, state), terms below

        def finish(state: list) -> int:
            key = (state[0], tuple(state[1]))
            if key not in known:
                known[key] = len(finished)
                finished.append((*key, state[0] + sum(finished[t][2] for _, t in state[1])))
            return known[key]

        path: list[list] = [[False, []]]  # open states along the last term
        last = b""
        for term in ordered:
            shared = 0
            while shared < len(last) and shared < len(term) and last[shared] == term[shared]:
                shared += 1
            for k in range(len(last), shared, -1):
                path[k - 1][1].append((last[k - 1], finish(path.pop())))
            path += [[False, []] for _ in term[shared:]]
            path[-1][0] = True
            last = term
        for k in range(len(last), 0, -1):
            path[k - 1][1].append((last[k - 1], finish(path.pop())))
        top = finish(path[0])
        number = lambda s: 0 if s == top else s + 1  # noqa: E731  the first state is 0
        rows = []
        for s, (final, edges, _) in enumerate(finished):
            out = int(final)
            for byte, t in edges:
                rows.append(((number(s) << 8) | byte, number(t), out))
                out += finished[t][2]
        rows.sort()
        cols = np.array(rows, np.int64).reshape(-1, 3)
        final = np.zeros(len(finished) + 1, bool)
        final[[number(s) for s, x in enumerate(finished) if x[0]]] = True
        return cls(cols[:, 0].copy(), cols[:, 1].astype(np.int32), cols[:, 2].astype(np.int32), final)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.edges), len(self.final)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.edges, self.targets, self.outputs, self.final))

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        n, m = np.frombuffer(data, np.int64, 2)
        at = lambda kind, k, count: np.frombuffer(data, kind, count, 16 + k)
        return cls(at(np.int64, 0, n), at(np.int32, 8 * n, n), at(np.int32, 12 * n, n), at(bool, 16 * n, m))

    def ordinals(self, words: list[bytes]) -> np.ndarray:
        """The ordinal of each word, -1 if it isn't a term; all words go one byte further at once."""
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        state, out, found = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        live, k = np.arange(len(words)), 0
        while len(live) and len(self.edges):
            ended = size[live] == k
            done = live[ended]
            found[done] = np.where(self.final[state[done]], out[done], -1)
            live = live[~ended]
            key = (state[live] << 8) | data[start[live] + k]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            ok = self.edges[at] == key
            live, at = live[ok], at[ok]
            state[live], out[live] = self.targets[at], out[live] + self.outputs[at]
            k += 1
        return found

    def term(self, ordinal: int) -> bytes:
        """The term of an ordinal: from each state by the last edge whose output isn't beyond what is left."""
        state, word = 0, bytearray()
        while not (ordinal == 0 and self.final[state]):
            a, b = np.searchsorted(self.edges, (state << 8, (state + 1) << 8))
            at = a + int(np.searchsorted(self.outputs[a:b], ordinal, "right")) - 1
            word.append(int(self.edges[at]) & 255)
            state, ordinal = int(self.targets[at]), ordinal - int(self.outputs[at])
        return bytes(word)


def _held_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, documents of the batch that hold it)."""
    for b in batches:
        held: defaultdict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            held[lang].update(set(terms(text.as_py())))
        for lang, c in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["lang", "term", "n"])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transducers of at most SHARD_TERMS sorted terms of one language each."""
    lang, ordered = None, []

    def built() -> pa.RecordBatch:
        made = Transducer.build(ordered).to_bytes()
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([ordered[0]], pa.binary()), pa.array([len(ordered)], pa.int64()), pa.array([made], pa.binary())], names=["lang", "first", "n", "made"])

    for b in batches:
        for of, term in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if ordered and (of != lang or len(ordered) == SHARD_TERMS):
                yield built()
                ordered = []
            lang = of
            ordered.append(term)
    if ordered:
        yield built()


class Shards:
    """Transducers of ranges of terms, each with its first term and how many come before it in its language."""

    def __init__(self, rows: list[tuple[str, bytes, int, int, bytes]]):
        self.of: defaultdict[str, list] = defaultdict(list)
        for lang, first, before, n, made in sorted(rows, key=lambda r: (r[0], r[1])):
            self.of[lang].append((first, before, n, Transducer.from_bytes(made)))

    def ordinals(self, lang: str, ordered: list[bytes]) -> np.ndarray:
        """Ordinals of sorted words within the language, -1 for those that these transducers don't hold."""
        out = np.full(len(ordered), -1, np.int64)
        shards = self.of.get(lang, [])
        cuts = [bisect_left(ordered, s[0]) for s in shards] + [len(ordered)]
        for (_, before, _, made), a, b in zip(shards, cuts, cuts[1:], strict=False):
            found = made.ordinals(ordered[a:b])
            out[a:b] = np.where(found >= 0, found + before, -1)
        return out

    def term(self, lang: str, ordinal: int) -> bytes | None:
        return next((made.term(ordinal - before) for _, before, n, made in self.of.get(lang, []) if before <= ordinal < before + n), None)


def _recount(shared):
    """(lang, source, ord, n) of a batch: each different term runs through the transducers once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(shared.value)
        for b in batches:
            counts: defaultdict[tuple[str, str], Counter] = defaultdict(Counter)
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
                counts[lang, source].update(terms(text.as_py()))
            for lang in {k[0] for k in counts}:
                own = {s: c for (of, s), c in counts.items() if of == lang}
                words = sorted(set().union(*own.values()))
                place = dict(zip(words, shards.ordinals(lang, words).tolist(), strict=True))
                for source, c in own.items():
                    rows = [(o, n) for w, n in c.items() if (o := place[w]) >= 0]
                    ords, ns = zip(*rows, strict=True) if rows else ((), ())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array([source] * len(rows), pa.string()), pa.array(ords, pa.int64()), pa.array(ns, pa.int64())], names=["lang", "source", "ord", "n"])

    return run


def _spell(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(shared.value)
        for b in batches:
            words = [shards.term(lang, o) for lang, o in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            kept = pa.array([w is not None for w in words])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([w and w.decode() for w in words], pa.string())], names=["lang", "ord", "source", "value", "rank", "item"]).filter(kept)

    return run


def kept_terms(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, term) of docs(lang, source, text): terms, as UTF-8, that at least so many rows of the language hold."""
    held = docs.select("lang", "text").mapInArrow(_held_terms, "lang string, term binary, n long")
    return held.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_documents).select("lang", "term")


def transducers(kept: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, first, before, n, made): a transducer for each range of kept terms; `before` counts the language's terms in front of it."""
    n = max(1, -(-kept.count() // shard_terms))
    made = saved(kept.repartitionByRange(n, "lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_build, "lang string, first binary, n long, made binary"), "transducers")
    before = F.coalesce(F.sum("n").over(W.partitionBy("lang").orderBy("first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return made.join(made.select("lang", "first", "n").select("lang", "first", before.alias("before")), ["lang", "first"])


def _passes(shards: DataFrame, max_bytes: int) -> list[list[tuple]]:
    """Keys of shards in groups whose transducers take at most `max_bytes` together, or one larger shard."""
    groups, held = [[]], 0
    for r in shards.select("lang", "first", F.length("made").alias("size")).orderBy("lang", "first").toLocalIterator():
        if groups[-1] and held + r["size"] > max_bytes:
            groups.append([])
            held = 0
        groups[-1].append((r["lang"], bytes(r["first"])))
        held += r["size"]
    return groups


def _share(n: str, total: str, terms_: str) -> Column:
    """1 + floor(SCALE (n + ADDED) / (total + ADDED terms)), in whole numbers."""
    return F.expr(f"1 + ((cast({n} as decimal(20,0)) + {ADDED}) * {SCALE}) div (cast({total} as decimal(20,0)) + {ADDED} * {terms_})").cast("long")


def _block_gaps(rows: pd.DataFrame) -> pd.DataFrame:
    """What a block's terms add to each pair of its sources, beyond terms that neither has. Rows without a term bring their source in."""
    a, b, lang = rows["a"].iloc[0], rows["b"].iloc[0], rows["lang"].iloc[0]
    sources, seen, place = np.unique(rows["no"].to_numpy(), return_index=True, return_inverse=True)
    mine = rows["mine"].to_numpy()[seen]
    none = rows["p0"].to_numpy()[seen]
    there = rows["ord"].to_numpy() >= 0
    words, at = np.unique(rows["ord"].to_numpy()[there], return_inverse=True)
    p = np.repeat(none[:, None], len(words), 1)
    p[place[there], at] = rows["p"].to_numpy()[there]
    first, second = [], []
    gaps = []
    for i, s in enumerate(sources):
        if mine[i] == a:
            others = np.flatnonzero((mine == b) & (sources > s))
            gaps.append(np.abs(p[i] - p[others]).sum(1) - len(words) * np.abs(none[i] - none[others]))
            first.append(np.full(len(others), s))
            second.append(sources[others])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pd.DataFrame({"lang": lang, "no1": join(first), "no2": join(second), "gap": join(gaps)})


def source_divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS, shard_terms: int = SHARD_TERMS, pass_bytes: int = PASS_BYTES, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank). Part `pair`: the gap to each other source of the language, all ranks; part `term`: the terms
    of which a source has more than its language, the first `top`.

    Null text, lang and source are empty; an empty text has no terms, but its source is there. Repeated rows are documents of their own.
    Ties are in the order of the items' UTF-8. Texts are read whole whatever their length, one batch at a time. A language without kept terms
    has gaps of 0 and no terms; an empty table gives no rows. Extra columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    kept = saved(kept_terms(rows, min_documents), "kept-terms")
    shards = saved(transducers(kept, shard_terms), "transducers")
    forget(kept)
    sizes = shards.groupBy("lang").agg(F.sum("n").alias("v"))
    groups = [g for g in _passes(shards, pass_bytes) if g]
    parts, shared = [], []
    for g in groups:
        lo, hi = g[0], g[-1]  # a run of shards in their order
        key = F.struct("lang", "first")
        held = shards.where((key >= F.struct(F.lit(lo[0]), F.lit(bytearray(lo[1])))) & (key <= F.struct(F.lit(hi[0]), F.lit(bytearray(hi[1])))))
        shared.append(spark.sparkContext.broadcast([(r["lang"], bytes(r["first"]), r["before"], r["n"], bytes(r["made"])) for r in held.collect()]))
        parts.append(rows.mapInArrow(_recount(shared[-1]), "lang string, source string, ord long, n long"))
    empty = spark.createDataFrame([], "lang string, source string, ord long, n long")
    found = empty
    for part in parts:
        found = found.unionByName(part)
    counts = saved(found.groupBy("lang", "source", "ord").agg(F.sum("n").alias("n")), "term-counts")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    stats = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "v"])
    # Without kept terms no share is asked for.
    none = F.when(F.col("v") > 0, _share("0", "total", "nullif(v, 0)"))
    stats = saved(stats.select("*", none.alias("p0"), (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("no")), "source-shares")
    small = bounded_broadcast(stats, MAX_BROADCAST_GROUPS)
    shares = counts.join(small, ["lang", "source"]).select("lang", "source", "no", "ord", "p0", _share("n", "total", "v").alias("p"))
    # Terms of which a source has more than its language.
    whole = counts.groupBy("lang", "ord").agg(F.sum("n").alias("n"))
    of_lang = stats.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v"))
    whole = whole.join(bounded_broadcast(of_lang, MAX_BROADCAST_GROUPS), "lang").select("lang", "ord", _share("n", "total", "v").alias("q"))
    more = shares.join(whole, ["lang", "ord"]).where("p > q").select("lang", "ord", "source", (F.col("p") - F.col("q")).alias("value"))
    ranked = more.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "ord"))).where(F.col("rank") <= top)
    ranked = saved(ranked, "top-terms")
    columns = ["lang", "source", F.lit("term").alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")]
    out = None
    for s in shared:
        spelt = ranked.mapInArrow(_spell(s), "lang string, ord long, source string, value long, rank int, item string").select(*columns)
        out = spelt if out is None else out.unionByName(spelt)
    # Gaps of pairs of sources.
    blocks = stats.groupBy("lang").agg((F.floor(F.max("no") / SOURCE_BLOCK) + 1).alias("blocks"))
    mine = F.floor(F.col("no") / SOURCE_BLOCK)
    # Each source takes part in every block of its language's terms, whether it has one of them or not.
    every = stats.where("v > 0").select("lang", "no", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("v") - 1) / TERM_BLOCK))).alias("block"), F.lit(-1).cast("long").alias("ord"), "p0", F.col("p0").alias("p"))
    dealt = shares.select("lang", "no", F.floor(F.col("ord") / TERM_BLOCK).alias("block"), "ord", "p0", "p").unionByName(every)
    dealt = dealt.join(bounded_broadcast(blocks, MAX_BROADCAST_GROUPS), "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("lang", F.least(mine, "other").alias("a"), F.greatest(mine, "other").alias("b"), "block", mine.alias("mine"), "no", "ord", "p", "p0")
    gaps = dealt.groupBy("lang", "a", "b", "block").applyInPandas(_block_gaps, "lang string, no1 long, no2 long, gap long").groupBy("lang", "no1", "no2").agg(F.sum("gap").alias("gap"))
    side = lambda k: stats.select("lang", F.col("no").alias(f"no{k}"), F.col("source").alias(f"source{k}"), F.col("p0").alias(f"none{k}"), *(["v"] if k == 1 else []))
    pairs = side(1).join(side(2), "lang").where("no1 < no2").join(gaps, ["lang", "no1", "no2"], "left")  # every pair of a language's sources is a result
    value = F.coalesce(F.col("v") * F.abs(F.col("none1") - F.col("none2")), F.lit(0)) + F.coalesce("gap", F.lit(0))
    pairs = pairs.select("lang", value.alias("value"), F.explode(F.array(F.struct(F.col("source1").alias("source"), F.col("source2").alias("item")), F.struct(F.col("source2").alias("source"), F.col("source1").alias("item")))).alias("x"))
    pairs = pairs.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return pairs if out is None else pairs.unionByName(out)
