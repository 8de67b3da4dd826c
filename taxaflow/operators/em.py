"""Abundances from ambiguous hits by expectation maximisation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.shared import bounded_broadcast, forget, saved

#: Abundances (a row for each sample and taxon) up to which they are broadcast to the hits.
MAX_BROADCAST_ABUNDANCES = 2_000_000
#: The least that an extrapolated share may be of the plain one.
LEAST_SHARE = 0.01
#: Hits of a sample up to which all its rounds run in one task, about as many hits in a block of such samples, and larger samples that are
#: broadcast.
SAMPLE_HITS, BLOCK_HITS, MAX_BROADCAST_SAMPLES = 1 << 20, 1 << 20, 1_000_000


def _kinds(hits: DataFrame) -> DataFrame:
    """(sample, h, n, kind): reads of a sample with the same hits as one row with their number. A read's hits are one row, as they are few."""
    of_read = hits.groupBy("sample", "read_id").agg(F.max("loglik").alias("top"), F.sort_array(F.collect_list(F.struct("taxon_id", "loglik"))).alias("h"))
    of_read = of_read.select("sample", F.transform("h", lambda x: F.struct(x["taxon_id"].alias("taxon_id"), F.exp(x["loglik"] - F.col("top")).alias("l"))).alias("h"))
    return of_read.groupBy("sample", "h").agg(F.count("*").alias("n")).withColumn("kind", F.monotonically_increasing_id())


class _Block:
    """Hits of whole samples as arrays, and their rounds. A kind without hits counts among its sample's reads only."""

    def __init__(self, rows: pa.Table):
        taxa, ls = (rows[c].combine_chunks() for c in ("taxa", "ls"))
        coded = lambda x: (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).dictionary_encode()
        samples, named = coded(rows["sample"]), coded(taxa.flatten())
        self.samples, self.taxa = samples.dictionary, named.dictionary
        self.n = rows["n"].to_numpy().astype(np.float64)
        hits = taxa.value_lengths().to_numpy(zero_copy_only=False)
        self.has, self.kind, self.l = hits > 0, np.repeat(np.arange(len(hits)), hits), ls.flatten().to_numpy(zero_copy_only=False)
        self.sample_of_kind = samples.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        keys, self.at = np.unique(self.sample_of_kind[self.kind] * max(1, len(self.taxa)) + named.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        self.of, self.taxon = np.divmod(keys, max(1, len(self.taxa)))
        self.reads = np.bincount(self.sample_of_kind, self.n, len(self.samples))[self.of]

    def by_sample(self, x):
        return np.bincount(self.of, x, len(self.samples))

    def round_of(self, f):
        """The next abundances, and the log likelihood of those given by sample."""
        w = f[self.at] * self.l
        total = np.where(self.has, np.bincount(self.kind, w, len(self.n)), 1.0)
        new = np.bincount(self.at, w * (self.n / total)[self.kind], len(f)) / self.reads
        return new, np.bincount(self.sample_of_kind, self.n * np.log(total), len(self.samples))

    def run(self, cycles: int, gains: list[float]):
        """Abundances after the plain rounds of cycle number `cycles`; `gains` gets the most that a sample gained in each cycle."""
        f = 1 / self.by_sample(None)[self.of]
        while True:
            one, then = self.round_of(f)
            two, now = self.round_of(one)
            gains.append(float((now - then).max()))
            if len(gains) == cycles:
                return two
            r, v = one - f, two - 2 * one + f
            r_size, v_size = np.sqrt(self.by_sample(r * r)), np.sqrt(self.by_sample(v * v))
            a = np.maximum(np.divide(r_size, v_size, out=np.ones_like(r_size), where=v_size > 0), 1)[self.of]
            g = np.maximum(f + 2 * a * r + a * a * v, two * LEAST_SHARE)
            three, far = self.round_of(g / self.by_sample(g)[self.of])
            f = np.where((far >= now)[self.of], three, two)


def _gains(cycles: int):
    def run(rows: pa.Table) -> pa.Table:
        gains: list[float] = []
        _Block(rows).run(cycles, gains)
        return pa.table({"cycle": pa.array(range(1, cycles + 1), pa.int32()), "gain": pa.array(gains, pa.float64())})

    return run


def _abundances(cycles: int):
    def run(rows: pa.Table) -> pa.Table:
        block = _Block(rows)
        return pa.table({"sample": block.samples.take(pa.array(block.of)), "taxon_id": block.taxa.take(pa.array(block.taxon)), "value": pa.array(block.run(cycles, []), pa.float64())})

    return run


def _by_joins(kinds: DataFrame, tol: float, max_rounds: int, most: dict[int, float]) -> tuple[int, DataFrame]:
    """The number of cycles and the abundances of samples of any size; `most` has what other samples gain at most in each cycle."""
    like = kinds.select("sample", "kind", "n", F.inline("h"))
    reads = kinds.groupBy("sample").agg(F.sum("n").alias("reads"))
    taxa = like.select("sample", "taxon_id").distinct()
    k = taxa.groupBy("sample").agg((1 / F.count("*")).alias("f"))
    f = saved(taxa.join(k, "sample").select("sample", "taxon_id", "f"), "abundances")
    small = f.limit(MAX_BROADCAST_ABUNDANCES + 1).count() <= MAX_BROADCAST_ABUNDANCES
    near = F.broadcast if small else lambda df: df
    done, cycle = 0, 0

    def round_of(f: DataFrame) -> DataFrame:
        """(sample, taxon_id, f, ll): the next abundances, and parts of the log likelihood of those given, which add up to it by sample."""
        nonlocal done
        done += 1
        joint = like.join(near(f.select("sample", "taxon_id", "f")), ["sample", "taxon_id"]).select("sample", "kind", "n", "taxon_id", (F.col("f") * F.col("l")).alias("w"))
        total = joint.groupBy("sample", "kind").agg(F.sum("w").alias("t"), F.first("n").alias("n"), F.collect_list(F.struct("taxon_id", "w")).alias("of"))
        part = total.select("sample", "n", "t", F.posexplode("of").alias("at", "x")).select("sample", "x.taxon_id", "n", "t", "x.w", "at")
        ll = F.sum(F.when(F.col("at") == 0, F.col("n") * F.log("t")).otherwise(0.0)).alias("ll")
        new = part.groupBy("sample", "taxon_id").agg(F.sum(F.col("n") * F.col("w") / F.col("t")).alias("s"), ll).join(near(reads), "sample")
        return saved(new.select("sample", "taxon_id", (F.col("s") / F.col("reads")).alias("f"), "ll"), "abundances")

    fit = lambda t, name: t.groupBy("sample").agg(F.sum("ll").alias(name))
    while True:
        one = round_of(f)
        two = round_of(one)
        gain = fit(two, "now").join(fit(one, "then"), "sample").agg(F.max(F.col("now") - F.col("then")).alias("gain")).first()["gain"]
        cycle += 1
        if max((x for x in (gain, most.get(cycle)) if x is not None), default=0.0) < tol or done + 1 > max_rounds:
            break
        both = f.select("sample", "taxon_id", F.col("f").alias("f0")).join(one.select("sample", "taxon_id", F.col("f").alias("f1")), ["sample", "taxon_id"])
        both = both.join(two.select("sample", "taxon_id", F.col("f").alias("f2")), ["sample", "taxon_id"])
        both = both.select("*", (F.col("f1") - F.col("f0")).alias("r"), (F.col("f2") - 2 * F.col("f1") + F.col("f0")).alias("v"))
        size = both.groupBy("sample").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("r_size"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("v_size"))
        # A step of at least 1 is what two plain rounds make; shares stay above 0 and are made to add up again.
        step = size.select("sample", F.greatest(F.coalesce(F.col("r_size") / F.nullif("v_size", F.lit(0.0)), F.lit(1.0)), F.lit(1.0)).alias("a"))
        far = both.join(near(step), "sample").withColumn("g", F.greatest(F.col("f0") + 2 * F.col("a") * F.col("r") + F.col("a") * F.col("a") * F.col("v"), F.col("f2") * LEAST_SHARE))
        far = far.join(near(far.groupBy("sample").agg(F.sum("g").alias("all"))), "sample")
        far = saved(far.select("sample", "taxon_id", (F.col("g") / F.col("all")).alias("f")), "abundances")
        three = round_of(far)
        better = fit(three, "far").join(fit(two, "near"), "sample").select("sample", (F.col("far") >= F.col("near")).alias("better"))
        last = f
        f = two.select("sample", "taxon_id", F.col("f").alias("f2")).join(three.select("sample", "taxon_id", F.col("f").alias("f3")), ["sample", "taxon_id"]).join(near(better), "sample")
        f = saved(f.select("sample", "taxon_id", F.when(F.col("better"), F.col("f3")).otherwise(F.col("f2")).alias("f")), "abundances")
        for t in (last, one, two, far, three):
            forget(t)
    for t in (f, one):
        forget(t)
    return cycle, two.select("sample", "taxon_id", F.col("f").alias("value"))


def em_abundance(hits: DataFrame, tol: float = 0.01, max_rounds: int = 60, rounds: list[int] | None = None, sample_hits: int | None = None) -> DataFrame:
    """(sample, taxon_id, value) from hits(sample, read_id, taxon_id, loglik).

    E: P(t | r) is proportional to f(t) exp(loglik); M: f(t) is the mean of P over the sample's reads. After two such rounds each sample's
    shares are carried on by squared extrapolation: with r the first change and v what the second differs from it, to f - 2 a r + a^2 v with
    a = -|r| / |v|; a third round starts there. A sample whose likelihood is less there than before goes on from its second round, so it
    never falls. Ends when no sample's log likelihood gains `tol` in a plain round. `rounds`, if given, gets their number.

    Samples share nothing but that end. Those of up to `sample_hits` hits go to blocks of samples, and a block's rounds run where it is: once
    for the most that a sample gains in each of all possible rounds, and once more up to the end. Larger samples are spread: a round is a
    join and two aggregates over all their hits, saved in the shared folder.
    """
    limit = SAMPLE_HITS if sample_hits is None else sample_hits
    kinds = saved(_kinds(hits), "hits")
    sizes = saved(kinds.groupBy("sample").agg(F.sum(F.size("h")).alias("hits")).where("sample is not null"), "sizes")
    total = sizes.agg(F.coalesce(F.sum(F.when(F.col("hits") <= limit, F.col("hits"))), F.lit(0)).alias("small"), F.count_if(F.col("hits") > limit).alias("large")).first()
    few = bounded_broadcast(sizes.where(F.col("hits") > limit).select(F.col("sample").alias("of")), MAX_BROADCAST_SAMPLES)
    if not total["small"]:
        cycle, out = _by_joins(kinds, tol, max_rounds, {})
    else:
        # Enough blocks to fill the tasks; a block's samples come together by a hash.
        n_blocks = max(-(-total["small"] // BLOCK_HITS), int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        small = kinds.where("sample is not null")
        small = small.join(few, F.col("sample") == F.col("of"), "left_anti") if total["large"] else small
        known = F.filter("h", lambda x: x["taxon_id"].isNotNull() & x["l"].isNotNull())
        small = small.select(F.pmod(F.xxhash64("sample"), F.lit(n_blocks)).cast("int").alias("block"), "sample", "n", known.alias("h"))
        blocks = small.select("block", "sample", "n", F.col("h.taxon_id").alias("taxa"), F.col("h.l").alias("ls")).groupBy("block")
        last = max_rounds // 3 + 1  # the cycle in which max_rounds ends the work
        found = blocks.applyInArrow(_gains(last), "cycle int, gain double").groupBy("cycle").agg(F.max("gain").alias("gain"))
        most = {r["cycle"]: r["gain"] for r in found.collect()}  # a row for each cycle
        cycle = next((k for k in range(1, last) if most[k] < tol), last)
        out = None
        if total["large"]:
            cycle, out = _by_joins(kinds.join(few, F.col("sample") == F.col("of"), "left_semi"), tol, max_rounds, most)
        kind = lambda c: hits.schema[c].dataType.simpleString()
        near = blocks.applyInArrow(_abundances(cycle), f"sample {kind('sample')}, taxon_id {kind('taxon_id')}, value double")
        out = near if out is None else near.unionByName(out)
    if rounds is not None:
        rounds.append(3 * cycle - 1)
    return out
