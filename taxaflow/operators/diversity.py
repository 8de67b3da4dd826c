"""Alpha and beta diversity on long abundances; distances are rows (a, b, d) with a before b."""

from __future__ import annotations

from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaflow.shared import saved

from .abundance import to_relative


def alpha(ab: DataFrame, base: float | None = None) -> DataFrame:
    """Observed richness, Chao1, Shannon and Simpson of each sample in one aggregate.

    Shannon is ln N - sum(x ln x) / N, so no second pass is needed for shares; `base` changes its logarithm. A value that makes a
    measure NaN is an error when the rows are read.
    """
    x = F.col("value")
    pos = ab.where(x > 0)
    a = pos.groupBy("sample").agg(
        F.count("*").alias("observed"), F.count_if(x == 1).alias("f1"), F.count_if(x == 2).alias("f2"), F.sum(x).alias("n"), F.sum(x * F.log(x)).alias("xlx"), F.sum(x * x).alias("xx")
    )
    f1, f2 = F.col("f1").cast("double"), F.col("f2").cast("double")
    unit = 1.0 if base is None else F.log(F.lit(float(base)))
    out = a.select(
        "sample", "observed",
        (F.col("observed") + F.when(f2 > 0, f1 * f1 / F.nullif(2 * f2, F.lit(0.0))).otherwise(f1 * (f1 - 1) / 2)).alias("chao1"),
        ((F.log("n") - F.col("xlx") / F.col("n")) / unit).alias("shannon"),
        (1 - F.col("xx") / (F.col("n") * F.col("n"))).alias("simpson"),
    )
    number = ~F.isnan("chao1") & ~F.isnan("shannon") & ~F.isnan("simpson")
    return out.where(F.assert_true(F.coalesce(number, F.lit(True)), F.concat(F.lit("alpha diversity is NaN in "), F.col("sample").cast("string"))).isNull())


def alpha_with_group(ab: DataFrame, groups: DataFrame) -> DataFrame:
    return alpha(ab).join(groups, "sample", "left")


def sample_pairs(samples: DataFrame) -> DataFrame:
    """(a, b) with a < b. Pairs of samples are the result's own size; taxa never take part here."""
    s = samples.select("sample").distinct()
    return s.select(F.col("sample").alias("a")).join(s.select(F.col("sample").alias("b")), F.col("a") < F.col("b"))


#: Values of a that meet one b after the other in `cross_pairs`. A multiple of 8, so that their packed places in a Parquet dictionary end at a byte.
PAIR_BLOCK = 256


#: Samples of a side in a tile, at most. A task has some 2^28 pairs then, and its samples stay far from what a Parquet dictionary holds.
TILE_SIDE = 1 << 14


def tiles(tasks: int, n_a: int, n_b: int) -> tuple[int, int]:
    """Parts of a and of b whose pairs of parts are `tasks`, or few more: a task more than there are cores would be a second wave."""
    root = isqrt(tasks)
    parts = max(range(root // 2 + 1, root + 1), key=lambda p: (-(-tasks % p), p))
    return max(parts, ceil(n_a / TILE_SIDE)), max(ceil(tasks / parts), ceil(n_b / TILE_SIDE))


def cross_pairs(samples1: DataFrame, samples2: DataFrame) -> DataFrame:
    """Ordered pairs (a, b) of two studies' different samples.

    The pairs are the result's own size, so each task makes a tile of them; only samples are shuffled. In a tile a block of a's meets one b
    after the other: b comes in runs and a repeats within what a page's compression sees, so files of pairs are small. The samples are
    counted at once, and tiles are of a bounded size whatever the number of shuffle partitions.
    """
    a, b = (t.select(F.col("sample").alias(s)).distinct() for t, s in ((samples1, "a"), (samples2, "b")))
    n = a.agg(F.count("*").alias("a")).crossJoin(b.agg(F.count("*").alias("b"))).first()
    parts_a, parts_b = tiles(int(samples1.sparkSession.conf.get("spark.sql.shuffle.partitions")), n["a"], n["b"])
    a = a.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(parts_a)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("a")) - 1
    blocks = a.withColumn("block", F.floor(place / PAIR_BLOCK)).groupBy("part", "block").agg(F.collect_list("a").alias("block_of_a")).select("block_of_a")
    # Dealt evenly to numbers of tasks of their own, and no broadcast: the samples are few and their pairs many, so sizes don't tell how much
    # work a task has.
    met = blocks.repartition(parts_a).hint("shuffle_replicate_nl").crossJoin(b.repartition(parts_b))
    return met.select(F.explode("block_of_a").alias("a"), "b").where(F.col("a") != F.col("b"))


#: Samples in a block. A taxon's rows meet in pairs of blocks, so a taxon that all samples have is spread over many tasks.
SAMPLE_BLOCK = 256


def dealt_to_blocks(ab1: DataFrame, ab2: DataFrame | None = None, keys: tuple[str, ...] = ("taxon_id",)) -> tuple[DataFrame, DataFrame]:
    """(taxon_id, i, j, a, x) and (taxon_id, i, j, b, y): the rows of two sides dealt to pairs of sample blocks.

    Within one table a pair of blocks comes once, i up to j; between two tables all pairs of blocks come. Rows meet in `keys`.
    """
    other = ab1 if ab2 is None else ab2
    samples = ab1.select("sample") if ab2 is None else ab1.select("sample").union(ab2.select("sample"))
    blocks = samples.agg(F.ceil(F.count_distinct("sample") / SAMPLE_BLOCK).cast("int").alias("blocks"))  # one row
    own = F.pmod(F.xxhash64("sample"), F.greatest("blocks", F.lit(1))).cast("int")

    def side(t: DataFrame, name: str, value: str, left: bool) -> DataFrame:
        t = t.select(F.col("sample").alias(name), *keys, F.col("value").alias(value), "sample").crossJoin(F.broadcast(blocks)).withColumn("own", own).drop("sample")
        last = F.greatest(F.col("blocks") - 1, F.lit(0))
        rest = F.sequence(F.lit(0), last) if ab2 is not None else F.sequence("own", last) if left else F.sequence(F.lit(0), F.col("own"))
        t = t.withColumn("rest", F.explode(rest)).withColumnsRenamed({"own": "i" if left else "j", "rest": "j" if left else "i"}).drop("blocks")
        # A number of tasks of its own: the rows are few and their pairs many, so sizes don't tell how much work a task has.
        return t.repartition(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "i", "j")

    return side(ab1, "a", "x", True), side(other, "b", "y", False)


def _shared(ab1: DataFrame, ab2: DataFrame | None, *terms, keys: tuple[str, ...] = ("taxon_id",)) -> DataFrame:
    """Sums, in which x and y can change places, over the taxa that two samples share: pairs a < b of a table, or all pairs with another's.

    What a pair of blocks shares in a taxon is combined by pair of samples at once, before its shuffle.
    """
    left, right = dealt_to_blocks(ab1, ab2, keys)
    met = left.join(right, [*keys, "i", "j"])
    if ab2 is not None:
        return met.groupBy("a", "b").agg(*terms)
    met = met.where((F.col("i") < F.col("j")) | (F.col("a") < F.col("b")))
    return met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(*terms)


def _pairs(ab: DataFrame, *terms: Column, other: DataFrame | None = None) -> DataFrame:
    """(a, b, each term as name_a and name_b): pairs a < b of samples, or all pairs with another study's, with sums over each sample.

    The sums are a row for each sample; they make the list of pairs too, so the abundances are read once for both.
    """
    return _pairs_of(_sums(ab, *terms), None if other is None else _sums(other, *terms))


def _sums(ab: DataFrame, *terms: Column) -> DataFrame:
    return ab.groupBy("sample").agg(*terms)


def _pairs_of(sums: DataFrame, other: DataFrame | None = None) -> DataFrame:
    side = lambda t, s: t.select(F.col("sample").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in t.columns if c != "sample"])
    a, b = side(sums, "a"), side(sums if other is None else other, "b")
    return a.join(b, F.col("a") < F.col("b")) if other is None else a.crossJoin(b)


def _bray(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    out = pairs.join(shared, ["a", "b"], "left")
    total = F.col("s_a") + F.col("s_b")
    return out.select("a", "b", F.when(total > 0, 1 - 2 * F.coalesce("m", F.lit(0.0)) / F.nullif(total, F.lit(0.0))).otherwise(0.0).alias("d"))


def bray_curtis(ab: DataFrame) -> DataFrame:
    """1 - 2 sum(min) / (Sa + Sb), 0 for two empty samples; pairs that share nothing come from the list of pairs."""
    return _bray(_pairs(ab, F.sum("value").alias("s")), _shared(ab, None, F.sum(F.least("x", "y")).alias("m")))


def bray_curtis_within(ab: DataFrame, classes: DataFrame) -> DataFrame:
    """`bray_curtis` of the pairs of one class only; classes(sample, class), a class for each sample, and samples without one are left out.

    Samples meet in their class's taxa alone. The abundances are saved, as both sides of the meeting, the sums and the blocks read them.
    """
    if not classes.groupBy("sample").count().where("count > 1").isEmpty():
        raise ValueError("a sample has more than one class")
    own = saved(ab.join(classes, "sample").select("sample", "class", "taxon_id", "value"), "class-abundances")
    pairs = _pairs_of(_sums(own, F.sum("value").alias("s"), F.first("class").alias("class"))).where("class_a = class_b")
    return _bray(pairs, _shared(own, None, F.sum(F.least("x", "y")).alias("m"), keys=("taxon_id", "class")))


def jaccard(ab: DataFrame, mode: str = "presence") -> DataFrame:
    """1 - shared / union on presence, 1 for two empty samples; mode "value": a taxon with different values isn't shared."""
    pos = ab.where(F.col("value") > 0)
    ones = F.count("*").alias("s") if mode == "presence" else F.count_if(F.col("x") == F.col("y")).alias("s")
    shared = _shared(pos, None, ones, F.count("*").alias("both"))
    out = _pairs(ab, F.count_if(F.col("value") > 0).alias("n")).join(shared, ["a", "b"], "left")
    union = F.col("n_a") + F.col("n_b") - F.coalesce("both", F.lit(0))
    return out.select("a", "b", F.when(union > 0, 1 - F.coalesce("s", F.lit(0)) / F.nullif(union, F.lit(0))).otherwise(1.0).alias("d"))


def bray_and_jaccard(ab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`bray_curtis` and `jaccard` on presence from one meeting of the samples."""
    pos = ab.where(F.col("value") > 0)
    met = saved(_shared(pos, None, F.sum(F.least("x", "y")).alias("m"), F.count("*").alias("both")), "shared-taxa")
    sums = saved(_sums(ab, F.sum("value").alias("s"), F.count_if(F.col("value") > 0).alias("n")), "sums")
    out = saved(_pairs_of(sums).join(met, ["a", "b"], "left"), "pairs")
    total, both = F.col("s_a") + F.col("s_b"), F.coalesce("both", F.lit(0))
    union = F.col("n_a") + F.col("n_b") - both
    bray = F.when(total > 0, 1 - 2 * F.coalesce("m", F.lit(0.0)) / F.nullif(total, F.lit(0.0))).otherwise(0.0)
    return out.select("a", "b", bray.alias("d")), out.select("a", "b", F.when(union > 0, 1 - both / F.nullif(union, F.lit(0))).otherwise(1.0).alias("d"))


def clr(ab: DataFrame) -> DataFrame:
    """ln(x + 1) less its mean over all taxa of the table, for each sample and taxon of the table."""
    taxa = ab.select("taxon_id").distinct()
    d = taxa.agg(F.count("*").alias("d"))
    mean = ab.groupBy("sample").agg(F.sum(F.log1p("value")).alias("s")).crossJoin(F.broadcast(d)).select("sample", (F.col("s") / F.col("d")).alias("mean"))
    full = mean.crossJoin(taxa)  # the dense table is what is asked for: samples x taxa
    return full.join(ab, ["sample", "taxon_id"], "left").select("sample", "taxon_id", (F.log1p(F.coalesce("value", F.lit(0.0))) - F.col("mean")).alias("clr"))


def aitchison(ab: DataFrame) -> DataFrame:
    """Euclidean distance of CLR values without the dense table: with L = ln(x + 1), d2 = sum La2 + sum Lb2 - 2 sum La Lb - D (ma - mb)2."""
    lx = ab.select("sample", "taxon_id", F.log1p("value").alias("value"))
    d = ab.agg(F.count_distinct("taxon_id").cast("double").alias("d"))
    shared = _shared(lx, None, F.sum(F.col("x") * F.col("y")).alias("xy"))
    out = _pairs(lx, F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).join(shared, ["a", "b"], "left").crossJoin(F.broadcast(d))
    gap = (F.col("s_a") - F.col("s_b")) / F.col("d")
    square = F.col("q_a") + F.col("q_b") - 2 * F.coalesce("xy", F.lit(0.0)) - F.col("d") * gap * gap
    return out.select("a", "b", F.sqrt(F.greatest(square, F.lit(0.0))).alias("d"))


METRICS = {"bray": bray_curtis, "jaccard": jaccard, "jaccard_value": lambda ab: jaccard(ab, "value"), "aitchison": aitchison}


def beta(ab: DataFrame, metric: str, relative: bool = False) -> DataFrame:
    """Distances by name; `relative`: values become shares first."""
    if metric not in METRICS:
        raise ValueError(f"metric is one of {', '.join(METRICS)}")
    return METRICS[metric](to_relative(ab) if relative else ab)


def to_square(distances: DataFrame, samples: list[str] | None = None) -> DataFrame:
    """The full symmetric table with a zero diagonal; for sinks."""
    both = distances.union(distances.select("b", "a", "d"))
    own = both.select("a").distinct().select("a", F.col("a").alias("b"), F.lit(0.0).alias("d"))
    return both.union(own).groupBy("a").pivot("b", samples).agg(F.first("d"))


def bc_between(ab1: DataFrame, ab2: DataFrame) -> DataFrame:
    """Bray-Curtis between each sample of one study and each of another on shares, and whether it's the same sample."""
    r1, r2 = to_relative(ab1), to_relative(ab2)
    shared = _shared(r1, r2, F.sum(F.least("x", "y")).alias("m"))
    out = _pairs(r1, F.sum("value").alias("s"), other=r2).join(shared, ["a", "b"], "left")
    return out.select("a", "b", (F.col("a") == F.col("b")).alias("same"), (1 - 2 * F.coalesce("m", F.lit(0.0)) / (F.col("s_a") + F.col("s_b"))).alias("d"))
