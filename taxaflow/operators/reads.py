"""Operators on reads(sample, read_id, read_ord, seq, qual): filters, statistics, cleaning funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaflow.functions import sequence as S
from taxaflow.shared import not_empty


def drop_empty(reads: DataFrame) -> DataFrame:
    return reads.where(F.length("seq") > 0)


#: Groups that a sample is dealt into before its first rows are chosen.
SPREAD = 64


def first_rows(rows: DataFrame, n: int | Column, by: str, order: list[Column]) -> DataFrame:
    """The n smallest rows of each `by` in an order that has no ties.

    Only the order's own columns move: the first n of each of `SPREAD` groups, then the first n of those; the last of them is a bound that
    goes to the rows where they are. No task holds a sample, and no read is shuffled.
    """
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    keys = rows.select(F.col(by).alias("of"), key.alias("key"), F.lit(n).alias("n") if isinstance(n, int) else n.alias("n"))
    rank = lambda *g: F.row_number().over(W.partitionBy(*g).orderBy("key"))
    some = keys.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(SPREAD))).withColumn("r", rank("of", "g")).where("r <= n")
    last = some.withColumn("r", rank("of")).where("r <= n").groupBy("of").agg(F.max("key").alias("last"))
    return rows.join(last, F.col(by).eqNullSafe(F.col("of"))).where(key <= F.col("last")).drop("of", "last")


def first_reads(reads: DataFrame, n: int, by: str = "sample") -> DataFrame:
    """The first n non-empty reads of each file."""
    return first_rows(drop_empty(reads), n, by, [F.col("read_ord"), F.col("read_id")])


def count_reads(reads: DataFrame, by: str = "sample") -> DataFrame:
    return reads.groupBy(by).agg(F.count("*").alias("reads"))


def min_reads(reads: DataFrame, n: int = 500, required: bool = True) -> DataFrame:
    """The reads of samples that have n or more; an error if there is no such sample, unless none is required."""
    enough = count_reads(reads).where(F.col("reads") >= n)
    if required:
        not_empty(enough, f"no sample has {n} reads")
    return reads.join(enough, "sample", "left_semi")


def n50(reads: DataFrame, by: str = "sample", direction: str = "desc", length: Column | None = None) -> DataFrame:
    """(by, n50): the length at which the running sum of lengths reaches half the total.

    Lengths are counted first, so the window runs over the different lengths of a sample and not over its reads.
    """
    length = F.length("seq") if length is None else length
    counts = reads.groupBy(by, length.cast("long").alias("len")).agg(F.count("*").alias("n"))
    w = W.partitionBy(by)
    order = F.desc("len") if direction == "desc" else F.asc("len")
    run = counts.select(by, "len", F.sum(F.col("len") * F.col("n")).over(w.orderBy(order)).alias("cum"), F.sum(F.col("len") * F.col("n")).over(w).alias("total"))
    reached = run.where(F.col("cum") >= F.col("total") / 2)
    return reached.groupBy(by).agg((F.max if direction == "desc" else F.min)("len").alias("n50"))


def primer_share(reads: DataFrame, primers: list[str], window: int = 120, k: int = 2, scan: int = 10_000) -> DataFrame:
    """(sample, primer_pct): the share of the first `scan` reads with a primer near an end."""
    seen = first_reads(reads, scan)
    hit = S.primer_in_window(S.head_window(F.col("seq"), window), primers, k)
    tail = F.coalesce(S.primer_in_window(S.tail_window(F.col("seq"), window), primers, k), F.lit(False))
    return seen.groupBy("sample").agg(F.round(F.avg((hit | tail).cast("double")) * 100, 2).alias("primer_pct"))


def _half(cum: str, total: str) -> Column:
    return F.col(cum) >= F.col(total) / 2


def read_stats(reads: DataFrame, primers: list[str] | None = None, window: int = 120, k: int = 2, scan: int = 10_000, offset: int = S.OFFSET) -> DataFrame:
    """A row for each sample: counts, lengths, N50, GC, qualities, primers; empty reads don't count.

    Reads are added up by sample and length first, so N50 and the rest come from one pass, over the different lengths.
    """
    good = drop_empty(reads).select("sample", F.length("seq").cast("long").alias("len"), S.gc_count(F.col("seq")).alias("gc"), S.quality_sum(F.col("seq"), F.col("qual"), offset).alias("q"), S.read_mean_q(F.col("seq"), F.col("qual"), offset).alias("mq"))
    lens = good.groupBy("sample", "len").agg(F.count("*").alias("n"), F.sum("gc").alias("gc"), F.sum("q").alias("q"), F.min("mq").alias("lo"), F.max("mq").alias("hi"))
    w, bases = W.partitionBy("sample"), F.sum(F.col("len") * F.col("n"))
    lens = lens.withColumn("cum", bases.over(w.orderBy(F.desc("len")))).withColumn("total", bases.over(w))
    out = lens.groupBy("sample").agg(
        F.sum("n").alias("reads"), F.max("total").alias("bases"), F.round(F.max("total") / F.sum("n"), 2).alias("mean_length"),
        F.min("len").alias("min_length"), F.max("len").alias("max_length"),
        F.round(F.sum("gc") / F.max("total") * 100, 2).alias("gc_pct"), F.round(F.sum("q") / F.max("total"), 2).alias("mean_q"),
        F.round(F.min("lo"), 2).alias("min_q"), F.round(F.max("hi"), 2).alias("max_q"), F.max(F.when(_half("cum", "total"), F.col("len"))).alias("n50"),
    )
    return out.join(primer_share(reads, primers, window, k, scan), "sample", "left") if primers else out


def stage_stats(reads: DataFrame, by: str = "sample") -> DataFrame:
    """Counts, lengths (halves to even), ascending N50 and the mean Q of the mean error probability; one pass, as in `read_stats`."""
    good = drop_empty(reads).select(by, F.length("seq").cast("long").alias("len"), S.error_sum(F.col("qual")).alias("err"), F.length("qual").alias("nq"))
    lens = good.groupBy(by, "len").agg(F.count("*").alias("n"), F.sum("err").alias("err"), F.sum("nq").alias("nq"))
    w = W.partitionBy(by)
    sums = {"cum": F.sum(F.col("len") * F.col("n")).over(w.orderBy("len")), "total": F.sum(F.col("len") * F.col("n")).over(w), "upto": F.sum("n").over(w.orderBy("len")), "reads": F.sum("n").over(w)}
    lens = lens.withColumns(sums)
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col("len")))
    middle = (at(F.floor((F.col("reads") + 1) / 2)) + at(F.floor(F.col("reads") / 2) + 1)) / 2
    return lens.groupBy(by).agg(
        F.max("reads").alias("reads"), F.max("total").alias("bases"), F.bround(F.max("total") / F.max("reads"), 0).cast("long").alias("mean_length"),
        F.bround(middle, 0).cast("long").alias("median_length"), S.phred_from_p(F.sum("err") / F.sum("nq")).alias("mean_q"),
        F.min(F.when(_half("cum", "total"), F.col("len"))).alias("n50"),
    )


def filter_reads(reads: DataFrame, min_len: int = 1000, max_len: int = 1700, min_mean_q: float = 8.0, min_accuracy_pct: float = 0.0) -> DataFrame:
    """Reads of an inclusive length range, a mean Q and a mean accuracy in percent."""
    length, n = F.length("seq"), F.length("qual")
    accuracy = F.when(n > 0, (1 - S.error_sum(F.col("qual")) / n) * 100)
    out = reads.where(length.between(min_len, max_len) & (S.read_mean_q(F.col("seq"), F.col("qual")) >= min_mean_q))
    return out.where(accuracy >= min_accuracy_pct) if min_accuracy_pct else out


def orient_and_trim(reads: DataFrame, forward: str, reverse: str, window: int = 120, k: int = 2, min_len: int = 50, min_mean_q: float = 0.0) -> DataFrame:
    """Reads turned to the forward strand and cut to what lies between the primers, with `status` and `strand`.

    The forward primer is looked for in the head and the reverse primer's complement in the tail, on the read and on its complement; the
    first strand with both wins. Status: low quality, unclassified (no strand has both), too short, else classified.
    """
    after_forward = lambda s: S.find_pattern(S.head_window(s, window), forward, k) + len(forward)
    back = reverse[::-1].translate(str.maketrans("ACGTN", "TGCAN"))
    tail_start = lambda s: F.greatest(F.length(s) - window, F.lit(0))
    before_reverse = lambda s: S.find_pattern(F.substring(s, tail_start(s) + 1, F.lit(window)), back, k, last=True) + tail_start(s)
    cut = reads.withColumn("plus", F.upper("seq")).withColumn("minus", S.revcomp(F.col("seq")))
    for strand in ("plus", "minus"):
        cut = cut.withColumn(f"{strand}_from", after_forward(F.col(strand))).withColumn(f"{strand}_to", before_reverse(F.col(strand)))
    on = lambda s: F.col(f"{s}_from").isNotNull() & F.col(f"{s}_to").isNotNull() & (F.col(f"{s}_to") >= F.col(f"{s}_from"))
    cut = cut.withColumn("strand", F.when(on("plus"), "+").when(on("minus"), "-"))
    size = F.when(F.col("strand") == "+", F.col("plus_to") - F.col("plus_from")).when(F.col("strand") == "-", F.col("minus_to") - F.col("minus_from"))
    start = F.when(F.col("strand") == "+", F.col("plus_from")).otherwise(F.col("minus_from"))
    cut = cut.withColumn("size", size).withColumn("start", start)
    status = F.when(S.read_mean_q(F.col("seq"), F.col("qual")) < min_mean_q, "low quality").when(F.col("strand").isNull(), "unclassified").when(F.col("size") < min_len, "too short").otherwise("classified")
    whole = F.when(F.col("strand") == "-", F.col("minus")).otherwise(F.col("plus"))
    turned = F.when(F.col("strand") == "-", F.reverse("qual")).otherwise(F.col("qual"))
    done = F.col("strand").isNotNull()
    return cut.select(
        "sample", "read_id", "read_ord", status.alias("status"), "strand",
        F.when(done, F.substring(whole, F.col("start"), F.col("size"))).otherwise(F.col("seq")).alias("seq"),
        F.when(done, F.substring(turned, F.col("start"), F.col("size"))).otherwise(F.col("qual")).alias("qual"),
    )


def funnel(reads: DataFrame, oriented: Column, kept: Column) -> DataFrame:
    """Counts of a cleaning by sample: raw, oriented, kept, with removal per step and in all, for reads and bases. One pass."""
    oriented, kept = F.coalesce(oriented, F.lit(False)), F.coalesce(kept, F.lit(False))
    out = reads.groupBy("sample").agg(
        F.count("*").alias("reads_raw"), F.count_if(oriented).alias("reads_oriented"), F.count_if(oriented & kept).alias("reads_final"),
        F.sum(F.length("seq")).cast("long").alias("bases_raw"), F.sum(F.when(oriented & kept, F.length("seq")).otherwise(0)).cast("long").alias("bases_final"),
    )
    return out.select(
        "*", S.pct_removed(F.col("reads_raw"), F.col("reads_oriented")).alias("pct_removed_oriented"), S.pct_removed(F.col("reads_raw"), F.col("reads_final")).alias("pct_removed_final"),
        S.pct_kept(F.col("reads_raw"), F.col("reads_final")).alias("pct_kept"), S.pct_removed(F.col("bases_raw"), F.col("bases_final")).alias("pct_removed_bases"),
    )


def funnel_long(counts: DataFrame) -> DataFrame:
    """(sample, bucket, count) of a funnel."""
    return counts.unpivot("sample", ["reads_raw", "reads_oriented", "reads_final"], "bucket", "count")


def sample_reads(reads: DataFrame, total: int = 120_000, n_samples: int | None = None, seed: int = 42) -> DataFrame:
    """An equal number of reads of each sample, total // n_samples, in the order of a seeded hash."""
    n = reads.select("sample").distinct().count() if n_samples is None else n_samples
    order = F.md5(F.concat_ws("-", F.lit(seed), F.col("read_id")).cast("binary"))
    return first_rows(reads, total // max(1, n), "sample", [order, F.col("read_id")])


def best_file(files: DataFrame, run: str = "run", path: str = "path", clean_mark: str = "clean") -> DataFrame:
    """One file for each run: a cleaned one first, then the shortest name, then by alphabet."""
    key = F.struct((~F.lower(path).contains(clean_mark)).alias("raw"), F.length(path).alias("n"), F.col(path).alias("p"))
    return files.groupBy(run).agg(F.min(key)["p"].alias(path))


def run_yield(summary: DataFrame, interval: str = "1 hour", min_q: float = 10.0) -> DataFrame:
    """Reads, bases, mean Q and length, pass and fail, by barcode and tumbling window; also on a stream with a watermark on ts."""
    out = summary.groupBy(F.window("ts", interval).alias("w"), "barcode").agg(
        F.count("*").alias("reads"), F.sum("length").alias("bases"), F.avg("mean_q").alias("mean_q"), F.avg("length").alias("mean_length"),
        F.count_if(F.col("mean_q") >= min_q).alias("passed"), F.count_if(F.col("mean_q") < min_q).alias("failed"),
    )
    return out.select(F.col("w.start").alias("window_start"), "barcode", "reads", "bases", "mean_q", "mean_length", "passed", "failed")
