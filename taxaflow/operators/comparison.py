"""Comparison of two studies sample by sample, and the numbers behind its figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.functions.distributions import pearson_p
from taxaflow.shared import never_empty

from .abundance import mean_profile, to_relative
from .ranges import quantiles


def outer_profiles(ab1: DataFrame, ab2: DataFrame) -> DataFrame:
    """(sample, taxon_id, x, y): both studies' values, 0 where one lacks a taxon."""
    a = ab1.select("sample", "taxon_id", F.col("value").alias("x"))
    b = ab2.select("sample", "taxon_id", F.col("value").alias("y"))
    return a.join(b, ["sample", "taxon_id"], "full_outer").na.fill(0.0, ["x", "y"])


def common_taxa(m1: DataFrame, m2: DataFrame) -> DataFrame:
    """(taxon_id, mine, theirs) of taxa that both have."""
    return m1.select("taxon_id", F.col("mean").alias("mine")).join(m2.select("taxon_id", F.col("mean").alias("theirs")), "taxon_id")


def compare_means(ab1: DataFrame, ab2: DataFrame) -> DataFrame:
    """Both means on common taxa, their difference, in falling order of the first; that no taxon is common is an error when the rows are read."""
    both = never_empty(common_taxa(mean_profile(ab1), mean_profile(ab2)), "no taxon is common to both")
    return both.select("*", (F.col("mine") - F.col("theirs")).alias("delta"), F.abs(F.col("mine") - F.col("theirs")).alias("abs_delta")).orderBy(F.desc("mine"), "taxon_id")


def correlation(df: DataFrame, x: str, y: str, by: list[str] | None = None, with_p: bool = True) -> DataFrame:
    """(by, n, r, p) of two columns."""
    out = df.groupBy(*(by or [])).agg(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"), F.corr(x, y).alias("r"))
    return out.withColumn("p", pearson_p("r", "n")) if with_p else out


def pearson_by_rank(tables: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(statistic, one column for each rank): r and n of the means on common taxa."""
    rows = [correlation(common_taxa(mean_profile(a), mean_profile(b)), "mine", "theirs", with_p=False).select(F.lit(rank).alias("rank"), F.expr("stack(2, 'n', cast(n as double), 'r', r) as (statistic, value)")) for rank, (a, b) in tables.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("statistic").pivot("rank", list(tables)).agg(F.first("value"))


def profile_corr(ab1: DataFrame, ab2: DataFrame) -> DataFrame:
    """Pearson of each sample's two profiles over taxa that either has."""
    return outer_profiles(ab1, ab2).where("x > 0 or y > 0").groupBy("sample").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))


def overlap(ab1: DataFrame, ab2: DataFrame) -> DataFrame:
    """Taxa that both, only the first or only the second have in each sample, and the share of abundance in the shared ones."""
    p = outer_profiles(ab1, ab2)
    both = (F.col("x") > 0) & (F.col("y") > 0)
    share = lambda c: F.sum(F.when(both, F.col(c)).otherwise(0.0)) / F.nullif(F.sum(c), F.lit(0.0))
    return p.groupBy("sample").agg(
        F.count_if(both).alias("shared"), F.count_if((F.col("x") > 0) & (F.col("y") == 0)).alias("only_1"), F.count_if((F.col("x") == 0) & (F.col("y") > 0)).alias("only_2"),
        share("x").alias("shared_share_1"), share("y").alias("shared_share_2"),
    )


def slope0(df: DataFrame, x: str, y: str) -> DataFrame:
    """The slope of the line through the origin."""
    return df.agg((F.sum(F.col(x) * F.col(y)) / F.nullif(F.sum(F.col(x) * F.col(x)), F.lit(0.0))).alias("slope"))


def metric_corr(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """One column for each pair, all in one aggregate."""
    return df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])


def describe_by(df: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """Mean and sample deviation of each column to three decimals."""
    return df.groupBy(by).agg(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", lambda c: F.round(F.avg(c), 3)), ("sd", lambda c: F.round(F.stddev_samp(c), 3)))])


def retention(pairs: DataFrame, pre: str = "reads_pre", post: str = "reads_post") -> DataFrame:
    """Median, mean, extremes of post / pre in percent, and the totals."""
    share = F.when(F.col(pre) > 0, F.col(post) / F.col(pre) * 100)
    r = pairs.withColumn("__share", share)
    rest = r.agg(
        F.count("*").alias("n"), F.avg("__share").alias("mean_pct"), F.min("__share").alias("min_pct"), F.max("__share").alias("max_pct"),
        F.sum(pre).cast("double").alias("total_pre"), F.sum(post).cast("double").alias("total_post"),
    )
    return rest.join(F.broadcast(quantiles(r, "__share", [], {"median_pct": 0.5})), how="left")  # one row each


def histogram(df: DataFrame, col: str, lo: float, hi: float, width: float, norm: str = "count") -> DataFrame:
    """(bin, lo, hi, value): bins of one width, the last closed on the right. norm: count, percent of all rows (also those outside), density."""
    n = max(1, round((hi - lo) / width))
    inside = df.where((F.col(col) >= lo) & (F.col(col) <= hi)).groupBy(F.least(F.floor((F.col(col) - lo) / width), F.lit(n - 1)).cast("long").alias("bin")).agg(F.count("*").alias("c"))
    spark = df.sparkSession
    bins = spark.range(n).select(F.col("id").alias("bin")).join(F.broadcast(inside), "bin", "left").select("bin", F.coalesce("c", F.lit(0)).alias("c"))
    edges = [F.round(lo + F.col("bin") * width, 9).alias("lo"), F.round(lo + (F.col("bin") + 1) * width, 9).alias("hi")]
    if norm == "count":
        return bins.select("bin", *edges, F.col("c").cast("double").alias("value"))
    total = df.agg(F.count("*").cast("double").alias("t")) if norm == "percent" else inside.agg(F.sum("c").cast("double").alias("t"))
    value = F.col("c") * 100 / F.col("t") if norm == "percent" else F.col("c") / (F.col("t") * width)
    return bins.crossJoin(F.broadcast(total)).select("bin", *edges, F.coalesce(value, F.lit(0.0)).alias("value"))


def retention_histogram(df: DataFrame, col: str, width: float = 0.5) -> DataFrame:
    """Counts in bins of half a percent from the floor of the least to the ceiling of the most."""
    low, high = df.agg(F.floor(F.min(col) / width) * width, F.ceil(F.max(col) / width) * width).first()
    return histogram(df, col, float(low), float(high), width)


def box_stats(df: DataFrame, by: str, col: str) -> DataFrame:
    """Quartiles and whiskers, the furthest values within 1.5 quartile ranges."""
    q = quantiles(df, col, [by], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    inside = F.when((F.col(col) >= F.col("q1") - 1.5 * spread) & (F.col(col) <= F.col("q3") + 1.5 * spread), F.col(col))
    return df.join(q, by).groupBy(by, "q1", "median", "q3").agg(F.min(inside).alias("low"), F.max(inside).alias("high"))


def paired_change(pairs: DataFrame, pre: str, post: str) -> DataFrame:
    """The median of what pairs gained, null without a pair."""
    return pairs.agg(F.count("*").alias("n")).join(F.broadcast(quantiles(pairs, F.col(post) - F.col(pre), [], {"median_change": 0.5})), how="left").drop("n")


def hexbin(df: DataFrame, x: str, y: str, n: int = 35, extent: tuple[float, float, float, float] = (0.0, 1.0, 0.0, 1.0), min_count: int = 1) -> DataFrame:
    """(cx, cy, count) on a hexagonal grid n wide: each point goes to the nearer of the centres of two lattices, the second half a step off."""
    x0, x1, y0, y1 = extent
    ny = int(n / 3**0.5)
    sx, sy = (x1 - x0) / n, (y1 - y0) / ny
    u, v = (F.col(x) - x0) / sx, (F.col(y) - y0) / sy
    near = lambda c: F.floor(c + 0.5)
    d1 = F.pow(u - near(u), 2) + 3 * F.pow(v - near(v), 2)
    d2 = F.pow(u - F.floor(u) - 0.5, 2) + 3 * F.pow(v - F.floor(v) - 0.5, 2)
    first = d1 < d2
    cx = F.when(first, near(u)).otherwise(F.floor(u) + 0.5) * sx + x0
    cy = F.when(first, near(v)).otherwise(F.floor(v) + 0.5) * sy + y0
    return df.groupBy(F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy")).agg(F.count("*").alias("count")).where(F.col("count") >= min_count)


def agreement(df: DataFrame, a: Column, b: Column, name: str = "equal") -> DataFrame:
    return df.agg(F.count_if(a.eqNullSafe(b)).alias(name), F.count("*").alias("n"))


def significance_agreement(df: DataFrame, p1: str, p2: str, alpha: float = 0.05) -> DataFrame:
    return agreement(df, F.col(p1) < alpha, F.col(p2) < alpha, "same_verdict")


def validation_per_sample(ab1: DataFrame, ab2: DataFrame, alpha1: DataFrame, alpha2: DataFrame) -> DataFrame:
    """A row for each sample: totals, diversities, profile correlation and overlap of both studies."""
    totals = lambda ab, n: ab.groupBy("sample").agg(F.sum("value").alias(f"assigned_{n}"))
    named = lambda a, n: a.select("sample", *[F.col(c).alias(f"{c}_{n}") for c in ("observed", "chao1", "shannon", "simpson")])
    r1, r2 = to_relative(ab1), to_relative(ab2)
    parts = [totals(ab1, 1), totals(ab2, 2), named(alpha1, 1), named(alpha2, 2), profile_corr(r1, r2).withColumnRenamed("n", "n_taxa"), overlap(r1, r2)]
    return reduce(lambda a, b: a.join(b, "sample"), parts)


def validation_report(per_sample: DataFrame) -> DataFrame:
    """(step, comparison, result): medians, ranges and correlations over the samples, in one aggregate and then long."""
    a = per_sample.agg(
        F.median("assigned_1").alias("assigned: median, first"), F.median("assigned_2").alias("assigned: median, second"), F.corr("assigned_1", "assigned_2").alias("assigned: correlation"),
        F.corr("shannon_1", "shannon_2").alias("alpha: correlation of Shannon"), F.corr("observed_1", "observed_2").alias("alpha: correlation of richness"),
        F.median("r").alias("profiles: median correlation"), F.min("r").alias("profiles: least correlation"), F.max("r").alias("profiles: most correlation"),
        F.median("shared_share_1").alias("overlap: median share, first"), F.median("shared_share_2").alias("overlap: median share, second"),
        F.avg("shared").alias("overlap: mean shared taxa"), F.avg("only_1").alias("overlap: mean own taxa, first"), F.avg("only_2").alias("overlap: mean own taxa, second"),
        F.count("*").cast("double").alias("samples: number"), F.avg(F.col("assigned_1") / F.nullif("assigned_2", F.lit(0.0))).alias("assigned: mean ratio"),
    )
    long = a.unpivot([], a.columns, "name", "result")
    return long.select(F.split_part("name", F.lit(": "), F.lit(1)).alias("step"), F.split_part("name", F.lit(": "), F.lit(2)).alias("comparison"), "result")
