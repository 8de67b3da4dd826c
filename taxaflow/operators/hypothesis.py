"""Rank and permutation tests."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaflow.functions.distributions import mann_whitney_p
from taxaflow.shared import bounded_broadcast, saved

from .ranges import running_counts

#: Samples with their labels of all permutations up to which they are broadcast.
MAX_BROADCAST_SAMPLES = 5_000
#: Distances in a panel of rows, and numbers of permuted samples that tasks hold at once.
PANEL_CELLS, PERMUTATION_CELLS = 1 << 22, 1 << 24


def value_ranks(df: DataFrame, col: str, by: list[str], *sums: Column) -> DataFrame:
    """(by, col, t, rank, ..): each different value with the number of its rows and their average rank.

    Equal values are counted first, and places taken in ranges of them, so no task holds a group's values.
    """
    counts = running_counts(df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("t"), *sums), col, by)
    return counts.withColumn("rank", F.col("upto") - (F.col("t") - 1) / 2.0).drop("upto")


def average_rank(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """`rank`, ties at their mean, and `t`, the size of each tie. Ranks come back to the rows by value, so the rows are saved first."""
    df = saved(df, "ranked-rows")
    return df.join(value_ranks(df, col, by), [*by, col])


def mann_whitney(df: DataFrame, metrics: list[str], group: str = "grp", pairs: list[tuple[str, str]] | None = None, with_p: bool = True) -> DataFrame:
    """(metric, g1, g2, n1, n2, u, p): two-sided, for each pair of groups and metric; groups of one value are left out."""
    names = pairs or list(combinations(sorted(r[0] for r in df.select(group).where(F.col(group).isNotNull()).distinct().collect()), 2))
    values = df.unpivot([group], metrics, "metric", "value").where("value is not null")
    list_of = F.array(*[F.struct(F.lit(a).alias("g1"), F.lit(b).alias("g2")) for a, b in names])
    rows = values.withColumn("p", F.explode(list_of)).select("metric", "p.g1", "p.g2", F.col(group).alias("g"), "value").where("g = g1 or g = g2")
    ranked = value_ranks(rows, "value", ["metric", "g1", "g2"], F.count_if(F.col("g") == F.col("g1")).alias("c1"))
    t = F.col("t").cast("double")
    out = ranked.groupBy("metric", "g1", "g2").agg(
        F.sum("c1").alias("n1"), F.sum(F.col("t") - F.col("c1")).alias("n2"), F.sum(F.col("c1") * F.col("rank")).alias("r1"), F.sum(t * (t * t - 1)).alias("ties"),
    ).where("n1 > 1 and n2 > 1")
    out = out.withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0)
    cols = ["metric", "g1", "g2", "n1", "n2", "u"]
    return out.select(*cols, mann_whitney_p("u", "n1", "n2", "ties").alias("p")) if with_p else out.select(*cols)


def label_arrays(samples: DataFrame, label: str, n_perm: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """(by, sample, labels): each sample's labels in permutations 0 (as given) to n_perm; labels are dealt anew in the order of a seeded hash."""
    by = by or []
    base = samples.select(*by, "sample", F.col(label).alias("label"))
    own = base.withColumn("k", F.row_number().over(W.partitionBy(*by, F.lit(1)).orderBy("sample")))
    many = base.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_perm))))
    key = F.md5(F.concat_ws("-", F.lit(seed), "perm", "sample").cast("binary"))
    dealt = many.select(*by, "perm", "label", F.row_number().over(W.partitionBy(*by, "perm").orderBy(key, "sample")).alias("k"))
    dealt = dealt.groupBy(*by, "k").agg(F.sort_array(F.collect_list(F.struct("perm", "label"))).alias("dealt"))
    return own.join(dealt, [*by, "k"]).select(*by, "sample", F.concat(F.array("label"), F.transform("dealt", lambda x: x["label"])).alias("labels"))


def permuted_labels(samples: DataFrame, label: str, n_perm: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """(by, perm, sample, label) for perm 0 (as given) to n_perm."""
    return label_arrays(samples, label, n_perm, seed, by).select(*(by or []), "sample", F.posexplode("labels").alias("perm", "label"))


def permanova(distances: DataFrame, groups: DataFrame, n_perm: int = 999, seed: int = 42, tol: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """(by, n, k, f, r2, p): one-way, on samples that have a group; p counts permutations with F* >= F - tol.

    distances(by, a, b, d); groups(by, sample, grp). SST sums d2 of all pairs over n; SSW sums those of pairs with one label over the label's
    size. A sample carries its labels of all permutations, as shares 1 / size by a number for each label, so each pair moves once and its
    terms are added up where it is.
    """
    by = by or []
    sizes = groups.groupBy(*by, F.col("grp").alias("label")).agg(F.count("*").alias("ng"))
    sizes = sizes.withColumn("no", F.row_number().over(W.partitionBy(*by, F.lit(1)).orderBy("label")))
    shape = sizes.groupBy(*by).agg(F.sum("ng").cast("double").alias("n"), F.count("*").cast("double").alias("k"))
    numbered = groups.withColumnRenamed("grp", "label").join(sizes, [*by, "label"]).select(*by, "sample", F.struct("no", "ng").alias("of"))
    labels = bounded_broadcast(saved(label_arrays(numbered, "of", n_perm, seed, by), "labels"), MAX_BROADCAST_SAMPLES)
    la = labels.select(*by, F.col("sample").alias("a"), F.col("labels").alias("of_a"))
    lb = labels.select(*by, F.col("sample").alias("b"), F.col("labels").alias("of_b"))
    d2 = distances.select(*by, "a", "b", (F.col("d") * F.col("d")).alias("q")).join(la, [*by, "a"]).join(lb, [*by, "b"])
    shares = F.zip_with("of_a", "of_b", lambda x, y: F.when(x["no"] == y["no"], F.lit(1.0) / x["ng"]))
    ss = d2.select(*by, "q", F.posexplode(shares).alias("perm", "share")).groupBy(*by, "perm").agg(F.sum("q").alias("q"), F.sum(F.col("q") * F.coalesce("share", F.lit(0.0))).alias("ssw"))
    all_of = ss.join(shape, by) if by else ss.crossJoin(F.broadcast(shape))
    all_of = all_of.withColumn("sst", F.col("q") / F.col("n"))
    f = ((F.col("sst") - F.col("ssw")) / (F.col("k") - 1)) / F.nullif(F.col("ssw") / (F.col("n") - F.col("k")), F.lit(0.0))
    row = F.struct("n", "k", F.round(f, 9).alias("f"), ((F.col("sst") - F.col("ssw")) / F.col("sst")).alias("r2"))
    tried = all_of.select(*by, "perm", row.alias("x")).groupBy(*by).agg(F.max(F.when(F.col("perm") == 0, F.col("x"))).alias("real"), F.collect_list(F.when(F.col("perm") > 0, F.col("x.f"))).alias("f"), F.count("*").alias("tried"))
    more = F.size(F.filter("f", lambda x: x >= F.col("real.f") - tol))
    return tried.where("real is not null").select(*by, F.col("real.n").cast("long").alias("n"), F.col("real.k").cast("long").alias("k"), "real.f", "real.r2", ((more + 1) / F.col("tried")).alias("p"))


def _panel_sums(shared, samples: int, first: int, panel: int):
    """Sums over the pairs of a panel of the first list's rows whose permuted row lies in a panel of the second's, for each permutation."""

    def run(key, xs: pd.DataFrame, ys: pd.DataFrame) -> pd.DataFrame:
        labels = np.frombuffer(shared.value, np.int32).reshape(samples, -1)
        low = int(key[1]) * panel
        square = np.full((panel, samples), np.nan)
        for no, others, d in zip(ys["no"], ys["others"], ys["d"], strict=True):
            square[no - low, others] = d
        out = np.zeros((labels.shape[1], 6))
        for no, others, d in zip(xs["no"], xs["others"], xs["d"], strict=True):
            to = labels[no] - low
            here = np.flatnonzero((to >= 0) & (to < panel))
            at = max(1, (1 << 21) // len(others))
            for perms in (here[k : k + at] for k in range(0, len(here), at)):
                y = square[to[perms][:, None], labels[others][:, perms].T]
                x = np.where(np.isnan(y), np.nan, np.asarray(d, float)[None, :])
                y = np.where(np.isnan(x), np.nan, y)
                out[perms] += np.stack([(~np.isnan(x)).sum(1), *(np.nansum(v, 1) for v in (x, y, x * x, y * y, x * y))], 1)
        kept = np.flatnonzero(out[:, 0])
        return pd.DataFrame({"perm": kept + first, **{c: out[kept, k] for k, c in enumerate(("n", "x", "y", "xx", "yy", "xy"))}})

    return run


def _rows_of(pairs: DataFrame, whole: bool) -> DataFrame:
    """(no, others, d): the distances of each sample to those after it, or to all others; a row has at most one entry for each sample."""
    one = pairs.select(F.least("u", "v").alias("no"), F.greatest("u", "v").alias("other"), "d")
    both = one.union(one.select("other", "no", "d")) if whole else one
    rows = both.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("other", "d"))).alias("of"))
    return rows.select("no", F.col("of.other").alias("others"), F.col("of.d").alias("d"))


def mantel(d1: DataFrame, d2: DataFrame, n_perm: int = 999, seed: int = 42, samples: DataFrame | None = None) -> DataFrame:
    """(n, r, p): Pearson of two distance lists over common pairs; two-sided p by relabelling the second list's samples.

    Samples are numbered, and both lists become panels of their rows. Each panel of the first list meets each of the second, with the
    numbers of all permutations at hand, and adds up the pairs that a permutation puts there. What is shuffled is each list once for each
    panel of the other, and a row for each permutation and pair of panels, but never a pair for each permutation. Permutations go in groups
    of a bounded size. samples(sample), if given, spares a pass over the first list.
    """
    spark = d1.sparkSession
    names = d1.select(F.col("a").alias("sample")).union(d1.select("b")).distinct() if samples is None else samples.select("sample").distinct()
    names = names.withColumn("no", (F.row_number().over(W.partitionBy(F.lit(1)).orderBy("sample")) - 1).cast("int"))
    to = saved(label_arrays(names, "no", n_perm, seed), "labels")
    n = to.count()
    panel = max(1, min(n, PANEL_CELLS // max(1, n)))
    panels = max(1, -(-n // panel))
    own = to.select("sample", F.col("labels")[0].alias("no"))
    own = F.broadcast(own) if n <= MAX_BROADCAST_SAMPLES else own
    numbered = lambda d: d.join(own.select(F.col("sample").alias("a"), F.col("no").alias("u")), "a").join(own.select(F.col("sample").alias("b"), F.col("no").alias("v")), "b").where("d is not null")
    deal = lambda rows, mine, other: rows.withColumn(mine, F.floor(F.col("no") / panel).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(panels - 1))))
    xs, ys = deal(_rows_of(numbered(d1), False), "p1", "p2"), deal(_rows_of(numbered(d2), True), "p2", "p1")
    if panels > 1 or n_perm + 1 > PERMUTATION_CELLS // max(1, n):
        xs, ys = saved(xs, "first-panels"), saved(ys, "second-panels")
    sums = None
    size = max(1, PERMUTATION_CELLS // max(1, n))
    for first in range(0, n_perm + 1, size):
        rows = to.select(F.col("labels")[0].alias("no"), F.slice("labels", first + 1, size).alias("of")).orderBy("no").collect()  # PERMUTATION_CELLS numbers
        shared = spark.sparkContext.broadcast(np.array([r["of"] for r in rows], np.int32).tobytes())
        part = xs.groupBy("p1", "p2").cogroup(ys.groupBy("p1", "p2")).applyInPandas(_panel_sums(shared, n, first, panel), "perm int, n double, x double, y double, xx double, yy double, xy double")
        sums = part if sums is None else sums.unionByName(part)
    cols = ["n", "x", "y", "xx", "yy", "xy"]
    sums = sums.groupBy("perm").agg(*[F.sum(c).alias(c) for c in cols])
    spread = F.sqrt(F.col("n") * F.col("xx") - F.col("x") * F.col("x")) * F.sqrt(F.col("n") * F.col("yy") - F.col("y") * F.col("y"))
    r = sums.select("perm", F.col("n").cast("long").alias("n"), F.round((F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.nullif(spread, F.lit(0.0)), 9).alias("r"))
    tried = r.agg(F.max(F.when(F.col("perm") == 0, F.struct("n", "r"))).alias("real"), F.collect_list(F.when(F.col("perm") > 0, F.col("r"))).alias("rs"), F.count("*").alias("tried"))
    return tried.where("tried > 0").select("real.n", "real.r", ((F.size(F.filter("rs", lambda x: F.abs(x) >= F.abs(F.col("real.r")))) + 1) / F.col("tried")).alias("p"))


def published_subsets(distances: DataFrame, samples: DataFrame, tests: DataFrame, n_perm: int = 999, seed: int = 42) -> DataFrame:
    """PERMANOVA of each (type, time) that tests(type, time, published_r2, published_p) lists, beside what was published."""
    chosen = samples.join(tests.select("type", "time").distinct(), ["type", "time"], "left_semi")
    side = lambda s: chosen.select("type", "time", F.col("sample").alias(s))
    own = distances.join(side("a"), "a").join(side("b"), ["type", "time", "b"])
    return permanova(own, chosen.select("type", "time", "sample", "grp"), n_perm, seed, by=["type", "time"]).join(tests, ["type", "time"])
