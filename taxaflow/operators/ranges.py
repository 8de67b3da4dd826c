"""Running counts and exact quantiles of any number of values, without a task or a buffer that holds a group.

The different values of a group are cut into ranges at approximate quantiles, which only decide who works on what. A place among all values is
what the ranges before hold, a sum over a few ranges, and a place within one range.

Cuts, sizes and places each read the values, so these are saved first: a sum of doubles may differ in its last bit when it is made again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaflow.shared import saved

#: Ranges of a group, and the accuracy of the sketch that cuts them.
RANGES, ACCURACY = 64, 1_000


def in_ranges(counts: DataFrame, value: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """counts(by, value, t, ..) with `range`, and (by, range, size, before, n) of each range: its rows, those of the ranges before, those of the group."""
    counts = saved(counts, "values")
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], ACCURACY).alias("cuts"))
    placed = counts.join(cuts, by).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")
    sizes = placed.groupBy(*by, "range").agg(F.sum("t").alias("size"))
    w = W.partitionBy(*by)  # RANGES rows at most
    before = F.coalesce(F.sum("size").over(w.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed, sizes.select(*by, "range", "size", before.alias("before"), F.sum("size").over(w).alias("n"))


def running_counts(counts: DataFrame, value: str, by: list[str]) -> DataFrame:
    """counts(by, value, t, ..) with `upto`: the rows of the group up to and with each value."""
    placed, ranges = in_ranges(counts, value, by)
    upto = F.col("before") + F.sum("t").over(W.partitionBy(*by, "range").orderBy(value))
    return placed.join(ranges.drop("size", "n"), [*by, "range"]).withColumn("upto", upto).drop("before", "range")


def quantiles(df: DataFrame, col: str | Column, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(by, a column for each share): exact quantiles, between two values on a straight line. Nulls don't count.

    Only ranges that hold an asked place are put in order.
    """
    own = by or ["__all"]
    value = (F.col(col) if isinstance(col, str) else col).cast("double")
    rows = (df if by else df.withColumn("__all", F.lit(1))).select(*own, value.alias("__v")).where("__v is not null")
    placed, ranges = in_ranges(rows.groupBy(*own, "__v").agg(F.count("*").alias("t")), "__v", own)
    place = {k: q * (F.col("n") - 1) for k, q in shares.items()}
    holds = lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("size"))
    asked = F.lit(False)
    for p in place.values():
        asked = asked | holds(F.floor(p)) | holds(F.ceil(p))
    upto = F.col("before") + F.sum("t").over(W.partitionBy(*own, "range").orderBy("__v"))
    run = placed.join(ranges.where(asked), [*own, "range"]).withColumn("upto", upto)
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("__v")))
    out = run.groupBy(*own).agg(F.max("n").alias("n"), *[x for k, p in place.items() for x in (at(F.floor(p)).alias(f"{k}_low"), at(F.ceil(p)).alias(f"{k}_high"))])
    between = lambda k: F.col(f"{k}_low") + (F.col(f"{k}_high") - F.col(f"{k}_low")) * (place[k] - F.floor(place[k]))
    # One value twice needs no line; that keeps infinite ones.
    return out.select(*by, *[F.when(F.col(f"{k}_low") == F.col(f"{k}_high"), F.col(f"{k}_low")).otherwise(between(k)).alias(k) for k in shares])
