"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaflow.shared import _PATHS, bounded_broadcast, forget, new_path, saved, shared_dir

__all__ = ["_PATHS", "bounded_broadcast", "connected_components", "decisions", "forget", "let", "new_path", "row_key", "saved", "shared_dir", "table"]

#: Words are runs of anything but ASCII white space.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Decisions (an id, a key and what was found in a row) up to which they go to the rows; beyond, rows and decisions are shuffled.
MAX_BROADCAST_DECISIONS = 400_000


def decisions(df: DataFrame, what: str, max_rows: int = MAX_BROADCAST_DECISIONS, weight: Column | None = None) -> DataFrame:
    """A few columns for the rows that a filter concerns, saved, and broadcast if they are few: texts then stay where they are.

    Rows of different sizes have a `weight`, which is added up against the bound.
    """
    kept = saved(df, what)
    if weight is None:
        return bounded_broadcast(kept, max_rows)
    return F.broadcast(kept) if (kept.agg(F.sum(weight)).first()[0] or 0) <= max_rows else kept


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)`, with `value` computed once per row."""
    return F.transform(F.array(value), body)[0]


def row_key(*cols: Column) -> Column:
    """A 64-bit key of a row's values; equal rows share it. Nulls count as values."""
    return F.xxhash64(*[x for c in cols for x in (c.isNull(), c)])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of an undirected graph given as edges (u, v) of longs; root is the smallest node of the component.

    Alternates large-star and small-star steps; each round is saved and the one before deleted, so lineage stays short. Only nodes with an edge appear.
    """
    e = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    digest = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = digest(e)
    while before[0]:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "n"), F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low)
        last, e = e, saved(small.distinct(), "edges")
        forget(last)
        after = digest(e)
        if after == before:
            break
        before = after
    roots = e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
