"""Principal coordinates and group ellipses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.shared import saved


def gower(distances: DataFrame) -> DataFrame:
    """(a, b, g): the centred matrix -1/2 J D2 J in full, by means of rows and of all."""
    square = distances.select("a", "b", (F.col("d") * F.col("d")).alias("q"))
    full = square.union(square.select("b", "a", "q"))
    n = full.agg(F.count_distinct("a").cast("double").alias("n"))
    rows = full.groupBy("a").agg(F.sum("q").alias("s")).crossJoin(F.broadcast(n)).select("a", (F.col("s") / F.col("n")).alias("m"))
    grand = rows.agg(F.avg("m").alias("g"))
    own = full.select("a").distinct().select("a", F.col("a").alias("b"), F.lit(0.0).alias("q"))
    out = full.union(own).join(rows.withColumnRenamed("m", "ma"), "a").join(rows.select(F.col("a").alias("b"), F.col("m").alias("mb")), "b").crossJoin(F.broadcast(grand))
    return out.select("a", "b", (-0.5 * (F.col("q") - F.col("ma") - F.col("mb") + F.col("g"))).alias("g"))


def _eigen(k: int, min_eigenvalue: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        rows = pd.concat(list(parts), ignore_index=True)
        if rows.empty:
            return
        names = sorted(rows["a"].unique())
        place = {s: i for i, s in enumerate(names)}
        g = np.zeros((len(names), len(names)))
        g[rows["a"].map(place), rows["b"].map(place)] = rows["g"]
        values, vectors = np.linalg.eigh((g + g.T) / 2)
        order = np.argsort(-values)
        total = values[values > 0].sum()
        order = [i for i in order if values[i] > min_eigenvalue][:k]
        for axis, i in enumerate(order, 1):
            v = vectors[:, i] * np.sqrt(values[i])
            v = v if v[np.argmax(np.abs(v))] > 0 else -v
            yield pd.DataFrame({"sample": names, "axis": axis, "value": v, "eigenvalue": values[i], "proportion": values[i] / total})

    return run


def pcoa(distances: DataFrame, k: int = 3, min_eigenvalue: float = 1e-12) -> DataFrame:
    """(sample, axis, value, eigenvalue, proportion) of the first k axes; the largest coordinate of an axis is positive.

    Centring is distributed. An axis's proportion is its share of all positive eigenvalues, so the whole spectrum is needed and with it the
    n x n matrix of samples (not of taxa or reads) in one task: 800 MB for 10,000 samples. Distances are saved, as centring reads them often.
    """
    return gower(saved(distances, "distances")).repartition(1).mapInPandas(_eigen(k, min_eigenvalue), "sample string, axis int, value double, eigenvalue double, proportion double")


def wide_coords(coords: DataFrame, k: int = 2) -> DataFrame:
    return coords.groupBy("sample").pivot("axis", list(range(1, k + 1))).agg(F.first("value")).toDF("sample", *[f"pc{i}" for i in range(1, k + 1)])


def ellipses(points: DataFrame, by: str = "grp", x: str = "x", y: str = "y", scale: float = 1.96) -> DataFrame:
    """Centre, angle (degrees), width and height of each group of more than two points, from the closed form of 2 x 2 eigenvalues."""
    g = points.groupBy(by).agg(
        F.count("*").alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("cxy")
    ).where("n > 2")
    half = (F.col("vx") + F.col("vy")) / 2
    root = F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, 2) + F.pow("cxy", 2))
    g = g.withColumn("l1", half + root).withColumn("l2", F.greatest(half - root, F.lit(0.0)))
    angle = F.degrees(F.atan2(F.col("l1") - F.col("vx"), F.col("cxy")))
    return g.select(by, "n", "cx", "cy", angle.alias("angle"), (2 * scale * F.sqrt("l1")).alias("width"), (2 * scale * F.sqrt("l2")).alias("height"))


def axis_limits(points: DataFrame, x: str = "x", y: str = "y", margin: float = 0.2) -> DataFrame:
    """Extremes of both axes and a margin of their range."""
    a = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    dx, dy = (F.col("x1") - F.col("x0")) * margin, (F.col("y1") - F.col("y0")) * margin
    return a.select((F.col("x0") - dx).alias("x_min"), (F.col("x1") + dx).alias("x_max"), (F.col("y0") - dy).alias("y_min"), (F.col("y1") + dy).alias("y_max"))
