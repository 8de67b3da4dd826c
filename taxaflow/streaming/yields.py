"""Run yield on a stream of read summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from taxaflow.operators.reads import run_yield

SCHEMA = "read_id string, barcode string, ts timestamp, length long, mean_q double"


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def run_yield_stream(summary: DataFrame, interval: str = "1 hour", late: str = "2 hours", min_q: float = 10.0) -> DataFrame:
    """Windows are final once the watermark has passed them; later rows are left out."""
    return run_yield(summary.withWatermark("ts", late), interval, min_q)


def write_yields(summary: DataFrame, path: str, checkpoint: str, interval: str = "1 hour", late: str = "2 hours") -> StreamingQuery:
    """Appends finished windows as Parquet, each once, and ends when what was there at the start is read."""
    out = run_yield_stream(summary, interval, late)
    return out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
