"""Tables in the folder that driver and executors share, and joins whose small side is of a checked size."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without, with a new folder of its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="taxaflow-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """Written as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


#: Where tables of `saved` lie, as long as they are in use.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def forget(df: DataFrame) -> None:
    """Deletes a table of `saved` that nothing will read again."""
    spark, path = df.sparkSession, _PATHS.pop(df)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def list_files(spark: SparkSession, path: str) -> list[str]:
    """The files at and under a path, empty ones too, named as by `file_of`."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, out = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True), []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return sorted(out)


def file_of() -> Column:
    """The file a row of a scan is from; the metadata have it as a URI."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """`df` marked for broadcast if it has at most `max_rows` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def not_empty(df: DataFrame, message: str) -> DataFrame:
    """`df`, or an error if it has no row."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def never_empty(df: DataFrame, message: str, of: DataFrame | None = None) -> DataFrame:
    """`df`; that it, or `of`, has no row is an error when this result is read. The count reads the shuffles that the rows come from.

    For the last step of an operator: what filters the result further may spare the count.
    """
    none = (df if of is None else of).agg(F.count("*").alias("__n")).where(F.assert_true(F.col("__n") > 0, message).isNotNull())
    return df.unionByName(none.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))
