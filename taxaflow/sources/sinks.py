"""Sinks: tables replaced in one step, sets of tables published all or not at all, rows split by a check."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaflow.operators.abundance import to_wide

#: Column names of a wide table up to which they are broadcast to its cells.
MAX_BROADCAST_NAMES = 1_000_000


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet, or csv and tsv with a header; the folder is replaced by the committer."""
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").csv(path, sep={"csv": ",", "tsv": "\t"}[fmt], header=True)


def wide_rows(ab: DataFrame, row: str = "taxon_id", column: str = "sample", value: str = "value") -> tuple[DataFrame, list[str]]:
    """(row, filled) and the names of the columns in order: a row of the wide table as its filled cells (no, value), sorted by column number.

    A wide table is never made of columns, so there may be any number of them; a row holds one cell for each at most.
    """
    names = sorted(r[0] for r in ab.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().collect())  # the table's header
    numbers = ab.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "__name string, no int")
    numbers = F.broadcast(numbers) if len(names) <= MAX_BROADCAST_NAMES else numbers
    cells = ab.select(F.col(row).alias("row"), F.col(column).cast("string").alias("__name"), F.col(value).alias("value")).join(numbers, "__name")
    cells = cells.groupBy("row", "no").agg(F.sum("value").alias("value"))
    return cells.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("no", "value"))).alias("filled")), names


def _quoted(c: Column, sep: str) -> Column:
    return F.when(c.contains(sep) | c.contains('"') | c.contains("\n"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(c)


def _with_header(header: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([header])], names=["value"])
        yield from batches

    return run


def write_wide(ab: DataFrame, path: str, row: str = "taxon_id", column: str = "sample", value: str = "value", fmt: str = "tsv", absent: str = "0.0") -> None:
    """A wide table as lines, sorted by row, each part with its header; absent cells hold `absent`."""
    sep = {"csv": ",", "tsv": "\t"}[fmt]
    rows, names = wide_rows(ab, row, column, value)
    gap = lambda n: F.repeat(F.lit(f"{sep}{absent}"), n)
    before = F.concat(F.array(F.lit(-1)), F.col("filled.no"))
    cells = F.zip_with("filled", F.slice(before, 1, F.size("filled")), lambda x, p: F.concat(gap(x["no"] - p - 1), F.lit(sep), F.coalesce(x["value"].cast("string"), F.lit(absent))))
    line = F.concat(_quoted(F.coalesce(F.col("row").cast("string"), F.lit("")), sep), F.array_join(cells, ""), gap(F.lit(len(names) - 1) - F.element_at("filled.no", -1)))
    quoted = [f'"{n.replace(chr(34), chr(92) + chr(34))}"' if any(x in n for x in (sep, '"', "\n")) else n for n in names]
    lines = rows.orderBy("row").select(line.alias("value"))
    lines.mapInArrow(_with_header(sep.join([row, *quoted])), "value string").write.mode("overwrite").text(path)


def write_feature_table(ab: DataFrame, path: str, samples: list[str] | None = None, fmt: str = "tsv") -> None:
    """The table of taxa by samples; `samples` chooses and orders columns and is for tables of few."""
    if samples is None and fmt != "parquet":
        write_wide(ab, path, fmt=fmt)
    else:
        write_table(to_wide(ab, samples).orderBy("taxon_id"), path, fmt)


def write_square(distances: DataFrame, path: str, fmt: str = "tsv") -> None:
    """The symmetric table of distances(a, b, d) with a zero diagonal."""
    both = distances.select("a", "b", "d").union(distances.select("b", "a", "d"))
    own = both.select("a").distinct().select("a", F.col("a").alias("b"), F.lit(0.0).alias("d"))
    write_wide(both.union(own), path, "a", "b", "d", fmt)


def _current(path: str) -> str:
    return f"{path}/CURRENT"


def publish(tables: dict[str, DataFrame], path: str, force: bool = False, fmt: str = "parquet") -> None:
    """Writes all tables under a new version of `path`, then names that version in the file CURRENT, which is replaced in one step; a
    set that exists is an error unless forced.

    Whatever stops the work, CURRENT names a whole set: the old one until the step, the new one from then on. The version before is deleted
    afterwards; what a stopped run leaves behind, the next one deletes.
    """
    spark = next(iter(tables.values())).sparkSession
    if published(spark, path) and not force:
        raise FileExistsError(path)
    version = f"version-{uuid.uuid4().hex}"
    fs, where = _fs(spark, path)
    try:
        for name, df in tables.items():
            write_table(df, f"{path}/{version}/{name}", fmt)
        _point(spark, path, version)
    except BaseException:
        if published(spark, path) != f"{path}/{version}":
            fs.delete(_fs(spark, f"{path}/{version}")[1], True)
        raise
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        if name != version and name.startswith(("version-", "CURRENT.")):
            fs.delete(status.getPath(), True)


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Replaces CURRENT by one that names `version`: written beside it, and moved over it by a rename that overwrites."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    beside = jvm.org.apache.hadoop.fs.Path(f"{_current(path)}.{uuid.uuid4().hex}")
    out = beside.getFileSystem(conf).create(beside, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.getFileSystem(conf).getUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, jvm.org.apache.hadoop.fs.Path(_current(path)), options)


def published(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that is current, or None if nothing has been published."""
    fs, where = _fs(spark, _current(path))
    if not fs.exists(where):
        return None
    return f"{path}/{spark.read.text(_current(path)).first()['value']}"


def on_error(df: DataFrame, valid: Column, policy: str = "skip") -> tuple[DataFrame, DataFrame]:
    """(good rows, failed rows); policy "stop": a failed row is an error when the good rows are read."""
    ok = F.coalesce(valid, F.lit(False))
    if policy == "stop":
        return df.where(F.assert_true(ok, "a sample failed").isNull()), df.limit(0)
    return df.where(ok), df.where(~ok)


def write_by_barcode(reads: DataFrame, path: str, by: str = "sample") -> None:
    reads.write.mode("overwrite").partitionBy(by).parquet(path)


def _rename(df: DataFrame, path: str, ending: str, name) -> None:
    """Gives the part files under `path` that end in `ending` the name that `name(file, number)` says; the files of one write are few."""
    spark = df.sparkSession
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found, files = fs.listFiles(top, True), []
    while found.hasNext():
        file = found.next().getPath()
        if file.getName().startswith("part-") and file.getName().endswith(ending):
            files.append(file)
    for k, file in enumerate(sorted(files, key=lambda f: f.toString())):
        fs.rename(file, jvm.org.apache.hadoop.fs.Path(name(file, k)))


def write_fastq(reads: DataFrame, path: str, by: str = "sample") -> None:
    """FASTQ files in a folder for each sample, as many as tasks have reads of it."""
    record = F.concat(F.lit("@"), "read_id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")
    reads.select(by, record.alias("value")).write.mode("overwrite").partitionBy(by).text(path)
    _rename(reads, path, ".txt", lambda f, k: f"{f.getParent()}/{k:06d}.fastq")


def write_sample_tables(rows: DataFrame, path: str, by: str = "sample", suffix: str = ".tsv") -> None:
    """A table with a header for each sample, named after it."""
    rows.repartition(by).write.mode("overwrite").partitionBy(by).csv(path, sep="\t", header=True)
    _rename(rows, path, ".csv", lambda f, _: f"{path}/{f.getParent().getName().split('=', 1)[1]}{suffix}")


def taxonomy_rows(taxonomy: DataFrame, key: str = "taxon_id", lineage: str = "lineage", order: str = "ord") -> DataFrame:
    """One lineage for each id, the last seen."""
    return taxonomy.groupBy(key).agg(F.max_by(lineage, order).alias(lineage))


def write_taxonomy(taxonomy: DataFrame, path: str, keep: bool = False) -> None:
    """Sorted by id; `keep`: a table that is there stays."""
    spark = taxonomy.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if keep and target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return
    write_table(taxonomy_rows(taxonomy).orderBy("taxon_id"), path, "tsv")
