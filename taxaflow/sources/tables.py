"""Scans of delimited tables whose header, delimiter or orientation has to be found out. Detection reads heads or runs one aggregate."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaflow.functions.names import RANKS, run_id, sample_name, taxon_id
from taxaflow.operators.abundance import dedupe, union_first, valid_runs
from taxaflow.shared import file_of, list_files

SAMPLE_NAME = re.compile(r"^(?:SRR|ERR|DRR)\d+|^barcode\d+", re.I)


def read_delimited(spark: SparkSession, path: str, required: list[str], candidates: tuple[str, ...] = (";", ",", "\t")) -> DataFrame:
    """The table under the first delimiter that gives the required columns; the error names the columns found."""
    seen = []
    for sep in candidates:
        df = spark.read.csv(path, sep=sep, header=True)
        df = df.toDF(*[c.strip() for c in df.columns])
        if set(required) <= set(df.columns):
            return df
        seen.append(df.columns)
    raise ValueError(f"{path} lacks {', '.join(required)}; it has {' | '.join(', '.join(c) for c in seen)}")


def sniff(spark: SparkSession, path: str) -> str:
    """The delimiter that the first line has most often."""
    line = (spark.read.text(path).head() or [""])[0]
    return max(("\t", ";", ","), key=line.count)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=sniff(spark, path), header=True)


def read_table_find_header(spark: SparkSession, path: str, cell: str, sep: str = "\t") -> DataFrame:
    """A table whose header is the row that holds `cell`: rows below it, names trimmed. One file is one split here, so its order holds."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("ord"))
    cells = F.transform(F.split("value", re.escape(sep)), lambda c: F.trim(c))
    head = lines.where(F.array_contains(cells, cell)).orderBy("ord").select(cells.alias("c"), "ord").first()
    if head is None:
        raise ValueError(f"no row of {path} holds {cell}")
    names = [n or f"_{i}" for i, n in enumerate(head["c"])]
    return lines.where(F.col("ord") > head["ord"]).select(cells.alias("c")).select(*[F.try_element_at("c", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def read_feature_table(spark: SparkSession, path: str) -> DataFrame:
    """ab(sample, taxon_id, value) of a wide table, turned if its rows are samples or its columns taxa; zeros and what isn't a number go.

    Lines are split and their cells made rows, so a table may have any number of columns. Only a row's name may be quoted.
    """
    lines = spark.read.text(path)
    head = (lines.head() or [""])[0]
    sep = max(("\t", ";", ","), key=head.count)
    names = [n.strip('"').replace('\\"', '"') for n in head.split(sep)[1:]]
    quoted = F.col("value").startswith('"')
    start = F.when(quoted, F.regexp_extract("value", r'^("(?:[^"\\]|\\.)*")', 1)).otherwise(F.split_part("value", F.lit(sep), F.lit(1)))
    key = F.when(quoted, F.replace(F.expr("substring(start, 2, length(start) - 2)"), F.lit('\\"'), F.lit('"'))).otherwise(F.col("start"))
    rows = lines.where(F.col("value") != head).select("value", start.alias("start")).select(key.alias("key"), F.split(F.substring("value", F.length("start") + 2, F.length("value")), re.escape(sep)).alias("cells"))
    first = [r[0] for r in rows.select("key").limit(20).collect()]
    turned = any(SAMPLE_NAME.match(x or "") for x in first) or any("|" in c or c.startswith("species") for c in names)
    summary = [i for i, c in enumerate(names) if c.startswith(("Total_counts", "Frecuencia_"))]
    # The header is one value of the plan: its names are looked up by number.
    named = F.split(F.lit("\x1f".join(names)), "\x1f")
    cells = rows.select("key", F.posexplode("cells").alias("no", "cell")).select("key", F.get(named, F.col("no")).alias("name"), "no", F.col("cell").try_cast("double").alias("value"))
    long = cells.where((F.col("value") > 0) & F.col("name").isNotNull() & ~F.col("no").isin(summary))
    return long.select(*(("key", "name") if turned else ("name", "key")), "value").toDF("sample", "taxon_id", "value")


def relative_column(sums: dict[str, float], abundance_first: bool = True, any_named: bool = True) -> str | None:
    """The column of shares: named like abundance and adding up to 1, else so named, else the first that adds up to 1."""
    near = [c for c, s in sums.items() if s is not None and 0.9 <= s <= 1.1 and c != "tax_id"]
    named = [c for c in sums if "abund" in c.lower()]
    orders = [[c for c in named if c in near], named if any_named else [], near]
    orders = orders if abundance_first else orders[::-1]
    return next((o[0] for o in orders if o), None)


def count_column(sums: dict[str, float]) -> str | None:
    named = [c for c in sums if re.fullmatch(r"(?i)(?:estimated[ _])?counts?", c)]
    return named[0] if named else next((c for c, s in sums.items() if s is not None and s > 1.1 and c != "tax_id"), None)


def probe_tables(spark: SparkSession, paths: list[str], sep: str = "\t") -> list[tuple[str, list[str], str | None]]:
    """(file, cells, reason): the cells of the header of each file, and why it can't be read as a table, if so: no line, bytes that aren't UTF-8, or a row
    with more cells than the header. One pass over the lines; rows with fewer cells are filled, as their tables can be read."""
    lines = spark.read.text(paths).select(file_of().alias("file"), F.monotonically_increasing_id().alias("ord"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = lines.where("trim(value) <> ''")
    # A quoted cell may hold the delimiter, so such rows don't count as too long.
    width = F.when(~F.col("value").contains('"'), F.size(F.split("value", re.escape(sep))))
    found = lines.groupBy("file").agg(F.min_by("value", F.struct("block", "ord")).alias("head"), F.max(width).alias("most"), F.bool_and(F.is_valid_utf8("value")).alias("text"))
    cells = F.transform(F.split("head", re.escape(sep)), lambda c: F.trim(F.btrim(c, F.lit('"'))))
    reason = F.when(~F.col("text"), "not UTF-8").when(F.col("most") > F.size(cells), "a row has more cells than the header")
    read = {r["file"]: (r["cells"], r["reason"]) for r in found.select("file", cells.alias("cells"), reason.alias("reason")).collect()}  # a row for each file, as the list itself
    return [(f, *read.get(f, ([], "empty"))) for p in paths for f in list_files(spark, p)]


def _layout(cells: list[str]) -> list[str]:
    """Column names of a header, ranks in their standard case, repeated names numbered."""
    out: list[str] = []
    for k, c in enumerate(cells):
        name = c.lower() if c.lower() in RANKS else c or f"_{k}"
        out.append(name if name not in out else f"{name}.{sum(x == name or x.startswith(name + '.') for x in out)}")
    return out


def read_tables(
    spark: SparkSession, path: str | list[str], kind: str = "relative", rank: str = "species", style: str = "accession", policy: str = "stop"
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(rows, failed): rows(sample, taxon_id, the ranks, value) of per-sample tables, and the files that can't be used, each with its reason.

    Files may differ in their columns and the columns' order: those with one header are one scan, and scans are put together by name. The
    value column is chosen for each file, from sums over the rows that have the rank. policy "stop": a failed file is an error; "skip": it is
    listed and its rows are left out.
    """
    paths = [path] if isinstance(path, str) else path
    failed: list[tuple[str, str]] = []
    layouts: dict[tuple[str, ...], list[str]] = {}
    for file, cells, reason in probe_tables(spark, paths):
        if reason:
            failed.append((file, reason))
        else:
            layouts.setdefault(tuple(_layout(cells)), []).append(file)
    scan = lambda names, files: spark.read.csv(files, sep="\t", header=True, schema=", ".join(f"`{n}` string" for n in names)).withColumn("__file", file_of())
    scans: dict[tuple[tuple[str, ...], str], list[str]] = {}
    for names, files in layouts.items():
        numeric = [c for c in names if c not in RANKS]
        if rank not in names or not numeric:
            failed += [(f, f"no {rank} column" if rank not in names else f"no {kind} column") for f in files]
            continue
        named = scan(names, files).where(F.coalesce(F.trim(rank), F.lit("")) != "")
        sums = {r["__file"]: r.asDict() for r in named.groupBy("__file").agg(*[F.sum(F.col(f"`{c}`").try_cast("double")).alias(c) for c in numeric]).collect()}
        for f in files:
            own = {c: sums.get(f, {}).get(c) for c in numeric}
            col = relative_column(own) if kind == "relative" else count_column(own)
            if col is None:
                failed.append((f, f"no {kind} column"))
            else:
                scans.setdefault((names, col), []).append(f)
    if failed and policy == "stop":
        raise ValueError("; ".join(f"{f}: {why}" for f, why in sorted(failed)))
    rows = None
    for (names, col), files in scans.items():
        df = scan(names, files)
        tax = F.col("tax_id") if "tax_id" in names else None
        value = F.coalesce(F.col(f"`{col}`").try_cast("double"), F.lit(0.0))
        part = df.select(sample_name(F.col("__file"), style).alias("sample"), taxon_id(rank, tax, F.col(rank)).alias("taxon_id"), *[r for r in RANKS if r in names], value.alias("value"))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if rows is None:
        rows = spark.createDataFrame([], f"sample string, taxon_id string, {rank} string, value double")
    return rows, sorted(failed)


def read_abundance(spark: SparkSession, path: str | list[str], kind: str = "relative", rank: str = "species", style: str = "accession") -> DataFrame:
    """(sample, taxon_id, the ranks there are, value) of per-sample tables; a file that can't be used is an error. See `read_tables`."""
    return read_tables(spark, path, kind, rank, style)[0]


def file_role(path: str) -> str | None:
    """What a per-sample table holds, by its name: relative, counts or assignments."""
    name = path.rsplit("/", 1)[-1].lower()
    if "rel" in name and "abundance" in name:
        return "relative"
    return "counts" if "count" in name else "assignments" if "assign" in name else None


def find_roles(spark: SparkSession, folder: str, pattern: str = "*.tsv") -> dict[str, list[str]]:
    """The tables of a folder and those in it by their role, in the order of their names. A folder that has tables has a relative one, or it
    is an error: folders are samples, or hold the tables of several."""
    out: dict[str, list[str]] = {"relative": [], "counts": [], "assignments": []}
    of: dict[str, set[str]] = {}
    for path in (f for f in list_files(spark, folder) if fnmatch.fnmatch(f.rsplit("/", 1)[1], pattern)):
        if role := file_role(path):
            out[role].append(path)
            of.setdefault(path.rsplit("/", 1)[0], set()).add(role)
    without = [f for f, roles in of.items() if "relative" not in roles]
    if without or not of:
        raise ValueError(f"no table of relative abundances in {', '.join(without or [folder])}")
    return out


def read_runs(spark: SparkSession, paths: list[str], key: str = "Run") -> DataFrame:
    """Run tables as one: runs that begin with SRR, the first row of each."""
    tables = [valid_runs(read_table_find_header(spark, p, key, sniff(spark, p)), key) for p in paths]
    return union_first(tables, key)


def read_sample_list(spark: SparkSession, path: str, col: str = "bacteria_barcode") -> DataFrame:
    df = read_any(spark, path)
    if col in df.columns:
        return df.select(F.trim(col).alias("sample")).where("sample <> ''").distinct()
    return spark.read.text(path).select(F.trim("value").alias("sample")).where("sample <> ''").distinct()


def read_totals(spark: SparkSession, path: str, col: str, key: str = "barcode") -> DataFrame:
    """(sample, total): whole numbers, rows without one left out, the last row of a barcode wins."""
    df = read_delimited(spark, path, [key, col], ("\t", ";", ","))
    rows = df.select(F.trim(key).alias("sample"), F.floor(F.col(f"`{col}`").try_cast("double")).alias("total"), F.monotonically_increasing_id().alias("ord")).where("total is not null")
    return dedupe(rows, "sample", ["ord"], "last").drop("ord")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(sample, fastq) of samples with exactly one path."""
    df = read_delimited(spark, path, ["sample", "fastq"], ("\t", ";", ","))
    return df.groupBy("sample").agg(F.count("fastq").alias("n"), F.min("fastq").alias("fastq")).where("n = 1").drop("n")


def read_statistics(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A statistics table with its run in front: the header holds Muestra, the label an accession."""
    df = read_table_find_header(spark, path, "Muestra", sep)
    return valid_runs(df.select(run_id(F.col("Muestra")).alias("run"), "*"))
