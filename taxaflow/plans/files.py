"""Queries that write a table by a sink and read it again by a source; their SQL reads the table itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.operators import abundance as A
from taxaflow.operators import diversity as D
from taxaflow.shared import new_path, saved
from taxaflow.sources import fastq, sinks, tables

from .registry import query, r6
from .views import Views


def _path(v: Views, what: str) -> str:
    return new_path(v.spark, what)


def _lines(rows: DataFrame, path: str, *cells: Column, sep: str = "\t") -> None:
    rows.select(F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]).alias("value")).write.text(path)


@query("select sample, read_id::varchar as read_id, length(seq)::bigint as bases, md5(seq) as seq, md5(qual) as qual from reads")
def fastq_files(v: Views) -> DataFrame:
    """SRC-1, SRC-3, SNK-4: reads as FASTQ files in a folder for each sample, read back in byte ranges."""
    path = _path(v, "fastq")
    sinks.write_fastq(v.reads, path)
    back = fastq.read_fastq(v.spark, path, glob="*.fastq", recursive=True, range_bytes=1 << 20)
    sample = F.regexp_extract("file", "/sample=([^/]+)/", 1).alias("sample")
    return back.select(sample, "read_id", F.length("seq").cast("long").alias("bases"), F.md5(F.col("seq").cast("binary")).alias("seq"), F.md5(F.col("qual").cast("binary")).alias("qual"))


@query(", f as (select read_id, upper(regexp_replace(seq, '[^ACGTN]', '', 'g')) as seq from reads) select 'read ' || read_id as name, length(seq)::bigint as bases, md5(seq) as seq from f where seq <> ''")
def fasta_records(v: Views) -> DataFrame:
    """SRC-2: sequences on lines of 60 letters."""
    path = _path(v, "fasta")
    wrapped = F.regexp_replace("seq", "(.{60})(?=.)", "$1\n")
    v.reads.repartition(16, "read_id").select(F.concat(F.lit(">read "), "read_id", F.lit("\n"), F.lower(wrapped)).alias("value")).write.text(path)
    return fastq.read_fasta(v.spark, path).select("name", F.length("seq").cast("long").alias("bases"), F.md5(F.col("seq").cast("binary")).alias("seq"))


_FILES = ", fl as (select s_nationkey as no, '/run/' || case when s_acctbal < 0 then 'other' else 'barcode' || lpad(s_nationkey::varchar, 2, '0') end || '/' || s_name || '.bam' as file from supplier)"


@query(_FILES + " select 'barcode' || lpad(no::varchar, 2, '0') as barcode, min(file) as file from fl where file like '%barcode%' and no between 1 and 20 group by no")
def barcode_layout(v: Views) -> DataFrame:
    """SRC-4: the first file of each barcode folder, up to barcode 20."""
    folder = F.when(F.col("s_acctbal") < 0, "other").otherwise(F.format_string("barcode%02d", "s_nationkey"))
    return fastq.samples_from_layout(v.table("supplier").select(F.concat(F.lit("/run/"), folder, F.lit("/"), "s_name", F.lit(".bam")).alias("file")), 20)


_NAMED = "'species|' || taxon_id || '|part ' || taxon_id"


def _sample_tables(v: Views, path: str) -> None:
    """Tables of three layouts, a folder for each: other columns, another order, ranks in another case, shares under no telling name; and
    for each region one of no table at all. Each layout reads the shares, so they are saved."""
    rel = saved(A.to_relative(v.ab), "shares")
    rows = rel.select(F.concat(F.lit("SRR1000"), "sample").alias("sample"), F.col("taxon_id").alias("tax_id"), F.concat(F.lit("part "), "taxon_id").alias("name"), F.col("value").alias("share"), (F.col("value") * 1000).alias("n"), (F.col("sample").cast("int") % 3).alias("k"))
    layouts = (
        ["tax_id", F.col("name").alias("species"), F.col("share").alias("abundance"), F.col("n").alias("estimated counts")],
        [F.col("n").alias("estimated counts"), F.col("share").alias("abundance"), F.col("name").alias("Species"), "tax_id", F.lit("g").alias("genus")],
        [F.col("name").alias("SPECIES"), F.col("n").alias("reads"), "tax_id", "share"],
    )
    for k, columns in enumerate(layouts):
        sinks.write_sample_tables(rows.where(F.col("k") == k).select("sample", *columns), f"{path}/{k}", suffix="_rel-abundance.tsv")
    text = F.when(F.col("r_regionkey") % 2 == 0, "garbage").otherwise("species\tabundance\npart 1\t0.5\t0.5\t7")
    v.table("region").select(F.concat(F.lit("SRR90000"), "r_regionkey").alias("sample"), text.alias("value")).write.partitionBy("sample").text(f"{path}/3")
    sinks._rename(v.ab, f"{path}/3", ".txt", lambda f, _: f"{path}/3/{f.getParent().getName().split('=', 1)[1]}_rel-abundance.tsv")


@query(f"select 'SRR1000' || sample as sample, {_NAMED} as taxon_id, round(value, 6) + 0.0 as value from rel")
def abundance_files(v: Views) -> DataFrame:
    """SRC-5, SNK-3: tables of shares, found by their names; files that aren't tables are skipped."""
    path = _path(v, "abundance")
    _sample_tables(v, path)
    found = tables.find_roles(v.spark, path)["relative"]
    return tables.read_tables(v.spark, found, policy="skip")[0].select("sample", "taxon_id", r6("value").alias("value"))


@query("select 'SRR90000' || r_regionkey as sample, case when r_regionkey % 2 = 0 then 'no species column' else 'a row has more cells than the header' end as reason from region")
def failed_files(v: Views) -> DataFrame:
    """SNK-3: the files that were skipped, with their reasons."""
    path = _path(v, "abundance")
    _sample_tables(v, path)
    failed = tables.read_tables(v.spark, tables.find_roles(v.spark, path)["relative"], policy="skip")[1]
    rows = v.spark.createDataFrame(failed, "file string, reason string")  # a row for each skipped file
    return rows.select(F.regexp_extract("file", "(SRR\\d+)", 1).alias("sample"), "reason")


@query("select s_suppkey as no, s_name as reads from supplier where s_acctbal >= 0")
def header_below(v: Views) -> DataFrame:
    """SRC-6: a header on the third row."""
    path = _path(v, "statistics")
    head = v.spark.createDataFrame([(0, "Report"), (1, ""), (2, "Muestra\t reads ")], "ord long, value string")
    body = v.table("supplier").select(F.col("s_suppkey").alias("n"), F.concat(F.when(F.col("s_acctbal") < 0, "other").otherwise("SRR"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0"), F.lit("_x")).alias("run"), "s_name")
    rows = head.unionByName(body.select((F.col("n") + 10).alias("ord"), F.concat_ws("\t", "run", "s_name").alias("value")))
    rows.repartition(1).sortWithinPartitions("ord").select("value").write.text(path)
    return tables.read_statistics(v.spark, path).select(F.regexp_extract("run", "^SRR0*([0-9]+)$", 1).cast("long").alias("no"), "reads")


@query("select c_custkey as id, c_name as name from customer")
def delimited(v: Views) -> DataFrame:
    """SRC-7: the delimiter that gives the required columns."""
    path = _path(v, "delimited")
    v.table("customer").select(F.col("c_custkey").alias(" id "), F.col("c_name").alias("name")).write.csv(path, sep=",", header=True)
    return tables.read_delimited(v.spark, path, ["id", "name"]).select(F.col("id").cast("long").alias("id"), "name")


@query(f"select 'barcode' || lpad(sample, 2, '0') as sample, {_NAMED} as taxon_id, value from ab")
def feature_table(v: Views) -> DataFrame:
    """SRC-8, SNK-1: the wide table of counts."""
    path = _path(v, "features")
    ab = v.ab.select(F.concat(F.lit("barcode"), F.lpad("sample", 2, "0")).alias("sample"), F.concat(F.lit("species|"), "taxon_id", F.lit("|part "), "taxon_id").alias("taxon_id"), "value")
    sinks.write_feature_table(ab, path)
    return tables.read_feature_table(v.spark, path)


@query("select a as sample, b as taxon_id, round(d, 6) + 0.0 as value from bc where d > 0 union all select b, a, round(d, 6) + 0.0 from bc where d > 0")
def square_table(v: Views) -> DataFrame:
    """RSH-4: the square table of distances, written as lines and read back."""
    path = _path(v, "square")
    sinks.write_square(D.bray_curtis(v.ab), path)
    return tables.read_feature_table(v.spark, path).withColumn("value", r6("value"))


_RUNS = ", r as (select 'SRR' || o_orderkey as run, o_orderstatus as status, 0 as t from orders where o_orderstatus <> 'O' union all select case when o_orderpriority = '1-URGENT' then 'x' else 'SRR' end || o_orderkey, o_orderpriority, 1 from orders)"


@query(_RUNS + " select run as \"Run\", arg_min(status, t) as status from r where run like 'SRR%' group by run")
def run_tables(v: Views) -> DataFrame:
    """SRC-9: two run tables; of a run that both have the first one's row."""
    key, paths = F.col("o_orderkey"), [_path(v, "runs"), _path(v, "runs")]
    orders = v.table("orders")
    sinks.write_table(orders.where("o_orderstatus <> 'O'").select(F.concat(F.lit("SRR"), key).alias("Run"), F.col("o_orderstatus").alias("status")), paths[0], "tsv")
    sinks.write_table(orders.select(F.concat(F.when(F.col("o_orderpriority") == "1-URGENT", "x").otherwise("SRR"), key).alias("Run"), F.col("o_orderpriority").alias("status")), paths[1], "csv")
    return tables.read_runs(v.spark, paths)


@query("select distinct o_orderpriority as sample from orders")
def sample_list(v: Views) -> DataFrame:
    """SRC-10."""
    path = _path(v, "list")
    v.table("orders").select(F.concat(F.lit(" "), "o_orderpriority").alias("bacteria_barcode"), "o_orderkey").write.csv(path, sep=";", header=True)
    return tables.read_sample_list(v.spark, path)


@query("select c_custkey::varchar as sample, floor(c_acctbal)::bigint as total from customer where c_mktsegment <> 'BUILDING'")
def read_totals(v: Views) -> DataFrame:
    """SRC-11: totals cut to whole numbers; what isn't a number doesn't count."""
    path = _path(v, "totals")
    value = F.when(F.col("c_mktsegment") == "BUILDING", "none").otherwise(F.col("c_acctbal").cast("string"))
    v.table("customer").select(F.col("c_custkey").alias("barcode"), value.alias("reads")).write.csv(path, sep="\t", header=True)
    return tables.read_totals(v.spark, path, "reads")


@query("select o_custkey::varchar as sample, min(o_orderkey)::varchar as fastq from orders group by 1 having count(*) = 1")
def manifest(v: Views) -> DataFrame:
    """SRC-12: samples with one path."""
    path = _path(v, "manifest")
    v.table("orders").select(F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("fastq")).write.csv(path, sep="\t", header=True)
    return tables.read_manifest(v.spark, path)


@query("select 'alpha' as \"table\", count(distinct sample) as \"rows\" from ab union all select 'counts', count(*) from ab")
def published(v: Views) -> DataFrame:
    """SNK-2: two tables published at once, twice, the second time over the first."""
    path = _path(v, "published")
    for force in (False, True):
        sinks.publish({"alpha": v.ab.select("sample").distinct(), "counts": v.ab}, path, force)
    count = lambda name: v.spark.read.parquet(f"{sinks.published(v.spark, path)}/{name}").agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
    return count("alpha").union(count("counts"))


@query("select sample, count(*) filter (length(seq) > 100) as good, count(*) filter (length(seq) <= 100) as failed from reads group by 1")
def split_by_check(v: Views) -> DataFrame:
    """SNK-3: rows that pass a check and those that fail it."""
    good, failed = sinks.on_error(v.reads, F.length("seq") > 100)
    both = good.select("sample", F.lit(1).alias("g")).unionByName(failed.select("sample", F.lit(0).alias("g")))
    return both.groupBy("sample").agg(F.count_if(F.col("g") == 1).alias("good"), F.count_if(F.col("g") == 0).alias("failed"))


@query("select sample, count(*) as reads, sum(length(seq))::bigint as bases from reads group by 1")
def outputs_by_barcode(v: Views) -> DataFrame:
    """SNK-4."""
    path = _path(v, "barcodes")
    sinks.write_by_barcode(v.reads, path)
    return v.spark.read.schema(v.reads.schema).parquet(path).groupBy("sample").agg(F.count("*").alias("reads"), F.sum(F.length("seq")).cast("long").alias("bases"))


@query("select l_partkey::varchar as taxon_id, arg_max(l_comment, l_orderkey * 10 + l_linenumber) as lineage from (select l_partkey, l_orderkey, l_linenumber, l_returnflag as l_comment from lineitem) group by 1")
def taxonomy_file(v: Views) -> DataFrame:
    """SNK-5: the last lineage of each id; a second write that keeps doesn't change it."""
    path = _path(v, "taxonomy")
    rows = v.table("lineitem").select(F.col("l_partkey").alias("taxon_id"), F.col("l_returnflag").alias("lineage"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    sinks.write_taxonomy(rows, path)
    sinks.write_taxonomy(rows.limit(0), path, keep=True)
    return v.spark.read.csv(path, sep="\t", header=True)
