"""Sources, sinks and the stream on small files."""

import gzip

import pytest
from pyspark.sql import functions as F

from taxaflow.functions import names as N
from taxaflow.sources import fastq, sinks, tables
from taxaflow.streaming import yields

RECORDS = "@r1 x\nACGT\n+\n@III\n@r2\n\n+\n\n@r3\nacgn\n+r3\nII+@\n"


def test_fastq_plain_and_compressed(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(RECORDS + "@r4\nAC\n")
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(RECORDS)
    (tmp_path / "notes.txt").write_text("no")
    got = fastq.read_fastq(spark, str(tmp_path)).orderBy("file", "read_ord").collect()
    assert [(r["sample"], r["read_id"], r["seq"], r["qual"]) for r in got] == [(s, i, q, u) for s in "ab" for i, q, u in (("r1", "ACGT", "@III"), ("r2", "", ""), ("r3", "acgn", "II+@"))]
    assert fastq.read_fastq(spark, str(tmp_path), glob="a*").count() == 3
    assert fastq.read_fastq(spark, str(tmp_path / "b.fq.gz"), glob="a*").count() == 3


@pytest.mark.parametrize("size", [1, 7, 16, 50, 1000])
def test_fastq_ranges_hold_each_record_once(spark, tmp_path, size):
    (tmp_path / "a.fastq").write_text("".join(f"@r{i}\n{'ACGT' * (i % 5 + 1)}\n+\n{'@+II' * (i % 5 + 1)}\n" for i in range(30)))
    got = [r["read_id"] for r in fastq.read_fastq(spark, str(tmp_path), range_bytes=size * 10).orderBy("read_ord").collect()]
    assert got == [f"r{i}" for i in range(30)]


def test_fasta(spark, tmp_path):
    (tmp_path / "p.fasta").write_text(">one\nacgt\nNNR\n>empty\n\n>two x\nTT-T\n")
    assert {(r["name"], r["seq"]) for r in fastq.read_fasta(spark, str(tmp_path / "p.fasta")).collect()} == {("one", "ACGTNN"), ("two x", "TTT")}
    assert {r["seq"] for r in fastq.read_fasta(spark, str(tmp_path / "p.fasta"), iupac_to_n=True).collect()} == {"ACGTNNN", "TTT"}


def test_layout(spark):
    files = spark.createDataFrame([("/d/barcode01/b.bam",), ("/d/barcode01/a.bam",), ("/d/barcode12/a.bam",), ("/d/barcode99/a.bam",), ("/d/x/a.bam",)], "file string")
    assert {(r["barcode"], r["file"]) for r in fastq.samples_from_layout(files, 73).collect()} == {("barcode01", "/d/barcode01/a.bam"), ("barcode12", "/d/barcode12/a.bam")}


def test_tables(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("title\n\nMuestra\t reads \nSRR1_x\t5\nother\t6\n")
    got = tables.read_statistics(spark, str(tmp_path / "h.tsv")).collect()
    assert [(r["run"], r["reads"]) for r in got] == [("SRR1", "5")]
    (tmp_path / "c.csv").write_text("ID,Barcode\n1,barcode01\n")
    assert tables.read_delimited(spark, str(tmp_path / "c.csv"), ["ID", "Barcode"]).count() == 1
    with pytest.raises(ValueError, match="Barcode"):
        tables.read_delimited(spark, str(tmp_path / "c.csv"), ["Nothing"])
    (tmp_path / "t.tsv").write_text("barcode\tn\nb1\t3.7\nb2\tx\nb1\t5.2\n")
    assert {(r["sample"], r["total"]) for r in tables.read_totals(spark, str(tmp_path / "t.tsv"), "n").collect()} == {("b1", 5)}
    (tmp_path / "m.tsv").write_text("sample\tfastq\na\tx\nb\ty\nb\tz\n")
    assert [(r["sample"], r["fastq"]) for r in tables.read_manifest(spark, str(tmp_path / "m.tsv")).collect()] == [("a", "x")]
    (tmp_path / "l.txt").write_text("s1\n s2 \n\ns1\n")
    assert {r["sample"] for r in tables.read_sample_list(spark, str(tmp_path / "l.txt")).collect()} == {"s1", "s2"}
    for i, rows in enumerate(("SRR1\ta\nSRR2\tb\n", "SRR2\tc\nSRR3\td\nx\te\n")):
        (tmp_path / f"r{i}.tsv").write_text("Run\tname\n" + rows)
    assert {(r["Run"], r["name"]) for r in tables.read_runs(spark, [str(tmp_path / "r0.tsv"), str(tmp_path / "r1.tsv")]).collect()} == {("SRR1", "a"), ("SRR2", "b"), ("SRR3", "d")}


@pytest.mark.parametrize("text", ["id\tbarcode01\tbarcode02\nspecies|1|x\t2\t0\nspecies|2|y\t1\t3\n", "id\tspecies|1|x\tspecies|2|y\nbarcode01\t2\t1\nbarcode02\t0\t3\n"])
def test_feature_table_either_way(spark, tmp_path, text):
    (tmp_path / "f.tsv").write_text(text)
    got = {(r["sample"], r["taxon_id"], r["value"]) for r in tables.read_feature_table(spark, str(tmp_path / "f.tsv")).collect()}
    assert got == {("barcode01", "species|1|x", 2.0), ("barcode01", "species|2|y", 1.0), ("barcode02", "species|2|y", 3.0)}


def test_abundance_columns(spark, tmp_path):
    (tmp_path / "SRR12345_rel-abundance.tsv").write_text("tax_id\tSpecies\tgenus\tabundance\testimated counts\n1\tx\tg\t0.4\t40\nunassigned\t\t\t0.6\t60\n")
    rel = {(r["sample"], r["taxon_id"], r["value"]) for r in tables.read_abundance(spark, str(tmp_path)).collect()}
    assert rel == {("SRR12345", "species|1|x", 0.4), ("SRR12345", "species|unassigned|Unassigned", 0.6)}
    assert {r["value"] for r in tables.read_abundance(spark, str(tmp_path), "count").collect()} == {40.0, 60.0}


def test_lineage_placeholder(spark):
    assert spark.range(1).select(N.rank_from_lineage(F.lit("k__Bacteria; g__uncultured"), "genus").alias("x")).first()["x"] == "Unassigned"


def test_publish_all_or_nothing(spark, tmp_path):
    target = str(tmp_path / "out")
    good, bad = spark.range(3), spark.range(3).where(F.assert_true(F.col("id") < 2).isNull())
    with pytest.raises(Exception):  # noqa: B017
        sinks.publish({"a": good, "b": bad}, target)
    assert sinks.published(spark, target) is None and not list(tmp_path.glob("out/version-*"))
    sinks.publish({"a": good}, target)
    with pytest.raises(FileExistsError):
        sinks.publish({"a": good}, target)
    sinks.publish({"a": spark.range(5)}, target, force=True)
    assert spark.read.parquet(f"{sinks.published(spark, target)}/a").count() == 5


def test_rows_split_by_a_check(spark):
    good, failed = sinks.on_error(spark.range(4), F.col("id") < 3)
    assert (good.count(), failed.count()) == (3, 1)
    with pytest.raises(Exception, match="failed"):
        sinks.on_error(spark.range(4), F.col("id") < 3, "stop")[0].collect()


def test_taxonomy_last_lineage_wins(spark, tmp_path):
    t = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 1)], "taxon_id string, lineage string, ord int")
    sinks.write_taxonomy(t, str(tmp_path / "tax"))
    got = spark.read.csv(str(tmp_path / "tax"), sep="\t", header=True).collect()
    assert {(r["taxon_id"], r["lineage"]) for r in got} == {("a", "y"), ("b", "z")}


def test_yields_of_a_stream(spark, tmp_path):
    rows = [(str(i), "b1", f"2024-01-01 0{h}:{i % 60:02d}:00", 100 + i, 5.0 + i) for h in range(5) for i in range(10)]
    df = spark.createDataFrame(rows, "read_id string, barcode string, ts string, length long, mean_q double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    q = yields.write_yields(yields.read_summaries(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert got and all(r["reads"] == 10 and r["passed"] == 5 for r in got)
