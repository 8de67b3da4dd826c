"""Errors that a wrong input raises, and inputs that are read all the same."""

import math

import pytest
from pyspark.sql import functions as F

from taxaflow import shared
from taxaflow.operators import abundance as A
from taxaflow.operators import comparison as C
from taxaflow.operators import diversity as D
from taxaflow.operators import hypothesis
from taxaflow.operators import reads as R
from taxaflow.sources import fastq, tables

AB = "sample string, taxon_id string, value double"


def test_no_sample_with_enough_reads(spark):
    reads = spark.createDataFrame([("a", "r", 1, "ACGT", "IIII")], "sample string, read_id string, read_ord long, seq string, qual string")
    assert R.min_reads(reads, 1).count() == 1
    with pytest.raises(ValueError, match="2 reads"):
        R.min_reads(reads, 2)


def test_taxonomy_of_a_table_either_way(spark):
    taxonomy = spark.createDataFrame([("t1", "g1"), ("t2", "g1")], "taxon_id string, genus string")
    ab = spark.createDataFrame([("s", "t1", 1.0), ("s", "t2", 2.0), ("s", "t9", 4.0)], AB)
    turned = ab.select(F.col("taxon_id").alias("sample"), F.col("sample").alias("taxon_id"), "value")
    for t in (ab, turned):
        assert [tuple(r) for r in A.collapse_rank(t, taxonomy, "genus").collect()] == [("s", "g1", 3.0)]
    with pytest.raises(Exception, match="no taxon of the table has a taxonomy"):
        A.collapse_rank(ab.where("taxon_id = 't9'"), taxonomy, "genus").collect()


def test_no_common_taxon(spark):
    ab = spark.createDataFrame([("s", "t1", 1.0)], AB)
    with pytest.raises(Exception, match="no taxon is common"):
        C.compare_means(ab, ab.withColumn("taxon_id", F.lit("t2"))).collect()


def test_alpha_that_is_no_number(spark):
    ab = spark.createDataFrame([("s", "t1", math.nan), ("s", "t2", 1.0)], AB)
    with pytest.raises(Exception, match="NaN in s"):
        D.alpha(ab).collect()


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "a.fastq").write_bytes(b"@r\xff1 x\nAC\xfeGT\n+\nIIII\n@r2\nA\n+\nI\n")
    got = fastq.read_fastq(spark, str(tmp_path)).orderBy("read_ord").collect()
    assert [(r["read_id"], r["seq"]) for r in got] == [("r1", "ACGT"), ("r2", "A")]


def test_roles_of_files(spark, tmp_path):
    for name in ("S1_rel-abundance.tsv", "S1_counts.tsv", "S1_read-assignments.tsv", "S1_notes.tsv"):
        (tmp_path / name).write_text("x\n")
    found = tables.find_roles(spark, str(tmp_path))
    assert {k: [p.rsplit("/", 1)[1] for p in v] for k, v in found.items()} == {"relative": ["S1_rel-abundance.tsv"], "counts": ["S1_counts.tsv"], "assignments": ["S1_read-assignments.tsv"]}
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x_counts.tsv").write_text("x\n")
    with pytest.raises(ValueError, match="relative"):
        tables.find_roles(spark, str(tmp_path / "none"))


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Conf:
        def get(self, key):
            return None

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(Conf)

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)


def test_first_rows_of_one_large_sample(spark, monkeypatch):
    monkeypatch.setattr(R, "SPREAD", 7)
    reads = spark.range(1000).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("sample"), F.col("id").cast("string").alias("read_id"), (1000 - F.col("id")).alias("read_ord"), F.lit("A").alias("seq"), F.lit("I").alias("qual"))
    got = {(r["sample"], int(r["read_id"])) for r in R.first_reads(reads, 30).collect()}
    want = {s: sorted((i for i in range(1000) if (i % 10 == 0) == (s == "b")), reverse=True)[:30] for s in "ab"}
    assert got == {(s, i) for s, rows in want.items() for i in rows}


def test_tests_by_shuffled_joins(spark, monkeypatch):
    d = spark.createDataFrame([(a, b, float((i * 7) % 5 + 1)) for i, (a, b) in enumerate((x, y) for x in "abcdef" for y in "abcdef" if x < y)], "a string, b string, d double")
    groups = spark.createDataFrame([(s, "x" if s < "d" else "y") for s in "abcdef"], "sample string, grp string")
    runs = []
    for limit in (5_000, 0):
        monkeypatch.setattr(hypothesis, "MAX_BROADCAST_SAMPLES", limit)
        monkeypatch.setattr(hypothesis, "PANEL_CELLS", 12 if limit == 0 else 1 << 22)
        monkeypatch.setattr(hypothesis, "PERMUTATION_CELLS", 100 if limit == 0 else 1 << 24)
        runs.append([[round(x, 9) for x in r] for t in (hypothesis.permanova(d, groups, 50), hypothesis.mantel(d, d, 50)) for r in t.collect()])
    assert runs[0] == runs[1] and runs[0][1][1] == 1.0


def test_tables_of_different_headers(spark, tmp_path):
    text = {
        "SRR100001_rel-abundance.tsv": "tax_id\tspecies\tabundance\testimated counts\n1\tA\t0.4\t40\n2\tB\t0.6\t60\n",
        "SRR100002_rel-abundance.tsv": "estimated counts\tabundance\tSpecies\ttax_id\n40.0\t0.4\tA\t1\n60.0\t0.6\tB\t2\n",
        "SRR100003_rel-abundance.tsv": "species\tgenus\tshare\nA\tG\t0.4\nB\t\t0.6\n\tG\t7\n",
        "SRR100004_rel-abundance.tsv": "garbage\n",
        "SRR100005_rel-abundance.tsv": "",
        "SRR100006_rel-abundance.tsv": "species\tabundance\nA\t1\t2\n",
        "SRR100007_rel-abundance.tsv": "species\tname\nA\tx\n",
    }
    for name, t in text.items():
        (tmp_path / name).write_text(t)
    (tmp_path / "SRR100008_rel-abundance.tsv").write_bytes(b"species\tabundance\nA\xff\t1\n")
    found = tables.find_roles(spark, str(tmp_path))["relative"]
    rows, failed = tables.read_tables(spark, found, policy="skip")
    got = {(r["sample"], r["taxon_id"], r["value"]) for r in rows.collect()}
    assert got == {
        *[(f"SRR10000{k}", f"species|{i}|{n}", x) for k in (1, 2) for i, n, x in ((1, "A", 0.4), (2, "B", 0.6))],
        ("SRR100003", "species|NA|A", 0.4), ("SRR100003", "species|NA|B", 0.6), ("SRR100003", "species|NA|Unassigned", 7.0),
    }
    assert [(f.rsplit("/", 1)[1][:9], why) for f, why in failed] == [
        ("SRR100004", "no species column"), ("SRR100005", "empty"), ("SRR100006", "a row has more cells than the header"), ("SRR100007", "no relative column"), ("SRR100008", "not UTF-8"),
    ]
    with pytest.raises(ValueError, match="SRR100004.*no species column"):
        tables.read_abundance(spark, found)
    counts, none = tables.read_tables(spark, found[:2], kind="counts")
    assert {r["value"] for r in counts.collect()} == {40.0, 60.0} and not none
    assert tables.read_tables(spark, found[3:], policy="skip")[0].count() == 0


def test_sample_folder_without_a_relative_table(spark, tmp_path):
    for name in ("a/a_rel-abundance.tsv", "a/a_counts.tsv", "b/b_counts.tsv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x\n")
    with pytest.raises(ValueError, match="/b"):
        tables.find_roles(spark, str(tmp_path))


def test_empty_and_zero_abundances(spark):
    t = spark.createDataFrame([("s", "t1", 0.0), ("s", "t2", 0.5)], AB)
    assert {tuple(r) for r in A.align_samples([t.limit(1), t.where("taxon_id = 't2'")]).collect()} == {("s", "t1", 0.0), ("s", "t2", 0.5)}
    for none in (t.limit(0), t.where("value = 0")):
        with pytest.raises(Exception, match="empty or holds zeros"):
            A.align_samples([none]).collect()
