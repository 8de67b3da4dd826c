"""Cases worked out by hand, invariants, and NumPy checks of what SQL can't say."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxaflow.functions import distributions as P
from taxaflow.functions import sequence as S
from taxaflow.operators import abundance as A
from taxaflow.operators import diversity as D
from taxaflow.operators import em, hypothesis, ordination, rarefaction
from taxaflow.operators import reads as R


def ab(spark, rows):
    return spark.createDataFrame([(s, t, float(v)) for s, t, v in rows], "sample string, taxon_id string, value double")


def lengths(spark, ns):
    return spark.createDataFrame([("s", i, i, "A" * n, "I" * n) for i, n in enumerate(ns)], "sample string, read_id long, read_ord long, seq string, qual string")


@pytest.mark.parametrize("ns, desc, asc", [([2, 3, 5], 5, 3), ([4, 6], 6, 6), ([7], 7, 7)])
def test_n50(spark, ns, desc, asc):
    reads = lengths(spark, ns)
    assert R.n50(reads).first()["n50"] == desc
    assert R.n50(reads, direction="asc").first()["n50"] == asc


def test_median_goes_to_even(spark):
    assert R.stage_stats(lengths(spark, [2, 3])).first()["median_length"] == 2


def test_two_mean_qualities(spark):
    reads = spark.createDataFrame([("s", 1, 1, "AC", "+?")], "sample string, read_id long, read_ord long, seq string, qual string")
    assert R.read_stats(reads).first()["mean_q"] == 20.0
    assert R.stage_stats(reads).first()["mean_q"] == 12.97


@pytest.mark.parametrize("read, pattern, k, fits", [("ACGT", "NCGA", 1, True), ("ACGT", "NCGA", 0, False), ("NCGT", "ACGT", 0, False), ("ACG", "ACGT", 4, False)])
def test_hamming(spark, read, pattern, k, fits):
    assert spark.range(1).select(S.hamming_leq(F.lit(read), F.lit(pattern), k).alias("x")).first()["x"] is fits


def test_pattern_longer_than_window(spark):
    assert spark.range(1).select(S.hit_positions(F.lit("AC"), F.lit("ACGT"), 4).alias("x")).first()["x"] == []


def test_orient_and_trim(spark):
    inner = "TTGACCTTGACCTTGACC"
    plus = "GG" + "GTACAC" + inner + S_revcomp("CATGTA") + "CC"
    rows = [("s", 1, 1, plus, "I" * len(plus)), ("s", 2, 2, S_revcomp(plus), "I" * len(plus)), ("s", 3, 3, "A" * 40, "I" * 40)]
    reads = spark.createDataFrame(rows, "sample string, read_id long, read_ord long, seq string, qual string")
    got = {r["read_id"]: (r["status"], r["strand"], r["seq"], len(r["qual"])) for r in R.orient_and_trim(reads, "GTACAC", "CATGTA", window=20, k=0, min_len=5).collect()}
    assert got[1] == ("classified", "+", inner, len(inner))
    assert got[2] == ("classified", "-", inner, len(inner))
    assert got[3][0] == "unclassified"


def S_revcomp(s):
    return s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


def test_largest_remainder(spark):
    rel = ab(spark, [("s", "a", 0.5), ("s", "b", 0.3), ("s", "c", 0.2), ("z", "a", 0.0)])
    totals = spark.createDataFrame([("s", 7), ("z", 5)], "sample string, total long")
    got = {(r["sample"], r["taxon_id"]): r["count"] for r in A.allocate(rel, totals).collect()}
    assert got == {("s", "a"): 4, ("s", "b"): 2, ("s", "c"): 1, ("z", "a"): 0}


@pytest.mark.parametrize("values, chao1", [([1, 1, 2, 5], 6.0), ([1, 1, 5], 4.0)])
def test_chao1(spark, values, chao1):
    assert D.alpha(ab(spark, [("s", str(i), v) for i, v in enumerate(values)])).first()["chao1"] == chao1


def test_distances(spark):
    t = ab(spark, [("x", "1", 1), ("x", "2", 2), ("y", "2", 2), ("y", "3", 3)])
    assert D.bray_curtis(t).first()["d"] == 0.5
    assert D.jaccard(t).first()["d"] == pytest.approx(1 - 1 / 3)
    empty = ab(spark, [("x", "1", 0), ("y", "1", 0)])
    assert D.bray_curtis(empty).first()["d"] == 0.0
    assert D.jaccard(empty).first()["d"] == 1.0


def test_prevalence_order(spark):
    t = ab(spark, [(s, "a", 1.4) for s in "xyz"] + [(s, "b", 1.3) for s in "xyz"])
    got = A.prevalence_filter(t).collect()
    assert {(r["taxon_id"], r["value"]) for r in got} == {("a", 2.0)} and len(got) == 3


def test_align_finds_a_taxon_twice(spark):
    with pytest.raises(Exception, match="twice in a sample"):
        A.align_samples([ab(spark, [("s", "a", 1)]), ab(spark, [("s", "a", 2)])]).collect()


@pytest.mark.parametrize("n, first, last", [(65, [1, 3, 5], [63, 65]), (66, [1, 3, 5], [65, 66])])
def test_depths(spark, n, first, last):
    got = sorted(r["depth"] for r in rarefaction.depths(ab(spark, [("s", "a", n)])).collect())
    assert got[:3] == first and got[-2:] == last


def test_rarefaction_follows_the_closed_form(spark):
    t = ab(spark, [("s", str(i), 1 + i % 7) for i in range(60)])
    drawn = {r["depth"]: r["richness"] for r in rarefaction.rarefaction(t, iterations=20).collect()}
    expected = {r["depth"]: r["richness"] for r in rarefaction.rarefaction_expected(t).collect()}
    assert drawn.keys() == expected.keys()
    assert drawn[max(drawn)] == 60 == pytest.approx(expected[max(drawn)])
    assert sorted(drawn.values()) == [drawn[k] for k in sorted(drawn)]
    assert all(abs(drawn[k] - expected[k]) < 3 for k in drawn)


def test_pcoa_gives_the_distances_back(spark):
    points = np.random.default_rng(0).normal(size=(7, 3))
    rows = [(f"s{i}", f"s{j}", float(np.linalg.norm(points[i] - points[j]))) for i in range(7) for j in range(i + 1, 7)]
    got = ordination.pcoa(spark.createDataFrame(rows, "a string, b string, d double"), 3).collect()
    x = np.zeros((7, 3))
    for r in got:
        x[int(r["sample"][1:]), r["axis"] - 1] = r["value"]
    for a, b, d in rows:
        assert np.linalg.norm(x[int(a[1:])] - x[int(b[1:])]) == pytest.approx(d, abs=1e-9)
    assert sum({r["axis"]: r["proportion"] for r in got}.values()) == pytest.approx(1.0)


def test_ellipse_against_numpy(spark):
    xy = np.random.default_rng(1).normal(size=(30, 2)) @ np.array([[2.0, 0.5], [0.0, 1.0]])
    got = ordination.ellipses(spark.createDataFrame([("g", float(a), float(b)) for a, b in xy], "grp string, x double, y double")).first()
    values = np.sort(np.linalg.eigvalsh(np.cov(xy.T)))[::-1]
    assert got["width"] == pytest.approx(3.92 * math.sqrt(values[0])) and got["height"] == pytest.approx(3.92 * math.sqrt(values[1]))


def test_p_values():
    assert P.pearson_p_value(0.5, 10) == pytest.approx(0.14111, abs=1e-5)
    assert P.pearson_p_value(1.0, 10) == 0.0 and P.pearson_p_value(0.3, 2) is None
    assert P.mann_whitney_p_value(0, 3, 3, 0) == pytest.approx(0.1)
    assert P.mann_whitney_p_value(4.5, 3, 3, 6.0) == pytest.approx(1.0)
    assert sum(P._u_counts(5, 4)) == math.comb(9, 4)


def test_mann_whitney_needs_two_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0), ("c", 5.0)], "grp string, m double")
    got = hypothesis.mann_whitney(df, ["m"]).collect()
    assert [(r["g1"], r["g2"], r["u"]) for r in got] == [("a", "b", 0.0)]
    assert got[0]["p"] == pytest.approx(1 / 3)


def test_permanova_and_mantel_bounds(spark):
    t = ab(spark, [(f"s{i}", str(j), (i < 4) * 5 * (j < 3) + 1 + (i * j) % 3) for i in range(8) for j in range(6)])
    groups = spark.createDataFrame([(f"s{i}", "g" if i < 4 else "h") for i in range(8)], "sample string, grp string")
    d = D.bray_curtis(t)
    r = hypothesis.permanova(d, groups, 99).first()
    assert 0 < r["p"] <= 0.1 and 0 < r["r2"] < 1 and r["n"] == 8 and r["k"] == 2
    m = hypothesis.mantel(d, d, 49).first()
    assert m["r"] == pytest.approx(1.0) and 0 < m["p"] <= 1


def test_em_splits_ambiguous_reads(spark):
    rows = [("s", f"r{i}", "a", 0.0) for i in range(6)] + [("s", f"q{i}", "b", 0.0) for i in range(2)] + [("s", f"m{i}", t, 0.0) for i in range(4) for t in "ab"]
    got = {r["taxon_id"]: r["value"] for r in em.em_abundance(spark.createDataFrame(rows, "sample string, read_id string, taxon_id string, loglik double"), tol=1e-6).collect()}
    assert got["a"] == pytest.approx(0.75, abs=0.01) and sum(got.values()) == pytest.approx(1.0)


def test_same_sample_whatever_the_partitions(spark):
    reads = lengths(spark, [5] * 40)
    a = sorted(r["read_id"] for r in R.sample_reads(reads, 10, 1).collect())
    b = sorted(r["read_id"] for r in R.sample_reads(reads.repartition(7), 10, 1).collect())
    assert a == b and len(a) == 10
