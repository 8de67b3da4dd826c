"""Operators in many blocks, ranges or panels give what they give in one, and hot keys are spread."""

import random
from hashlib import md5
from math import comb
from statistics import median, quantiles

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from taxaflow.operators import abundance as A
from taxaflow.operators import comparison as C
from taxaflow.operators import diversity as D
from taxaflow.operators import em, hypothesis, ranges, rarefaction
from taxaflow.plans import files
from taxaflow.plans.views import Views
from taxaflow.sources import fastq, sinks, tables

AB = "sample string, taxon_id string, value double"


def rows_of(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_distances_in_blocks(spark, monkeypatch):
    rng = random.Random(0)
    ab = spark.createDataFrame([(f"s{s}", f"t{t}", float(rng.randrange(1, 4))) for s in range(17) for t in range(30) if rng.random() < 0.4], AB).cache()
    other = ab.where("sample < 's3'").withColumn("value", F.col("value") + 1)
    every = lambda: [rows_of(t) for t in (*(m(ab) for m in D.METRICS.values()), D.bc_between(ab, other))]
    one = every()
    monkeypatch.setattr(D, "SAMPLE_BLOCK", 3)
    assert every() == one and len(one[0]) == 17 * 16 // 2


def test_two_distances_meet_once(spark, monkeypatch):
    rng = random.Random(9)
    ab = spark.createDataFrame([(f"s{s}", f"t{t}", float(rng.randrange(0, 4))) for s in range(9) for t in range(20) if rng.random() < 0.4] + [("z", "t0", 0.0)], AB)
    want = [rows_of(D.bray_curtis(ab)), rows_of(D.jaccard(ab))]
    met, shared = [], D._shared
    monkeypatch.setattr(D, "_shared", lambda *a: met.append(1) or shared(*a))
    assert [rows_of(t) for t in D.bray_and_jaccard(ab)] == want and met == [1]


def test_a_taxon_in_all_samples_is_spread(spark):
    ab = spark.range(5_000).select(F.concat(F.lit("s"), "id").alias("sample"), F.lit("t").alias("taxon_id"), F.lit(1.0).alias("value"))
    left, right = D.dealt_to_blocks(ab)
    most = lambda t: t.groupBy("taxon_id", "i", "j").count().agg(F.count("*"), F.max("count")).first()
    blocks = 20
    for side in (left, right):
        n, size = most(side)
        assert n == blocks * (blocks + 1) // 2 and size < 2 * D.SAMPLE_BLOCK
        assert side.select(F.spark_partition_id()).distinct().count() > 1
    assert D.dealt_to_blocks(ab.limit(0))[0].count() == 0


def test_pairs_of_two_studies_by_brute_force(spark, monkeypatch):
    one, other = [f"s{i}" for i in range(23)] + ["s1", None], [f"s{i}" for i in range(15, 40)] + ["s20", None]
    sides = [spark.createDataFrame([(s,) for s in x], "sample string") for x in (one, other)]
    want = sorted((a, b) for a in set(one) for b in set(other) if a and b and a != b)
    for block in (D.PAIR_BLOCK, 3):
        monkeypatch.setattr(D, "PAIR_BLOCK", block)
        assert rows_of(D.cross_pairs(*sides)) == want
    assert D.cross_pairs(sides[0], sides[1].limit(0)).count() == D.cross_pairs(sides[0].limit(0), sides[1]).count() == 0


def test_pairs_are_spread_and_their_files_small(spark, tmp_path):
    side = spark.range(1_500).select(F.concat(F.lit("s"), "id").alias("sample"))
    pairs = D.cross_pairs(side, side)
    assert pairs.select(F.spark_partition_id().alias("task")).groupBy("task").count().where("count > 400000").count() == 4
    pairs.write.parquet(str(tmp_path / "pairs"))
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.4 * 1_500 * 1_499


def test_tiles_of_pairs_are_as_many_as_tasks_and_of_bounded_size(spark):
    side = lambda n: spark.range(n).select(F.concat(F.lit("s"), "id").alias("sample"))
    tasks = lambda pairs: sorted(r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect())
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 8, 12):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            sizes = tasks(D.cross_pairs(side(6_000), side(100)))
            assert len(sizes) == n and sum(sizes) == 6_000 * 100 - 100 and sizes[-1] < 1.2 * sum(sizes) / n
        spark.conf.set("spark.sql.shuffle.partitions", 1)
        for one, other in ((50_000, 4), (4, 50_000)):
            sizes = tasks(D.cross_pairs(side(one), side(other)))
            assert sum(sizes) == 4 * 50_000 - 4 and sizes[-1] < 1.1 * 4 * D.TILE_SIDE
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    for n in range(1, 700):
        a, b = D.tiles(n, 1_000, 1_000)
        assert n <= a * b <= 1.25 * n + 1 and a <= b


def test_mantel_in_panels_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    names = [f"s{i:02d}" for i in range(11)]
    pairs = [(a, b) for a in names for b in names if a < b]
    x, y = rng.random(len(pairs)), rng.random(len(pairs))
    d1 = spark.createDataFrame([(a, b, float(v)) for (a, b), v in zip(pairs, x, strict=True)], "a string, b string, d double")
    d2 = spark.createDataFrame([(b, a, float(v)) for (a, b), v in zip(pairs[3:], y[3:], strict=True)], "a string, b string, d double")  # three pairs less
    labels = {r["sample"]: r["labels"] for r in hypothesis.label_arrays(spark.createDataFrame([(s, i) for i, s in enumerate(names)], "sample string, no long"), "no", 30, 42).collect()}
    second = {frozenset(p): v for p, v in zip(pairs[3:], y[3:], strict=True)}
    rs = []
    for k in range(31):
        met = [(v, second[q]) for (a, b), v in zip(pairs, x, strict=True) if (q := frozenset((names[labels[a][k]], names[labels[b][k]]))) in second]
        rs.append(round(float(np.corrcoef(*zip(*met, strict=True))[0, 1]), 9))
    want = (len(pairs) - 3, rs[0], (sum(abs(r) >= abs(rs[0]) for r in rs[1:]) + 1) / 31)
    for cells in (1 << 22, 40):
        monkeypatch.setattr(hypothesis, "PANEL_CELLS", cells)
        monkeypatch.setattr(hypothesis, "PERMUTATION_CELLS", cells)
        got = hypothesis.mantel(d1, d2, 30).first()
        assert (got["n"], round(got["r"], 8), round(got["p"], 9)) == (want[0], round(want[1], 8), round(want[2], 9))


def test_quantiles_are_exact(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice((rng.random(), float(rng.randrange(5)), -1e300)) if g != "one" else 3.5) for g in ("hot",) * 5000 + ("b",) * 40 + ("one",) * 3]
    df = spark.createDataFrame([*rows, ("hot", None), ("none", None)], "g string, v double")
    got = {r["g"]: tuple(r)[1:] for r in ranges.quantiles(df, "v", ["g"], {"q1": 0.25, "m": 0.5, "q3": 0.75}).collect()}
    of = {g: [v for h, v in rows if h == g] for g in ("hot", "b", "one")}
    assert got.keys() == of.keys()
    for g, v in of.items():
        assert got[g] == pytest.approx(quantiles(v, n=4, method="inclusive"))
    pairs = df.where("g = 'hot' and v is not null").select(F.lit(2.0).alias("pre"), (F.col("v") + 2).alias("post"))
    assert C.paired_change(pairs, "pre", "post").first()[0] == pytest.approx(median(v + 2 - 2 for v in of["hot"]))
    assert C.paired_change(pairs.limit(0), "pre", "post").first()[0] is None
    none = C.retention(pairs.limit(0), "pre", "post").first()
    assert none["n"] == 0 and none["median_pct"] is None


def test_ranks_of_a_million_values(spark):
    df = spark.range(1_000_000).select(F.lit("g").alias("g"), F.when(F.col("id") < 990_000, F.hash("id") * 1.0).otherwise(F.lit(7.5)).alias("v"))
    counts = df.groupBy("g", "v").agg(F.count("*").alias("t"))
    _, sizes = ranges.in_ranges(counts, "v", ["g"])
    n, most = sizes.agg(F.count("*"), F.max("size")).first()
    assert n >= ranges.RANGES // 2 and most < 60_000
    got = hypothesis.value_ranks(df, "v", ["g"]).select("v", "t", "rank").toPandas().sort_values("v")
    want = df.select("v").toPandas()["v"]
    rank = pd.DataFrame({"v": want, "r": want.rank()}).drop_duplicates().sort_values("v")
    assert np.allclose(got["v"], rank["v"]) and np.allclose(got["rank"], rank["r"]) and got["t"].sum() == 1_000_000


def test_ranks_of_values_that_differ_when_made_again(spark):
    again = F.udf(lambda x: x + random.random() * 1e-9, "double").asNondeterministic()
    df = spark.range(500).select(F.lit("g").alias("g"), again(F.col("id").cast("double")).alias("v"))
    got = hypothesis.average_rank(df, "v", ["g"]).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 501)) and all(r["rank"] == int(r["v"]) + 1 for r in got)
    counts = df.groupBy("g", "v").agg(F.lit(2).alias("t"))
    assert sorted(r["upto"] for r in ranges.running_counts(counts, "v", ["g"]).collect()) == list(range(2, 1001, 2))


def test_a_wide_table_of_many_samples(spark, tmp_path):
    n = 10_050
    ab = spark.range(n).select(F.concat(F.lit("barcode"), "id").alias("sample"), F.explode(F.array(F.lit("species|1|a"), F.lit('species|2|"b"\tc'))).alias("taxon_id"), (F.col("id") + 0.5).alias("value"))
    ab = ab.where("taxon_id <> 'species|1|a' or sample like '%7'").unionByName(spark.createDataFrame([("barcode3", "species|3|", 2.0)], AB))
    sinks.write_feature_table(ab, str(tmp_path / "wide"))
    lines = spark.read.text(str(tmp_path / "wide")).collect()
    assert {len(r[0].replace('"\tc', "").split("\t")) for r in lines} == {n + 1}
    assert rows_of(tables.read_feature_table(spark, str(tmp_path / "wide"))) == rows_of(ab)


def test_fasta_in_ranges_is_fasta_in_one(spark, tmp_path):
    rng = random.Random(3)
    text, want = "ACG\nTNx\n", [("", "ACGTN")]
    for i in range(400):
        seq = "".join(rng.choice("ACGTN") for _ in range(rng.randrange(1, 200)))
        text += f"{rng.choice(('>', '>', ' >'))}r{i} a->b\n" + "\n".join(seq[k : k + 60].lower() for k in range(0, len(seq), 60)) + rng.choice(("\n", "\n\n", "\r\n"))
        want.append((f"r{i} a->b", seq))
    for name in ("p", "q"):
        (tmp_path / f"{name}.fasta").write_text(text + ">empty\n>  \n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        parts = []
        for size in ("128m", "700"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0" if size == "700" else "4m")
            df = fastq.read_fasta(spark, str(tmp_path))
            parts.append(df.rdd.getNumPartitions())
            assert rows_of(df) == sorted(want * 2)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert parts[1] > 50 > parts[0]


def test_published_sets_are_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "set")
    table = lambda k: spark.range(k).select("id")
    of = lambda: [spark.read.parquet(f"{sinks.published(spark, path)}/{n}").count() for n in ("a", "b")]
    assert sinks.published(spark, path) is None
    sinks.publish({"a": table(1), "b": table(1)}, path)
    with pytest.raises(FileExistsError):
        sinks.publish({"a": table(2), "b": table(2)}, path)
    write = sinks.write_table
    point = sinks._point

    def killed(*_):
        raise KeyboardInterrupt

    for name, at in (("write_table", lambda df, p, f: killed() if p.endswith("b") else write(df, p, f)), ("_point", killed)):
        monkeypatch.setattr(sinks, name, at)
        with pytest.raises(KeyboardInterrupt):
            sinks.publish({"a": table(2), "b": table(2)}, path, force=True)
        assert of() == [1, 1]
        monkeypatch.setattr(sinks, "write_table", write)
        monkeypatch.setattr(sinks, "_point", point)
    sinks.publish({"a": table(3), "b": table(3)}, path, force=True)
    assert of() == [3, 3] and sum(p.name.startswith("version-") for p in (tmp_path / "set").iterdir()) == 1


def numpy_em(hits, tol):
    """Squared extrapolation on one table of hits(sample, read, taxon, likelihood), in NumPy; the number of rounds and the last abundances."""
    s, r, t, l = (hits[c].to_numpy() for c in ("sample", "read_id", "taxon_id", "loglik"))
    keys, k = np.unique(np.array([f"{a}|{b}" for a, b in zip(s, t, strict=True)]), return_inverse=True)
    reads, ri = np.unique(r, return_inverse=True)
    samples, si = np.unique([x.split("|")[0] for x in keys], return_inverse=True)
    of_read = np.zeros(len(reads), int)
    of_read[ri] = si[k]
    top = np.full(len(reads), -np.inf)
    np.maximum.at(top, ri, l)
    like = np.exp(l - top[ri])
    size = np.bincount(of_read)[si]

    def step(f):
        w = f[k] * like
        total = np.bincount(ri, w)
        return np.bincount(k, w / total[ri]) / size, np.bincount(of_read, np.log(total))

    f, done = 1 / np.bincount(si)[si], 0
    by = lambda x: np.bincount(si, x)
    while True:
        f1, then = step(f)
        f2, now = step(f1)
        done += 2
        if (now - then).max() < tol:
            return done, dict(zip(keys, f2, strict=True))
        d, v = f1 - f, f2 - 2 * f1 + f
        a = np.maximum(np.sqrt(by(d * d)) / np.maximum(np.sqrt(by(v * v)), 1e-300), 1)[si]
        g = np.maximum(f + 2 * a * d + a * a * v, 0.01 * f2)
        f3, far = step(g / by(g)[si])
        done += 1
        f = np.where((far >= now)[si], f3, f2)


def test_em_is_numpys(spark):
    rng = random.Random(4)
    rows = [(f"s{i % 2}", f"r{i}", f"t{t}", -rng.random() * 3) for i in range(300) for t in rng.sample(range(8), rng.randrange(1, 4))]
    hits = spark.createDataFrame(rows, "sample string, read_id string, taxon_id string, loglik double")
    rounds = []
    got = {f"{r['sample']}|{r['taxon_id']}": r["value"] for r in em.em_abundance(hits, tol=1e-4, rounds=rounds).collect()}
    done, want = numpy_em(hits.toPandas(), 1e-4)
    assert rounds == [done] and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_em_of_small_and_large_samples_is_one(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(f"s{i % 3}", f"r{i}", f"t{t}", -rng.random() * 3) for i in range(300) for t in rng.sample(range(8), rng.randrange(1, 4))]
    rows += [("s9", f"q{i}", f"t{t}", 0.0) for i in range(3) for t in (1, 2)]
    hits = spark.createDataFrame(rows, "sample string, read_id string, taxon_id string, loglik double")
    got = []
    joins = em._by_joins
    monkeypatch.setattr(em, "_by_joins", lambda *a: got.append("joins") or joins(*a))
    for limit in (1 << 20, 50, 0):
        rounds = []
        out = {(r["sample"], r["taxon_id"]): r["value"] for r in em.em_abundance(hits, tol=1e-4, rounds=rounds, sample_hits=limit).collect()}
        got.append((rounds, out))
    assert [x for x in got if x == "joins"] == ["joins"] * 2 and got[0] != "joins"  # samples that fit a block take no join in each round
    (n1, one), (n2, two), (n3, three) = (x for x in got if x != "joins")
    assert n1 == n2 == n3 and one.keys() == two.keys() == three.keys()
    assert all(abs(one[k] - two[k]) < 1e-9 and abs(one[k] - three[k]) < 1e-9 for k in one)


def test_rarefaction_puts_only_asked_ranges_in_order(spark, monkeypatch):
    rng = random.Random(6)
    ab = [(s, f"t{t}", float(rng.choice((0.5, 1, 1, 2, 9)))) for s in ("a", "b") for t in range(120)] + [("c", "t", 1.0), ("d", "t", 3.7), ("d", "u", 0.8), ("e", "t", 0.6), ("e", "u", 0.6)]
    df = spark.createDataFrame(ab, AB)
    wanted = [tuple(r) for r in rarefaction.depths(df).collect()]
    orders = {}
    for s in "abcde":
        for i in range(1, 4):
            keys = sorted((md5(f"42-{i}-{s}-{t}-{k}".encode()).hexdigest(), t) for r, t, x in ab if r == s for k in range(1, int(x) + 1))
            orders[s, i] = [t for _, t in keys]
    want = sorted((s, d, round(sum(len(set(orders[s, i][:d])) for i in range(1, 4)) / 3, 9)) for s, _, d in wanted)
    for size in (1, 20, 2_000):
        monkeypatch.setattr(rarefaction, "RANGE_SIZE", size)
        assert rows_of(rarefaction.rarefaction(df, iterations=3)) == want


def test_kinds_are_first_seen_as_expected():
    rng = np.random.default_rng(8)
    for counts in (np.array([1] * 50 + [3] * 20 + [10] * 5), np.array([1] * 50 + [40] * 60 + [3_000] * 5)):
        n = int(counts.sum())
        sizes = np.array([1, 5, 0, n // 3, 40, n - n // 3 - 46])
        got = np.mean([rarefaction._first_dealt(counts, sizes, rng).cumsum() for _ in range(400)], 0)
        depth = sizes.cumsum()
        want = [sum(1 - comb(n - int(x), int(d)) / comb(n, int(d)) for x in counts) for d in depth]
        assert np.allclose(got, want, atol=6 * (len(counts) / 400) ** 0.5) and got[-1] == len(counts)
        # A kind's draws grow with its taxa, not with the stretches: a stretch of no individuals takes none.
        assert np.array_equal(rarefaction._first_dealt(counts, np.array([n]), rng), [len(counts)])


def test_rarefaction_by_counts_is_as_expected(spark):
    rng = random.Random(5)
    ab = spark.createDataFrame([(s, f"t{t}", float(rng.choice((1, 1, 2, 5, 300, 1_000_000)))) for s in ("a", "b") for t in range(150)] + [("c", "t", 1.0), ("d", "t", 0.5)], AB)
    for block in (1 << 16, 20):
        got = rarefaction.rarefaction_by_counts(ab, iterations=40, taxa_block=block).toPandas().set_index(["sample", "depth"])["richness"]
        want = rarefaction.rarefaction_expected(ab).toPandas().set_index(["sample", "depth"])["richness"]
        assert set(got.index) == set(want.index)
        assert all(abs(got[k] - want[k]) <= 6 * (want[k] / 40) ** 0.5 + 1e-9 for k in want.index)
        last = got.groupby("sample").max()
        assert (last["a"], last["b"], last["c"]) == (150, 150, 1)
    with pytest.raises(Exception, match="more than 10\\^9"):
        rarefaction.rarefaction_by_counts(spark.createDataFrame([("a", "t", 2e9)], AB)).collect()


def test_a_wide_table_is_made_of_narrow_rows(spark):
    ab = spark.createDataFrame([(f"s{k % 3}", f"t{k % 7}", float(k)) for k in range(40)], AB)
    wide = A.to_wide(ab, ["s0", "s1", "s2"])
    want = {(f"s{k % 3}", f"t{k % 7}"): sum(float(j) for j in range(40) if j % 3 == k % 3 and j % 7 == k % 7) for k in range(1, 40)}
    assert {(r[0], r[1]): r[2] for r in A.to_long(wide).collect()} == want
    # Rows of all columns aren't shuffled: the one exchange is of (sample, taxon_id, value).
    assert wide._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_distances_within_classes(spark, monkeypatch):
    rng = random.Random(3)
    ab = spark.createDataFrame([(f"s{s}", f"t{t}", float(rng.randrange(0, 4))) for s in range(12) for t in range(20) if rng.random() < 0.4] + [("z0", "t0", 0.0), ("z3", "t1", 0.0)], AB)
    of = {r[0]: int(r[0][1:]) % 3 for r in ab.select("sample").distinct().collect() if r[0] != "s4"}
    classes = spark.createDataFrame(list(of.items()), "sample string, class int")
    want = [r for r in rows_of(D.bray_curtis(ab)) if r[0] in of and of.get(r[0]) == of.get(r[1])]
    monkeypatch.setattr(D, "SAMPLE_BLOCK", 2)
    assert rows_of(D.bray_curtis_within(ab, classes)) == want and len(want) > 10
    with pytest.raises(ValueError, match="more than one class"):
        D.bray_curtis_within(ab, classes.union(spark.createDataFrame([("s1", 0)], classes.schema)))


def test_layouts_read_saved_shares(spark, monkeypatch, tmp_path):
    shares, written = [], []
    monkeypatch.setattr(files.A, "to_relative", lambda ab, f=files.A.to_relative: shares.append(1) or f(ab))
    monkeypatch.setattr(files.sinks, "write_sample_tables", lambda rows, path, **_: written.append(rows._jdf.queryExecution().optimizedPlan().toString()))
    monkeypatch.setattr(files.sinks, "_rename", lambda *_: None)
    files._sample_tables(Views(spark, "/root/testdata/sf0.001"), str(tmp_path / "tables"))
    # No layout joins the tables again.
    assert shares == [1] and len(written) == 3 and not any("Join" in x for x in written)
