"""Operators on long abundances ab(sample, taxon_id, value): absent means no row, and means divide by all samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaflow.functions.names import UNASSIGNED, barcode_no, is_unassigned
from taxaflow.shared import never_empty


def _positive(ab: DataFrame) -> DataFrame:
    return ab.where(F.col("value") > 0)


def min_sample_total(ab: DataFrame, n: float) -> DataFrame:
    """Samples whose counts add up to n or more. For count tables only: relative ones add up to 1."""
    enough = ab.groupBy("sample").agg(F.sum("value").alias("t")).where(F.col("t") >= n)
    return ab.join(enough, "sample", "left_semi")


def min_abundance(ab: DataFrame, t: float) -> DataFrame:
    return ab.where(F.col("value") >= t) if t > 0 else ab


def has_rank(ab: DataFrame, rank: str) -> DataFrame:
    return ab.where(F.col(rank).isNotNull() & (F.trim(rank) != "")) if rank in ab.columns else ab


def to_relative(ab: DataFrame) -> DataFrame:
    """Values as shares of their sample; a sample that adds up to 0 keeps its zeros."""
    total = ab.groupBy(F.col("sample").alias("of")).agg(F.sum("value").alias("t"))
    share = F.col("value") / F.when(F.col("t") == 0, 1.0).otherwise(F.col("t"))
    return ab.join(total, F.col("sample") == F.col("of")).withColumn("value", share).drop("of", "t")


def collapse_rank(ab: DataFrame, taxonomy: DataFrame, rank: str) -> DataFrame:
    """Sums by sample and name at a rank; null names go. If no taxon has a taxonomy but samples do, the table is taken the other way round; if
    neither have, an error when the rows are read.

    Both ways are joined and summed in one pass; the few sums then tell which it is.
    """
    known = taxonomy.select(F.col("taxon_id").cast("string").alias("of"), F.col(rank).alias("name"))
    sample, taxon = F.col("sample").cast("string"), F.col("taxon_id").cast("string")
    way = lambda turned, key, rest: F.struct(F.lit(turned).alias("turned"), key.alias("key"), rest.alias("sample"))
    both = ab.select("value", F.explode(F.array(way(False, taxon, sample), way(True, sample, taxon))).alias("w")).select("value", "w.*")
    sums = both.join(known, F.col("key") == F.col("of")).groupBy("turned", "sample", "name").agg(F.sum("value").alias("value"))
    first = sums.agg(F.min("turned").alias("way"))  # one row
    out = sums.join(F.broadcast(first), F.col("turned") == F.col("way")).where("name is not null")
    out = out.select(F.col("sample").cast(ab.schema["sample"].dataType).alias("sample"), F.col("name").alias("taxon_id"), "value")
    return never_empty(out, "no taxon of the table has a taxonomy", sums)


def drop_unassigned(ab: DataFrame) -> DataFrame:
    """Without placeholder names, each sample made to add up to 1 again."""
    return to_relative(ab.where(~is_unassigned(F.col("taxon_id"))))


def drop_unassigned_id(ab: DataFrame) -> DataFrame:
    return ab.where(F.lower("taxon_id") != "unassigned")


def prevalence_filter(ab: DataFrame, total: float = 4, samples: int = 3) -> DataFrame:
    """Taxa that add up to more than `total`; then values rounded up; then taxa present in `samples` samples or more."""
    frequent = ab.groupBy("taxon_id").agg(F.sum("value").alias("t")).where(F.col("t") > total)
    up = ab.join(frequent, "taxon_id", "left_semi").withColumn("value", F.ceil("value").cast("double"))
    spread = up.groupBy("taxon_id").agg(F.count_if(F.col("value") > 0).alias("n")).where(F.col("n") >= samples)
    return up.join(spread, "taxon_id", "left_semi")


def keep_groups(df: DataFrame, groups: list[str], col: str = "grp") -> DataFrame:
    return df.where(F.col(col).isin(groups))


def min_group_size(df: DataFrame, n: int, col: str = "grp") -> DataFrame:
    """Rows of groups with more than n rows."""
    return df.join(df.groupBy(col).agg(F.count("*").alias("n")).where(F.col("n") > n), col, "left_semi")


def group_sizes(samples: DataFrame, col: str = "grp") -> DataFrame:
    return samples.groupBy(col).agg(F.count("*").alias("n"))


def drop_summary_columns(wide: DataFrame) -> DataFrame:
    return wide.drop(*[c for c in wide.columns if c.startswith(("Total_counts", "Frecuencia_"))])


def valid_barcodes(bridge: DataFrame, col: str = "barcode") -> DataFrame:
    return bridge.where(F.col(col).rlike(r"(?i)^barcode\d+$"))


def valid_runs(df: DataFrame, col: str = "run") -> DataFrame:
    return df.where(F.col(col).isNotNull() & F.col(col).startswith("SRR"))


def drop_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropna(subset=keys)


def keep_samples(ab: DataFrame, ids: DataFrame) -> DataFrame:
    """The samples of a list; taxa that only others have go with their rows."""
    return _positive(ab.join(ids.select("sample").distinct(), "sample", "left_semi"))


def rarefaction_inputs(ab: DataFrame, min_reads: int = 1) -> DataFrame:
    return min_sample_total(_positive(ab), min_reads)


def align_samples(tables: list[DataFrame]) -> DataFrame:
    """Per-sample tables (sample, taxon_id, value) as one; a taxon twice in a sample, or no value above 0 at all, is an error when the rows are read."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    once = rows.groupBy("sample", "taxon_id").agg(F.sum("value").alias("value"), F.count("*").alias("n"))
    good = once.where(F.assert_true(F.col("n") == 1, F.concat(F.lit("twice in a sample: "), F.col("taxon_id").cast("string"))).isNull()).select("sample", "taxon_id", "value")
    # The total's row never comes out: it fails or goes.
    total = once.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value")).where(F.assert_true(F.col("value") > 0, "the table of abundances is empty or holds zeros only").isNotNull())
    return good.unionByName(total, allowMissingColumns=True)


def to_wide(ab: DataFrame, samples: list[str] | None = None) -> DataFrame:
    """A row for each taxon and a column for each sample, 0 where absent; for sinks.

    Values are dealt by taxon while they are narrow: else each task makes a row of all columns for each taxon it sees, for one value or two.
    """
    return ab.repartition("taxon_id").groupBy("taxon_id").pivot("sample", samples).agg(F.sum("value")).na.fill(0.0)


def to_long(wide: DataFrame, key: str = "taxon_id") -> DataFrame:
    """(sample, taxon_id, value) of a wide table, without its zeros."""
    own = [c for c in wide.columns if c != key]
    return _positive(wide.unpivot(key, own, "sample", "value")).select("sample", F.col(key).alias("taxon_id"), "value")


def transpose(wide: DataFrame, key: str = "taxon_id", names: list[str] | None = None) -> DataFrame:
    """Columns become rows; the names of the new columns can be given to spare a pass."""
    own = [c for c in wide.columns if c != key]
    return wide.unpivot(key, own, "sample", "value").groupBy("sample").pivot(key, names).agg(F.sum("value"))


def dedupe(df: DataFrame, key: str | list[str], order: list[str], keep: str = "first") -> DataFrame:
    """One row for each key, the first or last in an order; by an aggregate that combines before it shuffles."""
    keys = [key] if isinstance(key, str) else key
    row = F.struct(*[F.col(c) for c in df.columns])
    pick = (F.min_by if keep == "first" else F.max_by)(row, F.struct(*order)).alias("r")
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(pick).select("r.*")


def union_first(tables: list[DataFrame], key: str) -> DataFrame:
    """Tables as one; of rows with one key the first table's first row."""
    rows = None
    for i, t in enumerate(tables):
        t = t.withColumn("__table", F.lit(i))
        rows = t if rows is None else rows.unionByName(t, allowMissingColumns=True)
    order = ["__table", *[c for c in rows.columns if c not in ("__table", key)]]
    return dedupe(rows, key, order).drop("__table")


def union_assignments(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, t in tables.items():
        t = t.withColumn("sample", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def resolve_group(samples: DataFrame, bridge: DataFrame, master: DataFrame, default: str = "Desconocido") -> DataFrame:
    """samples(sample) to bridge(barcode, id) to master(id, grp): the group of each sample, by barcode number. The last of repeated keys wins."""
    b = dedupe(valid_barcodes(bridge).select(barcode_no(F.col("barcode")).alias("no"), F.trim("id").alias("farm")).where("no is not null"), "no", ["farm"], "last")
    m = dedupe(master.select(F.trim("id").alias("farm_id"), F.trim("grp").alias("grp")).where("farm_id is not null"), "farm_id", ["grp"], "last")
    s = samples.select("sample", barcode_no(F.col("sample")).alias("sample_no"))
    out = s.join(b, F.col("sample_no") == F.col("no"), "left").join(m, F.col("farm") == F.col("farm_id"), "left")
    return out.select("sample", "farm", F.coalesce("grp", F.lit(default)).alias("grp"))


def direct_group(samples: DataFrame, meta: DataFrame) -> DataFrame:
    return samples.join(dedupe(meta.dropna(subset=["sample", "grp"]), "sample", ["grp"], "last"), "sample", "left")


def resolve_totals(samples: DataFrame, t1: DataFrame, t2: DataFrame, t3: DataFrame, default: int = 100_000) -> DataFrame:
    """Each sample's true total and where it's from: the cleaning summary, else the assignments, else the reads, else a fixed depth."""
    out = samples
    for k, t in enumerate((t1, t2, t3)):
        out = out.join(t.select("sample", F.col("total").cast("long").alias(f"t{k}")), "sample", "left")
    origin = F.when(F.col("t0").isNotNull(), "cleaning").when(F.col("t1").isNotNull(), "assignments").when(F.col("t2").isNotNull(), "reads").otherwise("pseudo")
    return out.select("sample", F.coalesce("t0", "t1", "t2", F.lit(default)).cast("long").alias("total"), origin.alias("origin"))


def sample_table(runs: DataFrame, article: DataFrame, pre: DataFrame, post: DataFrame) -> DataFrame:
    """runs and article samples on sample_id, then statistics before and after on run; all inner."""
    return runs.join(article, "sample_id").join(pre, "run").join(post, "run")


def present_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def missing_report(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return expected.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def pair_stages(pre: DataFrame, post: DataFrame, key: str = "sample") -> DataFrame:
    """Values of samples in both stages, side by side."""
    rest = [c for c in pre.columns if c != key]
    left = pre.select(key, *[F.col(c).alias(f"{c}_pre") for c in rest])
    return left.join(post.select(key, *[F.col(c).alias(f"{c}_post") for c in rest]), key)


def rekey_samples(ab: DataFrame, mapping: DataFrame) -> DataFrame:
    """ab with samples renamed by mapping(sample, run); a sample that it lacks is an error when the rows are read."""
    out = ab.join(mapping, "sample", "left")
    return out.where(F.assert_true(F.col("run").isNotNull(), F.concat(F.lit("no run for "), F.col("sample"))).isNull()).select(F.col("run").alias("sample"), "taxon_id", "value")


def taxon_summary(ab: DataFrame) -> DataFrame:
    return ab.groupBy("taxon_id").agg(F.sum("value").alias("total"), F.count_if(F.col("value") > 0).alias("n_samples"))


def group_frequency(ab: DataFrame, groups: DataFrame, names: list[str]) -> DataFrame:
    """For each taxon the samples of each group that have it, a column for each group in order; unmapped samples don't count."""
    present = _positive(ab).select("sample", "taxon_id").distinct().join(groups, "sample")
    counts = [F.count_if(F.col("grp") == g).alias(f"Frecuencia_{g}") for g in sorted(names)]
    return present.groupBy("taxon_id").agg(*counts)


def mean_profile(ab: DataFrame) -> DataFrame:
    """Mean of each taxon over all samples, zeros included."""
    n = ab.select(F.count_distinct("sample").alias("n"))
    return ab.groupBy("taxon_id").agg(F.sum("value").alias("s")).crossJoin(F.broadcast(n)).select("taxon_id", (F.col("s") / F.col("n")).alias("mean"))


def merge_taxa(ab: DataFrame, tax_id: Column) -> DataFrame:
    return ab.groupBy("sample", tax_id.alias("taxon_id")).agg(F.sum("value").alias("value"))


def sample_totals(ab: DataFrame) -> DataFrame:
    return ab.groupBy("sample").agg(F.sum("value").alias("assigned"))


def top_taxa(m1: DataFrame, m2: DataFrame, n: int) -> DataFrame:
    """Long rows (taxon_id, study, pct) of the n taxa with the largest sum of both studies' means; absent is 0."""
    a, b = m1.select("taxon_id", F.col("mean").alias("a")), m2.select("taxon_id", F.col("mean").alias("b"))
    both = a.join(b, "taxon_id", "full_outer").na.fill(0.0, ["a", "b"])
    top = both.orderBy(F.desc(F.round(F.col("a") + F.col("b"), 12)), "taxon_id").limit(n)
    return top.select("taxon_id", (F.col("a") * 100).alias("study_1"), (F.col("b") * 100).alias("study_2")).unpivot("taxon_id", ["study_1", "study_2"], "study", "pct")


def order_by(df: DataFrame, key: str) -> DataFrame:
    """total, mean: falling; taxon: by id; barcode: by number, those without last."""
    if key in ("total", "mean"):
        return df.orderBy(F.desc(key), "taxon_id")
    return df.orderBy("taxon_id") if key == "taxon" else df.orderBy(F.coalesce(barcode_no(F.col("sample")), F.lit(999)), "sample")


def allocate(ab: DataFrame, totals: DataFrame) -> DataFrame:
    """Whole counts by largest remainders: floor(p N), and the rest to the largest fractions, ties by taxon id. Sums are totals exactly.

    ab: relative values; totals(sample, total). Below 0 counts as 0; a total or a sum that isn't positive gives zeros.
    """
    p = ab.select("sample", "taxon_id", F.greatest("value", F.lit(0.0)).alias("value"))
    w = W.partitionBy("sample")
    raw = to_relative(p).join(totals.select("sample", F.greatest("total", F.lit(0)).cast("long").alias("total")), "sample").withColumn("raw", F.col("value") * F.col("total"))
    down = raw.withColumn("low", F.floor("raw"))
    # The fraction is rounded, so that one engine's last bit doesn't change an order.
    ranked = down.withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.round(F.col("raw") - F.col("low"), 9)), "taxon_id"))).withColumn("rest", F.col("total") - F.sum("low").over(w)).withColumn("sum", F.sum("value").over(w))
    count = F.when(F.col("sum") > 0, F.col("low") + F.when(F.col("rank") <= F.col("rest"), 1).otherwise(0)).otherwise(0)
    return ranked.select("sample", "taxon_id", count.cast("long").alias("count"))


def collapse_names(ab: DataFrame, names: DataFrame) -> DataFrame:
    """Values by names(taxon_id, name), the unnamed under Unassigned."""
    out = ab.join(names, "taxon_id", "left")
    return out.groupBy("sample", F.coalesce("name", F.lit(UNASSIGNED)).alias("taxon_id")).agg(F.sum("value").alias("value"))
