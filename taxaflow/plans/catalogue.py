"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaflow.functions import names as N
from taxaflow.functions import sequence as S
from taxaflow.operators import abundance as A
from taxaflow.operators import comparison as C
from taxaflow.operators import diversity as D
from taxaflow.operators import em, hypothesis, ordination, rarefaction
from taxaflow.operators import reads as R

from . import files  # noqa: F401  its queries register themselves
from .registry import QUERIES, SQL, query, r6
from .views import Views

PERMUTATIONS, SEED = 999, 42
FORWARD, REVERSE = "GTACAC", "CATGTA"
PRIMERS = ["GTACACGTACGT", "CATGTACATGCA"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _q_list(col: str) -> str:
    return f"list_transform(string_split({col}, ''), lambda c: ascii(c) - 33)"


# Reads ------------------------------------------------------------------------------------------------------------------------------

_N50 = """, lens as (select sample, length(seq)::bigint as len, count(*) as c from good group by 1, 2),
cum as (select sample, len, sum(len * c) over (partition by sample order by len desc) as cd, sum(len * c) over (partition by sample order by len) as ca, sum(len * c) over (partition by sample) as t from lens),
nd50 as (select sample, max(len)::bigint as n50 from cum where cd >= t / 2 group by 1),
na50 as (select sample, min(len)::bigint as n50 from cum where ca >= t / 2 group by 1)
"""


@query(
    _N50
    + f""", g as (select sample, length(seq) as len, length(regexp_replace(seq, '[^GCgc]', '', 'g')) as gc, list_sum({_q_list('qual')}) as q from good)
select sample, count(*) as reads, sum(len)::bigint as bases, round(avg(len), 2) as mean_length, min(len)::bigint as min_length, max(len)::bigint as max_length,
  round(sum(gc) / sum(len) * 100, 2) as gc_pct, round(sum(q) / sum(len), 2) as mean_q, round(min(q / len), 2) as min_q, round(max(q / len), 2) as max_q, n50
from g join nd50 using (sample) group by sample, n50"""
)
def read_stats(v: Views) -> DataFrame:
    return R.read_stats(v.reads)


def _hits(window: str, primers: list[str], k: int) -> str:
    both = [x for p in primers for x in (p, p[::-1].translate(str.maketrans("ACGTN", "TGCAN")))]
    return " or ".join(f"len(list_filter(range(1, length({window}) - {len(p)} + 2), lambda i: hamming(substr({window}, i, {len(p)}), '{p}') <= {k})) > 0" for p in both)


@query(
    f""", f as (select *, row_number() over (partition by sample order by read_ord) as ord from good),
w as (select sample, substr(seq, 1, 120) as h, case when length(seq) > 120 then right(seq, 120) else '' end as t from f where ord <= 10000)
select sample, round(avg(case when {_hits('h', PRIMERS, 2)} or {_hits('t', PRIMERS, 2)} then 1.0 else 0.0 end) * 100, 2) as primer_pct from w group by 1"""
)
def primer_share(v: Views) -> DataFrame:
    return R.primer_share(v.reads, PRIMERS)


@query(_N50 + "select sample, n50 from na50")
def n50_ascending(v: Views) -> DataFrame:
    return R.n50(R.drop_empty(v.reads), direction="asc")


@query(
    _N50
    + """, g as (select sample, length(seq) as len, list_sum(list_transform(string_split(qual, ''), lambda c: pow(10.0, -(ascii(c) - 33) / 10.0))) as err from good)
select sample, count(*) as reads, sum(len)::bigint as bases, round_even(avg(len), 0)::bigint as mean_length, round_even(median(len), 0)::bigint as median_length,
  round(-10 * log10(sum(err) / sum(len)), 2) as mean_q, n50 from g join na50 using (sample) group by sample, n50"""
)
def stage_stats(v: Views) -> DataFrame:
    return R.stage_stats(v.reads)


_FUNNEL = """, c as (select sample, count(*) as reads_raw, count(*) filter (length(seq) >= 400) as reads_oriented, count(*) filter (length(seq) >= 400 and length(seq) <= 3000) as reads_final,
  sum(length(seq))::bigint as bases_raw, coalesce(sum(length(seq)) filter (length(seq) >= 400 and length(seq) <= 3000), 0)::bigint as bases_final from reads group by 1)
"""


@query(
    _FUNNEL
    + """select *, round((reads_raw - reads_oriented) / reads_raw * 100, 2) as pct_removed_oriented, round((reads_raw - reads_final) / reads_raw * 100, 2) as pct_removed_final,
  round(reads_final / reads_raw * 100, 2) as pct_kept, case when bases_raw > 0 then round((bases_raw - bases_final) / bases_raw * 100, 2) else 0 end as pct_removed_bases from c"""
)
def funnel(v: Views) -> DataFrame:
    return R.funnel(v.reads, F.length("seq") >= 400, F.length("seq") <= 3000)


@query(_FUNNEL + "select sample, bucket, \"count\" from (unpivot (select sample, reads_raw, reads_oriented, reads_final from c) on reads_raw, reads_oriented, reads_final into name bucket value \"count\")")
def funnel_long(v: Views) -> DataFrame:
    return R.funnel_long(R.funnel(v.reads, F.length("seq") >= 400, F.length("seq") <= 3000))


@query("select sample, count(*) as reads from reads group by 1")
def count_reads(v: Views) -> DataFrame:
    return R.count_reads(v.reads)


@query("select sample, read_id from (select *, row_number() over (partition by sample order by read_ord) as k from good) where k <= 5")
def first_reads(v: Views) -> DataFrame:
    return R.first_reads(v.reads, 5).select("sample", "read_id")


@query("select sample, read_id from reads where sample in (select sample from reads group by 1 having count(*) >= 50)")
def min_reads(v: Views) -> DataFrame:
    return R.min_reads(v.reads, 50, required=False).select("sample", "read_id")


@query(f"select sample, read_id from good where length(seq) between 1000 and 1700 and list_sum({_q_list('qual')}) / length(seq) >= 8")
def filter_reads(v: Views) -> DataFrame:
    return R.filter_reads(v.reads).select("sample", "read_id")


@query("select read_id, md5(reverse(translate(upper(seq), 'ACGTN', 'TGCAN'))) as digest from reads")
def revcomp_reads(v: Views) -> DataFrame:
    return v.reads.select("read_id", F.md5(S.revcomp(F.col("seq")).cast("binary")).alias("digest"))


_PATTERN = "ACGTNACGTA"


@query(
    f""", h as (select read_id, substr(seq, 1, 10) as s from good where length(seq) >= 10)
select read_id, len(list_filter(range(1, 11), lambda i: substr('{_PATTERN}', i, 1) <> 'N' and substr('{_PATTERN}', i, 1) <> substr(s, i, 1)))::bigint as mismatches from h"""
)
def hamming_heads(v: Views) -> DataFrame:
    heads = v.reads.where(F.length("seq") >= 10).select("read_id", S.head_window(F.col("seq"), 10).alias("s"))
    return heads.select("read_id", S.mismatches(F.col("s"), F.lit(_PATTERN)).cast("long").alias("mismatches"))


@query("select read_id, md5(substr(seq, 1, 120)) as head, md5(case when length(seq) > 120 then right(seq, 120) end) as tail, length(regexp_replace(seq, '[^N]', '', 'g'))::bigint as n from reads")
def end_windows(v: Views) -> DataFrame:
    digest = lambda c: F.md5(c.cast("binary"))
    return v.reads.select("read_id", digest(S.head_window(F.col("seq"), 120)).alias("head"), digest(S.tail_window(F.col("seq"), 120)).alias("tail"), S.n_count(F.col("seq")).cast("long").alias("n"))


_BACK = REVERSE[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


def _place(s: str) -> str:
    head = f"list_filter(range(1, least(length({s}), 120) - {len(FORWARD)} + 2), lambda i: hamming(substr({s}, i, {len(FORWARD)}), '{FORWARD}') <= 1)[1] + {len(FORWARD)}"
    tail = f"list_filter(range(greatest(length({s}) - 120, 0) + 1, length({s}) - {len(_BACK)} + 2), lambda i: hamming(substr({s}, i, {len(_BACK)}), '{_BACK}') <= 1)[-1]"
    return f"{head} as a, {tail} as b"


@query(
    f""", r as (select sample, read_id, upper(seq) as p, reverse(translate(upper(seq), 'ACGTN', 'TGCAN')) as m from reads),
pp as (select sample, read_id, p as s, {_place('p')} from r), mm as (select read_id, m as s, {_place('m')} from r),
j as (select pp.sample, pp.read_id, case when pp.b >= pp.a then '+' when mm.b >= mm.a then '-' end as strand, case when pp.b >= pp.a then pp.b - pp.a when mm.b >= mm.a then mm.b - mm.a end as size,
  case when pp.b >= pp.a then substr(pp.s, pp.a::bigint, pp.b::bigint - pp.a::bigint) when mm.b >= mm.a then substr(mm.s, mm.a::bigint, mm.b::bigint - mm.a::bigint) else pp.s end as seq from pp join mm using (read_id))
select sample, read_id, case when strand is null then 'unclassified' when size < 50 then 'too short' else 'classified' end as status, strand, md5(seq) as digest from j"""
)
def orient_and_trim(v: Views) -> DataFrame:
    cut = R.orient_and_trim(v.reads, FORWARD, REVERSE, window=120, k=1, min_len=50)
    return cut.select("sample", "read_id", "status", "strand", F.md5(F.col("seq").cast("binary")).alias("digest"))


@query(
    """select date_trunc('hour', ts) as window_start, event_type as barcode, count(*) as reads, sum(user_id + 100)::bigint as bases, round(avg(value), 6) + 0.0 as mean_q, round(avg(user_id + 100), 6) + 0.0 as mean_length,
  count(*) filter (value >= 10) as passed, count(*) filter (value < 10) as failed from events group by 1, 2"""
)
def run_yield(v: Views) -> DataFrame:
    return R.run_yield(v.summary).withColumns({"mean_q": r6("mean_q"), "mean_length": r6("mean_length")})


@query(", n as (select count(distinct sample) as n from reads) select sample, read_id from (select *, row_number() over (partition by sample order by md5('42-' || read_id), read_id) as k from reads) where k <= 120000 // (select n from n)")
def sample_reads(v: Views) -> DataFrame:
    return R.sample_reads(v.reads).select("sample", "read_id")


def _files(v: Views) -> DataFrame:
    d = v.table("documents")
    path = F.concat(F.lit("/data/"), F.col("source"), F.when(F.col("doc_id") % 3 == 0, "/SRR").when(F.col("doc_id") % 3 == 1, "/barcode").otherwise("/s"), F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.when(F.col("doc_id") % 5 == 0, "_clean").otherwise(""), F.lit(".fastq.gz"))
    return d.select("doc_id", F.col("source").alias("run"), path.alias("path"))


_FILES = """, files as (select doc_id, source as run, '/data/' || source || case doc_id % 3 when 0 then '/SRR' when 1 then '/barcode' else '/s' end || lpad(doc_id::varchar, 7, '0') || case when doc_id % 5 = 0 then '_clean' else '' end || '.fastq.gz' as path from documents)
"""


@query(_FILES + "select run, path from (select *, row_number() over (partition by run order by (path not like '%clean%'), length(path), path) as k from files) where k = 1")
def best_file(v: Views) -> DataFrame:
    return R.best_file(_files(v))


@query(
    _FILES
    + r""", b as (select *, regexp_replace(regexp_extract(path, '[^/]*$'), '(?i)\.(?:fastq|fq)(?:\.gz)?$', '') as stem, nullif(regexp_extract(path, '((?:SRR|ERR|DRR)\d{5,})', 1), '') as acc from files)
select doc_id, stem, regexp_replace(stem, '_clean$', '') as bare, coalesce(acc, run || '_' || stem) as accession, coalesce(nullif(lower(regexp_extract(path, '(?i)(barcode\d+)', 1)), ''), acc, stem || '.fastq.gz') as barcode from b"""
)
def sample_names(v: Views) -> DataFrame:
    p = F.col("path")
    return _files(v).select("doc_id", N.sample_name(p).alias("stem"), N.sample_name(p, "suffix", "_clean").alias("bare"), N.sample_name(p, "accession").alias("accession"), N.sample_name(p, "barcode").alias("barcode"))


@query(
    _FILES
    + r"""select doc_id, try_cast(nullif(regexp_extract(path, '(?i)barcode0*(\d+)', 1), '') as integer)::varchar as no, 'barcode' || case when length(no) < 2 then '0' else '' end || no as label, nullif(regexp_extract(path, '(SRR\d+)', 1), '') as run, path like '%/barcode%' and doc_id % 5 <> 0 as valid, replace(path, '_clean', '') as plain from files"""
)
def barcode_numbers(v: Views) -> DataFrame:
    p = F.col("path")
    stem = N.sample_name(p)
    return _files(v).select("doc_id", N.barcode_no(p).cast("string").alias("no"), N.barcode_label(N.barcode_no(p)).alias("label"), N.run_id(p).alias("run"), stem.rlike(r"(?i)^barcode\d+$").alias("valid"), F.replace(p, F.lit("_clean"), F.lit("")).alias("plain"))


# Names of taxa ----------------------------------------------------------------------------------------------------------------------


@query(
    """, t as (select p_partkey, 'species|' || p_partkey || '|' || replace(coalesce(nullif(trim(p_name), ''), 'Unassigned'), '|', '_') as taxon, 'genus|NA|' || replace(p_brand, '|', '_') as no_id from part)
select p_partkey, taxon, no_id, string_split(taxon, '|')[2] as tax_id from t"""
)
def taxon_ids(v: Views) -> DataFrame:
    p = v.table("part").select("p_partkey", N.taxon_id("species", F.col("p_partkey"), F.col("p_name")).alias("taxon"), N.taxon_id("genus", None, F.col("p_brand")).alias("no_id"))
    return p.select("*", N.tax_id_of(F.col("taxon")).alias("tax_id"))


@query(
    """, l as (select p_partkey, 'k__Bacteria; p__' || p_type || '; c__; o__uncultured; f__NA; g__' || p_brand || '; s__' || p_name as text from part)
select p_partkey, text, trim(regexp_extract(text, 'g__([^;]+)', 1)) as genus, trim(regexp_extract(text, 'p__([^;]+)', 1)) as phylum, 'Unassigned' as "class", 'Unassigned' as "order", 'Unassigned' as family from l"""
)
def lineage_ranks(v: Views) -> DataFrame:
    text = F.concat(F.lit("k__Bacteria; p__"), F.col("p_type"), F.lit("; c__; o__uncultured; f__NA; g__"), F.col("p_brand"), F.lit("; s__"), F.col("p_name"))
    p = v.table("part").select("p_partkey", text.alias("text"))
    return p.select("*", *[N.rank_from_lineage(F.col("text"), r).alias(r) for r in ("genus", "phylum", "class", "order", "family")])


@query(
    """select p_partkey, 'k__Unassigned; p__' || p_type || '; c__Unassigned; o__Unassigned; f__Unassigned; g__' || p_brand || '; s__' || p_name as lineage from part"""
)
def lineage_strings(v: Views) -> DataFrame:
    none = F.lit("")
    return v.table("part").select("p_partkey", N.lineage(none, F.col("p_type"), none, none, none, F.col("p_brand"), F.col("p_name")).alias("lineage"))


@query(
    """select p_partkey, coalesce(nullif(trim(p_brand), ''), 'Unassigned') as genus from part"""
)
def taxonomy_to_rank(v: Views) -> DataFrame:
    named = N.normalise_ranks(v.table("part").select("p_partkey", F.col("p_brand").alias("Genus")))
    return N.taxonomy_to_rank(named, "genus", "p_partkey")


@query(
    """select c_custkey, case upper(c_mktsegment) when 'BUILDING' then 'Campesina' when 'AUTOMOBILE' then 'Empresarial' else c_mktsegment end as grp,
  coalesce(try_cast(substr(c_name, 10) as double), 0) as number, round((greatest(c_acctbal, 0) + 1e-6) * 100, 6) + 0.0 as scaled, lower(trim(c_mktsegment)) in ('', 'na', 'none') as unassigned from customer"""
)
def group_labels(v: Views) -> DataFrame:
    seg = F.col("c_mktsegment")
    return v.table("customer").select(
        "c_custkey", N.map_group(seg, {"building": "Campesina", "automobile": "Empresarial"}).alias("grp"), N.to_number(F.substring("c_name", 10, 100)).alias("number"),
        r6(N.log_scale_pct(F.col("c_acctbal"))).alias("scaled"), N.is_unassigned(seg).alias("unassigned"),
    )


# Abundances -------------------------------------------------------------------------------------------------------------------------


@query("select sample, taxon_id, round(value, 9) + 0.0 as value from rel")
def to_relative(v: Views) -> DataFrame:
    return A.to_relative(v.ab).select("sample", "taxon_id", (F.round("value", 9) + 0.0).alias("value"))


@query("select sample, genus as taxon_id, sum(value) as value from ab join taxonomy using (taxon_id) where genus is not null group by 1, 2")
def collapse_rank(v: Views) -> DataFrame:
    return A.collapse_rank(v.ab, v.taxonomy, "genus")


@query(
    """, c as (select sample, case genus when 'Brand#11' then 'uncultured' else genus end as taxon_id, sum(value) as value from ab join taxonomy using (taxon_id) group by 1, 2)
select sample, taxon_id, round(value / sum(value) over (partition by sample), 6) + 0.0 as value from c where taxon_id <> 'uncultured'"""
)
def drop_unassigned(v: Views) -> DataFrame:
    names = v.taxonomy.select("taxon_id", F.when(F.col("genus") == "Brand#11", "uncultured").otherwise(F.col("genus")).alias("name"))
    return A.drop_unassigned(A.collapse_rank(v.ab, names, "name")).withColumn("value", r6("value"))


@query("select sample, taxon_id, value from sp where sample in (select sample from sp group by 1 having sum(value) >= 600)")
def min_sample_total(v: Views) -> DataFrame:
    return A.min_sample_total(v.sp, 600)


@query("select sample, taxon_id, value from sp where value >= 2")
def min_abundance(v: Views) -> DataFrame:
    return A.min_abundance(v.sp, 2)


@query("select taxon_id, species from (select taxon_id, case when taxon_id % 7 = 0 then '' when taxon_id % 11 = 0 then null else species end as species from taxonomy) where species is not null and species <> ''")
def has_rank(v: Views) -> DataFrame:
    holed = v.taxonomy.withColumn("species", F.when(F.col("taxon_id") % 7 == 0, "").when(F.col("taxon_id") % 11 == 0, None).otherwise(F.col("species")))
    return A.has_rank(holed, "species").select("taxon_id", "species")


@query(
    """, u as (select sample, taxon_id, value * 0.7 as value from sp), f as (select taxon_id from u group by 1 having sum(value) > 12), up as (select sample, taxon_id, ceil(value)::double as value from u where taxon_id in (select taxon_id from f))
select * from up where taxon_id in (select taxon_id from up group by 1 having count(*) filter (value > 0) >= 14)"""
)
def prevalence_filter(v: Views) -> DataFrame:
    return A.prevalence_filter(v.sp.withColumn("value", F.col("value") * 0.7), 12, 14)


@query("select c_custkey, c_mktsegment as grp from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def keep_groups(v: Views) -> DataFrame:
    return A.keep_groups(v.table("customer").select("c_custkey", F.col("c_mktsegment").alias("grp")), ["BUILDING", "MACHINERY"])


@query("select c_custkey, c_nationkey from customer where c_nationkey in (select c_nationkey from customer group by 1 having count(*) > 60)")
def min_group_size(v: Views) -> DataFrame:
    return A.min_group_size(v.table("customer"), 60, "c_nationkey").select("c_custkey", "c_nationkey")


@query("select c_mktsegment as grp, count(*) as n from customer group by 1")
def group_sizes(v: Views) -> DataFrame:
    return A.group_sizes(v.table("customer").select(F.col("c_mktsegment").alias("grp")))


@query("select sample, taxon_id, value from ab where sample in (select sample from groups where grp = 'ASIA')")
def keep_samples(v: Views) -> DataFrame:
    return A.keep_samples(v.ab, v.groups.where("grp = 'ASIA'"))


@query(_FILES + "select doc_id, 'SRR' || doc_id as run from files where doc_id % 3 = 0")
def valid_runs(v: Views) -> DataFrame:
    named = _files(v).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("SRR"), F.col("doc_id"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("x"), F.col("doc_id"))).alias("run"))
    return A.drop_null_keys(A.valid_runs(named), ["run"])


@query(", t as (select sample, case when taxon_id % 5 = 0 then 'unassigned' else taxon_id::varchar end as taxon_id, value from ab) select sample, taxon_id, sum(value) as value from t where taxon_id <> 'unassigned' group by 1, 2")
def merged_taxa(v: Views) -> DataFrame:
    t = v.ab.withColumn("taxon_id", F.when(F.col("taxon_id") % 5 == 0, "unassigned").otherwise(F.col("taxon_id").cast("string")))
    return A.merge_taxa(A.drop_unassigned_id(t), F.col("taxon_id"))


@query("select sample, count(*) as taxa, sum(value) as total from sp where sample in (select sample from sp group by 1 having sum(value) >= 500) and value > 0 group by 1")
def rarefaction_inputs(v: Views) -> DataFrame:
    return A.rarefaction_inputs(v.sp, 500).groupBy("sample").agg(F.count("*").alias("taxa"), F.sum("value").alias("total"))


_SAMPLES = [str(i) for i in range(25)]


@query("select taxon_id, " + ", ".join(f"coalesce(sum(value) filter (sample = '{s}'), 0) as \"{s}\"" for s in _SAMPLES) + " from ab group by 1")
def to_wide(v: Views) -> DataFrame:
    return A.to_wide(A.align_samples([v.ab]), _SAMPLES)


@query("select sample, taxon_id, value from ab where value > 0")
def to_long(v: Views) -> DataFrame:
    return A.to_long(A.drop_summary_columns(A.to_wide(v.ab, _SAMPLES).withColumn("Total_counts", F.lit(1.0))))


@query(", c as (select sample, genus, sum(value) as value from ab join taxonomy using (taxon_id) group by 1, 2) select sample, " + ", ".join(f"sum(value) filter (genus = 'Brand#{i}') as \"Brand#{i}\"" for i in (11, 12, 13)) + " from c where genus in ('Brand#11', 'Brand#12', 'Brand#13') group by 1")
def transpose(v: Views) -> DataFrame:
    brands = ["Brand#11", "Brand#12", "Brand#13"]
    wide = A.to_wide(A.collapse_rank(v.ab, v.taxonomy, "genus").where(F.col("taxon_id").isin(brands)), _SAMPLES)
    return A.transpose(wide, names=brands)


@query("select c_mktsegment, c_custkey, c_name from (select *, row_number() over (partition by c_mktsegment order by c_acctbal, c_custkey) as k from customer) where k = 1")
def dedupe_first(v: Views) -> DataFrame:
    return A.dedupe(v.table("customer"), "c_mktsegment", ["c_acctbal", "c_custkey"]).select("c_mktsegment", "c_custkey", "c_name")


@query("select c_mktsegment, c_custkey from (select *, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey desc) as k from customer) where k = 1")
def dedupe_last(v: Views) -> DataFrame:
    return A.dedupe(v.table("customer"), "c_mktsegment", ["c_acctbal", "c_custkey"], "last").select("c_mktsegment", "c_custkey")


@query("select sample, grp from groups where grp = 'ASIA' union all select sample, 'second' from groups where grp <> 'ASIA'")
def union_first(v: Views) -> DataFrame:
    return A.union_first([v.groups.where("grp = 'ASIA'"), v.groups.withColumn("grp", F.lit("second"))], "sample")


@query("select 'a' as sample, taxon_id, genus, null as phylum from taxonomy where taxon_id % 2 = 0 union all select 'b', taxon_id, null, phylum from taxonomy where taxon_id % 2 = 1")
def union_assignments(v: Views) -> DataFrame:
    t = v.taxonomy
    return A.union_assignments({"a": t.where("taxon_id % 2 = 0").select("taxon_id", "genus"), "b": t.where("taxon_id % 2 = 1").select("taxon_id", "phylum")}).select("sample", "taxon_id", "genus", "phylum")


@query(
    """, s as (select c_custkey, 'barcode' || case when c_custkey < 10 then '0' else '' end || c_custkey as sample from customer)
select sample, case when c_custkey % 4 <> 0 then 'farm' || n_nationkey end as farm, case when c_custkey % 4 = 0 or n_nationkey % 6 = 0 then 'Desconocido' else r_name end as grp
from s join customer using (c_custkey) join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""
)
def resolve_group(v: Views) -> DataFrame:
    c = v.table("customer")
    label = N.barcode_label(F.col("c_custkey"))
    bridge = c.where("c_custkey % 4 <> 0").select(F.concat(F.lit("Barcode"), F.col("c_custkey")).alias("barcode"), F.concat(F.lit(" farm"), F.col("c_nationkey")).alias("id"))
    master = v.groups.where("cast(sample as int) % 6 <> 0").select(F.concat(F.lit("farm"), F.col("sample")).alias("id"), "grp")
    return A.resolve_group(c.select(label.alias("sample")), bridge, master)


@query("select s.sample, g.grp from (select distinct sample from sp) s left join groups g using (sample)")
def direct_group(v: Views) -> DataFrame:
    return A.direct_group(v.sp.select("sample").distinct(), v.groups)


@query(
    """, s as (select l_suppkey::varchar as sample, count(*) as n, l_suppkey as k from lineitem group by l_suppkey)
select sample, case when k % 4 = 0 then n * 10 when k % 4 = 1 then n * 9 when k % 4 = 2 then n * 8 else 100000 end as total, case when k % 4 = 0 then 'cleaning' when k % 4 = 1 then 'assignments' when k % 4 = 2 then 'reads' else 'pseudo' end as origin from s"""
)
def resolve_totals(v: Views) -> DataFrame:
    s = v.stages.select("sample", F.col("sample").cast("int").alias("k"), F.col("reads_pre").alias("n"))
    t = lambda m, f: s.where(f"k % 4 <= {m}").select("sample", (F.col("n") * f).alias("total"))
    return A.resolve_totals(s.select("sample"), t(0, 10), t(1, 9), t(2, 8))


@query("select sample as run, a.grp as sample_id, r.reads_pre, r.reads_post from groups a join stages r using (sample)")
def sample_table(v: Views) -> DataFrame:
    runs = v.groups.select(F.col("sample").alias("run"), F.concat("sample", F.lit("x")).alias("sample_id"))
    article = v.groups.select(F.concat("sample", F.lit("x")).alias("sample_id"), "grp")
    st = v.stages.withColumnRenamed("sample", "run")
    return A.sample_table(runs, article, st.select("run", "reads_pre"), st.select("run", "reads_post")).select("run", F.col("grp").alias("sample_id"), "reads_pre", "reads_post")


@query("select distinct sample from sp where sample in (select sample from ab)")
def present_in(v: Views) -> DataFrame:
    return A.present_in(v.sp.select("sample").distinct(), v.ab, "sample")


@query("select distinct sample from sp where sample not in (select sample from ab)")
def missing_report(v: Views) -> DataFrame:
    return A.missing_report(v.sp, v.ab, "sample")


@query("select taxon_id from s1 intersect select taxon_id from s2")
def taxa_common(v: Views) -> DataFrame:
    return v.s1.select("taxon_id").intersect(v.s2.select("taxon_id"))


@query("select taxon_id from s1 union select taxon_id from s2")
def taxa_union(v: Views) -> DataFrame:
    return v.s1.select("taxon_id").union(v.s2.select("taxon_id")).distinct()


@query(", few as (select taxon_id from s1 where value >= 3) select taxon_id from s2 except select taxon_id from few")
def taxa_difference(v: Views) -> DataFrame:
    return v.s2.select("taxon_id").subtract(v.s1.where("value >= 3").select("taxon_id"))


@query("select sample, taxon_id, round(x, 9) + 0.0 as x, round(y, 9) + 0.0 as y from prof")
def outer_profiles(v: Views) -> DataFrame:
    return C.outer_profiles(A.to_relative(v.s1), A.to_relative(v.s2)).withColumns({c: F.round(c, 9) + 0.0 for c in ("x", "y")})


@query("select a.sample, a.reads_pre as n_pre, b.reads_post as n_post from stages a join stages b using (sample) where b.reads_post > 0")
def pair_stages(v: Views) -> DataFrame:
    st = v.stages
    return A.pair_stages(st.select("sample", F.col("reads_pre").alias("n")), st.where("reads_post > 0").select("sample", F.col("reads_post").alias("n")))


@query("select a, b from pairs")
def sample_pairs(v: Views) -> DataFrame:
    return D.sample_pairs(v.ab)


@query(", a as (select distinct sample from sp), b as (select distinct l_suppkey::varchar as sample from lineitem where l_returnflag = 'R') select a.sample as a, b.sample as b from a join b on a.sample <> b.sample")
def cross_pairs(v: Views) -> DataFrame:
    returned = v.table("lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").cast("string").alias("sample"))
    return D.cross_pairs(v.sp, returned)


@query("select 'SRR' || sample as sample, taxon_id, value from ab")
def rekey_samples(v: Views) -> DataFrame:
    return A.rekey_samples(v.ab, v.groups.select("sample", F.concat(F.lit("SRR"), F.col("sample")).alias("run")))


@query("select taxon_id, sum(value) as total, count(*) filter (value > 0) as n_samples from ab group by 1")
def taxon_summary(v: Views) -> DataFrame:
    return A.order_by(A.taxon_summary(v.ab), "total")


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("select taxon_id, " + ", ".join(f"count(*) filter (grp = '{g}') as \"Frecuencia_{g}\"" for g in _REGIONS) + " from ab join groups using (sample) where value > 0 group by 1")
def group_frequency(v: Views) -> DataFrame:
    return A.group_frequency(v.ab, v.groups, _REGIONS)


@query("select taxon_id, round(sum(value) / (select count(distinct sample) from rel), 9) + 0.0 as mean from rel group by 1")
def mean_profile(v: Views) -> DataFrame:
    return A.mean_profile(A.to_relative(v.ab)).select("taxon_id", (F.round("mean", 9) + 0.0).alias("mean"))


@query("select sample, sum(value) as assigned from ab group by 1")
def sample_totals(v: Views) -> DataFrame:
    return A.sample_totals(v.ab)


@query(
    """, g1 as (select sample, genus as t, sum(value) as value from rel1 join taxonomy using (taxon_id) group by 1, 2), g2 as (select sample, genus as t, sum(value) as value from rel2 join taxonomy using (taxon_id) group by 1, 2),
b as (select coalesce(x.t, y.t) as taxon_id, coalesce(x.m, 0) as a, coalesce(y.m, 0) as b from (select t, sum(value) / (select count(distinct sample) from g1) as m from g1 group by 1) x full outer join (select t, sum(value) / (select count(distinct sample) from g2) as m from g2 group by 1) y on x.t = y.t),
top as (select * from b order by round(a + b, 12) desc, taxon_id limit 10)
select taxon_id, 'study_1' as study, round(a * 100, 6) + 0.0 as pct from top union all select taxon_id, 'study_2', round(b * 100, 6) + 0.0 from top"""
)
def top_taxa(v: Views) -> DataFrame:
    m = lambda ab: A.mean_profile(A.to_relative(A.collapse_rank(ab, v.taxonomy, "genus")))
    return A.top_taxa(m(v.s1), m(v.s2), 10).withColumn("pct", r6("pct"))


@query(
    """, t as (select sample, sum(value)::bigint * 3 + 7 as total from ab group by 1), r as (select sample, taxon_id, rel.value * total as raw, total from rel join t using (sample)),
k as (select *, floor(raw) as low, row_number() over (partition by sample order by round(raw - floor(raw), 9) desc, taxon_id) as rk, total - sum(floor(raw)) over (partition by sample) as rest from r)
select sample, taxon_id, (low + case when rk <= rest then 1 else 0 end)::bigint as "count" from k"""
)
def allocate(v: Views) -> DataFrame:
    totals = v.ab.groupBy("sample").agg((F.sum("value").cast("long") * 3 + 7).alias("total"))
    return A.allocate(A.to_relative(v.ab), totals)


# Diversity --------------------------------------------------------------------------------------------------------------------------

_ALPHA = """, al as (select sample, count(*) as observed, (count(*) + case when count(*) filter (value = 2) > 0 then (count(*) filter (value = 1)) ^ 2 / (2.0 * count(*) filter (value = 2)) else count(*) filter (value = 1) * (count(*) filter (value = 1) - 1) / 2.0 end)::double as chao1,
  ln(sum(value)) - sum(value * ln(value)) / sum(value) as shannon, 1 - sum(value * value) / sum(value) ^ 2 as simpson from {t} where value > 0 group by 1)
"""


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


_ALPHA_COLS = "round(chao1, 6) + 0.0 as chao1, round(shannon, 6) + 0.0 as shannon, round(simpson, 6) + 0.0 as simpson"


@query(_ALPHA.format(t="ab") + f"select sample, observed, {_ALPHA_COLS} from al")
def alpha_table(v: Views) -> DataFrame:
    return _rounded(D.alpha(v.ab), "chao1", "shannon", "simpson")


@query(_ALPHA.format(t="sp") + f"select sample, observed, {_ALPHA_COLS}, grp from al left join groups using (sample)")
def alpha_grouped(v: Views) -> DataFrame:
    return _rounded(D.alpha_with_group(v.sp, v.groups), "chao1", "shannon", "simpson")


@query("select a, b, round(d, 6) + 0.0 as d from bc")
def bray_curtis(v: Views) -> DataFrame:
    return _rounded(D.bray_curtis(v.ab), "d")


@query(
    ", tr as (select sample, sum(value) as s from rel group by 1), sr as (select a.sample as a, b.sample as b, sum(least(a.value, b.value)) as m from rel a join rel b on a.taxon_id = b.taxon_id and a.sample < b.sample group by 1, 2) "
    "select x.sample as a, y.sample as b, round(1 - 2 * coalesce(m, 0) / (x.s + y.s), 6) + 0.0 as d from tr x join tr y on x.sample < y.sample left join sr on sr.a = x.sample and sr.b = y.sample"
)
def beta_relative(v: Views) -> DataFrame:
    return _rounded(D.beta(v.ab, "bray", relative=True), "d")


@query("select a, b, round(d, 6) + 0.0 as d from jac")
def jaccard(v: Views) -> DataFrame:
    return _rounded(D.jaccard(v.ab), "d")


@query("select p.a, p.b, round(1 - coalesce(sh.same, 0) / (na + nb - coalesce(sh.both, 0)), 6) + 0.0 as d from pairs p left join sh using (a, b)")
def jaccard_value(v: Views) -> DataFrame:
    return _rounded(D.jaccard(v.ab, "value"), "d")


@query("select s.sample, t.taxon_id, round(ln(1 + coalesce(ab.value, 0)) - s.sl / (select d from nd), 6) + 0.0 as clr from tot s cross join (select distinct taxon_id from ab) t left join ab on ab.sample = s.sample and ab.taxon_id = t.taxon_id")
def clr(v: Views) -> DataFrame:
    return _rounded(D.clr(v.ab), "clr")


@query("select p.a, p.b, round(sqrt(greatest(qla + qlb - 2 * coalesce(ll, 0) - (select d from nd) * ((sla - slb) / (select d from nd)) ^ 2, 0)), 6) + 0.0 as d from pairs p left join sh using (a, b)")
def aitchison(v: Views) -> DataFrame:
    return _rounded(D.aitchison(v.ab), "d")


@query(", f as (select a, b, d from bc union all select b, a, d from bc union all select distinct sample, sample, 0.0 from ab) select a, " + ", ".join(f"round(max(d) filter (b = '{s}'), 6) + 0.0 as \"{s}\"" for s in _SAMPLES) + " from f group by 1")
def to_square(v: Views) -> DataFrame:
    return _rounded(D.to_square(D.bray_curtis(v.ab), _SAMPLES), *_SAMPLES)


@query(
    ", sr as (select a.sample as a, b.sample as b, sum(least(a.value, b.value)) as m from rel1 a join rel2 b on a.taxon_id = b.taxon_id group by 1, 2) "
    "select x.sample as a, y.sample as b, x.sample = y.sample as same, round(1 - 2 * coalesce(m, 0) / 2, 6) + 0.0 as d from (select distinct sample from rel1) x cross join (select distinct sample from rel2) y left join sr on sr.a = x.sample and sr.b = y.sample"
)
def bc_between(v: Views) -> DataFrame:
    return _rounded(D.bc_between(v.s1, v.s2), "d")


# Two studies ------------------------------------------------------------------------------------------------------------------------


@query("select sample, count(*) as n, round(corr(x, y), 6) + 0.0 as r from prof where x > 0 or y > 0 group by 1")
def profile_corr(v: Views) -> DataFrame:
    return _rounded(C.profile_corr(A.to_relative(v.s1), A.to_relative(v.s2)), "r")


_OVERLAP = """, ov as (select sample, count(*) filter (x > 0 and y > 0) as shared, count(*) filter (x > 0 and y = 0) as only_1, count(*) filter (x = 0 and y > 0) as only_2,
  sum(x) filter (x > 0 and y > 0) / sum(x) as shared_share_1, sum(y) filter (x > 0 and y > 0) / sum(y) as shared_share_2 from prof group by 1)
"""


@query(_OVERLAP + "select sample, shared, only_1, only_2, round(shared_share_1, 6) + 0.0 as shared_share_1, round(shared_share_2, 6) + 0.0 as shared_share_2 from ov")
def overlap(v: Views) -> DataFrame:
    return _rounded(C.overlap(A.to_relative(v.s1), A.to_relative(v.s2)), "shared_share_1", "shared_share_2")


_MEANS = "select taxon_id, round(m1.mean, 9) + 0.0 as mine, round(m2.mean, 9) + 0.0 as theirs, round(m1.mean - m2.mean, 9) + 0.0 as delta, round(abs(m1.mean - m2.mean), 9) + 0.0 as abs_delta from m1 join m2 using (taxon_id)"


@query(_MEANS)
def compare_means(v: Views) -> DataFrame:
    return C.compare_means(A.to_relative(v.s1), A.to_relative(v.s2)).withColumns({c: F.round(c, 9) + 0.0 for c in ("mine", "theirs", "delta", "abs_delta")})


@query("select count(*) as n, round(corr(m1.mean, m2.mean), 6) + 0.0 as r from m1 join m2 using (taxon_id)")
def means_correlation(v: Views) -> DataFrame:
    return _rounded(C.correlation(C.common_taxa(A.mean_profile(A.to_relative(v.s1)), A.mean_profile(A.to_relative(v.s2))), "mine", "theirs", with_p=False), "r")


# With t = sqrt(n - 2) tan(a) Student's density is a power of cos(a): p is what lies beyond asin(r), by two Simpson sums.
_ARC = "{top} / 60000 * list_sum(list_transform(range(20001), lambda i: (case when i = 0 or i = 20000 then 1 when i % 2 = 1 then 4 else 2 end) * greatest(cos({top} * i / 20000), 0.0) ^ (n - 3)))"


@query(
    ", c as (select count(*) as n, corr(m1.mean, m2.mean) as r from m1 join m2 using (taxon_id)) "
    f"select n, round(r, 6) + 0.0 as r, round(1 - ({_ARC.format(top='asin(abs(r))')}) / ({_ARC.format(top='(pi() / 2)')}), 6) + 0.0 as p from c"
)
def means_correlation_p(v: Views) -> DataFrame:
    return _rounded(C.correlation(C.common_taxa(A.mean_profile(A.to_relative(v.s1)), A.mean_profile(A.to_relative(v.s2))), "mine", "theirs"), "r", "p")


def _rank_r(rank: str) -> str:
    m = lambda s: f"(select {rank} as t, sum(value) / (select count(distinct sample) from {s}) as m from {s} join taxonomy using (taxon_id) group by 1)"
    return f"(select corr(x.m, y.m) as r, count(*)::double as n from {m('rel1')} x join {m('rel2')} y using (t))"


@query(f", p as (select * from {_rank_r('phylum')}), g as (select * from {_rank_r('genus')}) select 'n' as statistic, p.n as phylum, g.n as genus from p, g union all select 'r', round(p.r, 6) + 0.0, round(g.r, 6) + 0.0 from p, g")
def pearson_by_rank(v: Views) -> DataFrame:
    rel = lambda ab, rank: A.to_relative(A.collapse_rank(ab, v.taxonomy, rank))
    return _rounded(C.pearson_by_rank({r: (rel(v.s1, r), rel(v.s2, r)) for r in ("phylum", "genus")}), "phylum", "genus")


@query("select round(sum(reads_pre * reads_post) / sum(reads_pre * reads_pre), 6) + 0.0 as slope from stages")
def slope_through_origin(v: Views) -> DataFrame:
    return _rounded(C.slope0(v.stages, "reads_pre", "reads_post"), "slope")


@query("select round(corr(reads_pre, reads_post), 6) + 0.0 as reads_pre__reads_post, round(corr(q_pre, q_post), 6) + 0.0 as q_pre__q_post from stages")
def metric_corr(v: Views) -> DataFrame:
    return _rounded(C.metric_corr(v.stages, [("reads_pre", "reads_post"), ("q_pre", "q_post")]), "reads_pre__reads_post", "q_pre__q_post")


@query("select l_returnflag, round(avg(l_quantity), 3) as l_quantity_mean, round(stddev_samp(l_quantity), 3) as l_quantity_sd, round(avg(l_tax), 3) as l_tax_mean, round(stddev_samp(l_tax), 3) as l_tax_sd from lineitem group by 1")
def describe_by(v: Views) -> DataFrame:
    return C.describe_by(v.table("lineitem"), "l_returnflag", ["l_quantity", "l_tax"])


@query(
    ", s as (select *, reads_post / reads_pre * 100 as p from stages where reads_pre > 0) select count(*) as n, round(median(p), 6) + 0.0 as median_pct, round(avg(p), 6) + 0.0 as mean_pct, round(min(p), 6) + 0.0 as min_pct, round(max(p), 6) + 0.0 as max_pct, sum(reads_pre)::double as total_pre, sum(reads_post)::double as total_post from s"
)
def retention(v: Views) -> DataFrame:
    return _rounded(C.retention(v.stages), "median_pct", "mean_pct", "min_pct", "max_pct")


def _histogram_sql(source: str, col: str, lo: float, width: float, n: int, value: str) -> str:
    return f""", src as ({source}), h as (select least(floor(({col} - {lo}) / {width}), {n - 1})::bigint as bin, count(*) as c from src where {col} between {lo} and {lo + n * width} group by 1), b as (select r.bin::bigint as bin, coalesce(h.c, 0) as c from (select unnest(range({n})) as bin) r left join h on h.bin = r.bin)
select bin, round({lo} + bin * {width}, 9) as lo, round({lo} + (bin + 1) * {width}, 9) as hi, round({value}, 6) + 0.0 as value from b"""


@query(_histogram_sql("select value as q from events", "q", 8.0, 0.25, 72, "c * 100.0 / (select count(*) from src)"))
def quality_histogram(v: Views) -> DataFrame:
    return _rounded(C.histogram(v.table("events").select(F.col("value").alias("q")), "q", 8.0, 26.0, 0.25, "percent"), "value")


@query(_histogram_sql("select d from bc", "d", 0.0, 0.025, 40, "c / ((select sum(c) from h) * 0.025)"))
def distance_histogram(v: Views) -> DataFrame:
    return _rounded(C.histogram(D.bray_curtis(v.ab), "d", 0.0, 1.0, 0.025, "density"), "value")


@query(
    """, s as (select reads_post / reads_pre * 100 as p from stages), e as (select floor(min(p) / 0.5) * 0.5 as lo, ceil(max(p) / 0.5) * 0.5 as hi from s), n as (select greatest(1, round((hi - lo) / 0.5))::bigint as n, lo from e),
h as (select least(floor((p - lo) / 0.5), n - 1)::bigint as bin, count(*) as c from s, n group by 1), r as (select unnest(range((select n from n)))::bigint as bin)
select r.bin, round(lo + r.bin * 0.5, 9) as lo, round(lo + (r.bin + 1) * 0.5, 9) as hi, coalesce(c, 0)::double as value from r cross join n left join h on h.bin = r.bin"""
)
def retention_histogram(v: Views) -> DataFrame:
    return C.retention_histogram(v.stages.select((F.col("reads_post") / F.col("reads_pre") * 100).alias("p")), "p")


@query(
    """, q as (select l_returnflag as g, quantile_cont(l_extendedprice, 0.25) as q1, median(l_extendedprice) as median, quantile_cont(l_extendedprice, 0.75) as q3 from lineitem group by 1)
select g as l_returnflag, round(q1, 6) + 0.0 as q1, round(median, 6) + 0.0 as median, round(q3, 6) + 0.0 as q3, min(l_extendedprice) filter (l_extendedprice >= q1 - 1.5 * (q3 - q1)) as low, max(l_extendedprice) filter (l_extendedprice <= q3 + 1.5 * (q3 - q1)) as high from lineitem join q on g = l_returnflag group by g, q1, median, q3"""
)
def box_stats(v: Views) -> DataFrame:
    return _rounded(C.box_stats(v.table("lineitem"), "l_returnflag", "l_extendedprice"), "q1", "median", "q3")


@query("select round(median(q_post - q_pre), 6) + 0.0 as median_change from stages")
def paired_change(v: Views) -> DataFrame:
    return _rounded(C.paired_change(v.stages, "q_pre", "q_post"), "median_change")


@query(
    """, p as (select bc.d as x, jac.d as y from bc join jac using (a, b)), g as (select x * 35 as u, y * 20 as v from p), f as (select *, floor(u + 0.5) as u1, floor(v + 0.5) as v1, floor(u) + 0.5 as u2, floor(v) + 0.5 as v2 from g),
c as (select case when (u - u1) ^ 2 + 3 * (v - v1) ^ 2 < (u - u2) ^ 2 + 3 * (v - v2) ^ 2 then u1 else u2 end / 35 as cx, case when (u - u1) ^ 2 + 3 * (v - v1) ^ 2 < (u - u2) ^ 2 + 3 * (v - v2) ^ 2 then v1 else v2 end / 20 as cy from f)
select round(cx, 6) as cx, round(cy, 6) as cy, count(*) as "count" from c group by 1, 2"""
)
def hexbin(v: Views) -> DataFrame:
    pairs = D.bray_curtis(v.ab).withColumnRenamed("d", "x").join(D.jaccard(v.ab).withColumnRenamed("d", "y"), ["a", "b"])
    return C.hexbin(pairs, "x", "y")


@query("select count(*) filter (a.observed is not distinct from b.observed) as equal, count(*) as n from (select sample, count(*) as observed from s1 group by 1) a join (select sample, count(*) as observed from s2 group by 1) b using (sample)")
def agreement(v: Views) -> DataFrame:
    pairs = A.pair_stages(D.alpha(v.s1).select("sample", "observed"), D.alpha(v.s2).select("sample", "observed"))
    return C.agreement(pairs, F.col("observed_pre"), F.col("observed_post"))


@query("select count(*) filter ((l_tax < 0.05) = (l_discount < 0.05)) as same_verdict, count(*) as n from lineitem")
def significance_agreement(v: Views) -> DataFrame:
    return C.significance_agreement(v.table("lineitem"), "l_tax", "l_discount")


_PER_SAMPLE = (
    _ALPHA.format(t="s1").replace("al as", "al1 as")
    + _ALPHA.format(t="s2").replace("al as", "al2 as")
    + _OVERLAP
    + """, pc as (select sample, count(*) as n_taxa, corr(x, y) as r from prof where x > 0 or y > 0 group by 1), t1 as (select sample, sum(value) as assigned_1 from s1 group by 1), t2 as (select sample, sum(value) as assigned_2 from s2 group by 1),
ps as (select sample, assigned_1, assigned_2, al1.observed as observed_1, al1.chao1 as chao1_1, al1.shannon as shannon_1, al1.simpson as simpson_1, al2.observed as observed_2, al2.chao1 as chao1_2, al2.shannon as shannon_2, al2.simpson as simpson_2,
  n_taxa, r, shared, only_1, only_2, shared_share_1, shared_share_2 from t1 join t2 using (sample) join al1 using (sample) join al2 using (sample) join pc using (sample) join ov using (sample))
"""
)
_PS_FLOATS = ["assigned_1", "assigned_2", *[f"{c}_{k}" for k in (1, 2) for c in ("chao1", "shannon", "simpson")], "r", "shared_share_1", "shared_share_2"]


@query(_PER_SAMPLE + "select sample, observed_1, observed_2, n_taxa, shared, only_1, only_2, " + ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in _PS_FLOATS) + " from ps")
def validation_per_sample(v: Views) -> DataFrame:
    return _rounded(C.validation_per_sample(v.s1, v.s2, D.alpha(v.s1), D.alpha(v.s2)), *_PS_FLOATS)


_REPORT = {
    "assigned: median, first": "median(assigned_1)", "assigned: median, second": "median(assigned_2)", "assigned: correlation": "corr(assigned_1, assigned_2)",
    "alpha: correlation of Shannon": "corr(shannon_1, shannon_2)", "alpha: correlation of richness": "corr(observed_1, observed_2)",
    "profiles: median correlation": "median(r)", "profiles: least correlation": "min(r)", "profiles: most correlation": "max(r)",
    "overlap: median share, first": "median(shared_share_1)", "overlap: median share, second": "median(shared_share_2)",
    "overlap: mean shared taxa": "avg(shared)", "overlap: mean own taxa, first": "avg(only_1)", "overlap: mean own taxa, second": "avg(only_2)",
    "samples: number": "count(*)::double", "assigned: mean ratio": "avg(assigned_1 / assigned_2)",
}


@query(_PER_SAMPLE + " union all ".join(f"select '{k.split(': ')[0]}' as step, '{k.split(': ')[1]}' as comparison, round({e}, 6) + 0.0 as result from ps" for k, e in _REPORT.items()))
def validation_report(v: Views) -> DataFrame:
    return _rounded(C.validation_report(C.validation_per_sample(v.s1, v.s2, D.alpha(v.s1), D.alpha(v.s2))), "result")


# Tests and ordination ---------------------------------------------------------------------------------------------------------------

_RANKED = _ALPHA.format(t="ab") + """, val as (select grp as g, 'observed' as metric, observed::double as value from al join groups using (sample) union all select grp, 'shannon', shannon from al join groups using (sample)),
gp as (select a.grp as g1, b.grp as g2 from (select distinct grp from groups) a join (select distinct grp from groups) b on a.grp < b.grp),
rk as (select metric, g1, g2, g, rank() over (partition by metric, g1, g2 order by value) + (count(*) over (partition by metric, g1, g2, value) - 1) / 2.0 as r from val join gp on g = g1 or g = g2)
"""


@query(_RANKED + "select metric, g1, g2, count(*) filter (g = g1) as n1, count(*) filter (g = g2) as n2, (sum(r) filter (g = g1) - count(*) filter (g = g1) * (count(*) filter (g = g1) + 1) / 2.0)::double as u from rk group by 1, 2, 3 having n1 > 1 and n2 > 1")
def mann_whitney(v: Views) -> DataFrame:
    return hypothesis.mann_whitney(_alpha_values(v), ["observed", "shannon"], with_p=False)


def _alpha_values(v: Views) -> DataFrame:
    return D.alpha(v.ab).withColumn("observed", F.col("observed").cast("double")).join(v.groups, "sample")


# Without ties all ways to choose the first group's places are counted; else the normal tail is a Simpson sum.
@query(
    _RANKED
    + """, tie as (select metric, g1, g2, value, count(*) as t from val join gp on g = g1 or g = g2 group by 1, 2, 3, 4), tt as (select metric, g1, g2, sum(t * t * t - t)::double as ties from tie group by 1, 2, 3),
mw as (select metric, g1, g2, count(*) filter (g = g1) as n1, count(*) filter (g = g2) as n2, (sum(r) filter (g = g1) - count(*) filter (g = g1) * (count(*) filter (g = g1) + 1) / 2.0)::double as u from rk group by 1, 2, 3 having n1 > 1 and n2 > 1),
mt as (select *, greatest(u, n1 * n2 - u) as top, n1 + n2 as n from mw join tt using (metric, g1, g2)),
ns as (select distinct n1, n2 from mt where least(n1, n2) <= 8 and ties = 0 and n <= 16), mask as (select n1, n2, unnest(range((1 << (n1 + n2))::bigint)) as m from ns),
us as (select n1, n2, list_sum(list_transform(range(n1 + n2), lambda i: case when (m >> i) & 1 = 1 then i + 1 else 0 end)) - n1 * (n1 + 1) / 2 as uu from mask where bit_count(m) = n1),
ex as (select metric, g1, g2, count(*) filter (uu >= ceil(top)) / count(*) as tail from mt join us using (n1, n2) where ties = 0 group by 1, 2, 3),
z as (select *, (top - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))) as z from mt)
select metric, g1, g2, n1, n2, u, round(least(1.0, case when tail is not null then 2 * tail else 1 - 2 * z / 1200 / sqrt(2 * pi()) * list_sum(list_transform(range(401), lambda i: (case when i = 0 or i = 400 then 1 when i % 2 = 1 then 4 else 2 end) * exp(-0.5 * (z * i / 400) ^ 2))) end), 6) + 0.0 as p
from z left join ex using (metric, g1, g2)"""
)
def mann_whitney_p(v: Views) -> DataFrame:
    return _rounded(hypothesis.mann_whitney(_alpha_values(v), ["observed", "shannon"]), "p")


@query("select metric, round(r, 6) as r, g1, g2, g, count(*) as n from (select metric, g1, g2, g, r from rk) group by 1, 2, 3, 4, 5".join([_RANKED, ""]))
def average_rank(v: Views) -> DataFrame:
    values = _alpha_values(v).unpivot(["grp"], ["observed", "shannon"], "metric", "value")
    g = v.groups.select("grp").distinct()
    pairs = g.select(F.col("grp").alias("g1")).join(g.select(F.col("grp").alias("g2")), F.col("g1") < F.col("g2"))
    rows = values.join(pairs, (F.col("grp") == F.col("g1")) | (F.col("grp") == F.col("g2"))).withColumnRenamed("grp", "g")
    return hypothesis.average_rank(rows, "value", ["metric", "g1", "g2"]).groupBy("metric", F.round("rank", 6).alias("r"), "g1", "g2", "g").agg(F.count("*").alias("n"))


def _perm_labels(table: str, label: str, perms: int) -> str:
    return f""", many as (select p.perm, t.sample, t.{label} as label from {table} t, (select unnest(range(1, {perms + 1})) as perm) p),
own as (select perm, sample, row_number() over (partition by perm order by sample) as k from many), dealt as (select perm, label, row_number() over (partition by perm order by md5('{SEED}-' || perm || '-' || sample), sample) as k from many),
lab as (select own.perm, own.sample, dealt.label from own join dealt using (perm, k) union all select 0, sample, {label} from {table})
"""


@query(", sup as (select s_suppkey::varchar as sample, s_nationkey as grp from supplier)" + _perm_labels("sup", "grp", PERMUTATIONS) + "select perm::integer as perm, sample, label from lab")
def permuted_labels(v: Views) -> DataFrame:
    suppliers = v.table("supplier").select(F.col("s_suppkey").cast("string").alias("sample"), F.col("s_nationkey").alias("grp"))
    return hypothesis.permuted_labels(suppliers, "grp", PERMUTATIONS, SEED).select("perm", "sample", "label")


_PERMANOVA = (
    _perm_labels("groups", "grp", PERMUTATIONS)
    + """, sz as (select grp as label, count(*) as ng from groups group by 1), nk as (select count(*)::double as n, count(distinct grp)::double as k from groups), st as (select sum(d * d) / (select n from nk) as sst from bc),
sw as (select perm, sum(q / ng) as ssw from (select x.perm, x.label, sum(d * d) as q from bc join lab x on x.sample = bc.a join lab y on y.sample = bc.b and y.perm = x.perm and y.label = x.label group by 1, 2) join sz using (label) group by 1),
f as (select perm, round(((sst - ssw) / (k - 1)) / (ssw / (n - k)), 9) as f, (sst - ssw) / sst as r2, n, k from sw, st, nk), z as (select * from f where perm = 0)
select z.n::bigint as n, z.k::bigint as k, round(z.f, 6) + 0.0 as f, round(z.r2, 6) + 0.0 as r2, round((count(*) filter (f.f >= z.f - sqrt(2.220446049250313e-16)) + 1) / (count(*) + 1), 6) as p from f, z where f.perm > 0 group by z.n, z.k, z.f, z.r2"""
)


@query(_PERMANOVA)
def permanova(v: Views) -> DataFrame:
    return _rounded(hypothesis.permanova(D.bray_curtis(v.ab), v.groups, PERMUTATIONS, SEED, tol=2.220446049250313e-16**0.5), "f", "r2", "p")


def _strict(body: str) -> str:
    return body.replace(" - sqrt(2.220446049250313e-16)", "")


@query(_strict(_PERMANOVA))
def permanova_strict(v: Views) -> DataFrame:
    return _rounded(hypothesis.permanova(D.bray_curtis(v.ab), v.groups, PERMUTATIONS, SEED), "f", "r2", "p")


@query(
    f""", sub as (select n_nationkey::varchar as sample, case when n_nationkey % 2 = 0 then 'bag' else 'bulk' end as type, 1 as time, case when n_nationkey % 3 = 0 then 'x' else 'y' end as grp from nation),
dd as (select s.type, s.time, bc.* from bc join sub s on s.sample = bc.a join sub t on t.sample = bc.b and t.type = s.type), nk as (select type, time, count(*)::double as n, count(distinct grp)::double as k from sub group by 1, 2), sz as (select type, time, grp, count(*) as ng from sub group by 1, 2, 3),
many as (select p.perm, sub.* from sub, (select unnest(range(1, {PERMUTATIONS + 1})) as perm) p), own as (select type, time, perm, sample, row_number() over (partition by type, time, perm order by sample) as k from many),
dealt as (select type, time, perm, grp, row_number() over (partition by type, time, perm order by md5('{SEED}-' || perm || '-' || sample), sample) as k from many),
lab as (select type, time, perm, sample, grp from own join dealt using (type, time, perm, k) union all select type, time, 0, sample, grp from sub),
st as (select type, time, sum(d * d) as q from dd group by 1, 2), sw as (select type, time, perm, sum(q / ng) as ssw from (select dd.type, dd.time, x.perm, x.grp, sum(d * d) as q from dd join lab x on x.sample = dd.a join lab y on y.sample = dd.b and y.perm = x.perm and y.grp = x.grp group by 1, 2, 3, 4) join sz using (type, time, grp) group by 1, 2, 3),
f as (select type, time, perm, n, k, round(((q / n - ssw) / (k - 1)) / (ssw / (n - k)), 9) as f, (q / n - ssw) / (q / n) as r2 from st join nk using (type, time) join sw using (type, time)), z as (select * from f where perm = 0)
select z.type, z.time, z.n::bigint as n, z.k::bigint as k, round(z.f, 6) + 0.0 as f, round(z.r2, 6) + 0.0 as r2, round((count(*) filter (f.f >= z.f) + 1) / (count(*) + 1), 6) as p, 0.1 as published_r2, 0.05 as published_p
from z join f on f.type = z.type and f.time = z.time and f.perm > 0 group by z.type, z.time, z.n, z.k, z.f, z.r2"""
)
def published_subsets(v: Views) -> DataFrame:
    k = F.col("n_nationkey")
    s = v.table("nation").select(k.cast("string").alias("sample"), F.when(k % 2 == 0, "bag").otherwise("bulk").alias("type"), F.lit(1).alias("time"), F.when(k % 3 == 0, "x").otherwise("y").alias("grp"))
    tests = s.select("type", "time").distinct().withColumn("published_r2", F.lit(0.1)).withColumn("published_p", F.lit(0.05))
    distances = D.bray_curtis_within(v.ab, s.select("sample", F.struct("type", "time").alias("class")))
    out = hypothesis.published_subsets(distances, s, tests, PERMUTATIONS)
    return _rounded(out, "f", "r2", "p").select("type", "time", "n", "k", "f", "r2", "p", "published_r2", "published_p")


@query(
    ", nm as (select distinct sample, sample as name from ab)"
    + _perm_labels("nm", "name", PERMUTATIONS)
    + """, mv as (select x.perm, bc.d as x, least(x.label, y.label) as u, greatest(x.label, y.label) as v from bc join lab x on x.sample = bc.a join lab y on y.sample = bc.b and y.perm = x.perm),
r as (select perm, round(corr(mv.x, jac.d), 9) as r, count(*) as n from mv join jac on jac.a = mv.u and jac.b = mv.v group by 1), z as (select * from r where perm = 0)
select z.n, round(z.r, 6) + 0.0 as r, round((count(*) filter (abs(r.r) >= abs(z.r)) + 1) / (count(*) + 1), 6) as p from r, z where r.perm > 0 group by z.n, z.r"""
)
def mantel(v: Views) -> DataFrame:
    return _rounded(hypothesis.mantel(*D.bray_and_jaccard(v.ab), PERMUTATIONS, SEED), "r", "p")


@query()
def pcoa(v: Views) -> DataFrame:
    return ordination.pcoa(D.bray_curtis(v.ab), 3)


_ELLIPSE = """, g as (select l_returnflag as grp, count(*) as n, avg(l_quantity) as cx, avg(l_tax * 100) as cy, var_samp(l_quantity) as vx, var_samp(l_tax * 100) as vy, covar_samp(l_quantity, l_tax * 100) as c from lineitem group by 1 having n > 2),
l as (select *, (vx + vy) / 2 + sqrt(((vx - vy) / 2) ^ 2 + c ^ 2) as l1, (vx + vy) / 2 - sqrt(((vx - vy) / 2) ^ 2 + c ^ 2) as l2 from g)
select grp, n, round(cx, 6) + 0.0 as cx, round(cy, 6) + 0.0 as cy, round(degrees(atan2(l1 - vx, c)), 4) + 0.0 as angle, round(3.92 * sqrt(l1), 6) + 0.0 as width, round(3.92 * sqrt(l2), 6) + 0.0 as height from l"""


@query(_ELLIPSE)
def ellipses(v: Views) -> DataFrame:
    points = v.table("lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"))
    return _rounded(ordination.ellipses(points).withColumn("angle", F.round("angle", 4) + 0.0), "cx", "cy", "width", "height")


@query("select round(min(l_quantity) - 0.2 * (max(l_quantity) - min(l_quantity)), 6) as x_min, round(max(l_quantity) + 0.2 * (max(l_quantity) - min(l_quantity)), 6) as x_max, round(min(l_tax) - 0.2 * (max(l_tax) - min(l_tax)), 6) as y_min, round(max(l_tax) + 0.2 * (max(l_tax) - min(l_tax)), 6) as y_max from lineitem")
def axis_limits(v: Views) -> DataFrame:
    return _rounded(ordination.axis_limits(v.table("lineitem"), "l_quantity", "l_tax"), "x_min", "x_max", "y_min", "y_max")


_DEPTHS = """, nn as (select sample, sum(value)::bigint as n from ab group by 1), dp as (select distinct sample, n, d from (select sample, n, unnest(list_append(range(1, n + 1, greatest(1, n // 30)), n)) as d from nn))
"""


@query(
    _DEPTHS
    + f""", ind as (select sample, taxon_id, unnest(range(1, value::bigint + 1)) as k from ab), it as (select unnest(range(1, 11)) as iter),
dr as (select sample, iter, taxon_id, row_number() over (partition by sample, iter order by md5('{SEED}-' || iter || '-' || sample || '-' || taxon_id || '-' || k)) as rk from ind, it), fr as (select sample, iter, taxon_id, min(rk) as d from dr group by 1, 2, 3),
st as (select sample, d, count(*) as c from fr group by 1, 2)
select dp.sample, dp.d as depth, round(coalesce(sum(c), 0) / 10, 6) + 0.0 as richness from dp left join st on st.sample = dp.sample and st.d <= dp.d group by 1, 2"""
)
def rarefaction_curve(v: Views) -> DataFrame:
    return _rounded(rarefaction.rarefaction(v.ab, seed=SEED), "richness")


@query(
    _DEPTHS
    + """, kd as (select sample, value::bigint as x, count(*) as c from ab group by 1, 2)
select dp.sample, dp.d as depth, round(sum(c * (1 - case when n - x < d then 0 else exp((lgamma(n - x + 1.0) - lgamma(n - x - d + 1.0)) - (lgamma(n + 1.0) - lgamma(n - d + 1.0))) end)), 3) + 0.0 as richness from dp join kd using (sample) group by 1, 2"""
)
def rarefaction_expected(v: Views) -> DataFrame:
    return rarefaction.rarefaction_expected(v.ab).withColumn("richness", F.round("richness", 3) + 0.0)


@query(
    _DEPTHS
    + """, kd as (select sample, value::bigint as x, count(*) as c from ab group by 1, 2)
select dp.sample, dp.d as depth, round(sum(c * (1 - case when n - x < d then 0 else exp((lgamma(n - x + 1.0) - lgamma(n - x - d + 1.0)) - (lgamma(n + 1.0) - lgamma(n - d + 1.0))) end)), 3) + 0.0 as expected, true as near
from dp join kd using (sample) group by 1, 2"""
)
def rarefaction_by_counts(v: Views) -> DataFrame:
    """ST-19: the mean of ten draws, held against its expectation: within six standard errors at every depth."""
    drawn = rarefaction.rarefaction_by_counts(v.ab, seed=SEED)
    both = drawn.join(rarefaction.rarefaction_expected(v.ab).withColumnRenamed("richness", "expected"), ["sample", "depth"])
    return both.select("sample", "depth", (F.round("expected", 3) + 0.0).alias("expected"), (F.abs(F.col("richness") - F.col("expected")) <= 6 * F.sqrt(F.col("expected") / 10)).alias("near"))


@query()
def em_abundance(v: Views) -> DataFrame:
    """Lines as reads whose part is one of two neighbours; the first of two is a little likelier."""
    li = v.table("lineitem").select(F.col("l_suppkey").cast("string").alias("sample"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("read_id"), F.col("l_partkey").alias("t"))
    hits = li.select("sample", "read_id", F.explode(F.array(F.struct(F.col("t"), F.lit(-1.0).alias("loglik")), F.struct((F.col("t") + 1).alias("t"), F.lit(-1.5).alias("loglik")))).alias("h"))
    return em.em_abundance(hits.select("sample", "read_id", F.col("h.t").cast("string").alias("taxon_id"), "h.loglik"))
