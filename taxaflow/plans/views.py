"""The domain's tables as views of the tables at hand, for Spark and, as common table expressions, for SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS, BASES, QUALS = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTNACGTACGTACGTA", "+,-./0123456789:;<=>?@ABCD"
SPLIT_DAY = "1998-01-01"


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def reads(self) -> DataFrame:
        """Each document is a read: its letters map to bases and to qualities."""
        letters = F.lower(F.regexp_replace("text", "[^A-Za-z]", ""))
        rows = self.table("documents").select("source", "doc_id", letters.alias("l"))
        return rows.select(F.col("source").alias("sample"), F.col("doc_id").alias("read_id"), F.col("doc_id").alias("read_ord"), F.translate("l", LETTERS, BASES).alias("seq"), F.translate("l", LETTERS, QUALS).alias("qual"))

    def _counts(self, orders: DataFrame) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_partkey")
        joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return joined.groupBy(F.col("c_nationkey").cast("string").alias("sample"), F.col("l_partkey").alias("taxon_id")).agg(F.count("*").cast("double").alias("value"))

    @cached_property
    def ab(self) -> DataFrame:
        return self._counts(self.table("orders"))

    @cached_property
    def s1(self) -> DataFrame:
        return self._counts(self.table("orders").where(F.col("o_orderdate") < F.lit(SPLIT_DAY).cast("timestamp")))

    @cached_property
    def s2(self) -> DataFrame:
        return self._counts(self.table("orders").where(F.col("o_orderdate") >= F.lit(SPLIT_DAY).cast("timestamp")))

    @cached_property
    def sp(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_suppkey").cast("string").alias("sample"), F.col("l_partkey").alias("taxon_id")).agg(F.count("*").cast("double").alias("value"))

    @cached_property
    def taxonomy(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("taxon_id"), F.col("p_type").alias("phylum"), F.col("p_brand").alias("genus"), F.col("p_name").alias("species"))

    @cached_property
    def groups(self) -> DataFrame:
        n, r = self.table("nation"), self.table("region")
        return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("string").alias("sample"), F.col("r_name").alias("grp"))

    @cached_property
    def stages(self) -> DataFrame:
        """Rows, and rows that weren't returned, of each supplier: a cleaning's before and after."""
        li = self.table("lineitem")
        kept = F.col("l_returnflag") != "R"
        return li.groupBy(F.col("l_suppkey").cast("string").alias("sample")).agg(F.count("*").alias("reads_pre"), F.count_if(kept).alias("reads_post"), F.avg("l_quantity").alias("q_pre"), F.avg(F.when(kept, F.col("l_quantity"))).alias("q_post"))

    @cached_property
    def summary(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").cast("string").alias("read_id"), F.col("event_type").alias("barcode"), "ts", (F.col("user_id") + 100).alias("length"), F.col("value").alias("mean_q"))


CTES = f"""
letters as (select source, doc_id, lower(regexp_replace(text, '[^A-Za-z]', '', 'g')) as l from documents),
reads as (select source as sample, doc_id as read_id, doc_id as read_ord, translate(l, '{LETTERS}', '{BASES}') as seq, translate(l, '{LETTERS}', '{QUALS}') as qual from letters),
good as (select * from reads where length(seq) > 0),
lines as (select c_nationkey::varchar as sample, l_partkey as taxon_id, o_orderdate from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
ab as (select sample, taxon_id, count(*)::double as value from lines group by 1, 2),
s1 as (select sample, taxon_id, count(*)::double as value from lines where o_orderdate < timestamp '{SPLIT_DAY}' group by 1, 2),
s2 as (select sample, taxon_id, count(*)::double as value from lines where o_orderdate >= timestamp '{SPLIT_DAY}' group by 1, 2),
sp as (select l_suppkey::varchar as sample, l_partkey as taxon_id, count(*)::double as value from lineitem group by 1, 2),
taxonomy as (select p_partkey as taxon_id, p_type as phylum, p_brand as genus, p_name as species from part),
groups as (select n_nationkey::varchar as sample, r_name as grp from nation join region on n_regionkey = r_regionkey),
rel as (select sample, taxon_id, value / sum(value) over (partition by sample) as value from ab),
rel1 as (select sample, taxon_id, value / sum(value) over (partition by sample) as value from s1),
rel2 as (select sample, taxon_id, value / sum(value) over (partition by sample) as value from s2),
m1 as (select taxon_id, sum(value) / (select count(distinct sample) from rel1) as mean from rel1 group by 1),
m2 as (select taxon_id, sum(value) / (select count(distinct sample) from rel2) as mean from rel2 group by 1),
stages as (select l_suppkey::varchar as sample, count(*) as reads_pre, count(*) filter (l_returnflag <> 'R') as reads_post, avg(l_quantity) as q_pre, avg(l_quantity) filter (l_returnflag <> 'R') as q_post from lineitem group by 1),
prof as (select coalesce(a.sample, b.sample) as sample, coalesce(a.taxon_id, b.taxon_id) as taxon_id, coalesce(a.value, 0) as x, coalesce(b.value, 0) as y from rel1 a full outer join rel2 b on a.sample = b.sample and a.taxon_id = b.taxon_id),
tot as (select sample, sum(value) as s, count(*) as n, sum(ln(1 + value)) as sl, sum(ln(1 + value) ^ 2) as ql from ab group by 1),
sh as (select a.sample as a, b.sample as b, sum(least(a.value, b.value)) as m, count(*) as both, count(*) filter (a.value = b.value) as same, sum(ln(1 + a.value) * ln(1 + b.value)) as ll from ab a join ab b on a.taxon_id = b.taxon_id and a.sample < b.sample group by 1, 2),
pairs as (select a.sample as a, b.sample as b, a.s as sa, b.s as sb, a.n as na, b.n as nb, a.sl as sla, b.sl as slb, a.ql as qla, b.ql as qlb from tot a join tot b on a.sample < b.sample),
nd as (select count(distinct taxon_id)::double as d from ab),
bc as (select p.a, p.b, 1 - 2 * coalesce(m, 0) / (sa + sb) as d from pairs p left join sh using (a, b)),
jac as (select p.a, p.b, 1 - coalesce(sh.both, 0) / (na + nb - coalesce(sh.both, 0)) as d from pairs p left join sh using (a, b))
"""


def sql(body: str) -> str:
    """`body` after the views' common table expressions; more of them may come first in it, each after a comma."""
    return f"with {CTES}{body}"
