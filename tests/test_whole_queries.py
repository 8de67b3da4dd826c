"""Registered queries run their operators on all of their input, with the operators' own defaults."""

from taxaflow.operators import em
from taxaflow.plans import catalogue

DIR = "/root/testdata/sf0.01"


def test_em_runs_to_its_end_over_every_part(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(em, "em_abundance", lambda hits, **options: seen.append(options) or hits)
    hits = catalogue.queries()["em_abundance"](spark, DIR)
    parts = {r["l_partkey"] for r in spark.read.parquet(f"{DIR}/lineitem.parquet").select("l_partkey").distinct().collect()}
    taxa = {int(r["taxon_id"]) for r in hits.select("taxon_id").distinct().collect()}
    assert seen == [{}] and taxa == parts | {p + 1 for p in parts} and max(taxa) > 200
