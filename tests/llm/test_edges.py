"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from taxaflow.llm import chat, common, decontaminate, html, packing, pii, quality, secrets, simhash, toxicity, warc
from taxaflow.llm.common import connected_components
from taxaflow.llm.queries import vocabulary

LONG = "word other " * 30_000
PROSE = "The quick brown fox jumps over the lazy dog while many other animals watch from afar and wonder why it runs so very fast today."
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, words string, fp long, kept string, line string, value string"
CLASH = ("k", "w", 1, "no", "l", "v")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *CLASH) for i, t, s in rows], DOCS)


def odd(spark):
    return docs(spark, [(1, None, "a"), (2, "", "a"), (3, "   \n\t", None), (4, LONG, "a"), (5, PROSE, "b"), (5, PROSE, "b"), (6, PROSE, "b"), (None, PROSE + " More.", None), (7, "\x00 é👍", "a")])


def none(spark):
    return docs(spark, [])


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def bench(spark, rows=((1, PROSE), (2, None), (3, "short"), (4, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


OPERATORS = {
    "quality": lambda s, d: quality.quality(d),
    "decontaminate": lambda s, d: decontaminate.overlaps(d, bench(s)),
    "no benchmark": lambda s, d: decontaminate.overlaps(d, bench(s, ())),
    "secrets": lambda s, d: secrets.findings(d),
    "pii": lambda s, d: pii.personal_data(d),
    "toxicity": lambda s, d: toxicity.toxicity(d, labels(s, [(1, 1, 1), (4, 1, 0), (5, None, 0), (6, 1, None), (None, 1, 1)])),
    "no labels": lambda s, d: toxicity.toxicity(d, labels(s)),
    "packing": lambda s, d: packing.pack(d, vocabulary()),
    "simhash": lambda s, d: simhash.near_duplicates(d),
}
PER_ROW = {"quality", "pii", "toxicity", "no labels", "simhash"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    got = OPERATORS[name](spark, odd(spark)).collect()
    if name in PER_ROW:
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in odd(spark).collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, none(spark)).collect() == []


def test_defined_results(spark):
    q = {r["doc_id"]: r for r in quality.quality(odd(spark)).collect()}
    assert q[1]["base_failed"] and q[1]["n_words"] == 0 and not q[1]["kept"]
    assert q[4]["n_words"] == 60_000 == q[4]["n_repeat_words"] and not q[4]["kept"]
    assert q[5]["kept"] and q[6]["kept"]
    d = {r["doc_id"]: r for r in simhash.near_duplicates(odd(spark)).collect()}
    assert d[1]["fp"] == d[2]["fp"] == d[3]["fp"] == 0 and d[3]["component_id"] == 1
    assert d[6]["component_id"] == 5
    o = decontaminate.contaminated(odd(spark), bench(spark)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in o} == {(5, 1), (6, 1), (None, 1)}
    t = {r["doc_id"]: r for r in toxicity.toxicity(odd(spark), labels(spark)).collect()}
    assert all(r["score"] == 0 and r["predicted"] == 0 for r in t.values())
    p = packing.pack(odd(spark), vocabulary()).collect()
    assert [(r["length"], r["doc_tokens"]) for r in p if r["doc_id"] == 1] == [(1, 1)]


@pytest.mark.parametrize("make", [odd, none])
def test_stages(spark, tmp_path, make):
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    d = make(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == d.columns
        out.collect()


def test_stages_do_what_they_say(spark, tmp_path):
    key = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"
    clean = " ".join(f"alpha{i} beta{i} gamma{i}" for i in range(40))
    bench(spark, [(1, PROSE)]).write.parquet(str(tmp_path / "benchmark.parquet"))
    d = docs(spark, [(1, clean, "a"), (2, clean, "a"), (3, PROSE, "a"), (4, f'{clean} x token = "{key}" y', "b"), (5, "too short", "a")])
    kept = lambda x: sorted(r["doc_id"] for r in x.collect())
    assert kept(corpus_pipeline.quality_rules(spark, d, str(tmp_path))) == [1, 2, 3, 4]
    assert 2 not in kept(corpus_pipeline.near_duplicates(spark, d, str(tmp_path)))
    assert kept(corpus_pipeline.decontamination(spark, d, str(tmp_path))) == [1, 2, 4, 5]
    masked = {r["doc_id"]: r for r in corpus_pipeline.secret_scan(spark, d, str(tmp_path)).collect()}
    assert key not in masked[4]["text"] and secrets.MASK in masked[4]["text"] and masked[4]["n_chars"] == len(masked[4]["text"])
    assert masked[1]["text"] == clean and len(masked) == 5


def test_stages_shuffle_what_they_do_not_broadcast(spark, tmp_path, monkeypatch):
    bench(spark, [(1, PROSE)]).write.parquet(str(tmp_path / "benchmark.parquet"))
    d = docs(spark, [(1, f'{PROSE} x token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" y', "a"), (2, "unlike text of its own " * 3, "a"), (None, "too short", None), (3, None, "a"), (3, None, "a")])
    run = lambda: [sorted(map(str, stage(spark, d, str(tmp_path)).collect())) for _, stage in corpus_pipeline.STAGES[:4]]
    few = run()
    monkeypatch.setattr(common, "bounded_broadcast", lambda df, n: df)
    assert run() == few and len(few[3]) == 5


def test_repeated_rows_of_one_id_leave_one(spark):
    got = simhash.drop_near_duplicates(docs(spark, [(1, PROSE, "a"), (1, PROSE, "a"), (None, "other text here", "a")])).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "None"]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, "y") for i, u, h in rows], "page_id long, url string, html string, key string, offset long, paths string")


ODD_PAGES = [(1, "http://a.example/x", None), (2, "http://a.example/y", ""), (3, None, "<p>one"), (3, None, "<p>one"), (None, "not a url\n", "<p>one"), (4, "http://[bad", "<" * 5000), (5, "http://a.example/x", "<p>" + "long " * 50_000), (6, "", "<script>x")]


def test_odd_pages(spark):
    got = warc.round_trip(spark, pages(spark, ODD_PAGES)).collect()
    assert len(got) == len(ODD_PAGES)
    by = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"]), r["payload_bytes"]) for r in got)
    assert ("1", "response", "None", 0) in by and ("2", "revisit", "1", 0) in by
    assert by.count(("3", "response", "None", 6)) == 2 and ("None", "revisit", "3", 6) in by
    texts = {r["page_id"]: r["text"] for r in html.main_text(pages(spark, ODD_PAGES)).collect()}
    assert texts[1] == texts[2] == texts[6] == "" and texts[3] == "one" and texts[5].count("long") == 50_000
    assert warc.round_trip(spark, pages(spark, [])).collect() == [] == html.main_text(pages(spark, [])).collect()


def turns(spark, rows):
    return spark.createDataFrame([(*r, "p", "l", True) for r in rows], "conv_id long, turn long, role string, text string, piece string, loss string, round_trip boolean")


HARD = [
    (1, 0, "user", "a </turn>\nb"), (1, 1, "assistant", "\\"), (2, 0, "user", None), (2, 0, "assistant", "tie"), (2, 0, "assistant", "tie"), (3, None, None, "### assistant: x"), (None, 0, "we: ird\\###", "</turn>"),
    (4, 0, "assistant", " </turn>\n### user: hi </turn>\n"), (5, 0, "assistant", ""), (6, 0, "user", "x" * 100_000), (6, 1, "assistant", "\\\\</turn>\\###" * 2000), (7, 0, "", "#!chat\n"), (8, 0, "user", "$1 \\Q \\E"),
]


def test_hard_conversations_come_back(spark):
    out = chat.format_conversations(turns(spark, HARD))
    assert all(r["round_trip"] for r in out.collect()) and out.count() == 9
    back = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    assert back[1]["loss_chars"] == 1 and back[2]["n_turns"] == 3 and back[2]["loss_chars"] == 6 and back[5]["loss_chars"] == 0
    assert back[6]["loss_chars"] == len("\\\\</turn>\\###") * 2000
    assert chat.format_conversations(turns(spark, [])).collect() == []


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (9, 8), (7, 7), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, **dict.fromkeys(range(20, 26), 20)}
    assert connected_components(edges.where(F.lit(False))).collect() == []


def test_saved_tables_go_when_forgotten(spark):
    kept = common.saved(spark.range(3), "kept")
    path = Path(common._PATHS[kept].removeprefix("file:"))
    assert path.exists() and kept.count() == 3
    common.forget(kept)
    assert not path.exists()
