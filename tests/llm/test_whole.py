"""Each operator and stage on what it once left out."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from taxaflow.llm import common, decontaminate, minhash, packing, quality, secrets
from taxaflow.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def prose(i: int, n: int = 30) -> str:
    return " ".join(f"own{i}x{k}" for k in range(n))


def test_quality_rules_take_frequent_lines_out(spark, tmp_path, monkeypatch):
    line = "All Rights  reserved by us"
    body = lambda i: f"{line}\n{prose(i)}\n\n{line.upper()}\nlast {i}\n"
    rows = [(i, body(i), "a") for i in range(1, 26)] + [(1, body(1), "b"), (30, body(30) + line, "a"), (30, body(30) + line, "a"), (31, f"{line}\n" * 9 + prose(31, 20), "a"), (32, prose(32), "a")]
    want = {(i, t if i in (1, 32) else f"{prose(i)}\n\nlast {i}\n".removesuffix("\n" if i == 30 else ""), s) for i, t, s in rows if i != 31}
    for _ in range(2):  # broadcast, and shuffled
        out = corpus_pipeline.quality_rules(spark, docs(spark, rows), str(tmp_path)).collect()
        assert {(r["doc_id"], r["text"], r["source"]) for r in out} == want and len(out) == 29
        assert all(r["n_chars"] == len(r["text"]) for r in out)
        monkeypatch.setattr(common, "bounded_broadcast", lambda df, n: df)


@pytest.mark.parametrize("places, want", [([0], "b\n\nc\n"), ([1, 2, 4], "a\nc"), ([0, 1, 2, 3, 4], ""), ([2], "a\nb\nc\n")])
def test_lines_between_places(spark, places, want):
    one = spark.range(1).select(quality.without_lines(F.lit("a\nb\n\nc\n"), F.array(*map(F.lit, places))).alias("t"))
    assert one.first()["t"] == want


def held(words, item) -> bool:
    """By every part of every diagonal with a seed hit: 12 agreeing words and 70 % of the part."""
    for d in range(-len(item), len(words)):
        same = [i for i in range(max(0, d), min(len(words), d + len(item))) if words[i] == item[i - d]]
        hit = any(all(i + k in same for k in mask) and d <= i and i + 12 <= min(len(words), d + len(item)) for i in range(max(0, d), len(words)) for mask in decontaminate.MASKS)
        if hit and any(10 * (k - j + 1) >= 7 * (same[k] - same[j] + 1) for j in range(len(same)) for k in range(j + 11, len(same))):
            return True
    return False


def test_decontamination_judges_every_part_of_a_diagonal(spark, tmp_path):
    rng = random.Random(4)
    item = [f"w{i}" for i in range(59)]
    part = lambda spans: [w if any(a <= i < b for a, b in spans) else f"o{rng.randrange(9999)}" for i, w in enumerate(item)]
    texts = {
        1: part([(0, 14), (45, 59)]),  # two parts, the middle rewritten
        2: ["x"] * 7 + part([(0, 14)]),
        3: part([(0, 8), (50, 59)]),  # neither part is long enough
        4: [w if i in (0, 1, 3, 7, 9, 10, 11) or 12 <= i < 40 and i % 4 else "o" for i, w in enumerate(item)],  # only one seed hits
        5: [f"n{i}" for i in range(60)],
    }
    for i in range(6, 46):
        share = rng.choice((0.1, 0.25, 0.35, 0.5))
        texts[i] = ["y"] * rng.randrange(4) + [w if rng.random() > share else "o" for w in item[rng.randrange(20) :]]
    spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (None, "z " * 20)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs(spark, [(i, " ".join(t), "a") for i, t in texts.items()]), str(tmp_path)).collect()}
    assert kept == {i for i, t in texts.items() if not held(t, item)}
    assert 1 not in kept and 2 not in kept and 4 not in kept and {3, 5} <= kept


def test_added_tokens_inside_texts_are_found(spark):
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|", "Ends.<|endoftext|>\n\n Then"]
    t = Tokenizer.from_file(vocabulary())
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    assert want[0][2] == 50256
    rows = packing.pack(docs(spark, [(i, x, "a") for i, x in enumerate(texts)]), vocabulary()).collect()
    assert {r["doc_id"] for r in rows} == set(want)
    for r in rows:
        own = want[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


def test_secrets_are_judged_at_each_place(spark, tmp_path):
    key = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"
    other = key[::-1]
    texts = {
        1: f'river stone commit {key} of the window\nand then with api_key = "{key}" in the garden',
        2: f'api_key = "{key}" river stone\nand then commit {key} of the window',
        3: f"river stone commit {other} of the window",
        4: f'river x{key}9 stone https://example.org/{key} then token = "{key}" in',
    }
    rows = docs(spark, [*((i, t, "a") for i, t in texts.items()), (1, texts[1], "a")])
    found = [r for r in secrets.findings(rows).collect() if r["value"] in (key, other)]
    assert sorted((r["doc_id"], r["is_secret"]) for r in found) == [(1, True), (1, True), (2, True), (3, False), (4, True)]
    assert all(texts[r["doc_id"]][r["at"] :].startswith(r["value"]) and r["times"] == texts[r["doc_id"]].count(r["value"]) for r in found)
    assert {r["at"] for r in found if r["doc_id"] == 4} == {texts[4].index("/" + key) + 1}
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.secret_scan(spark, rows, str(tmp_path)).collect()}
    assert all(key not in t for t in out.values()) and out[3] == texts[3]


def test_keys_at_sentence_ends_and_behind_other_names(spark, tmp_path):
    known = "AKIA" + "Q7XK2M9ZB4TR8WVN"
    hexes = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"
    texts = {
        1: f"river stone then {known}. And the window",
        2: f"river aws_id={known} stone",
        3: f"river stone/{known}/window, and",
        4: f"river TOKEN={hexes}. And the window",
        5: f'river stone "{known}..." then',
        6: f"river stone X{known}9 then",
    }
    rows = docs(spark, [(i, t, "a") for i, t in texts.items()])
    found = {(r["doc_id"], r["value"]) for r in secrets.findings(rows).collect() if r["is_secret"]}
    assert {(i, known) for i in (1, 2, 5)} | {(4, hexes)} <= found
    values = {(r["doc_id"], r["value"]) for r in secrets.candidates(rows).collect()}
    assert (3, known) in values and (6, known) not in values and not any(v.endswith(".") or "=" in v for _, v in values)
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.secret_scan(spark, rows, str(tmp_path)).collect()}
    assert out[1] == "river stone then [SECRET]. And the window" and out[2] == "river aws_id=[SECRET] stone" and out[4] == "river TOKEN=[SECRET]. And the window"


def test_near_copies_by_brute_force(spark, tmp_path):
    rng = random.Random(8)
    texts = {}
    for i in range(120):
        words = prose(i % 12, 150).split()
        for k in rng.sample(range(150), rng.choice((0, 1, 2, 3, 4, 6, 9))):
            words[k] = f"new{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    texts |= {200: "", 201: None, 202: "two words", 203: "Two  words", 204: "other words"}

    def cut(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: cut(t) for i, t in texts.items()}
    link = lambda a, b: a == b or 100 * len(a & b) >= 80 * len(a | b) > 0
    want = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and link(sets[i], sets[j]) and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = {k: low if c == high else c for k, c in want.items()}
    rows = docs(spark, [(i, t, "a") for i, t in texts.items()])
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_copies(rows).collect()}
    assert got == want and len(set(want.values())) < 110
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, rows, str(tmp_path)).collect()} == set(want.values())


def test_near_copies_come_by_the_segment_join(spark, monkeypatch):
    words = [f"w{i}" for i in range(600)]
    rows = [(7, " ".join(words)), (3, " ".join([*words[:-1], "x"])), (5, " ".join(f"v{i}" for i in range(600)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "band_cells", lambda nodes: nodes.select("node", "size", F.lit(0).cast("long").alias("cell")).limit(0))
    assert sorted(r["doc_id"] for r in minhash.drop_near_copies(docs).collect()) == [3, 5]
