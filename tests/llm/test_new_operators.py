"""Prefix tries, source divergence and languages on small and hard tables, against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxaflow.llm import divergence, language, prefix_trie

CONV = "conv_id long, turn long, role string, text string"


def crc(x) -> int:
    return zlib.crc32(str(x).encode())


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    base = lambda c: c - (c - int(c / 20) * 20)
    built = {c: tuple(turns.get(base(c), [])[: crc(c) % 4] + turns[c][crc(c) % 4 :]) for c in turns}
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    words = lambda x: len(x.replace("\t", " ").replace("\n", " ").split(" ")) - x.replace("\t", " ").replace("\n", " ").split(" ").count("")
    out = []
    for key, cs in members.items():
        kids = [k for k in members if len(k) == len(key) + 1 and k[: len(key)] == key]
        sub = [k for k in members if k[: len(key)] == key]
        leaves = sum(not any(len(q) == len(k) + 1 and q[: len(k)] == k for q in sub) for k in sub)
        saved = sum((len(members[k]) - 1) * (words(k[-1][1]) if k else 0) for k in sub)
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(key))))
        out.append((min(cs), len(key), min(members[key[:-1]]) if key else None, len(cs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(df):
    return sorted(tuple(r[c] for c in COLS) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_trie_is_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "TURN_BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "END_BLOCK", 4)
    rng = random.Random(seed)
    rows = []
    for c in [*rng.sample(range(0, 90), 40), -3, -20, 10**12]:
        for t in range(rng.choice((1, 1, 2, 4, 9))):
            rows.append((c, rng.choice((t, t, None, 0)), rng.choice(("user", None)), rng.choice(("a b", "a  c\td", "", None, "ü"))))
    rows += rows[:5] + [(None, 1, "user", "x")]
    assert trie_rows(prefix_trie.prefix_trie(spark.createDataFrame(rows, CONV))) == brute_trie(rows)


def test_trie_of_a_long_conversation_a_large_group_and_no_table(spark):
    long = [(40, t, "user", f"t{t}") for t in range(70)]
    group = [(c, t, "user", "same words here") for c in range(100, 160) for t in range(4)]
    df = spark.createDataFrame(long + group, CONV).withColumn("depth", F.lit(1)).withColumn("k0", F.lit("x"))
    assert trie_rows(prefix_trie.prefix_trie(df)) == brute_trie(long + group)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONV)).count() == 0
    one = trie_rows(prefix_trie.prefix_trie(spark.createDataFrame([(5, 0, "user", "x")], CONV)))  # its turns are all left out
    assert one == brute_trie([(5, 0, "user", "x")]) and crc(5) % 4 > 0 and one[0][:7] == (5, 0, None, 1, 0, 1, 0)


@pytest.mark.parametrize("seed", range(4))
def test_transducer_is_minimal_and_numbers_its_terms(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))).encode() for _ in range(200)})
    made = divergence.Transducer.from_bytes(divergence.Transducer.build(words).to_bytes())
    asked = words + [b"zz", b"a" * 30, b"b\xc3", words[3] + b"q"]
    assert made.ordinals(asked).tolist() == [words.index(w) if w in words else -1 for w in asked]
    assert [made.term(i) for i in range(len(words))] == words
    # As many states as there are different sets of continuations.
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    assert len(made.final) - 1 == len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes})


def brute_divergence(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    count, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = divergence.terms(text.encode())
        count[lang, source].update(found)
        held[lang].update(set(found))
    out = []
    for lang in {r[1] for r in rows}:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        sources = sorted({s for _, of, s in rows if of == lang})
        n = {s: {t: count[lang, s][t] for t in kept} for s in sources}
        n[None] = {t: sum(n[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c + 5) // (sum(x.values()) + 5 * len(kept)) for t, c in x.items()} for s, x in n.items()}
        for s in sources:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            term = sorted((p[None][t] - p[s][t], t) for t in kept if n[s][t] and p[s][t] > p[None][t])[:top]
            out += [(lang, s, part, item.decode(), -v, k + 1) for part, x in (("pair", pair), ("term", term)) for k, (v, item) in enumerate(x)]
    return sorted(out)


def test_divergence_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", 3)
    monkeypatch.setattr(divergence, "TERM_BLOCK", 5)
    rng = random.Random(1)
    vocabulary = ["".join(x) for x in product("abÄ", repeat=3)]
    rows = [(rng.choice((None, "", "1 2", *[" ".join(rng.choices(vocabulary, weights=range(1, 28), k=30)).upper()] * 9)), rng.choice(("en", "de", None)), rng.choice("stuvwxyz")) for _ in range(160)]
    rows += [("nur hier", "einsam", "s"), (None, "einsam", "t"), ("a" * 5000 + " é" * 3000, "en", None)] + rows[:6]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("ord", F.lit(7)).withColumn("n", F.lit(1))
    found = lambda **k: sorted(tuple(r) for r in divergence.source_divergence(df, 12, 6, **k).select("lang", "source", "part", "item", "value", "rank").collect())
    want = brute_divergence(rows, 12, 6)
    assert found() == want and len(want) > 60
    assert found(shard_terms=4, pass_bytes=600) == want  # several transducers and passes
    assert divergence.source_divergence(df.limit(0)).count() == 0


def brute_kneser_ney(words, max_entries=10**9):
    """p(character | history) by recursion over counts of places, for one language and an unbounded model."""
    b, order = language.BOUNDARY, language.ORDER
    n = Counter()
    for w, c in words.items():
        s = b + w + b
        for i in range(1, len(s)):
            for k in range(max(0, i - order + 1), i + 1):
                n[s[k : i + 1]] += c
    before = Counter(g[1:] for g in n if len(g) > 1)
    a = {g: c if len(g) == order or g[0] == b else before[g] for g, c in n.items()}
    d = {}
    for k in range(1, order + 1):
        few = Counter(x for g, x in a.items() if len(g) == k)
        d[k] = few[1] / (few[1] + 2 * few[2]) if few[1] * few[2] else 0.5
    total = Counter()
    for g, x in a.items():
        total[g[:-1]] += x
    floor = 1 / (1 + sum(len(g) == 1 for g in a))
    own = lambda g: max(a.get(g, 0) - d[len(g)], 0) / total[g[:-1]] if g in a else 0

    def p(g):
        rest = p(g[1:]) if len(g) > 1 else floor
        kept = [x for x in a if x[:-1] == g[:-1] and len(x) == len(g) and own(x) > 0]
        return own(g) + (max(1 - sum(map(own, kept)), 1e-9) if kept else 1) * rest

    return lambda w: -sum(np.log2(p((b + w + b)[max(0, i - order + 1) : i + 1])) for i in range(1, len(w) + 2))


def test_model_is_kneser_ney(spark):
    rng = random.Random(2)
    words = Counter("".join(rng.choices("abcß", weights=(5, 3, 1, 1), k=rng.randrange(1, 8))) for _ in range(150))
    longest = spark.createDataFrame([("x", g, n) for g, n in language.longest_grams(words)], "lang string, gram string, n long")
    rows = language.kneser_ney(longest).collect()
    model = language.Model.of([r["gram"] for r in rows], np.array([r["p"] for r in rows]), np.array([r["history"] for r in rows]))
    floor = 1 / (1 + sum(len(r["gram"]) == 1 and not r["history"] for r in rows))
    asked = [*list(words)[:20], "zz", "abq", "ßßßßßß"]
    want = brute_kneser_ney(words)
    bits, chars = language.cross_entropies([model], asked, floor)
    assert np.allclose(bits[:, 0], [want(w) for w in asked]) and chars.tolist() == [len(w) + 1 for w in asked]


def test_bounded_model_keeps_its_bound_and_stays_a_distribution(spark):
    rng = random.Random(3)
    words = Counter("".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(600))
    longest = spark.createDataFrame([("x", g, n) for g, n in language.longest_grams(words)], "lang string, gram string, n long")
    rows = language.kneser_ney(longest, max_entries=200).collect()
    assert 0 < sum(not r["history"] for r in rows) <= 200
    total = defaultdict(float)
    for r in rows:
        total[r["gram"] if r["history"] else r["gram"][:-1]] += r["p"]
    assert all(abs(x - 1) < 1e-6 for x in total.values())


def test_languages_of_hard_rows(spark):
    rng = random.Random(5)
    sounds = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schw", "ör", "ent", "ung"]}
    say = lambda x, n: " ".join("".join(rng.choices(sounds[x], k=3)) for _ in range(n))
    rows = [(i, say(x, 40), x) for i in range(300) for x in ("aa" if i % 2 else "bb",)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 ²½ !?", "bb"), (None, say("bb", 9), "bb"), (1003, say("aa", 30), None), (1004, say("bb", 20_000), None), rows[0], (1005, "Я", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("entropy", F.lit("x")).withColumn("best", F.lit(1))
    got = language.identify(df).collect()
    assert len(got) == len(rows)
    of = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == (r["doc_id"] is not None and crc(r["doc_id"]) % 4 == 2) for r in got)
    assert all(of[i]["lang_pred"] == x for i, t, x in rows[:300]) and of[1003]["lang_pred"] == "aa" and of[1004]["lang_pred"] == "bb" and of[None]["lang_pred"] == "bb"
    assert all((of[i]["lang_pred"], of[i]["score"], of[i]["rejected"]) == ("und", 0.0, True) for i in (1000, 1001, 1002))
    assert of[1005]["lang_pred"] in ("aa", "bb") and of[1005]["rejected"]  # of no language known
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in language.identify(df.where("lang is null")).collect()} == {"und"}
    assert language.identify(df.limit(0)).count() == 0


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("lang_pred")).alias("right")).first()
    assert got["n"] > 200 and got["right"] >= 0.99 * got["n"]
