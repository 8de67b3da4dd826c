"""The queries against brute force, round trips and held-out accuracy."""

import base64
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taxaflow.llm import decontaminate, packing, pii, queries, simhash, warc
from taxaflow.llm.html import Page

DIR = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, tables, name):
    df = queries.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    theirs = tables.sql(queries.oracle_sql()[name]).select(", ".join(cols)).fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(str, theirs))


def slow_fingerprint(text: str) -> int:
    import xxhash

    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps: dict[int, int], bits: int) -> dict[int, int]:
    up = {i: i for i in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_by_brute_force(spark, tables):
    docs = dict(tables.sql("select doc_id, text from documents").fetchall())
    fps = {i: slow_fingerprint(t) for i, t in docs.items()}
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in queries.op8_segment_popcount(spark, DIR).collect()}
    assert got == {i: (fps[i], c) for i, c in classes(fps, 4).items()}


def test_links_of_dense_and_sparse_fingerprints(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    fps = {i: c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for i, c in enumerate(centres * 25)}
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in fps.values()})
    want = classes(dict(enumerate(x & (1 << 64) - 1 for x in signed)), 4)
    rows = simhash.fingerprint_components(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    root = {r["fp"]: r["root"] for r in rows}
    assert len(rows) == len(signed)
    assert [root[x] for x in signed] == [signed[want[i]] for i in range(len(signed))]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text: str):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


CUES = pii.automaton()


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab19.05@-+ ()%é:IBANtel/SN", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.scan(text, CUES)[0] == plain(text)


def test_added_spans():
    card = "4465758382889437"
    base, added = pii.scan(f"{card} {card} and IBAN GB82 WEST 1234 5698 7654 32 OK", CUES)
    assert base == [] and [(k, e - s) for k, s, e in added] == [("card", 16), ("card", 16), ("account", 27)]
    base, added = pii.scan(f"call +1 (663) 555-6869 {card} now", CUES)
    assert [s for s in base if s[0] == "phone"] == [] and added[-1] == ("phone", 5, 22)


def test_schemes_and_account_cues():
    text = "tel: (663) 555-6869, http://ann:pw@host.example/x http://host.example/a@b account number: 1234-5678-90 and SSN 123-45-6789; account of 12"
    got = [(k, text[a:b]) for k, a, b in pii.scan(text, CUES)[1]]
    assert got == [("phone", "(663) 555-6869"), ("account", "1234-5678-90"), ("account", "123-45-6789"), ("url", "http://ann:pw@host.example")]


def test_personal_data_of_documents(spark, tables):
    docs = dict(tables.sql("select doc_id, text from documents").fetchall())
    for r in queries.op5_anchor_expansion(spark, DIR).collect():
        want = plain(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert r["n_card"] == sum(k == "card" for k, *_ in want)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r["spans"].split(","))


def test_packing_keeps_every_id(spark, tables):
    from tokenizers import Tokenizer

    docs = dict(tables.sql("select doc_id, text from documents").fetchall())
    t = Tokenizer.from_file(queries.vocabulary())
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in docs.items()}
    rows = queries.op7_dp_packing(spark, DIR).collect()
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    covered: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == covered.get(r["doc_id"], 0)
        covered[r["doc_id"]] = r["start"] + r["length"]
    assert covered == {i: len(x) for i, x in ids.items()}
    filled: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 1024
    assert sum(1024 - n for n in filled.values() if n & (n - 1)) < 0.05 * sum(filled.values())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), min_size=1, max_size=25), st.data())
def test_cuts_cost_least(gaps, data):
    bounds = [0, *np.cumsum(gaps).tolist()]
    costs = [0, *(data.draw(st.integers(0, 9)) for _ in gaps)]
    padding = lambda n: 0 if n & (n - 1) == 0 else 16 - n
    price = lambda cut: sum(padding(b - a) + costs[bounds.index(b)] for a, b in zip(cut, cut[1:], strict=False))
    best = {0: 0}
    for j, p in enumerate(bounds[1:], 1):
        best[p] = min(best[q] + padding(p - q) for q in bounds[:j] if p - q <= 16) + costs[j]
    assert price(packing.cuts(bounds, costs, 16)) == best[bounds[-1]]


def test_warc_round_trip(spark, tables):
    pages = tables.sql("select page_id, html from pages").fetchall()
    first: dict[str, int] = {}
    for i, h in pages:
        first[h] = min(i, first.get(h, i))
    got = {r["page_id"]: r for r in queries.op3_capture_index(spark, DIR).collect()}
    assert len(got) == len(pages)
    for i, h in pages:
        r, data = got[i], h.encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[h] == i else ("revisit", first[h]))


def test_index_finds_exactly_its_keys(spark, tmp_path):
    rng = random.Random(5)
    keys = [f"com,x{rng.randrange(40):02d})/{rng.randrange(30)} {i % 7}" for i in range(700)]
    rows = spark.createDataFrame([(k, "a", i, 1) for i, k in enumerate(keys)], "key string, archive string, offset long, length long")
    shards = warc.write_index(rows.repartition(5), str(tmp_path / "cdx"), block_lines=8)
    reader = warc.Reader(str(tmp_path), str(tmp_path / "cdx"), shards)
    for k in [*sorted(set(keys)), "", "com,x05)/", "zzz"]:
        assert sorted(x[1] for x in reader.captures(k.encode())) == [i for i, x in enumerate(keys) if x == k]


def test_surt(spark):
    from pyspark.sql import functions as F

    urls = [("http://www.Example.com:80/A?b#c", "com,example)/A?b"), ("https://u@m.a.org", "org,a,m)/"), ("x y", "x%20y"), (None, "")]
    got = spark.createDataFrame([(u,) for u, _ in urls], "u string").select(warc.surt(F.col("u")).alias("s")).collect()
    assert [r["s"] for r in got] == [s for _, s in urls]


def test_substituted_passages_are_found_and_clean_text_is_not(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(40) for _ in range(30)]
    docs, want = [], set()
    for i in range(300):
        words = text(120)
        if i % 3 == 0:
            item = items[i % 30][:]
            for k in range(4, 40, 9):
                item[k] = "other"
            words[50:50] = [w.upper() + "," for w in item]
            want.add((i, i % 30))
        docs.append((i, " ".join(words)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    for limit in (decontaminate.MAX_BROADCAST_ROWS, 0):  # broadcast, and shuffled
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b, max_broadcast_rows=limit).collect()} == want


def test_toxicity_on_held_out_rows(spark, tables):
    d = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op6_boosted_toxicity(spark, d).collect()}
    labels = duckdb.sql(f"select doc_id, toxic from '{d}/labels.parquet'").fetchall()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for i, r in rows.items())
    held = [(rows[i]["predicted"], y) for i, y in labels if rows[i]["held_out"]]
    assert sum(p == y for p, y in held) / len(held) > 0.93
    assert sum(p and y for p, y in held) / sum(y for _, y in held) > 0.7


def test_secrets_of_documents(spark, tables):
    docs = dict(tables.sql("select doc_id, text from documents").fetchall())
    rows = queries.op4_secret_forest(spark, DIR).collect()
    found = {(r["doc_id"], r["value_sha256"]) for r in rows if r["is_secret"]}
    want = {(i, hashlib.sha256(m[1].encode()).hexdigest()) for i, t in docs.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    assert found == want
    for r in rows:
        value = docs[r["doc_id"]][r["at"] : r["at"] + r["length"]]
        assert hashlib.sha256(value.encode()).hexdigest() == r["value_sha256"] and docs[r["doc_id"]].count(value) == r["times"]


def test_main_text_of_pages(spark, tables):
    import html

    got = {r["page_id"]: r for r in queries.op10_consensus_paths(spark, DIR).collect()}
    for i, source in tables.sql("select page_id, html from pages").fetchall():
        article = re.search("<article>(.*?)</article>", source, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " " if "<br" in b else "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert got[i]["text"] == "\n\n".join(b for b in blocks if b) and got[i]["n_chars"] == len(got[i]["text"])


def test_page_parts():
    page = Page(
        "<html><head><title>t</title></head><body><div class='cookie-notice'>We use</div><header>H</header><nav>n</nav><main><div class='post-12'><h1>T &amp; x</h1>"
        "<p>Hello, <a href=x>link</a> world<br>more<p>Second, with&nbsp;commas, here<ul><li>one<li>two</ul><form>f</form><!-- no --><div id=comments>c</div></div></main><aside>s</aside><script>if (a<b) '</p>'</script></body></html>"
    )
    assert page.path(page.best()[0]) == "body>main>div.post"
    assert page.text([]) == "T & x\n\nHello, link world more\n\nSecond, with commas, here\n\none\n\ntwo"


def test_deep_pages_cost_in_proportion():
    page = Page("<div>x" * 20_000 + "<font>y" * 20_000)
    assert len(page.blocks) == 20_000 and page.text([]).startswith("x\n\nx")
