"""Cases that the operators once got wrong, and their other ways of working."""

import random

import pytest
from pyspark.sql import functions as F

from taxaflow.llm import decontaminate, minhash, packing, quality, simhash, toxicity, warc
from taxaflow.llm.html import Page
from taxaflow.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Running text of an article that goes on for a while, with commas, and with more of them. " * 3


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def prose(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(10**9)}" for _ in range(n)]


def test_copies_are_documents_of_their_own(spark):
    text = "One line of more than a few words here\n" + "\n".join(" ".join(prose(k, 12)) for k in range(4))
    rows = docs(spark, [(i, text, "a") for i in range(30)] + [(100 + i, text, "b") for i in range(20)] + [(0, text, "a")])
    got = {(r["doc_id"], r["n_removed_words"], r["kept"]) for r in quality.quality(rows).collect()}
    assert got == {(i, 57, False) for i in range(30)} | {(100 + i, 0, True) for i in range(20)}
    first = {r["doc_id"]: r["kept"] for r in quality.quality(rows, keep_first=True).collect()}
    assert first[0] and not any(first[i] for i in range(1, 30))
    assert {r["doc_id"] for r in quality.apply_rules(rows, keep_first=True).collect()} == {0, *range(100, 120)}


@pytest.mark.parametrize("broadcast", [0, 3, 400_000])
def test_overlaps_by_every_join(spark, broadcast):
    item = prose(1, 40)
    near = [w if k % 6 else f"other{k}" for k, w in enumerate(item)]
    rows = docs(spark, [(1, " ".join(prose(2, 9) + item + prose(3, 9)), "a"), (2, " ".join(near), "a"), (3, " ".join(prose(4, 60)), "a"), (2, " ".join(near), "a"), (None, " ".join(item), "a"), (5, None, "a")])
    items = spark.createDataFrame([(7, " ".join(item), "x", 1), (7, " ".join(item), "x", 1), (8, None, "x", 1)], "item_id long, text string, doc_id string, pos int")
    got = {(r["doc_id"], r["item_id"], r["diagonal"], r["last_word"]) for r in decontaminate.overlaps(rows, items, max_broadcast_rows=broadcast).collect()}
    # From the twelfth agreeing word on each one ends a stretch: a sixth of the words differs, and 70 % have to agree.
    near_ends = [k for k in range(40) if k % 6][11:]
    assert got == {*[(i, 7, d, d + k) for i, d in ((1, 9), (None, 0)) for k in range(11, 40)], *[(2, 7, 0, k) for k in near_ends]}
    assert {r["doc_id"] for r in decontaminate.decontaminate(rows, items, max_broadcast_rows=broadcast).collect()} == {3, 5}


def test_a_second_passage_does_not_undo_the_first(spark):
    item = prose(5, 200)
    text = lambda *spans: " ".join(w if any(a <= k < b for a, b in spans) else f"own{k}" for k, w in enumerate(item))
    rows = docs(spark, [(1, text((0, 40)), "a"), (2, text((0, 40), (160, 200)), "a"), (3, text((0, 8), (160, 168)), "a")])
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {tuple(r) for r in decontaminate.contaminated(rows, items).collect()}
    assert got == {(1, 7, 1, 29), (2, 7, 1, 58)}


def test_decisions_beyond_their_bound(spark, monkeypatch):
    rows = docs(spark, [(i, "A line that many hold\n" + "\n".join(" ".join(prose(10 * i + k, 9)) for k in range(4)), "a") for i in range(25)])
    runs = []
    for bound in (400_000, 0):
        monkeypatch.setattr(quality, "MAX_BROADCAST_DECISIONS", bound)
        runs.append(sorted((r["doc_id"], r["text"], r["n_chars"]) for r in quality.apply_rules(rows).collect()))
    assert runs[0] == runs[1] and len(runs[0]) == 25 and not any("many hold" in t for _, t, _ in runs[0])


def jaccard(a: str, b: str) -> float:
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_in_blocks(spark, monkeypatch):
    r = random.Random(7)
    base = prose(5, 120)
    texts = [" ".join(prose(100 + k, 60)) for k in range(20)]
    for _ in range(60):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(w))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = {i: find(i) for i in range(len(texts))}
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "MAX_BROADCAST_CELLS", 0)
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_copies(docs(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert got == want
    assert minhash.near_copies(docs(spark, [])).collect() == []
    odd = docs(spark, [(None, "only one here", "a"), (None, "", "a"), (3, None, "a"), (4, "", "a"), (4, "", "a")])
    assert sorted(str((x["doc_id"], x["component_id"])) for x in minhash.near_copies(odd).collect()) == ["(3, 3)", "(4, 3)", "(4, 3)", "(None, 3)", "(None, None)"]


def test_fingerprints_of_rows_without_id(spark):
    a, b = " ".join(prose(1, 50)), " ".join(prose(2, 50))
    got = simhash.near_duplicates(docs(spark, [(None, a, "a"), (None, b, "a"), (9, b, "a"), (8, b, "a"), (None, a, "a")])).collect()
    assert sorted(str((r["doc_id"], r["component_id"])) for r in got) == ["(8, 8)", "(9, 8)", "(None, 8)", "(None, None)", "(None, None)"]


def test_pieces_of_small_runs(spark, monkeypatch):
    monkeypatch.setattr(packing, "AGAIN", 2)
    r = random.Random(3)
    texts = [" ".join(prose(k, r.randrange(0, 60))) + ("." if k % 3 else "") for k in range(80)]
    rows = docs(spark, [(k, t, "a") for k, t in enumerate(texts)]).coalesce(1)
    pieces = packing.pack(rows, vocabulary(), length=64, block_ids=300).collect()
    whole = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    ends, places = {}, {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        assert p["start"] == ends.get(p["doc_id"], 0)
        ends[p["doc_id"]] = p["start"] + p["length"]
        places.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert ends == whole and len(whole) == 80
    for rows in places.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 64
    used = sum(whole.values())
    padded = sum(0 if (n := sum(x for _, x in rows)) & (n - 1) == 0 else 64 - n for rows in places.values())
    assert padded < 0.1 * used


@pytest.mark.parametrize(
    "source, path, text",
    [
        (f'<div class="content has-sidebar"><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div class="sidebar"><p>side</p></div>', "body>div.content.has.sidebar", ["T", LONG, LONG]),
        (f'<div class="sidebar"><p>{LONG}</p><p>{LONG}</p></div>', "body>div.sidebar", [LONG, LONG]),
        (f"<nav>n</nav><article><h1>Title</h1><section><p>{LONG}</p><p>{LONG}</p></section></article>", "body>article", ["Title", LONG, LONG]),
        (f'<article><section class="a"><p>A</p></section><section class="b"><p>{LONG}</p><p>{LONG}</p></section></article>', "body>article", ["A", LONG, LONG]),
        (f'<article><p>{LONG}</p><p class="alert">Inside.</p><section id="related-work"><h2>Related</h2><p>{LONG}</p></section></article>', "body>article", [LONG, "Inside.", "Related", LONG]),
        (f"<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be, <svg><text>no</text></svg>and <script>z</script>so on.</p><p>{LONG}</p></article>", "body>article", ["Let x=1 be, and so on.", LONG]),
        (f'<form id="f"><div id="top">Top</div><div class="post"><h1>H</h1><p>{LONG}</p><p>{LONG}</p></div></form>', "body>form>div.post", ["H", LONG, LONG]),
        (f'<div class="post"><h1>H</h1><p>Short text.</p></div><div id="comments"><p>{LONG}</p><p>{LONG}</p></div>', "body>div.post", ["H", "Short text."]),
        ('<div class="ad">An advert that is longer than the article.</div><article><h1>A</h1><p>B</article>', "body>article", ["A", "B"]),
        (f'<article><p>{LONG}</p><div class="cookie-notice">We use</div><div class="related-posts"><p>More</p></div><aside>x</aside></article>', "body>article", [LONG]),
    ],
)
def test_what_is_the_article(source, path, text):
    page = Page(f"<html><body>{source}</body></html>")
    assert page.path(page.best()[0]) == path
    assert page.text([]) == "\n\n".join(t.strip() for t in text)
    assert page.text([path]) == page.text([]) and page.text(["body>nothing"]) == page.text([])


def test_labels_and_ids_that_repeat(spark):
    rows = [(i, f"you vile awful{i % 3} thing, really awful" if i % 2 else f"a quiet morning by river {i}", "a") for i in range(120)]
    labels = spark.createDataFrame([(i, 1, i % 2, "text") for i in range(120)], "doc_id long, quality int, toxic int, text string")
    runs = [
        {(r["doc_id"], round(r["score"], 9)) for r in toxicity.toxicity(docs(spark, order), labels).collect()}
        for order in (rows + [(2, "zzz other text", "a")], [(2, "zzz other text", "a")] + rows[::-1])
    ]
    assert runs[0] == runs[1]


def test_read_back_in_as_many_tasks_as_archives_need(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 2_000)
    pages = spark.createDataFrame([(i, f"http://h{i % 5}.example/{i}", "<p>" + " ".join(prose(i % 50, 40))) for i in range(200)], "page_id long, url string, html string")
    got = warc.round_trip(spark, pages)
    assert got.rdd.getNumPartitions() > 4 and got.count() == 200
    assert {(r["page_id"], r["refers_to"]) for r in got.where("record_type = 'revisit'").collect()} == {(i, i % 50) for i in range(50, 200)}
    assert got.select(F.count_distinct("payload_digest")).first()[0] == 50


ARTICLE = "<p>" + "A long run of words that tells what the page is about, with commas and all. " * 4 + "</p>"


@pytest.mark.parametrize(
    "page, want",
    [
        ('<div class="social"><div class="post">{}</div></div>', "{}"),  # however short
        ("<article>{}<p>Real text here <span class='share'>x</p></article>", "{}\n\nReal text here x"),
        ("<article>{}<div>Second paragraph text <a class='social'><div>icon</div></a></div></article>", "{}\n\nSecond paragraph text"),
        ('<article>{}<pre><code><span class="token comment"># note</span></code></pre></article>', "{}\n\n# note"),
        ("<article>{}<p>The <span class='widget'>foo</span> bar <em class='notice'>is</em> <a class='related'>linked</a>.</p></article>", "{}\n\nThe foo bar is linked."),
        ("<article><h1 class='promo'>Title</h1>{}</article>", "Title\n\n{}"),
        ("<div class=title><h1>Title</h1></div><div class=body>{}</div>", "Title\n\n{}"),
        ("<div class=body>{}</div><div><a class=share>Share</a> <a class=share>Post</a></div>", "{}"),
        ("<article>{}<p hidden>no</p><p>yes <b hidden>no</b>end</p></article>", "{}\n\nyes end"),
    ],
)
def test_text_around_what_is_left_out(page, want):
    text = Page(ARTICLE).text([])
    assert Page(page.replace("{}", ARTICLE)).text([]) == want.replace("{}", text)


def test_nested_pages_by_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        n, blocks = 0, []

        def word():
            nonlocal n
            n += 1
            return f"w{n}"

        def inline(depth=0):
            text = " ".join(word() for _ in range(rng.randrange(2, 12)))
            if depth < 3 and rng.random() < 0.5:
                inner = inline(depth + 1)
                tag = rng.choice(("em", "span", "a", "b"))
                return text + f" <{tag} class='{rng.choice(('x', 'share', 'comment', 'widget ad', 'promo'))}'>" + inner[0] + f"</{tag}> end", text + " " + inner[1] + " end"
            return text, text

        def block():
            source, text = inline()
            blocks.append(text)
            return f"<{(tag := rng.choice(('p', 'p', 'h2', 'li', 'blockquote')))}>{source}</{tag}>"

        body = "".join(rng.choice(("{}", "<div>{}</div>", "<section class='part'>{}</section>")).format(block()) for _ in range(rng.randrange(2, 9)))
        noise = lambda: rng.choice(("<nav>Home</nav>", "<div class='sidebar'><p>side</p></div>", "<aside>a</aside>", "<div class='ad'>buy</div>", "<script>x<p></script>", "<form>f</form>", ""))
        wrap = rng.choice(("<article>{}</article>", "<main><div class='entry'>{}</div></main>", "<div id='c'><article class='post share'>{}</article></div>"))
        page = Page(f"<html><body>{noise()}{noise()}{wrap.format(body)}{noise()}<footer>end</footer></body></html>")
        assert page.text([]) == "\n\n".join(blocks)
