"""Main-text extraction with consensus paths for each host.

A page is cut into blocks of text, each with the elements around it. First pass: each page scores its containers by all the running text
under them, links counting against it, and goes down from the root as long as one child holds nearly all; it names the container it ends
at by its generalised path, the tags and classes from the body on without digits. The paths of a host's pages are added up in Spark; those
with a fair share win. Second pass: each page is read again and gives the blocks under the host's winning path, or under its own best
container if it has none of the winners or they hold under half of its running text. Navigation, forms, adverts, notices and comments
inside are left out in both passes; what only looks like one by its class, but holds most of the page's running text, stays.
"""

from __future__ import annotations

import html as references
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, saved

#: Least share of a host's votes that makes a path a winner (so there are 10 at most), and hosts up to which winners are broadcast.
MIN_SHARE, MAX_BROADCAST_HOSTS = 0.1, 50_000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't text of the page; they don't end a paragraph.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg object annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img "
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
SKIPPED = frozenset("head nav footer aside button select menu dialog".split())
#: Left out unless they hold most of the page's running text: some pages are one form.
SKIPPED_IF_SMALL = frozenset("form fieldset header".split())
#: Class, id and role words of what isn't the article.
SKIPPED_WORDS = frozenset(
    "nav navbar navigation menu menubar sidebar aside ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login search comment comments commentlist disqus respond reply replies share sharing social related recommended breadcrumb breadcrumbs pagination pager footer "
    "copyright skip toolbar widget complementary contentinfo".split()
)
#: These name a page's head, but inside an article its title.
HEAD_WORDS = frozenset("header masthead topbar".split())
#: Words that a class may have beside one of the above and still mean it; any other word makes it something else (has-sidebar, related-work).
FILLER = frozenset("box block container wrapper wrap area section list item items inner outer body top bottom left right main primary secondary site page global bar unit slot x google message posts articles links icons buttons form footer header".split())
#: What readers wrote; inside an article, tags of running text, and words that say little about them.
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td section figure figcaption table".split())
AMBIGUOUS = frozenset("alert notice notices related recommended search skip reply replies respond social share sharing widget menu navigation overlay comment comments".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A container must hold this share of the running text around it to be gone down to.
NEARLY_ALL = 0.8
#: Inside these a class tells a kind of text: code is marked up so.
MARKED_UP = frozenset("pre code".split())
CLOSED_BY_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt tr td th tbody thead".split()
)
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table article section div main body td th nav aside footer form blockquote".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NOT_WORD = re.compile(r"[^a-z]+")

Block = tuple[str, int, int]


def _value(block: Block) -> float:
    """Running text of a block: its characters, links counting against it."""
    return max(0.0, len(block[0]) - 2.0 * block[1])


def _named(token: str, tag: str, in_article: bool) -> bool | None:
    """Whether a class, id or role says that an element isn't the article's: None: no, False: yes, True: yes, readers' comments."""
    words = [w for w in NOT_WORD.split(token) if w]
    kinds = SKIPPED_WORDS if in_article else SKIPPED_WORDS | HEAD_WORDS
    if tag in ("article", "main"):
        kinds = COMMENT_WORDS
    elif in_article and tag in HEADINGS:
        return None
    elif in_article and tag in PROSE:
        kinds = kinds - AMBIGUOUS
    if not any(w in kinds for w in words) or not all(w in kinds or w in FILLER for w in words):
        return None
    return any(w in COMMENT_WORDS for w in words)


class Page:
    """The blocks of a page: text, characters in links, and the element around; the parent, tag and path of each element.

    Elements point to their parents and paths to the path above, so a page costs memory in proportion, however deep it is.
    """

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.parents: list[int] = []
        self.tags: list[str] = []
        self.path_of: list[int] = []
        self._soft: dict[int, bool] = {}  # elements left out unless they hold most of the text; True: readers' comments, in any case
        self._names: list[tuple[int, str]] = []  # of each path: the path above and the last name
        self._path_ids: dict[tuple[int, str], int] = {}
        self._read(source)
        self._leave_out()

    def _path_id(self, above: int, name: str) -> int:
        key = (above, name)
        if key not in self._path_ids:
            self._path_ids[key] = len(self._names)
            self._names.append(key)
        return self._path_ids[key]

    def path(self, element: int) -> str:
        names, k = [], self.path_of[element]
        while k >= 0:
            k, name = self._names[k]
            names.append(name)
        return ">".join(reversed(names))

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, bool, bool, bool]] = []  # tag, element number, skipped, in an article, in an inline element named otherwise
        parts: list[str] = []  # what was skipped never gets here
        links, pos, in_link, plain = 0, 0, 0, False

        def end_block() -> None:
            nonlocal links, plain
            if parts:
                text, at = " ".join(references.unescape("".join(parts)).split()), stack[-1][1] if stack else -1
                # Of a block that is all inline elements named as something else nothing is the article's, unless its own tag says so.
                if text and (plain or at >= 0 and self.tags[at] in PROSE):
                    self.blocks.append((text, min(links, len(text)), at))
                parts.clear()
            links, plain = 0, False

        def pop_to(k: int) -> None:
            nonlocal in_link
            in_link -= sum(x[0] == "a" for x in stack[k:])
            del stack[k:]

        n = len(source)
        while pos < n:
            m = TOKEN.search(source, pos)
            end = m.start() if m else n
            if end > pos and not (stack and stack[-1][2]):
                parts.append(source[pos:end])
                plain = plain or not (stack and stack[-1][4]) and not source[pos:end].isspace()
                if in_link:
                    links += end - pos
            if not m:
                break
            pos = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing, attributes = m[1] or m[4], m[3] or m[6] or ""
            if closing:
                if tag in RAW:
                    continue
                if tag not in INLINE:
                    end_block()
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if k is not None and (tag not in INLINE or not any(x[0] in SCOPE for x in stack[k + 1 :])):
                    pop_to(k)
                continue
            if tag == "br":
                parts.append(" ")
            if tag not in INLINE and tag not in RAW:
                end_block()
                if tag in CLOSED_BY_P:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == "p":
                            pop_to(i)
                            break
                        if stack[i][0] in SCOPE:
                            break
                for i in range(len(stack) - 1, -1, -1) if tag in SAME_CLOSES else ():
                    if stack[i][0] in SAME_CLOSES[tag]:
                        pop_to(i)
                        break
                    if stack[i][0] in SCOPE and stack[i][0] not in ("td", "th"):
                        break
            if tag in RAW:
                if not attributes.rstrip().endswith("/"):
                    close = re.compile(rf"</{re.escape(tag)}(?![A-Za-z0-9])[^>]*>?", re.I).search(source, pos)
                    pos = close.end() if close else n
                continue
            if tag in VOID or attributes.rstrip().endswith("/") and tag in INLINE:
                continue
            above = stack[-1] if stack else ("", -1, False, False, False)
            in_article = above[3] or tag in ("article", "main")
            skipped, soft, name = above[2] or tag in SKIPPED, False if tag in SKIPPED_IF_SMALL and not (tag == "header" and above[3]) else None, tag
            if attributes and not attributes.isspace():
                for key, *values in ATTRIBUTE.findall(attributes):
                    key, value = key.lower(), next((v for v in values if v), "").lower()
                    if key == "hidden" or key == "aria-hidden" and value == "true":
                        skipped = True
                    elif key in ("class", "id", "role"):
                        if tag not in ("html", "body"):
                            for token in value.split():
                                if (kind := _named(token, tag, above[3])) is not None:
                                    soft = bool(soft) or kind
                        if key == "class" and (found := [w for w in NOT_WORD.split(value) if w]):
                            name += "." + ".".join(found)
            if tag in INLINE:
                # By its class alone no inline element goes: text around it goes on.
                named = soft is not None and not any(x[0] in MARKED_UP for x in stack)
                stack.append((tag, above[1], skipped, in_article, above[4] or named))
                in_link += tag == "a"
            else:
                # The root isn't part of a path: pages with and without its tag agree.
                over = self.path_of[above[1]] if above[1] >= 0 and above[0] != "html" else -1
                stack.append((tag, len(self.parents), skipped, in_article, above[4]))
                if soft is not None:
                    self._soft[len(self.parents)] = soft
                self.parents.append(above[1])
                self.tags.append(tag)
                self.path_of.append(self._path_id(over, name))
        end_block()

    def _sums(self, value) -> list[float]:
        """For each element the values of all blocks under it. Parents come before their children."""
        out = [0.0] * len(self.parents)
        for block in self.blocks:
            if block[2] >= 0:
                out[block[2]] += value(block)
        for e in range(len(out) - 1, -1, -1):
            if self.parents[e] >= 0:
                out[self.parents[e]] += out[e]
        return out

    def _leave_out(self) -> None:
        """Takes out the blocks under elements that are named or tagged as something else and hold at most half of the running text."""
        if not self._soft:
            return
        gone: list[bool] = []

        def mark(soft) -> None:
            gone.clear()
            for e, parent in enumerate(self.parents):
                gone.append(soft(e) or parent >= 0 and gone[parent])

        mark(lambda e: self._soft.get(e, False))
        self.blocks = [x for x in self.blocks if x[2] < 0 or not gone[x[2]]]
        held, total = self._sums(_value), sum(map(_value, self.blocks))
        # An article with text of its own settles it: only what is around the article can be more than it is named.
        marked = [e for e, tag in enumerate(self.tags) if tag in ("article", "main") and held[e]]
        around = set()
        for e in marked:
            while e >= 0 and e not in around:
                around.add(e)
                e = self.parents[e]
        mark(lambda e: e in self._soft and not (2 * held[e] > total and (e in around or not marked)))
        self.blocks = [x for x in self.blocks if x[2] < 0 or not gone[x[2]]]

    def best(self) -> tuple[int, float]:
        """The element to read, and the running text under it. From the root on, a child with nearly all of it is gone down to, but not
        past a heading of its own level or a title before it, not out of an article (in main only if nothing else is in it), and not into
        a paragraph."""
        held, children = self._sums(_value), {}
        if not self.blocks:
            return -1, 0.0
        texts = self._sums(lambda _: 1)
        largest: dict[int, int] = {}
        for e, parent in enumerate(self.parents):
            if texts[e]:
                children.setdefault(parent, 0)
                children[parent] += 1
                if parent not in largest or held[e] > held[largest[parent]]:
                    largest[parent] = e
        headed = {self.parents[e] for _, _, e in self.blocks if e >= 0 and self.tags[e] in HEADINGS}
        titles = sorted({e for _, _, e in self.blocks if e >= 0 and self.tags[e] == "h1"})
        at, all_held, all_texts, in_main = -1, sum(map(_value, self.blocks)), len(self.blocks), False
        while at in largest:
            e = largest[at]
            # Elements are numbered in page order, so titles between the two are under the one and before the other.
            if bisect_left(titles, e) > bisect_left(titles, at + 1):
                break
            whole, in_main = texts[e] == all_texts, in_main or at >= 0 and self.tags[at] == "main"
            if at >= 0 and (e not in largest or self.tags[e] in PROSE - {"section", "td", "table"}):
                break
            if at >= 0 and not whole and (held[e] < NEARLY_ALL * all_held or at in headed or in_main) or at >= 0 and self.tags[at] == "article":
                break
            if at < 0 and not whole and held[e] < NEARLY_ALL * all_held:
                break
            at, all_held, all_texts = e, held[e], texts[e]
        return at, all_held

    def _under(self, chosen: set[int]) -> list[str]:
        """The blocks inside any of the chosen elements. Parents come before their children."""
        inside: list[bool] = []
        for e, parent in enumerate(self.parents):
            inside.append(e in chosen or parent >= 0 and inside[parent])
        return [text for text, _, e in self.blocks if e >= 0 and inside[e]]

    def text(self, paths: list[str]) -> str:
        """The blocks under the first of `paths` that holds at least half of what the page's own best container does, else those under the
        latter, joined by blank lines."""
        own = self.best()[0]
        mine = self._under({own}) if own >= 0 else [t for t, _, _ in self.blocks]
        for path in paths:
            k: int | None = -1
            for name in path.split(">"):
                k = None if k is None else self._path_ids.get((k, name))
            found = [] if k is None else self._under({e for e, p in enumerate(self.path_of) if p == k})
            if found and 2 * sum(map(len, found)) >= sum(map(len, mine)):
                return "\n\n".join(found)
        return "\n\n".join(mine)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hosts, paths, scores = [], [], []
        for host, source in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            page = Page(source.as_py() or "")
            e, score = page.best()
            if e >= 0 and score > 0:
                hosts.append(host)
                paths.append(page.path(e))
                scores.append(score)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], names=["host", "path", "score"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [Page(source.as_py() or "").text(paths or []) for source, paths in zip(b.column(2), b.column(3).to_pylist(), strict=True)]
        cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])


def winning_paths(pages: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, paths): the paths that win on a host, best first. `pages` has host and html.

    A page votes once, so votes are added up by page and not by length; the sums combine before they shuffle.
    """
    votes = pages.select("host", "html").mapInArrow(_votes, "host string, path string, score double")
    counted = saved(votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score")), "votes")
    total = counted.groupBy(F.col("host").alias("of")).agg(F.sum("votes").alias("all"))
    won = counted.join(total, F.col("host") == F.col("of")).where(F.col("votes") >= min_share * F.col("all"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.round("score", 3)).alias("s"), "path")))
    return won.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


def main_text(pages: DataFrame, min_share: float = MIN_SHARE, max_broadcast_hosts: int = MAX_BROADCAST_HOSTS) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of `pages` (page_id, url, html).

    A null or empty html gives an empty text. Pages without url or host vote for the host "". Repeated rows each give a row and a vote.
    An empty table gives no rows. Pages of any length are read whole, one at a time. Of paths with equal votes that with more running text
    comes first, then the first in order. Extra columns are ignored, whatever their names.
    """
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.coalesce(host, F.lit("")).alias("host"))
    winners = bounded_broadcast(saved(winning_paths(rows, min_share), "host-paths").withColumnRenamed("host", "of"), max_broadcast_hosts)
    joined = rows.join(winners, rows["host"] == winners["of"], "left").select("page_id", "url", "html", "paths")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
