"""Quality rules by cross-document line frequency, in DataFrame functions only.

Lines are normalised and hashed; a line's frequency on a host is the number of documents there that hold it. A line above the limit is
taken out of the host's documents, and a document that then has too few of its words left is rejected. As an option the document with
the smallest id keeps such a line, so that what many pages share survives once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_DECISIONS, SPACE_CLASS, bounded_broadcast, decisions, let, row_key, saved

#: Documents of a host that may share a line, and the least share of its words that a document must keep.
MAX_LINE_DOCS, MIN_LEFT = 20, 0.5
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def _has_word(line: Column) -> Column:
    return F.length(F.translate(line, SPACES, "")) > 0


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    return let(F.filter(F.split(text, "\n"), _has_word), lambda x: F.size(x) - F.size(F.array_distinct(x)))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a run of `window` words which the text has twice or more.

    Runs are hashed and sorted with their positions; the places of those with an equal neighbour are put in order, and each covers
    `window` words or as many as there are to the next place.
    """

    def covered(places: Column) -> Column:
        step = F.transform(places, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(places, i + 1) - p, F.lit(window))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def places(sorted_runs: Column) -> Column:
        same = lambda x, i: (x["h"] == F.get(sorted_runs, i - 1)["h"]) | (x["h"] == F.get(sorted_runs, i + 1)["h"])
        return F.array_sort(F.transform(F.filter(sorted_runs, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["p"]))

    def count(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        slow = let(let(F.array_sort(pairs), places), covered)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(slow)

    def runs(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > window, let(let(hashed, runs), count)).otherwise(0)


def base_measures(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, host, text) as doc_id, host and the base columns of the contract."""
    d = docs.select("doc_id", "host", "text", words(F.col("text")).alias("w"))
    d = d.select(
        "doc_id",
        row_key(F.col("doc_id"), F.col("host"), F.col("text")).alias("key"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup_lines(F.col("text")).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def normalised(line: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), SPACE_CLASS + "+", " "))


def line_words(docs: DataFrame) -> DataFrame:
    """(key, doc_id, pos, line, n): the lines with a word, hashed with their host, and their words."""
    lines = docs.select(
        "doc_id",
        "host",
        row_key(F.col("doc_id"), F.col("host"), F.col("text")).alias("key"),
        F.posexplode(F.split("text", "\n")).alias("pos", "raw"),
    ).withColumn("line", normalised(F.col("raw")))
    n = F.length("line") - F.length(F.translate("line", " ", "")) + 1
    return lines.where("line <> ''").select("key", "doc_id", "pos", row_key(F.col("host"), F.col("line")).alias("line"), n.alias("n"))


def frequent_lines(lines: DataFrame, max_line_docs: int = MAX_LINE_DOCS) -> tuple[DataFrame, DataFrame]:
    """(line, first_doc) of the lines that more than `max_line_docs` documents of a host hold, and all places of at least these lines.

    First all places are counted, which combines before it shuffles: a line that a third of all documents share costs a row for each
    task. Only lines with enough places can have enough documents, and only theirs are counted one by one. Rows that repeat an id are
    one document; rows without id are one for each different text.
    """
    often = lines.groupBy("line").agg(F.count("*").alias("places")).where(F.col("places") > max_line_docs).select(F.col("line").alias("often"))
    often = decisions(often, "often")
    places = saved(lines.join(often, lines["line"] == often["often"]).drop("often"), "places")
    held = places.select("line", "doc_id", F.when(F.col("doc_id").isNull(), F.col("key")).alias("text")).distinct()
    counted = held.groupBy("line").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))
    return saved(counted.where(F.col("docs") > max_line_docs).select(F.col("line").alias("frequent"), "first_doc"), "frequent"), places


def quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_line_docs: int = MAX_LINE_DOCS,
    min_left: float = MIN_LEFT,
    keep_first: bool = False,
) -> DataFrame:
    """A row for each row of `docs`: the base columns, words in removed lines, the verdict `kept`, and the places of the removed lines.

    A null text is an empty one: no words, so base_failed. Rows without host are a host of their own. Rows that repeat in id, host and
    text each give a row with the same values. Copies of a text under other ids are documents of their own; with `keep_first` the one
    with the smallest id keeps its lines. Other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    frequent, places = frequent_lines(saved(line_words(rows), "lines"), max_line_docs)
    frequent = bounded_broadcast(frequent, MAX_BROADCAST_DECISIONS)
    hit = places.join(frequent, places["line"] == frequent["frequent"])
    if keep_first:
        hit = hit.where(~F.coalesce(hit["doc_id"] == hit["first_doc"], F.lit(False)))
    # Rows that repeat have the same places: each place counts once.
    removed = hit.groupBy(F.col("key").alias("hit_key"), F.col("doc_id").alias("hit_doc")).agg(F.sort_array(F.collect_set(F.struct("pos", "n"))).alias("at"))
    removed = removed.select("hit_key", "hit_doc", F.aggregate("at", F.lit(0), lambda s, x: s + x["n"]).alias("removed"), F.transform("at", lambda x: x["pos"]).alias("removed_lines"))
    base = base_measures(rows)
    out = base.join(removed, (base["key"] == removed["hit_key"]) & base["doc_id"].eqNullSafe(removed["hit_doc"]), "left")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed_words"),
        (~F.col("base_failed") & (F.coalesce("removed", F.lit(0)) <= (1 - min_left) * F.col("n_words"))).alias("kept"),
        F.col("key").alias("row_key"),
        "removed_lines",
    )


def without_lines(text: Column, places: Column) -> Column:
    """`text` without its lines at the rising `places` (from 0); what lies between two places stays as it is."""

    def between(lines: Column, ends: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(ends) - 1), lambda k: F.slice(lines, ends[k - 1] + 2, ends[k] - ends[k - 1] - 1)))

    def joined(lines: Column) -> Column:
        return F.array_join(let(F.concat(F.array(F.lit(-1)), places, F.array(F.size(lines))), lambda ends: between(lines, ends)), "\n")

    return let(F.split(text, "\n"), joined)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The rows of `docs` that `quality` keeps, without their removed lines, and `length_col` counted again where the text changed.

    Rows that lose no line keep their text as it is. Nulls, repeats and empty tables are as in `quality`; an empty or null text goes.
    """
    found = quality(docs, id_col, text_col, host_col, **options).where("not kept or removed_lines is not null")
    found = found.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), F.col("kept").alias("__kept"), F.when(F.col("kept"), F.col("removed_lines")).alias("__places"))
    # A row holds its places too, of four bytes each.
    found = decisions(found.dropDuplicates(["__id", "__key"]), "rejected", MAX_BROADCAST_DECISIONS, 1 + F.coalesce(F.size("__places"), F.lit(0)) / 8)
    text = docs[text_col].cast("string")
    key = row_key(docs[id_col].cast("long"), docs[host_col].cast("string"), F.coalesce(text, F.lit("")))
    joined = docs.join(found, (key == found["__key"]) & docs[id_col].cast("long").eqNullSafe(found["__id"]), "left")
    joined = joined.where(F.coalesce(found["__kept"], F.lit(True)))
    places = found["__places"]
    clean = F.when(places.isNull(), text).otherwise(without_lines(text, places))
    kept = {c: docs[c] for c in docs.columns} | {text_col: clean}
    if length_col and length_col in docs.columns:
        kept[length_col] = F.when(places.isNull(), docs[length_col]).otherwise(F.length(clean).cast(docs.schema[length_col].dataType))
    return joined.select(*[c.alias(n) for n, c in kept.items()])
