"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A spaced seed is a fixed mask over a window of words: it hashes the words it selects and ignores the others, so a substituted word at an
ignored place leaves the hash as it was. The hashes of all windows of the documents meet those of the benchmark. Only hashes and places
move; words are fetched for hits alone. Of each diagonal (place in the document less place in the item) with a hit all words are compared, and
every part of it is judged, so substitutions cost their own place only and no passage hides another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, decisions, row_key, saved

#: Places that each mask selects in a window of SPAN words. Of random sets these find most regions with a fifth of the words replaced.
SPAN = 12
MASKS = ((0, 1, 3, 7, 9, 10, 11), (0, 1, 2, 4, 9, 10, 11), (0, 5, 6, 7, 8, 10, 11), (0, 2, 3, 4, 7, 8, 11))
#: Words that must agree along a diagonal, and their least share of the stretch from the first to the last of them.
MIN_MATCHED, MIN_IDENTITY = 12, 0.7
#: Rows of the benchmark's seeds (four for each word) up to which they are broadcast with their places; ten times as many are broadcast
#: as bare hashes, so that only hits are shuffled; beyond, all seeds are.
MAX_BROADCAST_ROWS = 400_000


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text: runs of letters and digits, lowered; anything else separates."""
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def windows(rows: DataFrame, keys: list[str], span: int = SPAN) -> DataFrame:
    """`keys`, the place `pos` and the words w0.. of each window of `span` words of column `words`."""
    n = F.size("words") - (span - 1)
    shifted = [F.slice("words", F.lit(k + 1), n).alias(f"w{k}") for k in range(span)]
    long_enough = rows.where(F.size("words") >= span)
    out = long_enough.select(*keys, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "w"))
    return out.select(*keys, "pos", *[F.col("w")[f"w{k}"].alias(f"w{k}") for k in range(span)])


def seeds(rows: DataFrame, masks: tuple[tuple[int, ...], ...] = MASKS) -> DataFrame:
    """A row for each window and mask, with the hash of the words selected."""
    return rows.withColumn("seed", F.explode(F.array(*[F.xxhash64(F.lit(m), *[F.col(f"w{k}") for k in mask]) for m, mask in enumerate(masks)])))


def words_of(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, row_key) of the documents; (item_id, words, item_key) of the different items long enough for a seed."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), word_hashes(F.col(item_text_col).cast("string")).alias("words"))
    return source.withColumn("row_key", row_key(F.col("doc_id"), F.col("text"))), items.where(F.size("words") >= SPAN).withColumn("item_key", F.xxhash64("words")).distinct()


def seed_hits(source: DataFrame, items: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """(doc_id, row_key, pos, item_id, item_key, item_pos): windows of a document and of an item that some mask finds equal, once for each mask."""
    rows = source.select("doc_id", "row_key", word_hashes(F.col("text")).alias("words"))
    mine = seeds(windows(rows, ["doc_id", "row_key"])).select("seed", "doc_id", "row_key", "pos")
    theirs = saved(seeds(windows(items, ["item_id", "item_key"])).select("seed", "item_id", "item_key", F.col("pos").alias("item_pos")), "item-seeds")
    if theirs.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        return mine.join(F.broadcast(theirs), "seed").drop("seed")
    known = bounded_broadcast(theirs.select("seed").distinct(), 10 * max_broadcast_rows)
    return mine.join(known, "seed", "left_semi").join(theirs, "seed").drop("seed")


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_matched: int = MIN_MATCHED,
    min_identity: float = MIN_IDENTITY,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """(doc_id, item_id, diagonal, last_word, row_key): words of a document at which a stretch that a benchmark item holds ends.

    Where a seed hits, the whole diagonal is read: every agreeing word counts, also between and beside the hits. A stretch is any part of it
    from one agreeing word to another with `min_matched` agreeing words and `min_identity` of its length (in whole percent), so what else
    agrees on the diagonal can't undo one.

    Null and empty texts, and texts and items of fewer than SPAN words, match nothing; texts of any length are read whole. Items that repeat
    a row count once, and so do documents that repeat in id and text; null ids stay null. With either table empty there are no rows. Extra
    columns are ignored, whatever their names.
    """
    source, items = words_of(docs, benchmark, id_col, text_col, item_col, item_text_col)
    hits = seed_hits(source, items, max_broadcast_rows)
    hits = hits.select("doc_id", "row_key", "item_id", "item_key", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    diagonals = ["doc_id", "row_key", "item_id", "item_key", "diagonal"]
    hit = decisions(hits.select(*[F.col(c).alias(f"hit_{c}") for c in diagonals]), "diagonals", max_broadcast_rows)
    read = source.join(hit, (source["row_key"] == hit["hit_row_key"]) & source["doc_id"].eqNullSafe(hit["hit_doc_id"]))
    read = read.select("text", *[F.col(f"hit_{c}").alias(c) for c in diagonals])
    theirs = bounded_broadcast(items.select(F.col("item_id").alias("their_id"), F.col("item_key").alias("their_key"), F.col("words").alias("theirs")), max_broadcast_rows // SPAN)
    both = read.join(theirs, (read["item_key"] == theirs["their_key"]) & read["item_id"].eqNullSafe(theirs["their_id"]))
    first = F.greatest(F.col("diagonal"), F.lit(0))
    n = F.least(F.size("words") - first, F.size("theirs") - (first - F.col("diagonal")))
    pairs = F.arrays_zip(F.slice("words", first + 1, n).alias("a"), F.slice("theirs", first - F.col("diagonal") + 1, n).alias("b"))
    at = both.withColumn("words", word_hashes(F.col("text"))).select(*diagonals, first.alias("first"), F.posexplode(pairs).alias("k", "w"))
    at = at.where("w.a = w.b").select(*diagonals, (F.col("first") + F.col("k")).alias("at")).distinct()
    # The k-th agreeing word lies at p: from word a to word b there are k_b - k_a + 1 of p_b - p_a + 1, a share of at least x if
    # k - x p has not fallen by more than 1 - x. Of the words far enough back, the one where it is least decides.
    percent = round(100 * min_identity)
    along = Window.partitionBy(*diagonals).orderBy("at")
    scored = at.withColumn("level", 100 * F.row_number().over(along) - percent * F.col("at"))
    least = F.min("level").over(along.rowsBetween(Window.unboundedPreceding, 1 - min_matched))
    ends = scored.withColumn("least", least).where(F.col("level") - F.col("least") + (100 - percent) >= 0)
    return ends.select("doc_id", "item_id", "diagonal", F.col("at").cast("long").alias("last_word"), "row_key")


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, n_diagonals, n_ends): for each document and item that overlap, the diagonals with a stretch, and the words at which
    one ends. Rows as in `overlaps`."""
    found = overlaps(docs, benchmark, **options).groupBy("doc_id", "item_id", "diagonal").agg(F.count("*").alias("n"))
    return found.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_diagonals"), F.sum("n").alias("n_ends"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that hold no stretch of a benchmark item. Rows that repeat stay or go together."""
    bad = overlaps(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias("__bad_id"), F.col("row_key").alias("__bad_key")).distinct()
    bad = decisions(bad, "contaminated")
    key = row_key(docs[id_col].cast("long"), docs[text_col].cast("string"))
    return docs.join(bad, (key == bad["__bad_key"]) & docs[id_col].cast("long").eqNullSafe(bad["__bad_id"]), "left_anti")
