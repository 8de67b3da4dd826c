"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words and word beginnings is mined from the training texts by smoothed log odds. The features of a text are densities of the
lexicon, its nearness to the second person, and rates of capitals, punctuation, repeats and disguised letters; nothing else goes in.
The trees are fitted on one part of the training rows and calibrated on the other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Labelled rows that the classifier learns from at most (the first in the order of a hash). They bound the lexicons too.
MAX_TRAINING_ROWS = 12_000
#: A lexicon entry needs this many toxic texts and this log odds.
MIN_TOXIC_TEXTS, MIN_LOG_ODDS = 4, 1.6
STEMS = (4, 5, 6, 7, 8)
THRESHOLD = 0.7
TREES, DEPTH, SEED = 24, 4, 17
#: Second persons of the languages at hand, and letters that others often stand for. Fixed values.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch usted ustedes ti tus vuestro".split())
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
FEATURES = (
    "words", "lexicon_density", "lexicon_weight", "lexicon_distinct", "lexicon_most", "stem_density", "stem_weight", "stem_distinct",
    "second_person", "second_person_near", "capitals", "capital_words", "exclamations", "questions", "punctuation", "disguised", "disguised_hits", "repeats",
)
_WORD = re.compile(r"[^\W_]+")
_SIGN, _LETTER = re.compile("[0-9@$!]"), re.compile("[a-z]")
_REPEAT = re.compile(r"([^\W\d_])\1\1")
_PUNCT = re.compile(r"[^\w\s]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_UPPER_WORD = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b")

Lexicon = dict[str, float]


def terms(text: str) -> set[str]:
    """The different words of a text, and beginnings of longer words, which end in a star."""
    words = set(_WORD.findall(text.lower()))
    return words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k}


def features(text: str, words_lexicon: Lexicon, stems_lexicon: Lexicon, firsts: frozenset[str]) -> list[float]:
    """FEATURES of a text. firsts: the first four letters of each beginning in `stems_lexicon`."""
    low = text.lower()
    words = _WORD.findall(low)
    n, chars = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    hits = {w: c for w, c in counts.items() if w in words_lexicon}
    total = sum(hits.values())
    stem_total, stem_weight, stem_kinds = 0, 0.0, 0
    for w, c in counts.items():
        if w[:4] in firsts:
            best = max((stems_lexicon.get(f"{w[:k]}*", 0.0) for k in STEMS if len(w) > k), default=0.0)
            if best:
                stem_total, stem_weight, stem_kinds = stem_total + c, stem_weight + best * c, stem_kinds + 1
    second = sum(c for w, c in counts.items() if w in SECOND_PERSON)
    near = 0
    if hits and second:
        last = -99
        for i, w in enumerate(words):
            if w in SECOND_PERSON:
                last = i
            elif w in hits and i - last <= 5:
                near += 1
    # Words that mix letters with digits or signs inside; white space cuts them, so a long text costs time in proportion.
    mixed = [w for x in low.split() if not x.isalpha() and _SIGN.search(w := x.strip(".,;:!?\"'()")) and _LETTER.search(w)]
    return [
        float(n), total / n, sum(words_lexicon[w] * c for w, c in hits.items()) / n, float(len(hits)), max(hits.values(), default=0) / n,
        stem_total / n, stem_weight / n, float(stem_kinds),
        second / n, near / n, len(_UPPER.findall(text)) / chars, len(_UPPER_WORD.findall(text)) / n, text.count("!") / n, text.count("?") / n, len(_PUNCT.findall(text)) / chars,
        len(mixed) / n, sum(w.translate(DISGUISES) in words_lexicon for w in mixed) / n, len(_REPEAT.findall(low)) / n,
    ]


def _arrow_features(words_lexicon: Lexicon, stems_lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = frozenset(s[:4] for s in stems_lexicon)
        for b in batches:
            rows = [features(t.as_py() or "", words_lexicon, stems_lexicon, firsts) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "features"])

    return run


def _arrow_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        toxic, out = [], []
        for y, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            found = list(terms(t.as_py() or ""))
            out += found
            toxic += [y] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(toxic, pa.int32())], names=["term", "toxic"])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(doc_id, toxic) of at most `max_rows` labelled rows that aren't held out; contradicting labels of an id don't count."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    rows = rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    return rows.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def mine_lexicon(texts: DataFrame) -> tuple[Lexicon, Lexicon]:
    """All words and beginnings that the toxic of `texts` (toxic, text) hold far more often than the others: as many as a sample of
    MAX_TRAINING_ROWS texts can have."""
    n = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    odds = F.log((F.col("t") + 0.5) / F.lit(n.get(1, 0) + 1.0)) - F.log((F.col("o") + 0.5) / F.lit(n.get(0, 0) + 1.0))
    counts = texts.select("toxic", "text").mapInArrow(_arrow_terms, "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    best = counts.where(F.col("t") >= MIN_TOXIC_TEXTS).withColumn("w", odds).where(F.col("w") >= MIN_LOG_ODDS)
    found = {r["term"]: r["w"] for r in best.select("term", "w").collect()}
    stems = {t: w for t, w in found.items() if t.endswith("*")}
    return {t: w for t, w in found.items() if t not in stems}, stems


class Toxicity:
    """A fitted scorer. `fit` reads at most `max_rows` labelled rows; `score` gives each row of any table a score of 0 to 1."""

    def __init__(self, lexicons: tuple[Lexicon, Lexicon], trees, calibration):
        self.lexicons, self.trees, self.calibration = lexicons, trees, calibration

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Toxicity:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        sample = saved(training_rows(labels, max_rows).coalesce(1), "toxicity-sample")  # at most max_rows rows of two numbers: it may be broadcast
        texts = rows.join(F.broadcast(sample), "doc_id").select("toxic", "text", "doc_id")
        texts = saved(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity-texts")  # of texts that share an id the least
        lexicons = mine_lexicon(texts)
        data = texts.select("doc_id", "text").mapInArrow(_arrow_features(*lexicons), "doc_id long, features array<double>").join(F.broadcast(sample), "doc_id")
        data = saved(data.select(array_to_vector("features").alias("features"), F.col("toxic").cast("double").alias("label"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("calibrate")).coalesce(4), "toxicity-features")
        if {r["label"] for r in data.where("not calibrate").select("label").distinct().collect()} != {0.0, 1.0}:
            return cls(lexicons, None, None)
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=SEED, minInstancesPerNode=5, subsamplingRate=1.0, checkpointInterval=-1).fit(data.where("not calibrate"))
        margin = trees.transform(data.where("calibrate")).select("label", vector_to_array("probability")[1].alias("p"))
        return cls(lexicons, trees, IsotonicRegression(featuresCol="p").fit(margin))

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, score): a row for each row; without both labels in training every score is 0."""
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        data = rows.mapInArrow(_arrow_features(*self.lexicons), "doc_id long, features array<double>")
        if self.trees is None:
            return data.select("doc_id", F.lit(0.0).alias("score"))
        raw = self.trees.transform(data.select("doc_id", array_to_vector("features").alias("features"))).select("doc_id", vector_to_array("probability")[1].alias("p"))
        # Isotonic steps tie: a thousandth of the trees' own probability keeps the order within a step.
        stepped = self.calibration.transform(raw).select("doc_id", (F.col("prediction") * 0.999 + F.col("p") * 0.001).alias("score"))
        return stepped.select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs`. A null text is an empty one and is scored as such; a null id isn't held out.

    Repeated rows each give a row with the same score; of different texts under one labelled id the least is learnt from. Labels of an id
    that contradict each other don't count. Without documents there are no rows, without labels every score is 0. Texts of any length are
    read whole. Texts on one step of the calibration are told apart by the trees' own probability; equal features have equal scores. Extra
    columns are ignored, whatever their names.
    """
    scored = Toxicity.fit(docs, labels).score(docs)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
