"""Languages by interpolated Kneser-Ney character models.

Words (runs of letters, in lower case) begin and end at a boundary. Every character of a word is predicted from up to ORDER - 1 characters
before it. Counts come from all training texts: a batch counts its words, then the grams of its different words; Spark adds them up. Lower
orders count how many different characters a gram is seen after, but grams at a word's beginning, which nothing precedes, count their places.
Discounts are n1 / (n1 + 2 n2) of their order.

A model holds the grams whose share of their language's places isn't below a bound that follows from MAX_ENTRIES, so its size is bounded
however much text is counted; a history's weight for the order below is what its grams in the model leave of 1. Grams and histories are sorted
arrays of 64-bit hashes. A text belongs to the language of the least cross-entropy per character. How sure that is, is calibrated on pieces of
texts that no model counted; texts that are surer wrong than right, or further from their language than nearly all calibration pieces,
are marked as rejected.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, saved

ORDER = 5
#: Grams of all languages' models together, at most, and texts to calibrate on (the first in the order of a hash; no model counts them).
MAX_ENTRIES, MAX_CALIBRATION_ROWS = 1 << 21, 4_000
#: Different words that a task counts before it hands them on, and calibration pieces of a text, in words.
HELD_WORDS, PIECES = 200_000, (1, 2, 3, 5, 8, 13, 21, 55)
#: Different words whose places are looked at together, and rows whose different words are.
WORDS_AT_ONCE, ROWS_AT_ONCE = 25_000, 2_500
#: Share of right calibration pieces whose cross-entropy a language accepts.
ACCEPTED_SHARE = 0.999
NONE = "und"
BOUNDARY = "\x02"
_LETTERS = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(w.isalpha() or any(map(str.isalpha, w)) for w in words)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


# Grams ------------------------------------------------------------------------------------------------------------------------------


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of bounded words, each place's distance from its word's beginning, and the word of each place."""
    text = "".join(f"{BOUNDARY}{w}{BOUNDARY}" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(size) - size
    return codes, np.arange(len(codes)) - np.repeat(start, size), np.repeat(np.arange(len(words)), size)


def _hashes(codes: np.ndarray, inside: np.ndarray) -> list[np.ndarray]:
    """For each order n from 0 the hash of the n characters up to and with each place; 0 where the word has fewer."""
    out = [np.zeros(len(codes), np.uint64)]
    with np.errstate(over="ignore"):
        spread = (codes + np.uint64(1)) * _MIX
        spread ^= spread >> np.uint64(29)
        weight = np.uint64(1)
        for n in range(1, ORDER + 1):
            moved = np.concatenate([np.zeros(n - 1, np.uint64), spread[: len(spread) - n + 1]]) if n <= len(spread) else np.zeros(len(spread), np.uint64)
            out.append(out[-1] + moved * weight + np.uint64(n == 1))
            weight *= np.uint64(0xD6E8FEB86659FD93)
        for n in range(1, ORDER + 1):
            out[n][inside < n - 1] = 0
    return out


def gram_hashes(grams: list[str]) -> np.ndarray:
    """The hash of each gram, as `_hashes` has it at the gram's last place."""
    out = np.zeros(len(grams), np.uint64)
    size = np.fromiter(map(len, grams), np.int64, len(grams))
    for n in range(1, ORDER + 1):
        own = np.flatnonzero(size == n)
        if len(own):
            codes = np.frombuffer("".join(grams[i] for i in own).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            out[own] = _hashes(codes, np.tile(np.arange(n), len(own)))[n][n - 1 :: n]
    return out


def _longest(hashes: list[np.ndarray], size: np.ndarray, places: np.ndarray) -> np.ndarray:
    out = hashes[ORDER][places]
    for n in range(2, ORDER):
        own = size == n
        out[own] = hashes[n][places[own]]
    return out


def longest_grams(words: dict[str, int]) -> Iterator[tuple[str, int]]:
    """Every place's longest gram (ORDER characters, or from the word's beginning on) with the number of its places; a gram may come again."""
    every = list(words)
    for k in range(0, len(every), WORDS_AT_ONCE):
        yield from _longest_grams(every[k : k + WORDS_AT_ONCE], words)


def _longest_grams(kinds: list[str], words: dict[str, int]) -> Iterator[tuple[str, int]]:
    codes, inside, of = _codes(kinds)
    text = "".join(f"{BOUNDARY}{w}{BOUNDARY}" for w in kinds)
    hashes = _hashes(codes, inside)
    places = np.flatnonzero(inside > 0)
    size = np.minimum(inside[places] + 1, ORDER)
    _, first, which = np.unique(_longest(hashes, size, places), return_index=True, return_inverse=True)
    total = np.bincount(which, np.fromiter(map(words.__getitem__, kinds), np.float64, len(kinds))[of[places]])
    for k, n in zip(first.tolist(), total.tolist(), strict=True):
        end = int(places[k]) + 1
        yield text[end - int(size[k]) : end], int(n)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of texts (lang, text), longest grams only."""
    held: defaultdict[str, Counter] = defaultdict(Counter)

    def counted() -> Iterator[pa.RecordBatch]:
        for lang, words in held.items():
            rows = list(longest_grams(words))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array([g for g, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["lang", "gram", "n"])

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            held[lang].update(words_of(text.as_py() or ""))
        if sum(map(len, held.values())) > HELD_WORDS:
            yield from counted()
            held.clear()
    yield from counted()


def kneser_ney(longest: DataFrame, max_entries: int = MAX_ENTRIES, order: int = ORDER) -> DataFrame:
    """(lang, gram, p, history): each gram of the model with its discounted probability after its history, for histories what is left of 1.

    longest(lang, gram, n): the counts of longest grams. Rows with `history` carry a history's weight for the order below instead.
    """
    every = longest.select("lang", "gram", "n", F.explode(F.sequence(F.lit(1), F.length("gram"))).alias("size")).select("lang", F.expr("right(gram, size)").alias("gram"), "n")
    places = saved(every.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("size", F.length("gram")), "language-grams")
    before = places.where("size > 1").groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("before"))
    free = (F.col("size") < order) & ~F.col("gram").startswith(BOUNDARY)
    types = places.join(before, ["lang", "gram"], "left").select("lang", "gram", "n", "size", F.when(free, F.coalesce("before", F.lit(0))).otherwise(F.col("n")).alias("a"), F.expr("left(gram, size - 1)").alias("history"))
    types = saved(types, "language-types")
    few = types.groupBy("lang", "size").agg(F.count_if(F.col("a") == 1).alias("n1"), F.count_if(F.col("a") == 2).alias("n2"))
    few = few.select("lang", "size", F.when(F.col("n1") * F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5).alias("d"))  # orders x languages rows
    least = places.where("size = 1").groupBy("lang").agg(F.sum("n").alias("all_places"))
    languages = max(1, least.count())
    least = least.select("lang", F.ceil(F.col("all_places") * (languages * order) / max_entries).alias("least"))
    after = types.groupBy("lang", "history").agg(F.sum("a").alias("total"))
    kept = types.join(F.broadcast(least), "lang").where("n >= least").join(F.broadcast(few), ["lang", "size"]).join(after, ["lang", "history"])
    kept = saved(kept.select("lang", "gram", "history", (F.greatest(F.col("a") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("p")).where("p > 0"), "language-kept")
    left = kept.groupBy("lang", F.col("history").alias("gram")).agg(F.greatest(1 - F.sum("p"), F.lit(1e-9)).alias("p"))
    out = saved(kept.select("lang", "gram", "p", F.lit(False).alias("history")).unionByName(left.select("lang", "gram", "p", F.lit(True).alias("history"))), "language-model")
    for t in (places, types, kept):
        forget(t)
    return out


# Models -----------------------------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Sorted hashes of grams with their probabilities, and of histories with their weights."""

    grams: np.ndarray
    p: np.ndarray
    histories: np.ndarray
    left: np.ndarray

    @classmethod
    def of(cls, grams: list[str], p: np.ndarray, history: np.ndarray) -> Model:
        hashes = gram_hashes(grams)
        out = []
        for side in (~history, history):
            order = np.argsort(hashes[side])
            out += [hashes[side][order], p[side][order]]
        return cls(*out)

    @staticmethod
    def _find(hashes: np.ndarray, values: np.ndarray, asked: np.ndarray, default: float) -> np.ndarray:
        if not len(hashes):
            return np.full(len(asked), default)
        at = np.minimum(np.searchsorted(hashes, asked), len(hashes) - 1)
        return np.where(hashes[at] == asked, values[at], default)

    def log2_p(self, grams: list[np.ndarray], histories: list[np.ndarray], floor: float) -> np.ndarray:
        """Of places with their hashes by order, 0 where the word has none: log2 of the interpolated probability."""
        p = np.full(len(grams[0]), floor)
        for n in range(1, ORDER + 1):
            there = grams[n] != 0
            left = self._find(self.histories, self.left, histories[n - 1], 1.0)
            p = np.where(there, self._find(self.grams, self.p, grams[n], 0.0) + left * p, p)
        return np.log2(p)


def cross_entropies(models: list[Model], words: list[str], floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each word under each model (words x models), and its predicted characters."""
    parts = [_cross_entropies(models, words[k : k + WORDS_AT_ONCE], floor) for k in range(0, len(words), WORDS_AT_ONCE)]
    return (np.concatenate([b for b, _ in parts]), np.concatenate([n for _, n in parts])) if parts else (np.zeros((0, len(models))), np.zeros(0, np.int64))


def _cross_entropies(models: list[Model], words: list[str], floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Places that share all that counts are looked up once."""
    codes, inside, of = _codes(words)
    hashes = _hashes(codes, inside)
    places = np.flatnonzero(inside > 0)
    size = np.minimum(inside[places] + 1, ORDER)
    _, first, which = np.unique(_longest(hashes, size, places), return_index=True, return_inverse=True)
    at = places[first]
    grams = [h[at] for h in hashes]
    histories = [h[at - 1] for h in hashes]
    starts = np.flatnonzero(np.diff(of[places], prepend=-1))
    bits = np.stack([-np.add.reduceat(m.log2_p(grams, histories, floor)[which], starts) for m in models], 1)
    return bits, np.diff(starts, append=len(places))


def _score(shared):
    """(.., bits of the best model, its lead over the next, characters, which) for rows (.., text); the text goes. No letter: nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, floor = shared.value
        for b in (whole.slice(k, ROWS_AT_ONCE) for whole in batches for k in range(0, max(1, whole.num_rows), ROWS_AT_ONCE)):
            number: defaultdict[str, int] = defaultdict(count().__next__)
            texts = []
            for text in b.column(b.num_columns - 1):
                words = words_of(text.as_py() or "")
                words = words if has_letter(words) else []
                texts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            bits, chars = cross_entropies(models, list(number), floor)
            rows: list[tuple] = []
            for words in texts:
                n = int(chars[words].sum())
                if not n:
                    rows.append((None, None, 0, None))
                    continue
                each = bits[words].sum(0) / n
                best = int(each.argmin())
                rest = np.delete(each, best)
                rows.append((float(each[best]), float(rest.min() - each[best]) if len(rest) else 99.0, n, best))
            kinds = (pa.float64(), pa.float64(), pa.int64(), pa.int32())
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*b.schema.names[:-1], "entropy", "lead", "chars", "best"])

    return run


SCORED = "entropy double, lead double, chars long, best int"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of PIECES words from the middle of each text, and the text."""
    for b in batches:
        langs, out = [], []
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = words_of(text or "")
            cut = [words] + [words[len(words) // 2 :][:n] for n in PIECES if n < len(words) // 2]
            out += [" ".join(w) for w in cut]
            langs += [lang] * len(cut)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.string())], names=["lang", "text"])


class LanguageId:
    """Fitted models. `fit` counts all training texts; `predict` gives each row of any table a language."""

    def __init__(self, spark, langs: list[str], models: list[Model], floor: float, sure, ceilings: list[float]):
        self.spark, self.langs, self.models, self.floor, self.sure, self.ceilings = spark, langs, models, floor, sure, ceilings
        self.shared = spark.sparkContext.broadcast((models, floor))  # MAX_ENTRIES grams and as many histories at most

    @classmethod
    def fit(cls, docs: DataFrame, max_entries: int = MAX_ENTRIES, max_calibration_rows: int = MAX_CALIBRATION_ROWS) -> LanguageId:
        """docs(doc_id, lang, text). A training row has an id that isn't held out, a text and a language."""
        spark = docs.sparkSession
        rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
        turn = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(1 << 40))
        n = rows.count()
        # One row in 20, or as many as are allowed: a share of the hash's range, so no order over all rows is needed.
        bound = int((1 << 40) * min(0.05, max_calibration_rows / max(1, n)))
        grams = rows.where(turn >= bound).select("lang", "text").mapInArrow(_count_grams, "lang string, gram string, n long")
        model = kneser_ney(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), max_entries)
        table = model.toArrow()
        forget(model)
        lang, gram = np.array(table["lang"].to_pylist(), object), table["gram"].to_pylist()
        p, history = table["p"].to_numpy(), table["history"].to_numpy(zero_copy_only=False)
        langs = sorted(set(lang.tolist()))
        models = [Model.of([gram[i] for i in own], p[own], history[own]) for own in (np.flatnonzero(lang == x) for x in langs)]
        floor = 1.0 / (1 + len({g for g, h in zip(gram, history, strict=True) if len(g) == 1 and not h}))
        out = cls(spark, langs, models, floor, None, [float("inf")] * len(langs))
        if langs:
            out._calibrate(rows.where(turn < bound).select("lang", "text"))
        return out

    def _calibrate(self, rows: DataFrame) -> None:
        """Fits how often a lead is right, and each language's ceiling of cross-entropy, on pieces of texts."""
        found = rows.mapInArrow(_pieces, "lang string, text string").mapInArrow(_score(self.shared), f"lang string, {SCORED}").where("best is not null").toPandas()
        right = (found["lang"] == found["best"].map(dict(enumerate(self.langs)))).to_numpy()
        if len(found):
            self.sure = fit_steps(evidence(found["lead"].to_numpy(), found["chars"].to_numpy()), right)
        for k in range(len(self.langs)):
            own = found["entropy"][right & (found["best"] == k)]
            if len(own):
                self.ceilings[k] = float(own.quantile(ACCEPTED_SHARE))

    def predict(self, docs: DataFrame) -> DataFrame:
        """docs(.., text) without its text, and lang_pred, score, entropy, rejected."""
        kept = [c for c in docs.columns if c != "text"]
        if not self.langs:
            return docs.select(*kept, F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected"))
        schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
        out = docs.select(*kept, "text").mapInArrow(_score(self.shared), f"{schema}, {SCORED}")
        names, ceilings = F.array(*map(F.lit, self.langs)), F.array(*[F.lit(c) for c in self.ceilings])
        score = steps(F.col("lead") * F.sqrt("chars"), self.sure)
        out = out.withColumn("s", F.when(F.col("best").isNull(), 0.0).otherwise(score))
        far = F.col("entropy") > F.get(ceilings, F.col("best"))
        return out.select(*kept, F.coalesce(F.get(names, F.col("best")), F.lit(NONE)).alias("lang_pred"), F.col("s").alias("score"), "entropy", (F.col("best").isNull() | (F.col("s") < 0.5) | far).alias("rejected"))


def evidence(lead: np.ndarray, chars: np.ndarray) -> np.ndarray:
    return lead * np.sqrt(chars)


def fit_steps(x: np.ndarray, right: np.ndarray, bins: int = 32) -> list[tuple[float, float]]:
    """(x, share right) at rising x and shares: means of bins of equal size, merged while one falls (isotonic regression), one right and one
    wrong piece added to each."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of x, rows, right
    for part in np.array_split(order, min(bins, len(order))):
        blocks.append([float(x[part].sum()), len(part), float(right[part].sum())])
        while len(blocks) > 1 and (blocks[-2][2] + 1) / (blocks[-2][1] + 2) >= (blocks[-1][2] + 1) / (blocks[-1][1] + 2):
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return [(a / n, (r + 1) / (n + 2)) for a, n, r in blocks]


def steps(x: Column, points: list[tuple[float, float]] | None) -> Column:
    """Between the points a straight line; before the first from (0, 0) and beyond the last towards 1, so that more evidence is never less sure."""
    if not points:
        return x / (1 + x)
    (x0, y0), (xn, yn) = points[0], points[-1]
    out = F.when(x <= x0, F.lit(y0) * x / max(x0, 1e-9))
    for (a, ya), (b, yb) in zip(points, points[1:], strict=False):
        out = out.when(x <= b, ya + (yb - ya) * (x - a) / max(b - a, 1e-9))
    return out.otherwise(yn + (1 - yn) * (x - xn) / (1 + x - xn))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, entropy, rejected), a row for each row of `docs`.

    A text that is null or has no letter is `und` with score 0, and rejected. A null id isn't held out and is never learnt from; rows without
    a language are predicted only. Repeated rows each give a row and each count. Texts that fit two languages equally well get the first in
    the order of their names. Texts are read whole whatever their length. Without training rows every row is `und`; an empty table gives no
    rows. Extra columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    found = LanguageId.fit(rows).predict(rows.select("doc_id", "text"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
