"""Column functions on reads: bases, qualities, primers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType

OFFSET = 33


def _sums(quals: pa.Array, table) -> pa.Array:
    """For each string the sum of `table` over its bytes: one vector operation for a batch. Null stays null, an empty string gives 0."""
    import numpy as np

    strings = quals.cast(pa.large_binary())
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = table[np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]] if len(strings) else table[:0]
    out = np.zeros(len(strings), table.dtype)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.add.reduceat(data, offsets[some] - offsets[0])
    return pa.array(out, mask=np.asarray(quals.is_null()))


# A lambda over the characters of a quality string costs five times as much as these, Arrow transfer included.
@F.arrow_udf(LongType())
def _symbol_sum(quals: pa.Array) -> pa.Array:
    import numpy as np

    return _sums(quals, np.arange(256, dtype=np.int64))


@F.arrow_udf(DoubleType())
def _error_sum(quals: pa.Array) -> pa.Array:
    """Of 10 ^ (-symbol / 10); the offset is a factor and comes later."""
    import numpy as np

    return _sums(quals, 10.0 ** (-np.arange(256) / 10.0))


def revcomp(seq: Column) -> Column:
    """Reverse complement in upper case; N stays N."""
    return F.reverse(F.translate(F.upper(seq), "ACGTN", "TGCAN"))


def mismatches(piece: Column, pattern: Column) -> Column:
    """Differing places of two strings of one length; an N of the pattern fits anything, an N of the piece only an N."""
    differs = lambda i: (F.substring(pattern, i, F.lit(1)) != "N") & (F.substring(pattern, i, F.lit(1)) != F.substring(piece, i, F.lit(1)))
    n = F.length(pattern)
    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), differs))).otherwise(0)


def hamming_leq(piece: Column, pattern: Column, k: int) -> Column:
    return (F.length(piece) == F.length(pattern)) & (mismatches(piece, pattern) <= k)


def hit_positions(window: Column, pattern: Column, k: int) -> Column:
    """1-based places of a window where a pattern fits with at most k mismatches; a pattern longer than the window has none."""
    last = F.length(window) - F.length(pattern) + 1
    fits = lambda i: mismatches(F.substring(window, i, F.length(pattern)), pattern) <= k
    return F.when((last >= 1) & (F.length(pattern) > 0), F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), fits)).otherwise(F.array().cast("array<int>"))


def find_pattern(window: Column, pattern: str, k: int, last: bool = False) -> Column:
    """1-based place of the first (or last) fit of a fixed pattern with at most k mismatches, null without one.

    A batch of windows is one byte matrix that is compared with the pattern a letter at a time, so the work is a vector operation for
    each letter and not a lambda for each place.
    """
    import numpy as np

    letters = np.frombuffer(pattern.encode(), np.uint8)

    @F.arrow_udf(IntegerType())
    def find(windows: pa.Array) -> pa.Array:
        texts = [(t or "").encode() for t in windows.to_pylist()]
        out: list[int | None] = []
        for start in range(0, len(texts), 4096):
            part = texts[start : start + 4096]
            width = max(map(len, part), default=0)
            places = width - len(letters) + 1
            if not len(letters) or places < 1:
                out += [None] * len(part)
                continue
            grid = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in part), np.uint8).reshape(len(part), width)
            wrong = np.zeros((len(part), places), np.uint8)
            for j, letter in enumerate(letters):
                if letter != ord("N"):
                    wrong += grid[:, j : j + places] != letter
            fits = (wrong <= k) & (np.arange(places) + len(letters) <= np.array([len(t) for t in part])[:, None])
            at = places - fits[:, ::-1].argmax(axis=1) if last else fits.argmax(axis=1) + 1
            out += [int(p) if ok else None for p, ok in zip(at, fits.any(axis=1), strict=True)]
        return pa.array(out, pa.int32())

    return find(window)


def primer_in_window(window: Column, primers: list[str], k: int) -> Column:
    """Whether any primer or its reverse complement lies in the window."""
    complement = str.maketrans("ACGTN", "TGCAN")
    found = F.lit(False)
    for p in primers:
        for pattern in (p, p[::-1].translate(complement)):
            found = found | find_pattern(F.upper(window), pattern, k).isNotNull()
    return found


def head_window(seq: Column, w: int) -> Column:
    return F.substring(seq, 1, w)


def tail_window(seq: Column, w: int) -> Column:
    """The last w bases, null if the read isn't longer than w: its head window covers it."""
    return F.when(F.length(seq) > w, F.substring(seq, -w, w))


def gc_count(seq: Column) -> Column:
    return F.length(seq) - F.length(F.translate(seq, "GCgc", ""))


def n_count(seq: Column) -> Column:
    return F.length(seq) - F.length(F.translate(seq, "Nn", ""))


def quality_sum(seq: Column, qual: Column, offset: int = OFFSET) -> Column:
    """Sum of Phred values over the places that have a base and a quality."""
    n = F.least(F.length(seq), F.length(qual))
    return _symbol_sum(F.substring(qual, F.lit(1), n)) - n * offset


def read_mean_q(seq: Column, qual: Column, offset: int = OFFSET) -> Column:
    """Arithmetic mean Phred of a read; null without a base or quality."""
    n = F.least(F.length(seq), F.length(qual))
    return quality_sum(seq, qual, offset) / F.when(n > 0, n)


def error_sum(qual: Column, offset: int = OFFSET) -> Column:
    """Sum of the error probabilities of a read's bases."""
    return _error_sum(qual) * 10.0 ** (offset / 10.0)


def phred_from_p(p: Column) -> Column:
    """Phred of an error probability, to two decimals; 60 for none."""
    return F.when(p > 0, F.round(-10 * F.log10(p), 2)).otherwise(60.0)


def pct_removed(before: Column, after: Column) -> Column:
    return F.when(before > 0, F.round((before - after) / before * 100, 2)).otherwise(0.0)


def pct_kept(before: Column, after: Column) -> Column:
    return F.when(before > 0, F.round(after / before * 100, 2)).otherwise(0.0)
