"""Order-preserving packing of tokenised documents into fixed windows by dynamic programming.

The documents of a partition form one stream of token ids in their stored order. Windows of at most `length` ids are cut out of the
stream one after another; cuts may fall after a document (no penalty), after a sentence, or, where a sentence is longer than a window,
after any id. A cut costs the padding of the window it ends plus the penalty of its kind. With P the ids before a boundary,
best(j) = min over i in reach of best(i) + padding(P_j - P_i) + penalty(j); as padding is length - (P_j - P_i) but for powers of two, the
first part needs the least best(i) + P_i among the boundaries in reach, which a monotone queue holds; powers of two, which don't pad, are all looked up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 1024
#: Ids of padding that a cut inside a document is worth: after a sentence, and inside one.
SENTENCE_COST, SPLIT_COST = 12, 48
#: Ids that one run of the dynamic programme holds; a longer document makes a longer run. The windows at its end are cut again in the next.
BLOCK_IDS, AGAIN = 500_000, 64
#: The published pattern of the vocabulary, with possessive repeats, which match alike and need no way back. Fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer(path: str):
    """The ids of the byte-level BPE vocabulary at `path` (tokenizers' JSON), as an encoder and each id's bytes.

    tiktoken stands in for tokenizers, with the same ids: the file's added tokens are found inside texts too. Those with options that
    tiktoken doesn't know are refused.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    vocab, added = data["model"]["vocab"], data["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("an added token takes more or less than its own characters")
    special = {t["content"]: t["id"] for t in added}
    # A byte-level vocabulary spells each byte as a printable character: those that print as themselves, the others from U+0100 on.
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelt = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    ranks = {bytes(spelt[c] for c in word): i for word, i in vocab.items() if word not in special}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), {i: w for w, i in ranks.items()} | {i: t.encode() for t, i in special.items()}


def cuts(bounds, costs, length: int = LENGTH) -> list[int]:
    """The boundaries of least cost. bounds: rising positions from 0 to the end; costs: the penalty of a cut at each.

    No gap between neighbouring bounds may exceed `length`.
    """
    n = len(bounds)
    best, back = [0] * n, [0] * n
    at = {p: i for i, p in enumerate(bounds)}
    keys, held, head = [0], [0], 0  # the monotone queue: best + position, rising, and the boundary of each
    powers = [1 << k for k in range(length.bit_length()) if 1 << k < length]
    for j in range(1, n):
        p = bounds[j]
        low = p - length
        while bounds[held[head]] < low:
            head += 1
        i = held[head]
        value = keys[head] + length - p
        for w in powers:  # those don't pad, wherever their best stands in the queue
            k = at.get(p - w)
            if k is not None and best[k] < value:
                value, i = best[k], k
        best[j] = value = value + costs[j]
        back[j] = i
        value += p
        while len(keys) > head and keys[-1] >= value:
            keys.pop()
            held.pop()
        keys.append(value)
        held.append(j)
    out, j = [n - 1], n - 1
    while j:
        j = back[j]
        out.append(j)
    return [bounds[j] for j in reversed(out)]


def boundaries(ids, doc_ends, ends_sentence, length: int = LENGTH, sentence_cost: int = SENTENCE_COST, split_cost: int = SPLIT_COST):
    """(positions, costs): where windows may be cut, and the penalty of each."""
    import numpy as np

    cost = np.full(len(ids) + 1, -1, np.int32)
    cost[1:][ends_sentence[ids]] = sentence_cost
    cost[doc_ends] = 0
    cost[0] = 0
    pos = np.flatnonzero(cost >= 0)
    gaps = np.diff(pos)
    for k in np.flatnonzero(gaps > length).tolist():  # no sentence ends for a whole window: any id may end it
        cost[pos[k] + 1 : pos[k + 1]] = split_cost
    pos = np.flatnonzero(cost >= 0)
    return pos.tolist(), cost[pos].tolist()


def _packer(path: str, length: int, sentence_cost: int, split_cost: int, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        encoder, words = tokenizer(path)
        ends = np.zeros(max(words) + 2, bool)
        for i, w in words.items():
            ends[i] = w.rstrip(b" \n\r\t")[-1:] in (b".", b"!", b"?") or b"\n" in w
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, np.ndarray, int]] = []  # document, its ids, and how many of them lie in windows already given
        size, due = 0, block_ids

        def emit(last: bool) -> pa.RecordBatch:
            """The windows of what is held; but for the last time, those at its end stay held, to be cut with what follows."""
            nonlocal sequence, held, size, due
            ids = np.concatenate([x[done:] for _, x, done in held])
            doc_ends = np.cumsum([len(x) - done for _, x, done in held])
            bounds, costs = boundaries(ids, doc_ends, ends, length, sentence_cost, split_cost)
            cut = cuts(bounds, costs, length)
            if not last:
                cut = cut[: max(1, len(cut) - AGAIN)]
            raw, stop = ids.astype("<u4").tobytes(), cut[-1]
            rows, rest, k = [], [], 0
            for (doc, own, done), end in zip(held, doc_ends.tolist(), strict=True):
                first = end - len(own)
                at = first + done
                while at < min(end, stop):
                    while cut[k + 1] <= at:
                        k += 1
                    to = min(end, cut[k + 1])
                    rows.append((doc, at - first, to - at, zlib.crc32(raw[4 * at : 4 * to]), len(own), sequence + k, at - cut[k]))
                    at = to
                if at < end:
                    rest.append((doc, own, at - first))
            sequence += len(cut) - 1
            held, size = rest, len(ids) - stop
            due = size + block_ids
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "", allowed_special="all")
                ids.append(end_id)
                held.append((doc, np.array(ids, np.uint32), 0))
                size += len(ids)
                if size >= due:
                    yield emit(False)
        if held:
            yield emit(True)

    return run


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, sentence_cost: int = SENTENCE_COST, split_cost: int = SPLIT_COST, end_id: int = 0, block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of a document: where it starts in the document and where it lies in which sequence.

    Each document is its ids and then `end_id`; a null or empty text is `end_id` alone. Documents keep the order in which a partition
    stores them, pieces the order of the document; each id lies in exactly one piece, also of repeated rows (which are documents of
    their own). Sequence ids differ across partitions and don't change if a lost task runs again. An empty table gives no rows.
    Nothing is shuffled: each partition ends one sequence early at most. The programme runs over about `block_ids` ids at a time; the
    last `AGAIN` windows of a run are cut again with what follows, so no window ends for the sake of a run. Texts of any length are read whole.
    Extra columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_packer(vocabulary, length, sentence_cost, split_cost, end_id, block_ids), SCHEMA)
