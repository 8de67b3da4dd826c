"""Personal data by anchor expansion: an Aho-Corasick automaton finds cues, local parsers grow and check what lies around each.

Cues are at-signs, a digit before a dot (ip), pairs of digits with at most one blank or hyphen between (card), a plus before a digit
(phone), schemes (tel: and ://, for a user in a URL) and account words (IBAN, account, SSN, passport). A parser reads left and right of its cue only as far as its own characters go, so a text costs one
pass of the automaton and time in proportion to what is found.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("account", "url")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = DIGITS | frozenset(" ().-")
_IBAN_CUES = ("IBAN", "Iban", "iban")
_ACCOUNT_CUES = ("account", "Account", "ACCOUNT", "acct", "Acct", "SSN", "ssn", "passport", "Passport")
#: A number as people write it, to find one inside a longer run that isn't valid as a whole.
_NATIONAL = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}(?![0-9])")
_IBAN = re.compile(r"[\s:#.]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
#: A number right after an account cue, and what ends a URL's authority.
_ACCOUNT = re.compile(r"(?:\s{1,2}(?:number|no|nr|num))?\.?\s{0,2}[:#=]?\s{0,2}([A-Z]{0,3}[0-9](?:[ -]?[0-9]){5,22})(?![0-9A-Za-z])")
_AUTHORITY = re.compile(r"[^\s/?#\"'<>]+")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def iban_valid(s: str) -> bool:
    """ISO 13616: the first four characters go last, letters count from 10, the whole is 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    for c in "0123456789":
        a.add_word(f"{c}.", ("ip", 2))
        a.add_word(f"+{c}", ("phone", 2))
        for d in "0123456789":
            a.add_word(c + d, ("card", 2))
            a.add_word(f"{c} {d}", ("card", 3))
            a.add_word(f"{c}-{d}", ("card", 3))
    for cue in _IBAN_CUES:
        a.add_word(cue, ("iban", len(cue)))
    for cue in _ACCOUNT_CUES:
        a.add_word(cue, ("account", len(cue)))
    for cue in ("tel:", "Tel:", "TEL:"):
        a.add_word(cue, ("tel", 4))
    a.add_word("://", ("url", 3))
    a.make_automaton()
    return a


def _right(text: str, i: int, allowed: frozenset[str]) -> int:
    n = len(text)
    while i < n and text[i] in allowed:
        i += 1
    return i


def _left(text: str, i: int, allowed: frozenset[str], least: int) -> int:
    while i > least and text[i - 1] in allowed:
        i -= 1
    return i


def _email(text: str, at: int, least: int) -> tuple[int, int] | None:
    start, n = _left(text, at, _LOCAL, least), len(text)
    end = _right(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < n and text[end] == "." and (more := _right(text, end + 1, _LABEL)) > end + 1:
        end, dots = more, dots + 1
    return (start, end) if dots else None


def _ip(text: str, at: int, least: int) -> tuple[int, int, list[str]] | None:
    start, n = _left(text, at, DIGITS, least), len(text)
    parts, i = [], start
    for k in range(4):
        if k:
            if i >= n or text[i] != ".":
                return None
            i += 1
        end = _right(text, i, DIGITS)
        if end == i:
            return None
        parts.append(text[i:end])
        i = end
    return start, i, parts


def _digit_chain(text: str, start: int) -> int:
    """The end of the run of digits with at most one blank or hyphen between two."""
    i, n = start + 1, len(text)
    while i < n:
        if text[i] in DIGITS:
            i += 1
        elif text[i] in " -" and i + 1 < n and text[i + 1] in DIGITS:
            i += 2
        else:
            break
    return i


def _inner_cards(text: str, start: int, end: int) -> list[Span]:
    """Cards written as one or as four groups of digits inside a chain that is none as a whole."""
    groups = [(start + m.start(), start + m.end()) for m in re.finditer("[0-9]+", text[start:end])]
    out, k = [], 0
    while k < len(groups):
        a, b = groups[k]
        if 16 <= b - a <= 19 and luhn(text[a:b]):
            out.append(("card", a, b))
        elif [y - x for x, y in groups[k : k + 4]] == [4, 4, 4, 4] and luhn("".join(text[x:y] for x, y in groups[k : k + 4])):
            out.append(("card", a, groups[k + 3][1]))
            k += 3
        k += 1
    return out


def scan(text: str, cues) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans) of one text, each by kind as listed and then start; ends are exclusive, in code points."""
    base: list[Span] = []
    added: list[Span] = []
    ends = dict.fromkeys((*KINDS, *EXTRA_KINDS, "iban", "tel"), 0)
    for last, (kind, size) in cues.iter(text):
        at = last - size + 1
        done = ends[kind]
        if at < done:
            continue
        if kind == "card":
            end = ends[kind] = _digit_chain(text, at)
            if end - at >= 16:
                digits = text[at:end].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    base.append((kind, at, end))
                else:
                    added += _inner_cards(text, at, end)
        elif kind == "ip":
            if found := _ip(text, at, done):
                ends[kind] = found[1]
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found[2]):
                    base.append((kind, found[0], found[1]))
        elif kind == "email":
            if found := _email(text, at, done):
                ends[kind] = found[1]
                base.append((kind, *found))
        elif kind == "phone":
            end = _right(text, at + 2, _PHONE)
            while end > at + 3 and text[end - 1] not in DIGITS:
                end -= 1
            if end > at + 3:
                ends[kind] = end
                if 8 <= sum(c in DIGITS for c in text[at:end]) <= 15:
                    base.append((kind, at, end))
                elif m := _NATIONAL.match(text, at, end):
                    added.append((kind, at, m.end()))
        elif kind == "tel":
            start = last + 1 + (text[last + 1 : last + 2] == " ")
            end = _right(text, start, _PHONE) if text[start : start + 1] in DIGITS | {"("} else start
            while end > start and text[end - 1] not in DIGITS:
                end -= 1
            if end > start and 7 <= sum(c in DIGITS for c in text[start:end]) <= 15:
                ends[kind] = end
                added.append(("phone", start, end))
        elif kind == "url":
            start = _left(text, at, _LETTERS, done)
            if start < at and (m := _AUTHORITY.match(text, last + 1)) and m[0].rfind("@") > 0:
                ends[kind] = m.end()
                added.append((kind, start, m.end()))
        elif kind == "account":
            if m := _ACCOUNT.match(text, last + 1):
                ends[kind] = m.end()
                added.append((kind, m.start(1), m.end(1)))
        elif m := _IBAN.match(text, last + 1):
            value = m[1]
            while value and not (15 <= len(x := value.replace(" ", "")) <= 34 and iban_valid(x)):
                value = value[: value.rindex(" ")] if " " in value else ""  # words in capitals may follow
            if value:
                ends[kind] = m.start(1) + len(value)
                added.append(("account", m.start(1), ends[kind]))
    order = {k: i for i, k in enumerate((*KINDS, *EXTRA_KINDS))}
    key = lambda s: (order[s[0]], s[1], s[2])
    return sorted(base, key=key), sorted(added, key=key)


def _spelt(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _arrow_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cues = automaton()
    order = {k: i for i, k in enumerate((*KINDS, *EXTRA_KINDS))}
    for b in batches:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        shas, spans = [], []
        for t in b.column(1):
            base, added = scan(t.as_py() or "", cues)
            for k in KINDS:
                counts[k].append(sum(s[0] == k for s in base))
            shas.append(hashlib.sha256(_spelt(base).encode()).hexdigest())
            spans.append(_spelt(sorted(base + added, key=lambda s: (order[s[0]], s[1], s[2])) if added else base))
        cols = [b.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(shas, pa.string()), pa.array(spans, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: counts of the four base kinds, the digest of their spans, and all spans.

    Added to the base: cards inside longer digit chains, numbers inside longer phone runs and after tel:, URLs with a user, and account
    numbers after their cue (an IBAN must check out). A null text
    is empty; an empty one has no spans, and its digest is that of the empty string. Repeated rows each give a row, null ids stay null. An
    empty table gives no rows. Texts of any length are read whole. Extra columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_arrow_scan, SCHEMA)
