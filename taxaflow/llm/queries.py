"""The registered queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, html, language, packing, pii, prefix_trie, quality, secrets, simhash, toxicity, warc
from .common import table


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns and the verdict of every document; edge cases as in `quality.quality`."""
    return quality.quality(table(spark, sf_dir, "documents")).drop("row_key", "removed_lines")


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item, with the item; those that don't have no row. Edge cases as in `decontaminate.overlaps`."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives through the index; edge cases as in `warc.round_trip`."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op4_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with its verdict; values leave as digests only. Edge cases as in `secrets.findings`."""
    found = secrets.findings(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256")
    return found.select("doc_id", "at", F.length("value").cast("long").alias("length"), "times", digest, "score", "is_secret")


def op5_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document; edge cases as in `pii.personal_data`."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op6_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, learnt from labels that aren't held out; edge cases as in `toxicity.toxicity`."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_dp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document and where they lie; edge cases as in `packing.pack`."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op8_segment_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; edge cases as in `simhash.near_duplicates`."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_grammar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back; edge cases as in `chat.format_conversations`."""
    return chat.op9(spark, sf_dir)


def op10_consensus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; edge cases as in `html.main_text`."""
    return html.main_text(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations; edge cases as in `prefix_trie.prefix_trie`."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source of a language differs from the others and from the language; edge cases as in `divergence.source_divergence`."""
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that aren't held out; edge cases as in `language.identify`."""
    return language.identify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_line_frequency, op2_spaced_seeds, op3_capture_index, op4_secret_forest, op5_anchor_expansion,
        op6_boosted_toxicity, op7_dp_packing, op8_segment_popcount, op9_grammar_round_trip, op10_consensus_paths,
        op11_prefix_trie, op12_source_divergence, op13_kneser_ney_language,
    )
    return {f.__name__: f for f in ops}


_W = r"[^\x20\x09-\x0D]+"

OP1_SQL = rf"""
with d as (select doc_id, source, coalesce(text, '') as text from documents),
w as (select doc_id, source, text, regexp_extract_all(text, '{_W}') as ws, string_split(text, chr(10)) as ls from d),
b as (
  select doc_id, source, text, ws, len(ws)::bigint as n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(list_filter(ls, lambda x: regexp_matches(x, '{_W}'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '{_W}')))))::bigint as n_dup_lines
  from w),
g as (select doc_id, i, array_to_string(ws[i:i+7], ' ') as run from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from b where len(ws) >= 8)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, run) as c from g) where c > 1),
cov as (select doc_id, count(distinct j)::bigint as n from (select doc_id, unnest(range(i, i + 8)) as j from rep) group by doc_id),
l as (select doc_id, source, text, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as line
      from (select doc_id, source, text, unnest(ls) as x from w)),
f as (select source, line from l where line <> '' group by source, line having count(distinct doc_id) > 20),
r as (select doc_id, sum(len(string_split(line, ' ')))::bigint as n from l join f using (source, line) group by doc_id),
o as (
  select b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words, coalesce(r.n, 0)::bigint as n_removed_words
  from b left join cov using (doc_id) left join r using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words,
  (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
  (not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and n_removed_words <= 0.5 * n_words) as kept
from o
"""

_MASKED = " union all ".join(
    "select doc_id, item_id, d.i - b.i as diagonal from d join b on "
    + " and ".join(f"d.v[{k + 1}] = b.v[{k + 1}]" for k in mask)
    for mask in decontaminate.MASKS
)

OP2_SQL = rf"""
with dw as (select doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as ws from documents where text is not null),
bw as (select item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as ws from benchmark where text is not null),
d as (select doc_id, i, ws[i:i+11] as v from (select doc_id, ws, unnest(range(1, len(ws) - 10)) as i from dw where len(ws) >= 12)),
b as (select item_id, i, ws[i:i+11] as v from (select item_id, ws, unnest(range(1, len(ws) - 10)) as i from bw where len(ws) >= 12)),
h as ({_MASKED}),
g as (select distinct doc_id, item_id, diagonal from h),
w as (select doc_id, item_id, diagonal, dw.ws as ws, bw.ws as items, unnest(range(greatest(diagonal, 0) + 1, least(len(dw.ws), len(bw.ws) + diagonal) + 1)) as place from g join dw using (doc_id) join bw using (item_id)),
l as (select doc_id, item_id, diagonal, place, 100 * row_number() over (partition by doc_id, item_id, diagonal order by place) - 70 * place as level from w where ws[place] = items[place - diagonal]),
e as (select *, min(level) over (partition by doc_id, item_id, diagonal order by place rows between unbounded preceding and 11 preceding) as least from l)
select doc_id, item_id, count(distinct diagonal) as n_diagonals, count(*) as n_ends from e where level - least + 30 >= 0 group by doc_id, item_id
"""

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(f"substr('{_ALPHABET}', ((('0x' || substr(h, {5 * k + 1}, 5))::bigint >> {shift}) & 31)::integer + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0))

OP3_SQL = f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
f as (select *, min(page_id) over (partition by h) as first_id from p)
select page_id, strlen(html)::bigint as payload_bytes, {_BASE32} as payload_digest,
  case when page_id is not distinct from first_id then 'response' else 'revisit' end as record_type, case when page_id is distinct from first_id then first_id end as refers_to
from f
"""

OP9_SQL = r"""
with t as (
  select conv_id::bigint as conv_id, turn::bigint as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
q as (
  select *, length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + 4 + 2 + 9 as n
  from t)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  (sum(n) + 7)::bigint as formatted_chars
from q group by conv_id
"""

_CRC_BYTE = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))"


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda a, b: {_CRC_BYTE}), 4294967295::bigint)"


OP11_SQL = rf"""
with t as (
  select conv_id::bigint as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos,
    coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
c as (select c, c - c % 20 as base, {_crc32('c::varchar')} % 4 as h from (select distinct c from t)),
rebuilt as (
  select c.c, 0 as part, pos, role, text from c join t on t.c = c.base and t.pos <= c.h
  union all select c.c, 1, pos, role, text from c join t on t.c = c.c and t.pos > c.h),
d as (select c, row_number() over w as depth, len(regexp_extract_all(text, '{_W}'))::bigint as words,
    string_agg(length(role) || ':' || length(text) || ':' || role || text, '') over w as key
  from rebuilt window w as (partition by c order by part, pos rows unbounded preceding)),
p as (select c, depth, words, sha256(key) as key from d union all select c, 0, 0, '' from c),
s as (select c, max(depth) as size from p group by c),
n as (select key, depth, min(c) as conv_id, count(*) as n_convs, max(words) as words from p group by key, depth),
up as (select n.key, q.key as up from n join p q on q.c = n.conv_id and q.depth = n.depth - 1),
k as (select up as key, count(*) as n from up group by up),
leaf as (select n.*, k.n is null as is_leaf from n left join k using (key)),
sub as (select p.key, count(*) filter (is_leaf) as n_leaves, sum((n_convs - 1) * leaf.words)::bigint as saved_tokens from leaf join p on p.c = leaf.conv_id and p.depth <= leaf.depth group by p.key),
e as (select p.key, sha256(string_agg(p.c::varchar, ',' order by p.c)) as h from p join s on s.c = p.c and s.size = p.depth group by p.key)
select n.conv_id, n.depth::bigint as depth, q.conv_id as parent_conv_id, n.n_convs, coalesce(k.n, 0)::bigint as n_children, sub.n_leaves, sub.saved_tokens, coalesce(e.h, sha256('')) as ends_sha256
from n join sub using (key) left join k using (key) left join e using (key) left join up using (key) left join n q on q.key = up.up
"""

OP12_SQL = r"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from w group by 1, 2 having count(distinct id) >= 30),
v as (select lang, count(*)::hugeint as v from kept group by 1),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*)::hugeint as n from w join kept using (lang, term) group by 1, 2, 3),
full_c as (select g.lang, g.source, kept.term, coalesce(c.n, 0)::hugeint as n from g join kept using (lang) left join c using (lang, source, term)),
p as (select lang, source, term, n, 1 + (1000000000 * (n + 5)) // ((sum(n) over (partition by lang, source)) + 5 * v.v) as p from full_c join v using (lang)),
q as (select lang, term, 1 + (1000000000 * (n + 5)) // ((sum(n) over (partition by lang)) + 5 * v.v) as q
      from (select lang, term, sum(n)::hugeint as n from full_c group by 1, 2) join v using (lang)),
pair as (select a.lang, a.source, b.source as item, coalesce(s.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term group by 1, 2, 3) s on s.lang = a.lang and s.source = a.source and s.item = b.source),
term as (select lang, source, term as item, (p - q)::bigint as value from p join q using (lang, term) where n > 0 and p > q)
select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::integer as rank from pair
union all
select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item)::integer as rank from term qualify rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_frequency": OP1_SQL, "op2_spaced_seeds": OP2_SQL, "op3_capture_index": OP3_SQL, "op9_grammar_round_trip": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op12_source_divergence": OP12_SQL}
