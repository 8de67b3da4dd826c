"""Secret scans with a random forest over candidates, in DataFrame functions and the JVM's own forest only.

Candidates are runs of 16 or more characters that keys are written in, with a digit and a letter, and values of 6 or more assigned to a
credential's name in one of four languages, both without a name before them and punctuation after them, known key formats wherever they
stand alone, and armoured blocks, each as a whole. A forest removes the false positives. Its features are the length, how characters change within the candidate, how much of it the corpus knows as
words, what its path looks like, and the words beside it. It is trained from labelled findings: a given table, and findings planted in
texts of the corpus. What a planted value is follows from how it was made (a random key, or a checksum, slug, identifier and the like),
and not from any feature; the texts around it and the words in it are the corpus's own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_DECISIONS, decisions, let, row_key, saved

#: Words beside a candidate that name a credential (English, German, French, Spanish), or say that it is something else; key formats; paths
#: of tests. Fixed values.
CREDENTIAL = (
    r"(?:token|secret|passwd|password|pwd|passphrase|api[_ -]?key|access[_ -]?key|private[_ -]?key|(?<![A-Za-z])key|auth|bearer|credential"
    r"|passwort|kennwort|geheimnis|schl(?:[üÜ]|ue)ssel|mot de passe|mdp|jeton|(?<![A-Za-z])cl[éÉ]|contrase[ñÑn]a|clave|secreto)"
)
HARMLESS = r"(?i)(?:[_-]id|sha-?(?:1|256)|md5|commit|checksum|digest|etag|uuid|guid|isbn|doi|href|src|url|version|example|sample|placeholder)[^A-Za-z0-9]*$"
FORMATS = r"(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*|hooks\.slack\.com/services/[A-Za-z0-9/]{30,}|discord(?:app)?\.com/api/webhooks/[0-9]{15,}/[A-Za-z0-9_-]{40,})"
KNOWN, KNOWN_INSIDE = f"^/*{FORMATS}$", f"(?<![A-Za-z0-9]){FORMATS}(?![A-Za-z0-9])"
TEST_PATH = r"(?i)(?:test|example|sample|mock|fixture|spec)s?(?:[^a-z]|$)"
RUN = r"[A-Za-z0-9+/_=.~-]{16,}+"
ASSIGNED = rf"(?i){CREDENTIAL}[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?([A-Za-z0-9+/_=.~!@#$%^&*-]{{6,}}+)"
#: An armoured block up to its end line, or, without one, as far as its lines go; line ends may be escaped. Which blocks are keys.
BLOCK = r"-----BEGIN [A-Z0-9 ]++-----(?:(?:[A-Za-z0-9+/=:,.()_\s\\]++|-(?!----))*+-----END [A-Z0-9 ]++-----|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,}+)*+)"
PRIVATE = "^-----BEGIN [A-Z0-9 ]*PRIVATE KEY"
#: What is no part of a run: a name before its value, and punctuation after it.
NAME, END = r"^.*=(?=[^=])", r"[.~-]+$"
#: Characters read on each side of a candidate. Given labelled findings, and texts of the corpus with planted ones, that the forest learns
#: from at most (the first in the order of a hash).
AROUND, MAX_LABELLED, MAX_CONTEXTS = 48, 8_000, 400
#: A run of letters is a word if the corpus has it this often; looked-up runs up to which they are broadcast.
MIN_WORD_COUNT, MAX_BROADCAST_WORDS = 3, 400_000
TREES, DEPTH, SEED, THRESHOLD = 32, 8, 11, 0.5
MASK = "[SECRET]"
#: Shorter values are masked where they stand alone; planted kinds made in one projection, so that its code is small enough to be compiled.
SHORT, KINDS_AT_ONCE = 16, 6


def candidate_values(text: Column) -> Column:
    """The different candidates of a text."""
    bare = lambda v: F.regexp_replace(v, END, "")

    def outside(rest: Column) -> Column:
        runs = F.transform(F.regexp_extract_all(rest, F.lit(RUN), F.lit(0)), lambda v: bare(F.regexp_replace(v, NAME, "")))
        runs = F.filter(runs, lambda v: (F.length(v) >= 16) & v.rlike("[0-9]") & v.rlike("[A-Za-z]"))
        assigned = F.filter(F.transform(F.regexp_extract_all(rest, F.lit(ASSIGNED), F.lit(1)), bare), lambda v: F.length(v) >= 6)
        return F.concat(runs, assigned, F.regexp_extract_all(rest, F.lit(KNOWN_INSIDE), F.lit(0)))

    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0)), let(F.regexp_replace(text, BLOCK, " "), outside)))


def quoted(value: Column) -> Column:
    """A pattern of the value itself."""
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc_id, row_key, row, path, value, at, times, before, after): what lies around each different candidate of a document.

    A row for each place of the value that differs in `before` or `after`; `at` is the value's first place. Places inside a longer run of
    letters and digits are another value's, so they don't count. Rows of `docs` that repeat differ in `row`. The text itself isn't carried along.
    Null and empty texts have no candidates; a null path is an empty one, a null id stays null. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.col(text_col).cast("string").alias("text"))
    text = F.col("text")

    def starts(v: Column, between: Column) -> Column:
        none = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(1).alias("next"))
        step = lambda s, x: F.struct(F.concat(s["starts"], F.array(s["next"] + F.length(x))).alias("starts"), (s["next"] + F.length(x) + F.length(v)).alias("next"))
        return F.aggregate(F.slice(between, F.lit(1), F.size(between) - 1), none, step, lambda s: s["starts"])

    def around(v: Column, at: Column) -> Column:
        before = F.substring(text, F.greatest(F.lit(1), at - AROUND), F.least(F.lit(AROUND), at - 1))
        return F.struct(before.alias("before"), F.substring(text, at + F.length(v), F.lit(AROUND)).alias("after"))

    def own(v: Column, places: Column) -> Column:
        alone = lambda at: ~F.substring(text, F.greatest(F.lit(1), at - 1), F.least(F.lit(1), at - 1)).rlike("[A-Za-z0-9]") & ~F.substring(text, at + F.length(v), F.lit(1)).rlike("[A-Za-z0-9]")
        return let(F.filter(places, alone), lambda x: F.when(F.size(x) > 0, x).otherwise(places))

    def found(v: Column) -> Column:
        def shown(places: Column) -> Column:
            return let(
                own(v, places),
                lambda x: F.struct(
                    v.alias("value"),
                    (x[0] - 1).cast("long").alias("at"),
                    F.size(places).cast("long").alias("times"),
                    F.array_distinct(F.transform(x, lambda at: around(v, at))).alias("shown"),
                ),
            )

        return let(let(F.split(text, quoted(v)), lambda between: starts(v, between)), shown)

    key = row_key(F.col("doc_id"), text)
    out = rows.select("doc_id", key.alias("row_key"), F.monotonically_increasing_id().alias("row"), "path", F.explode(F.transform(candidate_values(text), found)).alias("c"))
    return out.select("doc_id", "row_key", "row", "path", "c.value", "c.at", "c.times", F.inline("c.shown"))


def word_runs(value: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit("[a-z]{4,}"), F.lit(0)))


def known_words(docs: DataFrame, values: DataFrame, text_col: str = "text", max_broadcast: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """(word): the letter runs of `values.value` that stand alone in the corpus MIN_WORD_COUNT times or more. Counts cover all texts."""
    asked = saved(values.select(F.explode(word_runs(F.col("value"))).alias("word")).distinct(), "asked-words")
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col).cast("string")), r"[^\p{L}\p{N}]+")).alias("word")).where(F.length("word") >= 4)
    if asked.limit(max_broadcast + 1).count() <= max_broadcast:
        counted = words.join(F.broadcast(asked), "word").groupBy("word").agg(F.count("*").alias("n"))
    else:
        counted = words.groupBy("word").agg(F.count("*").alias("n")).join(asked, "word")
    return counted.where(F.col("n") >= MIN_WORD_COUNT).select("word")


def with_coverage(values: DataFrame, words: DataFrame) -> DataFrame:
    """`values` and `covered`, the share of a value's characters that lie in known words."""
    runs = values.select("value").distinct().select("value", F.explode(word_runs(F.col("value"))).alias("word"))
    share = runs.join(words, "word").groupBy(F.col("value").alias("of")).agg(F.sum(F.length("word")).alias("letters"))
    joined = values.join(share, F.col("value") == F.col("of"), "left")
    return joined.withColumn("covered", F.least(F.lit(1.0), F.coalesce(F.col("letters"), F.lit(0)) / F.length("value"))).drop("of", "letters")


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.length(value)


def with_features(found: DataFrame) -> DataFrame:
    """`found` and `features`: length; character transitions; dictionary coverage; path; neighbouring words."""
    v, before, after = F.col("value"), F.col("before"), F.col("after")
    classes = reduce(lambda c, x: F.regexp_replace(c, *x), (("[0-9]", "0"), ("[a-z]", "a"), ("[A-Z]", "A"), ("[^0aA]", "-")), v)
    changes = (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1) / F.length(v)
    longest = lambda pattern: F.coalesce(F.array_max(F.transform(F.regexp_extract_all(v, F.lit(pattern), F.lit(0)), F.length)), F.lit(0)) / F.length(v)
    parts = [
        F.least(F.length(v), F.lit(200)), _share(v, "[0-9]"), _share(v, "[A-Z]"), _share(v, "[^A-Za-z0-9]"),
        changes, F.size(F.array_distinct(F.split(v, ""))) / F.length(v), longest("[A-Za-z]+"), longest("[0-9]+"), _share(F.lower(v), "[aeiou]"),
        v.rlike("^[0-9a-fA-F]+$"), v.rlike(KNOWN), v.rlike(PRIVATE), F.col("covered"),
        F.col("path").rlike(TEST_PATH), (before.rlike("[/\\\\]$") | before.rlike(r"(?i)https?:\S*$")),
        before.rlike("@$") | after.rlike("^@"),
        before.rlike(rf"(?i){CREDENTIAL}[^\n]{{0,12}}$"), before.rlike(rf"(?i){CREDENTIAL}[\"']?\s*[:=]\s*[\"']?$"), before.rlike(r"[:=]\s*[\"']?$"), before.rlike("[\"']$") & after.rlike("^[\"']"), before.rlike(HARMLESS),
        F.length(F.regexp_extract(before, r"([A-Za-z]*)[^A-Za-z]*$", 1)), F.length(F.regexp_extract(after, r"^[^A-Za-z]*([A-Za-z]*)", 1)),
    ]
    return found.withColumn("features", F.array(*[F.coalesce(p.cast("double"), F.lit(0.0)) for p in parts]))


def planted_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """(path, value, before, after, label): findings of each kind in each of at most `max_contexts` texts, and in a few empty ones.

    The texts are the first in the order of a hash. Only those in a share of the hash's range that holds some times as many are looked at,
    so what meets in a task doesn't grow with the corpus.

    Kinds with label 1 hold random keys, key blocks and passwords; those with label 0 checksums, ids, addresses, names of words and numbers,
    placeholders, certificates, words said of a credential, and keys in paths of tests.
    """
    text, path = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    share = min(1.0, 8 * max_contexts / max(1, docs.count()))
    key = F.xxhash64(F.col(id_col).cast("long"), text, path)
    rows = docs.select(text.alias("text"), path.alias("path"), key.alias("h")).where(F.length("text") >= 3 * AROUND).where(F.col("h") <= int((share - 0.5) * ((1 << 64) - 2048)))
    rows = rows.orderBy("h", "text", "path").limit(max_contexts).unionByName(docs.sparkSession.range(0, 20, 1, 1).select(F.lit("").alias("text"), F.lit("").alias("path"), F.col("id").alias("h")))
    draw = lambda k: F.xxhash64("h", F.lit(k))
    at = F.pmod(draw("at"), F.greatest(F.length("text") - 2 * AROUND, F.lit(1))).cast("int") + 1
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,9}"), F.lit(0))), lambda w: w != "")
    rows = rows.select(
        "path",
        "h",
        F.regexp_replace(F.substring("text", at, F.lit(AROUND)), r"\S*$", "").alias("left"),
        F.regexp_replace(F.substring("text", at + AROUND, F.lit(AROUND)), r"^\S*", "").alias("right"),
        F.concat(words, F.array(*map(F.lit, "river stone letter yesterday garden yellow window market silver".split()))).alias("words"),
    )
    rows = saved(rows.coalesce(1), "contexts")
    one_of = lambda k, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(draw(k), F.lit(len(xs))) + 1).cast("int"))
    number = lambda k, n: F.pmod(draw(k), F.lit(n)).cast("string")
    hexed = lambda k, n: F.substring(F.sha2(F.concat_ws("/", F.col("h").cast("string"), F.lit(k)).cast("binary"), 256), 1, n)
    b64 = lambda k, n: F.substring(F.base64(F.unhex(F.sha2(F.concat_ws("/", F.col("h").cast("string"), F.lit(k)).cast("binary"), 512))), 1, n)
    alnum = lambda k, n: F.substring(F.regexp_replace(b64(k, 80), "[^A-Za-z0-9]", ""), 1, n)
    word = lambda k: F.get("words", F.pmod(draw(k), F.size("words")).cast("int"))
    slug = lambda k, sep: F.concat_ws(sep, word(k + "1"), word(k + "2"), word(k + "3"))
    uuid = lambda k: F.regexp_replace(hexed(k, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    name = one_of("name", "token", "secret", "password", "api_key", "access_key", "secret_key", "auth_token", "client_secret", "key", "Passwort", "mot de passe", "contraseña", "clave")
    close = one_of("then", " ", ". ", ", ", "\n", "; ")
    none, test_path = F.lit(""), F.concat(F.col("path"), one_of("test", "/tests/fixtures/keys.py", "/test_login.py", "/example.env", "/spec/mock.rb"))
    file = F.concat(F.col("path"), one_of("file", "", "", "/src/config.py", "/.env", "/app/settings.yaml"))
    set_to = F.concat(name, one_of("equals", ' = "', '="', ' : "', "='"))
    line = one_of("line", "\n", "\\n")
    armour = lambda k, kind: F.concat(F.lit("-----BEGIN "), kind, F.lit("-----"), *[x for i in range(3) for x in (line, b64(f"{k}{i}", 64))], line, F.lit("-----END "), kind, F.lit("-----"))
    kinds = [  # value, what stands right before and after it, its path, label
        (hexed("a", 40), set_to, F.lit('"'), file, 1),
        (F.upper(hexed("b", 40)), F.upper(set_to), F.lit('"'), file, 1),
        (hexed("c", 32), F.concat(one_of("url", "https://api.example.org/v1?", "GET /items?page=2&", "?"), name, F.lit("=")), close, file, 1),
        (F.regexp_replace(b64("d", 36), "=", ""), F.concat(F.upper(name), F.lit("=")), F.lit("\n"), file, 1),
        (alnum("e", 32), F.concat(F.lit('"'), name, F.lit('": "')), F.lit('",'), file, 1),
        (b64("f", 43), F.lit("Authorization: Bearer "), F.lit("\n"), file, 1),
        (F.concat(F.lit("AKIA"), F.upper(alnum("g", 16))), one_of("aws", "", "aws_id=", "key ", "("), close, file, 1),
        (F.concat(F.lit("ghp_"), alnum("i", 36)), none, close, file, 1),
        (F.concat(F.lit("sk-"), alnum("j", 40)), none, close, file, 1),
        (F.concat(alnum("k", 9), one_of("sign", "!", "#", "@", "%"), alnum("l", 4)), set_to, F.lit('"'), file, 1),
        (alnum("m", 12), F.concat(name, F.lit(": ")), close, file, 1),
        (hexed("aj", 40), F.concat(name, one_of("said", " is ", " -> ", " was ")), close, file, 1),
        (F.concat(F.lit("eyJ"), alnum("Q", 33), F.lit(".eyJ"), alnum("R", 50), F.lit("."), alnum("S", 43)), one_of("jwt", "", "Bearer ", "token=", '"jwt": "'), close, file, 1),
        (F.concat(F.lit("xoxb-"), number("T", 10**11), F.lit("-"), alnum("U", 24)), one_of("bot", "", "bot: ", "("), close, file, 1),
        (F.concat(F.lit("AIza"), alnum("V", 35)), one_of("map", "", "?key=", "maps "), close, file, 1),
        (hexed("W", 32), one_of("key", "key=", "?key=", "&apikey=", "key: "), close, file, 1),
        (F.concat(F.lit("hooks.slack.com/services/T"), F.upper(alnum("X", 9)), F.lit("/B"), F.upper(alnum("Y", 9)), F.lit("/"), alnum("Z", 24)), F.lit("https://"), close, file, 1),
        (armour("aa", one_of("pem", "RSA PRIVATE KEY", "PRIVATE KEY", "OPENSSH PRIVATE KEY")), none, close, file, 1),
        (slug("ab", ""), F.concat(name, one_of("is", ": ", "=", " = ")), close, file, 1),
        (F.concat(F.lit("1"), number("ac", 10**6), number("ad", 10**4)), F.concat(name, one_of("num", ": ", "=", " = ")), close, file, 1),
        (hexed("n", 40), one_of("sum", "commit ", "sha1:", "SHA-1 ", "checksum: ", "etag ", "version "), close, file, 0),
        (hexed("o", 64), one_of("sum2", "sha256:", "digest ", "sha256 = ", "md5/"), close, file, 0),
        (hexed("p", 40), none, close, file, 0),
        (b64("q", 64), F.lit('integrity="sha512-'), F.lit('"'), file, 0),
        (b64("r", 80), one_of("mime", "data:image/png;base64,", "data:font/woff;base64,"), F.lit('"'), file, 0),
        (uuid("s"), one_of("id", "", "id=", "uuid: ", '"id": "', "/"), close, file, 0),
        (F.concat(F.lit("mail"), number("t", 90), F.lit(".example.com")), F.concat(word("u"), F.lit("@")), close, file, 0),
        (F.concat(word("v"), F.lit("."), number("w", 99)), none, F.concat(F.lit("@"), word("x"), F.lit(".example.org")), file, 0),
        (F.concat(slug("y", "-"), F.lit("-"), number("z", 9999)), one_of("link", "https://example.org/", "/", "href=\"/", ""), close, file, 0),
        (F.concat(slug("A", "_"), number("B", 99)), none, close, file, 0),
        (F.concat(word("C"), F.initcap(word("D")), F.initcap(word("E")), number("F", 20)), none, one_of("call", "(", " ", ".", "["), file, 0),
        (F.concat(one_of("sort", "IMG_", "scan-", "report."), F.lit("2023"), number("G", 9999), F.lit("_"), number("H", 999999), one_of("end", ".jpg", ".pdf", "")), none, close, file, 0),
        (F.concat(F.lit("2023-0"), number("I", 9), F.lit("-1"), number("J", 9), F.lit("T10.00.00Z")), none, close, file, 0),
        (F.concat(one_of("made", "your-", "my-", "change-me-", "xxxx-", "test-"), slug("K", "-"), F.lit("-1")), set_to, F.lit('"'), file, 0),
        (F.concat(F.lit("xxxxxxxxxxxxxxxx"), number("L", 9)), set_to, F.lit('"'), file, 0),
        (slug("M", "_"), F.concat(name, one_of("of", ": ", " = ")), close, file, 0),
        (hexed("ae", 40), F.concat(F.lit('"'), name, F.lit('_id": "')), F.lit('",'), file, 0),
        (armour("af", one_of("cert", "CERTIFICATE", "PUBLIC KEY", "CERTIFICATE REQUEST")), none, close, file, 0),
        (word("ag"), F.concat(name, one_of("prose", ": ", " = ")), close, file, 0),
        (F.concat(word("ah"), F.lit("-"), word("ai")), F.concat(name, one_of("prose2", ": ", " = ")), close, file, 0),
        (hexed("N", 40), set_to, F.lit('"'), test_path, 0),
        (alnum("O", 32), F.concat(F.lit('"'), name, F.lit('": "')), F.lit('",'), test_path, 0),
        (F.concat(F.lit("AKIA"), F.upper(alnum("P", 16))), set_to, F.lit('"'), test_path, 0),
    ]
    texts = [
        F.struct(F.xxhash64("h", F.lit(k)).alias("id"), p.alias("path"), F.concat("left", b, v, a, F.col("right")).alias("text"), v.alias("planted"), F.lit(y).alias("label"))
        for k, (v, b, a, p, y) in enumerate(kinds)
    ]
    parts = [rows.select(F.inline(F.array(*texts[k : k + KINDS_AT_ONCE]))) for k in range(0, len(texts), KINDS_AT_ONCE)]
    planted = saved(reduce(DataFrame.unionByName, parts).coalesce(1), "planted")
    # What is found of a planted value, with a name or an address around it or in part, has its label; what the text had before has none.
    found = candidates(planted, "id", "text", "path").select("doc_id", "path", "value", "before", "after")
    of = planted.select("id", "planted", "label")
    same = F.contains("value", "planted") | F.contains("planted", "value")
    return found.join(F.broadcast(of), (F.col("doc_id") == F.col("id")) & same).select("path", "value", "before", "after", "label")


def findings(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, row_key, value, at, times, score, is_secret): every candidate of every document with the forest's verdict.

    A value is judged at each of its places in a document; the highest score counts.

    labelled: (path, value, before, after, label) to learn from beside planted findings, at most `max_labelled` rows in the order of a hash.
    Null and empty texts have no candidates; a null path is an empty one; a null id stays null. Documents that repeat in id and text give
    their findings once for each row. An empty table gives no rows. Texts of any length are read whole. Extra columns are ignored, whatever
    their names.
    """
    columns = ["path", "value", "before", "after", "label"]
    known = planted_findings(docs, id_col, text_col, path_col).select(*columns)
    if labelled is not None:
        known = known.unionByName(labelled.select(*columns).orderBy(F.xxhash64(*columns), *columns).limit(max_labelled))
    known = saved(known.coalesce(1), "labelled")
    found = saved(candidates(docs, id_col, text_col, path_col), "candidates")
    words = saved(known_words(docs, found.select("value").union(known.select("value")), text_col), "known-words")
    found = saved(with_coverage(found, words), "covered")
    train = with_features(with_coverage(known, words)).select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
    train = saved(train.coalesce(1), "training")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", minInstancesPerNode=2).fit(train)
    scored = forest.transform(with_features(found).withColumn("features", array_to_vector("features")))
    score = F.round(vector_to_array("probability")[1], 6)
    best = scored.select("doc_id", "row_key", "row", "value", "at", "times", score.alias("score")).groupBy("doc_id", "row_key", "row", "value", "at", "times").agg(F.max("score").alias("score"))
    return best.select("doc_id", "row_key", "value", "at", "times", "score", (F.col("score") >= threshold).alias("is_secret"))


def mask_secrets(docs: DataFrame, mask: str = MASK, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """`docs` with each confirmed secret replaced by `mask`, and `length_col` counted again where the text changed; all rows stay.

    Longer values go first, so none is left in part; values of fewer than SHORT characters go where they stand alone. Rows with nothing to mask keep their text as it is.
    """
    bad = findings(docs, id_col=id_col, text_col=text_col, **options).where("is_secret")
    ordered = F.array_sort(F.collect_set(F.struct((-F.length("value")).alias("n"), "value")))
    bad = bad.groupBy(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key")).agg(F.transform(ordered, lambda x: x["value"]).alias("__values"))
    bad = decisions(bad, "secrets", MAX_BROADCAST_DECISIONS // 8)  # a row holds its values too
    key = row_key(docs[id_col].cast("long"), docs[text_col].cast("string"))
    values, text = bad["__values"], docs[text_col]
    alone = lambda v: F.concat(F.lit("(?<![A-Za-z0-9])"), quoted(v), F.lit("(?![A-Za-z0-9])"))
    plain = F.lit(mask.replace("\\", "\\\\").replace("$", "\\$"))
    put = lambda t, v: F.when(F.length(v) < SHORT, F.regexp_replace(t, alone(v), plain)).otherwise(F.replace(t, v, F.lit(mask)))
    clean = F.when(values.isNull(), text).otherwise(F.aggregate(values, text.cast("string"), put))
    kept = {c: docs[c] for c in docs.columns} | {text_col: clean}
    if length_col and length_col in docs.columns:
        kept[length_col] = F.when(values.isNull(), docs[length_col]).otherwise(F.length(clean).cast(docs.schema[length_col].dataType))
    joined = docs.join(bad, (key == bad["__key"]) & docs[id_col].cast("long").eqNullSafe(bad["__id"]), "left")
    return joined.select(*[c.alias(n) for n, c in kept.items()])
