"""Chat formatting with a grammar round trip, in DataFrame functions only.

    #!chat
    ### user: text </turn>
    ### assistant: text </turn>

A backslash quotes the control strings `\\`, `###` and `</turn>` inside a text (and `:` inside a role). The formatted conversation is
parsed again: it is cut at each `</turn>` line, a turn's head is taken off, and quotes are removed. A turn whose raw text the parser
rejects (it holds an unquoted control string) or doesn't give back is quoted, and the comparison is made once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

HEAD, MARK, END = "#!chat\n", "### ", " </turn>\n"
CONTROL = r"(\\|###|</turn>)"
ROLE_CONTROL = r"(\\|###|</turn>|:)"
TRAINED = "assistant"


def quoted(text: Column, control: str = CONTROL) -> Column:
    return F.regexp_replace(text, control, r"\\$1")


def unquoted(text: Column, control: str = CONTROL) -> Column:
    return F.regexp_replace(text, r"\\" + control, "$1")


def _head(role: Column) -> Column:
    return F.concat(F.lit(MARK), quoted(role, ROLE_CONTROL), F.lit(": "))


def _turns_of(pieces: Column) -> Column:
    """The parser on turns without their end mark: role, text, and whether a control string stands unquoted in either."""

    def one(piece: Column) -> Column:
        head = F.regexp_extract(piece, r"^### ((?:[^\\:]++|\\(?:###|</turn>|\\|:))*+): ", 0)
        role = F.substring(head, F.lit(len(MARK) + 1), F.length(head) - len(MARK) - 2)
        text = F.substring(piece, F.length(head) + 1, F.length(piece))
        loose = F.regexp_replace(text, r"\\(\\|###|</turn>)", "")
        return F.struct(
            unquoted(role, ROLE_CONTROL).alias("role"),
            unquoted(text).alias("text"),
            ((F.length(head) > 0) & ~loose.rlike(CONTROL)).alias("good"),
        )

    return F.transform(pieces, one)


def _pieces(formatted: Column) -> Column:
    """The turns of a formatted conversation, in order; after the last end mark nothing follows."""
    body = F.substring(formatted, F.lit(len(HEAD) + 1), F.length(formatted))
    return let(F.split(body, END), lambda p: F.slice(p, F.lit(1), F.size(p) - 1))


def parse(formatted: Column) -> Column:
    """array<struct<role, text, good>> of a formatted conversation."""
    return _turns_of(_pieces(formatted))


def format_turn(role: Column, text: Column) -> Column:
    """One turn with its head, without its end mark: raw if the parser gives it back, quoted else."""
    raw = F.concat(_head(role), text)
    again = F.struct(role.alias("role"), text.alias("text"), F.lit(True).alias("good"))
    same = _turns_of(_pieces(F.concat(F.lit(HEAD), raw, F.lit(END)))) == F.array(again)
    return F.when(same, raw).otherwise(F.concat(_head(role), quoted(text)))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = TRAINED) -> DataFrame:
    """(conv_id, formatted, loss, round_trip): a row for each conversation.

    loss: array<struct<start, length>>, for each turn the code points of its piece that are trained on (length 0: none).
    round_trip: whether the parser gives back the turns from `formatted`.

    Turns are ordered by turn, then role, then text, so ties and repeated rows have one defined order and all stay; null turns come
    first. A null text or role is an empty one, rows without conv_id are one conversation. An empty table gives no rows. A conversation
    is one row, as its digest needs its text in order: the longest conversation must fit in a task.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn_col).cast("long").alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    rows = rows.select("conv_id", "t", format_turn(F.col("t.role"), F.col("t.text")).alias("piece"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("t", "piece"))).alias("x"))
    source = F.transform("x", lambda x: F.struct(x["t"]["role"].alias("role"), x["t"]["text"].alias("text"), F.lit(True).alias("good")))
    convs = convs.select(
        "conv_id",
        F.concat(F.lit(HEAD), F.array_join(F.transform("x", lambda x: F.concat(x["piece"], F.lit(END))), "")).alias("formatted"),
        F.transform("x", lambda x: let(F.length(_head(x["t"]["role"])), lambda n: F.struct(
            n.alias("start"), F.when(x["t"]["role"] == trained, F.length(x["piece"]) - n).otherwise(0).alias("length")))).alias("loss"),
        source.alias("source"),
    )
    return convs.select("conv_id", "formatted", "loss", (parse(F.col("formatted")) == F.col("source")).alias("round_trip"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from `formatted` and its loss mask alone: counts and digests of the turns and of the text trained on."""
    pieces = formatted.select("conv_id", "formatted", "loss", _pieces(F.col("formatted")).alias("pieces"))
    read = pieces.select(
        "conv_id",
        F.length("formatted").cast("long").alias("formatted_chars"),
        _turns_of(F.col("pieces")).alias("turns"),
        F.array_join(F.zip_with("pieces", "loss", lambda p, m: unquoted(F.substring(p, m["start"] + 1, m["length"]))), "").alias("trained"),
    )
    spelt = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spelt.cast("binary"), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, -7, whose texts hold control strings."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    formatted = format_conversations(rows.unionByName(hard)).where(F.assert_true("round_trip").isNull())
    return read_back(formatted)
