"""A trie of conversation prefixes whose subtree totals come from parallel tree contraction.

Every distinct sequence of first turns is a node. A node's key is a sum of digests, one for each of its turns and its depth, so keys are
running sums: they are taken in blocks of turns, and a parent's key is its child's less the child's own digest. A node is then named by
its smallest member and its depth.

Contraction alternates two steps on what is left of the tree, each by joins:

* compress: all chains of nodes with one child go. A chain node's way to the end of its chain is doubled until it arrives; the chain's sum
  goes to the parent of its first node, which becomes the parent of what follows the chain.
* rake: all leaves go, and their sums to their parents.

Leaves at least halve in each turn of both, so the rounds grow with the logarithm of the tree whatever its depth. Re-expansion goes through
the compressed chains in reverse: a chain node's total is its sum to the chain's end and the total of what follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_CLASS, forget, saved

#: Conversations are families of this many ids; a rebuilt one takes up to HEAD turns from its family's first.
FAMILY, HEAD = 20, 3
#: Turn numbers in a block of running sums, and ids in a block of a list of ends.
TURN_BLOCK, END_BLOCK = 1024, 4096
ID, UP, SUMS = ["conv_id", "depth"], ["up_conv", "up_depth"], ["leaves", "tokens"]
KEY = ["k0", "k1", "k2", "k3"]


def _n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"[^{SPACE_CLASS[1:-1]}]+"), F.lit(0))).cast("long")


def _digest_words(depth: Column, digest: Column) -> list[Column]:
    """Four 32-bit numbers for a turn at a depth; their sums along a conversation tell its prefixes apart."""
    hexed = F.sha2(F.concat_ws(":", depth, digest).cast("binary"), 256)
    return [F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def shared_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % 4).cast("int")


def _blocks(df: DataFrame, values: list[str]) -> DataFrame:
    """(conv, block, before_v for each value): what the conversation's blocks before it add up to."""
    w = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return df.select("conv", "block", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"before_{v}") for v in values])


def numbered_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, block, pos, digest, words): the turns of each conversation in order, pos from 1; saved, without texts.

    A conversation's turns are put in order within blocks of turn numbers, so a long one is spread over many tasks.
    """
    turn = F.col(turn_col).cast("long")
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv"), turn.alias("turn"), F.coalesce(F.floor(turn / TURN_BLOCK).cast("long"), F.lit(-(1 << 62)).cast("long")).alias("block"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).where("conv is not null")
    place = F.row_number().over(W.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    rows = saved(rows.select("conv", "block", place.cast("long").alias("place"), digest.alias("digest"), _n_words(F.col("text")).alias("words")), "trie-turns")
    sizes = rows.groupBy("conv", "block").agg(F.max("place").alias("n"))
    placed = rows.join(_blocks(sizes, ["n"]), ["conv", "block"]).select("conv", "block", (F.col("before_n") + F.col("place")).alias("pos"), "digest", "words")
    out = saved(placed, "trie-placed")
    forget(rows)
    return out


def rebuilt_prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of numbered turns: (conv, depth, k0..k3, w0..w3, words), a row for each prefix of each rebuilt conversation, and (conv, size), a row
    for each rebuilt conversation, those without turns too."""
    head = turns.where(F.col("pos") <= HEAD).select("conv", "pos", "words", F.array(*_digest_words(F.col("pos"), F.col("digest"))).alias("w"))
    heads = head.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "w", "words"))).alias("head"))  # HEAD rows at most
    upto = lambda i, j: F.aggregate(F.slice("head", 1, i), F.lit(0).cast("long"), lambda a, x: a + x["w"][j])
    steps = F.array(*[F.struct(*[upto(i, j).alias(k) for j, k in enumerate(KEY)]) for i in range(HEAD + 1)])
    heads = heads.select(F.col("conv").alias("base"), "head", steps.alias("steps"))
    sizes = turns.groupBy("conv").agg(F.max("pos").alias("own")).withColumn("h", shared_turns(F.col("conv"))).withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    convs = sizes.join(heads, "base", "left").withColumn("taken", F.least("h", F.coalesce(F.size("head"), F.lit(0))))
    start = F.when(F.col("taken") > 0, F.element_at("steps", F.col("taken") + 1))
    convs = convs.select(
        "conv", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("size"),
        *[F.coalesce(start[k], F.lit(0)).alias(f"{k}_start") for k in KEY], F.when(F.col("taken") > 0, F.slice("head", 1, F.col("taken"))).alias("head"), "steps",
    )
    convs = saved(convs, "trie-conversations")
    first = convs.where("taken > 0").select("conv", "steps", F.inline("head")).select("conv", F.col("pos").alias("depth"), F.element_at("steps", F.col("pos").cast("int") + 1).alias("s"), "w", "words")
    first = first.select("conv", "depth", *[F.col(f"s.{k}") for k in KEY], *[F.col("w")[j].alias(f"w{j}") for j in range(4)], "words")
    # What holds for a conversation goes to its blocks, and from there to its turns, so no long conversation meets one row.
    of_block = turns.groupBy("conv", "block").agg(F.max("pos").alias("last")).join(convs.select("conv", "h", "taken", *[f"{k}_start" for k in KEY]), "conv").where("last > h")
    own = turns.join(of_block.drop("last"), ["conv", "block"]).where("pos > h").withColumn("depth", F.col("pos") - F.col("h") + F.col("taken"))
    own = own.select("conv", "block", "depth", "words", *[f"{k}_start" for k in KEY], *[w.alias(f"w{j}") for j, w in enumerate(_digest_words(F.col("depth"), F.col("digest")))])
    own = saved(own, "trie-own")
    before = _blocks(own.groupBy("conv", "block").agg(*[F.sum(f"w{j}").alias(f"w{j}") for j in range(4)]), [f"w{j}" for j in range(4)])
    run = W.partitionBy("conv", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    own = own.join(before, ["conv", "block"]).select(
        "conv", "depth", *[(F.col(f"k{j}_start") + F.col(f"before_w{j}") + F.sum(f"w{j}").over(run)).alias(f"k{j}") for j in range(4)], *[f"w{j}" for j in range(4)], "words",
    )
    return first.unionByName(own), convs.select("conv", "size")


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined lists of each node, whose blocks come in order; one block is held at a time."""
    at, running = None, None

    def table(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.string())], names=["depth", *KEY, "ends_sha256"])

    for b in batches:
        done = []
        for *key, ids in zip(*[b.column(i).to_pylist() for i in range(5)], b.column(6), strict=True):
            if key == at:
                running.update(b",")
            else:
                if at is not None:
                    done.append((*at, running.hexdigest()))
                at, running = key, hashlib.sha256()
            running.update(ids.as_py().encode())
        yield table(done)
    if at is not None:
        yield table([(*at, running.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k0..k3, ends_sha256) of ends(depth, k0..k3, conv). Ids are joined in blocks of their range first, then each node's blocks are
    streamed in order, as a digest has to be."""
    blocks = ends.groupBy("depth", *KEY, F.floor(F.col("conv") / END_BLOCK).alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_set("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    dealt = blocks.repartition("depth", *KEY).sortWithinPartitions("depth", *KEY, "block")
    return dealt.select("depth", *KEY, "block", "ids").mapInArrow(_stream_digests, "depth long, k0 long, k1 long, k2 long, k3 long, ends_sha256 string")


def _renamed(df: DataFrame, names: dict[str, str], *more: str | Column) -> DataFrame:
    return df.select(*[F.col(a).alias(b) for a, b in names.items()], *more)


def _added(tree: DataFrame, more: DataFrame, n_raked: str | None = None) -> DataFrame:
    """`tree` with what its nodes got: more(conv_id, depth, got_leaves, got_tokens, ..)."""
    joined = tree.join(more, ID, "left")
    n = F.col("n") if n_raked is None else F.col("n") - F.coalesce(n_raked, F.lit(0))
    return joined.select(*ID, *UP, *[(F.col(s) + F.coalesce(f"got_{s}", F.lit(0))).alias(s) for s in SUMS], n.alias("n"))


def _to_parents(rows: DataFrame, conv: str, depth: str, *more: Column) -> DataFrame:
    return rows.groupBy(F.col(conv).alias("conv_id"), F.col(depth).alias("depth")).agg(*[F.sum(s).alias(f"got_{s}") for s in SUMS], *more)


def compress(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree without its chains, and the chains: (conv_id, depth, end_conv, end_depth, leaves, tokens), the sums up to before the end."""
    chain = tree.where("n = 1")
    # Each node under a chain node gives that one its first step.
    step = tree.select(*_as(ID, "end"), *_as(UP, ""), (F.col("n") != 1).alias("done")).join(chain.select(*ID, *SUMS), ID)
    way = saved(step, "trie-way")
    while not way.where("not done").isEmpty():
        ahead = _renamed(way, {"conv_id": "end_conv", "depth": "end_depth", "end_conv": "next_conv", "end_depth": "next_depth", "leaves": "l2", "tokens": "t2", "done": "d2"})
        moved = way.where("not done").join(ahead, ["end_conv", "end_depth"]).select(
            F.col("next_conv").alias("end_conv"), F.col("next_depth").alias("end_depth"), *ID, F.col("d2").alias("done"), (F.col("leaves") + F.col("l2")).alias("leaves"), (F.col("tokens") + F.col("t2")).alias("tokens"),
        )
        last, way = way, saved(way.where("done").unionByName(moved), "trie-way")
        forget(last)
    # The first node of a chain is the one whose parent isn't in a chain.
    tops = chain.select(*ID, *UP).join(_renamed(chain, {"conv_id": "up_conv", "depth": "up_depth"}), UP, "left_anti")
    tops = saved(way.join(tops, ID).select(F.col("end_conv").alias("conv_id"), F.col("end_depth").alias("depth"), F.col("up_conv").alias("to_conv"), F.col("up_depth").alias("to_depth"), *SUMS), "trie-tops")
    rest = tree.where("n <> 1").join(tops.drop(*SUMS), ID, "left")
    rest = rest.select(*ID, F.coalesce("to_conv", "up_conv").alias("up_conv"), F.coalesce("to_depth", "up_depth").alias("up_depth"), *SUMS, "n")
    return _added(rest, _to_parents(tops, "to_conv", "to_depth")), way.drop("done")


def _as(cols: list[str], to: str) -> list[Column]:
    """conv and depth columns under the names of `to`: end_conv, end_depth or conv_id, depth."""
    return [F.col(c).alias(n) for c, n in zip(cols, [f"{to}_conv", f"{to}_depth"] if to else ID, strict=True)]


def rake(tree: DataFrame) -> DataFrame:
    """The tree without its leaves; parents get their sums and lose them as children."""
    gone = _to_parents(tree.where("n = 0"), "up_conv", "up_depth", F.count("*").alias("raked"))
    return _added(tree.where("n > 0"), gone, "raked")


def subtree_totals(tree: DataFrame) -> DataFrame:
    """(conv_id, depth, leaves, tokens) summed over each node's subtree, of tree(conv_id, depth, up_conv, up_depth, leaves, tokens, n): n children.

    The root isn't a row: nodes whose parent isn't there are tops.
    """
    tree = saved(tree, "trie-tree")
    raked, chains = [], []
    while not tree.isEmpty():
        before = tree
        if not tree.where("n = 1").isEmpty():
            tree, ways = compress(tree)
            tree = saved(tree, "trie-tree")
            chains.append(ways)
            forget(before)
        raked.append(tree.where("n = 0").select(*ID, *SUMS))
        tree = saved(rake(tree), "trie-tree")
    known = None
    for r in raked:
        known = r if known is None else known.unionByName(r)
    if known is None:
        return tree.select(*ID, *SUMS)
    for way in reversed(chains):
        of_end = _renamed(known, {"conv_id": "end_conv", "depth": "end_depth", "leaves": "l2", "tokens": "t2"})
        more = way.join(of_end, ["end_conv", "end_depth"]).select(*ID, (F.col("leaves") + F.col("l2")).alias("leaves"), (F.col("tokens") + F.col("t2")).alias("tokens"))
        known = known.unionByName(saved(more, "trie-expanded"))
    return known


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256).

    Turns are ordered by turn (null first), then role, then text, so ties and repeated rows have one order and all stay. A null role or text
    is an empty one; rows without conv_id belong to no conversation and are left out. An empty table gives no rows. Texts of any length are
    hashed whole and then left behind; conversations of any length are spread over tasks by their turn numbers (turns that all share one
    number are put in order in one task, which spills). Extra columns are ignored, whatever their names.
    """
    placed = numbered_turns(turns, conv_col, turn_col, role_col, text_col)
    prefixes, convs = rebuilt_prefixes(placed)
    prefixes = saved(prefixes, "trie-prefixes")
    nodes = prefixes.groupBy("depth", *KEY).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), *[F.max(f"w{j}").alias(f"w{j}") for j in range(4)])
    zero = [F.lit(0).cast("long").alias(k) for k in KEY]
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), *zero, "conv_id", "n_convs", F.lit(0).cast("long").alias("words"), *[F.lit(0).cast("long").alias(f"w{j}") for j in range(4)])
    nodes = saved(nodes.unionByName(root), "trie-nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(k).alias(f"p{j}") for j, k in enumerate(KEY)], F.col("conv_id").alias("up_conv"))
    linked = nodes.select("*", *[(F.col(k) - F.col(f"w{j}")).alias(f"p{j}") for j, k in enumerate(KEY)]).where("depth > 0").join(parents, ["depth", "p0", "p1", "p2", "p3"])
    linked = saved(linked.select(*ID, "up_conv", (F.col("depth") - 1).alias("up_depth"), "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("tokens")), "trie-links")
    children = linked.groupBy(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth")).agg(F.count("*").alias("n"))
    children = saved(children, "trie-children")
    tree = linked.join(children, ID, "left").select(*ID, *UP, F.when(F.col("n").isNull(), 1).otherwise(0).cast("long").alias("leaves"), "tokens", F.coalesce("n", F.lit(0)).alias("n"))
    totals = subtree_totals(tree)
    whole = totals.join(linked.where("depth = 1").select(*ID), ID).agg(F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens"))
    top = root.select("conv_id", "depth").crossJoin(F.broadcast(whole)).select(*ID, F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("tokens", F.lit(0)).alias("tokens"))  # one row each
    last = convs.join(prefixes.withColumnRenamed("depth", "size"), ["conv", "size"]).select(F.col("size").alias("depth"), *KEY, "conv")
    ends = end_digests(last.unionByName(convs.where("size = 0").select(F.col("size").alias("depth"), *zero, "conv")))
    named = nodes.select(*ID, *KEY, "n_convs").join(ends, ["depth", *KEY], "left").drop(*KEY)
    out = named.join(totals.unionByName(top), ID).join(children, ID, "left").join(linked.select(*ID, "up_conv"), ID, "left")
    return out.select(
        "conv_id", "depth", F.col("up_conv").alias("parent_conv_id"), "n_convs", F.coalesce("n", F.lit(0)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("tokens").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
