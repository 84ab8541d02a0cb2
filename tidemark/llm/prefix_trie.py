"""The trie of all prefixes of conversations, built by a van Emde Boas recursion over depth.

Depth is cut at half, the halves at half again, and so on: with 2^K steps above the longest conversation, level k has
pieces of 2^k turns.  All pieces of a level are worked on in one job, so the recursion takes K rounds, not one for each
turn, and every row is one turn, so no conversation has to fit a task.

* **Names.**  Blocks of 2^k turns are named from the names of their halves, bottom up.  Then, top down, every piece is
  cut in the middle: the cut prefix is named from the name of the prefix where the piece begins and of the block that
  leads to the cut.  Its upper and its lower half are pieces of the next round.  A name is a SHA-256, which depends on
  depth and turns only, so equal prefixes get equal names without meeting.
* **Nodes.**  One aggregate by name, with partial counts and minima on the map side, gives members and the smallest one.
* **Totals.**  Bottom up, every node has the sum over that part of its subtree which lies in its own piece.  When two
  pieces become one, the sums of the roots of the lower forest are grafted on to the nodes of the upper trie above them,
  which are prefixes of the root's smallest member.  A round has at most one row for each turn.
* **Ends.**  The ids of the conversations that end in a node are sorted by the shuffle and hashed as a stream, so a node
  at which very many end needs no memory for them.

A parent of more than ``hot_children`` children is not a join key: its row goes to a table of such parents, which is
joined by its measured size.  Turns are numbered in blocks of 4,096 turn numbers.

Defined cases: null roles and texts are empty; null turns come first; rows of the same turn are ordered by the digest of
role and text, repeated ones are turns of their own; rows without a conversation id belong to no conversation; an empty
table has no nodes, not even a root; other columns play no part.  Texts are reduced to digest and word count in the
first pass and not shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BITS = 12
_NO_TURN = -(2**62)  #: block of the rows whose turn is null


def _name(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def ranked_turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, name, words): the turns of every conversation, numbered from 0."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = _name(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), name.alias("name"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    turns = stored(turns.withColumn("block", F.coalesce(F.shiftright("turn", BLOCK_BITS), F.lit(_NO_TURN))), "turns")
    sizes = turns.groupBy("conv", "block").agg(F.count("*").alias("rows"))
    starts = sizes.select("conv", "block", (F.sum("rows").over(W.partitionBy("conv").orderBy("block")) - F.col("rows")).alias("start"))
    at = F.row_number().over(W.partitionBy("conv", "block").orderBy("turn", "name")) - 1
    return turns.join(starts, ["conv", "block"]).select("conv", (F.col("start") + at).alias("pos"), "name", "words")


def nodes(turns: DataFrame, conversations: DataFrame, hot_children: int = 65_536) -> DataFrame:
    """One row for each distinct prefix of the turns (conv, pos, name, words) of ``conversations`` (conv, unique).

    (node, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256); ``conv_id`` is the
    smallest member.  Conversations without turns are members of the root.
    """
    longest = turns.agg(F.max("pos")).first()[0]
    levels = 0 if longest is None else (longest + 1).bit_length()
    prefixes = _prefixes(turns, conversations, levels)
    found = _nodes(prefixes, turns, hot_children)
    totals = _totals(found, prefixes, levels)
    over = prefixes.join(turns.select("conv", F.col("pos").alias("depth")), ["conv", "depth"], "left_anti")
    none = hashlib.sha256(b"").hexdigest()
    out = found.join(totals, "node").join(_end_digests(over.select("node", "conv")), "node", "left")
    return out.select("node", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def _prefixes(turns: DataFrame, conversations: DataFrame, levels: int) -> DataFrame:
    """(conv, depth, node): the name of every prefix of every conversation."""
    blocks = [turns.select("conv", F.col("pos").alias("block"), "name")]
    for k in range(levels - 1):
        half = lambda odd: F.max(F.when(F.col("block") % 2 == odd, F.col("name")))
        pairs = blocks[-1].groupBy("conv", F.shiftright("block", 1).alias("block")).agg(half(0).alias("left"), half(1).alias("right"))
        pairs = pairs.where("left is not null and right is not null")
        blocks.append(stored(pairs.select("conv", "block", _name(F.col("left"), F.col("right")).alias("name")), "blocks"))
    known = [conversations.select("conv", F.lit(0).cast("long").alias("depth"), F.unhex(F.sha2(F.lit(""), 256)).alias("node"))]
    for k in reversed(range(levels)):
        upper = blocks[k].where("block % 2 = 0").select("conv", F.shiftleft("block", k).alias("depth"), "name")
        cut = reduce(DataFrame.unionAll, known).join(upper, ["conv", "depth"])
        known.append(stored(cut.select("conv", (F.col("depth") + 2**k).alias("depth"), _name(F.col("node"), F.col("name")).alias("node")), "cuts"))
    return stored(reduce(DataFrame.unionAll, known), "prefixes")


def _nodes(prefixes: DataFrame, turns: DataFrame, hot_children: int) -> DataFrame:
    """(node, depth, conv_id, n_convs, words, parent_conv_id, n_children)"""
    found = prefixes.groupBy("node").agg(F.max("depth").alias("depth"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"))
    above = turns.select("conv", F.col("pos").alias("depth"), "words").join(prefixes, ["conv", "depth"]).select(F.col("conv").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), "words")
    found = stored(found.join(above, ["conv_id", "depth"], "left").select("node", "depth", "conv_id", "n_convs", F.coalesce("words", F.lit(0)).alias("words"), "parent"), "nodes")
    families = stored(found.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")), "families")
    parents = families.join(found.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    parents = stored(parents, "parents")
    hot = stored(parents.where(F.col("n_children") > hot_children).select("parent", F.col("parent_conv_id").alias("hot_conv_id")), "hot")
    marked = found.join(hot, "parent", "left")
    ordinary = F.when(F.col("hot_conv_id").isNull(), F.col("parent"))  # children of hot parents, and the root, need no further look
    cold = marked.where(ordinary.isNotNull()).join(parents.select("parent", "parent_conv_id"), "parent")
    warm = marked.where(ordinary.isNull()).withColumn("parent_conv_id", F.col("hot_conv_id"))
    kept = ["node", "depth", "conv_id", "n_convs", "words", "parent_conv_id"]
    both = cold.select(kept).unionAll(warm.select(kept))
    counts = families.select(F.col("parent").alias("node"), "n_children")
    return stored(both.join(counts, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")


def _totals(found: DataFrame, prefixes: DataFrame, levels: int) -> DataFrame:
    """(node, n_leaves, saved_tokens): sums over whole subtrees."""
    leaf = (F.col("n_children") == 0).cast("long")
    sums = found.select("node", "depth", "conv_id", leaf.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    for k in range(levels):
        bits = min(k + 1, BLOCK_BITS)  # pieces longer than a block meet block by block
        piece = F.shiftleft(F.shiftright("depth", k + 1), k + 1)
        parts = F.sequence(F.shiftright(piece, bits), F.shiftright(F.col("depth") - 1, bits))
        forest = sums.where(F.col("depth").bitwiseAND(F.lit(2 ** (k + 1) - 1)) == 2**k)
        forest = forest.select(F.col("conv_id").alias("conv"), F.explode(parts).alias("part"), "n_leaves", "saved_tokens")
        upper = prefixes.where(F.col("depth").bitwiseAND(F.lit(2**k)) == 0).select("conv", F.shiftright("depth", bits).alias("part"), "node")
        grafts = upper.join(forest, ["conv", "part"]).select("node", F.lit(None).cast("long").alias("depth"), F.lit(None).cast("long").alias("conv_id"), "n_leaves", "saved_tokens")
        both = sums.unionAll(grafts).groupBy("node")
        sums = stored(both.agg(*(F.max(c).alias(c) for c in ("depth", "conv_id")), *(F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens"))), "sums")
    return sums.select("node", "n_leaves", "saved_tokens")


def _end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, conv): ids ascending, joined by commas.  A stream keeps one digest open at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            names, texts = batch["node"].to_pylist(), list(map(str, batch["conv"].to_pylist()))
            done: list[tuple[bytes, str]] = []
            begin = 0
            for at in [i for i in range(1, len(names)) if names[i] != names[i - 1]] + [len(names)]:
                part = ",".join(texts[begin:at]).encode()
                if names[begin] == node:
                    digest.update(b"," + part)
                else:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = names[begin], hashlib.sha256(part)
                begin = at
            yield _digest_batch(done)
        if node is not None:
            yield _digest_batch([(node, digest.hexdigest())])

    return ends.repartition("node").sortWithinPartitions("node", "conv").mapInArrow(run, "node binary, ends_sha256 string")


def _digest_batch(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], ["node", "ends_sha256"])


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations of the contract of op13, from ranked turns: conversation c begins with the first h turns
    of conversation c - c % 20, then come its own after its first h, with h the crc32 of c as text, modulo 4."""
    turns = stored(turns, "ranked")
    h = F.crc32(F.col("conv").cast("string")) % 4
    lengths = turns.groupBy("conv").agg(F.count("*").alias("length"))
    convs = lengths.select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % 20).alias("base"))
    convs = stored(convs.join(lengths.select(F.col("conv").alias("base"), "length"), "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("length", F.lit(0))).alias("lent")), "convs")
    heads = turns.where("pos < 3").select(F.col("conv").alias("base"), "pos", "name", "words")
    lent = convs.join(heads, "base").where("pos < h").select("conv", "pos", "name", "words")
    # own turns move by h less the lent ones; the few conversations they move in meet their turns block by block
    part = F.shiftright("pos", BLOCK_BITS)
    own = turns.where(F.col("pos") >= h)
    parts = own.select("conv", part.alias("part")).distinct().join(convs.where("lent < h").select("conv", (F.col("h") - F.col("lent")).alias("moved")), "conv")
    own = own.withColumn("part", part).join(parts, ["conv", "part"], "left")
    own = own.select("conv", (F.col("pos") - F.coalesce("moved", F.lit(0))).alias("pos"), "name", "words")
    return stored(lent.unionAll(own), "rebuilt"), convs.select("conv")
