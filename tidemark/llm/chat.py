"""Chat formatting of reply trees.

Messages name the message they reply to.  Self-joins enumerate the paths from roots to leaves: round r joins every
message to its ancestor 2^r steps up, so a path of any length takes a logarithmic number of rounds and every round has
one row for each message.  Sums of scores along the way come with the joins, so each leaf knows its depth and the
score of its branch.  Branches are ranked by mean score within a tree, and the messages of the chosen leaves' paths
are found by the same jumps backwards.  Each chosen path becomes one conversation.

The template marks a turn as ``<|im_start|>role``, a line end, the text, ``<|im_end|>``, a line end.  Inside texts and
roles every ``<|`` gets a backslash in between, as do those that have backslashes there already, so no control string
can occur and unescaping takes away exactly one; line ends and backslashes in roles are escaped too.

Defined cases: null roles and texts are empty; an unknown parent makes a root; messages on a cycle have no root and
are left out; repeated messages are turns of their own, in the order of turn, role and text; null turns come first;
rows with a null conversation are one conversation; an empty table gives an empty result; other columns play no part.
One conversation must fit a task, as its text is one value of the result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import per_batch, stored

START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation and the spans of it, in code points, that the loss covers: the assistant's texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def read_back(conversation: str) -> list[tuple[str, str]]:
    return [(unescape_role(role), unescape(text)) for role, text in _TURN.findall(conversation)]


def reply_chain(rows: DataFrame) -> DataFrame:
    """(tree, node, parent, role, text, score): rows by turn as a tree in which each row replies to the one before."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    role, text = (F.coalesce(x, F.lit("")).alias(x) for x in ("role", "text"))
    node = F.row_number().over(W.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    rows = rows.select(tree.alias("tree"), "turn", role, text).withColumn("node", node)
    return rows.select("tree", "node", F.nullif(F.col("node") - 1, F.lit(0)).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def conversations(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, rank, n_turns, conversation, loss_spans): one row for each chosen root-to-leaf path.

    ``messages`` has tree, node (unique within its tree), parent, role, text, score.  The best ``branches`` of a tree
    by mean score are chosen, or all.
    """
    messages = stored(messages.select("tree", "node", "parent", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score")), "messages")
    known = messages.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    links = messages.select("tree", "node", "parent", "score").join(known, ["tree", "parent"], "left")
    up = stored(links.select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("above"), F.lit(1).cast("long").alias("depth"), "score"), "up")
    jumps, rounds = [], 0
    total = messages.count()
    while not up.where("above is not null").isEmpty() and 2**rounds <= 2 * total:  # only cycles are left after that
        jumps.append(up.select("tree", "node", "above").where("above is not null"))
        higher = up.select("tree", F.col("node").alias("above"), F.col("above").alias("next"), F.col("depth").alias("more"), F.col("score").alias("sum"))
        further = up.where("above is not null").join(higher, ["tree", "above"], "left").select(
            "tree", "node", F.col("next").alias("above"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.col("score") + F.coalesce("sum", F.lit(0.0))).alias("score"),
        )
        up = stored(up.where("above is null").unionByName(further), "up")  # messages that have reached their root are not joined again
        rounds += 1
    depths = up.where("above is null").select("tree", "node", "depth", "score")
    parents = messages.where("parent is not null").select("tree", F.col("parent").alias("node"))
    best = W.partitionBy("tree").orderBy(F.desc(F.col("score") / F.col("depth")), "node")
    leaves = depths.join(parents, ["tree", "node"], "left_anti").withColumn("rank", F.row_number().over(best))
    leaves = leaves if branches is None else leaves.where(F.col("rank") <= branches)
    leaves = stored(leaves.select("tree", F.col("node").alias("leaf"), "rank"), "leaves")
    on_path = leaves.select("tree", "leaf", F.col("leaf").alias("node"))
    for jump in jumps:
        further = on_path.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"))
        on_path = stored(on_path.unionAll(further), "paths")
    turns = on_path.join(depths.select("tree", "node", "depth"), ["tree", "node"]).join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    turns = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))

    def write(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [formatted([(t["role"], t["text"]) for t in turns]) for turns in batch["turns"].to_pylist()]
        spans = pa.array([[{"begin": a, "end": b} for a, b in s] for _, s in made], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
        lengths = pa.array([len(t) for t in batch["turns"].to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([batch["tree"], batch["leaf"], lengths, pa.array([t for t, _ in made], pa.string()), spans], ["tree", "leaf", "n_turns", "conversation", "loss_spans"])

    out = per_batch(turns, write, "tree string, leaf long, n_turns long, conversation string, loss_spans array<struct<begin: long, end: long>>")
    return out.join(leaves, ["tree", "leaf"]).select("tree", "leaf", "rank", "n_turns", "conversation", "loss_spans")
