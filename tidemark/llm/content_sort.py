"""Exact duplicates by sorting contents.

Texts are normalised once (A-Z in lower case) and written with their leading characters, a 64-bit mark and a SHA-256.
Rows are then dealt to ranges of (leading characters, mark): the splitters between ranges are sampled by Spark, which
never has to hold whole texts for that.  Inside its range every row is sorted, externally where memory does not do,
by its text, so equal texts are neighbours.  A text that differs from its neighbour's, compared in full, begins a new
run; of a run the row that stays comes first.

A text with very many copies must not fill one range.  Marks whose texts come to over ``piece_bytes`` bytes are counted
beforehand, with partial sums on the map side, and their rows are dealt to pieces, each of which is a sort key of its own.
The runs of these pieces, one row each, are sorted and compared with their neighbours in full once more, so a split
group is one group in the result.  There are at most (bytes in all / ``piece_bytes``) such marks; they are joined as a
table whose size Spark has measured.

Defined cases: a null text equals the empty text; a null id is beaten by every other id and is the id that stays only
where a group has no other; of rows with equal id and text one stays; an empty table gives an empty result; other
columns play no part, whatever their names.  Text length is not limited.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stored

HEAD = 32  #: leading characters in a sort key


def _lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` does the same to a text of ASCII alone, only faster."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def content_groups(docs: DataFrame, keep: str = "smallest", carry: tuple[str, ...] = (), piece_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, row): one row for each row of ``docs``.

    ``keep`` says whether the ``smallest`` or the ``largest`` id of a group stays.  ``row`` is a struct of the columns
    named in ``carry``, for callers that want more of the input back.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is 'smallest' or 'largest', not {keep!r}")
    best = F.asc_nulls_last if keep == "smallest" else F.desc_nulls_last
    of_group = F.min if keep == "smallest" else F.max
    row = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in carry)) if carry else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _lowered(F.coalesce("text", F.lit(""))).alias("text"), row.alias("row"))
    rows = rows.select(
        "*", F.substring("text", 1, HEAD).alias("head"), F.xxhash64("text").alias("mark"), F.sha2("text", 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("nr"), (F.octet_length("text") + 64).cast("long").alias("size"),
    )
    rows = stored(rows, "contents")  # written once, so numbers of rows hold and later passes read only the columns they need

    heavy = rows.groupBy("mark").agg(F.sum("size").alias("size")).where(F.col("size") > piece_bytes)
    heavy = stored(heavy.select("mark", F.ceil(F.col("size") / piece_bytes).alias("pieces")), "heavy")
    dealt = rows.join(heavy, "mark", "left")
    piece = F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("nr"), "pieces"))
    dealt = dealt.select("doc_id", "text", "row", "head", "mark", "text_sha256", "nr", F.col("pieces").isNotNull().alias("split"), piece.alias("piece"))

    key = ["head", "mark", "piece"]  # every window below holds these columns, so the one exchange serves them all
    sorted_by = W.partitionBy(key).orderBy("text", best("doc_id"), "nr")
    before = F.lag("text").over(sorted_by)
    runs = dealt.repartitionByRange(*key).withColumn("first", before.isNull() | (before != F.col("text")))
    runs = runs.withColumn("run", F.sum(F.col("first").cast("long")).over(sorted_by.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.select("doc_id", "row", *key, "run", "first", "split", "text_sha256", F.when(F.col("split") & F.col("first"), F.col("text")).alias("text"))
    run = W.partitionBy(*key, "run")
    runs = stored(runs.withColumns({"keep_id": of_group("doc_id").over(run), "group_size": F.count("*").over(run)}), "runs")

    whole = runs.where("split and first").select("head", "mark", "piece", "run", "text", "keep_id", "group_size")
    by_text = W.partitionBy("head", "mark").orderBy("text", best("keep_id"), "piece")
    before = F.lag("text").over(by_text)
    whole = whole.withColumn("top", before.isNull() | (before != F.col("text")))
    whole = whole.withColumn("group", F.sum(F.col("top").cast("long")).over(by_text.rowsBetween(W.unboundedPreceding, 0)))
    group = W.partitionBy("head", "mark", "group")
    whole = whole.select(*key, "run", "top", of_group("keep_id").over(group).alias("keep_id"), F.sum("group_size").over(group).alias("group_size"))

    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "row"]
    alone = runs.where("not split").withColumn("kept", F.col("first"))
    parts = runs.where("split").drop("keep_id", "group_size").join(whole, [*key, "run"])
    return alone.select(out).unionAll(parts.withColumn("kept", F.col("first") & F.col("top")).select(out))


def without_copies(docs: DataFrame, keep: str = "smallest", piece_bytes: int = 64 << 20) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they were."""
    return content_groups(docs, keep, tuple(docs.columns), piece_bytes).where("kept").select("row.*")
