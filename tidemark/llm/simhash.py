"""SimHash near-duplicates by pigeonring filtering.

A document's fingerprint has 64 bits: a bit is set if it is set in over half of the hashes of the document's word
shingles.  Fingerprints with at most three differing bits are linked, and linked documents form components.

Candidates come from chains of segments.  Cut a pair's 64 bits into a ring of eight segments.  If at most three bits
differ in all, some start exists from which every chain of l consecutive segments holds at most 3 l / 8 differing
bits.  So from that start two segments agree, five hold at most one difference and seven at most two.  The five are
the key: at most one of its last three segments may differ, so a fingerprint is filed under 8 starts x 3 wild
segments, each key being 32 agreeing bits.  Within a bucket the longer chains are checked before the full distance.

A bucket of more than ``bucket_rows`` fingerprints is filed anew: its free bits are cut in four, of which three
differences leave one untouched, so the members go to four finer keys each.  When at most 13 bits are free a bucket
cannot hold over 8,192 fingerprints.  Nothing is dropped, no bucket grows without bound, and within a bucket links are
found from one member to all that are not yet reached, so a dense group costs few comparisons and yields a tree of
links, not all pairs.  Documents with the same fingerprint are one row during the search.

Defined cases: a null text is empty; a text without words has fingerprint zero; texts of fewer words than a shingle
are one shingle; repeated rows get one row each; rows without an id get the component of their fingerprint, whose id
is the smallest known one; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import components, per_batch, stored, utf8

BITS, SEGMENTS, SEED, DISTANCE = 64, 8, 42, 3
_ALL = 2**64 - 1
_BITS_OF = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle_words: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle_words + 1].tolist()
    hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, (ends[shingle_words - 1 :] - 1).tolist())], np.uint64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS_OF for k in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number, one row for each row of ``docs``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, shingle_words) for t in utf8(batch["text"])], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(found)], ["doc_id", "fp"])

    return per_batch(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >> 63 else mask


def _segment(k: int) -> int:
    return 0xFF << 8 * (k % SEGMENTS)


#: (start of the chain, mask of the bits that agree)
KEYS = [(i, _segment(i) | _segment(i + 1) | sum(_segment(i + k) for k in (2, 3, 4) if k != wild)) for i in range(SEGMENTS) for wild in (2, 3, 4)]


def _finer(start: int, mask: int) -> list[tuple[int, int]]:
    """Four masks of which one holds only agreeing bits, whatever three of the free bits differ."""
    free = [b for k in range(BITS) if not mask >> (b := (8 * start + k) % BITS) & 1]
    return [(start, mask | sum(1 << b for b in free[k * len(free) // 4 : (k + 1) * len(free) // 4])) for k in range(4)]


def _near(differing: np.ndarray, start: int) -> np.ndarray:
    """Whether the chains from ``start`` stay within their budgets, the whole ring last."""
    turn = np.uint64(8 * start)
    ring = (differing >> turn) | (differing << (np.uint64(64) - turn)) if start else differing
    near = np.bitwise_count(ring & np.uint64(2**40 - 1)) <= 1
    near[near] = np.bitwise_count(ring[near] & np.uint64(2**56 - 1)) <= 2
    near[near] = np.bitwise_count(ring[near]) <= DISTANCE
    return near


def bucket_links(members: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links that connect all members of a bucket which can reach each other."""
    links, rest = [], np.unique(members.view(np.uint64))
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            one = todo.pop()
            near = _near(rest ^ one, start)
            if near.any():
                found = rest[near]
                links += [(one, x) for x in found]
                todo += list(found)
                rest = rest[~near]
    return links


def _filed(fps: DataFrame, keys: list[tuple[int, int]]) -> DataFrame:
    options = F.array(*(F.struct(F.lit(s).alias("start"), F.lit(_signed(m)).alias("mask")) for s, m in keys))
    filed = fps.select("fp", F.explode(options).alias("key")).select("fp", "key.start", "key.mask")
    return filed.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))


def links(fps: DataFrame, bucket_rows: int = 1_024) -> DataFrame:
    """(a, b): links among the distinct fingerprints ``fps`` (fp) that connect every two at distance three or less."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = [], []
        for start, members in zip(batch["start"].to_pylist(), batch["members"]):
            for x, y in bucket_links(members.values.to_numpy(zero_copy_only=False), start):
                a.append(x)
                b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])

    key, found, keys = ["start", "mask", "value"], [], KEYS
    filed = _filed(fps, keys)
    while True:
        sizes = filed.groupBy(key).count()
        bounded = max(BITS - m.bit_count() for _, m in keys) <= 13
        large = None if bounded else stored(sizes.where(F.col("count") > bucket_rows).drop("count"), "large")
        if large is not None and large.isEmpty():
            large = None
        small = filed.join(large, key, "left_anti") if large is not None else filed
        buckets = small.groupBy(key).agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
        found.append(per_batch(buckets.select("start", "members"), run, "a long, b long"))
        if large is None:
            return reduce(DataFrame.unionAll, found).distinct()
        finer = {k: _finer(*k) for k in keys}
        table = [(s, _signed(m), _signed(c)) for (s, m), children in finer.items() for _, c in children]  # at most 24 * 4^3 rows
        children = fps.sparkSession.createDataFrame(table, "start int, mask long, child long")
        filed = filed.join(large, key).join(F.broadcast(children), ["start", "mask"])
        filed = filed.select("fp", "start", F.col("child").alias("mask"), F.col("fp").bitwiseAND(F.col("child")).alias("value"))
        keys = [c for children in finer.values() for c in children]


def near_duplicates(docs: DataFrame, shingle_words: int = 3, bucket_rows: int = 1_024) -> DataFrame:
    """(doc_id, fingerprint, component_id): the component's id is its smallest doc_id."""
    marked = stored(fingerprints(docs, shingle_words), "fingerprints")
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(fps.select("fp"), bucket_rows)).select(F.col("node").alias("fp"), "root")
    rooted = fps.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    out = marked.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id names their component, once each; rows without an id are not compared and stay."""
    named = docs.where("doc_id is not null")
    found = stored(near_duplicates(named, shingle_words).where("doc_id = component_id").groupBy("doc_id").count(), "kept")
    kept = named.join(found.select("doc_id"), "doc_id", "left_semi")
    if not found.where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))
