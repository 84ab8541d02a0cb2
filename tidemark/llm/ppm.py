"""LM scoring by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts up to ``order`` bytes long, with the counts of the byte that follows.  A byte is
coded in its longest known context; if it never followed that context, an escape goes to the context without its
first byte.  Escapes are estimated by method D (a novel byte takes half a count from itself), and the bytes that a
longer context knew are excluded from the counts of the shorter one.  Below order 0 all bytes are alike.  A text is
preceded by 0xFE bytes and ended by 0xFF, which UTF-8 never contains.  The trie is that of the training documents and
stays as it is while texts are scored, so the code length of a byte follows from the ``order`` bytes before it and
itself, its gram.  A baseline of smoothed word frequencies comes with it.

The trie grows with the corpus and is never in one place.  Documents are dealt to chunks of about ``chunk_bytes``.
Every chunk gives its distinct grams and words with their counts in training texts; these are dealt by the last two
bytes of the context, which keeps a context together with all its longer ones of the same ending (orders 1 and 0 are
a table of 65,536 counts), so a bucket works out the code length of each gram on its own; and the lengths go back to
the chunks that asked.  The texts are shuffled once.  A third pass is not needed, and no task holds more than a chunk
or a bucket; both are bounded in bytes, but for a single document or a single two-byte ending.

Words are known by the 64-bit hashes of their bytes.

Defined cases: a null text is empty and its code is the end alone; a null id counts as the text ``null`` when training
documents are chosen; repeated rows are scored one by one and all learnt from; without training documents all bytes
are alike; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

START, END = b"\xfe", b"\xff"
_U = np.uint64
GRAM, WORD = 0, 1


def is_training(doc_ids: list[int | None]) -> np.ndarray:
    """Documents to learn from: the crc32 of the id as text, modulo ten, is not zero."""
    return np.array([crc32(str(x if x is not None else "null").encode()) % 10 != 0 for x in doc_ids], bool)


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all texts, one for each byte and one for each end, and where each text begins among them."""
    joined = START * order + (END + START * order).join(texts) + END
    codes = np.frombuffer(joined, np.uint8)
    packed = np.zeros(len(codes) - order, _U)
    for k in range(order + 1):
        packed = (packed << _U(8)) | codes[k : k + len(packed)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.cumsum(sizes) - sizes
    at = starts + order * np.arange(len(texts))  # the fillers between two texts are no grams
    keep = np.repeat(at - starts, sizes) + np.arange(sizes.sum())
    return packed[keep], starts


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts and how many each text has."""
    split = [t.split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    return np.fromiter((xxh64_intdigest(w) for t in split for w in t), _U, int(sizes.sum())), sizes


def _tail(packed: np.ndarray, order: int) -> np.ndarray:
    return packed & _U((1 << 8 * (order + 1)) - 1)


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return at, sorted_[at] == wanted


@dataclass(frozen=True)
class Level:
    """The counts of one order: grams, their contexts with totals, and what longer contexts exclude."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray

    @staticmethod
    def of(known: np.ndarray, counts: np.ndarray, order: int) -> Level:
        own, of = np.unique(_tail(known, order), return_inverse=True)
        sums = np.bincount(of, counts, len(own))
        contexts, inside = np.unique(own >> _U(8), return_inverse=True)
        return Level(own, sums, contexts, np.bincount(inside, sums, len(contexts)), np.bincount(inside, minlength=len(contexts)).astype(float))

    def excluded(self, longer: Level, order: int) -> tuple[np.ndarray, np.ndarray]:
        """For every context of ``longer``: the count here of the bytes that it knows, and how many those are."""
        at, _ = _find(self.grams, _tail(longer.grams, order))
        _, inside = np.unique(longer.grams >> _U(8), return_inverse=True)
        return np.bincount(inside, self.counts[at], len(longer.contexts)), longer.kinds


def levels(known: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int) -> list[Level]:
    """The orders from ``order`` down to 0; ``pairs`` counts bytes by the byte before, over all training texts.

    Between the longest contexts and order 1 a byte counts once for every longer context that it follows (update
    exclusion): what a longer context has coded does not teach the shorter ones again.
    """
    before, byte = np.nonzero(pairs)
    two = (before.astype(_U) << _U(8)) | byte.astype(_U)
    high = [Level.of(known, counts.astype(float), order)] if order > 1 else []
    for k in range(order - 1, 1, -1):
        high.append(Level.of(high[-1].grams, np.ones(len(high[-1].grams)), k))
    return high + [Level.of(two, pairs[before, byte].astype(float), k) for k in range(min(order, 1), -1, -1)]


def log_probabilities(asked: np.ndarray, trie: list[Level]) -> np.ndarray:
    """log10 of the probability of the last byte of each gram."""
    total, done = np.zeros(len(asked)), np.zeros(len(asked), bool)
    longer: Level | None = None
    for order, level in zip(range(len(trie) - 1, -1, -1), trie):
        gram = _tail(asked, order)
        at, seen = _find(level.contexts, gram >> _U(8))
        n, kinds = (np.where(seen, x[at], 0.0) if len(x) else np.zeros(len(asked)) for x in (level.totals, level.kinds))
        if longer is not None and len(longer.grams):
            at, there = _find(longer.contexts, _tail(asked, order + 1) >> _U(8))
            for left, gone in ((n, 0), (kinds, 1)):
                left -= np.where(there, level.excluded(longer, order)[gone][at], 0.0)
        at, hit = _find(level.grams, gram)
        usable = ~done & (kinds > 0)
        hit &= usable
        if hit.any():
            total[hit] += np.log10((2 * level.counts[at[hit]] - 1) / (2 * n[hit]))
        miss = usable & ~hit
        total[miss] += np.log10(kinds[miss] / (2 * n[miss]))
        done |= hit
        longer = level
    left = 256 - (len(trie[-1].grams) if trie else 0)
    total[~done] -= np.log10(max(left, 1))
    return total


def _read(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[list, list[bytes], np.ndarray]]:
    """Parts of a table of about a MB: ids, texts in lower case, which of them are for training."""
    ids, texts = batch["doc_id"].to_pylist(), batch["text"]
    first = 0
    while first < len(ids):
        part, size, last = [], 0, first
        while last < len(ids) and size < 1_000_000:
            part.append((texts[last].as_py() or "").encode().lower())
            size += len(part[-1])
            last += 1
        yield ids[first:last], part, is_training(ids[first:last])
        first = last


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted array of keys with summed counts."""
    if not parts:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    keys, of = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(of, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _counted(packed: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all texts with their counts in training texts."""
    keys, counts = np.unique(packed[training], return_counts=True)
    rest = np.unique(packed[~training])
    return _merged([(keys, counts), (rest, np.zeros(len(rest), np.int64))])


def _facts(docs: DataFrame) -> tuple[np.ndarray, int, int, int]:
    """Counts of byte pairs, of words and of distinct words in training texts, and the bytes of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, size, known = np.zeros(65_536, np.int64), 0, 0, []
        for batch in batches:
            for _, texts, training in _read(batch):
                size += sum(map(len, texts))
                learnt = [t for t, use in zip(texts, training) if use]
                if learnt:
                    pairs += np.bincount(grams(learnt, 1)[0].astype(np.int64), minlength=65_536)
                    hashes, sizes = words(learnt)
                    n += len(hashes) + len(sizes)
                    known.append(np.unique(hashes))
            known = [np.unique(np.concatenate(known))] if known else []
        distinct = known[0] if known else np.zeros(0, _U)
        at = np.flatnonzero(pairs)
        kind = np.repeat(np.array([0, 1, 2, 3], np.int32), [len(at), len(distinct), 1, 1])
        key = np.concatenate([at, distinct.view(np.int64), [0, 0]])
        count = np.concatenate([pairs[at], np.zeros(len(distinct), np.int64), [n, size]])
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), pa.array(count)], ["kind", "key", "n"])

    rows = docs.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    facts = rows.groupBy("kind", F.when(F.col("kind") == 1, 0).otherwise(F.col("key")).alias("key")).agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()
    pairs = np.zeros((256, 256), np.int64)
    found = {2: 0, 3: 0, 1: 0}
    for r in facts:  # at most 65,536 pairs and three more
        if r["kind"] == 0:
            pairs[r["key"] >> 8, r["key"] & 255] = r["n"]
        else:
            found[r["kind"]] = r["rows"] if r["kind"] == 1 else r["n"]
    return pairs, found[2], found[1] + (found[2] > 0), found[3]  # the end is a token of its own


def scores(docs: DataFrame, order: int = 5, chunk_bytes: int = 32_000_000, bucket_bytes: int = 6_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pairs, train_tokens, vocabulary, size = _facts(docs)
    chunks, buckets = 1 + size // chunk_bytes, 1 + size // bucket_bytes
    rest = np.log10(train_tokens + 0.1 * (vocabulary + 1))

    def gather(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        found: dict[int, list] = {GRAM: [], WORD: []}
        for _, texts, training in _read(table):
            packed, starts = grams(texts, order)
            lengths = np.diff(starts, append=len(packed))
            found[GRAM].append(_counted(packed, np.repeat(training, lengths)))
            hashes, sizes = words(texts)
            found[WORD].append(_counted(hashes, np.repeat(training, sizes)))
            for kind, parts in found.items():
                if len(parts) > 8:
                    found[kind] = [_merged(parts)]
        out = []
        for kind, parts in found.items():
            keys, counts = _merged(parts)
            by = keys if kind == WORD else ((keys >> _U(8)) & _U(0xFFFF)) * _U(0x9E3779B97F4A7C15) >> _U(20)
            out.append(pa.table({"who": np.full(len(keys), 2 * chunk + kind, np.int32), "key": keys.view(np.int64), "n": counts, "bucket": (by % _U(buckets)).astype(np.int32)}))
        return pa.concat_tables(out)

    def answer(table: pa.Table) -> pa.Table:
        who, keys, n = (table[x].to_numpy() for x in ("who", "key", "n"))
        keys, value = keys.view(_U), np.zeros(len(keys))
        is_word = who % 2 == WORD
        _, of = np.unique(keys[is_word], return_inverse=True)
        value[is_word] = np.log10(np.bincount(of, n[is_word])[of] + 0.1) if len(of) else 0.0
        distinct, of = np.unique(keys[~is_word], return_inverse=True)
        if len(distinct):
            counts = np.bincount(of, n[~is_word], len(distinct))
            value[~is_word] = log_probabilities(distinct, levels(distinct[counts > 0], counts[counts > 0], pairs, order))[of]
        return pa.table({"chunk": (who // 2).astype(np.int32), "kind": (who % 2).astype(np.int32), "key": keys.view(np.int64), "value": value})

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        kind, keys, value = known["kind"].to_numpy(), known["key"].to_numpy().view(_U), known["value"].to_numpy()
        tables = {}
        for k in (GRAM, WORD):
            order_ = np.argsort(keys[kind == k])
            tables[k] = keys[kind == k][order_], value[kind == k][order_]
        out = []
        for ids, part, training in _read(texts):
            packed, starts = grams(part, order)
            model = np.add.reduceat(tables[GRAM][1][np.searchsorted(tables[GRAM][0], packed)], starts)
            hashes, sizes = words(part)
            of = np.repeat(np.arange(len(part)), sizes)
            single = tables[WORD][1][np.searchsorted(tables[WORD][0], hashes)] if len(hashes) else np.zeros(0)
            known_words = np.bincount(of, single > -0.5, len(part)).astype(np.int64) + (train_tokens > 0)
            ends = np.log10(pairs[:, END[0]].sum() + 0.1)  # as many ends as training documents
            base = np.bincount(of, single, len(part)) + ends - (sizes + 1) * rest
            out.append(pa.table({
                "doc_id": pa.array(ids, pa.int64()), "held_out": ~training, "n_tokens": sizes + 1, "n_known": known_words,
                "train_tokens": np.full(len(part), train_tokens, np.int64), "base_score": base, "score": model,
            }))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in RESULT.items()})

    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).repartition(int(chunks), "chunk")
    wanted = dealt.groupBy("chunk").applyInArrow(gather, "who int, key long, n long, bucket int")
    lengths = wanted.groupBy("bucket").applyInArrow(answer, "chunk int, kind int, key long, value double")
    return dealt.groupBy("chunk").cogroup(lengths.groupBy("chunk")).applyInArrow(score, ", ".join(f"{n} {SQL[t]}" for n, t in RESULT.items()))


RESULT = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
SQL = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}
