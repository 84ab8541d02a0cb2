"""Quality rules: an isolation forest over rule statistics, with a threshold calibrated on labelled rows.

Every document gets a vector of statistics (``STATISTICS``).  Trees cut a random statistic at a random value, so
documents with unusual statistics are alone after few cuts; the mean path length over all trees is the score.  Every
good labelled document counts in every tree: where the trees cut follows from the ranges of the statistics alone, and
tasks count the documents in their cells.  The threshold is the lowest score that at most ``clean_loss`` of all good
labelled documents exceed, found exactly.  The driver holds ranges and counts by cell, never documents.  Statistics,
scores and verdicts cover all documents and whole texts.

Two plain rules go first and do not depend on the fit: fewer than ten words, or over a fifth of the words in
five-word windows that the text repeats.

Defined cases: a null text is the empty text and fails the base rule; null ids get a row like any other; repeated
rows get one row each; without labelled rows there is no forest, and a document is kept if it passes the base
rules; an empty table gives an empty result.  Other columns are not looked at, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, per_batch, stored, utf8

SYMBOLS = b"#*$%&|<>"
UPPER, LOWER, DIGITS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:!?"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATISTICS = ["symbol_share", "mark_share", "upper_share", "digit_share", "same_as_last_share"]
CONTINUED = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no character
_ODD = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], hashes: np.ndarray, width: int = 5) -> int:
    """How many words lie in windows of ``width`` words that the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = np.zeros(n, np.uint64)
    for k in range(width):
        windows = (windows * _ODD) ^ hashes[k : k + n]
        windows ^= windows >> np.uint64(29)
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(windows, twice))
    seen: dict[tuple, list[int]] = {}
    for i in at.tolist():  # equal hashes are only a hint
        seen.setdefault(tuple(words[i : i + width]), []).append(i)
    starts = np.array([i for same in seen.values() if len(same) > 1 for i in same], np.int64)
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + width, -1)
    return int((np.cumsum(inside)[:-1] > 0).sum())


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def measure(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The counts and the statistics of whole texts, one row each.  Statistics are roots of shares; the constants in
    the denominators damp those of short texts."""
    counts, stats = np.zeros((len(texts), len(COUNTS)), np.int64), np.zeros((len(texts), len(STATISTICS)))
    for row, text in enumerate(texts):
        words = text.split()
        n = len(words)
        if not n:
            continue
        hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        chars = len(text) - _count(text, SPACE) - (0 if text.isascii() else _count(text, CONTINUED))
        lines = [x for x in text.split(b"\n") if x.strip()]
        symbols, repeats = _count(text, SYMBOLS), repeated_words(words, hashes)
        upper = _count(text, UPPER)
        counts[row] = n, chars, symbols, len(lines) - len(set(lines)), repeats
        letters = upper + _count(text, LOWER)
        same = (hashes[1:] == hashes[:-1]).sum()
        stats[row] = symbols / chars, _count(text, MARKS) / (chars + 200), upper / (letters + 200), _count(text, DIGITS) / (chars + 500), same / (n + 50)
    return counts, np.sqrt(stats)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])


def _path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def _depth(n: int, most: int) -> int:
    """Levels that can tell n rows apart."""
    return min(most, math.ceil(math.log2(max(n, 2))))


@dataclass(frozen=True)
class IsolationForest:
    """Trees as heaps: node i has the children 2i+1 and 2i+2; ``feature`` is -1 at a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    length: np.ndarray
    unit: float

    @staticmethod
    def grow(low: np.ndarray, high: np.ndarray, trees: int = 200, depth: int = 8, seed: int = 7) -> IsolationForest:
        """Trees cut down to ``depth`` everywhere, before any row is seen.  Cuts are uniform over the cell of a node;
        the root's cell goes from ``low`` to ``high``.  Without a statistic that varies, a tree is a single leaf."""
        random = np.random.RandomState(seed)
        wide = np.flatnonzero(high > low)
        depth = depth if len(wide) else 0
        feature, cut, length = (np.full((trees, 2 ** (depth + 1) - 1), x) for x in (-1, 0.0, 0.0))
        cells = np.broadcast_to([low, high], (trees, 1, 2, len(low)))
        for level in range(depth):
            at = slice(2**level - 1, 2 ** (level + 1) - 1)
            f = random.choice(wide, (trees, 2**level))
            least, most = (np.take_along_axis(cells[:, :, side], f[..., None], 2)[..., 0] for side in (0, 1))
            feature[:, at], cut[:, at] = f, random.uniform(least, most)
            cells = np.repeat(cells, 2, 1)  # a new array; even cells end at the cut, odd ones begin there
            for child, side in ((0, 1), (1, 0)):
                np.put_along_axis(cells[:, child::2, side], f[..., None], cut[:, at, None], 2)
        return IsolationForest(feature, cut, length, 1.0)

    @property
    def depth(self) -> int:
        return int(np.log2(self.feature.shape[1] + 1)) - 1

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """How many rows come by each node of each tree."""
        out, at_row = np.zeros(self.feature.shape, np.int64), np.arange(len(rows))
        for t in range(len(self.feature)):
            node = np.zeros(len(rows), np.int64)
            for level in range(self.depth + 1):
                if level:
                    node = 2 * node + 1 + (rows[at_row, self.feature[t, node]] >= self.cut[t, node])
                out[t] += np.bincount(node, minlength=out.shape[1])
        return out

    def settled(self, counts: np.ndarray) -> IsolationForest:
        """Leaves are the nodes that fewer than two rows come by, and those of the last level.  A cell without rows
        ends its branch, so what lies away from all rows has a short path, also where the rows are constant."""
        level = np.floor(np.log2(np.arange(self.feature.shape[1]) + 1))
        leaf = (counts < 2) | (level == self.depth)
        length = np.where(leaf, level + _path(counts), 0.0)
        return replace(self, feature=np.where(leaf, -1, self.feature), length=length, unit=float(_path(counts[0, 0])) or 1.0)

    @staticmethod
    def fit(rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = 200, depth: int = 8, seed: int = 7) -> IsolationForest:
        """The forest of rows that are at hand; ``fit_rules`` does the same for a table."""
        forest = IsolationForest.grow(low, high, trees, _depth(len(rows), depth), seed)
        return forest.settled(forest.counts(rows))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the shorter the mean path, the higher."""
        total, at_row = np.zeros(len(rows)), np.arange(len(rows))
        for t in range(len(self.feature)):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, node]
                right = rows[at_row, f] >= self.cut[t, node]
                node = np.where(f < 0, node, 2 * node + 1 + right)
            total += self.length[t, node]
        return 2.0 ** (-total / len(self.feature) / self.unit)


@dataclass(frozen=True)
class RuleModel:
    forest: IsolationForest | None
    threshold: float

    def verdicts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counts, base failures, anomaly scores and what is kept."""
        counts, stats = measure(texts)
        failed = base_failed(counts)
        scores = self.forest.score(stats) if self.forest and len(texts) else np.zeros(len(texts))
        return counts, failed, scores, ~failed & (scores <= self.threshold)


def labelled_statistics(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, quality, failed, statistics...): every labelled document once.  Texts are measured where they are read;
    only statistics are shuffled.  Of rows with the same id the smallest statistics count."""
    quality = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    schema = "doc_id long, failed boolean, " + ", ".join(f"{x} double" for x in STATISTICS)

    def statistics(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, stats = measure(utf8(batch["text"]))
        return pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(base_failed(counts)), *map(pa.array, stats.T.copy())], ["doc_id", "failed", *STATISTICS])

    measured = per_batch(docs.select("doc_id", "text").where("doc_id is not null"), statistics, schema)
    once = measured.groupBy("doc_id").agg(F.min(F.struct("failed", *STATISTICS)).alias("of"))
    return quality.join(once, "doc_id").select("doc_id", "quality", "of.*")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch[x].to_numpy(zero_copy_only=False) for x in STATISTICS])


def cell_counts(rows: DataFrame, forest: IsolationForest) -> np.ndarray:
    """How many of all rows come by each node of each tree.  Each task adds up its own rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((forest.counts(_matrix(batch)) for batch in batches if batch.num_rows), np.zeros(forest.feature.shape, np.int64))
        tree, node = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(node.astype(np.int32)), pa.array(total[tree, node])], ["tree", "node", "n"])

    found = rows.select(*STATISTICS).mapInArrow(count, "tree int, node int, n long").groupBy("tree", "node").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(forest.feature.shape, np.int64)  # as large as the forest, whatever the rows
    out[found.tree.to_numpy(), found.node.to_numpy()] = found.n.to_numpy()
    return out


def nth_smallest(rows: DataFrame, column: str, n: int, parts: int = 1024) -> float:
    """The value of 0-based rank ``n``.  Each pass counts the rows in ``parts`` equal parts of the range that holds it."""
    v = F.col(column)
    low, high, below = *rows.agg(F.min(v), F.max(v)).first(), 0
    while low < high:
        part = F.least(F.floor((v - F.lit(low)) / F.lit(high - low) * parts), F.lit(parts - 1))
        found = rows.where(v.between(low, high)).groupBy(part.alias("part")).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("n"))
        for x in sorted(found.collect()):  # at most ``parts`` rows
            low, high = x["low"], x["high"]
            if below + x["n"] > n:
                break
            below += x["n"]
    return low


def fit_rules(docs: DataFrame, labels: DataFrame, clean_loss: float = 0.003, trees: int = 200) -> RuleModel:
    """Fit forest and threshold on all labelled documents.

    Only documents that pass the base rules count.  A good row is one labelled quality 1.  The forest sees good rows
    alone: what it isolates is what good documents do not look like.
    """
    passed = stored(labelled_statistics(docs, labels).where("not failed").drop("failed"), "labelled")
    good = passed.where("quality = 1")
    n = good.count()
    if n < 2:
        return RuleModel(None, 1.0)
    ranges = passed.agg(*map(F.min, STATISTICS), *map(F.max, STATISTICS)).first()
    low, high = np.array(ranges, float).reshape(2, -1)
    forest = IsolationForest.grow(low, high, trees, _depth(n, 8))
    forest = forest.settled(cell_counts(good, forest))
    scores = stored(per_batch(good.select(*STATISTICS), lambda batch: pa.RecordBatch.from_arrays([pa.array(forest.score(_matrix(batch)))], ["score"]), "score double"), "scores")
    return RuleModel(forest, nth_smallest(scores, "score", math.ceil((n - 1) * (1 - clean_loss))))


def rule_verdicts(docs: DataFrame, model: RuleModel) -> DataFrame:
    """(doc_id, counts..., base_failed, anomaly_score, kept): one row for each row of ``docs``."""
    schema = "doc_id long, " + ", ".join(f"{x} long" for x in COUNTS) + ", base_failed boolean, anomaly_score double, kept boolean"

    def verdicts(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, failed, scores, kept = model.verdicts(utf8(batch["text"]))
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"].cast(pa.int64()), *map(pa.array, counts.T.copy()), pa.array(failed), pa.array(scores), pa.array(kept)],
            ["doc_id", *COUNTS, "base_failed", "anomaly_score", "kept"],
        )

    return per_batch(docs.select("doc_id", "text"), verdicts, schema)


def passing(docs: DataFrame, model: RuleModel) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep."""
    at = docs.columns.index("text")
    return per_batch(docs, lambda batch: batch.filter(pa.array(model.verdicts(utf8(batch.column(at)))[3])), docs.schema)
