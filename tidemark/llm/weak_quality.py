"""Quality classifier: overlapping heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer.

There are two targets, each with its own labellers: ``junk`` (repetition, symbols, shouting, lists) and ``toxic``
(terms of abuse).  A labeller fires or not.  How often every pattern of firing labellers occurs is counted over all
documents; there are at most 2^labellers patterns, whatever the size of the input.  Expectation-maximisation over the
patterns gives every labeller's rate among bad and good documents and the posterior of every pattern.  The posteriors
label a sample of at most ``sample_rows`` documents (the smallest hashes of their ids), on which a linear scorer over
hashed words, word shapes and binned shares is trained for each target.  The scorers see whole texts of all documents.

Two of the labellers of ``toxic`` know terms that are common in documents labelled toxic and rare in others; they are
read from at most ``labelled_rows`` labelled documents.

Defined cases: a null or empty text fires nothing, has no features but the constant one, and is kept unless the
scorers say otherwise of it; null ids and repeated rows get a row each; without labels the learned labellers never
fire; where no labeller fires at all everything is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cached_property
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import per_batch, stored, utf8

#: Common English terms of abuse, in two overlapping lists.
ABUSE_A = frozenset([b"idiot", b"stupid", b"moron", b"loser", b"pathetic", b"worthless", b"dumb"])
ABUSE_B = frozenset([b"scum", b"trash", b"clown", b"disgusting", b"worthless", b"stupid", b"filth", b"pathetic"])
EDGES = b".,;:!?\"'()#*$%&|<>"
BINS = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
#: The shares above which the labellers of ``junk`` fire, in their order.
LIMITS = np.array([0.15, 0.85, 0.1, 0.03, 0.6, 0.3, 0.1, 0.3])
_SPACE, _SYMBOL = (np.isin(np.arange(256), list(x)) for x in (b" \t\n\x0b\x0c\r", b"#*$%&|<>"))
TARGETS = {
    "junk": ["repeats_last", "repeats_any", "symbol_ends", "symbol_density", "capitals", "bangs", "bars", "bar_lines"],
    "toxic": ["abuse_a", "abuse_b", "learned_a", "learned_b"],
}
LABELLERS = [x for labellers in TARGETS.values() for x in labellers]


def look(text: bytes) -> tuple[np.ndarray, set[bytes]]:
    """Eight shares, one for each labeller of ``junk``, and the distinct words in lower case without punctuation.

    The shares: words equal to the word before, words that are no first occurrence, words that end in a symbol,
    symbols, capitals, words that end in an exclamation mark, words that are a bar, lines with two bars or more.
    """
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(8), set()
    hashes = np.fromiter(map(hash, words), np.int64, n)
    codes = np.frombuffer(text + b" ", np.uint8)
    before_space = codes[:-1][_SPACE[codes[1:]]]
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    letters = upper + len(text) - len(text.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    bars, barred = 0, 0.0
    if b"|" in text:
        lines = text.split(b"\n")
        bars, barred = words.count(b"|"), sum(x.count(b"|") >= 2 for x in lines) / len(lines)
    shares = np.array([
        (hashes[1:] == hashes[:-1]).sum() / (n + 10), (n - len(np.unique(hashes))) / (n + 10), _SYMBOL[before_space].sum() / (n + 10),
        _SYMBOL[codes].sum() / (len(text) + 50), upper / (letters + 40), (before_space == 33).sum() / (n + 10), bars / (n + 10), barred,
    ])
    return shares, set(text.lower().translate(None, EDGES).split())


@dataclass(frozen=True)
class Terms:
    """Terms of abuse read from labelled documents, in two halves that know them independently."""

    a: frozenset = frozenset()
    b: frozenset = frozenset()

    @cached_property
    def every(self) -> frozenset:
        return self.a | self.b | ABUSE_A | ABUSE_B


def votes(shares: np.ndarray, words: set[bytes], terms: Terms) -> int:
    """The firing labellers as bits: ``junk`` first, then ``toxic``."""
    bits = int(((shares > LIMITS) << np.arange(8)).sum())
    hits = words & terms.every
    if hits:
        bits |= sum((not hits.isdisjoint(known)) << (8 + k) for k, known in enumerate((ABUSE_A, ABUSE_B, terms.a, terms.b)))
    return bits


def fit_terms(docs: DataFrame, labels: DataFrame, labelled_rows: int = 16_384, least_share: float = 0.015, times: float = 20.0) -> Terms:
    """Words in ``least_share`` of the toxic labelled documents and ``times`` as common there as in the others."""
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most labelled_rows ids

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = Counter()
        for text, toxic, half in zip(utf8(batch["text"]), batch["toxic"].to_pylist(), batch["half"].to_pylist()):
            counts.update((half, toxic == 1, w) for w in look(text)[1] | {b""})  # the empty word counts documents
        half, toxic, words = zip(*counts) if counts else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(half, pa.int32()), pa.array(toxic, pa.bool_()), pa.array(words, pa.binary()), pa.array(counts.values(), pa.int64())], ["half", "toxic", "word", "n"],
        )

    pivot = [F.sum(F.when(F.col("toxic") == bad, F.col("n")).otherwise(0)).alias(name) for bad, name in ((True, "bad"), (False, "good"))]
    counts = per_batch(rows, counted, "half int, toxic boolean, word binary, n long").groupBy("half", "word").agg(*pivot)
    counts = stored(counts.where("bad >= 3"), "terms")
    found = {0: [], 1: []}
    sizes = {r["half"]: (max(r["bad"], 1), max(r["good"], 1)) for r in counts.where("word = X''").collect()}
    for half, (bad, good) in sizes.items():
        hit = (F.col("half") == half) & (F.col("bad") >= least_share * bad) & (F.col("bad") / bad > times * (F.col("good") + 0.5) / good)
        found[half] = [bytes(r["word"]) for r in counts.where(hit).orderBy(F.desc("bad"), "word").limit(1000).collect()]  # a report of the strongest
    return Terms(frozenset(found[0]), frozenset(found[1]))


def label_model(patterns: np.ndarray, weights: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over counted patterns (rows of 0/1 by labeller).

    Gives the posterior of being bad for every pattern, and every labeller's rate of firing among bad and good.
    """
    fires = patterns.astype(float)
    bad = (fires.sum(1) > 0) * 0.9 + 0.01
    if not len(fires) or not fires.any():
        return np.zeros(len(fires)), np.zeros(fires.shape[1]), np.zeros(fires.shape[1])
    for _ in range(rounds):
        w1, w0 = weights * bad, weights * (1 - bad)
        rate1 = np.clip((w1 @ fires + 0.1) / (w1.sum() + 0.2), 1e-4, 1 - 1e-4)
        rate0 = np.clip((w0 @ fires + 0.01) / (w0.sum() + 1.0), 1e-6, 0.5)
        prior = np.clip(w1.sum() / weights.sum(), 1e-4, 0.5)
        odds = np.log(prior / (1 - prior)) + fires @ np.log(rate1 / rate0) + (1 - fires) @ np.log((1 - rate1) / (1 - rate0))
        bad = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return bad, rate1, rate0


def features(shares: np.ndarray, words: set[bytes], bits: int) -> np.ndarray:
    """Hashed features: the distinct words, the shares as the bins that they reach, and a constant one."""
    hashed = {crc32(w) for w in words}
    hashed.update(crc32(b"share %d above %d" % (k, b)) for k, x in enumerate(shares) for b in range(int(np.searchsorted(BINS, x))))
    hashed.add(crc32(b"constant feature"))
    return np.unique(np.fromiter(hashed, np.int64, len(hashed)) & (2**bits - 1))


def fit_linear(rows: list[np.ndarray], target: np.ndarray, bits: int, epochs: int = 8, rate: float = 0.3, sparse: float = 2e-4, seed: int = 3) -> np.ndarray:
    """Logistic regression with soft targets: adaptive steps on small batches, with an absolute penalty."""
    weights, squares = np.zeros(2**bits), np.full(2**bits, 1e-8)
    random = np.random.RandomState(seed)
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for first in range(0, len(order), 256):
            part = order[first : first + 256]
            at = np.concatenate([rows[i] for i in part])
            of = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            z = np.bincount(of, weights[at], len(part))
            error = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target[part]
            slope = np.bincount(at, error[of], 2**bits) / len(part)
            squares += slope**2
            step = rate / np.sqrt(squares)
            moved = weights - step * slope
            touched = slope != 0
            weights = np.where(touched, np.sign(moved) * np.maximum(np.abs(moved) - step * sparse, 0), weights)
    return weights


@dataclass(frozen=True)
class QualityModel:
    terms: Terms
    bits: int
    weights: dict[str, np.ndarray]
    rates: dict[str, dict[str, tuple[float, float]]]

    def badness(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """The probability of being bad by each target."""
        return self.scores([features(*look(t), self.bits) for t in texts])

    def scores(self, rows: list[np.ndarray]) -> dict[str, np.ndarray]:
        out = {}
        for name, w in self.weights.items():
            z = np.array([w[r].sum(dtype=float) for r in rows], float)
            out[name] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        return out

    def kept(self, texts: list[bytes]) -> np.ndarray:
        return np.all([x < 0.5 for x in self.badness(texts).values()], axis=0) if len(texts) else np.zeros(0, bool)


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, bits: int = 18) -> QualityModel:
    """Count patterns over all documents, estimate the labellers, and train the scorers on the posterior labels."""
    terms = fit_terms(docs, labels)

    def fired(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([votes(*look(t), terms) for t in utf8(batch["text"])], pa.int32())], ["bits"])

    counted = {r["bits"]: r["count"] for r in per_batch(docs.select("text"), fired, "bits int").groupBy("bits").count().collect()}
    patterns, weights = np.array(sorted(counted), np.int64), np.array([counted[k] for k in sorted(counted)], float)
    posterior, rates, first = {}, {}, 0
    for name, labellers in TARGETS.items():
        own = (patterns[:, None] >> np.arange(first, first + len(labellers))) & 1
        bad, rate1, rate0 = label_model(own, weights)
        posterior[name] = dict(zip(patterns.tolist(), bad.tolist()))
        rates[name] = {x: (float(p), float(q)) for x, p, q in zip(labellers, rate1, rate0)}
        first += len(labellers)

    ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most sample_rows ids

    def gathered(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = [look(t) for t in utf8(batch["text"])]
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"].cast(pa.int64()), pa.array([votes(*x, terms) for x in seen], pa.int32()), pa.array([features(*x, bits).astype(np.int32).tobytes() for x in seen], pa.binary())],
            ["doc_id", "bits", "features"],
        )

    rows = per_batch(sample, gathered, "doc_id long, bits int, features binary").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    at = [np.frombuffer(x, np.int32).astype(np.int64) for x in rows.features]
    trained = {name: fit_linear(at, np.array([posterior[name].get(x, 0.0) for x in rows.bits]), bits).astype(np.float32) for name in TARGETS}
    return QualityModel(terms, bits, trained, rates)


def quality_verdicts(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, junk_score, toxic_score, fired, kept): one row for each row of ``docs``."""

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = [look(t) for t in utf8(batch["text"])]
        bad = model.scores([features(*x, model.bits) for x in seen])
        fired = [[name for k, name in enumerate(LABELLERS) if v >> k & 1] for v in (votes(*x, model.terms) for x in seen)]
        keep = (bad["junk"] < 0.5) & (bad["toxic"] < 0.5)
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"].cast(pa.int64()), pa.array(bad["junk"], pa.float64()), pa.array(bad["toxic"], pa.float64()), pa.array(fired, pa.list_(pa.string())), pa.array(keep)],
            ["doc_id", "junk_score", "toxic_score", "fired", "kept"],
        )

    return per_batch(docs.select("doc_id", "text"), scored, "doc_id long, junk_score double, toxic_score double, fired array<string>, kept boolean")


def passing(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the scorers keep."""
    at = docs.columns.index("text")
    return per_batch(docs, lambda batch: batch.filter(pa.array(model.kept(utf8(batch.column(at))))), docs.schema)
