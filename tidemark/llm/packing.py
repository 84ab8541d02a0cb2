"""Packing documents into training sequences by order-preserving dynamic programming.

The documents of a partition, in their order, are one stream of token ids.  It may be cut at the ends of documents,
at the ends of sentences for a penalty, and, where a sentence is longer than a sequence, every ``capacity`` ids for a
larger one.  A sequence is what lies between two cuts; it costs its padding up to ``capacity`` (none if its length is a
power of two) and a small overhead.  The cheapest cuts follow from

    best[j] = penalty[j] + min over i with x[j] - x[i] <= capacity of best[i] + capacity - (x[j] - x[i])

whose minimum over a sliding window of best[i] + x[i] is kept in a monotone queue; sequences whose length is a power
of two are extra transitions, found by position.  A stretch of ``stretch`` ids is solved at a time and all but its last
``kept_back`` sequences are final; the rest is solved again with what follows, so memory is bounded however large a
partition is, and only the end of a partition pads more than the cuts require.

There is no shuffle: partitions are those of the input, and a sequence's id is the partition's number and a count.  A
recomputed task gives the same sequences.

Ids are made by the tokenizer for a space and the word after it, since its pattern never joins a space to the text
before it; texts in which white space follows a space, or that end in one, are handed to it whole, and their sentences
end where its offsets say.  Words met before
come from a dictionary that is emptied when it holds ``_REMEMBERED`` of them.

Defined cases: a null or empty text is its end id alone; null ids and repeated rows are documents like others; an
empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_REMEMBERED = 450_000
_RUN_OF_SPACE = re.compile(r" (?:\s|\Z)")
_CHUNK = re.compile(r"[^ ]+")
#: Fixed value: the pattern by which byte-level tokenizers of this kind cut a text before merging.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SENTENCE_END = (".", "!", "?")


def _ranked(spec: dict) -> tiktoken.Encoding | None:
    """The same vocabulary merged by rank; None if it is no byte-level one whose merges are in the order of their ids."""
    model = spec["model"]
    steps = spec["pre_tokenizer"]
    if model["type"] != "BPE" or spec.get("normalizer") or (steps or {}).get("type") != "ByteLevel" or steps.get("add_prefix_space"):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the usual printable stand-ins for bytes
    signs = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(signs[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made) or len(ranks) != 256 + len(made):
        return None
    return tiktoken.Encoding("ranked", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Words(dict):
    """Ids of a space and a word; a new word is encoded when it is first asked for.

    Words that may hold a special token, and all words where merging by rank is not the same, go to the tokenizer.
    """

    def __init__(self, tokenizer, ranked: tiktoken.Encoding | None):
        super().__init__()
        self.tokenizer, self.ranked = tokenizer, ranked

    def __missing__(self, word: str) -> bytes:
        text = " " + word
        ids = self.ranked.encode_ordinary(text) if self.ranked and "<|" not in word else self.tokenizer.encode(text, add_special_tokens=False).ids
        self[word] = found = array("I", ids).tobytes()
        return found


class Encoder:
    """Ids as little-endian 32-bit bytes, and where sentences end."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.words = _Words(self.tokenizer, _ranked(json.loads(tokenizer_json)))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, np.uint32).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
        """For each text its ids and the counts of ids after which a sentence ends."""
        split = [t.split(" ") if not _RUN_OF_SPACE.search(t) else None for t in texts]
        if len(self.words) > _REMEMBERED:
            self.words.clear()
        firsts = iter(self._encode([x[0] for x in split if x]))
        out = []
        for text, words in zip(texts, split):
            if not words:
                out.append(self._encode_spaced(text))
                continue
            parts = [next(firsts), *map(self.words.__getitem__, words[1:])]
            ends = [k for k, w in enumerate(words) if w.endswith(_SENTENCE_END) or "\n" in w]
            out.append((b"".join(parts), (np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) // 4)[ends]))
        return out


    def _encode_spaced(self, text: str) -> tuple[bytes, np.ndarray]:
        """The same of a text with runs of white space, from the places that its ids have in it."""
        coded = self.tokenizer.encode(text, add_special_tokens=False)
        stops = np.fromiter((b for _, b in coded.offsets), np.int64, len(coded.offsets))
        places = [m.end() for m in _CHUNK.finditer(text) if m[0].endswith(_SENTENCE_END) or "\n" in m[0]]
        ends = np.unique(np.searchsorted(np.maximum.accumulate(stops), np.array(places, np.int64), "right"))
        return np.array(coded.ids, np.uint32).tobytes(), ends[ends > 0]


_ENCODERS: dict[int, Encoder] = {}


def cuts(x: np.ndarray, penalty: np.ndarray, capacity: int, overhead: float) -> list[int]:
    """Indices of the positions ``x`` (increasing, first and last included, no gap above ``capacity``) to cut at."""
    n = len(x)
    extra: dict[int, list[int]] = {}
    for k in range(int(capacity).bit_length() - 1):
        at = np.searchsorted(x, x - 2**k)
        for j in np.flatnonzero((x[at] == x - 2**k) & (at < np.arange(n))).tolist():
            extra.setdefault(j, []).append(int(at[j]))
    xs, fine = x.tolist(), penalty.tolist()
    best, came = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque()
    for j in range(1, n):
        value, here = best[j - 1] + xs[j - 1], xs[j]
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j - 1))
        while xs[queue[0][1]] < here - capacity:
            queue.popleft()
        low, i = queue[0]
        low += capacity - here
        for k in extra.get(j, ()):
            if best[k] < low:
                low, i = best[k], k
        best[j], came[j] = low + fine[j] + overhead, i
    path, j = [n - 1], n - 1
    while j:
        j = came[j]
        path.append(j)
    return path[::-1]


class _Stream:
    """The ids of a partition that are not yet in a final sequence."""

    def __init__(self, partition: int, capacity: int, sentence: float, hard: float, overhead: float):
        self.capacity, self.sentence, self.hard, self.overhead = capacity, sentence, hard, overhead
        self.next_id = partition << 40
        self.docs: deque[tuple[int | None, int, bytes]] = deque()  # id, where it begins in the stream, ids
        self.x, self.penalty, self.begin, self.end = [np.zeros(0, np.int64)], [np.zeros(0)], 0, 0

    def add(self, doc_id: int | None, ids: bytes, ends: np.ndarray) -> None:
        n = len(ids) // 4
        at = np.append(ends[: np.searchsorted(ends, n)], n)  # the ends of sentences increase
        fine = np.full(len(at), self.sentence)
        fine[-1] = 0.0
        if n > self.capacity and (np.diff(at, prepend=0) > self.capacity).any():
            more = np.concatenate([np.arange(a + self.capacity, b, self.capacity) for a, b in zip(np.append(0, at[:-1]), at)])
            at, fine = np.concatenate([at, more]), np.concatenate([fine, np.full(len(more), self.hard)])
            order = np.argsort(at)
            at, fine = at[order], fine[order]
        self.x.append(at + self.end)
        self.penalty.append(fine)
        self.docs.append((doc_id, self.end, ids))
        self.end += n

    def solve(self, kept_back: int) -> Iterator[tuple]:
        """The pieces of all final sequences."""
        x, penalty = np.concatenate([[self.begin], *self.x]), np.concatenate([[0.0], *self.penalty])
        if len(x) == 1:
            return
        path = cuts(x, penalty, self.capacity, self.overhead)
        final = path[: len(path) - kept_back] if kept_back else path
        if len(final) < 2:
            self.x, self.penalty = [x[1:]], [penalty[1:]]
            return
        for a, b in zip(final, final[1:]):
            yield from self._pieces(int(x[a]), int(x[b]))
        self.begin = int(x[final[-1]])
        self.x, self.penalty = [x[final[-1] + 1 :]], [penalty[final[-1] + 1 :]]

    def _pieces(self, a: int, b: int) -> Iterator[tuple]:
        at = a
        while at < b:
            doc_id, begin, ids = self.docs[0]
            n = len(ids) // 4
            stop = min(b, begin + n)
            yield doc_id, at - begin, stop - at, ids[4 * (at - begin) : 4 * (stop - begin)], n, self.next_id, at - a
            if stop == begin + n:
                self.docs.popleft()
            at = stop
        self.next_id += 1


def packed(
    docs: DataFrame, tokenizer_json: str, capacity: int = 2_048, end_id: int = 1, sentence_penalty: float = 16.0,
    hard_penalty: float = 128.0, overhead: float = 4.0, stretch: int = 500_000, kept_back: int = 16,
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): the pieces of all documents.

    ``ids`` are little-endian 32-bit numbers; ``start`` counts the ids of the document before the piece, ``offset``
    those of the sequence before it; ``doc_tokens`` counts the end id that every document gets.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary file, a few MB
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hash(shipped.value)
        encoder = _ENCODERS.get(known) or _ENCODERS.setdefault(known, Encoder(shipped.value))
        stream = _Stream(TaskContext.get().partitionId(), capacity, sentence_penalty, hard_penalty, overhead)
        schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")])

        def out(pieces: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pieces), schema)], schema=schema)

        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = [t or "" for t in part["text"].to_pylist()]
                for doc_id, (ids, ends) in zip(part["doc_id"].to_pylist(), encoder.encode(texts)):
                    stream.add(doc_id, ids + last, ends)
                if stream.end - stream.begin >= stretch and (pieces := list(stream.solve(kept_back))):
                    yield out(pieces)
        if pieces := list(stream.solve(0)):
            yield out(pieces)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, PIECES)


def read_tokenizer(path: str) -> str:
    return Path(path).read_text(encoding="utf-8")
