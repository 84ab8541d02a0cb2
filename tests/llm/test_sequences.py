"""Packing, mixing and LM scores."""

import math
from collections import Counter, defaultdict
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest

from tidemark.llm import mixing, packing, ppm
from tidemark.llm.queries import tokenizer


@pytest.fixture(scope="module")
def vocabulary():
    pytest.importorskip("public_tokenizers")
    return tokenizer()


def test_ids_are_those_of_the_tokenizer(vocabulary, messy):
    encoder = packing.Encoder(vocabulary)
    texts = ["", "a  b", " a", "a ", " \n x", "x\n y", "x\n  y", "x\n\n y", "a<|endoftext|> b<|endoftext|>c", "it's don 't  x", "é 漢字　c %%%,", "\t\t a", "A!! B!! | 12,3"]
    texts += [r.text or "" for r in messy.select("text").collect()]
    got = [np.frombuffer(ids, np.uint32).tolist() for ids, _ in encoder.encode(texts)]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_sentences_end_alike_with_single_and_double_spaces(vocabulary):
    encoder = packing.Encoder(vocabulary)
    sentences = [f"Sentence number {i} says what it says{end}" for i, end in zip(range(40), ".!?" * 14)]
    texts = [" ".join(sentences), "  ".join(sentences), " ".join(sentences) + " ", "\n ".join(sentences) + "  x", "  ", " \n "]
    for text, (ids, ends) in zip(texts, encoder.encode(texts)):
        ids = np.frombuffer(ids, np.uint32).tolist()
        assert ids == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        said = [encoder.tokenizer.decode(ids[:k]).rstrip(" \n") for k in ends.tolist()]
        if "Sentence" in text:
            want = [" ".join(sentences[: k + 1]).split() for k in range(40)]
            assert [s.split() for s in said if s] == want
        assert (np.diff(ends) > 0).all() and (ends > 0).all()


def test_cuts_by_brute_force():
    random = np.random.RandomState(3)
    for _ in range(60):
        x = np.concatenate([[0], np.cumsum(random.randint(1, 9, 9))])
        fine = random.choice([0.0, 3.0, 7.0], len(x))
        capacity = 16

        def cost(path):
            total = 0.0
            for a, b in zip(path, path[1:]):
                size = x[b] - x[a]
                if size > capacity:
                    return math.inf
                total += (0 if size & (size - 1) == 0 else capacity - size) + fine[b] + 1.0
            return total

        inner = range(1, len(x) - 1)
        best = min(cost([0, *c, len(x) - 1]) for k in range(len(x) - 1) for c in combinations(inner, k))
        assert cost(packing.cuts(x, fine, capacity, 1.0)) == pytest.approx(best)


def check_pieces(pieces, docs, encoder, capacity):
    sequences, parts = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        parts[p.doc_id, p.doc_tokens].append(p)
        assert len(p.ids) == 4 * p.length
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        assert sum(p.length for p in own) <= capacity
    want = Counter((d.doc_id, encoder.encode([d.text or ""])[0][0] + b"\1\0\0\0") for d in docs)
    got = Counter()
    for (doc_id, n), own in parts.items():
        own.sort(key=lambda p: (p.start, p.sequence_id))
        copies = len([p for p in own if p.start == 0])
        ids = b"".join(p.ids for p in own[::copies])
        assert len(ids) == 4 * n
        got[doc_id, ids] += copies
    assert got == want


def test_pieces_are_a_round_trip(vocabulary, messy, no_docs):
    encoder = packing.Encoder(vocabulary)
    for capacity, stretch in ((2_048, 500_000), (64, 300)):
        out = packing.packed(messy, vocabulary, capacity=capacity, stretch=stretch).collect()
        check_pieces(out, messy.select("doc_id", "text").collect(), encoder, capacity)
    assert packing.packed(no_docs, vocabulary).count() == 0


def test_little_padding(spark, vocabulary):
    random = np.random.RandomState(1)
    words = ["alpha", "beta", "gamma", "delta", "of", "the"]
    texts = [" ".join(w + ("." if random.rand() < 0.1 else "") for w in random.choice(words, random.randint(20, 900))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    sizes = Counter()
    for p in packing.packed(docs, vocabulary).collect():
        sizes[p.sequence_id] += p.length
    padding = sum(0 if n & (n - 1) == 0 else 2_048 - n for n in sizes.values())
    assert padding < 0.02 * sum(sizes.values())


def test_pfair_windows_and_deviation(spark):
    totals = spark.createDataFrame([("=a", 5_000_000), ("=b", 900_000), ("=c", 40_000), ("=d", 1)], "name string, units long")
    for weights, temperature in ((None, 0.5), ({"a": 1, "b": 2, "c": 3, "d": 0.5}, 1.0), ({"a": 0, "b": 0, "zzz": 1}, 1.0)):
        shares = mixing.shares(totals, weights, temperature, 64)
        rows = mixing.one_period(shares, 1_000).orderBy("slot").collect()
        period = rows[0].period
        assert [r.slot for r in rows] == list(range(period)) and sum({r.name: r.share for r in rows}.values()) == period
        served = Counter()
        for r in rows:
            assert r.turn == served[r.name] and r.release <= r.slot < r.deadline
            served[r.name] += 1
            for name, share in {x.name: x.share for x in rows}.items():
                assert abs(served[name] - (r.slot + 1) * share / period) < 1
    half = {r["name"]: r["share"] for r in mixing.shares(totals, {"a": 1, "b": 1}, 1.0, 1_024).collect()}
    assert abs(half["=a"] - 512) <= 4 and half["=d"] == 1


def test_every_row_gets_its_place(spark, messy, no_docs):
    for bucket_rows in (2_048, 1):
        rows = mixing.mix_plan(messy, block_units=50, bucket_rows=bucket_rows).collect()
        assert sorted((r.doc_id or 0, r.source or "", r.units) for r in rows) == sorted((r.doc_id or 0, r.source or "", len(r.text or "") + 1) for r in messy.collect())
        by_source = defaultdict(list)
        for r in rows:
            by_source[r.source].append(r)
            assert r.block == r.start // 50 and r.release <= r.slot < r.deadline
        for own in by_source.values():
            own.sort(key=lambda r: r.start)
            assert [r.start for r in own] == [0, *np.cumsum([r.units for r in own])[:-1]]
    assert mixing.mix_plan(no_docs).count() == 0
    out = mixing.mixed(messy)
    assert out.columns == messy.columns and out.count() == messy.count()


def test_mixed_rows_come_in_the_order_of_their_slots(spark):
    rows = [(i, "x" * 90, "big" if i % 3 else "small") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = {"weights": {"big": 1.0, "small": 1.0}, "block_units": 500, "slots": 16}
    slot = {r.doc_id: (r.slot, r.start) for r in mixing.mix_plan(docs, **options).collect()}
    order = [r.doc_id for r in mixing.mixed(docs, **options).collect()]
    assert order == sorted(slot, key=slot.get)
    first = [next(r for r in rows if r[0] == i)[2] for i in order[:300]]
    assert abs(first.count("big") - 150) <= 10


def plain_ppm(train, order):
    counts = defaultdict(Counter)
    for t in train:
        b = b"\xfe" * order + t + b"\xff"
        for i in range(order, len(b)):
            for o in range(order + 1):
                counts[b[i - o : i]][b[i]] += 1
    for o in range(order - 1, 1, -1):
        for c in [c for c in counts if len(c) == o]:
            counts[c] = Counter()
        for c in [c for c in counts if len(c) == o + 1]:
            counts[c[1:]].update(counts[c].keys())

    def probability(context, byte):
        p, gone = 1.0, set()
        for o in range(order, -1, -1):
            seen = counts.get(context[len(context) - o :] if o else b"", {})
            live = {k: v for k, v in seen.items() if k not in gone}
            if not live:
                continue
            n = sum(live.values())
            if byte in live:
                return p * (2 * live[byte] - 1) / (2 * n)
            p *= len(live) / (2 * n)
            gone |= set(seen)
        return p / (256 - len(counts.get(b"", ())))

    return probability


def plain_score(probability, text, order):
    b = b"\xfe" * order + text + b"\xff"
    return sum(math.log10(probability(b[i - order : i], b[i])) for i in range(order, len(b)))


@pytest.mark.parametrize(("order", "chunk_bytes", "bucket_bytes"), [(5, 48_000_000, 6_000_000), (2, 300, 100), (1, 5_000, 900)])
def test_scores_by_brute_force(spark, messy, order, chunk_bytes, bucket_bytes):
    random = np.random.RandomState(order)
    texts = [" ".join(random.choice(["ab", "Abc", "cab", "é", "b.", "xyz"], random.randint(0, 30))) for _ in range(40)]
    docs = messy.where("doc_id <> 5").select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = [(r.doc_id, (r.text or "").encode().lower()) for r in docs.collect()]
    learn = [crc32(str("null" if i is None else i).encode()) % 10 != 0 for i, _ in rows]
    probability = plain_ppm([t for (_, t), use in zip(rows, learn) if use], order)
    words = Counter(w for (_, t), use in zip(rows, learn) if use for w in [*t.split(), None])
    n, v = sum(words.values()), len(words)
    want = []
    for (i, t), use in zip(rows, learn):
        tokens = [*t.split(), None]
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        want.append((i or 0, not use, len(tokens), sum(words[w] > 0 for w in tokens), n, round(base, 6), round(plain_score(probability, t, order), 6)))
    got = ppm.scores(docs, order, chunk_bytes, bucket_bytes).collect()
    assert sorted((r[0] or 0, *r[1:5], round(r[5], 6), round(r[6], 6)) for r in got) == sorted(want)


def test_scores_of_no_rows_and_without_training(spark, messy, no_docs):
    assert ppm.scores(no_docs).count() == 0
    held = next(i for i in range(1_000) if crc32(str(i).encode()) % 10 == 0)
    row = ppm.scores(spark.createDataFrame([(held, "ab c")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.score == pytest.approx(-5 * math.log10(256))
    assert row.base_score == pytest.approx(0.0)
    long = ppm.scores(messy).where("doc_id = 5").first()
    assert long.n_tokens == 60_001 and math.isfinite(long.score) and long.score < 0


def test_probabilities_add_up():
    grams, _ = ppm.grams([b"abracadabra", b"abc"], 3)
    known, counts = np.unique(grams, return_counts=True)
    pairs = np.bincount(ppm.grams([b"abracadabra", b"abc"], 1)[0].astype(int), minlength=65_536).reshape(256, 256)
    trie = ppm.levels(known, counts, pairs, 3)
    for context in (b"abr", b"zzz", b"bra", b"xab"):
        every = (np.uint64(int.from_bytes(context, "big")) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (10 ** ppm.log_probabilities(every, trie)).sum() == pytest.approx(1)
