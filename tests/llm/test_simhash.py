"""SimHash near-duplicates and linked components against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm import simhash
from tidemark.llm.common import components


def plain_fingerprint(text, n=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, near):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                one, two = sorted((find(a), find(b)))
                root[two] = one
    return {x: find(x) for x in nodes}


def test_chains_find_every_pair():
    random_ = random.Random(1)
    for _ in range(3_000):
        a = random_.getrandbits(64)
        b = a
        for bit in random_.sample(range(64), random_.randint(0, 3)):
            b ^= 1 << bit
        assert any(a & m == b & m and simhash._near(np.array([a ^ b], np.uint64), s)[0] for s, m in simhash.KEYS)


@pytest.mark.parametrize("bucket_rows", [1_024, 5, 1])
def test_links_connect_what_brute_force_connects(spark, bucket_rows):
    random_ = random.Random(2)
    fps = set()
    for _ in range(12):
        base = random_.getrandbits(64)
        for _ in range(25):
            x = base
            for bit in random_.sample(range(64), random_.randint(0, 6)):
                x ^= 1 << bit
            fps.add(simhash._signed(x))
    fps = sorted(fps)
    want = groups(fps, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    want = {k: v for k, v in want.items() if Counter(want.values())[v] > 1}
    links = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), bucket_rows)
    assert {r.node: r.root for r in components(links).collect()} == want


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1_000, 1_000 + i) for i in range(1, 300)] + [(5_001, 5_000), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(201)}, **{1_000 + i: 1_000 for i in range(300)}, 5_000: 5_000, 5_001: 5_000}


def test_documents_by_brute_force(messy, no_docs):
    out = simhash.near_duplicates(messy).collect()
    prints = {int(r.fingerprint, 16) for r in out}
    assert sorted((r.doc_id or 0, int(r.fingerprint, 16)) for r in out) == sorted((r.doc_id or 0, plain_fingerprint(r.text)) for r in messy.collect())
    roots = groups(sorted(prints), lambda a, b: (a ^ b).bit_count() <= 3)
    lowest = {}
    for r in out:
        root = roots[int(r.fingerprint, 16)]
        lowest[root] = min((x for x in (lowest.get(root), r.doc_id) if x is not None), default=None)
    assert all(r.component_id == lowest[roots[int(r.fingerprint, 16)]] for r in out)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_of_each_group_stays(messy):
    kept = simhash.one_of_each(messy)
    assert kept.columns == messy.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 7, 8]


def test_near_copies_are_linked_and_others_are_not(spark):
    rng = np.random.RandomState(4)
    vocabulary = [f"w{i}" for i in range(3_000)]
    bases = [rng.choice(vocabulary, 800).tolist() for _ in range(20)]
    rows = [(10 * i, " ".join(b)) for i, b in enumerate(bases)]
    for i, b in enumerate(bases):
        b = list(b)
        b[rng.randint(800)] = "changed"
        rows.append((10 * i + 1, " ".join(b)))
        rows.append((10 * i + 2, " ".join(bases[i]).upper()))
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where(F.col("doc_id") % 10 != 1)
    assert all(r.component_id == r.doc_id // 10 * 10 for r in out.collect())
