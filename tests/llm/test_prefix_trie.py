"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie
from tidemark.llm.prefix_trie import nodes, ranked_turns, rebuilt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def plain_trie(sequences):
    members = defaultdict(list)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        ends = ",".join(str(c) for c in sorted(convs) if len(sequences[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), sum(len(n) == len(node) + 1 for n in below), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def original(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, digest(role, text), role, text))
    return {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}


def plain_rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def found(df):
    return sorted([tuple(r) for r in df.select(COLUMNS).collect()], key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def sample(seed, convs, longest):
    random_ = random.Random(seed)
    rows = []
    for c in random_.sample(range(-30, 400), convs):
        for t in range(random_.randint(1, longest)):
            text = random_.choice(["yes", "no way  at all", "a\tb", None, "", "ü x"]) if t else random_.choice(["hello", "Hello there"])
            rows.append((c, t if random_.random() < 0.95 else None, random_.choice(["user", "assistant", None]) if t > 3 else "user", text))
    return rows + rows[:5] + [(None, 1, "user", "nobody's")]


@pytest.mark.parametrize(("seed", "convs", "longest", "bits"), [(1, 60, 9, 12), (2, 25, 1, 12), (3, 12, 40, 2)])
def test_rebuilt_conversations(spark, monkeypatch, seed, convs, longest, bits):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", bits)
    rows = sample(seed, convs, longest)
    turns, ids = rebuilt(ranked_turns(table(spark, rows)))
    assert found(nodes(turns, ids)) == plain_trie(plain_rebuilt(original(rows)))


@pytest.mark.parametrize("hot_children", [1, 65_536])
def test_conversations_as_they_are(spark, hot_children):
    rows = sample(4, 50, 6)
    turns = ranked_turns(table(spark, rows))
    assert found(nodes(turns, turns.select("conv").distinct(), hot_children)) == plain_trie(original(rows))


def test_long_and_odd(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 4)
    rows = [(7, t, "user", f"turn {t}") for t in range(300)] + [(8, t, "user", f"turn {t}") for t in range(290)] + [(9, None, None, None)]
    df = table(spark, rows).withColumns({n: F.lit(1) for n in ("name", "conv", "pos", "words", "block", "node", "depth")})
    turns = ranked_turns(df)
    rows = {(r.conv_id, r.depth): r for r in nodes(turns, turns.select("conv").distinct()).collect()}
    assert len(rows) == 302
    assert rows[7, 0].saved_tokens == 290 * 2 and rows[7, 0].n_leaves == 2 and rows[7, 0].n_convs == 3
    assert rows[7, 290].n_leaves == 1 and rows[7, 290].saved_tokens == 2 and rows[7, 290].n_convs == 2
    assert rows[7, 291].parent_conv_id == 7 and rows[7, 291].saved_tokens == 0
    assert rows[7, 290].ends_sha256 == hashlib.sha256(b"8").hexdigest()


def test_no_turns(spark):
    turns = ranked_turns(table(spark, []))
    assert nodes(*rebuilt(turns)).count() == 0
    only = spark.createDataFrame([(5,), (10,), (3,)], "conv long")
    assert found(nodes(turns, only)) == [(3, 0, None, 3, 0, 1, 0, hashlib.sha256(b"3,5,10").hexdigest())]
