"""Exact duplicates by content sort against a plain dictionary."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm.content_sort import content_groups, without_copies


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, largest):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lowered(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known, default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        at = ids.index(keep)
        out += [(i, keep, len(ids), k == at, sha) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def found(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()], key=str)


SAMPLE = [
    (5, "Same TEXT"), (3, "same text"), (9, "SAME text"), (3, "same text"), (4, "same  text"), (1, "ÄPFEL"), (2, "äpfel"), (6, "ÄPfel"),
    (7, None), (8, ""), (10, " "), (None, "same text"), (None, "only without id"), (None, "Only without id"), (11, "x" * 40 + "a"), (12, "x" * 40 + "b"),
    (13, "Kelvin"), (14, "kelvin"), (15, "long " * 50_000), (16, "LONG " * 50_000),
] + [(100 + i, "hot Text" if i % 3 else "Hot text") for i in range(300)]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("piece_bytes", [64 << 20, 500, 1])
def test_groups(spark, keep, piece_bytes):
    docs = spark.createDataFrame(SAMPLE, "doc_id long, text string").repartition(5)
    assert found(content_groups(docs, keep, piece_bytes=piece_bytes)) == plain(SAMPLE, keep == "largest")


def test_odd_tables(spark, messy, no_docs):
    assert found(content_groups(messy)) == plain([(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()], False)
    assert content_groups(no_docs).count() == 0
    with pytest.raises(ValueError):
        content_groups(messy, "newest")


def test_rows_that_stay_keep_their_columns(messy):
    docs = messy.withColumn("a.b", F.lit(1)).withColumn("row", F.col("doc_id"))
    kept = without_copies(docs, piece_bytes=1)
    assert kept.columns == docs.columns
    assert kept.exceptAll(docs).count() == 0
    assert sorted(lowered(r.text) for r in kept.collect()) == sorted({lowered(r.text) for r in docs.collect()})
