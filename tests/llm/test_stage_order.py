"""Sequences follow the mixing schedule however the mixed rows were written."""

import corpus_pipeline
from tidemark.llm import mixing


def test_sequence_ids_follow_slots_over_files_of_unequal_size(spark, tmp_path):
    rows = [(i, f"document {i} " + f"of source {i % 3} with words to fill it. " * (30 + 17 * i % 200), "abc"[i % 3] if i < 500 else "c") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    place = {r.doc_id: (r.slot, r.start) for r in mixing.mix_plan(docs).collect()}
    assert len({slot for slot, _ in place.values()}) > 10
    ordered = sorted(rows, key=lambda r: place[r[0]])
    for a, b in ((0, 40), (40, 140), (140, 160), (160, 700)):  # in order over the files, the last one the largest
        spark.createDataFrame(ordered[a:b], docs.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "mixed"))
    pieces = corpus_pipeline.pack(spark, spark.read.parquet(str(tmp_path / "mixed")), "").collect()
    assert {p.doc_id for p in pieces} == set(place)
    found = [place[p.doc_id] for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset))]
    assert found == sorted(found)
