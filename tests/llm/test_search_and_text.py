"""Nearest neighbours, chat formatting, HTML extraction, licence scans and the pipeline."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, html_blocks, licenses, prefix_forest, simhash
from tidemark.llm.queries import TRAP


def exact(rows, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for i in sorted({i for i in ids.tolist() if i % 20 == 0}):
        scores = x @ x[np.flatnonzero(ids == i)[0]]
        others = ids != i
        order = np.lexsort((ids[others], -scores[others]))[:k]
        out[i] = list(zip(ids[others][order].tolist(), scores[others][order].tolist()))
    return out


def test_recall_against_brute_force(spark):
    random = np.random.RandomState(0)
    centres = random.normal(size=(30, 32))
    rows = [(i, (centres[i % 30] + random.normal(size=32) * 0.8).astype(float) * random.uniform(0.5, 2)) for i in range(3_000)]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    want = exact(rows, 20)
    for options in ({}, {"block_rows": 700, "query_rows": 40, "candidates": 1.5}):
        got = prefix_forest.nearest(vectors, **options).orderBy("query_id", "rank").collect()
        assert len(got) == 20 * len(want)
        hits = sum(r.vec_id in dict(want[r.query_id]) for r in got)
        assert hits >= 0.9 * len(got)
        full = {i: dict(exact([(i, rows[i][1]), *[x for x in rows if x[0] != i]], 2_999)[i]) for i in (0, 20)}
        assert all(r.score == pytest.approx(full[r.query_id][r.vec_id], abs=1e-12) for r in got if r.query_id in full)


def test_small_tables_are_searched_whole_and_bad_vectors_stay_out(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [1.0, 1.0]), (7, [0.0, 0.0]), (8, None), (9, [float("nan"), 1.0]), (10, [float("inf"), 1.0]), (11, [None, 1.0]), (None, [1.0, 1.0]), (12, [1.0]), (40, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("block", F.lit(1))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in prefix_forest.nearest(vectors).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 1.0), (0, 2, 4, 1.0), (0, 3, 20, 0.0), (20, 1, 3, 2.0), (20, 2, 4, 2.0), (20, 3, 0, 0.0)]
    assert prefix_forest.nearest(vectors.where("false")).count() == 0


def test_forest_ranges_are_prefix_matches():
    random = np.random.RandomState(1)
    x = random.normal(size=(200, 8))
    forest = prefix_forest.Forest(x, prefix_forest._planes(4, 10, 8, 3))
    strings, queries = forest.strings(x), forest.strings(x[:5] + 0.1)
    for q, found in enumerate(forest.candidates(x[:5] + 0.1, 30)):
        for dropped in range(11):
            same = strings >> dropped == (queries[:, q] >> dropped)[:, None]
            if same.sum() >= 30:
                assert found.tolist() == np.flatnonzero(same.any(0)).tolist()
                break


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|im_start|>x", "<\\\\|", "<", "|>", "<|<|<||", TRAP, "a\nb\\", "é<|漢"])
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)
    whole, spans = chat.formatted([(text, text), ("assistant", text), ("assistant", "")])
    assert chat.read_back(whole) == [(text, text), ("assistant", text), ("assistant", "")]
    assert [chat.unescape(whole[a:b]) for a, b in spans] == [text, ""]


def test_reply_tree_paths_and_ranks(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a1", 1.0), ("t", 3, 1, "assistant", "a2", 3.0), ("t", 4, 3, "user", "q2", 0.0), ("t", 5, 4, "assistant", "b", 9.0), ("t", 6, 3, "user", "other", -9.0),
            ("u", 1, 99, "user", "orphan", 0.0), ("c", 1, 2, "user", "x", 0.0), ("c", 2, 1, "user", "y", 0.0)]
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    out = {(r.tree, r.leaf): r for r in chat.conversations(messages).collect()}
    assert set(out) == {("t", 2), ("t", 5), ("t", 6), ("u", 1)}  # messages on a cycle have no root
    assert [t for _, t in chat.read_back(out["t", 5].conversation)] == ["q", "a2", "q2", "b"]
    assert (out["t", 5].rank, out["t", 2].rank, out["t", 6].rank) == (1, 2, 3)
    assert [r.leaf for r in chat.conversations(messages, branches=1).where("tree = 't'").collect()] == [5]
    assert chat.conversations(messages.where("false")).count() == 0


def test_turns_in_order_with_nulls_and_repeats(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(130)] + [(2, 0, None, None), (2, None, "assistant", "first"), (2, 0, None, None), (None, 0, "user", "z")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("score", F.lit("x")).withColumn("node", F.lit(1))
    out = {r.tree: chat.read_back(r.conversation) for r in chat.conversations(chat.reply_chain(table)).collect()}
    assert out["=1"] == [("user" if t % 2 else "assistant", f"turn {t}") for t in range(130)]
    assert out["=2"] == [("assistant", "first"), ("", ""), ("", "")] and out[""] == [("user", "z")]


PAGE = "<html><head><title>T</title><script>x='<p>no</p>'</script></head><body><nav><ul><li><a href='/'>Home</a><li><a href='/b'>More &amp; more</a></ul></nav><div class='ad'>Buy it now.</div><article><h1>{0} &lt;head&gt;</h1><p><b>{1}<br>x<p>{2}&nbsp;end.</p><ul><li>{3}<li>{0}</ul></article><footer>&copy; Some name</footer></body></html>"


def test_leaves_close_and_decode():
    got = [t for _, t, _ in html_blocks.leaves(PAGE.format("A", "b  c", "d", "e"))]
    assert got == ["Home", "More & more", "Buy it now.", "A <head>", "b c x", "d end.", "e", "A", "© Some name"]
    for odd in ("", "<", "<p", "<!-- x", "<script>x", "<style>", "a < b > c", "</p></p>", "<a b='", "<p class=\"x>y"):
        html_blocks.leaves(odd)
    assert [t for _, t, _ in html_blocks.leaves("a < b &amp; c")] == ["a < b & c"]


def test_gradients_by_differences():
    random = np.random.RandomState(0)
    lab = html_blocks.Labeller.new(hidden=3)
    lab.weights = [w.astype(float) for w in lab.weights]
    pages, y = [random.normal(size=(n, html_blocks.SIZE)) for n in (4, 2)], [random.rand(n) > 0.5 for n in (4, 2)]

    def loss():
        p = lab._run(pages)[-1]
        return -sum(np.log(np.where(t, p[: len(t), j], 1 - p[: len(t), j])).sum() for j, t in enumerate(y)) / 6

    before = [w.copy() for w in lab.weights]
    step = 1e-3
    numeric = []
    for k, at in ((0, (5, 2)), (0, (html_blocks.SIZE + 1, 7)), (1, (-1, 4)), (1, (9, 0)), (2, (3,)), (2, (-1,))):
        values = []
        for sign in (1, -1):
            lab.weights = [w.copy() for w in before]
            lab.weights[k][at] += sign * step
            values.append(loss())
        numeric.append((k, at, (values[0] - values[1]) / (2 * step)))
    lab.weights = [w.copy() for w in before]
    lab.train(pages, [np.asarray(t, np.float32) for t in y], epochs=1, rate=1e-4, batch=2)
    for k, at, slope in numeric:  # the first step of the optimiser goes against the sign of the slope
        if abs(slope) > 1e-5:
            assert np.sign(before[k][at] - lab.weights[k][at]) == np.sign(slope)


def test_extraction_learns_from_pages_that_name_their_parts(spark):
    random = np.random.RandomState(2)
    words = ["".join(random.choice(list("aeionrst"), 5)) for _ in range(100)]
    say = lambda: " ".join(random.choice(words, random.randint(4, 40))).capitalize() + "."
    rows = [(i, f"http://x/{i}", PAGE.format(*(say() for _ in range(4)))) for i in range(80)] + [(None, None, None), (1, None, ""), (None, "u", "<p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    labeller = html_blocks.fit_labeller(pages)
    out = html_blocks.extracted(pages, labeller)
    assert out.columns == ["page_id", "url", "text"] and out.count() == len(rows)
    wrong = 0
    for r, (_, _, html) in zip(sorted(out.where("url like 'http%'").collect(), key=lambda r: r.page_id), rows):
        want = [t for names, t, _ in html_blocks.leaves(html) if html_blocks.own_label(names)]
        wrong += r.text != "\n".join(want)
    assert wrong <= 2
    assert html_blocks.fit_labeller(pages.where("false")) is None
    assert [r.text for r in html_blocks.extracted(pages.limit(2), None).collect()] == ["", ""]
    assert html_blocks.extracted(pages.where("false"), labeller).count() == 0


def test_licences_are_found_and_talk_of_licences_is_not(spark, messy, no_docs):
    random = np.random.RandomState(3)
    words = ["".join(random.choice(list("aeionrst"), 5)) for _ in range(200)]
    plain = [" ".join(random.choice(words, 12)) for _ in range(120)]
    rows = [(i, f"{t}\n{plain[-i - 1]}") for i, t in enumerate(plain)]
    rows += [(1_000, f"{plain[0]}\nReleased under the MIT License.\n{plain[1]}"), (1_001, "Licensed under the Apache License, Version 2.0."), (1_002, "The driver is licensed and the general public was under it."), (1_003, "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.")]
    docs = messy.select("doc_id", "text", "kept", "score", "line", "gram", "row").unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    model = licenses.fit_licences(docs)
    out = licenses.licence_scan(docs, model)
    assert out.count() == docs.count()
    found = {r.doc_id: r for r in out.where("doc_id >= 1000").collect()}
    assert found[1_000].licences == ["MIT"] and found[1_000].paragraph == 1 and found[1_001].family == "Apache-2.0"
    assert found[1_002].family == licenses.UNKNOWN and found[1_003].licences == ["CC-BY-NC", "GPL"] and found[1_003].n_paragraphs == 2
    assert out.where("doc_id < 1000 or doc_id is null").where("size(licences) > 0").count() == 0
    assert licenses.licence_scan(no_docs, model).count() == 0


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.count()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert docs.exceptAll(before).count() == 0
    assert kept["mixing"] == kept["near_duplicates"] <= kept["quality_classifier"] <= kept["quality_rules"]
    stages = {n: spark.read.parquet(str(tmp_path / n)) for n in kept}
    groups = simhash.near_duplicates(stages["quality_classifier"])
    assert sorted(r.doc_id for r in stages["near_duplicates"].collect()) == sorted(r.component_id for r in groups.select("component_id").distinct().collect())
    ids = stages["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t"))
    assert ids.where("n <> t").count() == 0 and ids.count() == kept["mixing"]
    assert corpus_pipeline.run(spark, FOLDER).count() == kept["packing"]


def test_pipeline_stages_on_messy_rows(spark, messy, some_labels, tmp_path):
    some_labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, messy, str(tmp_path))
        assert stage(spark, messy.where("false"), str(tmp_path)).count() == 0
        assert name == "packing" or out.columns == messy.columns
        assert out.count() > 0
