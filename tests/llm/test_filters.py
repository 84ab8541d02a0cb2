"""Quality rules and the quality classifier."""

import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import anomaly_rules as rules
from tidemark.llm import weak_quality as weak


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def sentences(seed, n=300):
    random = np.random.RandomState(seed)
    vocabulary = ["".join(random.choice(list("aeionrst"), random.randint(2, 8))) for _ in range(400)]
    return [" ".join(random.choice(vocabulary, random.randint(30, 90))).capitalize() + "." for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    good = sentences(1)
    junk = [re.sub(" ", " | ", x) for x in sentences(2, 15)] + [re.sub(" ", "### ", x) for x in sentences(3, 15)] + [x.upper().replace(" ", "!! ") for x in sentences(4, 15)]
    toxic = [f"you idiot {x} worthless scum" for x in sentences(5, 40)]
    texts = good + junk + toxic
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kind = ["good"] * len(good) + ["junk"] * len(junk) + ["toxic"] * len(toxic)
    labels = spark.createDataFrame([(i, int(k != "junk"), int(k == "toxic")) for i, k in enumerate(kind)], "doc_id long, quality int, toxic int")
    return docs, labels, kind


def test_rule_counts_by_brute_force(spark, messy):
    texts = ["a b c d e a b c d e f", "x\n\nx\n x\nx", "", None, "a|b #*$%&<> c", "é " * 12, *(r.text for r in messy.select("text").collect())]
    counts, _ = rules.measure([(t or "").encode() for t in texts])
    assert [tuple(map(int, c)) for c in counts] == [plain_counts(t) for t in texts]


def test_forest_isolates_what_differs_and_keeps_the_rest(corpus):
    docs, labels, kind = corpus
    found = {r.doc_id: r for r in rules.rule_verdicts(docs, rules.fit_rules(docs, labels)).collect()}
    kept = [found[i].kept for i in range(len(kind))]
    assert np.mean([k for k, what in zip(kept, kind) if what == "junk"]) < 0.2
    assert np.mean([k for k, what in zip(kept, kind) if what == "good"]) > 0.98


def test_forest_paths_by_hand():
    rows = np.array([[0.1, 0.0], [0.2, 0.0], [0.15, 0.0], [0.12, 0.0]])
    forest = rules.IsolationForest.fit(rows, np.array([0.0, 0.0]), np.array([1.0, 1.0]), trees=50)
    assert forest.score(np.array([[0.9, 0.9]]))[0] > forest.score(rows).max()
    assert rules._path(np.array([1, 2])).tolist() == [0.0, 1.0]


def test_rules_on_messy_rows(messy, no_docs, some_labels):
    for labels in (some_labels, some_labels.where("false")):
        model = rules.fit_rules(messy, labels)
        out = rules.rule_verdicts(messy, model).collect()
        assert sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == sorted((r.doc_id or 0, *plain_counts(r.text)) for r in messy.collect())
        assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in out)
        assert rules.rule_verdicts(no_docs, model).count() == 0
        passed = rules.passing(messy, model)
        assert passed.columns == messy.columns and passed.count() == sum(r.kept for r in out)
    assert rules.fit_rules(no_docs, some_labels).forest is None


def test_every_labelled_row_counts(spark, monkeypatch):
    """Ranges, cells and threshold against the same forest fitted on all rows at hand, in a few small tasks."""
    plain, odd = sentences(11, 8000), [x.replace(" ", " | ") for x in sentences(12, 400)]
    texts = [x for i in range(50) for x in (*plain[i % 40 :: 40], *odd[i::50])]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, "too short"), (None, texts[0])], "doc_id long, text string").repartition(7)
    quality = [int(" | " not in x) for x in texts]
    labels = spark.createDataFrame([*enumerate(quality), (None, 1)], "doc_id long, quality int").repartition(3)
    counts, stats = rules.measure([x.encode() for x in texts])
    sound = ~rules.base_failed(counts)
    good = stats[sound & (np.array(quality) == 1)]
    assert len(good) > 9_000
    wanted = rules.IsolationForest.fit(good, stats[sound].min(0), stats[sound].max(0), 20)
    assert (wanted.counts(good)[:, 0] == len(good)).all()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        model = rules.fit_rules(docs, labels, clean_loss=0.01, trees=20)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (model.forest.feature == wanted.feature).all() and np.array_equal(model.forest.length, wanted.length) and model.forest.unit == wanted.unit
    assert model.threshold == np.quantile(wanted.score(good), 0.99, method="higher")


@pytest.mark.parametrize("parts", [2, 1024])
def test_nth_smallest(spark, parts):
    values = np.r_[np.random.RandomState(3).lognormal(0, 3, 500), np.full(40, 1.5), 1e12]
    table = spark.createDataFrame([(float(x),) for x in values], "v double").repartition(3)
    for n in (0, 300, 499, len(values) - 1):
        assert rules.nth_smallest(table, "v", n, parts) == np.sort(values)[n]


def test_label_model_finds_the_rates():
    random = np.random.RandomState(0)
    bad = random.rand(20_000) < 0.2
    fires = np.column_stack([np.where(bad, random.rand(20_000) < p, random.rand(20_000) < q) for p, q in ((0.8, 0.02), (0.7, 0.01), (0.6, 0.05))]).astype(int)
    patterns, counts = np.unique(fires, axis=0, return_counts=True)
    posterior, rate1, rate0 = weak.label_model(patterns, counts.astype(float))
    assert np.allclose(rate1, [0.8, 0.7, 0.6], atol=0.04) and np.allclose(rate0, [0.02, 0.01, 0.05], atol=0.02)
    assert posterior[(patterns == 1).all(1)][0] > 0.99 > 0.05 > posterior[(patterns == 0).all(1)][0]


def test_classifier_rejects_junk_and_abuse(corpus):
    docs, labels, kind = corpus
    model = weak.fit_quality(docs, labels)
    out = {r.doc_id: r for r in weak.quality_verdicts(docs, model).collect()}
    share = {what: np.mean([out[i].kept for i, k in enumerate(kind) if k == what]) for what in ("good", "junk", "toxic")}
    assert share["good"] > 0.97 and share["junk"] < 0.1 and share["toxic"] < 0.15
    assert weak.passing(docs, model).count() == sum(r.kept for r in out.values())


def test_classifier_on_messy_rows(messy, no_docs, some_labels):
    model = weak.fit_quality(messy, some_labels)
    out = weak.quality_verdicts(messy, model)
    assert out.count() == messy.count() and out.where("kept is null or junk_score is null or isnan(toxic_score)").count() == 0
    assert weak.quality_verdicts(no_docs, model).count() == 0
    assert weak.passing(messy, model).columns == messy.columns
    empty = weak.fit_quality(no_docs, some_labels.where("false"))
    assert weak.quality_verdicts(messy, empty).count() == messy.count()


def test_features_and_votes():
    shares, words = weak.look(b"Spam!! SPAM!! spam!! | a|b")
    assert words == {b"spam", b"ab"} and shares[5] == 3 / 15
    assert weak.votes(*weak.look(b"you Idiot, really"), weak.Terms()) >> 8 == 1
    assert weak.look(b"")[1] == set() and not weak.look(b" \n")[0].any()
