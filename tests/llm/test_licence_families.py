"""Every licence family, near misses and talk of licences, against a plain scanner; the words that the scan looks for first."""

import math
import re
from itertools import pairwise

import numpy as np
import pytest

from tidemark.llm import licenses

NEAR = {  # each names one family, and words of others
    "Licensed under CC BY-NC-SA 4.0.": ["CC-BY-NC-SA"],
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": ["CC-BY-ND"],
    "This library is under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": ["LGPL"],
    "The MIT License (MIT)": ["MIT"],
    "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3": ["LGPL"],
    "Eclipse Public License - v 2.0": ["EPL"],
    "Released under the ISC License.": ["ISC"],
    "Released under the Unlicense.": ["Unlicense"],
}


def share(template: str, paragraph: str) -> float:
    of, there = ({*pairwise(re.findall("[a-z0-9]+", x.lower()))} for x in (template, paragraph))
    return len(of & there) / len(of)


def scanner(paragraph: str) -> set[str]:
    """Families with a template of the largest share, where that is enough."""
    best = {f: max(share(t, paragraph) for t in texts) for f, texts in licenses.TEMPLATES.items()}
    return {f for f, s in best.items() if s >= 0.7 and s == max(best.values())}


@pytest.fixture(scope="module")
def scanned(spark):
    random = np.random.RandomState(5)
    words = ["".join(random.choice(list("aeionrst"), 5)) for _ in range(200)]
    plain = [" ".join(random.choice(words, 12)) for _ in range(100)]
    texts = plain + [f"{plain[k]}\n\n{t}\n\n{plain[-k]}" for k, t in enumerate(t for some in licenses.TEMPLATES.values() for t in some)] + list(NEAR) + licenses.TALK
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = licenses.fit_licences(docs)
    out = {texts[r.doc_id]: r for r in licenses.licence_scan(docs, model).collect()}
    return model, plain, out


def test_families_near_misses_and_talk(scanned):
    model, plain, out = scanned
    assert {t: out[t].licences for t in NEAR} == NEAR
    assert all(out[t].licences == [] and out[t].family == licenses.UNKNOWN for t in [*plain, *licenses.TALK])
    for family, texts in licenses.TEMPLATES.items():
        for text in texts:
            got = next(r for t, r in out.items() if f"\n\n{text}\n\n" in t)
            assert set(got.licences) <= scanner(text), text  # never a family that the comparison speaks against
            assert got.licences == [family], text
            assert got.paragraph == 2 and got.probability >= model.cut


def test_anchors_are_in_every_paragraph_that_can_be_confirmed(scanned):
    words = list(scanned[0].rarest)
    assert sorted(words) == sorted({w for _, _, needed in licenses.needed_pairs() for pair in needed for w in pair})
    random = np.random.RandomState(11)
    for _ in range(30):
        some = set(licenses.anchors(0.7, [words[k] for k in random.permutation(len(words))]))
        for _, _, needed in licenses.needed_pairs():
            least = math.ceil(0.7 * len(needed) - 1e-9)
            for _ in range(20):
                there = {w for k in random.choice(len(needed), least, replace=False) for w in needed[k]}
                assert there & some
            assert sum(not some & set(pair) for pair in needed) < least  # pairs without an anchor are too few
