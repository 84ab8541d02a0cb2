"""Pages that do not name their parts, and the defined cases of long pages, ties and clashing columns."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_blocks

A = "The river rose in the night and took the old bridge with it, and by morning the two halves of the town had no way to meet."
B = "Council members spoke for hours about the cost of a new span, while shopkeepers on the far bank counted what they had lost."
C = "By spring a ferry ran twice a day, and people had begun to like the slow crossing more than they had ever liked the bridge."
T = "A bridge is lost"
SAID = "<p>Great article, I loved it.</p><p>I remember that night well, we were on the far bank.</p>"
VOICES = "<div id='voices'><div>Anna</div><p>I remember that night well.</p><div>Reply</div><div>Bert</div><p>So do I.</p><div>Reply</div></div>"
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul>"
LAYOUTS = {
    "plain divs": (f"<div><a href=/>Home</a> <a href=/n>News</a></div><div><h1>{T}</h1><div>{A}</div><div>{B}</div></div><div>Copyright 2020 The Paper</div>", [T, A, B]),
    "paragraphs in plain divs": (f"<div><div><h1>{T}</h1><p>{A}</p><p>{B}</p></div></div>", [T, A, B]),
    "bare paragraphs": (f"<p>{A}</p><p>{B}</p><p>{C}</p>", [A, B, C]),
    "an article of one paragraph": (f"<article><p>{A}</p></article>", [A]),
    "an article without paragraphs": (f"<nav><a href=/>Home</a></nav><article>{A}</article><footer>Contact us</footer>", [A]),
    "preformatted": (f"<nav><a href=/>Home</a></nav><main><h1>A loop</h1><p>{A}</p><pre>for i in x:\n  print(i)</pre><p>{B}</p></main>", ["A loop", A, "for i in x: print(i)", B]),
    "comments of an unknown name": (f"<article><h1>{T}</h1><p>{A}</p><p>{B}</p></article><section id='responses'>{SAID}</section>", [T, A, B]),
    "comments within": (f"<article><h1>{T}</h1><p>{A}</p><p>{B}</p><section id='responses'>{SAID}</section></article>", [T, A, B]),
    "comments below a plain div": (f"<div><h1>{T}</h1><p>{A}</p><p>{B}</p><p>{C}</p></div>{VOICES}", [T, A, B, C]),
    "made-up names": (f"<div class='xq'>{MENU}</div><div class='zzt'><h1>{T}</h1><p>{A}</p><p>{B}</p></div><div class='kk'><a href=/p>Privacy</a></div>", [T, A, B]),
}


@pytest.fixture(scope="module")
def labeller(spark):
    return html_blocks.fit_labeller(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_layouts_without_telling_names(labeller):
    got = html_blocks.main_text([f"<html><body>{html}</body></html>" for html, _ in LAYOUTS.values()], labeller)
    assert dict(zip(LAYOUTS, got)) == {name: want for name, (_, want) in LAYOUTS.items()}


def test_pages_that_name_their_parts_are_held_against_their_names(spark, labeller):
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id % 5 = 0").collect()  # a test set, most of it not trained on
    wrong = 0
    for r, got in zip(rows, html_blocks.main_text([r["html"] for r in rows], labeller)):
        wrong += got != [text for names, text, _ in html_blocks.leaves(r["html"] or "") if html_blocks.own_label(names)]
    assert wrong <= len(rows) // 100


def test_long_pages_repeated_rows_and_clashing_columns(spark, labeller):
    long = "<article>" + "".join(f"<p>{A} {k}</p>" for k in range(3_000)) + "</article>"
    rows = [(1, "u", long), (1, "u", long), (2, "v", f"<p>{A}</p><p>{A}</p><p>{A}</p>"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({name: F.lit(7) for name in ("text", "n_chars", "label", "block", "names")})
    out = html_blocks.extracted(pages, labeller)
    assert out.columns == ["page_id", "url", "text"]
    got = sorted(((r.page_id or 0, r.text) for r in out.collect()))
    whole = "\n".join(f"{A} {k}" for k in range(3_000))
    assert got == [(0, ""), (1, whole), (1, whole), (2, "\n".join([A] * 3))]
