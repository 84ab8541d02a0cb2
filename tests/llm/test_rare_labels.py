"""Pages that name their parts are found among many that do not."""

from tidemark.llm import html_blocks
from tests.llm.test_search_and_text import PAGE


def test_rare_and_repeated_pages_still_train(spark):
    bare = [(i, "<html><body><div><p>Some text.</p></div></body></html>") for i in range(600)]
    named = [(1_000 + i % 3, PAGE.format(f"Title {i % 3}", "One part.", "Another part.", "An item")) for i in range(6)]
    pages = spark.createDataFrame([*bare, *named], "page_id long, html string")
    assert html_blocks.fit_labeller(pages, sample_pages=10) is not None
