"""A head that is not closed ends where the page's body begins."""

import pytest

from vitrine.llm import html

HEAD = "<html><head><meta charset=utf-8><title>T</title><script>var x = '<p>';</script><noscript><p>off</p></noscript>"


@pytest.mark.parametrize("rest", ["<body><article><p>Some text</article>", "<article><p>Some text</article>", "<p>Some text", "Some text", "<img src=x>Some text", "<noscript>off<body><p>Some text", "</head><body><p>Some text"])
def test_open_head(rest):
    assert html.main_text(HEAD + rest) == "Some text"
