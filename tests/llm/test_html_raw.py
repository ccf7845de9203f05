"""Raw elements end at their literal end tags, and the head at what cannot be in it."""

import pytest

from tessera.llm import html

ARTICLE = "<article><p>Main text</p></article>"


@pytest.mark.parametrize(
    "page",
    [
        "<script>for(i=0;i<n;i++){x()}</script>" + ARTICLE,
        "<SCRIPT>if(a<b)c('<p>')</Script >" + ARTICLE + "<script>d</script>",
        "<style>a<b{</style>" + ARTICLE,
        "<html><head><title>a<b</title><script>if(i<n){x()}</script><meta name=x><link rel=y><body>" + ARTICLE,
        "<html><head><title>T</title>\n<meta name=x>" + ARTICLE,
        "<head><title>T</title></head><body>" + ARTICLE,
        "<header>Top</header>" + ARTICLE,
        "<svg><svg></svg><text>drawn</text></svg>" + ARTICLE,
        "<svg><object>" + ARTICLE,
        ARTICLE + "<script>never ended <p>x</p>",
        ARTICLE + "<textarea>written</textarea><noscript><p>n</p></noscript>",
    ],
)
def test_main_text_is_kept(page):
    assert html.extract(page, html.Rules(None, {})) == "Main text"


def test_many_raw_starts_without_end():
    assert html.extract("<svg>" * 20_000 + ARTICLE, html.Rules(None, {})) == "Main text"
