"""Where tags end: quotes that open no value, unclosed ones, and pages made to cost time."""

import time

import pytest

from tessera.llm.html import Rules, Tags, extract, parse

CASES = {
    "<article><p>one</p><p data-x='it's'>two text</p><p>three isn't here</p><p>four</p></article>": ["one", "two text", "three isn't here", "four"],
    '<article><p title="a"b">first text</p></article>': ["first text"],
    "<article><p a=\"x>y\" b = '>' c=d>in</p><p>2 < 3 <b>x</b></p></article>": ["in", "2 < 3 x"],
    '<article><p a="never closed>text</p><p>more</p></article>': ["text", "more"],
    '<article><p>a</p></article><a "': ["a"],
    '<article><h1 class="header">Title</h1><p class="header">lead</p><p>body</p></article>': ["Title", "lead", "body"],
    '<article><p>kept</p><p class="ad">bought</p><h2 class="social"><a href="/s">share</a></h2></article>': ["kept"],
    "<article><p>a<!-- > --> b</p><!doctype x><?php echo ?><p>c</p><!-- open <p>lost</p>": ["a b", "c"],
}


@pytest.mark.parametrize("page", CASES)
def test_texts(page):
    assert extract(page, Rules(None, {}, {})).split("\n") == CASES[page]


HOSTILE = ['<a "' * 50_000, "<p a=b" * 50_000, "<a ='x' " * 50_000 + "'>'", "<a ='<a =\"" * 40_000, "<!" * 100_000, '<a ="' * 80_000, "<" * 200_000, "<a = " * 90_000 + ">", "<a " * 90_000 + "='>"]


@pytest.mark.parametrize("page", HOSTILE)
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    parse(page)
    assert time.process_time() - began < 5


@pytest.mark.parametrize("page", [p[:60] for p in HOSTILE] + list(CASES))
def test_every_character_is_in_one_token(page):
    tags, at = Tags(page), 0
    for closing, tag, attributes, text, end in tags.tokens(0):
        assert end > at
        if text is not None:
            assert page[end - len(text) : end] == text
        at = end
    assert at <= len(page)
