"""The wrapper decides what is main text; nothing of a marked article is lost."""

import random

import pytest

from tessera.llm import html

NONE = html.Rules(None, {})


def sentence(r, n=14):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n)) + "."


def run(spark, pages):
    rows = [(i, f"http://{host}/{i}", page) for i, (host, page) in enumerate(pages)]
    return [r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>T</title><meta name=x><p>One</p><article><p>Main text</p></article>", "Main text"),
        ("<script>if (i<n) { say('don't') }</script><article><p>Main text</p></article>", "Main text"),
        ('<article><p>Main text</p><div class="related-work"><p>Earlier studies of this say much.</p></div><section class="search-results"><p>We found seven.</p></section></article>', "Main text\nEarlier studies of this say much.\nWe found seven."),
        ('<article><p>Main <span class="ad">Buy <span>now</span></span> text</p></article>', "Main text"),
        ('<article><p>Main text<span class=ad>Buy</article><p>after', "Main text"),
        ('<article><p>Main text</p><div class="related-posts"><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div><div class="post-comments"><p>First!</p></div></article>', "Main text"),
        ('<article><p>Main text</p><div class="related"><p>See elsewhere</p></div></article>', "Main text"),
    ],
)
def test_probes(page, text):
    assert html.extract(page, NONE) == text


def test_copies_and_equal_leads_lose_nothing(spark):
    one = "<article><h1>T</h1><p>Only paragraph.</p></article>"
    lead = "<article><h1>T{0}</h1><div class=lead>The same on six pages</div><p>{1}</p></article>"
    r = random.Random(1)
    found = run(spark, [("copies", one)] * 5 + [("leads", lead.format(i, sentence(r, 40))) for i in range(6)])
    assert found[:5] == ["T\nOnly paragraph."] * 5
    assert all("The same on six pages" in t for t in found[5:])


def soup(r, i, notice=False):
    """A page without marked content: the legal text is longer than the story."""
    menu = "".join(f"<div class=k><a href=/{n}>Section number {n}</a></div>" for n in range(6))
    legal = "".join(f"<p>{'Terms and conditions apply to all visitors of this site. ' * 6}</p>" for _ in range(4))
    extra = "<div class=n>Our offices are closed on Monday, thank you.</div>" if notice else ""
    story = [sentence(r, 30) for _ in range(3)]
    page = f"<div class=a>{menu}</div><div class=b><div class=t>{extra}{''.join(f'<p>{x}</p>' for x in story)}</div></div><div class=c>{legal}</div>"
    return page, "\n".join(story)


def test_slots_choose_the_content_where_none_is_marked(spark):
    r = random.Random(2)
    pages = [soup(r, i, notice=i % 2 == 0) for i in range(12)]
    found = run(spark, [("soup", p) for p, _ in pages])
    assert found == [t for _, t in pages]
    alone = [html.extract(p, NONE) for p, _ in pages]
    assert all(a != t and a.startswith("Terms") for a, (_, t) in zip(alone, pages))


def test_near_copies_are_no_template(spark):
    r = random.Random(3)
    story = "".join(f"<div class=s{chr(97 + i)}>{sentence(r, 30)}</div>" for i in range(3))
    pages = [("near", f"<div class=day>Day {i}</div><div class=t>{story}</div>") for i in range(10)]
    found = run(spark, pages)
    assert all(len(t.split("\n")) >= 3 for t in found)


def test_repeated_links_are_a_menu_unless_in_an_article(spark):
    r = random.Random(4)
    links = "".join(f"<li><a href=/{n}>Entry number {n} of all</a></li>" for n in range(5))
    plain = [("plain", f"<div class=t><p>{sentence(r, 40)}</p><ul>{links}</ul><p>{sentence(r, 40)}</p></div>") for _ in range(6)]
    marked = [("marked", f"<article><p>{sentence(r, 40)}</p><ul>{links}</ul></article>") for _ in range(6)]
    found = run(spark, plain + marked)
    assert all("Entry" not in t and t.count("\n") == 1 for t in found[:6]) and all(t.count("Entry") == 5 for t in found[6:])


def test_deep_and_wide_pages(spark):
    r = random.Random(5)
    deep = "<div>" * 5000 + "<p>Deep text</p>" + "</div>" * 5000 + "<p>end</p>"
    wide = "".join(f"<h2>H{i}</h2><p>x{i}</p>" for i in range(3000))
    found = run(spark, [("deep", deep), ("wide", wide), ("wide", wide.replace("x", "y")), ("none", None), ("", "")])
    assert "Deep text" in found[0] and found[1].count("\n") == 5999 and found[2].count("y") == 3000 and found[3:] == ["", ""]
    assert sentence(r)


def test_clashing_columns(spark):
    row = (1, "http://a/1", "<article><p>x</p></article>", "u", "v", "w")
    pages = spark.createDataFrame([row, row], "page_id long, url string, html string, host string, rules string, text string")
    assert [tuple(r) for r in html.extract_pages(pages).collect()] == [(1, "http://a/1", "x", 1)] * 2
    assert html.extract_pages(pages.limit(0)).count() == 0


def test_every_page_of_a_host_is_aligned(spark):
    """More pages than one group holds; few have the notice, and all of the second host are long."""
    r = random.Random(6)
    rare = [soup(r, i, notice=i % 25 == 0) for i in range(200)]
    long = [soup(r, i) for i in range(8)]
    found = run(spark, [("rare", p) for p, _ in rare] + [("long", f"<!--{'x' * 300_000}-->{p}") for p, _ in long])
    assert found == [t for _, t in rare + long]
