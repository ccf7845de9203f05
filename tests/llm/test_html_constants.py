"""Strings are left out as constant only if all pages of a host agree on them, and copies of one page say nothing."""

from tessera.llm import html

PAGE = "<html><body><!-- {0} --><div class=top><p>{0}</p></div><article><h1>{1}</h1><p class=lead>{2}</p><blockquote>{3}</blockquote></article></body></html>"


def extracted(spark, pages):
    rows = [(i, f"http://{host}/{i}", page) for i, (host, page) in enumerate(pages)]
    return [r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_copies_keep_their_article(spark):
    copies = [("copies", PAGE.format("today", "Title", "The lead.", "A quotation."))] * 12
    near = [("near", PAGE.format(f"day {i}", "Title", "The lead.", "A quotation.")) for i in range(12)]
    assert set(extracted(spark, copies + near)) == {"Title\nThe lead.\nA quotation."}


def test_all_pages_of_a_host_decide(spark, monkeypatch):
    """The pages that are aligned have one lead; others of the host have their own."""
    monkeypatch.setattr(html, "ALIGN_BYTES", 600)
    pages = [("mixed", PAGE.format(i, f"Title {i}", "The same lead." if i < 8 else f"Lead {i}." + " word" * 200, "Sign up here.")) for i in range(16)]
    assert extracted(spark, pages) == [f"Title {i}\n" + ("The same lead." if i < 8 else f"Lead {i}." + " word" * 200) for i in range(16)]
