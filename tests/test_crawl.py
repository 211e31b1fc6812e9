"""Crawling: levels by a written frontier, listings page by page, posts and files."""

from folioforge.operators import joins as J
from folioforge.operators import rows as R
from folioforge.sources import html as H


def test_levels(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{j}") for i in range(30) for j in (2 * i + 1, 2 * i + 2, i // 2)], "src string, href string")
    start = spark.createDataFrame([("n0",), ("n0",)], "href string")
    want, front = {"n0": 0}, {0}
    for d in (1, 2, 3):
        front = {j for i in front for j in (2 * i + 1, 2 * i + 2, i // 2) if i < 30 and f"n{j}" not in want}
        want |= {f"n{j}": d for j in front}
    out = H.crawl(edges, start, 3)
    assert {r["href"]: r["depth"] for r in out.collect()} == want
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()  # a union of written levels
    assert H.crawl(edges, start, 50).count() == 61 and H.crawl(edges, start.limit(0), 5).count() == 0


def page(*hrefs):
    return "".join(f'<a href="{h}">제목이 있는 글 {k}</a>' for k, h in enumerate(hrefs))


PAGES = [
    ("https://h/list", page("/11", "/12")), ("https://h/list?page=2", page("/13", "/11")), ("https://h/list?page=3", page("/about")), ("https://h/list?page=4", page("/14")),
    ("https://h/other?cat=1&page=1", page("/21")), ("https://h/other?cat=1&page=3", page("/22")), ("https://h/none", None),
    ("https://h/11", page("/f/a.pdf", "/x.html") + '<a href="/f/국어%20정답.pdf"></a>'), ("https://h/12", page("/f/a.pdf", "/f/b.PDF?v=1")), ("https://h/13", ""), ("https://h/14", page("/f/late.pdf")), ("https://h/21", page("/f/c.pdf")),
]


def test_pages_until_an_empty_one(spark):
    got = sorted((r["listing"], r["page_no"]) for r in H.listing_pages(spark.createDataFrame(PAGES[:7], "url string, html string")).collect())
    assert got == [("https://h/list", 1), ("https://h/list", 2), ("https://h/other?cat=1", 1)]


def test_files_of_a_site(spark):
    pages = spark.createDataFrame(PAGES, "url string, html string")
    of = lambda *urls: sorted((r["listing"], r["post"], r["href"], r["file_type"]) for r in H.site(pages, spark.createDataFrame([(u,) for u in urls], "url string")).collect())
    assert of("https://h/list") == [("https://h/list", "https://h/11", "https://h/f/a.pdf", "paper"), ("https://h/list", "https://h/11", "https://h/f/국어%20정답.pdf", "answer"), ("https://h/list", "https://h/12", "https://h/f/b.PDF?v=1", "paper")]
    assert of("https://h/other?cat=1") == [("https://h/other?cat=1", "https://h/21", "https://h/f/c.pdf", "paper")] and of("https://h/nowhere") == []


def test_texts_that_hold_an_item_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "xa b c d ey\nz"), (2, "a b c"), (3, None), (4, "one two"), (5, "q a b c d e q a b c d e")], "d int, t string")
    items = spark.createDataFrame([(1, "a b c d e"), (2, "two"), (3, ""), (4, None), (5, "b c d"), (6, "no such words at all")], "i int, s string")
    want = [(1, 1), (1, 3), (1, 5), (2, 3), (4, 2), (4, 3), (5, 1), (5, 3), (5, 5)]
    assert sorted(map(tuple, J.containing(docs, items, "d", "t", "i", "s").collect())) == want
    monkeypatch.setattr(J, "blocks_of", lambda rows: 3)
    assert sorted(map(tuple, J.containing(docs, items, "d", "t", "i", "s").collect())) == want
    assert R.blocks_of(items, 20) > 3 and R.blocks_of(items.limit(0)) == 1
