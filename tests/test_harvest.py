"""H1-H17 on the hand-made pages of FIXTURES.md section 3."""

from pyspark.sql import functions as F

from themelens.functions import urls
from themelens.functions.html import scan_page
from themelens.operators import closure, harvest

BASE = "https://h.org"


def test_resolve(spark):
    df = spark.createDataFrame([("/items/show/5",), ("https://x.org/a",), ("items/browse?page=2",),
                                ("//cdn.org/x",), ("",), ("?q=1",), ("../a",)], "h string")
    got = [r.u for r in df.select(urls.resolve_url(F.col("h"), F.lit(BASE)).alias("u")).collect()]
    assert got == ["https://h.org/items/show/5", "https://x.org/a", "https://h.org/items/browse?page=2",
                   "https://cdn.org/x", "https://h.org", "https://h.org?q=1", "https://h.org/a"]


def test_item_url_predicate(spark):
    df = spark.createDataFrame([("https://a.omeka.net/items/show/5",), ("https://a.omeka.net/item/5",),
                                ("https://a.org/items/show/5",), ("",), (None,)], "u string")
    got = [r.ok for r in df.select(urls.is_item_url(F.col("u"), "omeka", "/items/show/").alias("ok")).collect()]
    assert got == [True, False, False, False, False]


def test_closure_with_cycle(spark):
    edges = spark.createDataFrame([("p1", "p2"), ("p2", "p3"), ("p3", "p1"), ("p4", "p4")], "src string, dst string")
    starts = spark.createDataFrame([("p1", "p1")], "start string, node string")
    got = sorted(r.node for r in closure.link_closure(starts, edges).collect())
    assert got == ["p1", "p2", "p3"]


def test_field_values_joined_in_order():
    html = ('<div id="dublin-core-creator"><div class="element-text"> Ana  B </div>'
            '<div class="element-text"></div><div class="element-text">Bia &amp; C</div></div>')
    r = scan_page(html, "dublin-core-", "element-text", ["h1.item-title", "h1", "title"], ".pdf")
    assert r["fields"]["creator"] == [" Ana  B ", "", "Bia & C"]


def _records(spark, html, url="https://h.org/items/show/1"):
    pages = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return harvest.extract_records(pages, base=BASE, drop_untitled=False).first()


def test_records_from_page(spark):
    html = ('<html><head><title>T</title></head><body><h1>H</h1>'
            '<div id="dublin-core-creator"><div class="element-text"> Ana  B </div>'
            '<div class="element-text"></div><div class="element-text">Bia &amp; C</div></div>'
            '<div id="dublin-core-contributor"><div class="element-text">X</div></div>'
            '<div id="dublin-core-advisor"><div class="element-text">Y</div></div>'
            '<div id="dublin-core-date"><div class="element-text">2019-05-01</div></div>'
            '<a href="/a.html">a</a><a href="/f/x.pdf?dl=1">f</a><a href="/y.pdf">y</a></body></html>')
    r = _records(spark, html)
    assert r.autor == "Ana B; Bia & C"
    assert r.orientador == "Y"               # advisor (later) beats contributor
    assert r.titulo == "T"                   # <title> comes first in document order
    assert r.ano == "2019"
    assert r.arquivo_pdf == "https://h.org/f/x.pdf?dl=1"
    assert r.link_acesso == "https://h.org/items/show/1"
    assert r.coorientador == "" and r.resumo == ""


def test_contributor_when_no_advisor(spark):
    html = '<title>T</title><div id="dublin-core-contributor"><div class="element-text">X</div></div>'
    assert _records(spark, html).orientador == "X"


def test_year_keeps_text(spark):
    df = spark.createDataFrame([("2019-05-01",), ("s.d.",), ("",)], "x string")
    assert [r.y for r in df.select(harvest.year_of(F.col("x")).alias("y")).collect()] == ["2019", "s.d.", ""]


def test_untitled_dropped_and_size_guard(spark):
    pages = spark.createDataFrame([(1, "u1", "<p>no title</p>" + " " * 100), (2, "u2", "<title>x</title>")],
                                  "page_id long, url string, html string")
    assert harvest.size_guard(pages).count() == 1
    assert harvest.extract_records(pages, base=BASE).count() == 1


def test_item_links_distinct(spark):
    html = '<a href="/items/show/5">a</a><a href="/items/show/5">b</a><a href="/item/7">c</a><a href="/x">d</a>'
    pages = spark.createDataFrame([(1, "https://a.omeka.net/x", html)], "page_id long, url string, html string")
    got = [r.link for r in harvest.item_links(pages).collect()]
    assert got == ["https://a.omeka.net/items/show/5"]
