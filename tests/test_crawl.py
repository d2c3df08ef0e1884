"""The composed harvest: states, depths, and a restart in the middle."""

import os

import pytest
from pyspark.sql import functions as F

from themelens.operators import closure, crawl
from themelens.operators.crawl import harvest_all

BASE = "https://x.omeka.net"
PAD = "<p>" + "text " * 30 + "</p>"


def page(*hrefs, body=PAD, title=None):
    head = f"<title>{title}</title>" if title else ""
    return head + "".join(f"<a href='{h}'>a</a>" for h in hrefs) + body


@pytest.fixture
def pages(spark):
    rows = [
        (1, f"{BASE}/b?page=1", page("?page=2", "/b?page=2", "/b?page=10", "/items/show/1", "/items/show/1")),
        (2, f"{BASE}/b?page=2", page("/b?page=1", "/b?page=3", "/items/show/2", "/items/show/3", "https://y.org/items/show/9")),
        (3, f"{BASE}/b?page=10", page("/b?page=4", "/items/show/8", body="")),  # too short: leads nowhere
        (4, f"{BASE}/b?page=4", page("/items/show/7")),
        (5, f"{BASE}/items/show/1", page("/items/show/6", "/b?page=77", title="One")),
        (9, f"{BASE}/items/show/1", page(title="One again")),
        (6, f"{BASE}/items/show/2", page()),
        (7, None, page(title="no url")), (8, f"{BASE}/items/show/3", None),
    ]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, link string, depth string")


def rows(found):
    states = sorted((r.url[len(BASE):], r.kind, r.state, r.depth) for r in found.states.collect())
    return [r.titulo for r in found.records.collect()], states, tuple(found.rate.first())


WANT = (["One"], [("/b?page=1", "listing", "read", 0), ("/b?page=10", "listing", "failed", 1),
                  ("/b?page=2", "listing", "read", 1), ("/b?page=3", "listing", "failed", 2), ("/items/show/1", "item", "read", 1),
                  ("/items/show/2", "item", "untitled", 2), ("/items/show/3", "item", "failed", 2), ("?page=2", "listing", "failed", 1)], (1, 3, 1 / 3))


def test_states_records_and_rate(spark, pages):
    assert rows(harvest_all(pages, f"{BASE}/b?page=1", BASE)) == WANT
    empty = harvest_all(pages.where("false"), f"{BASE}/b?page=1", BASE)
    assert rows(empty) == ([], [("/b?page=1", "listing", "failed", 0)], (0, 0, None))


def test_a_crawl_goes_on_where_it_was_stopped(spark, pages, tmp_path, monkeypatch):
    folder, start = str(tmp_path / "crawl"), f"{BASE}/b?page=1"
    step = crawl._step

    def stop(folder, name, build, spark):
        if name == "listing-2":
            build().write.parquet(os.path.join(folder, name))  # written, but lost before its marker
            raise KeyboardInterrupt
        return step(folder, name, build, spark)

    monkeypatch.setattr(crawl, "_step", stop)
    with pytest.raises(KeyboardInterrupt):
        harvest_all(pages, start, BASE, folder)
    monkeypatch.setattr(crawl, "_step", step)
    kept = {n: os.stat(os.path.join(folder, n)).st_mtime_ns for n in ("pages", "links", "listing-0", "listing-1")}
    assert rows(harvest_all(pages, start, BASE, folder)) == WANT
    assert kept == {n: os.stat(os.path.join(folder, n)).st_mtime_ns for n in kept}
    assert rows(harvest_all(pages.where("false"), start, BASE, folder)) == WANT  # all steps are there


def test_pagination_order_and_cycles(spark):
    links = [(f"p?page={a}", f"p?page={b}") for a, b in ((1, 2), (2, 10), (10, 1), (5, 1))] + [("p?page=2", "p?q=3"), ("p?page=2", None)]
    found = closure.pagination_closure(spark.createDataFrame(links, "url string, link string"), spark.createDataFrame([("p?page=1",)], "url string"))
    assert [r.url for r in found.collect()] == ["p?page=1", "p?page=10", "p?page=2"]
    both = closure.link_closure(spark.createDataFrame([(1, 1), (5, 5)], "start long, node long"),
                                spark.createDataFrame([(1, 2), (2, 1), (2, 3), (5, 1)], "src long, dst long"))
    assert sorted(map(tuple, both.collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (5, 1, 1), (5, 2, 2), (5, 3, 3), (5, 5, 0)]


def test_no_window_without_partitions(spark):
    from themelens.operators.reports import category_order
    from themelens.operators.tfidf import fit_tfidf
    counts = spark.createDataFrame([(f"a{k % 50}", k) for k in range(200)], "orientador_principal string, count long")
    order = category_order(counts)
    assert [r.position for r in order.orderBy(F.desc("total"), "orientador_principal").collect()] == list(range(1, 51))
    docs = spark.createDataFrame([(k, f"alpha beta w{k % 3} gamma") for k in range(9)], "doc_id long, texto_processado string")
    vocab = fit_tfidf(docs, max_features=None, min_df=1, max_df=1.0).vocab
    assert [r.term_id for r in vocab.orderBy("term").collect()] == list(range(vocab.count()))
    for df in (order, vocab):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
