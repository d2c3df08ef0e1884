"""Loaders by header and layout, link reading and resolution, vectors that take no part, uncapped vocabulary."""

import json
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from themelens.functions import urls
from themelens.functions.html import scan_page
from themelens.functions.lexicon import RECORD_COLUMNS
from themelens.operators.distances import cross_knn
from themelens.operators.harvest import page_links
from themelens.operators.tfidf import fit_tfidf
from themelens.sources import io


def test_csv_binds_by_header(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('titulo,resumo,orientador,extra\nA,"um, dois\nlinha",Ana,x\n', encoding="utf-8")
    row = io.read_records(spark, str(path)).first()
    assert (row.titulo, row.resumo, row.orientador, row.autor) == ("A", "um, dois\nlinha", "Ana", None)
    assert list(row.asDict()) == list(RECORD_COLUMNS)
    assert io.read_records(spark, str(path), schema=None).columns == ["titulo", "resumo", "orientador", "extra"]


def test_result_file_reads_back(spark, tmp_path):
    df = spark.createDataFrame([("2019", "res", 3, 0.5, "T")], "ano string, resumo string, cluster int, dim_x double, titulo string")
    out = str(tmp_path / "result.csv")
    saved = io.save_results(df, out)
    assert saved.columns == ["titulo", "ano", "resumo", "cluster", "dim_x"]
    assert tuple(io.read_records(spark, out, schema=saved.schema).first()) == ("T", "2019", "res", 3, 0.5)


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays(spark, tmp_path, indent):
    rows = [{"titulo": "A", "resumo": "r\n1"}, {"titulo": "B", "autor": "x"}]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(rows, indent=indent), encoding="utf-8")
    got = sorted((r.titulo, r.resumo, r.autor) for r in io.read_records(spark, str(path)).collect())
    assert got == [("A", "r\n1", None), ("B", None, "x")]


def test_json_lines_and_broken_input(spark, tmp_path):
    lines = tmp_path / "a.jsonl"
    lines.write_text('{"titulo": "A"}\n{"titulo": "B"}\n')
    assert sorted(r.titulo for r in io.read_records(spark, str(lines)).collect()) == ["A", "B"]
    broken = tmp_path / "b.json"
    broken.write_text('[{"titulo": "A"}, {"titulo"')
    with pytest.raises(Exception):
        io.read_records(spark, str(broken)).collect()


def test_references_resolve_as_the_standard_says(spark):
    base = "https://h.org"
    hrefs = ["/../x", "a/../b", "/a/./b", "x/../../y", "./a", "../a", "a/b/..", "a/.", "..", ".", "/", "a//b/c", "/a//b",
             "?q=../x", "#a/../b", "a/../b?x=./y#z/..", "//c.org/a/../b", "https://x.org/a/../b", "", "é/../ü", "a/b/../../../c/",
             " /x ", "\t/a\nb", "\x01 /c", "  ", " https://x.org/a ", "\xa0/x", " ?q=1 ", "/a\r\n", "\n//c.org/d", "a b "]
    df = spark.createDataFrame([(h,) for h in hrefs], "h string")
    got = [r.u for r in df.select(urls.resolve_url(F.col("h"), F.lit(base)).alias("u")).collect()]
    assert got == [urljoin(base, h) for h in hrefs]


def test_links_come_from_the_parse(spark):
    html = ("<!-- <a href='/no1'>x</a> --><script>var s = \"<a href='/no2'>\";</script>"
            "<a data-href='/no3' href=/items/show/1>a</a><A HREF='/items/show/2?a=1&#38;b=2'>b</A><a name=x>c</a>")
    pages = spark.createDataFrame([(1, "https://h.org/p", html)], "page_id long, url string, html string")
    got = [(r.href, r.link, r.is_item) for r in page_links(pages, patterns=["/items/show/1"]).orderBy("pos").collect()]
    assert got == [("/items/show/1", "https://h.org/items/show/1", True),
                   ("/items/show/2?a=1&b=2", "https://h.org/items/show/2?a=1&b=2", False)]


def test_broken_markup_is_reported(monkeypatch):
    from themelens.functions import html
    assert scan_page("<p>x", "i-", "v", ["p"], None)["error"] is None

    def fail(self, data):
        raise AssertionError("bad")
    monkeypatch.setattr(html._PageScan, "handle_data", fail)
    page = scan_page("<a href='/x'>x</a>", "i-", "v", ["p"], None)
    assert page["hrefs"] == ["/x"] and page["error"] == "AssertionError: bad"


def test_knn_leaves_out_unusable_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 0.0]), (5, [1.0]), (6, [0.0, 2.0]), (7, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.left_id, r["rank"], r.right_id) for r in cross_knn(df, df, k=2).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1), (6, 1, 6), (6, 2, 1)]


def test_vocabulary_without_a_cap(spark):
    texts = [(1, "banco dados rede"), (2, "banco dados"), (3, "rede banco")]
    df = spark.createDataFrame(texts, "doc_id long, t string")
    free = fit_tfidf(df, "t", max_features=None, ngram_range=(1, 1), min_df=1, max_df=1.0)
    capped = fit_tfidf(df, "t", max_features=10, ngram_range=(1, 1), min_df=1, max_df=1.0)
    assert free.shape == capped.shape == (3, 3)
    assert free.vocab_terms == capped.vocab_terms == ["banco", "dados", "rede"]
    assert free.idf == pytest.approx(capped.idf)
    vectors = lambda m: {r.doc_id: r.features.toArray().tolist() for r in m.with_vectors().select("doc_id", "features").collect()}
    a, b = vectors(free), vectors(capped)
    assert all(a[k] == pytest.approx(b[k]) for k in b)
