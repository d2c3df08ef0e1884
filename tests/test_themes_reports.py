"""C4-C10, A1-A9, P2-P4 on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from themelens.functions import lexicon as lx
from themelens.operators import reports as rp
from themelens.operators import themes


def test_cluster_mean_absent_is_zero(spark):
    docs = spark.createDataFrame([(1, 0, [("t", 0, 0.8)]), (2, 0, []), (3, 0, []), (4, 0, [])],
                                 "doc_id long, cluster int, tfidf array<struct<term:string,term_id:int,w:double>>")
    got = themes.cluster_term_means(docs).first()
    assert got.score == pytest.approx(0.2)


def _kw(spark, rows):
    return spark.createDataFrame(rows, "cluster int, rank int, term string, score double")


def test_theme_tie_takes_earlier_theme(spark):
    th = themes.theme_table(spark, [("T1", "a b"), ("T2", "a b")])
    kw = _kw(spark, [(3, 1, "a", 0.5), (3, 2, "b", 0.4)])
    assert themes.name_clusters(kw, th).first().cluster_name == "T1 (C3)"


def test_fallback_name(spark):
    th = themes.theme_table(spark)
    kw = _kw(spark, [(3, 1, "redes sociais", 0.5), (3, 2, "web", 0.4), (3, 3, "x", 0.1)])
    assert themes.name_clusters(kw, th).first().cluster_name == "Tema Geral: Redes sociais, Web (C3)"


def test_noise_name(spark):
    docs = spark.createDataFrame([(1, -1), (2, 0)], "doc_id long, cluster int")
    names = spark.createDataFrame([(0, "N0")], "cluster int, cluster_name string")
    got = {r.doc_id: r.cluster_name for r in themes.attach_names(docs, names).collect()}
    assert got == {1: lx.NOISE_NAME, 2: "N0"}


def test_cluster_stats_with_noise(spark):
    a = spark.createDataFrame([(-1,), (0,), (0,), (1,)], "cluster int")
    r = themes.cluster_stats(a).first()
    assert (r.n_clusters, r.n_noise, r.noise_share) == (2, 1, 0.25)


def test_principal_advisor(spark):
    df = spark.createDataFrame([(" Ana ; Bia",), ("",), (None,)], "x string")
    got = [r.y for r in df.select(rp.principal_advisor(F.col("x")).alias("y")).collect()]
    assert got == ["Ana", "", None]


def test_coerce_number(spark):
    vals = ["2019", " 2019 ", "1e3", "2019d", "2_019", "s.d.", ""]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    got = [r.y for r in df.select(rp.coerce_number(F.col("x")).alias("y")).collect()]
    assert got == [2019.0, 2019.0, 1000.0, None, None, None, None]


def test_top_advisors_ties_by_name(spark):
    rows = [("c",)] * 3 + [("b",)] * 2 + [("a",)] * 2 + [("d",)]
    df = spark.createDataFrame(rows, "orientador_principal string")
    got = [(r.orientador_principal, r["count"]) for r in rp.top_advisors(df, 2).collect()]
    assert got == [("c", 3), ("a", 2)]


def test_advisor_frame_drops_missing(spark):
    df = spark.createDataFrame([("A", "2019"), ("B", "s.d."), (None, "2020"), ("", "2021")],
                               "orientador string, ano string")
    got = sorted((r.orientador_principal, r.ano) for r in rp.advisor_frame(df).collect())
    assert got == [("", 2021.0), ("A", 2019.0)]
    got_csv = [r.orientador_principal for r in rp.advisor_frame(df, empty_as_null=True).collect()]
    assert got_csv == ["A"]


def test_advisor_frame_needs_column(spark):
    with pytest.raises(ValueError):
        rp.advisor_frame(spark.createDataFrame([(1,)], "x int"))


def test_item_table_nulls_last(spark):
    df = spark.createDataFrame([("o", "a", None, "t", "T1"), ("o", "a", "2019", "t", "T1")],
                               "orientador string, autor string, ano string, titulo string, cluster_name string")
    got = [r["Ano"] for r in rp.item_table(df).collect()]
    assert got == ["2019", None]


def test_wordcloud_weight_floor(spark):
    kw = _kw(spark, [(i, 1, "t", 0.002) for i in range(8)])
    got = rp.wordcloud_weights(kw, 6).collect()
    assert len(got) == 6 and all(r.weight == 0.01 for r in got)


def test_naming_computes_keywords_when_missing(spark):
    docs = spark.createDataFrame([(1, 0, [("web", 0, 0.9), ("api", 1, 0.5)]), (2, 0, [("web", 0, 0.7)])],
                                 "doc_id long, cluster int, tfidf array<struct<term:string,term_id:int,w:double>>")
    got = themes.name_clusters_from_docs(docs, themes.theme_table(spark)).first()
    assert got.cluster_name == "Desenvolvimento Web & API (C0)"


def test_term_means_do_not_depend_on_partitions(spark):
    import random
    from themelens.operators import themes
    r = random.Random(6)
    rows = [(k, k % 3, [(f"t{r.randrange(20)}", r.random() ** 9) for _ in range(12)]) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, cluster int, tfidf array<struct<term:string,w:double>>")
    found = [sorted(map(tuple, themes.cluster_term_means(d).select("cluster", "term", "score").collect()))
             for d in (df.repartition(1), df.repartition(7), df.orderBy("doc_id").coalesce(1))]
    assert found[0] == found[1] == found[2]
    sums = {}
    for k, c, terms in rows:
        for t, w in terms:
            sums[c, t] = sums.get((c, t), 0.0) + w / 200
    assert all(abs(s - sums[c, t]) < 1e-12 for c, t, s in found[0])


def test_pipeline_reports_save_and_folded_lexicon(spark, small_dir, tmp_path):
    from pyspark.sql import functions as F
    from themelens.plans.pipeline import theme_pipeline
    from themelens.sources import io
    from themelens.sources.tables import document_records
    records = document_records(spark, small_dir).withColumn("ano", F.lit("2020"))
    res = theme_pipeline(records, k=3, top_n=5, fold_lexicon=True)
    reports = res.reports(top_n=4)
    assert set(reports) == {"cluster_stats", "cluster_sizes", "items", "cloud_weights", "cloud_titles", "scatter", "ranking",
                            "themes_by_advisor", "advisor_order", "advisor_by_year"}
    assert reports["ranking"].count() == 4 and reports["cluster_sizes"].count() == 3
    assert reports["items"].count() == res.docs.count()
    for ending in (".csv", ".json"):
        path = str(tmp_path / f"out{ending}")
        saved = res.save(path)
        assert io.read_records(spark, path, schema=saved.schema).count() == saved.count()


def test_pipeline_keeps_texts_once(spark, monkeypatch):
    """The tables on disk hold the texts once, and the packed vectors of K-means are gone afterwards."""
    import os

    from themelens import session
    from themelens.operators import kmeans
    from themelens.plans import pipeline
    from themelens.operators import tfidf

    made, written = [], session.written

    def kept(df):
        out = written(df)
        made.append((out.columns, out.inputFiles()))
        return out

    for module in (kmeans, pipeline, tfidf):
        if hasattr(module, "written"):
            monkeypatch.setattr(module, "written", kept)
    words = "rede neural dados modelo treino banco consulta indice solo planta adubo colheita".split()
    rows = [(i, f"titulo {i}", " ".join(words[(i * 5 + j * (1 + i % 3)) % 12] for j in range(30))) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, titulo string, resumo string")
    found = pipeline.theme_pipeline(docs, k=3, tfidf_params={"min_df": 1, "max_df": 1.0}).result_table().collect()
    assert len(found) == 24 and all(r.cluster_name for r in found)
    there = [(columns, [f for f in files if os.path.exists(f.removeprefix("file://"))]) for columns, files in made]
    assert sum("resumo" in columns for columns, files in there if files) <= 1
    packed = [files for columns, files in there if "vals" in columns]
    assert packed and not any(packed)
