"""Registered queries: theme naming (C7-C10), word-cloud data (P3, P4), sources and
sinks (S1, S2, S8, S10) and the whole pipeline (Q1, P1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..operators import reports as rp
from ..operators import themes
from ..session import written
from ..sources import io
from ..sources.tables import document_records
from .pipeline import theme_pipeline, theme_pipeline_result
from .q_text import SQL_LANG_CLUSTERS, WS_EDGES, _lang_docs
from .registry import query


def _theme_values() -> str:
    rows = ", ".join(f"('{t.replace(chr(39), chr(39) * 2)}', {o}, '{w}')" for t, o, w in lx.theme_rows())
    return f"themes(theme, theme_order, keyword) AS (VALUES {rows})"


SQL_NAMES = SQL_LANG_CLUSTERS + f""",
{_theme_values()},
kw AS (SELECT cluster, rank, term, score FROM ranked WHERE rank <= 15),
scores AS (
  SELECT k.cluster, th.theme, th.theme_order, count(DISTINCT k.term) AS score
  FROM kw k JOIN themes th ON th.keyword = k.term WHERE k.rank <= {lx.NAMING_TOP_TERMS}
  GROUP BY k.cluster, th.theme, th.theme_order),
best AS (
  SELECT cluster, theme, score FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, theme_order) AS rn FROM scores)
  WHERE rn = 1),
fb AS (
  SELECT cluster, string_agg(upper(substr(term, 1, 1)) || lower(substr(term, 2)), ', ' ORDER BY rank) AS fallback
  FROM kw WHERE rank <= {lx.FALLBACK_TERMS} GROUP BY cluster),
names AS (
  SELECT fb.cluster,
         CASE WHEN best.score >= {lx.MIN_THEME_SCORE} THEN best.theme || ' (C' || CAST(fb.cluster AS VARCHAR) || ')'
              ELSE '{lx.FALLBACK_PREFIX}' || fb.fallback || ' (C' || CAST(fb.cluster AS VARCHAR) || ')' END
           AS cluster_name,
         CASE WHEN best.score >= {lx.MIN_THEME_SCORE} THEN best.theme END AS theme,
         CAST(coalesce(best.score, 0) AS BIGINT) AS theme_score
  FROM fb LEFT JOIN best USING (cluster))"""


def _keywords(spark, sf_dir):
    """The clustered documents and their keywords, 15 a cluster, as a table: naming reads them several times."""
    docs = _lang_docs(spark, sf_dir)
    return docs, written(themes.cluster_keywords(docs, top_n=15))


@query("theme_scores", oracle=SQL_NAMES + """
SELECT cluster, theme, CAST(score AS BIGINT) AS score FROM scores""")
def q_theme_scores(spark, sf_dir):
    _, kw = _keywords(spark, sf_dir)
    s = themes.theme_scores(kw, themes.theme_table(spark))
    return s.select("cluster", "theme", F.col("score").cast("long").alias("score"))


@query("theme_pick", oracle=SQL_NAMES + """
SELECT cluster, cluster_name, theme, theme_score FROM names""")
def q_theme_pick(spark, sf_dir):
    _, kw = _keywords(spark, sf_dir)
    return themes.name_clusters(kw, themes.theme_table(spark))


@query("fallback_name", oracle=SQL_NAMES + """
SELECT cluster, fallback FROM fb""")
def q_fallback_name(spark, sf_dir):
    _, kw = _keywords(spark, sf_dir)
    top = kw.filter(F.col("rank") <= lx.FALLBACK_TERMS)
    return top.groupBy("cluster").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: themes.capitalize(x["term"])),
        lx.FALLBACK_SEPARATOR).alias("fallback"))


@query("cluster_names", oracle=SQL_NAMES + """
SELECT a.doc_id, a.cluster, n.cluster_name FROM assign a LEFT JOIN names n USING (cluster)""")
def q_cluster_names(spark, sf_dir):
    docs, kw = _keywords(spark, sf_dir)
    names = themes.name_clusters(kw, themes.theme_table(spark))
    return themes.attach_names(docs.select("doc_id", "cluster"), names).select("doc_id", "cluster", "cluster_name")


@query("wordcloud_weights", oracle=SQL_NAMES + """
SELECT cluster, term, round(greatest(0.01, score), 6) AS weight FROM kw
WHERE cluster IN (SELECT DISTINCT cluster FROM kw ORDER BY cluster LIMIT 6)""")
def q_wordcloud_weights(spark, sf_dir):
    _, kw = _keywords(spark, sf_dir)
    w = rp.wordcloud_weights(kw, 6)
    return w.select("cluster", "term", F.round("weight", 6).alias("weight"))


@query("wordcloud_titles", oracle=SQL_NAMES + """
SELECT s.cluster, coalesce(n.cluster_name, 'Cluster ' || CAST(s.cluster AS VARCHAR)) AS title, s.n_docs
FROM sizes s LEFT JOIN names n USING (cluster)
WHERE s.cluster IN (SELECT DISTINCT cluster FROM kw ORDER BY cluster LIMIT 6)""")
def q_wordcloud_titles(spark, sf_dir):
    docs, kw = _keywords(spark, sf_dir)
    names = themes.name_clusters(kw, themes.theme_table(spark))
    return rp.wordcloud_titles(docs, kw, names, 6)


# ------------------------------------------------------------------ sources / sinks
SQL_RECORDS = """
WITH recs AS (
  SELECT doc_id, split_part(text, chr(10), 1) AS titulo, text AS resumo, source AS orientador FROM documents)"""


@query("src_json_roundtrip", oracle=SQL_RECORDS + """
SELECT titulo, orientador, resumo FROM recs""")
def q_src_json_roundtrip(spark, sf_dir):
    recs = document_records(spark, sf_dir).select("titulo", "orientador", "resumo")
    path = io.scratch_path(spark, "records") + ".json"
    io.write_records(recs, path)
    return io.read_records(spark, path).select("titulo", "orientador", "resumo")


@query("src_csv_roundtrip", oracle=SQL_RECORDS + """
SELECT titulo, orientador, resumo FROM recs""")
def q_src_csv_roundtrip(spark, sf_dir):
    """Columns out of order and most of the record's missing: they are bound by name.

    CSV cannot tell '' from a missing value: both read back as '' here.
    """
    recs = document_records(spark, sf_dir).select("resumo", "titulo", "orientador")
    path = io.scratch_path(spark, "records") + ".csv"
    io.write_records(recs, path)
    back = io.read_records(spark, path)
    return back.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("titulo", "orientador", "resumo")])


@query("save_projection", oracle=SQL_RECORDS + """
SELECT titulo, orientador, resumo FROM recs""")
def q_save_projection(spark, sf_dir):
    return io.result_projection(document_records(spark, sf_dir))


@query("record_preview", oracle=SQL_RECORDS + f""",
first AS (SELECT * FROM recs ORDER BY doc_id LIMIT 3),
long AS (
  SELECT doc_id, 0 AS field_pos, 'titulo' AS field, titulo AS value FROM first
  UNION ALL SELECT doc_id, 1, 'orientador', orientador FROM first
  UNION ALL SELECT doc_id, 2, 'resumo', resumo FROM first)
SELECT doc_id, CAST(field_pos AS BIGINT) AS field_pos, field,
       substr(value, 1, 100) || CASE WHEN length(value) > 100 THEN '...' ELSE '' END AS shown
FROM long WHERE value IS NOT NULL AND regexp_replace(value, '{WS_EDGES}', '', 'g') <> ''""")
def q_record_preview(spark, sf_dir):
    recs = document_records(spark, sf_dir).select("doc_id", "titulo", "orientador", "resumo")
    return io.record_preview(recs, "doc_id", columns=["titulo", "orientador", "resumo"])


# ------------------------------------------------------------------ whole pipeline
@query("theme_pipeline")
def q_theme_pipeline(spark, sf_dir):
    """Q1 (rows-only check): the result table of the whole pipeline."""
    return theme_pipeline_result(spark, sf_dir)


@query("scatter_data")
def q_scatter_data(spark, sf_dir):
    """P1 (rows-only check): scatter points of the pipeline result."""
    res = theme_pipeline(document_records(spark, sf_dir), k=6, top_n=15)
    return rp.scatter_data(res.docs)


@query("pipeline_invariants", oracle=SQL_LANG_CLUSTERS.split(",\nassign AS")[0] + """
SELECT (SELECT n FROM ndocs) AS n_docs, CAST(0 AS BIGINT) AS n_unnamed, CAST(0 AS BIGINT) AS n_bad_label""")
def q_pipeline_invariants(spark, sf_dir):
    """Q1 invariants: every kept document labelled in [0, 6) and named."""
    res = theme_pipeline(document_records(spark, sf_dir), k=6, top_n=15)
    d = res.docs
    return d.agg(F.count(F.lit(1)).alias("n_docs"),
                 F.count_if(F.col("cluster_name").isNull()).alias("n_unnamed"),
                 F.count_if((F.col("cluster") < 0) | (F.col("cluster") >= 6)).alias("n_bad_label"))
