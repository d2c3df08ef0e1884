"""Queries of the pipeline's second half (C4, C10, A1-A9, P1-P4, S8) on documents whose labels are given.

The labels of K-means can't be stated in SQL, so these take them from the ids: clusters 0 to 3, the last without a
name, and noise; advisors that are missing or empty, and years that are none, occur as well.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..operators import themes
from ..sources import io
from ..sources.tables import first_line, read_table
from .pipeline import PipelineResult
from .q_text import WS_EDGES
from .registry import query

NAMES = [(0, "Zero"), (1, "Um"), (2, "Dois")]

SQL = f"""
WITH docs AS (
  SELECT doc_id, split_part(text, chr(10), 1) AS titulo, 'Autor ' || doc_id % 50 AS autor,
         CASE doc_id % 9 WHEN 4 THEN NULL WHEN 5 THEN '' ELSE source || ' ; ' || lang END AS orientador,
         CASE doc_id % 4 WHEN 0 THEN '2019' WHEN 1 THEN ' 2020 ' WHEN 2 THEN 's.d.' ELSE '2021.0' END AS ano,
         text AS resumo, lang AS palavras_chave, CAST(doc_id % 5 - 1 AS INTEGER) AS cluster,
         doc_id / 4 AS dim_x, -doc_id / 8 AS dim_y FROM documents),
names(cluster, cluster_name) AS (VALUES {', '.join(f"({k}, '{n}')" for k, n in NAMES)}),
named AS (
  SELECT d.*, CASE WHEN d.cluster = -1 THEN '{lx.NOISE_NAME}' ELSE n.cluster_name END AS cluster_name
  FROM docs d LEFT JOIN names n USING (cluster)),
adv AS (
  SELECT regexp_replace(split_part(orientador, ';', 1), '{WS_EDGES}', '', 'g') AS advisor, cluster_name,
         CASE doc_id % 4 WHEN 0 THEN 2019.0 WHEN 1 THEN 2020.0 ELSE 2021.0 END::DOUBLE AS ano
  FROM named WHERE orientador IS NOT NULL AND doc_id % 4 <> 2),
top AS (SELECT advisor FROM adv GROUP BY advisor ORDER BY count(*) DESC, advisor LIMIT 15),
rows AS (SELECT adv.* FROM adv JOIN top USING (advisor)),
kw AS (
  SELECT cluster, palavras_chave AS term, count(*) / any_value(total) - 0.25 AS score
  FROM (SELECT *, count(*) OVER (PARTITION BY cluster) AS total FROM docs WHERE cluster >= 0) GROUP BY cluster, palavras_chave)"""


def _result(spark, sf_dir) -> PipelineResult:
    n, d = F.col("doc_id"), read_table(spark, sf_dir, "documents")
    advisor = F.when(n % 9 == 5, F.lit("")).when(n % 9 != 4, F.concat("source", F.lit(" ; "), "lang"))
    years = F.element_at(F.array(*map(F.lit, ["2019", " 2020 ", "s.d.", "2021.0"])), (n % 4 + 1).cast("int"))
    docs = d.select(
        "doc_id", first_line(F.col("text")).alias("titulo"), F.concat(F.lit("Autor "), (n % 50).cast("string")).alias("autor"),
        advisor.alias("orientador"), years.alias("ano"), F.col("text").alias("resumo"), F.col("lang").alias("palavras_chave"),
        (n % 5 - 1).cast("int").alias("cluster"), (n / 4).alias("dim_x"), (-n / 8).alias("dim_y"))
    sizes = themes.cluster_sizes(docs)
    keywords = docs.where("cluster >= 0").groupBy("cluster", F.col("palavras_chave").alias("term")).agg(F.count("*").alias("m")).join(
        sizes, "cluster").select("cluster", "term", (F.col("m") / F.col("n_docs") - 0.25).alias("score"))
    names = spark.createDataFrame(NAMES, "cluster int, cluster_name string")
    return PipelineResult(themes.attach_names(docs, names), keywords, names, None)


def _report(name, sql, *columns):
    @query(f"clustered_{name}", oracle=SQL + sql)
    def report(spark, sf_dir):
        return _result(spark, sf_dir).reports()[name].selectExpr(*columns)


_report("cluster_stats", """
SELECT count(DISTINCT cluster) FILTER (cluster <> -1) AS n_clusters, count_if(cluster = -1) AS n_noise,
       round(count_if(cluster = -1) / count(*), 6) AS noise_share, count(*) AS n_docs FROM docs""",
        "n_clusters", "n_noise", "round(noise_share, 6) AS noise_share", "n_docs")
_report("ranking", """
SELECT advisor AS "Orientador", count(*) AS "Quantidade" FROM rows GROUP BY advisor""", "Orientador", "Quantidade")
_report("themes_by_advisor", """
SELECT advisor AS orientador_principal, cluster_name, count(*) AS count FROM rows WHERE cluster_name IS NOT NULL GROUP BY ALL""",
        "orientador_principal", "cluster_name", "count")
_report("advisor_by_year", """
SELECT ano, advisor AS orientador_principal, count(*) AS count FROM rows GROUP BY ALL""", "ano", "orientador_principal", "count")
_report("advisor_order", """
SELECT advisor AS orientador_principal, count(*) AS total, row_number() OVER (ORDER BY count(*) DESC, advisor) AS position
FROM rows WHERE cluster_name IS NOT NULL GROUP BY advisor""", "orientador_principal", "total", "position")
_report("items", """
SELECT orientador AS "Orientador", autor AS "Autor", ano AS "Ano", titulo AS "Título do TCC", cluster_name AS "Tema (Cluster)" FROM named""", "*")
_report("scatter", """
SELECT dim_x, dim_y, cluster_name, titulo AS hover FROM named""", "dim_x", "dim_y", "cluster_name", "hover")
_report("cloud_weights", """
SELECT cluster, term, round(greatest(0.01, score), 6) AS weight FROM kw""", "cluster", "term", "round(weight, 6) AS weight")
_report("cloud_titles", """
SELECT cluster, coalesce(cluster_name, 'Cluster ' || cluster) AS title, count(*) AS n_docs
FROM named WHERE cluster >= 0 GROUP BY cluster, cluster_name""", "cluster", "title", "n_docs")


def _saved(spark, sf_dir, ending):
    """S8 written with all ten columns and read back; a table of text does not tell '' from missing."""
    path = io.scratch_path(spark, "result") + ending
    saved = _result(spark, sf_dir).save(path)
    return io.read_records(spark, path, schema=saved.schema)


SQL_SAVED = SQL + """
SELECT titulo, autor, ADVISOR AS orientador, ano, resumo, palavras_chave, cluster, cluster_name, dim_x, dim_y FROM named"""


@query("saved_csv", oracle=SQL_SAVED.replace("ADVISOR", "coalesce(orientador, '')"))
def q_saved_csv(spark, sf_dir):
    return _saved(spark, sf_dir, ".csv").withColumn("orientador", F.coalesce("orientador", F.lit("")))


@query("saved_json", oracle=SQL_SAVED.replace("ADVISOR", "orientador"))
def q_saved_json(spark, sf_dir):
    return _saved(spark, sf_dir, ".json")
