"""Registered queries: advisor reports, item table, cluster statistics (A, P2, C4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import reports as rp
from ..operators import themes
from ..sources.tables import order_records, read_table
from .registry import query

WS_EDGES = tx.WS_EDGES_PATTERN
NUMBER = rp.NUMBER_PATTERN

SQL_ITEMS = f"""
WITH items AS (
  SELECT o.o_orderkey AS item_id, c.c_name AS orientador, o.o_orderpriority AS cluster_name,
         strftime(o.o_orderdate, '%Y') AS ano_txt, 'Item ' || CAST(o.o_orderkey AS VARCHAR) AS titulo,
         'Autor ' || CAST(o.o_custkey AS VARCHAR) AS autor
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
adv AS (
  SELECT item_id, orientador, cluster_name, titulo, autor,
         regexp_replace(split_part(orientador, ';', 1), '{WS_EDGES}', '', 'g') AS orientador_principal,
         CASE WHEN regexp_matches(ano_txt, '{NUMBER}')
              THEN TRY_CAST(regexp_replace(ano_txt, '{WS_EDGES}', '', 'g') AS DOUBLE) END AS ano
  FROM items),
complete AS (SELECT * FROM adv WHERE orientador_principal IS NOT NULL AND ano IS NOT NULL),
top AS (
  SELECT orientador_principal, count(*) AS count FROM complete GROUP BY orientador_principal
  ORDER BY count DESC, orientador_principal LIMIT 15),
top_rows AS (SELECT * FROM complete WHERE orientador_principal IN (SELECT orientador_principal FROM top))"""


def _adv(spark, sf_dir):
    return rp.advisor_frame(order_records(spark, sf_dir))


def _top_rows(spark, sf_dir):
    return rp.top_advisor_rows(_adv(spark, sf_dir), 15)


@query("principal_advisor", oracle=f"""
SELECT doc_id, regexp_replace(split_part(source || ' ; ' || lang, ';', 1), '{WS_EDGES}', '', 'g')
       AS orientador_principal
FROM documents""")
def q_principal_advisor(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", rp.principal_advisor(F.concat_ws(" ; ", "source", "lang")).alias("orientador_principal"))


@query("drop_incomplete", oracle=SQL_ITEMS + """
SELECT item_id, orientador_principal, ano FROM complete""")
def q_drop_incomplete(spark, sf_dir):
    return _adv(spark, sf_dir).select("item_id", "orientador_principal", "ano")


@query("top_advisors", oracle=SQL_ITEMS + """
SELECT orientador_principal, count FROM top""")
def q_top_advisors(spark, sf_dir):
    return rp.top_advisors(_adv(spark, sf_dir), 15)


@query("top_advisor_rows", oracle=SQL_ITEMS + """
SELECT item_id, orientador_principal FROM top_rows""")
def q_top_advisor_rows(spark, sf_dir):
    return _top_rows(spark, sf_dir).select("item_id", "orientador_principal")


@query("advisor_ranking", oracle=SQL_ITEMS + """
SELECT orientador_principal AS "Orientador", count(*) AS "Quantidade" FROM top_rows GROUP BY 1""")
def q_advisor_ranking(spark, sf_dir):
    return rp.advisor_ranking(_top_rows(spark, sf_dir))


@query("themes_by_advisor", oracle=SQL_ITEMS + """
SELECT orientador_principal, cluster_name, count(*) AS count FROM top_rows
WHERE orientador_principal IS NOT NULL AND cluster_name IS NOT NULL GROUP BY 1, 2""")
def q_themes_by_advisor(spark, sf_dir):
    return rp.themes_by_advisor(_top_rows(spark, sf_dir))


@query("advisor_by_year", oracle=SQL_ITEMS + """
SELECT ano, orientador_principal, count(*) AS count FROM top_rows WHERE ano IS NOT NULL GROUP BY 1, 2""")
def q_advisor_by_year(spark, sf_dir):
    return rp.advisor_by_year(_top_rows(spark, sf_dir))


@query("category_order", oracle=SQL_ITEMS + """,
counts AS (SELECT orientador_principal, cluster_name, count(*) AS count FROM top_rows GROUP BY 1, 2),
totals AS (SELECT orientador_principal, CAST(sum(count) AS BIGINT) AS total FROM counts GROUP BY 1)
SELECT orientador_principal, total,
       CAST(row_number() OVER (ORDER BY total DESC, orientador_principal) AS BIGINT) AS position FROM totals""")
def q_category_order(spark, sf_dir):
    return rp.category_order(rp.themes_by_advisor(_top_rows(spark, sf_dir)))


@query("item_table", oracle="""
SELECT c.c_name AS "Orientador", 'Autor ' || CAST(o.o_custkey AS VARCHAR) AS "Autor",
       strftime(o.o_orderdate, '%Y') AS "Ano", 'Item ' || CAST(o.o_orderkey AS VARCHAR) AS "Título do TCC",
       o.o_orderpriority AS "Tema (Cluster)"
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def q_item_table(spark, sf_dir):
    return rp.item_table(order_records(spark, sf_dir))


@query("cluster_sizes", oracle="""
SELECT CAST(label AS BIGINT) AS cluster, count(*) AS n_docs FROM embeddings GROUP BY 1""")
def q_cluster_sizes(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("cluster"))
    return themes.cluster_sizes(e)


@query("cluster_stats", oracle="""
SELECT count(DISTINCT CASE WHEN c <> -1 THEN c END) AS n_clusters, count_if(c = -1) AS n_noise,
       count_if(c = -1) / count(*) AS noise_share, count(*) AS n_docs
FROM (SELECT CASE WHEN label = 9 THEN -1 ELSE CAST(label AS BIGINT) END AS c FROM embeddings)""")
def q_cluster_stats(spark, sf_dir):
    # label 9 stands for noise so that the noise branch is exercised
    e = read_table(spark, sf_dir, "embeddings").select(
        F.when(F.col("label") == 9, F.lit(-1)).otherwise(F.col("label")).cast("long").alias("cluster"))
    return themes.cluster_stats(e)
