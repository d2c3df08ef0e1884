"""Queries over inputs derived from the given tables, where every branch shows both outcomes.

The stored pages hold no item records and the items no gaps, so these queries build some:
one item page a document, with and without each field, under-sized, untitled and repeated
pages; report rows with missing advisors and odd years; a lexicon of words that the corpus
does hold.  The operators run on the result; the SQL states the expected values from the
same rules, without any markup.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..operators import closure, harvest, themes
from ..operators import reports as rp
from ..operators.crawl import harvest_all
from ..operators.ranks import global_rank
from ..sources.tables import order_records, read_table
from .q_themes import SQL_LANG_CLUSTERS, _keywords
from .registry import query

HOST = "https://a.omeka.net"


def _field(name, *values):
    parts = [F.concat(F.lit('<div class="element-text">'), v, F.lit("</div>")) for v in values]
    return F.concat(F.lit(f'<div id="{lx.FIELD_ID_PREFIX}{name}">'), *parts, F.lit("</div>"))


def item_pages(spark, sf_dir):
    """page_id, url, html: one item page for every document."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    n = F.col("doc_id")
    num = n.cast("string")
    none = F.lit("")

    def when(condition, value):
        return F.when(condition, value).otherwise(none)

    date = F.concat((F.lit(2000) + n % 20).cast("string"), F.lit("-05-01"))
    body = F.concat(
        F.lit("<html><head>"), when(n % 14 == 0, F.concat(F.lit("<title>Reserva "), num, F.lit("</title>"))), F.lit("</head><body>"),
        F.lit("<!-- <a href='/items/show/0'>old</a> -->"),
        when(n % 7 != 0, _field("title", F.concat(F.lit(" Obra\n "), num, F.lit(" &amp; cia ")))),
        _field("creator", F.concat(F.lit(" "), F.col("source")), none, F.col("lang")),
        when(n % 3 != 2, _field("contributor", F.concat(F.lit("Contrib "), F.col("source")))),
        when(n % 2 == 0, _field("advisor", F.concat(F.lit("Prof. "), F.col("lang")))),
        when(n % 5 == 1, _field("co-advisor", F.concat(F.lit("Co "), F.col("source")))),
        F.when(n % 3 == 0, _field("date", date)).when(n % 3 == 1, _field("date", F.lit("s.d."))).otherwise(none),
        _field("subject", F.col("lang")),
        _field("description", F.concat(F.col("source"), F.lit("\n\t texto"))),
        F.lit("<a href=/about>about</a><a href='/items/show/"), (n + 1).cast("string"), F.lit("'>next</a>"),
        when(n % 6 == 0, F.lit("<a href='https://b.org/items/show/1'>other</a><a href='/item/7'>7</a>")),
        when(n % 4 == 0, F.concat(F.lit("<a href='/x/../files/d"), num, F.lit(".pdf?dl=1&#38;v=2'>pdf</a>"))),
        F.lit("</body></html>"))
    html = F.when(n % 11 == 0, F.lit("<title>x</title>")).otherwise(body)
    url = F.concat(F.lit(f"{HOST}/items/show/"), F.when(n % 13 == 5, n - 1).otherwise(n).cast("string"))
    return d.select(n.alias("page_id"), url.alias("url"), html.alias("html"))


SQL_ITEM_PAGES = f"""
WITH pages_of AS (
  SELECT doc_id AS n, lang, source,
         '{HOST}/items/show/' || CAST(CASE WHEN doc_id % 13 = 5 THEN doc_id - 1 ELSE doc_id END AS VARCHAR) AS url
  FROM documents),
kept AS (SELECT url, min(n) AS n FROM pages_of WHERE n % 11 <> 0 GROUP BY url),
records AS (
  SELECT n AS page_id,
         CASE WHEN n % 7 <> 0 THEN 'Obra ' || n || ' & cia' WHEN n % 14 = 0 THEN 'Reserva ' || n ELSE '' END AS titulo,
         source || '; ' || lang AS autor,
         CASE WHEN n % 2 = 0 THEN 'Prof. ' || lang WHEN n % 3 <> 2 THEN 'Contrib ' || source ELSE '' END AS orientador,
         CASE WHEN n % 5 = 1 THEN 'Co ' || source ELSE '' END AS coorientador,
         CASE n % 3 WHEN 0 THEN CAST(2000 + n % 20 AS VARCHAR) WHEN 1 THEN 's.d.' ELSE '' END AS ano,
         'Curso' AS curso, 'Casa' AS instituicao, lang AS palavras_chave, source || ' texto' AS resumo, '' AS abstract,
         url AS link_acesso,
         CASE WHEN n % 4 = 0 THEN '{HOST}/files/d' || n || '.pdf?dl=1&v=2' ELSE '' END AS arquivo_pdf,
         'TCC' AS tipo_trabalho
  FROM pages_of JOIN kept USING (url, n))"""


def _records(spark, sf_dir):
    pages = harvest.dedupe_urls(harvest.size_guard(item_pages(spark, sf_dir)))
    return harvest.extract_records(pages, constants={"curso": "Curso", "instituicao": "Casa"})


@query("item_records", oracle=SQL_ITEM_PAGES + """
SELECT * FROM records WHERE titulo <> ''""")
def q_item_records(spark, sf_dir):
    """Under-sized, repeated and untitled pages go, every field has both outcomes."""
    return _records(spark, sf_dir)


def listing_pages(spark, sf_dir):
    """page_id, url, html: one listing page for every document, eight to a block.

    A page leads to the next one of its block and back to the first, but none leads to the last; the first page of a
    block leads to those of two more.  Some pages are too short to count, which cuts off what only they lead to.
    Every page links to its own item twice and to one further on, which may not exist.
    """
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    n = F.col("doc_id")
    block = F.floor(n / 8)

    def link(to, token="page="):
        return F.concat(F.lit(f"<a href='/items/browse?{token}"), to.cast("string"), F.lit("'>p</a>"))

    def item(to):
        return F.concat(F.lit("<a href='/items/show/"), to.cast("string"), F.lit("'>i</a>"))

    body = F.concat(
        F.lit("<html><body><!-- <a href='/items/browse?page=x'>no</a> -->"), item(n), item(n), item(n * 3),
        F.lit("<a href='https://b.org/items/show/1'>other</a><a href='/about'>about</a>"),
        F.when(n % 8 < 6, link(n + 1)).otherwise(link(n + 1, "p=")), link(block * 8),
        F.when(n % 8 == 0, F.concat(link(16 * block + 8), link(16 * block + 16))).otherwise(F.lit("")), F.lit("</body></html>"))
    html = F.when(n % 17 == 3, F.lit("<a href='/items/show/2'>short</a>")).otherwise(body)
    return d.select(n.alias("page_id"), F.concat(F.lit(f"{HOST}/items/browse?page="), n.cast("string")).alias("url"), html.alias("html"))


START = f"{HOST}/items/browse?page=0"
SQL_LISTING = SQL_ITEM_PAGES.replace("WITH pages_of", "WITH RECURSIVE pages_of", 1) + """,
edges AS (
  SELECT n, unnest(CASE WHEN n % 8 = 0 THEN [n // 8 * 8, 16 * (n // 8) + 8, 16 * (n // 8) + 16] ELSE [n // 8 * 8] END) AS m
  FROM pages_of WHERE n % 17 <> 3
  UNION ALL SELECT n, n + 1 FROM pages_of WHERE n % 17 <> 3 AND n % 8 < 6),
reach(n) AS (SELECT 0 UNION SELECT e.m FROM reach r JOIN edges e ON e.n = r.n),
items AS (
  SELECT DISTINCT unnest([p.n, p.n * 3]) AS n FROM reach r JOIN pages_of p ON p.n = r.n WHERE p.n % 17 <> 3)"""


@query("pagination_pages", oracle=SQL_LISTING + f"""
SELECT url, row_number() OVER (ORDER BY url) AS position
FROM (SELECT '{HOST}/items/browse?page=' || n AS url FROM reach)""")
def q_pagination_pages(spark, sf_dir):
    """H6 over real pagination links, with cycles and pages that none leads to; in the order of the text."""
    pages = listing_pages(spark, sf_dir)
    links = harvest.page_links(harvest.size_guard(pages)).select("url", "link")
    found = closure.pagination_closure(links, spark.createDataFrame([(START,)], "url string")).select("url")
    return global_rank(found, ["url"], "position")


def _crawl(spark, sf_dir):
    items = item_pages(spark, sf_dir)
    return harvest_all(listing_pages(spark, sf_dir).union(items), START, HOST, constants={"curso": "Curso", "instituicao": "Casa"})


@query("harvest_all", oracle=SQL_LISTING + f"""
SELECT r.* FROM records r JOIN items i ON r.link_acesso = '{HOST}/items/show/' || i.n WHERE titulo <> ''""")
def q_harvest_all(spark, sf_dir):
    """H1-H16 from the start page to the records: short, repeated and untitled item pages, and items without a page."""
    return _crawl(spark, sf_dir).records


@query("harvest_states", oracle=SQL_LISTING + f"""
SELECT '{HOST}/items/browse?page=' || r.n AS url, 'listing' AS kind,
       CASE WHEN p.n IS NULL OR p.n % 17 = 3 THEN 'failed' ELSE 'read' END AS state
FROM reach r LEFT JOIN pages_of p ON p.n = r.n
UNION ALL
SELECT '{HOST}/items/show/' || i.n, 'item', CASE WHEN r.titulo <> '' THEN 'read' WHEN r.titulo = '' THEN 'untitled' ELSE 'failed' END
FROM items i LEFT JOIN records r ON r.link_acesso = '{HOST}/items/show/' || i.n""")
def q_harvest_states(spark, sf_dir):
    """The state of every URL of the crawl."""
    return _crawl(spark, sf_dir).states.drop("depth")


@query("harvest_rate", oracle=SQL_LISTING + f"""
SELECT count_if(r.titulo <> '') AS n_ok, count(*) AS n_links, count_if(r.titulo <> '') / count(*) AS success_rate
FROM items i LEFT JOIN records r ON r.link_acesso = '{HOST}/items/show/' || i.n""")
def q_harvest_rate(spark, sf_dir):
    """H17 of the whole crawl."""
    return _crawl(spark, sf_dir).rate


@query("item_record_stats", oracle=SQL_ITEM_PAGES + """
SELECT (SELECT count(DISTINCT link_acesso) FROM records WHERE titulo <> '') AS n_ok, count(DISTINCT url) AS n_links,
       (SELECT count(DISTINCT link_acesso) FROM records WHERE titulo <> '') / count(DISTINCT url) AS success_rate
FROM pages_of""")
def q_item_record_stats(spark, sf_dir):
    """H17 below 100 %: short and untitled pages give no record."""
    links = item_pages(spark, sf_dir).select(F.col("url").alias("link"))
    return harvest.extraction_stats(links, _records(spark, sf_dir))


@query("item_links", oracle=SQL_ITEM_PAGES + f"""
SELECT DISTINCT '{HOST}/items/show/' || CAST(n + 1 AS VARCHAR) AS link FROM pages_of WHERE n % 11 <> 0""")
def q_item_links(spark, sf_dir):
    """H2-H5: links of other hosts, other paths and commented markup are not item links."""
    return harvest.item_links(item_pages(spark, sf_dir))


@query("item_page_links", oracle=SQL_ITEM_PAGES + """
SELECT n AS page_id, CAST(pos AS BIGINT) AS pos, href, is_item FROM (
  SELECT n, 1 AS pos, '/about' AS href, false AS is_item FROM pages_of WHERE n % 11 <> 0
  UNION ALL SELECT n, 2, '/items/show/' || CAST(n + 1 AS VARCHAR), true FROM pages_of WHERE n % 11 <> 0
  UNION ALL SELECT n, 3, 'https://b.org/items/show/1', true FROM pages_of WHERE n % 11 <> 0 AND n % 6 = 0
  UNION ALL SELECT n, 4, '/item/7', true FROM pages_of WHERE n % 11 <> 0 AND n % 6 = 0
  UNION ALL SELECT n, CASE WHEN n % 6 = 0 THEN 5 ELSE 3 END, '/x/../files/d' || n || '.pdf?dl=1&v=2', false
  FROM pages_of WHERE n % 11 <> 0 AND n % 4 = 0)""")
def q_item_page_links(spark, sf_dir):
    """H2: unquoted and quoted references, decoded, with both values of ``is_item``."""
    return harvest.page_links(item_pages(spark, sf_dir)).select("page_id", "pos", "href", "is_item")


@query("report_rows_with_gaps", oracle="""
SELECT k AS item_id, CASE k % 7 WHEN 1 THEN 'Ana' ELSE name END AS orientador_principal,
       CASE k % 5 WHEN 2 THEN 1000 ELSE 2019 END::DOUBLE AS ano
FROM (SELECT o.o_orderkey AS k, c.c_name AS name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)
WHERE k % 7 <> 0 AND k % 5 < 3""")
def q_report_rows_with_gaps(spark, sf_dir):
    """A1-A3: missing advisors and years that aren't numbers are dropped."""
    k = F.col("item_id")
    years = F.element_at(F.array(*map(F.lit, ["2019", " 2019 ", "1e3", "s.d.", "2_019"])), (k % 5 + 1).cast("int"))
    advisor = F.when(k % 7 == 1, F.lit(" Ana ; Bia")).when(k % 7 != 0, F.col("orientador"))
    rows = order_records(spark, sf_dir).withColumn("ano", years).withColumn("orientador", advisor)
    return rp.advisor_frame(rows).select("item_id", "orientador_principal", "ano")


SQL_CORPUS_THEMES = SQL_LANG_CLUSTERS + f""",
kw AS (SELECT cluster, rank, term, score FROM ranked WHERE rank <= 15),
themes AS (
  SELECT DISTINCT CASE WHEN rank % 2 = 1 THEN 'Impar' ELSE 'Par' END AS theme, CAST(rank % 2 AS INTEGER) AS theme_order,
         term AS keyword
  FROM kw WHERE cluster <> (SELECT max(cluster) FROM kw) AND rank <= 5),
scores AS (
  SELECT k.cluster, t.theme, t.theme_order, count(DISTINCT k.term) AS score
  FROM kw k JOIN themes t ON t.keyword = k.term WHERE k.rank <= {lx.NAMING_TOP_TERMS} GROUP BY ALL)"""


def _corpus_themes(kw):
    last = kw.agg(F.max("cluster").alias("last"))
    odd = F.col("rank") % 2
    return (kw.where("rank <= 5").join(F.broadcast(last), F.col("cluster") != F.col("last"))  # one row
            .select(F.when(odd == 1, "Impar").otherwise("Par").alias("theme"), odd.cast("int").alias("theme_order"),
                    F.col("term").alias("keyword")).distinct())


@query("theme_scores_in_corpus", oracle=SQL_CORPUS_THEMES + """
SELECT cluster, theme, CAST(score AS BIGINT) AS score FROM scores""")
def q_theme_scores_in_corpus(spark, sf_dir):
    """C7 with a lexicon taken from the clusters' own words."""
    _, kw = _keywords(spark, sf_dir)
    found = themes.theme_scores(kw, _corpus_themes(kw))
    return found.select("cluster", "theme", F.col("score").cast("long").alias("score"))


@query("theme_pick_in_corpus", oracle=SQL_CORPUS_THEMES + f"""
SELECT cluster, CASE WHEN score >= {lx.MIN_THEME_SCORE} THEN theme END AS theme, CAST(coalesce(score, 0) AS BIGINT) AS theme_score
FROM (SELECT DISTINCT cluster FROM kw) LEFT JOIN (
  SELECT cluster, theme, score FROM scores
  QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, theme_order) = 1) USING (cluster)""")
def q_theme_pick_in_corpus(spark, sf_dir):
    """The best theme, ties to the earlier one, fallback below the least score."""
    _, kw = _keywords(spark, sf_dir)
    return themes.name_clusters(kw, _corpus_themes(kw)).select("cluster", "theme", "theme_score")
