"""Registered queries: page source and harvest."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions import urls
from ..operators import closure, harvest
from ..operators import reports as rp
from ..sources.tables import read_table
from .registry import query

WS_EDGES, WS_RUN = tx.WS_EDGES_PATTERN, tx.WS_RUN_PATTERN
HREF = harvest.ANCHOR_HREF_PATTERN.replace("'", "''")
ATEXT = harvest.ANCHOR_TEXT_PATTERN
#: test parameters: the stored pages have no item paths, so the URL predicate and the
#: attachment selector are exercised with tokens that occur in them
TEST_HOST_TOKEN, TEST_PATH_TOKEN, TEST_ATTACHMENT = "blog", "/en/", "/the"


def _clean_sql(x):
    return f"coalesce(regexp_replace(regexp_replace({x}, '{WS_EDGES}', '', 'g'), '{WS_RUN}', ' ', 'g'), '')"


SQL_LINKS = f"""
WITH hrefs AS (
  SELECT page_id, url, {urls.base_sql('url')} AS base,
         list_transform(regexp_extract_all(html, '{HREF}', 1), lambda h: replace(h, '&amp;', '&')) AS hs
  FROM pages),
links AS (
  SELECT page_id, url, base, CAST(generate_subscripts(hs, 1) AS BIGINT) AS pos, unnest(hs) AS href FROM hrefs),
resolved AS (SELECT *, {urls.resolve_sql('href', 'base')} AS link FROM links)"""

SQL_TITLES = f"""
WITH t AS (
  SELECT page_id, url,
         {_clean_sql("replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&')")} AS titulo
  FROM pages)"""

YEAR_SQL = ("CASE WHEN regexp_matches(url, '\\p{Nd}{4}') THEN regexp_extract(url, '(\\p{Nd}{4})', 1) "
            "ELSE url END")


def _pages(spark, sf_dir):
    return read_table(spark, sf_dir, "pages", spread=True)


@query("src_pages", oracle="""
SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS n_bytes FROM pages""")
def q_src_pages(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "url", F.octet_length("html").cast("long").alias("n_bytes"))


@query("page_size_guard", oracle=f"""
SELECT page_id, url FROM pages WHERE strlen(html) >= {lx.MIN_BODY_BYTES}""")
def q_page_size_guard(spark, sf_dir):
    return harvest.size_guard(_pages(spark, sf_dir)).select("page_id", "url")


@query("extract_links", oracle=SQL_LINKS + """
SELECT page_id, pos, href,
       regexp_matches(href, '/items/show/\\d+') OR regexp_matches(href, '/item/\\d+')
       OR regexp_matches(href, '/items/\\d+') AS is_item
FROM links""")
def q_extract_links(spark, sf_dir):
    return harvest.page_links(_pages(spark, sf_dir)).select("page_id", "pos", "href", "is_item")


@query("resolve_links", oracle=SQL_LINKS + """
SELECT page_id, pos, link FROM resolved""")
def q_resolve_links(spark, sf_dir):
    return harvest.page_links(_pages(spark, sf_dir)).select("page_id", "pos", "link")


@query("valid_url_filter", oracle=f"""
SELECT page_id, url,
       coalesce(regexp_extract(url, '{urls.NETLOC_PATTERN}', 1) <> ''
                AND contains(regexp_extract(url, '{urls.NETLOC_PATTERN}', 1), '{TEST_HOST_TOKEN}')
                AND contains(regexp_extract(url, '{urls.PATH_PATTERN}', 1), '{TEST_PATH_TOKEN}'), false) AS ok
FROM pages""")
def q_valid_url_filter(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.select("page_id", "url", urls.is_item_url(F.col("url"), TEST_HOST_TOKEN, TEST_PATH_TOKEN).alias("ok"))


@query("distinct_links", oracle=SQL_LINKS + """
SELECT DISTINCT link FROM resolved""")
def q_distinct_links(spark, sf_dir):
    return harvest.page_links(_pages(spark, sf_dir)).select("link").distinct()


@query("links_per_page", oracle=SQL_LINKS + """
SELECT page_id, count(*) AS n_links, count(DISTINCT link) AS n_distinct FROM resolved GROUP BY page_id""")
def q_links_per_page(spark, sf_dir):
    return (harvest.page_links(_pages(spark, sf_dir)).groupBy("page_id")
            .agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("link").alias("n_distinct")))


@query("link_closure", oracle=SQL_LINKS.replace("WITH hrefs", "WITH RECURSIVE hrefs", 1) + """,
edges AS (SELECT DISTINCT url AS src, link AS dst FROM resolved),
starts AS (SELECT url AS start, url AS node FROM pages WHERE contains(url, 'page=')),
reach(start, node) AS (
  SELECT start, node FROM starts
  UNION
  SELECT reach.start, e.dst FROM reach JOIN edges e ON e.src = reach.node)
SELECT start, node AS url FROM reach""")
def q_link_closure(spark, sf_dir):
    """Closure from every page whose URL carries ``page=`` over the page -> link
    graph (all links; the stored hrefs carry no pagination token)."""
    p = _pages(spark, sf_dir)
    links = harvest.page_links(p)
    starts = p.filter(F.col("url").contains("page=")).select("url")
    return closure.pagination_closure(links, starts, token="")


@query("dedupe_urls", oracle="""
SELECT url, min(page_id) AS page_id FROM pages GROUP BY url""")
def q_dedupe_urls(spark, sf_dir):
    return harvest.dedupe_urls(_pages(spark, sf_dir).select("page_id", "url"))


@query("extract_year", oracle=f"""
SELECT page_id, {YEAR_SQL} AS ano FROM pages""")
def q_extract_year(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", harvest.year_of(F.col("url")).alias("ano"))


@query("coerce_year", oracle=f"""
SELECT page_id, CASE WHEN regexp_matches(y, '{rp.NUMBER_PATTERN}')
                     THEN TRY_CAST(regexp_replace(y, '{WS_EDGES}', '', 'g') AS DOUBLE) END AS ano
FROM (SELECT page_id, {YEAR_SQL} AS y FROM pages)""")
def q_coerce_year(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", rp.coerce_number(harvest.year_of(F.col("url"))).alias("ano"))


@query("title_fallback", oracle=SQL_TITLES + """
SELECT page_id, titulo FROM t""")
def q_title_fallback(spark, sf_dir):
    return harvest.extract_records(_pages(spark, sf_dir), drop_untitled=False).select("page_id", "titulo")


@query("join_multivalue", oracle=f"""
SELECT page_id,
       array_to_string(list_filter(list_transform(regexp_extract_all(html, '{ATEXT}', 1),
                       lambda v: {_clean_sql("replace(v, '&amp;', '&')")}), lambda v: v <> ''), '; ') AS joined
FROM pages""")
def q_join_multivalue(spark, sf_dir):
    p = _pages(spark, sf_dir)
    texts = F.transform(F.regexp_extract_all("html", F.lit(ATEXT), 1),
                        lambda v: F.replace(v, F.lit("&amp;"), F.lit("&")))
    return p.select("page_id", harvest.join_values(texts).alias("joined"))


@query("field_precedence", oracle=f"""
SELECT page_id, coalesce(nullif(h1, ''), nullif(title, ''), '') AS orientador FROM (
  SELECT page_id,
         {_clean_sql("regexp_extract(html, '(?s)<h2>(.*?)</h2>', 1)")} AS h1,
         {_clean_sql("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title
  FROM pages)""")
def q_field_precedence(spark, sf_dir):
    """'contributor' = <title> text, 'advisor' = <h2> text: the later non-empty wins."""
    p = _pages(spark, sf_dir)
    contributor = tx.clean_whitespace(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))
    advisor = tx.clean_whitespace(F.regexp_extract("html", r"(?s)<h2>(.*?)</h2>", 1))
    return p.select("page_id", F.coalesce(F.nullif(advisor, F.lit("")), F.nullif(contributor, F.lit("")),
                                          F.lit("")).alias("orientador"))


@query("first_attachment", oracle=SQL_LINKS + f""",
firsts AS (
  SELECT page_id, min_by(link, pos) AS link FROM resolved WHERE contains(href, '{TEST_ATTACHMENT}') GROUP BY page_id)
SELECT p.page_id, coalesce(f.link, '') AS arquivo_pdf FROM pages p LEFT JOIN firsts f USING (page_id)""")
def q_first_attachment(spark, sf_dir):
    r = harvest.extract_records(_pages(spark, sf_dir), attachment_token=TEST_ATTACHMENT, drop_untitled=False)
    return r.select("page_id", "arquivo_pdf")


@query("assemble_record", oracle=SQL_TITLES + """
SELECT page_id, titulo, '' AS autor, '' AS orientador, '' AS coorientador, '' AS ano, '' AS curso,
       '' AS instituicao, '' AS palavras_chave, '' AS resumo, '' AS abstract, p.url AS link_acesso,
       '' AS arquivo_pdf, 'TCC' AS tipo_trabalho
FROM pages p JOIN t USING (page_id) WHERE titulo <> ''""")
def q_assemble_record(spark, sf_dir):
    return harvest.extract_records(_pages(spark, sf_dir))


@query("drop_untitled", oracle=SQL_TITLES + """
SELECT count(*) AS n_records FROM t WHERE titulo <> ''""")
def q_drop_untitled(spark, sf_dir):
    return harvest.extract_records(_pages(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_records"))


@query("extraction_stats", oracle=SQL_TITLES + """
SELECT count_if(titulo <> '') AS n_ok, count(*) AS n_links, count_if(titulo <> '') / count(*) AS success_rate
FROM (SELECT DISTINCT url, titulo FROM t)""")
def q_extraction_stats(spark, sf_dir):
    p = _pages(spark, sf_dir)
    links = p.select(F.col("url").alias("link"))
    return harvest.extraction_stats(links, harvest.extract_records(p))


@query("stream_records", oracle=SQL_TITLES + """
SELECT page_id, titulo, p.url AS link_acesso
FROM pages p JOIN t USING (page_id) WHERE titulo <> ''""")
def q_stream_records(spark, sf_dir):
    """The page table read as a file stream, harvested batch by batch into a sink."""
    import uuid
    from ..session import ensure_checkpoint_dir
    from ..streaming import run_to_completion
    root = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    # as a pattern the name stands for one file as well as for a folder of files
    out = run_to_completion(spark, os.path.join(sf_dir, "{pages}.parquet"), os.path.join(root, "records"),
                            checkpoint=os.path.join(root, "ckpt"))
    return out.select("page_id", "titulo", "link_acesso")


@query("extract_fields", oracle=f"""
SELECT page_id, CAST(len(regexp_extract_all(html, 'id="{lx.FIELD_ID_PREFIX}[^"]*"')) AS BIGINT) AS n_fields
FROM pages""")
def q_extract_fields(spark, sf_dir):
    """H8: metadata elements found per page by the one-pass scan (the stored test
    pages carry none, so every count is 0 -- a check against false positives)."""
    from ..functions.html import page_parts
    p = _pages(spark, sf_dir)
    parts = p.select("page_id", page_parts(F.col("html"), lx.FIELD_ID_PREFIX, lx.FIELD_VALUE_CLASS,
                                           lx.TITLE_FALLBACK_TAGS, lx.ATTACHMENT_TOKEN).alias("_p"))
    return parts.select("page_id", F.coalesce(F.size(F.map_keys("_p.fields")), F.lit(0)).cast("long").alias("n_fields"))
