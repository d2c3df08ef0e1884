"""Stored pages -> item links -> structured records.

The network fetch of the original crawl is re-aimed at a stored ``pages``
table ``(page_id, url, html)``.  Links and records are DataFrame operations: URL
resolution and clean-up are JVM built-ins, dedupe is a distinct/grouping, and only
the reading of links and element-scoped fields runs in one Arrow-batched parse per
page (:mod:`themelens.functions.html`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions import urls
from ..functions.html import page_parts

#: quoted href attribute values of anchor tags, for the SQL oracles (plain markup)
ANCHOR_HREF_PATTERN = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""
#: anchor texts (anchors without nested markup)
ANCHOR_TEXT_PATTERN = r"(?is)<a\s[^>]*>([^<]*)</a>"


def size_guard(pages: DataFrame, min_bytes: int = lx.MIN_BODY_BYTES) -> DataFrame:
    """H1: drop bodies under ``min_bytes`` bytes (UTF-8)."""
    return pages.filter(F.octet_length("html") >= F.lit(min_bytes))


def anchor_hrefs(html) -> "F.Column":
    """All anchor hrefs in document order, decoded, from the one parse of the page."""
    return page_parts(html, lx.FIELD_ID_PREFIX, lx.FIELD_VALUE_CLASS, (), None)["hrefs"]


def page_links(pages: DataFrame, base=None, patterns=None) -> DataFrame:
    """H2 + H3: (page_id, url, pos, href, link, is_item) for every anchor.

    ``is_item`` marks hrefs matching any of ``patterns`` (search semantics);
    ``link`` is the href resolved against ``base`` (a site root; default: the
    root of the page's own URL).
    """
    pats = lx.ITEM_LINK_PATTERNS if patterns is None else patterns
    base_col = urls.site_base(F.col("url")) if base is None else F.lit(base)
    hrefs = pages.select("page_id", "url", base_col.alias("_base"), anchor_hrefs(F.col("html")).alias("_h"))
    out = tx.explode_rows(hrefs, ["page_id", "url", "_base"], "_h", "href", with_pos=True)
    item = F.lit(False)
    for p in pats:
        item = item | F.col("href").rlike(p)
    return out.select("page_id", "url", (F.col("pos") + 1).cast("long").alias("pos"), "href",
                      urls.resolve_url(F.col("href"), F.col("_base")).alias("link"), item.alias("is_item"))


def item_links(pages: DataFrame, base=None, patterns=None, host_token: str = lx.ITEM_HOST_TOKEN,
               path_token: str = lx.ITEM_PATH_TOKEN) -> DataFrame:
    """H2-H5: distinct valid item links across the collection (one row per link)."""
    links = page_links(pages, base, patterns).filter("is_item")
    return (links.filter(urls.is_item_url(F.col("link"), host_token, path_token))
            .select("link").distinct())


def dedupe_urls(pages: DataFrame) -> DataFrame:
    """H7: one page per URL, deterministically the smallest ``page_id``."""
    return pages.groupBy("url").agg(F.min_by(F.struct(*[c for c in pages.columns if c != "url"]),
                                             F.col("page_id")).alias("p")).select("url", "p.*")


def year_of(c):
    """First run of four digits; text without one is kept as it is."""
    pat = r"(\p{Nd}{4})"
    return F.when(c.rlike(pat), F.regexp_extract(c, pat, 1)).otherwise(c)


def join_values(arr):
    """H9 + H10: clean each value, drop empty ones, join with '; ' in order."""
    cleaned = F.transform(arr, lambda v: tx.clean_whitespace(v))
    return F.concat_ws(lx.MULTI_VALUE_SEPARATOR, F.filter(cleaned, lambda v: v != F.lit("")))


def extract_records(pages: DataFrame, base=None, field_map=None, constants=None,
                    attachment_token: str = lx.ATTACHMENT_TOKEN, drop_untitled: bool = True) -> DataFrame:
    """One record (13 string columns, '' for missing) per page.

    ``constants`` fills ``curso``, ``instituicao`` and ``tipo_trabalho``.
    """
    fmap = lx.FIELD_MAP if field_map is None else field_map
    consts = {"curso": "", "instituicao": "", "tipo_trabalho": "TCC"}
    consts.update(constants or {})
    base_col = urls.site_base(F.col("url")) if base is None else F.lit(base)
    parsed = pages.select(
        "page_id", "url", base_col.alias("_base"),
        page_parts(F.col("html"), lx.FIELD_ID_PREFIX, lx.FIELD_VALUE_CLASS,
                   lx.TITLE_FALLBACK_TAGS, attachment_token).alias("_p"))
    # per source element: the joined value ('' when absent)
    src_vals = {src: join_values(F.coalesce(F.col("_p.fields")[src], F.array().cast("array<string>")))
                for src, _ in fmap}
    parsed = parsed.select("page_id", "url", "_base", "_p",
                           *[v.alias(f"_src_{i}") for i, v in enumerate(src_vals.values())])
    srcs = list(src_vals)
    # Every target takes the last non-empty source in map order
    target = {}
    for i, (src, dst) in enumerate(fmap):
        col = F.col(f"_src_{srcs.index(src)}")
        target.setdefault(dst, []).append(col)
    val = {dst: F.coalesce(*[F.nullif(c, F.lit("")) for c in reversed(cols)], F.lit(""))
           for dst, cols in target.items()}
    # Title fallback in document order
    fallback = F.coalesce(tx.clean_whitespace(F.col("_p.fallback_title")), F.lit(""))
    titulo = val.get("titulo", F.lit(""))
    titulo = F.when(titulo != F.lit(""), titulo).otherwise(fallback)
    # year
    ano = val.get("ano", F.lit(""))
    ano = F.when(ano != F.lit(""), year_of(ano)).otherwise(ano)
    # First attachment link, resolved
    att = F.col("_p.attachment")
    pdf = F.when(att.isNotNull(), urls.resolve_url(att, F.col("_base"))).otherwise(F.lit(""))
    cols = {
        "titulo": titulo, "autor": val.get("autor", F.lit("")), "orientador": val.get("orientador", F.lit("")),
        "coorientador": val.get("coorientador", F.lit("")), "ano": ano,
        "curso": F.lit(consts["curso"]), "instituicao": F.lit(consts["instituicao"]),
        "palavras_chave": val.get("palavras_chave", F.lit("")), "resumo": val.get("resumo", F.lit("")),
        "abstract": val.get("abstract", F.lit("")), "link_acesso": F.col("url"),
        "arquivo_pdf": pdf, "tipo_trabalho": F.lit(consts["tipo_trabalho"]),
    }
    rec = parsed.select("page_id", *[cols[c].alias(c) for c in lx.RECORD_COLUMNS])
    if drop_untitled:
        rec = rec.filter(F.col("titulo") != F.lit(""))          # H15
    return rec


def extraction_stats(links: DataFrame, records: DataFrame, link_col: str = "link") -> DataFrame:
    """Successful extractions over unique links (records keyed by link_acesso)."""
    ok = records.select(F.col("link_acesso").alias(link_col)).distinct().withColumn("_ok", F.lit(True))
    j = links.select(link_col).distinct().join(ok, link_col, "left")
    return j.agg(F.count_if(F.col("_ok").isNotNull()).alias("n_ok"), F.count(F.lit(1)).alias("n_links"),
                 (F.count_if(F.col("_ok").isNotNull()) / F.count(F.lit(1))).alias("success_rate"))
