"""The whole harvest as one resumable job: listing pages -> item links -> records, with a state for every URL.

:func:`harvest_all` composes H6, H2-H5, H7, H1, H8-H16 and H17 over stored pages.  Every step is a table in the
crawl's folder, with a marker beside it that is written after it; a crawl that starts again in the same folder reads
the marked steps and goes on with the first that is missing.

The listing pages are found in rounds.  A round joins the URLs that the round before it found with the pagination
links, takes off those that an earlier round has, and is appended as a table of its own: nothing that was found is
written again.  All links come from one parse of every page, before the first round.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import urls
from ..sources.io import scratch_path
from . import harvest

#: States of a URL.
READ, FAILED, UNTITLED = "read", "failed", "untitled"


@dataclass
class Harvest:
    """``records`` (13 columns and page_id), ``states`` (url, kind, state, depth) and ``rate`` (n_ok, n_links, success_rate)."""

    records: DataFrame
    states: DataFrame
    rate: DataFrame


def _step(folder: str, name: str, build, spark) -> DataFrame:
    """The table ``name`` of the crawl; built unless its marker is there."""
    path, marker = os.path.join(folder, name), os.path.join(folder, f"{name}.done")
    try:
        spark.read.parquet(marker)
    except AnalysisException:
        build().write.mode("overwrite").parquet(path)
        spark.range(1).write.mode("overwrite").parquet(marker)
    return spark.read.parquet(path)


def listing_rounds(links: DataFrame, start_url: str, folder: str) -> DataFrame:
    """(url, depth) of all URLs reached from ``start_url`` over ``links`` (url, link), a table a round."""
    spark = links.sparkSession
    rounds = [_step(folder, "listing-0", lambda: spark.createDataFrame([(start_url, 0)], "url string, depth int"), spark)]
    while True:
        depth = len(rounds)

        def build():
            seen = reduce(DataFrame.union, rounds).select("url")
            found = rounds[-1].join(links, "url").select(F.col("link").alias("url")).distinct()
            return found.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth))

        new = _step(folder, f"listing-{depth}", build, spark)
        if new.isEmpty():
            return reduce(DataFrame.union, rounds)
        rounds.append(new)


def harvest_all(pages: DataFrame, start_url: str, base: str, folder: str | None = None, token: str = "page=", patterns=None,
                host_token: str = lx.ITEM_HOST_TOKEN, path_token: str = lx.ITEM_PATH_TOKEN,
                min_bytes: int = lx.MIN_BODY_BYTES, **record_options) -> Harvest:
    """Records of all items that the listing pages reached from ``start_url`` link to.

    ``pages``: (page_id, url, html) of stored pages.  A body under ``min_bytes`` counts as not read: a listing page then
    gives no links, an item no record.  Of the pages stored under one URL the one with the smallest page_id counts; null
    URLs and bodies take no part.  Items are links of a listing page that match ``patterns``, ``host_token`` and
    ``path_token``.  The rate counts items with a record over all items (null if there are none).
    ``record_options`` go to :func:`harvest.extract_records`.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "crawl")
    usable = pages.select("page_id", "url", "html").where(F.col("url").isNotNull() & F.col("html").isNotNull())
    stored = _step(folder, "pages", lambda: harvest.dedupe_urls(harvest.size_guard(usable, min_bytes)), spark)

    def all_links():
        found = harvest.page_links(stored, base, patterns)
        item = F.col("is_item") & urls.is_item_url(F.col("link"), host_token, path_token)
        listing = F.col("href").contains(token)
        return found.select("url", "link", item.alias("item"), listing.alias("listing")).where("item or listing").distinct()

    links = _step(folder, "links", all_links, spark)
    listing = listing_rounds(links.where("listing").select("url", "link"), start_url, folder)
    items = _step(folder, "items", lambda: listing.join(links.where("item"), "url").groupBy(F.col("link").alias("url")).agg(
        (F.min("depth") + 1).alias("depth")), spark)
    read = stored.join(items.select("url"), "url", "left_semi")
    records = _step(folder, "records", lambda: harvest.extract_records(read, base=base, drop_untitled=False, **record_options), spark)
    titles = records.select(F.col("link_acesso").alias("url"), (F.col("titulo") != "").alias("titled"))
    here = stored.select("url", F.lit(True).alias("here"))
    states = listing.join(here, "url", "left").select(
        "url", F.lit("listing").alias("kind"), F.when(F.col("here"), READ).otherwise(FAILED).alias("state"), "depth").union(
        items.join(titles, "url", "left").select(
            "url", F.lit("item").alias("kind"),
            F.when(F.col("titled"), READ).when(~F.col("titled"), UNTITLED).otherwise(FAILED).alias("state"), "depth"))
    kept = records.where(F.col("titulo") != "")
    rate = harvest.extraction_stats(items.select(F.col("url").alias("link")), kept) if not items.isEmpty() else spark.createDataFrame(
        [(0, 0, None)], "n_ok long, n_links long, success_rate double")
    return Harvest(kept, states, rate)
