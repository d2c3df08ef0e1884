"""C4-C11: cluster statistics, keywords and names.

Inputs are a per-document table carrying ``cluster`` and the ``tfidf`` array
(one row per document, as produced by :func:`fit_tfidf`).  Cluster keywords
explode each document's sparse row and aggregate by (cluster, term) with a
map-side partial aggregate, so only one row per (cluster, term) per task
shuffles.  Everything after that is bounded by clusters x vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import explode_rows
from .sums import stable_sum

SCORE_ORDER_DIGITS = 9


def cluster_sizes(assign: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """C4: (cluster, n_docs) for every label, noise included."""
    return assign.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("n_docs"))


def cluster_stats(assign: DataFrame, cluster_col: str = "cluster", noise: int = lx.NOISE_LABEL) -> DataFrame:
    """C4: one row: clusters without noise, noise count and share, documents."""
    c = F.col(cluster_col)
    return assign.agg(
        F.count_distinct(F.when(c != F.lit(noise), c)).alias("n_clusters"),
        F.count_if(c == F.lit(noise)).alias("n_noise"),
        (F.count_if(c == F.lit(noise)) / F.count(F.lit(1))).alias("noise_share"),
        F.count(F.lit(1)).alias("n_docs"),
    )


def cluster_term_means(docs: DataFrame, cluster_col: str = "cluster", weights_col: str = "tfidf",
                       noise: int = lx.NOISE_LABEL) -> DataFrame:
    """Mean weight per (cluster, term); absent = 0, divisor = cluster size.

    The sums are the same for any partitioning of the documents.
    """
    d = docs.filter(F.col(cluster_col) != F.lit(noise))
    sums = (explode_rows(d, [cluster_col], weights_col)
            .groupBy(cluster_col, F.col("x.term").alias("term"))
            .agg(stable_sum(F.col("x.w")).alias("w_sum")))
    sizes = cluster_sizes(d, cluster_col)           # broadcast if its measured size allows
    return (sums.join(sizes, cluster_col)
            .select(cluster_col, "term", (F.col("w_sum") / F.col("n_docs")).alias("score")))


def top_terms(means: DataFrame, top_n: int = 10, cluster_col: str = "cluster") -> DataFrame:
    """Top ``top_n`` terms per cluster by score (ties: term ascending).

    Scores are compared at 9 decimals, so that terms of equal weight are ties although
    their weights were rounded differently.  Spark plans the ``rank <= n`` filter as a WindowGroupLimit, so each
    task keeps only n rows per cluster before the exchange.
    """
    w = Window.partitionBy(cluster_col).orderBy(
        F.desc(F.round("score", SCORE_ORDER_DIGITS)), F.asc("term"))
    return (means.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= top_n))


def cluster_keywords(docs: DataFrame, top_n: int = 10, cluster_col: str = "cluster",
                     weights_col: str = "tfidf") -> DataFrame:
    """C5 + C6: (cluster, rank, term, score)."""
    return top_terms(cluster_term_means(docs, cluster_col, weights_col), top_n, cluster_col) \
        .select(cluster_col, "rank", "term", "score")


def theme_table(spark, lexicon=None, fold: bool = False) -> DataFrame:
    """Theme lexicon as (theme, theme_order, keyword); optional accent folding."""
    rows = lx.theme_rows(lexicon)
    df = spark.createDataFrame(rows, "theme string, theme_order int, keyword string")
    if fold:
        from ..functions.text import fold_accents
        df = df.withColumn("keyword", fold_accents(F.col("keyword"), exact=False))
    return df


def theme_scores(keywords: DataFrame, themes: DataFrame, naming_terms: int = lx.NAMING_TOP_TERMS,
                 cluster_col: str = "cluster") -> DataFrame:
    """|top-10 terms & theme keywords| per (cluster, theme) with overlap > 0."""
    top = keywords.filter(F.col("rank") <= naming_terms).select(cluster_col, "term")
    # the lexicon is a fixed parameter of a few dozen rows: a proven broadcast bound
    return (top.join(F.broadcast(themes), top.term == themes.keyword)
            .groupBy(cluster_col, "theme", "theme_order")
            .agg(F.count_distinct("term").alias("score")))


def name_clusters(keywords: DataFrame, themes: DataFrame, cluster_col: str = "cluster",
                  naming_terms: int = lx.NAMING_TOP_TERMS, min_score: int = lx.MIN_THEME_SCORE) -> DataFrame:
    """C8 + C9: (cluster, cluster_name, theme, theme_score) for every cluster with keywords."""
    scores = theme_scores(keywords, themes, naming_terms, cluster_col)
    best = scores.groupBy(cluster_col).agg(
        F.min_by(F.struct("theme", "score"), F.struct(-F.col("score"), F.col("theme_order"))).alias("b"))
    best = best.select(cluster_col, F.col("b.theme").alias("theme"), F.col("b.score").alias("theme_score"))
    fb = (keywords.filter(F.col("rank") <= lx.FALLBACK_TERMS)
          .groupBy(cluster_col)
          .agg(F.array_join(F.transform(
              F.array_sort(F.collect_list(F.struct("rank", "term"))),
              lambda x: capitalize(x["term"])), lx.FALLBACK_SEPARATOR).alias("fallback")))
    cid = F.col(cluster_col).cast("string")
    return (fb.join(best, cluster_col, "left")
            .select(cluster_col,
                    F.when(F.col("theme_score") >= F.lit(min_score),
                           F.concat(F.col("theme"), F.lit(" (C"), cid, F.lit(")")))
                     .otherwise(F.concat(F.lit(lx.FALLBACK_PREFIX), F.col("fallback"),
                                         F.lit(" (C"), cid, F.lit(")"))).alias("cluster_name"),
                    F.when(F.col("theme_score") >= F.lit(min_score), F.col("theme")).alias("theme"),
                    F.coalesce(F.col("theme_score"), F.lit(0)).cast("long").alias("theme_score")))


def capitalize(c):
    """Python ``str.capitalize``: first character upper, the rest lower (whole term)."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def attach_names(docs: DataFrame, names: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """Map names onto rows; noise rows get the noise name.

    ``names`` has one row per cluster; it is broadcast if its measured size allows,
    and otherwise the join's skew handling splits the large clusters.
    """
    out = docs.join(names.select(cluster_col, "cluster_name"), cluster_col, "left")
    return out.withColumn("cluster_name", F.when(F.col(cluster_col) == F.lit(lx.NOISE_LABEL),
                                                 F.lit(lx.NOISE_NAME)).otherwise(F.col("cluster_name")))


def name_clusters_from_docs(docs: DataFrame, themes: DataFrame, keywords: DataFrame | None = None,
                            cluster_col: str = "cluster") -> DataFrame:
    """C11: naming needs keywords; when none are given they are computed (top 10)."""
    if keywords is None:
        keywords = cluster_keywords(docs, top_n=lx.NAMING_TOP_TERMS, cluster_col=cluster_col)
    return name_clusters(keywords, themes, cluster_col)
