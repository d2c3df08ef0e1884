"""Grouped reports over the clustered records.

All reports are plain aggregations.  Where a small set (the top-n advisors,
the plotted clusters) filters a large table, the small side has a proven
bound (n rows) and is broadcast; everything else is left to AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from .ranks import global_rank

#: A2 guard: what a numeric parse accepts (pandas-like), whitespace as Python's
NUMBER_PATTERN = (f"^[{tx.WS_CLASS}]*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?"
                  f"[{tx.WS_CLASS}]*$")


def principal_advisor(c):
    """A1: first ';'-separated part, stripped; null stays null, '' stays ''."""
    return tx.strip_ws(F.substring_index(c, ";", 1))


def coerce_number(c):
    """A2: text -> double, anything unparsable -> null (never raises under ANSI)."""
    return F.when(c.rlike(NUMBER_PATTERN), tx.strip_ws(c).try_cast("double"))


def advisor_frame(df: DataFrame, advisor_col: str = "orientador", year_col: str = "ano",
                  empty_as_null: bool = False) -> DataFrame:
    """A1-A3: adds ``orientador_principal`` (and numeric ``ano``), drops incomplete rows.

    ``empty_as_null`` reproduces the CSV load path, where an empty advisor is
    missing and therefore dropped; the default keeps '' as its own group.
    """
    if advisor_col not in df.columns:
        raise ValueError(f"column {advisor_col!r} not found: advisor reports need it")
    adv = F.col(advisor_col)
    if empty_as_null:
        adv = F.when(adv != F.lit(""), adv)
    out = df.withColumn("orientador_principal", principal_advisor(adv))
    subset = ["orientador_principal"]
    if year_col in df.columns:
        out = out.withColumn(year_col, coerce_number(F.col(year_col).cast("string")))
        subset.append(year_col)
    return out.dropna(subset=subset)


def top_advisors(adv: DataFrame, top_n: int = 15) -> DataFrame:
    """A4: the ``top_n`` advisors by row count (ties: name ascending)."""
    return (adv.groupBy("orientador_principal").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("orientador_principal")).limit(top_n))


def top_advisor_rows(adv: DataFrame, top_n: int = 15) -> DataFrame:
    """A5: rows whose advisor is in the top set; the set has at most ``top_n`` rows."""
    top = top_advisors(adv, top_n).select("orientador_principal")
    return adv.join(F.broadcast(top), "orientador_principal", "left_semi")


def advisor_ranking(top_rows: DataFrame) -> DataFrame:
    """(Orientador, Quantidade) ascending by count for display."""
    return (top_rows.groupBy(F.col("orientador_principal").alias("Orientador"))
            .agg(F.count(F.lit(1)).alias("Quantidade"))
            .orderBy(F.asc("Quantidade"), F.asc("Orientador")))


def themes_by_advisor(top_rows: DataFrame, theme_col: str = "cluster_name") -> DataFrame:
    """Count by (advisor, theme); rows with a null key are not grouped."""
    return (top_rows.filter(F.col("orientador_principal").isNotNull() & F.col(theme_col).isNotNull())
            .groupBy("orientador_principal", theme_col).agg(F.count(F.lit(1)).alias("count")))


def advisor_by_year(top_rows: DataFrame, year_col: str = "ano") -> DataFrame:
    """Count by (year, advisor)."""
    return (top_rows.filter(F.col(year_col).isNotNull())
            .groupBy(year_col, "orientador_principal").agg(F.count(F.lit(1)).alias("count")))


def category_order(counts: DataFrame, key: str = "orientador_principal", value: str = "count",
                   descending: bool = True) -> DataFrame:
    """Order categories by their total (ties by name).

    The places are running counts over ranges of the totals, so no task sees all categories.
    """
    totals = counts.groupBy(key).agg(F.sum(value).cast("long").alias("total"))
    order = F.desc("total") if descending else F.asc("total")
    return global_rank(totals, [order, F.asc(key)], "position")


def item_table(df: DataFrame) -> DataFrame:
    """Present columns renamed, sorted by theme, year, advisor with nulls last."""
    present = [(c, name) for c, name in lx.ITEM_TABLE_COLUMNS if c in df.columns]
    out = df.select(*[F.col(c).alias(name) for c, name in present])
    keys = [k for k in lx.ITEM_TABLE_ORDER if k in out.columns]
    return out.orderBy(*[F.col(k).asc_nulls_last() for k in keys])


def scatter_data(df: DataFrame) -> DataFrame:
    """X, y, theme and hover title ('' when there is no title column)."""
    hover = F.col("titulo") if "titulo" in df.columns else F.lit("")
    return df.select("dim_x", "dim_y", "cluster_name", hover.alias("hover"))


def wordcloud_weights(keywords: DataFrame, max_clusters: int = 6, cluster_col: str = "cluster") -> DataFrame:
    """Keyword weights ``max(0.01, score)`` for the first ``max_clusters`` cluster ids."""
    ids = (keywords.select(cluster_col).distinct()
           .orderBy(cluster_col).limit(max_clusters))          # at most max_clusters rows
    return (keywords.join(F.broadcast(ids), cluster_col, "left_semi")
            .select(cluster_col, "term", F.greatest(F.lit(lx.MIN_CLOUD_WEIGHT), F.col("score")).alias("weight")))


def wordcloud_titles(docs: DataFrame, keywords: DataFrame, names: DataFrame | None = None,
                     max_clusters: int = 6, cluster_col: str = "cluster") -> DataFrame:
    """Panel title per plotted cluster: name (or ``Cluster <id>``) and document count."""
    ids = (keywords.select(cluster_col).distinct().orderBy(cluster_col).limit(max_clusters))
    counts = docs.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("n_docs"))
    out = F.broadcast(ids).join(counts, cluster_col, "left")
    default = F.concat(F.lit("Cluster "), F.col(cluster_col).cast("string"))
    if names is not None:
        out = out.join(names.select(cluster_col, "cluster_name"), cluster_col, "left")
        title = F.coalesce(F.col("cluster_name"), default)
    else:
        title = default
    return out.select(cluster_col, title.alias("title"),
                      F.coalesce(F.col("n_docs"), F.lit(0)).cast("long").alias("n_docs"))
