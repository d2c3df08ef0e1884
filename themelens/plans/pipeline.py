"""Q1: the whole theming pipeline as one composition of DataFrame operators.

records -> text preparation -> TF-IDF -> K-means -> keywords -> names ->
2-D projection -> result table and reports.  Everything is lazy except the points where
a bounded result is needed on the driver (the vocabulary, the K-means
centres, the PCA components).
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..operators import kmeans, projection, reports, textprep, tfidf, themes
from ..session import written
from ..sources import io
from ..sources.tables import document_records


def _without_accents(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


@dataclass
class PipelineResult:
    docs: DataFrame          # one row per document: record columns, cluster, cluster_name, dim_x, dim_y
    keywords: DataFrame      # (cluster, rank, term, score)
    names: DataFrame         # (cluster, cluster_name, theme, theme_score)
    model: tfidf.TfidfModel

    def result_table(self) -> DataFrame:
        """S8 projection: the present ones of the result columns, in fixed order."""
        return self.docs.select(*[c for c in lx.RESULT_COLUMNS if c in self.docs.columns])

    def save(self, path: str) -> DataFrame:
        """Write the result table by the extension of ``path`` (.csv or .json) and return it."""
        return io.save_results(self.docs, path)

    def reports(self, top_n: int = 15, max_clusters: int = 6) -> dict[str, DataFrame]:
        """C4, A1-A9 and P1-P4 on the clustered documents, by name.

        Advisor reports are there only if the documents have an advisor (A10), the scatter data only with a projection.
        """
        d = self.docs
        out = {"cluster_stats": themes.cluster_stats(d), "cluster_sizes": themes.cluster_sizes(d), "items": reports.item_table(d),
               "cloud_weights": reports.wordcloud_weights(self.keywords, max_clusters),
               "cloud_titles": reports.wordcloud_titles(d, self.keywords, self.names, max_clusters)}
        if "dim_x" in d.columns:
            out["scatter"] = reports.scatter_data(d)
        if "orientador" in d.columns:
            rows = reports.top_advisor_rows(reports.advisor_frame(d), top_n)
            by_theme = reports.themes_by_advisor(rows)
            out |= {"ranking": reports.advisor_ranking(rows), "themes_by_advisor": by_theme,
                    "advisor_order": reports.category_order(by_theme)}
            if "ano" in d.columns:
                out["advisor_by_year"] = reports.advisor_by_year(rows)
        return out


def theme_pipeline(records: DataFrame, k: int = 6, top_n: int = 15, method: str = "kmeans",
                   reduction: str = "pca", lexicon=None, lemmas: DataFrame | None = None,
                   tfidf_params: dict | None = None, seed: int = 42, min_cluster_size: int | None = None,
                   fold_lexicon: bool = False) -> PipelineResult:
    """``min_cluster_size`` is for density clustering; with ``fold_lexicon`` stop words and theme keywords lose their accents, as the text does."""
    carry = [c for c in lx.RESULT_COLUMNS + ["lang"] if c in records.columns and c != "doc_id"]
    prepared = textprep.prepare_text(records, lemmas=lemmas)
    params = dict(tfidf_params or {})
    if fold_lexicon:
        stop = params.get("stop_words", lx.STOP_WORDS)
        params["stop_words"] = sorted({*stop, *map(_without_accents, stop)})
    model = tfidf.fit_tfidf(prepared, keep_columns=carry, **params)
    vec = model.with_vectors("features").drop("tf_kept", "weights")
    if method == "kmeans":
        _, docs = kmeans.kmeans_fit(vec, "features", k=k, seed=seed, id_col="doc_id")
    else:
        # density clustering works on dense rows, as the reference densifies its matrix
        from pyspark.ml.functions import vector_to_array
        dense = written(vec).withColumn("_dense", vector_to_array("features"))
        _, docs = kmeans.cluster(dense, method, id_col="doc_id", vec_col="_dense", min_cluster_size=min_cluster_size)
        docs = docs.drop("_dense")
    docs = docs.drop("features")
    if method == "kmeans":  # several passes follow; they don't need the texts, which the model's table holds already
        weighted = written(docs.select("tfidf", "cluster"))
    else:
        weighted = docs = written(docs)
    keywords = themes.cluster_keywords(weighted, top_n=top_n)
    names = themes.name_clusters(keywords, themes.theme_table(records.sparkSession, lexicon, fold_lexicon))
    named = themes.attach_names(docs, names)
    if reduction == "pca":
        mean, comps, _ = projection.pca_sparse(weighted, model.vocab_terms, model.n_docs, k=2, seed=seed)
        named = projection.project_sparse(named, model.vocab_terms, mean, comps)
    elif reduction is not None:
        raise ValueError(f"unsupported reduction method: {reduction!r}")
    return PipelineResult(named, keywords, names, model)


def theme_pipeline_result(spark, sf_dir: str) -> DataFrame:
    """Flagship query: the documents table through the whole pipeline (main settings)."""
    res = theme_pipeline(document_records(spark, sf_dir), k=6, top_n=15)
    return res.result_table().withColumn("cluster", F.col("cluster").cast("int"))
