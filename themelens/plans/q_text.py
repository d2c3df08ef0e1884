"""Registered queries: text preparation, TF-IDF, cluster keywords (T, V, C4-C6, C5-C11)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import textprep, tfidf, themes
from ..session import written
from ..sources.tables import document_records, read_table
from .registry import query, sql_list

# ------------------------------------------------------------------ shared SQL fragments
NON_TEXT = tx.NON_TEXT_PATTERN
WS_RUN = tx.WS_RUN_PATTERN
WS_EDGES = tx.WS_EDGES_PATTERN
TOKEN = tx.TOKEN_PATTERN
STOP = sql_list(lx.distinct_stop_words())

SQL_PREP = f"""
WITH recs AS (
  SELECT doc_id, lang, source AS orientador, split_part(text, chr(10), 1) AS titulo, text AS resumo
  FROM documents),
prep AS (
  SELECT doc_id, lang, orientador, titulo,
         coalesce(titulo, '') || '. ' || coalesce(resumo, '') AS combined,
         regexp_replace(lower(regexp_replace(coalesce(titulo, '') || '. ' || coalesce(resumo, ''),
                        '{NON_TEXT}', '', 'g')), '{WS_RUN}', ' ', 'g') AS txt
  FROM recs),
kept AS (
  SELECT * FROM prep WHERE length(regexp_replace(txt, '{WS_EDGES}', '', 'g')) > 50)"""

SQL_TOKENS = SQL_PREP + f""",
toks AS (
  SELECT doc_id, lang, regexp_extract_all(strip_accents(txt), '{TOKEN}') AS raw FROM kept),
toks_nostop AS (
  SELECT doc_id, lang, list_filter(raw, lambda t: NOT list_contains({STOP}, t)) AS w FROM toks),
pos AS (
  SELECT doc_id, lang, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM toks_nostop),
grams AS (
  SELECT doc_id, tok AS term FROM pos
  UNION ALL
  SELECT doc_id, tok || ' ' || nxt FROM (
    SELECT doc_id, tok, lead(tok) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM pos) b
  WHERE nxt IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY doc_id, term),
ndocs AS (SELECT count(*) AS n FROM kept),
stats AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
vocab AS (
  SELECT term, df, cf FROM stats, ndocs WHERE df >= 3 AND df <= 0.85 * ndocs.n
  ORDER BY cf DESC, term LIMIT 2000),
wts AS (
  SELECT tf.doc_id, tf.term, tf.tf * (ln((1.0 + ndocs.n) / (1.0 + vocab.df)) + 1.0) AS weight
  FROM tf JOIN vocab USING (term), ndocs),
l2 AS (
  SELECT doc_id, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS tfidf FROM wts)"""

# cluster = rank of the language (stand-in labels for the minimum slice)
SQL_LANG_CLUSTERS = SQL_TOKENS + """,
assign AS (SELECT doc_id, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS BIGINT) AS cluster FROM kept),
sizes AS (SELECT cluster, count(*) AS n_docs FROM assign GROUP BY cluster),
means AS (
  SELECT a.cluster, l.term, sum(l.tfidf) / any_value(s.n_docs) AS score
  FROM l2 l JOIN assign a USING (doc_id) JOIN sizes s ON s.cluster = a.cluster
  GROUP BY a.cluster, l.term),
ranked AS (
  SELECT cluster, term, score,
         row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, term) AS rank
  FROM means)"""


def _records(spark, sf_dir):
    return document_records(spark, sf_dir)


def _prepared(spark, sf_dir):
    return textprep.prepare_text(_records(spark, sf_dir))


def _model(spark, sf_dir, **kw):
    return tfidf.fit_tfidf(_prepared(spark, sf_dir), keep_columns=["lang"], **kw)


def lang_clusters(df):
    """Stand-in labels: cluster = rank of the language among distinct languages.

    The distinct-language table is tiny; ranking it needs no partitioning.  It is written, so that the join
    back is planned from its measured size before the documents are shuffled.
    """
    langs = df.select("lang").distinct()
    ranked = langs.withColumn("cluster", (F.dense_rank().over(Window.orderBy("lang")) - 1).cast("long"))
    return df.join(written(ranked), "lang")


# ------------------------------------------------------------------ T
@query("combine_text", oracle=SQL_PREP + """
SELECT doc_id, combined AS texto_combinado FROM prep""")
def q_combine_text(spark, sf_dir):
    r = _records(spark, sf_dir)
    return r.select("doc_id", tx.combine_text(r.columns).alias("texto_combinado"))


@query("strip_punct_lower", oracle=SQL_PREP + f"""
SELECT doc_id, lower(regexp_replace(combined, '{NON_TEXT}', '', 'g')) AS texto_limpo FROM prep""")
def q_strip_punct_lower(spark, sf_dir):
    r = _records(spark, sf_dir)
    return r.select("doc_id", tx.strip_punct_lower(tx.combine_text(r.columns)).alias("texto_limpo"))


@query("collapse_ws", oracle=SQL_PREP + """
SELECT doc_id, txt AS texto_limpo FROM prep""")
def q_collapse_ws(spark, sf_dir):
    r = _records(spark, sf_dir)
    return r.select("doc_id", tx.clean_text(tx.combine_text(r.columns)).alias("texto_limpo"))


@query("clean_whitespace", oracle=f"""
SELECT doc_id, coalesce(regexp_replace(regexp_replace(text, '{WS_EDGES}', '', 'g'), '{WS_RUN}', ' ', 'g'), '')
       AS cleaned
FROM documents""")
def q_clean_whitespace(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.clean_whitespace(F.col("text")).alias("cleaned"))


@query("min_length_filter", oracle=SQL_PREP + """
SELECT doc_id, length(txt) AS n_chars FROM kept""")
def q_min_length_filter(spark, sf_dir):
    return _prepared(spark, sf_dir).select(
        "doc_id", F.length("texto_processado").cast("long").alias("n_chars"))


@query("dropped_docs", oracle=SQL_PREP + f"""
SELECT count(*) AS n_before,
       count_if(length(regexp_replace(txt, '{WS_EDGES}', '', 'g')) > 50) AS n_after,
       count_if(NOT (length(regexp_replace(txt, '{WS_EDGES}', '', 'g')) > 50)) AS n_dropped
FROM prep""")
def q_dropped_docs(spark, sf_dir):
    return textprep.dropped_counts(_records(spark, sf_dir))


# ------------------------------------------------------------------ V
@query("fold_accents", oracle=SQL_PREP + """
SELECT doc_id, strip_accents(txt) AS folded FROM kept""")
def q_fold_accents(spark, sf_dir):
    return _prepared(spark, sf_dir).select("doc_id", tx.fold_accents(F.col("texto_processado")).alias("folded"))


@query("tokenize", oracle=SQL_TOKENS + """
SELECT doc_id, CAST(generate_subscripts(raw, 1) AS BIGINT) AS pos, unnest(raw) AS token FROM toks""")
def q_tokenize(spark, sf_dir):
    p = _prepared(spark, sf_dir)
    t = p.select("doc_id", tx.tokenize(tx.fold_accents(F.col("texto_processado"))).alias("raw"))
    return tx.explode_rows(t, ["doc_id"], "raw", "token", with_pos=True) \
        .select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "token")


@query("remove_stopwords", oracle=SQL_TOKENS + """
SELECT doc_id, CAST(i AS BIGINT) AS pos, tok AS token FROM pos""")
def q_remove_stopwords(spark, sf_dir):
    t = tfidf.term_arrays(_prepared(spark, sf_dir))
    return tx.explode_rows(t, ["doc_id"], "tokens", "token", with_pos=True) \
        .select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "token")


@query("ngrams", oracle=SQL_TOKENS + """
SELECT doc_id, term, tf FROM tf""")
def q_ngrams(spark, sf_dir):
    return tfidf.term_rows(_prepared(spark, sf_dir))


@query("doc_frequency", oracle=SQL_TOKENS + """
SELECT term, df, cf FROM stats, ndocs WHERE df >= 3 AND df <= 0.85 * ndocs.n""")
def q_doc_frequency(spark, sf_dir):
    stats, n = tfidf.counted_terms(_prepared(spark, sf_dir), 3)
    return tfidf.prune_vocabulary(stats, n, 3, 0.85, None) \
        .select("term", "df", F.col("cf").cast("long").alias("cf"))


@query("vocab_top", oracle=SQL_TOKENS + """
SELECT term, df, cf, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS term_id FROM vocab""")
def q_vocab_top(spark, sf_dir):
    m = _model(spark, sf_dir)
    return m.vocab.select("term", "df", "cf", F.col("term_id").cast("long").alias("term_id"))


@query("tfidf_weights", oracle=SQL_TOKENS + """
SELECT doc_id, term, round(weight, 6) AS weight FROM wts""")
def q_tfidf_weights(spark, sf_dir):
    return _model(spark, sf_dir).raw_weights().select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query("tfidf_l2", oracle=SQL_TOKENS + """
SELECT doc_id, term, round(tfidf, 6) AS tfidf FROM l2""")
def q_tfidf_l2(spark, sf_dir):
    return _model(spark, sf_dir).long().select("doc_id", "term", F.round("tfidf", 6).alias("tfidf"))


@query("tfidf_shape", oracle=SQL_TOKENS + """
SELECT (SELECT n FROM ndocs) AS n_docs, (SELECT count(*) FROM vocab) AS n_terms,
       (SELECT count(*) FROM l2) AS nnz""")
def q_tfidf_shape(spark, sf_dir):
    m = _model(spark, sf_dir)
    nnz = m.docs.agg(F.sum(F.size("tfidf")).cast("long").alias("nnz"))
    return nnz.select(F.lit(m.n_docs).cast("long").alias("n_docs"),
                      F.lit(m.n_terms).cast("long").alias("n_terms"), "nnz")


# ------------------------------------------------------------------ C4-C6 with stand-in labels
def _lang_docs(spark, sf_dir):
    m = _model(spark, sf_dir)
    return lang_clusters(m.docs)


@query("cluster_term_mean", oracle=SQL_LANG_CLUSTERS + """
SELECT cluster, term, round(score, 6) AS score FROM means""")
def q_cluster_term_mean(spark, sf_dir):
    return themes.cluster_term_means(_lang_docs(spark, sf_dir)).select(
        "cluster", "term", F.round("score", 6).alias("score"))


@query("cluster_keywords", oracle=SQL_LANG_CLUSTERS + """
SELECT cluster, CAST(rank AS BIGINT) AS rank, term, round(score, 6) AS score FROM ranked WHERE rank <= 15""")
def q_cluster_keywords(spark, sf_dir):
    k = themes.cluster_keywords(_lang_docs(spark, sf_dir), top_n=15)
    return k.select("cluster", F.col("rank").cast("long").alias("rank"), "term", F.round("score", 6).alias("score"))


# ------------------------------------------------------------------ T5 lemma lookup
#: fixed test parameter: a small lemma table over frequent words of the test corpus
TEST_LEMMAS = [("the", "the", "DET"), ("and", "and", "CCONJ"), ("of", "of", "ADP"), ("la", "el", "DET"),
               ("le", "le", "DET"), ("des", "de", "ADP"), ("die", "der", "DET"), ("is", "be", "AUX"),
               ("es", "ser", "AUX"), ("et", "et", "PUNCT"), ("a", "a", "SYM"), ("to", "to", "PART")]


def _lemma_sql():
    from ..operators.lemmas import DROP_POS, LEMMA_TOKEN_PATTERN
    vals = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in TEST_LEMMAS)
    drop = ", ".join(f"'{x}'" for x in DROP_POS)
    return SQL_PREP + f""",
lem(surface, lemma, pos) AS (VALUES {vals}),
tk AS (
  SELECT doc_id, unnest(regexp_extract_all(txt, '{LEMMA_TOKEN_PATTERN}')) AS t,
         generate_subscripts(regexp_extract_all(txt, '{LEMMA_TOKEN_PATTERN}'), 1) AS i FROM prep),
j AS (
  SELECT tk.doc_id, tk.i, coalesce(l.lemma, tk.t) AS lemma,
         coalesce(l.pos, CASE WHEN regexp_matches(tk.t, '^[.]+$') THEN 'PUNCT'
                              WHEN regexp_matches(tk.t, '^\\p{{N}}+$') THEN 'NUM' ELSE 'X' END) AS tag
  FROM tk LEFT JOIN lem l ON l.surface = tk.t),
agg AS (SELECT doc_id, string_agg(lemma, ' ' ORDER BY i) AS lem FROM j WHERE tag NOT IN ({drop}) GROUP BY doc_id)
SELECT p.doc_id, coalesce(agg.lem, '') AS texto_processado FROM prep p LEFT JOIN agg USING (doc_id)"""


@query("lemmatize", oracle=_lemma_sql())
def q_lemmatize(spark, sf_dir):
    lemmas = spark.createDataFrame(TEST_LEMMAS, "surface string, lemma string, pos string")
    p = textprep.prepare_text(_records(spark, sf_dir), lemmas=lemmas, keep_short=True)
    return p.select("doc_id", "texto_processado")
