"""T2-T6, V1-V4 on hand-made cases (FIXTURES.md section 3)."""

from pyspark.sql import functions as F

from themelens.functions import text as tx
from themelens.functions.lexicon import STOP_WORDS
from themelens.operators import tfidf


def one(spark, expr, value, ddl="x string"):
    return spark.createDataFrame([(value,)], ddl).select(expr.alias("y")).first()["y"]


def test_combine_keeps_separators(spark):
    df = spark.createDataFrame([("A", None, "C")], "titulo string, resumo string, palavras_chave string")
    assert df.select(tx.combine_text(df.columns)).first()[0] == "A. . C"


def test_combine_only_present_columns(spark):
    df = spark.createDataFrame([("A", "B")], "resumo string, titulo string")
    assert df.select(tx.combine_text(df.columns)).first()[0] == "B. A"


def test_strip_punct_then_lower(spark):
    assert one(spark, tx.clean_text(F.col("x")), "Front-End,  (Não)  v2.0 a/b") == "frontend não v2.0 ab"


def test_unicode_whitespace_kept_as_blank(spark):
    assert one(spark, tx.clean_text(F.col("x")), "a b") == "a b"
    assert one(spark, tx.clean_text(F.col("x")), "x² 1ª") == "x² 1ª"


def test_length_filter_boundary(spark):
    df = spark.createDataFrame([("a" * 50,), (" " + "b" * 51 + " ",), (None,)], "x string")
    kept = [r.x for r in df.filter(tx.long_enough(F.col("x"), 50)).collect()]
    assert kept == [" " + "b" * 51 + " "]


def test_clean_whitespace(spark):
    assert one(spark, tx.clean_whitespace(F.col("x")), "\n a \t b ") == "a b"
    assert one(spark, tx.clean_whitespace(F.col("x")), None) == ""


def test_fold_compatibility_characters(spark):
    assert one(spark, tx.fold_accents(F.col("x")), "1ª 2º x² ação") == "1a 2o x2 acao"


def test_fold_rare_characters_exact(spark):
    # ligature and fraction unfold into several characters: Arrow path
    assert one(spark, tx.fold_accents(F.col("x")), "ﬁm ½") == "fim 1⁄2"


def test_stopwords_after_folding(spark):
    df = spark.createDataFrame([(1, "não análise sistema")], "doc_id long, texto_processado string")
    toks = tfidf.term_arrays(df, stop_words=STOP_WORDS, ngram_range=(1, 1)).first()["tokens"]
    assert toks == ["analise"]


def test_bigrams_bridge_removed_words(spark):
    df = spark.createDataFrame([(1, "a1 stop b1 c1")], "doc_id long, texto_processado string")
    terms = tfidf.term_arrays(df, stop_words=["stop"]).first()["terms"]
    assert terms == ["a1", "b1", "c1", "a1 b1", "b1 c1"]


def test_trigrams(spark):
    df = spark.createDataFrame([(1, "aa bb cc dd")], "doc_id long, texto_processado string")
    terms = tfidf.term_arrays(df, stop_words=[], ngram_range=(3, 3)).first()["terms"]
    assert terms == ["aa bb cc", "bb cc dd"]


def test_term_counts_in_row(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c", "b"],), ([],)], "terms array<string>")
    rows = tx.with_term_counts(df).select("tf").collect()
    assert [(x.term, x.tf) for x in rows[0].tf] == [("a", 1), ("b", 3), ("c", 1)]
    assert rows[1].tf == []
