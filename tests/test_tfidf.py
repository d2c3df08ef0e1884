"""V5-V10 rules and TF-IDF values against a direct computation."""

import math

import pytest

from themelens.operators import tfidf


def test_df_window_int_and_float():
    assert tfidf._doc_threshold(3, 20, "min_df") == 3.0
    assert tfidf._doc_threshold(0.85, 20, "max_df") == pytest.approx(17.0)
    with pytest.raises(ValueError):
        tfidf._doc_threshold(1.5, 20, "max_df")


def test_prune_vocabulary(spark):
    stats = spark.createDataFrame([("a", 2, 9), ("b", 3, 5), ("c", 17, 7), ("d", 18, 8)],
                                  "term string, df long, cf long")
    kept = {r.term for r in tfidf.prune_vocabulary(stats, 20, 3, 0.85, None).collect()}
    assert kept == {"b", "c"}
    top = [r.term for r in tfidf.prune_vocabulary(stats, 20, 1, 1.0, 2).collect()]
    assert sorted(top) == ["a", "d"]


def test_single_term_weight_is_one(spark):
    df = spark.createDataFrame([(i, "palavra") for i in range(3)], "doc_id long, texto_processado string")
    m = tfidf.fit_tfidf(df, min_df=1, max_df=1.0, stop_words=[])
    vals = [r.tfidf for r in m.long().collect()]
    assert vals == [pytest.approx(1.0)] * 3
    raw = [r.weight for r in m.raw_weights().collect()]
    assert raw == [pytest.approx(1.0)] * 3


def test_document_without_vocabulary_stays(spark):
    df = spark.createDataFrame([(1, "xx yy"), (2, "xx yy"), (3, "zz")], "doc_id long, texto_processado string")
    m = tfidf.fit_tfidf(df, min_df=2, max_df=1.0, stop_words=[], ngram_range=(1, 1))
    rows = {r.doc_id: r.tfidf for r in m.docs.collect()}
    assert rows[3] == [] and len(rows[1]) == 2


def test_values_match_formula(spark):
    texts = ["aa bb aa", "bb cc", "aa cc cc dd"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, texto_processado string")
    m = tfidf.fit_tfidf(df, min_df=1, max_df=1.0, stop_words=[], ngram_range=(1, 1))
    got = {(r.doc_id, r.term): r.tfidf for r in m.long().collect()}
    n = 3
    docs = [t.split() for t in texts]
    dfreq = {t: sum(t in d for d in docs) for d in docs for t in d}
    for i, d in enumerate(docs):
        w = {t: d.count(t) * (math.log((1 + n) / (1 + dfreq[t])) + 1) for t in set(d)}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for t, v in w.items():
            assert got[(i, t)] == pytest.approx(v / norm)


def test_empty_vocabulary_raises(spark):
    df = spark.createDataFrame([(1, "a e o")], "doc_id long, texto_processado string")
    with pytest.raises(ValueError):
        tfidf.fit_tfidf(df, min_df=1, max_df=1.0)


def test_pruned_to_nothing_raises(spark):
    df = spark.createDataFrame([(1, "xx"), (2, "yy")], "doc_id long, texto_processado string")
    with pytest.raises(ValueError):
        tfidf.fit_tfidf(df, min_df=2, max_df=1.0, stop_words=[])


def test_vectors_equal_long_table(spark):
    texts = ["aa bb aa", "bb cc", "aa cc cc dd"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, texto_processado string")
    m = tfidf.fit_tfidf(df, min_df=1, max_df=1.0, stop_words=[], ngram_range=(1, 1))
    long = {(r.doc_id, r.term): r.tfidf for r in m.long().collect()}
    for r in m.with_vectors().select("doc_id", "features").collect():
        for idx, v in zip(r.features.indices, r.features.values):
            assert long[(r.doc_id, m.vocab_terms[idx])] == pytest.approx(v)


def test_counts_equal_term_arrays_and_nothing_is_cached(spark):
    """Terms of one to three words, nulls, stop words, accents; chunks of a few tokens; the fit keeps nothing in memory."""
    from themelens.functions import text as tx
    texts = ["", None, "não pára não pára ⅱ ½ x", "de um dia de sol e um dia", "dia sol dia", "sol_a b2 b2 b2 ﬁm", "º"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, texto_processado string").repartition(2)
    held, tfidf.BATCH_TOKENS = tfidf.BATCH_TOKENS, 3
    try:
        for span, fold in (((1, 2), True), ((1, 3), False), ((2, 3), True), ((3, 3), True)):
            arrays = tfidf.term_arrays(df, stop_words=["de", "um"], ngram_range=span, fold=fold).select("doc_id", "terms")
            want = sorted((r.doc_id, x.term, x.tf) for r in tx.with_term_counts(arrays).collect() for x in r.tf)
            assert sorted(map(tuple, tfidf.term_rows(df, stop_words=["de", "um"], ngram_range=span, fold=fold).collect())) == want
            stats, n = tfidf.counted_terms(df, 1, stop_words=["de", "um"], ngram_range=span, fold=fold)
            assert n == len(texts)
            assert {r.term: (r.df, r.cf) for r in stats.collect()} == {
                t: (sum(x[1] == t for x in want), sum(x[2] for x in want if x[1] == t)) for t in {x[1] for x in want}}
        cached = spark.sparkContext._jsc.getPersistentRDDs().size()
        m = tfidf.fit_tfidf(df, min_df=2, max_df=1.0, stop_words=["de", "um"])
        assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached
        kept = [r.tf_kept for r in m.docs.orderBy("doc_id").collect()]
        arrays = tfidf.term_arrays(df, stop_words=["de", "um"]).select("doc_id", "terms")
        assert [[(x.term, x.tf) for x in row] for row in kept] == [
            [(x.term, x.tf) for x in r.tf if x.term in m.vocab_terms] for r in tx.with_term_counts(arrays).orderBy("doc_id").collect()]
    finally:
        tfidf.BATCH_TOKENS = held


def test_counting_holds_few_tokens():
    """What a task holds while it counts doesn't grow with its texts; the counts are those of all texts."""
    import tracemalloc

    import numpy as np
    texts = (f"aa bb w{i % 5000} " * 100 for i in range(4000))
    found, pieces = {}, 0
    tracemalloc.start()
    for terms, group, _, tf in tfidf._counted(texts, tfidf.HELD_TOKENS, [], (1, 1)):
        pieces += 1
        for term, df, cf in zip(terms.to_pylist(), np.bincount(group), np.bincount(group, tf)):
            found[term] = found.get(term, np.zeros(2)) + (df, cf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(found["aa"]) == [4000, 400_000] and list(found["w7"]) == [1, 100] and pieces > 1
    assert peak < 100 << 20


def test_cleaning_is_computed_once(spark):
    """The length filter takes the cleaned text; it doesn't clean the text again."""
    from themelens.operators import textprep
    df = spark.createDataFrame([(1, "Um título", "Resumo  com espaços. " * 5), (2, "", None)], "doc_id long, titulo string, resumo string")
    out = textprep.prepare_text(df).select("doc_id", "texto_processado")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
    assert [r.texto_processado[:24] for r in out.collect()] == ["um título. resumo com es"]


def test_naming_reads_keywords_as_a_table(spark, small_dir):
    """The clusters' keywords are computed once, not once for every use in naming."""
    import __spark_entry__ as E
    for name in ("theme_pick_in_corpus", "theme_scores_in_corpus", "fallback_name"):
        plan = E.queries()[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan, name


def test_language_labels_do_not_shuffle_documents(spark, small_dir):
    """The few labels go to the documents by their measured size."""
    from themelens.plans.q_text import lang_clusters
    from themelens.session import written
    docs = written(spark.range(3000).selectExpr("id AS doc_id", "CAST(id % 3 AS STRING) AS lang", "sha2(CAST(id AS STRING), 256) AS rest"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4096")
    try:
        out = lang_clusters(docs)
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [tuple(r) for r in out.groupBy("lang", "cluster").count().orderBy("lang").collect()] == [("0", 0, 1000), ("1", 1, 1000), ("2", 2, 1000)]


def test_terms_are_not_held_before_the_shuffle(spark):
    """A task hands its counted terms straight to the shuffle: no hash table of them in the map task."""
    df = spark.createDataFrame([(1, "um dois tres dois"), (2, "dois quatro"), (3, None)], "doc_id long, texto_processado string")
    stats = tfidf.term_stats(df, stop_words=[], ngram_range=(1, 1))
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan[plan.rindex("Exchange"):]
    assert {r.term: (r.df, r.cf) for r in stats.collect()} == {"um": (1, 1), "dois": (2, 3), "tres": (1, 1), "quatro": (1, 1), None: (3, 0)}


def test_spread_rows_are_kept_on_disk(spark):
    """Few splits may be large: what is spread takes no executor memory."""
    from pyspark.sql import functions as F

    from themelens.sources.tables import spread_rows
    out = spread_rows(spark.range(0, 40, 1, 1).withColumn("x", F.lit("spread")))
    try:
        assert out.storageLevel.useDisk and not out.storageLevel.useMemory
        assert out.rdd.getNumPartitions() > 1 and out.count() == 40
    finally:
        out.unpersist()
