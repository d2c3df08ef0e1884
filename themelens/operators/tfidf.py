"""TF-IDF as a sparse long table, built Spark-first.

Plan shape (two passes over the texts, one shuffle of small, pre-aggregated data, nothing cached in memory):

* every document is folded, tokenised, stop-word filtered and turned into n-grams
  inside the task (:func:`_counted`), and counted there by row -- the (document, term) count
  table is neither kept nor shuffled;
* document frequency / corpus frequency per term: a task adds up its documents' terms,
  about ``HELD_TOKENS`` tokens at a time, and ``groupBy(term)`` adds up the rest after
  the only shuffle, so that a task holds no more than that before it.  The number of documents comes from the same pass; terms below an
  absolute ``min_df`` are not written;
* the vocabulary is capped at ``max_features`` rows (TakeOrdered), so it has a
  proven size bound and goes to every task, which counts only its terms in the second
  pass; what is kept of a document is (term_id, tf), in the shared folder; weighting and
  the L2 norm then stay inside each row;
* without a cap (``max_features=None``) the vocabulary is joined instead and the
  norm is a window on ``doc_id`` (AQE decides broadcast from the measured size).
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.lexicon import STOP_WORDS
from ..session import written
from .ranks import global_rank

#: largest vocabulary that is sent to every task
INLINE_VOCAB_LIMIT = 100_000
#: Tokens whose terms a task adds up before it hands their counts on, and tokens of a batch of single rows, about.
HELD_TOKENS, BATCH_TOKENS = 1 << 19, 1 << 17
#: Documents of an Arrow batch: texts may be long, and a task holds a batch in the JVM and in Python.
ARROW_ROWS = 1000


def term_arrays(df: DataFrame, text_col: str = "texto_processado", stop_words=STOP_WORDS,
                ngram_range=(1, 2), fold: bool = True, token_pattern: str = tx.TOKEN_PATTERN) -> DataFrame:
    """Adds ``tokens`` (after stop words) and ``terms`` (n-grams) array columns.

    Each step is its own projection over a plain column, so no expensive
    expression is inlined twice (array functions fall back from codegen and
    would not share a common subexpression).
    """
    cols = [c for c in df.columns if c not in ("tokens", "terms", "_folded", "_raw")]
    text = F.col(text_col)
    out = df.select(*cols, (tx.fold_accents(text) if fold else text).alias("_folded"))
    out = out.select(*cols, tx.tokenize(F.col("_folded"), token_pattern).alias("_raw"))
    toks = tx.remove_stopwords(F.col("_raw"), stop_words) if stop_words else F.col("_raw")
    out = out.select(*cols, toks.alias("tokens"))
    return out.select(*cols, "tokens", tx.ngram_terms(F.col("tokens"), ngram_range).alias("terms"))


def _counted(texts, size: int, stop_words=STOP_WORDS, ngram_range=(1, 2), fold: bool = True):
    """The n-grams of :func:`term_arrays` of the texts that an iterable gives, counted by row: for about ``size``
    tokens at a time and every n, (distinct terms; place of the term, row and count of every term of a row)."""
    stop, pattern = frozenset(stop_words or ()), re.compile(tx.PYTHON_TOKEN_PATTERN)
    place, ids, rows, sizes = defaultdict(), [], [], []
    place.default_factory = place.__len__
    for row, text in enumerate(texts):
        if text is not None:
            tokens = pattern.findall(tx.fold_text(text) if fold else text)
            ids.extend(map(place.__getitem__, tokens))
            rows.append(row)
            sizes.append(len(tokens))
        if len(ids) >= size:
            yield from _grams(place, ids, rows, sizes, stop, ngram_range)
            place.clear()
            ids, rows, sizes = [], [], []
    yield from _grams(place, ids, rows, sizes, stop, ngram_range)


def _grams(place, ids, rows, sizes, stop, ngram_range):
    """:func:`_counted` of the rows at hand: ``place`` numbers their distinct tokens, ``ids`` are all tokens."""
    lo, hi = ngram_range
    held = np.array([w not in stop for w in place], dtype=bool)
    token, doc = np.array(ids, dtype=np.int64), np.repeat(np.array(rows, dtype=np.int64), sizes)
    keep = held[token]
    token, doc, words = token[keep], doc[keep], pa.array(place, pa.string())
    at, gram = np.arange(len(token)), np.zeros(len(token), dtype=np.int64)
    for n in range(1, hi + 1):
        inside = at + n <= len(token)
        inside[inside] = doc[at[inside] + n - 1] == doc[at[inside]]
        at, key = at[inside], gram[inside] * len(words)
        if not len(at):
            break
        key += token[at + n - 1]
        order = np.argsort(key, kind="stable")  # a term's places by row
        key, own = key[order], doc[at[order]]
        first = np.append(True, key[1:] != key[:-1])
        fresh = first.copy()
        fresh[1:] |= own[1:] != own[:-1]
        group = np.cumsum(first) - 1
        if n >= lo:
            start = at[order[first]]
            terms = words.take(pa.array(token[start]))
            for k in range(1, n):
                terms = pc.binary_join_element_wise(terms, words.take(pa.array(token[start + k])), " ")
            yield terms, group[fresh], own[fresh], np.diff(np.append(np.flatnonzero(fresh), len(key)))
        gram = np.empty(len(at), dtype=np.int64)
        gram[order] = group


def _read(texts):
    """The texts of an Arrow array, one at a time."""
    return (text.as_py() for text in texts)


def term_rows(df: DataFrame, text_col: str = "texto_processado", doc_col: str = "doc_id", stop_words=STOP_WORDS,
              ngram_range=(1, 2), fold: bool = True) -> DataFrame:
    """(doc_id, term, tf): the n-grams of every text, counted inside the row."""
    _check_range(ngram_range)
    _small_batches(df.sparkSession)
    rows = df.select(doc_col, text_col)

    def count(batches):
        for batch in batches:
            for terms, group, row, tf in _counted(_read(batch.column(1)), BATCH_TOKENS, stop_words, ngram_range, fold):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), terms.take(pa.array(group)), pa.array(tf, pa.int64())],
                                                 names=[doc_col, "term", "tf"])

    kind = rows.schema[doc_col].dataType.simpleString()
    return rows.mapInArrow(count, f"`{doc_col}` {kind}, term string, tf long")


def _small_batches(spark):
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(conf))
    if held <= 0 or held > ARROW_ROWS:
        spark.conf.set(conf, str(ARROW_ROWS))


def _check_range(ngram_range):
    lo, hi = ngram_range
    if lo < 1 or hi < lo:
        raise ValueError(f"bad ngram_range {ngram_range}")


def _doc_threshold(value, n_docs: int, name: str) -> float:
    """int = absolute document count, float = share of documents."""
    if isinstance(value, bool):
        raise TypeError(f"{name} must be int or float")
    if isinstance(value, int):
        if value < 0:
            raise ValueError(f"{name} must be >= 0")
        return float(value)
    if isinstance(value, float):
        if not 0.0 <= value <= 1.0:
            raise ValueError(f"{name} as a float must be in [0, 1]")
        return value * n_docs
    raise TypeError(f"{name} must be int or float")


def term_stats(df: DataFrame, text_col: str = "texto_processado", stop_words=STOP_WORDS, ngram_range=(1, 2),
               fold: bool = True) -> DataFrame:
    """(term, df, cf); the row without a term has the number of documents as ``df``."""
    _check_range(ngram_range)

    def partial(batches):
        n = 0

        def texts():
            nonlocal n
            for batch in batches:
                n += batch.num_rows
                yield from _read(batch.column(0))

        for terms, group, _, tf in _counted(texts(), HELD_TOKENS, stop_words, ngram_range, fold):
            order = pc.sort_indices(terms)  # neighbours that begin alike take less of the shuffle
            parts = [terms, pa.array(np.bincount(group)), pa.array(np.bincount(group, tf).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([p.take(order) for p in parts], names=["term", "df", "cf"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([n], pa.int64()), pa.array([0], pa.int64())], names=["term", "df", "cf"])

    _small_batches(df.sparkSession)
    # nearly all terms of a task differ: dealt out first, its rows are not held once more to be added up before the shuffle
    parts = df.select(text_col).mapInArrow(partial, "term string, df long, cf long").repartition("term")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def counted_terms(df: DataFrame, min_df=1, **kw):
    """:func:`term_stats` as a table, without terms below an absolute ``min_df``, and the number of documents."""
    stats = term_stats(df, **kw)
    if isinstance(min_df, int):
        stats = stats.where(F.col("term").isNull() | (F.col("df") >= F.lit(min_df)))
    stats = written(stats)
    return stats.where("term is not null"), stats.where("term is null").agg(F.sum("df")).first()[0] or 0


def prune_vocabulary(stats: DataFrame, n_docs: int, min_df=3, max_df=0.85,
                     max_features: int | None = 2000) -> DataFrame:
    """V5 + V6: document-frequency window, then the ``max_features`` most frequent
    terms in the corpus (ties: term ascending)."""
    hi = _doc_threshold(max_df, n_docs, "max_df")
    lo = _doc_threshold(min_df, n_docs, "min_df")
    if hi < lo:
        raise ValueError("max_df corresponds to fewer documents than min_df")
    kept = stats.filter((F.col("df") >= F.lit(lo)) & (F.col("df") <= F.lit(hi)))
    if max_features is not None:
        if max_features <= 0:
            raise ValueError("max_features must be positive")
        kept = kept.orderBy(F.desc("cf"), F.asc("term")).limit(max_features)
    return kept


def idf_column(n_docs: int, df_col="df"):
    """V7: smooth idf ``ln((1+N)/(1+df)) + 1``."""
    return F.log(F.lit(float(1 + n_docs)) / (F.col(df_col) + F.lit(1.0))) + F.lit(1.0)


@dataclass
class TfidfModel:
    """Result of :func:`fit_tfidf`.

    ``docs`` keeps one row per document with ``tfidf: array<struct<term, w>>``;
    ``vocab`` is (term, term_id, df, cf, idf) ordered by term.
    """
    docs: DataFrame
    vocab: DataFrame
    n_docs: int
    n_terms: int
    doc_col: str = "doc_id"

    @property
    def shape(self):
        return (self.n_docs, self.n_terms)

    @cached_property
    def _entries(self) -> list:
        return self.vocab.orderBy("term_id").select("term", "idf").collect()

    @property
    def vocab_terms(self) -> list:
        """The terms in vocabulary order (fetched to the driver when asked for)."""
        return [r["term"] for r in self._entries]

    @property
    def idf(self) -> list:
        """The weights in vocabulary order (fetched to the driver when asked for)."""
        return [r["idf"] for r in self._entries]

    def long(self) -> DataFrame:
        """(doc_id, term, tfidf) long sparse table (V9)."""
        return (tx.explode_rows(self.docs, [self.doc_col], "tfidf")
                .select(self.doc_col, F.col("x.term").alias("term"), F.col("x.w").alias("tfidf")))

    def raw_weights(self) -> DataFrame:
        """(doc_id, term, weight) before the L2 norm (V7)."""
        return (tx.explode_rows(self.docs, [self.doc_col], "weights")
                .select(self.doc_col, F.col("x.term").alias("term"), F.col("x.w").alias("weight")))

    def with_vectors(self, output_col: str = "features") -> DataFrame:
        """``docs`` plus a sparse ``pyspark.ml`` vector in vocabulary order (JVM only)."""
        from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
        from pyspark.ml.linalg import Vectors

        bag = self.docs.withColumn(
            "_bag", F.flatten(F.transform("tf_kept", lambda x: F.array_repeat(x["term"], x["tf"].cast("int")))))
        cv = CountVectorizerModel.from_vocabulary(self.vocab_terms, inputCol="_bag", outputCol="_tf")
        ep = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_tf", outputCol="_w")
        nm = Normalizer(p=2.0, inputCol="_w", outputCol=output_col)
        return nm.transform(ep.transform(cv.transform(bag))).drop("_bag", "_tf", "_w")


def _vocabulary_counts(terms, stop_words, ngram_range, fold):
    """Arrow function from texts to their counts of ``terms``, ``array<struct<term_id, tf>>`` by ``term_id``."""
    known = pa.array(terms, pa.string())

    @F.arrow_udf("array<struct<term_id:int,tf:bigint>>")
    def counts(texts: pa.Array) -> pa.Array:
        found = [(np.empty(0, dtype=np.int64),) * 3]
        for grams, group, row, tf in _counted(_read(texts), BATCH_TOKENS, stop_words, ngram_range, fold):
            ids = pc.fill_null(pc.index_in(grams, value_set=known), -1).to_numpy(zero_copy_only=False)[group]
            found.append((row[ids >= 0], ids[ids >= 0], tf[ids >= 0]))
        row, ids, tf = map(np.concatenate, zip(*found))
        order = np.lexsort((ids, row))
        pairs = pa.StructArray.from_arrays([pa.array(ids[order], pa.int32()), pa.array(tf[order], pa.int64())], names=["term_id", "tf"])
        ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(texts))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
    return counts


def _entries(terms, idf, what: str):
    """Arrow function from (term_id, tf) arrays to the model's column ``what``, with terms, in the same order."""
    known, weight = pa.array(terms, pa.string()), np.array(idf, dtype=float)
    name, kind = ("tf", "bigint") if what == "tf_kept" else ("w", "double")

    @F.arrow_udf(f"array<struct<term:string,term_id:int,{name}:{kind}>>")
    def entries(kept: pa.Array) -> pa.Array:
        sizes = kept.value_lengths().to_numpy(zero_copy_only=False)
        ids, value = (kept.flatten().field(c) for c in ("term_id", "tf"))
        if what != "tf_kept":
            w = value.to_numpy(zero_copy_only=False) * weight[ids.to_numpy(zero_copy_only=False)]
            if what == "tfidf":
                row = np.repeat(np.arange(len(sizes)), sizes)
                w = w / np.sqrt(np.bincount(row, w * w, minlength=len(sizes)))[row]  # added up in the row's order
            value = pa.array(w)
        parts = pa.StructArray.from_arrays([known.take(ids), ids, value], names=["term", "term_id", name])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), parts)
    return entries


def fit_tfidf(df: DataFrame, text_col: str = "texto_processado", doc_col: str = "doc_id",
              max_features: int | None = 2000, ngram_range=(1, 2), min_df=3, max_df=0.85,
              stop_words=STOP_WORDS, fold: bool = True, keep_columns=None,
              persist: bool = True) -> TfidfModel:
    """V1-V10 in one call, parameters as the reference's vectoriser.

    ``persist``: the documents' counts are kept as a table in the shared folder, else made anew for every use.
    """
    keep = [c for c in (keep_columns or []) if c != doc_col]
    how = {"text_col": text_col, "stop_words": stop_words, "ngram_range": ngram_range, "fold": fold}
    texts = df.select(doc_col, text_col, *keep)
    stats, n_docs = counted_terms(texts, min_df, **how)
    if stats.isEmpty() and term_stats(texts, **how).where("term is not null").isEmpty():
        raise ValueError("empty vocabulary; perhaps the documents only contain stop words")
    vocab = prune_vocabulary(stats, n_docs, min_df, max_df, max_features)

    inline = max_features is not None and max_features <= INLINE_VOCAB_LIMIT
    if inline:
        rows = sorted(vocab.collect(), key=lambda r: r["term"])     # <= max_features rows
        if not rows:
            raise ValueError("After pruning, no terms remain. Try a lower min_df or a higher max_df.")
        terms = [r["term"] for r in rows]
        idf = [math.log((1.0 + n_docs) / (1.0 + r["df"])) + 1.0 for r in rows]
        spark = df.sparkSession
        vocab_df = spark.createDataFrame(
            [(t, i, r["df"], r["cf"], w) for i, (t, r, w) in enumerate(zip(terms, rows, idf))],
            "term string, term_id int, df long, cf long, idf double")
        # only the vocabulary's terms are counted, in its order
        kept = _vocabulary_counts(terms, stop_words, ngram_range, fold)
        out = texts.select(doc_col, *keep, kept(F.col(text_col)).alias("_kept"))
        if persist:
            out = written(out)
        made = [_entries(terms, idf, c)(F.col("_kept")).alias(c) for c in ("tf_kept", "weights", "tfidf")]
        out = out.select(doc_col, *keep, *made)
        return TfidfModel(out, vocab_df, n_docs, len(terms), doc_col)

    # unbounded vocabulary: join + window, nothing collected
    n_terms = vocab.count()
    if n_terms == 0:
        raise ValueError("After pruning, no terms remain. Try a lower min_df or a higher max_df.")
    vocab_df = global_rank(vocab.withColumn("idf", idf_column(n_docs)), ["term"], "rank")
    vocab_df = vocab_df.withColumn("term_id", (F.col("rank") - 1).cast("int")).drop("rank")
    long = (term_rows(texts, doc_col=doc_col, **how)
            .join(vocab_df.select("term", "term_id", "idf"), "term")
            .withColumn("w", F.col("tf") * F.col("idf")))
    long = long.withColumn("tfidf", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(
        Window.partitionBy(doc_col))))
    per_doc = (long.groupBy(doc_col).agg(
        F.collect_list(F.struct("term", "term_id", "tf")).alias("tf_kept"),
        F.collect_list(F.struct("term", "term_id", "w")).alias("weights"),
        F.collect_list(F.struct("term", "term_id", F.col("tfidf").alias("w"))).alias("tfidf")))
    out = texts.select(doc_col, *keep).join(per_doc, doc_col, "left")
    for c in ("tf_kept", "weights", "tfidf"):
        out = out.withColumn(c, F.coalesce(c, F.array().cast(out.schema[c].dataType)))
    return TfidfModel(out, vocab_df, n_docs, n_terms, doc_col)
