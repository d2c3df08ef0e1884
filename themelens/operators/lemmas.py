"""T5: lemmatisation re-aimed as a lookup in a lemma table.

The per-row NLP model of the original is replaced by a table
``(surface, lemma, pos)`` (for example exported once from any tagger).  Each
text is split into word runs and dot runs; every token is looked up, tokens
tagged PUNCT, SPACE, SYM or NUM are dropped (unknown tokens: dot runs count as
PUNCT and digit runs as NUM), the rest are replaced by their lemma and joined
with blanks.

Plan: a table of at most ``INLINE_LEMMAS`` surfaces goes to every task, which looks up the tokens of
a document inside the row; the texts are shuffled once, by document.  A larger table is joined with
the tokens (AQE picks broadcast or shuffle from its measured size), which are regrouped by document.
Both give the same rows: the tokens of documents of one id are put together by position.  Of several
rows of one surface the smallest (pos, lemma) counts; a null lemma leaves the surface
form, a null pos the default tag, a null surface is ignored.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: word runs or runs of dots (the only punctuation left after cleaning)
LEMMA_TOKEN_PATTERN = f"[{tx.WORD_CLASS}]+|[.]+"
PYTHON_LEMMA_TOKEN_PATTERN = r"\w+|[.]+"
#: largest lemma table that is sent to every task
INLINE_LEMMAS = 100_000
DROP_POS = ("PUNCT", "SPACE", "SYM", "NUM")


def _default_pos(tok):
    return (F.when(tok.rlike(r"^[.]+$"), F.lit("PUNCT"))
            .when(tok.rlike(r"^\p{N}+$"), F.lit("NUM")).otherwise(F.lit("X")))


def _lookup(entries):
    """Arrow function from the texts of a document id to its lemmatised text."""
    pattern, drop = re.compile(PYTHON_LEMMA_TOKEN_PATTERN), frozenset(DROP_POS)
    # None: the token goes; a surface without a tag has the default one
    table = {r["surface"]: (r["surface"] if r["lemma"] is None else r["lemma"], r["lpos"]) for r in entries}

    def kept(token):
        lemma, pos = table.get(token, (token, None))
        if pos is None:
            dropped = token[0] == "." or (token.isnumeric() and all(unicodedata.category(c)[0] == "N" for c in token))
        else:
            dropped = pos in drop
        return None if dropped else lemma

    @F.arrow_udf("string")
    def lemmatised(texts: pa.Array) -> pa.Array:
        out = []
        for group in texts.to_pylist():
            if len(group) == 1:
                words = [w for w in map(kept, pattern.findall(group[0])) if w is not None]
            else:
                found = ((i, kept(t)) for text in group for i, t in enumerate(pattern.findall(text)))
                words = [w for _, w in sorted(x for x in found if x[1] is not None)]
            out.append(" ".join(words))
        return pa.array(out, pa.string())
    return lemmatised


def lemmatize(df: DataFrame, lemmas: DataFrame, text_col: str, out_col: str, doc_col: str = "doc_id") -> DataFrame:
    best = F.min(F.struct("pos", "lemma")).alias("best")
    tab = lemmas.where("surface is not null").groupBy("surface").agg(best).select(
        "surface", F.col("best.lemma").alias("lemma"), F.col("best.pos").alias("lpos"))
    entries = tab.limit(INLINE_LEMMAS + 1).collect()
    if len(entries) <= INLINE_LEMMAS:
        texts = F.collect_list(F.coalesce(F.col(text_col), F.lit(""))).alias("_texts")
        per_doc = (df.where(F.col(doc_col).isNotNull()).groupBy(doc_col).agg(texts)
                   .select(doc_col, _lookup(entries)(F.col("_texts")).alias(out_col)))
        out = df.join(per_doc, doc_col, "left")
        return out.withColumn(out_col, F.coalesce(F.col(out_col), F.lit("")))
    toks = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(LEMMA_TOKEN_PATTERN), 0)
    long = tx.explode_rows(df.select(doc_col, toks.alias("_tok")), [doc_col], "_tok", "t", with_pos=True)
    j = long.join(tab, long.t == tab.surface, "left")
    j = j.select(doc_col, "pos", F.coalesce("lemma", "t").alias("lemma"),
                 F.coalesce(F.col("lpos"), _default_pos(F.col("t"))).alias("tag"))
    j = j.filter(~F.col("tag").isin(list(DROP_POS)))
    per_doc = j.groupBy(doc_col).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "lemma"))), lambda x: x["lemma"]), " ").alias(out_col))
    out = df.join(per_doc, doc_col, "left")
    return out.withColumn(out_col, F.coalesce(F.col(out_col), F.lit("")))
