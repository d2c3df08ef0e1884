"""Text preparation over a record DataFrame keyed by ``doc_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.lexicon import MIN_TEXT_CHARS


def prepare_text(df: DataFrame, text_columns=None, lemmas: DataFrame | None = None,
                 min_chars: int = MIN_TEXT_CHARS, keep_short: bool = False) -> DataFrame:
    """Adds ``texto_combinado``, ``texto_limpo`` and ``texto_processado``.

    Rows whose processed text has at most ``min_chars`` characters after strip are
    removed (T6) unless ``keep_short``.  With a ``lemmas`` table (surface, lemma, pos)
    the processed text is lemmatised (T5); without one it equals the cleaned text.
    """
    out = (df.withColumn("texto_combinado", tx.combine_text(df.columns, text_columns))
             .withColumn("texto_limpo", tx.settled(tx.clean_text(F.col("texto_combinado")))))
    if lemmas is not None:
        from .lemmas import lemmatize
        out = lemmatize(out, lemmas, "texto_limpo", "texto_processado")
    else:
        out = out.withColumn("texto_processado", F.col("texto_limpo"))
    if not keep_short:
        out = out.filter(tx.long_enough(F.col("texto_processado"), min_chars))
    return out


def dropped_counts(df: DataFrame, min_chars: int = MIN_TEXT_CHARS) -> DataFrame:
    """Rows before, after and dropped by the length filter, in one pass."""
    prepared = prepare_text(df, keep_short=True)
    keep = tx.long_enough(F.col("texto_processado"), min_chars)
    return prepared.agg(
        F.count(F.lit(1)).alias("n_before"),
        F.count_if(keep).alias("n_after"),
        F.count_if(~keep | keep.isNull()).alias("n_dropped"),
    )
