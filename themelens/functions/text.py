"""Column expressions for text preparation and tokenising (JVM-side built-ins).

Character classes follow Python's ``str`` regex semantics (``\\w`` = letters,
numbers and ``_``; ``\\s`` = ``str.isspace``).  The whitespace class is derived
from ``str.isspace`` and written with ``\\x{..}`` escapes, a syntax that both
Java regex (Spark) and RE2 (DuckDB, used by the oracles) accept, so the same
pattern text runs in both engines.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _ranges(codepoints):
    out, start, prev = [], None, None
    for cp in codepoints:
        if start is None:
            start = prev = cp
        elif cp == prev + 1:
            prev = cp
        else:
            out.append((start, prev))
            start = prev = cp
    if start is not None:
        out.append((start, prev))
    return out


def _class_body(codepoints) -> str:
    parts = []
    for a, b in _ranges(sorted(codepoints)):
        parts.append(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}")
    return "".join(parts)


#: body of a character class matching exactly Python's whitespace (``str.isspace``)
WS_CLASS = _class_body(cp for cp in range(sys.maxunicode + 1) if chr(cp).isspace())
#: the same characters
WS_CHARS = "".join(chr(cp) for cp in range(sys.maxunicode + 1) if chr(cp).isspace())
#: body of a class matching Python's ``\w`` for ``str`` patterns
WORD_CLASS = r"\p{L}\p{N}_"

#: Every char that is not word, whitespace or '.'
NON_TEXT_PATTERN = f"[^{WORD_CLASS}{WS_CLASS}.]"
#: T4 / H9: runs of whitespace
WS_RUN_PATTERN = f"[{WS_CLASS}]+"
#: H9/A1 strip: leading or trailing whitespace runs
WS_EDGES_PATTERN = f"^[{WS_CLASS}]+|[{WS_CLASS}]+$"
#: V2: default token pattern, word runs of two or more characters
TOKEN_PATTERN = f"[{WORD_CLASS}]{{2,}}"
#: the same for Python's ``re``
PYTHON_TOKEN_PATTERN = r"\w{2,}"


# ---------------------------------------------------------------- T2-T4, T6, H9
def combine_text(df_columns, columns=None, sep: str = ". ") -> Column:
    """Join the present text columns; null -> '' and separators always kept."""
    from .lexicon import TEXT_COLUMNS

    wanted = TEXT_COLUMNS if columns is None else columns
    present = [c for c in wanted if c in df_columns]
    if not present:
        raise ValueError(f"none of the text columns {wanted} is present")
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in present])


def strip_punct_lower(c: Column) -> Column:
    """Delete (not blank) chars that are not word/whitespace/'.', then lower-case."""
    return F.lower(F.regexp_replace(c, NON_TEXT_PATTERN, ""))


def collapse_ws(c: Column) -> Column:
    """T4: runs of whitespace become one blank (no strip)."""
    return F.regexp_replace(c, WS_RUN_PATTERN, " ")


def clean_text(c: Column) -> Column:
    """T3 then T4."""
    return collapse_ws(strip_punct_lower(c))


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of any kind."""
    return F.regexp_replace(c, WS_EDGES_PATTERN, "")


def clean_whitespace(c: Column) -> Column:
    """H9: strip, collapse whitespace runs to one blank; null/empty -> ''."""
    return F.coalesce(collapse_ws(strip_ws(c)), F.lit(""))


def long_enough(c: Column, min_chars: int = 50) -> Column:
    """Non-null and more than ``min_chars`` characters after strip."""
    return c.isNotNull() & (F.length(F.btrim(c, F.lit(WS_CHARS))) > F.lit(min_chars))


def settled(c: Column) -> Column:
    """``c`` as it is, but opaque to the optimizer: a filter on a computed column is moved below the projections with
    the whole computation written out in it, once for each mention; what isn't deterministic is computed once and stays put."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


# ---------------------------------------------------------------- V1 accent folding
def _fold_char(ch: str) -> str:
    norm = unicodedata.normalize("NFKD", ch)
    return "".join(x for x in norm if not unicodedata.combining(x))


@functools.lru_cache(maxsize=1)
def fold_tables():
    """Rule-built folding tables: NFKD decomposition minus combining marks.

    Returns ``(src, dst, rare_pattern)``: single BMP characters that fold to one
    character go to ``translate(src, dst)`` (JVM); texts matching ``rare_pattern``
    (anything beyond Latin-1, or Latin-1 characters unfolding into several, such
    as fractions) go through the Arrow fallback.
    """
    one, gone, rare_latin1 = [], [], []
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        # only characters with a decomposition or combining marks change
        if not (unicodedata.decomposition(ch) or unicodedata.combining(ch)):
            continue
        f = _fold_char(ch)
        if f == ch:
            continue
        if len(f) == 1:
            one.append((ch, f))
        elif not f:
            gone.append(ch)          # bare combining marks: deleted
        elif cp <= 0xFF:
            rare_latin1.append(cp)
    # translate() deletes the source chars that have no counterpart in ``dst``,
    # so the deleted ones go last.
    src_s = "".join(s for s, _ in one) + "".join(gone)
    dst_s = "".join(d for _, d in one)
    # Texts with a character beyond Latin-1 (or one of the few Latin-1 characters
    # that unfold into several) take the exact path.  A single negated range keeps
    # the test cheap; the Arrow path is exact for whatever it receives.
    rare = "[^\\x{0}-\\x{FF}]" + (f"|[{_class_body(rare_latin1)}]" if rare_latin1 else "")
    return src_s, dst_s, rare


def fold_text(s):
    """V1 of one text."""
    if s is None:
        return None
    if s.isascii():
        return s
    return "".join(x for x in unicodedata.normalize("NFKD", s) if not unicodedata.combining(x))


@F.pandas_udf(T.StringType())
def _fold_rare(s: pd.Series) -> pd.Series:
    return s.map(fold_text)


def fold_accents(c: Column, exact: bool = True) -> Column:
    """V1: NFKD accent folding.

    Common characters are folded by ``translate`` inside the JVM.  Only texts that
    contain a character whose fold is not a single BMP character are shipped to
    the Arrow UDF (others pass as null, which costs nothing in Arrow).
    """
    src, dst, rare_pattern = fold_tables()
    jvm = F.translate(c, src, dst)
    if not exact:
        return jvm
    rare = _fold_rare(F.when(c.rlike(rare_pattern), c))
    return F.coalesce(rare, jvm)


# ---------------------------------------------------------------- V2-V4
def tokenize(c: Column, pattern: str = TOKEN_PATTERN) -> Column:
    """V2: all matches of the token pattern, in text order."""
    return F.regexp_extract_all(c, F.lit(pattern), 0)


def remove_stopwords(tokens: Column, stop_words) -> Column:
    """V3: drop tokens equal to a stop word (exact match, list not folded)."""
    words = list(dict.fromkeys(stop_words))
    if not words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(words))


def word_ngrams(tokens: Column, n: int) -> Column:
    """Contiguous n-grams joined by a blank; empty when fewer than n tokens."""
    if n == 1:
        return tokens
    if n == 2:
        k = F.size(tokens) - 1
        return F.when(F.size(tokens) > 1,
                      F.zip_with(F.slice(tokens, 1, k), F.slice(tokens, 2, k),
                                 lambda a, b: F.concat_ws(" ", a, b))
                      ).otherwise(F.array().cast("array<string>"))
    m = F.size(tokens) - n + 1
    return F.when(m > 0,
                  F.transform(F.sequence(F.lit(1), m), lambda i: F.array_join(F.slice(tokens, i, n), " "))
                  ).otherwise(F.array().cast("array<string>"))


def ngram_terms(tokens: Column, ngram_range=(1, 2)) -> Column:
    """V4: all n-grams for n in the range, built after stop-word removal."""
    lo, hi = ngram_range
    if lo < 1 or hi < lo:
        raise ValueError(f"bad ngram_range {ngram_range}")
    parts = [word_ngrams(tokens, n) for n in range(lo, hi + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def with_term_counts(df, terms_col: str = "terms", out_col: str = "tf"):
    """Adds per-row term frequencies ``array<struct<term, tf>>`` without a shuffle.

    The row's terms are sorted and runs are counted inside the row, so the
    (document, term) count table never crosses the network.  Every lambda only
    touches its own elements (no lookups into other arrays), which keeps the
    work linear in the number of terms after the sort.
    """
    s, prev, flag, starts = "_tc_sorted", "_tc_prev", "_tc_flag", "_tc_starts"
    n = F.size(F.col(s))
    out = df.withColumn(s, F.array_sort(F.col(terms_col)))
    out = out.withColumn(prev, F.concat(F.array(F.lit(None).cast("string")),
                                        F.slice(F.col(s), 1, F.greatest(n - 1, F.lit(0)))))
    out = out.withColumn(flag, F.zip_with(s, prev, lambda a, b: b.isNull() | (a != b)))
    out = out.withColumn(starts, F.filter(F.transform(flag, lambda f, i: F.when(f, i)),
                                          lambda x: x.isNotNull()))
    m = F.size(F.col(starts))
    ends = F.concat(F.slice(F.col(starts), 2, F.greatest(m - 1, F.lit(0))), F.array(n))
    firsts = F.filter(F.zip_with(s, flag, lambda t, f: F.when(f, t)), lambda x: x.isNotNull())
    counts = F.zip_with(ends, starts, lambda e, b: (e - b).cast("long"))
    out = out.withColumn(out_col, F.when(n > 0, F.zip_with(
        firsts, counts, lambda t, c: F.struct(t.alias("term"), c.alias("tf")))).otherwise(
        F.array().cast("array<struct<term:string,tf:bigint>>")))
    return out.drop(s, prev, flag, starts)


def explode_rows(df, keep, array_col, alias: str = "x", with_pos: bool = False):
    """One row per element of ``array_col`` (rows with empty arrays vanish).

    ``explode_outer`` + a null filter instead of ``explode``: for a plain explode
    the optimizer infers ``size(array) > 0`` and pushes it below the projections,
    re-evaluating the whole expression that built the array a second time.
    """
    keep = list(keep)
    if with_pos:
        out = df.select(*keep, F.posexplode_outer(array_col).alias("pos", alias))
    else:
        out = df.select(*keep, F.explode_outer(array_col).alias(alias))
    return out.filter(F.col(alias).isNotNull())
