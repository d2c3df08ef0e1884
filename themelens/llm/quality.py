"""Quality rules: a rule bitmask ledger.

Every rule is evaluated once a document; the ledger keeps the measurements and one
failure bit a rule.  Policies are named sets of rules, so a verdict is a bitwise test on
the ledger, and an ablation (what changes without a rule) is an aggregation over its
bits: no text is read again.  All of it is row-local built-in functions, without a shuffle.

Repeated 3-word windows are found inside the row: the windows' 64-bit hashes are
compared for distinctness first; only rows with a repeat sort (hash, position) pairs,
packed into one long with as many position bits as the row needs, and read neighbours.
Windows that agree in the hash bits that are left are sorted once more with their hash and
words, so that only equal words count as a repeat, at every length of text.

Defined results: a null or empty text has no words and all measurements zero (and fails
``few_words``); every row is measured for itself, so repeated rows, ties and null ids
don't matter; an empty table gives an empty ledger; extra columns are carried along in
``row``, under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, read, settled

SPACE = "[ \\t-\\r]+"
WORD = "[^ \\t-\\r]"
WINDOW = 3

#: Rule -> condition on the measurements under which a document fails it. The place in
#: this list is the rule's bit; new rules go to the end.
RULES = [
    ("few_words", lambda m: m["n_words"] < 50),
    ("repeated_words", lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 50),
    ("symbols", lambda m: m["n_symbols"] * 10 > m["n_words"]),
    ("repeated_lines", lambda m: m["n_dup_lines"] * 2 > m["n_lines"]),
    ("capitals", lambda m: m["n_upper"] * 2 > m["n_letters"]),
    ("shouting", lambda m: m["n_shouts"] * 2 > m["n_words"]),
    ("word_length", lambda m: (m["word_chars"] < m["n_words"] * 3) | (m["word_chars"] > m["n_words"] * 10)),
    ("some_repeated_lines", lambda m: m["n_dup_lines"] * 10 > m["n_lines"] * 3),
]
BITS = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Rules that every policy holds.
BASE = ("few_words", "repeated_words")
#: Policy version -> its rules.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines", "capitals", "shouting"),
    "strict": tuple(BITS),
}


def mask(rules) -> int:
    """The bits of rules, by their names."""
    return sum(BITS[r] for r in rules)


def count_of(chars: str, text):
    """How many characters of a class a text holds."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def rule_ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``), ``m`` (measurements) and ``failures`` (bits)."""
    text = F.col("text")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    words, n = F.col("words"), F.size("words")
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW),
                          lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))
    rows = rows.withColumn("windows", F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<long>")))
    low = F.expr("cast(ceil(log2(size(windows) + 1)) as int)")
    packed = F.expr("transform(windows, (h, i) -> shiftleft(shiftright(h, low), low) | i)")
    rows = rows.withColumn("low", low).withColumn("packed", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(packed)))
    twice = F.expr("""filter(packed, (x, k) ->
        (k > 0 and shiftright(get(packed, k - 1), low) = shiftright(x, low))
        or (k + 1 < size(packed) and shiftright(get(packed, k + 1), low) = shiftright(x, low)))""")
    rows = rows.withColumn("twice", F.when(F.col("packed").isNotNull(), twice))
    at = [f"'w{k}', get(words, i + {k})" for k in range(WINDOW)]
    rows = rows.withColumn("alike", F.expr(f"""sort_array(transform(
        transform(twice, x -> cast(x & (shiftleft(1L, low) - 1) as int)),
        i -> named_struct('h', get(windows, i), {", ".join(at)}, 'i', cast(i as long))))"""))
    same = " and ".join(f"get(alike, {{0}}).{c} = x.{c}" for c in ("h", *(f"w{k}" for k in range(WINDOW))))
    rows = rows.withColumn("repeats", F.expr(f"""transform(filter(alike, (x, k) ->
        (k > 0 and {same.format("k - 1")}) or (k + 1 < size(alike) and {same.format("k + 1")})), x -> x.i)"""))
    covered = F.expr(f"""aggregate(sort_array(repeats),
        named_struct('last', -{WINDOW}L, 'n', 0L),
        (a, x) -> named_struct('last', x, 'n', a.n + least({WINDOW}L, x - a.last)), a -> a.n)""")
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    rows = rows.withColumn("lines", lines)
    measured = rows.select("row", F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count_of("#*$%&|<>", text).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("repeats").isNotNull(), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        count_of("\\p{Lu}", text).alias("n_upper"),
        count_of("\\p{L}", text).alias("n_letters"),
        count_of("!?", text).alias("n_shouts")).alias("m"))
    bits = [F.when(fails(F.col("m")), F.lit(BITS[name])).otherwise(F.lit(0)) for name, fails in RULES]
    return measured.withColumn("failures", settled(sum(bits, F.lit(0)).cast("long")))


def fails(rules, failures="failures"):
    """Whether a row of the ledger fails any of ``rules``."""
    return F.col(failures).bitwiseAND(F.lit(mask(rules)).cast("long")) != 0


def keep(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass a policy, with their own columns."""
    return rule_ledger(docs, text_col).where(~fails(POLICIES[policy])).select("row.*")


def ablations(ledger: DataFrame, policy: str) -> DataFrame:
    """rule, failed (rows failing it), alone (rows kept if it were dropped), kept (by the policy)."""
    whole = mask(POLICIES[policy])
    seen = ledger.groupBy(F.col("failures").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).count()
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit"))
                                for r in POLICIES[policy]])).alias("r")
    of = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("count"))), F.lit(0))
    return seen.select("bits", "count", rules).groupBy(F.col("r.rule").alias("rule")).agg(
        of(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("failed"),
        of(F.col("bits") == F.col("r.bit")).alias("alone"),
        of(F.col("bits") == 0).alias("kept"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        [l FOR l IN string_split(text, chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines FROM d),
p AS (SELECT k, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
g AS (SELECT k, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c, list(i) AS places FROM p
      GROUP BY ALL HAVING count(*) > 1),
s AS (SELECT k, unnest(places) AS i FROM g),
r AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM s) GROUP BY k),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
        length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_upper,
        length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS n_letters,
        length(regexp_replace(text, '[^!?]+', '', 'g')) AS n_shouts
      FROM w LEFT JOIN r USING (k)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        n_symbols * 10 > n_words OR n_dup_lines * 2 > n_lines OR n_upper * 2 > n_letters
        OR n_shouts * 2 > n_words AS more_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT more_failed AS kept FROM f
"""


@query("op7_quality_rules", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdict of policy v1 for every document."""
    ledger = rule_ledger(read(spark, sf_dir, "documents", "doc_id", "text"))
    return ledger.select(
        "row.doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words",
        fails(BASE).alias("base_failed"), (~fails(POLICIES["v1"])).alias("kept"))
