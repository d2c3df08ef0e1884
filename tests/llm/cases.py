"""Rows that every operator must handle, and small reference computations."""

import re

LONG_WORDS = " ".join(f"w{i % 9973}x{i % 97}" for i in range(40_000))
PARAGRAPH = "The quick brown fox jumps over the lazy dog while the band plays on and on until dawn breaks here. " * 4

#: (doc_id, text): nulls, empty and blank texts, repeated rows, long texts and words, other letters.
ROWS = [
    (1, ""), (2, None), (3, "a"), (4, LONG_WORDS), (5, PARAGRAPH + "five"), (5, PARAGRAPH + "five"),
    (6, PARAGRAPH + "six"), (None, "no id, one two three four"), (None, PARAGRAPH + "five"), (7, "  \n\t "),
    (8, "x" * 30_000), (9, "1" * 30_000), (10, "Ünïcødé 漢字 한글 𐍈 ﬁ   é ▁ <|endoftext|>"),
    (11, "same line here\nsame line here\nanother line"), (12, "same line here\nsame line herf"),
    (13, "\n\n"), (14, PARAGRAPH + "five"), (15, "a\x00b\x01\r\nc \x1f d  e\x85f"), (16, " lead and trail "),
]
#: Extra columns under names that the operators use themselves.
EXTRA = ["row", "words", "key", "ids", "part", "tile", "fp", "length", "spans", "line", "m", "failures", "count", "rank"]


def frame(spark, rows=ROWS):
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(d, t, *EXTRA) for d, t in rows], schema).repartition(3)


def empty(spark):
    return frame(spark, ROWS[:1]).where("false")


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", text)


def by_row(df, *columns):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def documents(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet")


def pairs(df):
    """(doc_id, text) of a table."""
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


class Sets:
    """Union-find."""

    def __init__(self, n):
        self.up = list(range(n))

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
