"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept;
its result is written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of ``documents``, with ``n_chars`` following the text.

1. quality: documents that fail policy ``v1`` of the rule ledger go.
2. lines: of every class of alike lines the first of the corpus stays.
3. near_duplicates: of each group of texts within 3 fingerprint bits one row stays, the one with the
   smallest id (null after all others), then the smallest hash of the text.  Rows are told apart by a
   key of their own, so ids may repeat or be null.
4. personal_data: spans are replaced by their kind.
5. packing: every piece of every text with its sequence and place.

Null texts: the quality rules reject them, as they have no words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themelens.llm.common import default_path, materialise, read
from themelens.llm.lines import dedup_documents
from themelens.llm.packing import pack_documents
from themelens.llm.pii import redact
from themelens.llm.quality import keep
from themelens.llm.simhash import near_duplicates

#: SQL can't express the stages after line dedup (hash fingerprints, a trained classifier, token ids).
ORACLE_SQL = None


def counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text has it now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep(docs, "v1")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(dedup_documents(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("hash"),
                   F.monotonically_increasing_id().alias("number"))
    rows = materialise(docs.select(F.struct("*").alias("row"), key.alias("key")), "rows")  # a number holds once it is written
    found = near_duplicates(rows.select("key", F.col("row.text").alias("text")), words=3, max_bits=3, id_col="key")
    heads = found.where("doc_id.number = component_id.number").select("component_id.number")
    return rows.withColumn("number", F.col("key.number")).join(heads, "number").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, default_path("byte_bpe_50k.json"))[1].drop("piece_id")


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", one_of_each),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
