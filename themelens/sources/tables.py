"""Driver tables and the record views built on them.

The test tables carry no theses, so they are mapped onto the record layout:
``documents.text`` is the abstract (``resumo``), its first line the title,
``source`` the advisor; ``orders`` joined to ``customer`` is the large item table
(customer = advisor, priority = theme, order year = year).
"""

from __future__ import annotations

import os

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """Parquet scan of a driver table.

    ``spread``: for tables with heavy per-row work, make sure there are at least as
    many partitions as task slots.  On a cluster the scan already yields
    thousands of splits and this is a no-op; a small single-row-group file would
    otherwise run on one core.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(table_path(sf_dir, name))
    if spread:
        df = spread_rows(df)
    return df


def spread_rows(df: DataFrame) -> DataFrame:
    """Spread a scan that yields fewer splits than task slots.

    The spread copy is persisted, which keeps the optimizer from pushing the expensive per-row
    filters of later steps below the exchange, where they would run in the single scan task.  It is
    kept on disk: few splits of 128 MB can be more than the executors have memory to spare for.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        return df.repartition(slots).persist(StorageLevel.DISK_ONLY)
    return df


def first_line(c):
    """Text up to the first line feed (whole text when there is none)."""
    return F.substring_index(c, "\n", 1)


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records view of ``documents``: doc_id, titulo, resumo, orientador, lang."""
    d = read_table(spark, sf_dir, "documents", spread=True)
    return d.select(
        "doc_id",
        first_line(F.col("text")).alias("titulo"),
        F.col("text").alias("resumo"),
        F.col("source").alias("orientador"),
        "lang",
    )


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item view of orders joined to customers: advisor = customer name,
    theme = order priority, year = order year (as text, like a harvested field)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return o.join(c, o.o_custkey == c.c_custkey, "inner").select(
        F.col("o_orderkey").alias("item_id"),
        F.col("c_name").alias("orientador"),
        F.col("o_orderpriority").alias("cluster_name"),
        F.date_format("o_orderdate", "yyyy").alias("ano"),
        F.concat(F.lit("Item "), F.col("o_orderkey").cast("string")).alias("titulo"),
        F.concat(F.lit("Autor "), F.col("o_custkey").cast("string")).alias("autor"),
    )
