"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themelens.session import ensure_checkpoint_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Rows of one Arrow batch: texts may be long, so batches hold few of them.
ARROW_ROWS = 1000
ARROW_BYTES = "4m"


def query(name: str, oracle: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def bound_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Arrow batches hold no more than so many rows, or some ``ARROW_BYTES``, from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Scan of a driver table; only ``columns`` are read where they are given."""
    bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder of ``spark.checkpoint.dir``."""
    return os.path.join(ensure_checkpoint_dir(spark), f"llm-{uuid.uuid4().hex}", name)


def materialise(df: DataFrame, name: str, arrow_rows: int = ARROW_ROWS) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: later stages re-read the files, also after executors are lost.  The
    shuffle files of the finished step are of no use then; Spark removes them once the driver
    has collected its garbage, so that is asked for, and the disk holds one step's at a time.
    Arrow batches are bounded, also where ``read`` didn't open the table.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    bound_batches(spark, arrow_rows)
    df.write.option("compression", "zstd").parquet(path)
    bound_batches(spark)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def settled(column):
    """``column`` as it is, but opaque to the optimizer.

    A filter on a computed column is moved below the projections with the whole computation
    written out in it, once for each mention; a condition that isn't deterministic stays put.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)


def default_path(name: str) -> str:
    """Where the public tokenizer file ``name`` is installed."""
    import public_tokenizers
    return public_tokenizers.path(name)


def texts(column) -> list[str]:
    """The strings of an Arrow column, a null read as the empty text."""
    return [t or "" for t in column.to_pylist()]


def binary(values) -> pa.Array:
    """Arrow array of byte strings."""
    return pa.array(values, type=pa.binary())
