"""Incremental harvest with Structured Streaming.

New page files arriving in a folder are turned into records micro-batch by
micro-batch.  The set of processed URLs (the crawl's dedupe state) is the sink
table itself: each batch keeps the first page per URL, anti-joins it with the
records already written and appends the rest, so a replayed batch after a
failure writes nothing twice.  Progress is kept in the checkpoint location,
which must be on the shared file system (by default below
``spark.checkpoint.dir``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import harvest
from ..session import ensure_checkpoint_dir

PAGE_SCHEMA = "page_id bigint, url string, html string"


def _existing(spark: SparkSession, out_dir: str):
    """URLs already in the sink (any file system Spark can read), or None before the first batch.

    Only a missing path means that there is no sink yet; any other failure is raised.
    """
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(out_dir).select(F.col("link_acesso").alias("url"))
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def harvest_batch(batch: DataFrame, out_dir: str, base=None) -> None:
    """Harvest the pages whose URLs the sink doesn't hold; they are set aside before the parse."""
    pages = harvest.dedupe_urls(harvest.size_guard(batch))
    done = _existing(batch.sparkSession, out_dir)
    if done is not None:
        pages = pages.join(done, "url", "left_anti")
    harvest.extract_records(pages, base=base).write.mode("append").parquet(out_dir)


def start_record_stream(spark: SparkSession, pages_dir: str, out_dir: str, checkpoint: str | None = None,
                        glob: str | None = None, base=None, available_now: bool = True):
    """Start the incremental harvest; returns the StreamingQuery."""
    ckpt = checkpoint or os.path.join(ensure_checkpoint_dir(spark), "harvest-stream")
    reader = spark.readStream.schema(PAGE_SCHEMA)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    src = reader.parquet(pages_dir)
    w = (src.writeStream.foreachBatch(lambda df, _epoch: harvest_batch(df, out_dir, base))
         .option("checkpointLocation", ckpt))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def run_to_completion(spark: SparkSession, pages_dir: str, out_dir: str, **kw) -> DataFrame:
    q = start_record_stream(spark, pages_dir, out_dir, **kw)
    q.awaitTermination()
    return spark.read.parquet(out_dir)
