"""Spark session and shared-folder helpers.

The library never creates its own scratch space on a cluster: lineage cuts go to
the folder named by ``spark.checkpoint.dir``.  Only local runs (tests, bench)
fill that setting in when it is unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "themelens", driver_memory: str = "8g",
                  extra: dict | None = None) -> SparkSession:
    """Session for local runs (tests, bench). Cluster jobs get theirs from the launcher."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, allow_local_default=True)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, allow_local_default: bool = False) -> str:
    """Return the shared checkpoint folder from the session configuration.

    On a cluster the launcher sets ``spark.checkpoint.dir`` to a shared file system.
    A local folder is only made when ``allow_local_default`` is set (tests, bench)
    and the master is local.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if not path:
        master = spark.sparkContext.master
        if not (allow_local_default or master.startswith("local")):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder for iterative operators")
        path = tempfile.mkdtemp(prefix="themelens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set(CHECKPOINT_CONF, path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df):
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df):
    """``df`` as a table in the shared folder: later steps read its files, also after executors are lost.

    Unlike after a checkpoint, the optimizer starts afresh from here: it carries no constraints on, which
    would double with every round of a loop.
    """
    path = os.path.join(ensure_checkpoint_dir(df.sparkSession), f"table-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df):
    """Delete the files of a table of :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if os.path.basename(folder).startswith("table-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
