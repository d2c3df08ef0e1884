"""Record sources and sinks.

Readers always take a declared schema (no inference pass over the data);
writers are plain DataFrame writers, partitioned by Spark, into folders.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as lx
from ..functions import text as tx
from ..session import ensure_checkpoint_dir
from .split_files import csv_records, json_records

RECORD_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in lx.RECORD_COLUMNS])

#: blanks around a value are kept (Spark's writer drops them unless told not to)
CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"', "encoding": "UTF-8",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _kind(path: str) -> str:
    p = path.rstrip("/").lower()
    if p.endswith(".csv"):
        return "csv"
    if p.endswith(".json") or p.endswith(".jsonl"):
        return "json"
    raise ValueError("unsupported file format: use .csv or .json")


def read_records(spark: SparkSession, path: str, schema: T.StructType | None = RECORD_SCHEMA,
                 multiline_json: bool | None = None, splittable: bool = True) -> DataFrame:
    """CSV (header, quoted multi-line fields) or JSON by extension.

    CSV columns are bound by their header names, read as text and cast to
    ``schema``; columns of the schema that the file lacks are null, and ``schema=None``
    keeps the file's own columns.  JSON files hold one object a line, or one array
    or object over many lines; unless ``multiline_json`` says which, the first line that
    isn't blank tells.  Input that can't be parsed raises.  Other extensions raise
    ``ValueError``.

    CSV files and JSON arrays are read by many tasks a file (:mod:`split_files`).  With ``splittable=False``
    every file is one task's, which also reads quotes that don't follow RFC 4180 (one within an unquoted
    field), lone carriage returns as line ends, and arrays of other things than objects.
    """
    if _kind(path) == "csv":
        rows = spark.read.options(**CSV_OPTIONS, mode="FAILFAST").csv(path)
        if splittable and rows.columns:
            rows = csv_records(spark, path, rows.columns, CSV_OPTIONS)
        if schema is None:
            return rows
        return rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                             for f in schema])
    if multiline_json is None:
        multiline_json = not path.rstrip("/").lower().endswith(".jsonl") and _starts_array(spark, path)
    if multiline_json and splittable and schema is not None and _starts_array(spark, path, "["):
        return json_records(spark, path, schema)
    reader = spark.read.option("mode", "FAILFAST").option("multiLine", str(multiline_json).lower())
    return (reader.schema(schema) if schema is not None else reader).json(path)


def _starts_array(spark: SparkSession, path: str, *opening: str) -> bool:
    """Whether a JSON file is laid out over many lines: its first line opens an array or an object only."""
    line = F.trim(F.translate(F.substring("value", 1, 1000), "\ufeff\r\t", "")).alias("line")
    first = spark.read.text(path).select(line).where("line <> ''").first()
    return first is not None and (first.line.startswith("[") or first.line == "{" and "[" not in opening)


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> bool:
    """JSON lines or CSV by extension; nothing is written for an empty input."""
    if df.isEmpty():
        return False
    kind = _kind(path)
    w = df.write.mode(mode)
    if kind == "csv":
        w.options(**CSV_OPTIONS).csv(path)
    else:
        w.option("encoding", "UTF-8").json(path)
    return True


def save_results(df: DataFrame, path: str) -> DataFrame:
    """Keep the present result columns in fixed order and write them by extension."""
    out = result_projection(df)
    write_records(out, path)
    return out


def result_projection(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in lx.RESULT_COLUMNS if c in df.columns])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder (never machine-local on a cluster)."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def record_preview(df: DataFrame, order_col: str, n: int = lx.PREVIEW_ROWS, width: int = lx.PREVIEW_CHARS,
                   columns=None) -> DataFrame:
    """First ``n`` records, non-blank fields only, values cut to ``width`` chars + '...'."""
    cols = [c for c in (columns or lx.RECORD_COLUMNS) if c in df.columns]
    first = df.orderBy(order_col).limit(n)                       # TakeOrdered: n rows
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("field"),
                               F.col(c).cast("string").alias("value")) for i, c in enumerate(cols)])
    long = tx.explode_rows(first.select(order_col, pairs.alias("_p")), [order_col], "_p", "x")
    v = F.col("x.value")
    keep = v.isNotNull() & (tx.strip_ws(v) != F.lit(""))
    shown = F.concat(F.substring(v, 1, width), F.when(F.length(v) > width, F.lit("...")).otherwise(F.lit("")))
    return long.filter(keep).select(order_col, F.col("x.i").cast("long").alias("field_pos"),
                                    F.col("x.field").alias("field"), shown.alias("shown"))
