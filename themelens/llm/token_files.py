"""Token ids in binary files: fixed-width bit packing with block offsets.

File format, all numbers little-endian::

    magic 8 bytes | bit width u32 | ids per block u32 | documents u64 | ids u64 | blocks u64
    doc ids i64[documents] | doc id present u8[documents] | first id of each document u64[documents + 1]
    block offsets u64[blocks + 1], from the start of the payload | payload

Every id takes the bits that the largest vocabulary id needs.  A block holds a multiple
of eight ids, so it starts on a byte; any range of ids is read by seeking to its blocks
and unpacked with vectorised shifts.

Work is dealt by ranges of (document id, hash of the text), so that one document id with
very many rows is split as well; each task writes its documents as one or more files
under names of its own attempt, and only the names that Spark commits in the manifest
are read.  The manifest stays a table, also where the read tasks are made from it.

Defined results: a null text is the empty text (its ids are the end id alone); a null
document id sorts first and is read back as null; rows of one document id follow each
other in the order of their text's hash; an empty table gives no files and no rows; other
columns are ignored.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themelens.operators.ranks import running_total

from .common import binary, default_path, materialise, query, read, shared_path, texts
from .subwords import WordBpe, encoder

MAGIC = b"TOKIDS01"
HEADER = struct.Struct("<8sIIQQQ")
BLOCK_IDS = 4096
#: A file is closed once it holds so many ids (32 MB at 16 bits); documents are not cut.
FILE_IDS = 1 << 24
#: Documents that one read task takes at a time.
READ_DOCS = 2048


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids (uint32) as ``width`` bits each, padded to whole bytes."""
    n = len(ids)
    eight = np.zeros((-(-n // 8), 8), dtype=np.uint64)
    eight.reshape(-1)[:n] = ids
    out = np.zeros((len(eight), width + 8), dtype=np.uint8)
    for j in range(8):
        at, shift = divmod(j * width, 8)
        value = eight[:, j] << np.uint64(shift)
        for k in range(-(-(width + shift) // 8)):
            out[:, at + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return out[:, :width].tobytes()[: -(-n * width // 8)]


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes."""
    padded = data + bytes(8)
    words = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    bits = np.arange(n, dtype=np.int64) * width
    return ((words[bits >> 3] >> (bits & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype("<u4")


class FileWriter:
    """Collects documents, packing whole blocks as they fill."""

    def __init__(self, width: int):
        self.width, self.docs, self.present, self.starts = width, [], [], [0]
        self.payload, self.offsets, self.open, self.n_open = bytearray(), [0], [], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.present.append(doc_id is not None)
        self.starts.append(self.starts[-1] + len(ids))
        self.open.append(ids)
        self.n_open += len(ids)
        if self.n_open >= 64 * BLOCK_IDS:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.open) if self.open else np.zeros(0, dtype="<u4")
        whole = len(ids) if last else len(ids) - len(ids) % BLOCK_IDS
        base = len(self.payload)
        self.payload += pack(ids[:whole], self.width)
        size = BLOCK_IDS * self.width // 8
        self.offsets += [min(base + k * size, len(self.payload)) for k in range(1, -(-whole // BLOCK_IDS) + 1)]
        self.open, self.n_open = [ids[whole:]], len(ids) - whole

    def bytes(self) -> bytes:
        self._blocks(True)
        head = HEADER.pack(MAGIC, self.width, BLOCK_IDS, len(self.docs), self.starts[-1], len(self.offsets) - 1)
        return b"".join([head, np.array(self.docs, "<i8").tobytes(), np.array(self.present, "u1").tobytes(),
                         np.array(self.starts, "<u8").tobytes(), np.array(self.offsets, "<u8").tobytes(),
                         bytes(self.payload)])


class FileReader:
    """Random access to one file; ``file`` has ``read_at(size, offset)``."""

    def __init__(self, file):
        self.file = file
        magic, self.width, self.block, self.docs, self.ids, self.blocks = HEADER.unpack(
            file.read_at(HEADER.size, 0))
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEADER.size
        self.at_docs, self.at_present = at, at + 8 * self.docs
        self.at_starts = self.at_present + self.docs
        self.at_offsets = self.at_starts + 8 * (self.docs + 1)
        self.at_payload = self.at_offsets + 8 * (self.blocks + 1)

    def _numbers(self, at: int, first: int, n: int, kind: str) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.frombuffer(self.file.read_at(n * size, at + first * size), dtype=kind)

    def index(self, first: int, n: int):
        """Doc ids, their presence, and the first ids of documents ``first .. first + n``."""
        return (self._numbers(self.at_docs, first, n, "<i8"), self._numbers(self.at_present, first, n, "u1"),
                self._numbers(self.at_starts, first, n + 1, "<u8").astype(np.int64))

    def range(self, start: int, end: int) -> np.ndarray:
        """Ids ``start .. end`` of the file."""
        if end <= start:
            return np.zeros(0, dtype="<u4")
        first, last = start // self.block, -(-end // self.block)
        offsets = self._numbers(self.at_offsets, first, last - first + 1, "<u8").astype(np.int64)
        data = self.file.read_at(int(offsets[-1] - offsets[0]), self.at_payload + int(offsets[0]))
        return unpack(data, min(last * self.block, self.ids) - first * self.block, self.width)[
            start - first * self.block: end - first * self.block]


def _open_fs(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int | None = 1,
                      id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``docs`` and write the files; the manifest: file, docs, ids, start (first id overall), one row a file."""
    key = F.col(id_col)
    order = ["doc", "tie", "row"]  # the last one takes rows of one id and text apart
    rows = (docs.select(key.alias("doc"), F.col(text_col).alias("body"))
            .withColumn("tie", F.xxhash64("body")).withColumn("row", F.monotonically_increasing_id())
            .repartitionByRange(*order).sortWithinPartitions(*order))
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def write(batches):
        enc = encoder(WordBpe, path)
        width = max(1, int(max(enc.vocabulary - 1, end_id or 0)).bit_length())
        store, root = _open_fs(folder)
        part, files, out = TaskContext.get().partitionId(), 0, FileWriter(width)

        def close():
            nonlocal files, out
            name = f"{root}/{part:06d}-{files:05d}-{uuid.uuid4().hex}.ids"
            with store.open_output_stream(name) as f:
                f.write(out.bytes())
            row = pa.RecordBatch.from_pydict(
                {"part": [part], "seq": [files], "file": [name], "docs": [len(out.docs)], "ids": [out.starts[-1]]},
                schema=pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("file", pa.string()),
                                  ("docs", pa.int64()), ("ids", pa.int64())]))
            files, out = files + 1, FileWriter(width)
            return row

        store.create_dir(root, recursive=True)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                out.add(doc, np.frombuffer(enc.encode(text) + end, dtype="<u4"))
                if out.starts[-1] >= file_ids:
                    yield close()
        if out.docs:
            yield close()

    manifest = materialise(rows.mapInArrow(
        write, "part long, seq long, file string, docs long, ids long"), "manifest")
    return running_total(manifest, [], ["part", "seq"], "ids", "end").select(
        "file", "docs", "ids", (F.col("end") - F.col("ids")).alias("start"))


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32 bytes)."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("docs") - 1, F.lit(READ_DOCS).cast("long")))
    tasks = manifest.where("docs > 0").select("file", at.alias("first"), "docs", "start").select(
        "file", "first", F.least(F.lit(READ_DOCS), F.col("docs") - F.col("first")).alias("n"), "start")
    # the rows are small and the work behind them is not, so their number of partitions is given
    tasks = tasks.repartition(max(1, min(tasks.count(), 4 * spark.sparkContext.defaultParallelism)))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def load(batches):
        store, _ = _open_fs(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with store.open_input_file(r["file"]) as f:
                    reader = FileReader(f)
                    doc, present, starts = reader.index(r["first"], r["n"])
                    ids = reader.range(int(starts[0]), int(starts[-1])).tobytes()
                at = (starts - starts[0]) * 4
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc, mask=present == 0), pa.array(starts[:-1] + r["start"]),
                    pa.array(np.diff(starts)), binary([ids[a:b] for a, b in zip(at, at[1:])])], schema=schema)

    return tasks.mapInArrow(load, "doc_id long, start long, n_tokens long, ids binary")


@query("op8_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all ``documents``, written and read back: per document its place and checksum."""
    folder = shared_path(spark, "token-files")
    manifest = write_token_files(read(spark, sf_dir, "documents", "doc_id", "text"), folder,
                                 default_path("word_bpe_49k.json"))
    return read_token_files(spark, folder, manifest).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
