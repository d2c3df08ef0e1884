"""Large CSV files with quoted line breaks, and large JSON arrays, read by many tasks a file.

A task that starts in the middle of a file does not know whether it is inside a quoted field, a string or
a record.  So a file is read twice, both times by byte ranges (the blocks of Spark's text source):

1. Every block sums up what it does to that state: for CSV the parity of its quotes; for JSON the change of the
   string state and of the bracket depth, for either state that it may begin in.  A prefix scan over the blocks, one
   row each, gives the state at the start of every block.
2. Every block cuts its text into records with that state.  A record that lies in one block is whole; the pieces of one
   that reaches over blocks meet in a group of their own.

CSV is cut at line feeds outside quotes, so quotes must follow RFC 4180 (a quote within a field is doubled and the
field quoted; else the parity means nothing, and the parse fails).  JSON is cut at closing braces, so an array on a single line is
read in parallel as well as an indented one; elements must be objects.  The driver holds one row a block (a block
has ``spark.sql.files.maxPartitionBytes``, 128 MB by default).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

SCHEMA = "file string, block long, kind string, first boolean, text string"
#: Pieces of a record that reaches over blocks, in the order in which they stand in a block.
HEAD, MIDDLE, TAIL, WHOLE = "0head", "1middle", "2tail", "whole"


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.option("lineSep", separator).text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.col("value").alias("piece"))


def _by_block(batches):
    """(file, block, pieces) of consecutive rows of one block; a block may come in several runs."""
    for batch in batches:
        files, blocks, pieces = (c.to_pylist() for c in batch.columns)
        start = 0
        for k in range(1, len(pieces) + 1):
            if k == len(pieces) or blocks[k] != blocks[start] or files[k] != files[start]:
                yield files[start], blocks[start], pieces[start:k]
                start = k


def _rows(columns, names):
    return pa.RecordBatch.from_arrays(columns, names=names)


def csv_effect(line: str) -> tuple[int, int, int]:
    """(parity of the quotes, 0, 0)."""
    return line.count('"') & 1, 0, 0


def json_effect(piece: str) -> tuple[int, int, int]:
    """(parity of the quotes that aren't escaped, change of depth from outside strings, change of depth from inside)."""
    parts = piece.replace("\\\\", "").replace('\\"', "").split('"')
    depth = [sum(s.count("{") + s.count("[") - s.count("}") - s.count("]") for s in parts[k::2]) for k in (0, 1)]
    return (len(parts) - 1) & 1, depth[0], depth[1]


def _then(first, second):
    """Effect of ``first`` and then ``second``: the string state after the first decides which depth counts."""
    p, a, b = first
    q, c, d = second
    return p ^ q, a + (d if p else c), b + (c if p else d)


def _states(pieces: DataFrame, effect, ending: str) -> dict:
    """(file, block) -> (inside, depth, whether it is the file's last block), at the start of every block."""

    def total(batches):
        sums = {}
        for file, block, texts in _by_block(batches):
            now = sums.get((file, block), (0, 0, 0))
            for t in texts:
                now = _then(now, effect(t + ending))
            sums[file, block] = now
        keys = list(sums)
        yield _rows([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
                     *[pa.array([sums[k][n] for k in keys], pa.int64()) for n in range(3)]], ["file", "block", "p", "a", "b"])

    found, state, last = {}, {}, {}
    summed = pieces.mapInArrow(total, "file string, block long, p long, a long, b long")
    for r in sorted(summed.collect(), key=lambda r: (r.file, r.block)):  # one row a block
        inside, depth = state.get(r.file, (0, 0))
        found[r.file, r.block] = (inside, depth)
        state[r.file] = (inside ^ r.p, depth + (r.b if inside else r.a))
        last[r.file] = r.block
    return {k: (*v, last[k[0]] == k[1]) for k, v in found.items()}


def _cut(pieces: DataFrame, states: dict, cutter) -> DataFrame:
    """(file, block, kind, text): whole records, and the pieces of those that reach over blocks."""
    shared = pieces.sparkSession.sparkContext.broadcast(states)

    def cut(batches):
        current, at = None, None
        for file, block, texts in _by_block(batches):
            if at != (file, block):
                if current is not None:
                    yield _batch(*at, current, current.end())
                at = (file, block)
                if at not in shared.value:
                    raise RuntimeError(f"{file} was split differently in the second pass; don't change split sizes between")
                current = cutter(*shared.value[at])
            yield _batch(*at, current, current.add(texts))
        if current is not None:
            yield _batch(*at, current, current.end())

    return pieces.mapInArrow(cut, SCHEMA)


def _batch(file, block, cutter, found):
    """Records and pieces with the mark of the file's first one."""
    first = [block == 0 and cutter.given == 0 and k == 0 for k in range(len(found))]
    cutter.given += len(found)
    return _rows([pa.array([file] * len(found), pa.string()), pa.array([block] * len(found), pa.int64()),
                  pa.array([k for k, _ in found], pa.string()), pa.array(first, pa.bool_()), pa.array([t for _, t in found], pa.string())],
                 ["file", "block", "kind", "first", "text"])


class _Cutter:
    """Records of one block, from the state at its start; ``joint`` stands between the pieces of a record."""

    joint = ""

    def __init__(self, inside: int, depth: int, last: bool):
        self.inside, self.depth, self.last = inside, depth, last
        self.parts, self.began, self.given = [], not self.open(), 0

    def open(self) -> bool:
        raise NotImplementedError

    def close(self, unfinished: bool = False):
        kind = (TAIL if self.began else MIDDLE) if unfinished else (WHOLE if self.began else HEAD)
        out = (kind, self.joint.join(self.parts))
        self.parts, self.began = [], True
        return out


class CsvCutter(_Cutter):
    joint = "\n"

    def open(self):
        return bool(self.inside)

    def add(self, lines):
        out = []
        for line in lines:
            self.parts.append(line)
            self.inside ^= csv_effect(line)[0]
            if not self.inside:
                out.append(self.close())
        return out

    def end(self):
        return [self.close(unfinished=True)] if self.parts else []


class JsonCutter(_Cutter):
    """The array's own depth is 1; a piece ends before a closing brace, but for the file's last one."""

    def __init__(self, inside, depth, last):
        super().__init__(inside, depth, last)
        self.held = None  # the latest piece: whether it is the file's last one shows at the end

    def open(self):
        return bool(self.inside) or self.depth > 1

    def add(self, pieces):
        out = []
        for piece in pieces:
            if self.held is not None:
                out += self._take(self.held + "}")
            self.held = piece
        return out

    def _take(self, piece):
        self.parts.append(piece)
        parity, outside, within = json_effect(piece)
        self.depth += within if self.inside else outside
        self.inside ^= parity
        return [] if self.open() else [self.close()]

    def end(self):
        out = []
        if self.held is not None:
            if not self.last:
                out = self._take(self.held + "}")
            elif self.held.strip() or self.parts:
                self.parts.append(self.held)
        return out + ([self.close(unfinished=True)] if self.parts else [])


def _stitched(cut: DataFrame, joint: str) -> DataFrame:
    """(file, first, text) of all records, the pieces of those over several blocks put together in their order."""
    cut = written(cut)
    parts = cut.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    number = parts.select("file", "block", "kind").withColumn("record", F.sum((F.col("kind") == TAIL).cast("int")).over(order))  # two rows a block at most
    joined = parts.join(number, ["file", "block", "kind"]).groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("block", "kind", "text"))).alias("parts"), F.max("first").alias("first"))
    return cut.where(F.col("kind") == WHOLE).select("file", "first", "text").union(
        joined.select("file", "first", F.array_join(F.transform("parts", lambda p: p["text"]), joint).alias("text")))


def csv_records(spark: SparkSession, path: str, columns: list[str], options: dict) -> DataFrame:
    """Rows of the CSV file or files at ``path`` by the names ``columns``, all strings; every file's first record is its header."""
    pieces = _pieces(spark, path, "\n")
    states = _states(pieces, csv_effect, "")

    texts = _stitched(_cut(pieces, states, CsvCutter), "\n")
    # as the whole-file reader has it, line ends within fields become line feeds where the file's own lines end in two characters
    pairs = texts.where("first").select("file", F.col("text").endswith("\r").alias("pairs"))
    rows = texts.where("not first").join(pairs, "file").select(
        F.when(F.col("pairs"), F.regexp_replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), r"\r\z", "")).otherwise(F.col("text")).alias("text"))
    rows = rows.where("text <> ''")
    names = [f"c{k}" for k in range(len(columns))]
    parsed = F.from_csv("text", ", ".join(f"{n} string" for n in names), {**options, "mode": "FAILFAST", "header": "false"})
    return rows.select(parsed.alias("row")).select(*[F.col(f"row.{n}").alias(c) for n, c in zip(names, columns)])


def json_records(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of the JSON file or files at ``path``, each an array of objects, as ``schema``."""
    pieces = _pieces(spark, path, "}")
    cut = _cut(pieces, _states(pieces, json_effect, "}"), JsonCutter)
    texts = _stitched(cut, "").select(F.regexp_replace("text", r"\A\x{FEFF}?[\s,\[]*", "").alias("text"))
    rows = texts.where(~F.col("text").rlike(r"\A[\s\]]*\z"))
    parsed = F.from_json("text", schema, {"mode": "FAILFAST"})
    return rows.select(parsed.alias("row")).select("row.*")
