"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

Distinct fingerprints are laid out in tiles.  The population counts of ``BLOCKS`` equal
parts of a fingerprint name its tile; two fingerprints differ in at least as many bits as
the sum of the differences of their parts' counts, so a tile meets only the tiles within
the radius and all other tile pairs are skipped without loss.  A tile of more than
``TILE`` fingerprints is split by hash and its parts meet pairwise.  The tiles that meet
are compared in full with numpy exclusive-or and bit counts; of the links found in a
pair of tiles only a spanning forest leaves the task, so a dense group does not give all
its pairs.  Components follow by label propagation over the fingerprints.

Defined results: a null or empty text, or one without words, has fingerprint zero and
links like any other; a null document id takes no part in the smallest id of its
component, and is null there if no other row has one; repeated rows share a component;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, query, read, texts
from .components import connected_components

BITS = 64
#: Parts of a fingerprint whose population counts name its tile.
BLOCKS = 4
#: Fingerprints in a tile part, about.
TILE = 4096
#: Rows of a tile that are compared at a time (bounds memory to ROWS * TILE numbers).
ROWS = 256
HASH_SEED = 42


def fingerprint(text: str, words: int) -> int:
    """Fingerprint of one text: a bit is set where over half of the shingles' hashes have it."""
    from xxhash import xxh64_intdigest as xxh

    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: only A-Z and ASCII white space
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    spans = zip(starts[:n].tolist(), (ends[words - 1:] if len(tokens) >= words else ends[-1:]).tolist())
    hashes = np.array([xxh(joined[a:b], HASH_SEED) for a, b in spans], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def sign(batches):
        for batch in batches:
            values = np.array([fingerprint(t, words) for t in texts(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return source.mapInArrow(sign, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def tile_links(a: np.ndarray, b: np.ndarray, max_bits: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links between two arrays of fingerprints (``same``: one array with itself)."""
    left, right = [], []
    for k in range(0, len(a), ROWS):
        near = np.bitwise_count(a[k:k + ROWS, None] ^ b[None, :]) <= max_bits
        i, j = np.nonzero(near)
        i = i + k
        if same:
            i, j = i[i < j], j[i < j]
        left.append(i)
        right.append(j)
    i, j = np.concatenate(left), np.concatenate(right)
    if not len(i):
        return a[:0], b[:0]
    j = j if same else j + len(a)
    nodes = a if same else np.concatenate([a, b])
    label = np.arange(len(nodes))
    while True:  # least index of each local component
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[moved]], nodes[moved]


def fingerprint_links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) that connect all of ``distinct`` (column fp) within ``max_bits`` of each other."""
    part = BITS // BLOCKS
    mask = (1 << part) - 1
    counts = [F.bit_count(F.shiftrightunsigned("fp", k * part).bitwiseAND(F.lit(mask).cast("long"))) for k in range(BLOCKS)]
    tiled = distinct.select("fp", sum((c.cast("int") * 32 ** k for k, c in enumerate(counts)), F.lit(0)).alias("tile"))
    # at most 17 ** BLOCKS tiles: a proven bound for the broadcast
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    packed = materialise(
        tiled.join(F.broadcast(sizes), "tile")
        .groupBy("tile", F.pmod(F.xxhash64("fp"), "parts").cast("int").alias("part"))
        .agg(F.collect_list("fp").alias("fps")), "tiles")
    steps = [d for d in product(range(-max_bits, max_bits + 1), repeat=BLOCKS)
             if sum(map(abs, d)) <= max_bits and d[::-1] >= (0,) * BLOCKS]
    codes = F.array(*[F.lit(sum(v * 32 ** k for k, v in enumerate(d))) for d in steps])
    left = packed.select(F.col("tile").alias("from"), F.col("part").alias("from_part"), F.col("fps").alias("a"),
                         F.explode(codes).alias("step")).withColumn("tile", F.col("from") + F.col("step"))
    met = left.join(packed, "tile").where((F.col("step") != 0) | (F.col("from_part") <= F.col("part"))).select(
        "a", F.col("fps").alias("b"), ((F.col("step") == 0) & (F.col("from_part") == F.col("part"))).alias("same"))

    def compare(batches):
        for batch in batches:
            pairs = []
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].values.to_numpy().view(np.uint64) for c in (0, 1))
                same = batch.column(2)[k].as_py()
                links = tile_links(a, b, max_bits, same)
                if len(links[0]):
                    pairs.append(links)
            if pairs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([p[k] for p in pairs]).view(np.int64)) for k in (0, 1)], names=["a", "b"])

    return met.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed long), fingerprint (hex) and component_id of every row of ``docs``."""
    signed = materialise(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = materialise(signed.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    links = materialise(fingerprint_links(distinct, max_bits), "near")
    labels = connected_components(links)
    linked = materialise(labels.join(distinct, labels.node == distinct.fp).select("fp", "label", "first"), "linked")
    smallest = materialise(linked.groupBy("label").agg(F.min("first").alias("smallest")), "smallest")
    of_fp = linked.select("fp", "label").join(smallest, "label").select("fp", F.col("smallest").alias("component_id"))
    lone = distinct.join(labels, distinct.fp == labels.node, "left_anti").select("fp", F.col("first").alias("component_id"))
    component = materialise(of_fp.union(lone), "components")
    return signed.join(component, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op1_simhash_near_duplicates")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, 3-word shingles, at most 3 bits apart."""
    found = near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), words=3, max_bits=3)
    return found.select("doc_id", "fingerprint", "component_id")
