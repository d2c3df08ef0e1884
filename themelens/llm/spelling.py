"""Spelling variants: Bloom-guided neighbourhoods of one edit, then an exact vocabulary join.

The words of a corpus and their counts form the vocabulary.  Its words are put into blocked Bloom
filters, one or more for each word length ("length-sharded"), which are broadcast.  Every word then
generates its edits: all deletions, probed in the filter of the length below, and all replacements
by a later letter of the alphabet, probed in the filter of its own length; each pair of near words
is generated once, from one of its sides.  Hashes of edits follow from the word's own hash without
building the edited strings.  Only edits that a filter lets pass become rows, and a join with the
vocabulary removes those that are no words.  A word's form is its most frequent near word, if that is
``factor`` times as frequent; forms lead to roots by pointer jumping.

Sizes: a filter takes 16 bits a word in segments of at most ``SEGMENT`` words.  A round broadcasts
at most ``FILTER_BYTES`` of them, whatever the vocabulary, and a larger vocabulary takes more rounds,
each of which probes all words against its segments.  A form is ``factor`` times as frequent as its
word, so the chains have at most log_factor(largest count) steps, and twice as many a round are jumped.

Defined results: null, empty and blank texts have no runs; a null id counts as the empty string before the
colon; repeated rows count as often as they stand; a run of any length is taken whole; ties between forms go
to the smaller word in code-point order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, query, read

#: Letters of a run, after A-Z are lower-cased; all of them are one byte in Latin-1.
LETTERS = r"a-zÀ-ÿ"
#: 64-bit words of a block, blocks of a whole segment, and words in a segment (16 bits each).
LANES, SEGMENT_BLOCKS = 8, 1024
SEGMENT = SEGMENT_BLOCKS * LANES * 64 // 16
#: Bytes of filters that one round broadcasts, at most.
FILTER_BYTES = 32 << 20
#: Letters of words whose edits are generated at a time, about.
CHUNK = 1 << 16
#: Words in a task, about.
TASK_WORDS = 50_000


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
INVERSE = np.uint64(pow(BASE, -1, 1 << 64))
CODES = mix(np.arange(1, 257, dtype=np.uint64))


def powers(n: int) -> np.ndarray:
    """BASE ** i for i below ``n``, modulo 2 ** 64."""
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), BASE, dtype=np.uint64))])[:n]


def terms(codes: np.ndarray) -> np.ndarray:
    """Summands of the hash of every word (rows of ``codes``): code of the letter times the power of its place."""
    return CODES[codes] * powers(codes.shape[1])


class Filters:
    """The segments of one round; ``layout`` has (segments, blocks of each) by word length."""

    def __init__(self, layout: dict, parts: list):
        self.layout, self.first, at = layout, {}, 0
        for length, segment, bits in parts:
            if length not in self.first:
                self.first[length] = np.full(layout[length][0], -1, dtype=np.int64)
            self.first[length][segment] = at
            at += len(bits) // 8
        self.bits = np.frombuffer(b"".join(p[2] for p in parts), dtype=np.uint64)

    def probe(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Places of those of ``hashes`` (of edits of ``length`` letters) that a segment of this round lets pass."""
        segment, block, marks = place(hashes, *self.layout[length])
        at = self.first[length][segment]
        left = np.flatnonzero(at >= 0)
        at = at[left] + block[left] * LANES
        for lane in range(LANES):
            bit = (marks[left] >> np.uint64(6 * lane)) & np.uint64(63)
            good = (self.bits[at + lane] >> bit) & np.uint64(1) == 1
            left, at = left[good], at[good]
        return left


def place(hashes: np.ndarray, segments: int, blocks: int):
    """Segment, block and the marks of the lanes (6 bits each) of every hash."""
    h = mix(hashes)
    segment = ((h >> np.uint64(32)) % np.uint64(segments)).astype(np.int64)
    block = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(blocks)).astype(np.int64)
    return segment, block, mix(h ^ CODES[0])


def build_segment(hashes: np.ndarray, segments: int, blocks: int) -> bytes:
    """Bits of a segment that holds ``hashes``."""
    bits = np.zeros(blocks * LANES, dtype=np.uint64)
    _, block, marks = place(hashes, segments, blocks)
    for lane in range(LANES):
        np.bitwise_or.at(bits, block * LANES + lane, np.uint64(1) << ((marks >> np.uint64(6 * lane)) & np.uint64(63)))
    return bits.tobytes()


def edits(words: list[bytes], filters: Filters, alphabet: bytes):
    """(number of the word, edited word) of the deletions and replacements that ``filters`` let pass."""
    length = len(words[0])
    codes = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(-1, length)
    parts = terms(codes)
    whole = parts.sum(axis=1, dtype=np.uint64)
    if length - 1 in filters.first:
        before = np.cumsum(parts, axis=1, dtype=np.uint64) - parts
        without = before + (whole[:, None] - before - parts) * INVERSE
        new = np.ones(codes.shape, dtype=bool)  # of equal neighbours only the first is deleted
        new[:, 1:] = codes[:, 1:] != codes[:, :-1]
        row, at = np.nonzero(new)
        hit = filters.probe(length - 1, without[row, at])
        for r, p in zip(row[hit].tolist(), at[hit].tolist()):
            yield r, words[r][:p] + words[r][p + 1:]
    if length in filters.first:
        power = powers(length)
        for letter in alphabet:
            row, at = np.nonzero(codes < letter)
            hit = filters.probe(length, whole[row] - parts[row, at] + CODES[letter] * power[at])
            one = bytes([letter])
            for r, p in zip(row[hit].tolist(), at[hit].tolist()):
                yield r, words[r][:p] + one + words[r][p + 1:]


def grouped(batches):
    """(word, n) of ``batches`` as lists of words of one length, about ``CHUNK`` letters together."""
    waiting = {}
    for batch in batches:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            word = word.encode("latin-1")
            group = waiting.setdefault(len(word), [])
            group.append((word, n))
            if len(group) * len(word) >= CHUNK:
                yield waiting.pop(len(word))
    yield from waiting.values()


def vocabulary(docs: DataFrame, min_length: int, min_count: int, drop_one_in: int | None) -> DataFrame:
    """word and n of ``docs`` (doc_id, text); with ``drop_one_in``, of the runs thinned by their hash."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    word = F.col("word")
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(lower, F.lit(f"([{LETTERS}]{{{min_length},}})"), F.lit(1))).alias("word"))
    if drop_one_in:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
        found = found.select("word", h.alias("h")).withColumn("at", (F.col("h") % F.length("word")).cast("int"))
        cut = F.concat(F.substring(word, F.lit(1), F.col("at")), F.substring(word, F.col("at") + 2, F.length("word")))
        found = found.select(F.when(F.col("h") % drop_one_in == 0, cut).otherwise(word).alias("word"))
    return found.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def filter_segments(words: DataFrame, layout: dict) -> DataFrame:
    """(length, segment, bits) of the vocabulary's Bloom filters."""

    def number(batches):
        for group in grouped(batches):
            length = len(group[0][0])
            codes = np.frombuffer(b"".join(w for w, _ in group), dtype=np.uint8).reshape(-1, length)
            hashes = terms(codes).sum(axis=1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(group), length, np.int32)), pa.array(place(hashes, *layout[length])[0].astype(np.int32)),
                 pa.array(hashes.view(np.int64))], names=["length", "segment", "hash"])

    def build(table):
        length, segment = table.column("length")[0], table.column("segment")[0]
        bits = build_segment(table.column("hash").to_numpy().view(np.uint64), *layout[length.as_py()])
        return pa.table([pa.array([length.as_py()], pa.int32()), pa.array([segment.as_py()], pa.int32()), pa.array([bits], pa.binary())],
                        names=["length", "segment", "bits"])

    hashed = words.select("word", "n").mapInArrow(number, "length int, segment int, hash long")
    return hashed.groupBy("length", "segment").applyInArrow(build, "length int, segment int, bits binary")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every two words of ``words`` (word, n) one edit apart, in one direction."""
    spark = words.sparkSession
    sizes = {r.length: r.m for r in words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("m")).collect()}
    layout = {}
    for length, m in sizes.items():
        segments = -(-m // SEGMENT)
        layout[length] = (segments, -(-m * 16 // (LANES * 64 * segments)))
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct()  # at most 90 letters
    alphabet = "".join(sorted(r.c for r in letters.collect() if r.c)).encode("latin-1")
    segments = materialise(filter_segments(words, layout), "segments")
    rounds, room = [[]], FILTER_BYTES
    for length in sorted(layout):
        for k in range(layout[length][0]):
            size = layout[length][1] * LANES * 8
            if size > room:
                rounds.append([])
                room = FILTER_BYTES
            rounds[-1].append((length, k))
            room -= size
    out = None
    for part in rounds:
        if not part:
            continue
        low, high = part[0], part[-1]
        place_of = F.struct("length", "segment")
        taken = segments.where((place_of >= F.struct(F.lit(low[0]).alias("length"), F.lit(low[1]).alias("segment")))
                               & (place_of <= F.struct(F.lit(high[0]).alias("length"), F.lit(high[1]).alias("segment"))))
        shared = spark.sparkContext.broadcast(Filters(layout, [(r.length, r.segment, bytes(r.bits)) for r in taken.collect()]))

        def probe(batches, shared=shared):
            for group in grouped(batches):
                rows, near = [], []
                for k, edit in edits([w for w, _ in group], shared.value, alphabet):
                    rows.append(k)
                    near.append(edit.decode("latin-1"))
                    if len(near) >= CHUNK:
                        yield batch_of(group, rows, near)
                        rows, near = [], []
                if near:
                    yield batch_of(group, rows, near)

        def batch_of(group, rows, near):
            return pa.RecordBatch.from_arrays(
                [pa.array([group[k][0].decode("latin-1") for k in rows], pa.string()),
                 pa.array([group[k][1] for k in rows], pa.int64()), pa.array(near, pa.string())], names=["word", "n", "near"])

        positives = words.select("word", "n").mapInArrow(probe, "word string, n long, near string")
        pairs = positives.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
        pairs = materialise(pairs.select("word", "n", "near", "near_n"), "pairs")
        out = pairs if out is None else out.union(pairs)
    return out


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) of ``forms`` (word, form), whose chains have at most ``steps`` steps."""
    jump = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(steps, 1)))):
        then = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jump = materialise(jump.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return jump


def spelling_variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, factor: int = 10,
                      drop_one_in: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    words = materialise(vocabulary(docs, min_length, min_count, drop_one_in), "counted")
    size, most = words.agg(F.count("*"), F.max("n")).first()
    words = materialise(words.repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_WORDS)), "word"),
                        "vocabulary")
    empty = words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).where("false")
    pairs = near_pairs(words) if size else empty
    both = pairs.union(pairs.select("near", "near_n", "word", "n"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    near = materialise(near, "near")
    found = words.join(near, "word", "left")
    best_n = -F.col("best.minus")
    is_form = best_n >= F.col("n") * factor
    found = materialise(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, best_n).alias("form_n")), "forms")
    steps = max(1, math.floor(math.log((most or 1) / min_count, factor) + 1e-9)) if most and most > min_count else 1
    ends = roots(found.where("form is not null").select("word", "form"), steps)
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents``, one run in 31 thinned by a letter, with their near words, forms and roots."""
    return spelling_variants(read(spark, sf_dir, "documents", "doc_id", "text"), drop_one_in=31)
