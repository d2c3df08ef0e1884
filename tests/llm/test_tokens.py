"""Packing, piece encoding and token files against the libraries and exact round trips."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from themelens.llm.common import default_path
from themelens.llm.packing import (BUCKETS, cut_pieces, exact_patterns, fill_patterns, fit_repeats, pack_documents,
                                   pack_rest, packed_sequences, plan_sequences, share_of)
from themelens.llm.pieces import MergePieces, encode_pieces
from themelens.llm.subwords import ByteBpe, WordBpe
from themelens.llm.token_files import FileReader, FileWriter, pack, read_token_files, unpack, write_token_files
from themelens.llm.common import shared_path

from .cases import ROWS, by_row, documents, empty, frame, pairs

ALPHABET = "abcdefgh ABC  \n\t.,'!?0123éüßñ漢字한𐍈́\x00\x01\x1c\x85 ​﻿▁<|>"


def random_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(80))) for _ in range(n)]


def decoded(data):
    return np.frombuffer(data, dtype="<u4").tolist()


@pytest.mark.parametrize("kind,name", [(ByteBpe, "byte_bpe_50k.json"), (WordBpe, "word_bpe_49k.json")])
def test_encoders_equal_the_library(kind, name, spark, small_dir):
    from tokenizers import Tokenizer
    own, library = kind(default_path(name)), Tokenizer.from_file(default_path(name))
    texts = random_texts(1500, 1) + [t or "" for _, t in ROWS] + [t for _, t in pairs(documents(spark, small_dir))]
    for text in texts:
        assert decoded(own.encode(text)) == library.encode(text, add_special_tokens=False).ids, text[:80]


def test_pieces_equal_the_library(spark, small_dir):
    import sentencepiece
    path = default_path("piece_bpe_32k.model")
    own, library = MergePieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    runs = [a + " " * n + b for n in (*range(1, 70), 300) for a, b in (("", ""), ("", "a"), ("x", "\n"), ("é", "漢 "))]
    texts = random_texts(1500, 2) + runs + [t or "" for _, t in ROWS] + [t for _, t in pairs(documents(spark, small_dir))]
    for text in texts:
        ids = decoded(own.encode(text))
        assert ids == library.encode(text), text[:80]
        assert own.decode(ids) == library.decode(ids), text[:80]


def test_pieces_of_odd_rows(spark):
    import sentencepiece
    path = default_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    found = by_row(encode_pieces(frame(spark), path), "doc_id", "ids", "decoded")
    assert found == sorted(((d, library.encode(t or ""), library.decode(library.encode(t or ""))) for d, t in ROWS), key=repr)
    assert encode_pieces(empty(spark), path).count() == 0


@pytest.mark.parametrize("width", [1, 3, 7, 8, 13, 16, 17, 24, 31])
def test_bit_packing_round_trip(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 7, 8, 9, 4096, 5001):
        ids = rng.integers(0, 1 << width, n, dtype=np.uint32)
        data = pack(ids, width)
        assert len(data) == -(-n * width // 8)
        assert (unpack(data, n, width) == ids).all()


def test_file_random_access():
    import io
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 49_408, n, dtype=np.uint32) for n in (3, 0, 5000, 1, 300_000, 4096, 17)]
    writer = FileWriter(16)
    for k, ids in enumerate(docs):
        writer.add(None if k == 3 else k, ids)
    data = io.BytesIO(writer.bytes())

    class At:
        def read_at(self, size, offset):
            data.seek(offset)
            return data.read(size)

    reader = FileReader(At())
    doc, present, starts = reader.index(0, len(docs))
    assert present.tolist() == [1, 1, 1, 0, 1, 1, 1] and doc.tolist() == [0, 1, 2, 0, 4, 5, 6]
    flat = np.concatenate(docs)
    for a, b in ((0, len(flat)), (4095, 4097), (5000, 5003), (len(flat) - 5, len(flat)), (9, 9)):
        assert (reader.range(a, b) == flat[a:b]).all()


def test_token_files(spark, small_dir):
    from tokenizers import Tokenizer
    path = default_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for docs in (frame(spark), documents(spark, small_dir)):
        folder = shared_path(spark, "files")
        manifest = write_token_files(docs, folder, path, file_ids=20_000)
        assert manifest.count() > 1
        found = read_token_files(spark, folder, manifest).orderBy("start").collect()
        expected = defaultdict(list)
        for d, t in pairs(docs):
            expected[d].append([*library.encode(t or "", add_special_tokens=False).ids, 1])
        start = 0
        for r in found:
            assert r.start == start and r.n_tokens == len(r.ids) // 4
            expected[r.doc_id].remove(decoded(r.ids))
            start += r.n_tokens
        assert not any(expected.values())
        ids = [r.doc_id for r in found]
        assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    folder = shared_path(spark, "files")
    manifest = write_token_files(empty(spark), folder, path)
    assert manifest.count() == 0 and read_token_files(spark, folder, manifest).count() == 0


def test_token_files_of_equal_rows(spark):
    """Equal rows are dealt to many files and all come back; the work list is a plan, not a list of the driver's."""
    folder = shared_path(spark, "files")
    docs = spark.range(50_000).selectExpr("cast(null as long) AS doc_id", "cast(null as string) AS text")
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")  # rows as small as these would be put together again
    try:
        manifest = write_token_files(docs, folder, default_path("word_bpe_49k.json"))
        files = manifest.orderBy("start").collect()
    finally:
        spark.conf.unset(merging)
    assert len(files) > 4 and max(f.docs for f in files) < 25_000
    assert [f.start for f in files] == [sum(g.ids for g in files[:k]) for k in range(len(files))]
    found = read_token_files(spark, folder, manifest)
    starts = sorted(r.start for r in found.select("start").collect())
    assert starts == list(range(50_000)) and found.where("doc_id IS NULL AND n_tokens = 1").count() == 50_000


def test_the_fit_beats_best_fit():
    """Where best fit decreasing is poor, the fitted patterns take fewer sequences, alone and in the plan."""
    for low, high, n in ((250, 500, 4000), (100, 700, 20_000)):
        counts = Counter(np.random.default_rng(0).integers(low, high, n).tolist())
        histogram = np.zeros(1025)
        histogram[list(counts)] = list(counts.values())
        patterns = exact_patterns(np.array(sorted(counts)), 1024)
        fitted = sorted(fit_repeats(histogram, patterns).items(), key=lambda kv: (-kv[1], kv[0]))
        fit, half, plain = (sum(m for _, m in fill_patterns(dict(counts), patterns, fitted, share, 1024))
                            for share in (1.0, 0.5, 0.0))
        assert fit < plain and half < plain
        assert sum(m for _, m in plan_sequences(counts, 1024)) <= min(fit, half)


def test_packing_of_equal_rows(spark):
    """Equal rows fall into all shares of their length, and fill sequences without gaps."""
    docs = spark.range(20_000).selectExpr("cast(null as long) AS doc_id", "'one and the same text' AS text")
    pieces, placed = pack_documents(docs, default_path("byte_bpe_50k.json"), size=64)
    shares = [r["count"] for r in pieces.groupBy(share_of("piece_id")).count().collect()]
    assert len(shares) == BUCKETS and max(shares) < 3 * 20_000 / BUCKETS
    length = pieces.first().length
    per = 64 // length
    found = placed.groupBy("sequence_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("offset")).alias("at")).collect()
    assert len(found) == -(-20_000 // per) and all(list(r["at"]) == [length * k for k in range(r["n"])] for r in found)


def test_patterns_and_fit():
    lengths = np.array([2, 3, 4, 5, 6, 8])
    found = {tuple(sorted(v for v in p if v)) for p in exact_patterns(lengths, 10).tolist()}
    expected = {(2, 8), (4, 6), (5, 5), (2, 2, 6), (2, 3, 5), (2, 4, 4), (3, 3, 4)}
    assert found == expected
    histogram = np.zeros(11)
    histogram[[2, 8, 4, 6]] = [7, 7, 5, 5]
    repeats = fit_repeats(histogram, exact_patterns(lengths, 10))
    left = histogram.copy()
    for k, n in repeats.items():
        assert n > 0
        for v in exact_patterns(lengths, 10)[k]:
            if v:
                left[v] -= n
    assert np.abs(left).max() < 0.3


def test_plan_uses_every_length_once():
    r = random.Random(4)
    for size in (64, 128):
        for _ in range(20):
            counts = {r.randrange(1, size + 1): r.randrange(1, 400) for _ in range(size // 2)}
            recipes = plan_sequences(counts, size)
            used = defaultdict(int)
            for lengths, n in recipes:
                assert sum(lengths) <= size and n > 0
                for v in lengths:
                    used[v] += n
            assert used == counts
            sequences, least = sum(n for _, n in recipes), -(-sum(k * n for k, n in counts.items()) // size)
            first_fit = sum(n for _, n in pack_rest(counts, size))
            assert least <= sequences <= first_fit * 1.03 + 3


def test_plan_is_no_worse_than_best_fit():
    r = random.Random(4)
    for size in (16, 64, 128):
        for k in range(60):
            counts = {r.randrange(1, size + 1): r.randrange(1, 4 if k % 2 else 400) for _ in range(size // 2)}
            assert sum(n for _, n in plan_sequences(counts, size)) <= sum(n for _, n in pack_rest(counts, size))


def test_sequences_of_repeated_and_null_ids(spark):
    path, size = default_path("byte_bpe_50k.json"), 16
    texts = ["one two three", "four five", "six " * 40, "seven " * 21, "one two three"]
    rows = [(d, t) for d in (1, None, 2) for t in texts]
    pieces, placed = pack_documents(frame(spark, rows), path, size=size)
    whole = packed_sequences(pieces, placed).collect()
    assert all(r.n_tokens <= size and len(r.ids) == 4 * r.n_tokens for r in whole)
    cut = [bytes(r.ids) for r in pieces.collect()]
    of_piece = {r.piece_id: bytes(r.ids) for r in pieces.collect()}
    sequences = defaultdict(list)
    for r in placed.collect():
        sequences[r.sequence_id].append((r.offset, of_piece[r.piece_id]))
    assert {r.sequence_id: bytes(r.ids) for r in whole} == {k: b"".join(x for _, x in sorted(v)) for k, v in sequences.items()}
    assert sum(len(r.ids) for r in whole) == sum(map(len, cut))


def test_packing(spark, small_dir):
    from tokenizers import Tokenizer
    path = default_path("byte_bpe_50k.json")
    library, size = Tokenizer.from_file(path), 128
    for docs in (frame(spark), documents(spark, small_dir)):
        pieces, placed = pack_documents(docs, path, size=size)
        rows = placed.collect()
        taken, covered = defaultdict(list), defaultdict(list)
        for r in rows:
            taken[r.sequence_id].append((r.offset, r.length))
            covered[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        for spans in taken.values():  # gapless, and no longer than a sequence
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= size
        expected = defaultdict(list)
        for d, t in pairs(docs):
            ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
            first = len(ids) % size or size
            edges = [0, *range(first, len(ids) + 1, size)]
            expected[d] += [(p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(edges, edges[1:]))]
        assert {d: sorted(v) for d, v in covered.items()} == {d: sorted(v) for d, v in expected.items()}
        total = sum(r.length for r in rows)
        assert len(taken) <= 1.05 * -(-total // size) + 2
    named = frame(spark, [(d, t) for d, t in ROWS if d in (1, 3, 4, 6)])
    pieces, placed = pack_documents(named, path, size=size)
    whole = packed_sequences(pieces, placed)
    assert whole.where(F.octet_length("ids") != 4 * F.col("n_tokens")).count() == 0
    assert whole.agg(F.sum("n_tokens")).first()[0] == pieces.agg(F.sum("length")).first()[0]
    assert cut_pieces(empty(spark), path, 2, size).count() == 0
    assert pack_documents(empty(spark), path)[1].count() == 0
