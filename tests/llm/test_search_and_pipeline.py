"""Exact top-k, the SQL oracles, and the pipeline against brute force."""

import os
import random
import re
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from themelens.llm import topk
from themelens.llm.catalogue import ORACLES, QUERIES
from themelens.llm.common import materialise
from themelens.llm.topk import top_k

from .cases import PARAGRAPH, Sets, by_row, empty, frame
from .test_duplicates import plain_fingerprint, plain_lines
from .test_native import plain_base, plain_measures

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain_top(rows, k, every):
    out = []
    usable = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows
              if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    queries = {}
    for i, v in usable:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    for i, q in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i and len(v) == len(q))
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "STEP", 16)
    r = random.Random(8)
    rows = [(i, [r.uniform(-3, 3) for _ in range(6)]) for i in range(300)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.5]) for i in range(300, 360)]  # one very common vector: ties
    rows += [(400, None), (None, [1.0] * 6), (401, []), (450, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (451, [float("nan")] * 6),
             (452, [float("inf")] + [0.0] * 5), (500, [1.0, 2.0]), (501, [2.0, 2.0]), (550, [9.0]), (10, [5.0] * 6), (10, [-5.0] * 6)]
    table = spark.createDataFrame([(*x, "id", "v") for x in rows], "vec_id long, embedding array<float>, id string, v string").repartition(3)
    expected = sorted(plain_top(rows, 7, 10), key=repr)
    for group in (16, 64, 4096):
        found = top_k(table, F.col("id") % 10 == 0, k=7, group=group)
        assert by_row(found, "query_id", "rank", "vec_id", "score") == expected
    assert top_k(table.where("false"), F.col("id") % 10 == 0).count() == 0


def compared(spark, n, group):
    """Share of all pairs of a query and a candidate whose groups meet, on vectors around n / 500 centres."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(n // 500, 16))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    vectors = 200 * centres[np.arange(n) % len(centres)] + r.normal(size=(n, 16))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.round().astype(int).tolist())], "id long, v array<long>")
    search, _ = topk.prepare(materialise(rows, "clustered"), F.col("id") % 50 == 0, 5, group)
    sizes = search.home.where("query_id IS NULL").select(*topk.PLACE, "n")
    assert sizes.agg(F.sum("n")).first()[0] == n and sizes.agg(F.max("n")).first()[0] < 3 * group
    home = search.asked.join(sizes, topk.PLACE).agg(F.sum("n")).first()[0]
    return (home + (search.routes.agg(F.sum("n")).first()[0] or 0)) / (n * -(-n // 50))


def test_top_k_meets_few_groups(spark):
    """Queries go to groups that may hold a better score, and to fewer of all as the table grows."""
    small, large = compared(spark, 10_000, 500), compared(spark, 40_000, 500)
    assert large < small / 2 and large < 0.15


def test_top_k_hot_vector(spark):
    """20,000 rows of one vector, half of them of one id, are dealt to groups of bounded size."""
    rows = spark.range(20_000).select(F.when(F.col("id") < 10_000, F.col("id")).otherwise(50).alias("vec_id"),
                                      F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    vectors = materialise(topk.quantise(rows, 256.0, "vec_id", "embedding"), "hot")
    search, _ = topk.prepare(vectors, F.col("id") == 50, 5, 1000)
    assert search.home.where("query_id IS NULL").agg(F.max("n")).first()[0] < 2000
    found = top_k(rows, F.col("id") == 50, group=1000).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in found) == [(k + 1, k, 5 * 256 ** 2) for k in range(5)]


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"op3_line_dedup"}))
def test_oracles(spark, small_dir, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    found = QUERIES[name](spark, small_dir)
    expected = con.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in found.collect())


def plain_pipeline(rows):
    """(doc_id, text) after the stages before packing."""
    def passes(text):
        n, _, symbols, dup, repeats = plain_measures(text)
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        upper, letters = sum(c.isupper() for c in text or ""), sum(c.isalpha() for c in text or "")
        return not (n < 50 or 100 * repeats > 50 * n or symbols * 10 > n or dup * 2 > len(lines) or upper * 2 > letters
                    or sum(c in "!?" for c in text) * 2 > n)
    rows = [(d, t) for d, t in rows if t is not None and passes(t)]
    distinct, sets = plain_lines(rows)
    number = {line: k for k, line in enumerate(distinct)}
    seen, cut = set(), []
    for d, text in sorted(rows):
        kept = []
        for line in text.encode().split(b"\n"):
            name = sets.root(number[line]) if line in number else None
            if name is None or name not in seen:
                kept.append(line)
            seen.add(name)
        cut.append((d, b"\n".join(kept).decode()))
    fps = [plain_fingerprint(t) for _, t in cut]
    groups = Sets(len(cut))
    for i in range(len(cut)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                groups.join(i, j)
    out = []
    for d, text in (cut[i] for i in range(len(cut)) if groups.root(i) == i):
        at, clean = 0, ""
        for kind, a, b in sorted((s.split(":") for s in plain_base(text)), key=lambda s: (int(s[1]), int(s[2]))):
            if int(a) >= at:
                clean += text[at:int(a)] + f"<{kind.upper()}>"
            at = max(at, int(b))
        out.append((d, clean + text[at:]))
    return out


def pipeline_rows():
    r = random.Random(12)
    word = lambda: "".join(r.choice("bcdfgaeiou") for _ in range(r.randrange(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(12) for _ in range(5)]
    rows = []
    for d in range(40):
        lines = [line(r.randrange(8, 40)) for _ in range(r.randrange(3, 7))] + r.sample(shared, 2)
        if d % 4 == 0:
            lines.append(f"mail {word()}@example.com from 10.0.0.{d} or +1 (555) 555-{2000 + d} end")
        rows.append((d, "\n".join(lines)))
    rows += [(100 + d, rows[d][1]) for d in range(5)]  # copies
    rows += [(200, "too short"), (201, None), (202, ""), (203, "### " * 80), (204, "a b c " * 90), (205, line(60).upper())]
    return rows


def test_pipeline(spark, tmp_path):
    rows = pipeline_rows()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    state = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, str(tmp_path))
        assert state.columns == docs.columns, name
        state.write.parquet(str(tmp_path / name))
        state = spark.read.parquet(str(tmp_path / name))
    assert by_row(state, "doc_id", "text") == sorted(plain_pipeline(rows), key=repr)
    assert state.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, state, str(tmp_path))
    whole = by_row(corpus_pipeline.run(spark, str(tmp_path)), "doc_id", "piece", "start", "length", "ids_crc32")
    assert by_row(packed, "doc_id", "piece", "start", "length", "ids_crc32") == whole
    assert {r[0] for r in whole} == {d for d, _ in plain_pipeline(rows)}


def test_stages_of_odd_rows(spark, small_dir):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), small_dir).count() == 0, name
    docs = frame(spark, [(1, PARAGRAPH), (1, PARAGRAPH), (2, PARAGRAPH), (None, "x"), (None, "x"), (3, None), (4, "")])
    kept = by_row(corpus_pipeline.one_of_each(spark, docs, small_dir), "doc_id", "text")
    assert kept == sorted([(1, PARAGRAPH), (None, "x"), (3, None)], key=repr)


def test_one_of_each_group_of_odd_ids(spark, small_dir):
    """Every group keeps one row, whatever its ids are."""
    r = random.Random(3)
    line = lambda n: " ".join("".join(r.choice("bcdfgaeiou") for _ in range(6)) for _ in range(n))
    a, b, c, d, e = (line(400) for _ in range(5))
    near = lambda text: text.replace(" ", "  ")
    rows = [(1, a), (1, b), (2, near(b)),  # two texts of one id, both heads
            (3, c), (4, near(c)), (4, d),  # id 4: a copy of a smaller id's text and the only row of another group
            (None, e), (None, near(e)), (None, a), (None, near(c))]
    fps = [plain_fingerprint(t) for _, t in rows]
    groups = Sets(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                groups.join(i, j)
    number = {row: groups.root(k) for k, row in enumerate(rows)}
    kept = by_row(corpus_pipeline.one_of_each(spark, frame(spark, rows), small_dir), "doc_id", "text")
    assert sorted(number[k] for k in kept) == sorted(set(number.values()))
    assert {(1, a), (1, b), (3, c), (4, d)} <= set(kept) and len(kept) == 5 and kept[-1][0] is None


@pytest.mark.parametrize("gone", [["llm"], ["llm", "corpus_pipeline.py"]])
def test_the_rest_stands_alone(tmp_path, gone):
    """Without the two folders, with and without the pipeline, the registry still gives the other queries."""
    target = tmp_path / "repo"
    shutil.copytree(ROOT, target, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), [n for n in q if n.startswith('op') or n == 'pipeline'])"
    said = subprocess.run([sys.executable, "-c", code], cwd=target, capture_output=True, text=True,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert said.returncode == 0, said.stderr
    assert re.match(r"\d{2,} \[\]", said.stdout)
    names = set(QUERIES)
    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", n)[0] for n in names}
