"""Spelling variants, MinHash near-duplicates and whitening against brute force."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from themelens.llm import minhash, spelling, whitening
from themelens.llm.minhash import minhash_groups
from themelens.llm.spelling import spelling_variants
from themelens.llm.whitening import whiten

from .cases import EXTRA, PARAGRAPH, ROWS, Sets, by_row, documents, empty, frame, pairs, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# spelling variants

def plain_vocabulary(rows, min_length=7, min_count=2, one_in=31):
    count = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if one_in and h % one_in == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= min_length and n >= min_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    k = next((k for k in range(len(short)) if short[k] != long[k]), len(short))
    return short[k:] == long[k + 1:]


def plain_variants(rows, factor=10, **options):
    count = plain_vocabulary(rows, **options)
    near = collections.defaultdict(list)
    by_gap = collections.defaultdict(set)  # equal after one letter is left out at one place, or one is added
    for w in count:
        by_gap["whole", w].add(w)
        for k in range(len(w)):
            by_gap["gap", w[:k], w[k + 1:]].add(w)
            if w[:k] + w[k + 1:] in count:
                by_gap["whole", w[:k] + w[k + 1:]].add(w)
    links = set()
    for kind, *key in by_gap:
        group = sorted(by_gap[(kind, *key)])
        if kind == "gap":
            links.update(itertools.combinations(group, 2))
        else:
            links.update(tuple(sorted((key[0], w))) for w in group if w != key[0])
    for a, b in links:
        assert one_edit(a, b)
        near[a].append(b)
        near[b].append(a)
    form = {}
    for w in count:
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= factor * count[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(near[w]), count.get(form[w])) for w, n in count.items()), key=repr)


VARIANTS = ("word", "form", "root", "n", "n_near", "form_n")


def variants(df, **options):
    return by_row(spelling_variants(df, **options), *VARIANTS)


def test_variants_of_a_table(spark, small_dir):
    docs = documents(spark, small_dir)
    assert variants(docs, drop_one_in=31) == plain_variants(pairs(docs))


@pytest.mark.parametrize("room", [64, 32 << 20])
def test_variants_of_odd_rows(spark, monkeypatch, room):
    """Also with filters of a few words, so that there are many rounds of many segments."""
    monkeypatch.setattr(spelling, "FILTER_BYTES", room * 64)
    if room == 64:
        monkeypatch.setattr(spelling, "SEGMENT", 8)
        monkeypatch.setattr(spelling, "CHUNK", 100)
    r = random.Random(3)
    stems = ["".join(r.choice("abé") for _ in range(9)) for _ in range(60)]
    rows = list(ROWS)
    for k, stem in enumerate(stems):
        for count in (1, 2, 25, 300)[k % 4:]:
            at = r.randrange(9)
            rows += [(1000 + k, " ".join([stem[:at] + r.choice(["", "a", "ÿ", "À"]) + stem[at + r.randrange(2):]] * count))]
    rows += [(1, "aaaaaaaa AAAAAAAA aaaaaaa aaaaaaa Aaaaaaa×a"), (2, "chainone " * 2 + "chaintone " * 20 + "chaintoner " * 200 + "Chaintoners " * 2000)]
    rows += [(3, "x" * 30_000 + " " + "x" * 29_999 + "y " + "x" * 29_999)] * 2
    for one_in in (None, 31):
        assert variants(frame(spark, rows), drop_one_in=one_in) == plain_variants(rows, one_in=one_in)
    found = {row[0]: row for row in variants(frame(spark, rows))}
    assert found["chainone"][1:3] == ("chaintone", "chaintoners")
    assert found["x" * 29_999][4] == 2


def test_no_words(spark):
    assert variants(empty(spark)) == []
    assert variants(frame(spark, [(1, None), (2, "short words only"), (None, "onceonly")])) == []


def test_filters_let_all_words_pass():
    r = random.Random(1)
    known = [bytes(r.choice(b"abcd") for _ in range(8)) for _ in range(5000)]
    codes = np.array([list(w) for w in known], dtype=np.uint8)
    hashes = spelling.terms(codes).sum(axis=1, dtype=np.uint64)
    layout = {8: (1, 20)}
    filters = spelling.Filters(layout, [(8, 0, spelling.build_segment(hashes, 1, 20))])
    assert len(filters.probe(8, hashes)) == len(hashes)


# MinHash near-duplicates

def plain_sets(rows, n=4):
    out = []
    for _, text in rows:
        found = words((text or "").translate(LOWER))
        out.append({" ".join(found[k:k + n]) for k in range(max(1, len(found) - n + 1))} if found else set())
    return out


def plain_groups(rows, percent=80):
    sets = plain_sets(rows)
    up = Sets(len(rows))
    where = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    both = collections.Counter()
    first = {}
    for k, s in enumerate(sets):  # equal sets together first, so that hot groups stay small
        key = frozenset(s)
        if s and key in first:
            up.join(first[key], k)
        first.setdefault(key, k)
    heads = set(first.values())
    for group in where.values():
        both.update(itertools.combinations([k for k in group if k in heads], 2))
    for (a, b), shared in both.items():
        if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            up.join(a, b)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[up.root(k)] = min(least.get(up.root(k), doc_id), doc_id)
    out = []
    for k, (doc_id, _) in enumerate(rows):
        component = least.get(up.root(k)) if sets[k] else doc_id
        out.append((doc_id, len(sets[k]), component, doc_id == component))
    return sorted(out, key=repr)


GROUPS = ("doc_id", "n_shingles", "component_id", "kept")


def test_groups_of_a_table(spark, small_dir):
    docs = documents(spark, small_dir)
    assert by_row(minhash_groups(docs), *GROUPS) == plain_groups(pairs(docs))


def chained(r, start, m, length=120):
    """A hot group: ``m`` texts, each one changed at a few places from an earlier one."""
    made = [[f"w{r.randrange(900)}" for _ in range(length)]]
    for _ in range(m - 1):
        text = list(r.choice(made[-8:]))
        for _ in range(r.randrange(1, 4)):
            text[r.randrange(length)] = f"v{r.randrange(900)}"
        made.append(text)
    return [(start + k, " ".join(t)) for k, t in enumerate(made)]


@pytest.mark.parametrize("fair", [8, 0])
def test_groups_of_odd_rows(spark, monkeypatch, fair):
    """Also where the exact blocks have to settle nearly all."""
    monkeypatch.setattr(minhash, "FAIR", fair or 10 ** 9)
    monkeypatch.setattr(minhash, "BLOCK", 2000)
    if not fair:  # the first round of stars ends the stars
        monkeypatch.setattr(minhash, "FAIR", 0.5)
    r = random.Random(5)
    rows = ROWS + chained(r, 1000, 150) + chained(r, 2000, 60, 30)
    rows += [(3000 + k, PARAGRAPH + "five") for k in range(40)] + [(None, rows[-1][1])] + [(1000, rows[25][1]), (1000, "no other one is like this")]
    rows += [(4000, "a b c d e f g"), (4001, "a b c d e f"), (4002, "A b\tc d"), (4003, "a b c"), (4004, "A B C"), (4005, "a b c d e f g h")]
    assert by_row(minhash_groups(frame(spark, rows)), *GROUPS) == plain_groups(rows)


def test_no_documents(spark):
    assert minhash_groups(empty(spark)).count() == 0
    blank = by_row(minhash_groups(frame(spark, [(1, ""), (2, None), (2, " \t"), (None, "")])), *GROUPS)
    assert blank == sorted([(1, 0, 1, True), (2, 0, 2, True), (2, 0, 2, True), (None, 0, None, True)], key=repr)


def test_sketches_fill_and_agree_as_the_sets_do():
    r = np.random.default_rng(2)
    for size in (1, 2, 7, 60, 500, 40_000):
        x = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64))
        assert (minhash.sketch(x) < minhash.FULL).all()
        assert (minhash.sketch(x[::-1].copy()) == minhash.sketch(x)).all()
    agreed = []
    for _ in range(40):
        x = np.unique(r.integers(0, 1 << 63, 300, dtype=np.uint64))
        agreed.append((minhash.sketch(x[:240]) == minhash.sketch(x[60:])).mean())
    assert abs(np.mean(agreed) - 0.6) < 0.03 and np.std(agreed) < 0.07


# whitening

def vectors(spark, rows):
    schema = "vec_id long, embedding array<float>, " + ", ".join(f"`{c}` string" for c in ["k", "x", "n", "z", "at", *EXTRA])
    return spark.createDataFrame([(i, v, *["k", "x", "n", "z", "at", *EXTRA]) for i, v in rows], schema).repartition(3)


def check_whitening(found, rows, wanted=32):
    usable = [(i, np.floor(64 * np.array(v, dtype=np.float32).astype(float)).astype(int) + 1_000_000) for i, v in rows]
    x = np.array([v for _, v in usable]).astype(object)
    n, total = len(x), x.sum(axis=0)
    y = ((n * x - total) / n).astype(float)
    cov = y.T @ y / n
    e, c = np.linalg.eigh(cov)
    e, c = e[::-1], c[:, ::-1]
    k = min(wanted, int((e > 1e-15 * e[0]).sum()), np.linalg.matrix_rank(y))
    out = collections.defaultdict(dict)
    for r in found.collect():
        assert r.n == n and r.identity_error <= 1e-8
        assert abs(r.explained - e[r.component - 1] / np.trace(cov)) <= 1e-9 * r.explained
        out[r.component].setdefault((r.vec_id, r.deviation), []).append(r.whitened)
    assert sorted(out) == list(range(1, k + 1))
    rows_of = sorted((i is not None, i, int(d)) for (i, _), d in zip(usable, ((n * x - total) ** 2).sum(axis=1)))
    assert sorted((i is not None, i, d) for (i, d), v in out[1].items() for _ in v) == rows_of
    z = np.zeros((n, k))
    seen = collections.Counter()
    for at, ((i, _), d) in enumerate(zip(usable, ((n * x - total) ** 2).sum(axis=1))):
        if len(out[1][i, int(d)]) == 1:
            z[at] = [out[m][i, int(d)][0] for m in range(1, k + 1)]
            seen[at] = 1
    plain = y @ c[:, :k] / np.sqrt(e[:k])
    gaps = np.abs(np.diff(e[:k + 1])) if k < len(e) else np.append(np.abs(np.diff(e[:k])), e[k - 1])
    for m in range(k):
        apart = min(gaps[m], gaps[m - 1] if m else np.inf) > 1e-6 * e[0]
        if apart and len(seen) == n:
            assert min(np.abs(plain[:, m] - z[:, m]).max(), np.abs(plain[:, m] + z[:, m]).max()) < 1e-6
    return z


def test_whitening_of_a_table(spark, small_dir):
    table = spark.read.parquet(f"{small_dir}/embeddings.parquet")
    check_whitening(whiten(table), [(r.vec_id, r.embedding) for r in table.select("vec_id", "embedding").collect()])


def test_whitening_of_odd_rows(spark):
    r = random.Random(4)
    good = [(k, [r.uniform(-50, 50) * 10 ** -j for j in range(5)] + [1.0]) for k in range(80)]  # one entry never varies
    good += [(None, [1.0] * 6), (7, [2.0, 0.0, 3.0, 1.0, 1.0, 1.0]), (7, [9.0, 0.0, 3.0, 1.0, 1.0, 1.0])]
    bad = [(500, None), (501, []), (502, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (503, [float("nan")] * 6), (504, [float("inf")] + [0.0] * 5),
           (505, [1.0, 2.0]), (506, [3e38] + [0.0] * 5)]
    check_whitening(whiten(vectors(spark, good + bad)), good)
    check_whitening(whiten(vectors(spark, good + bad), components=2), good, wanted=2)


def test_whitening_of_equal_deviations(spark):
    """Breakdowns: a cross has equal deviations along all axes; few rows span few dimensions; equal rows none."""
    cross = [(k, [float((k // 2 == j) * (1 - 2 * (k % 2)) * 8) for j in range(12)]) for k in range(24)]
    found = whiten(vectors(spark, cross))
    assert found.select("component").distinct().count() == 12
    assert all(r.identity_error < 1e-9 and abs(r.explained - 1 / 12) < 1e-9 for r in found.collect())
    few = [(k, [float((k * j * j + k * k) % 7) for j in range(20)]) for k in range(5)]
    check_whitening(whiten(vectors(spark, few)), few)
    assert whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whiten(vectors(spark, [(1, None)])).count() == 0


def test_long_deviations():
    whole, rest = np.array([0, 0]), np.array([0, 1])
    x = np.array([[3, 4], [1 << 40, 0]])
    assert whitening.deviations(x, whole, rest, 2) == [36 + 49, None]
