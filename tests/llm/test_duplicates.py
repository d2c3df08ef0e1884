"""Near-duplicates, line dedup and repeated substrings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from themelens.llm import lines as L
from themelens.llm import simhash as S
from themelens.llm.common import materialise
from themelens.llm.components import connected_components
from themelens.llm.lines import banded, dedup_documents, dedup_lines, keys_of, within
from themelens.llm.simhash import fingerprint, fingerprint_links, near_duplicates, tile_links
from themelens.llm.substrings import Rolling, remove_repeats

from .cases import EXTRA, PARAGRAPH, ROWS, Sets, by_row, documents, empty, frame, pairs, words


def plain_fingerprint(text, n=3):
    own = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not own:
        return 0
    shingles = [" ".join(own[i:i + n]) for i in range(max(1, len(own) - n + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(rows, max_bits=3):
    fps = [plain_fingerprint(t) for _, t in rows]
    sets = Sets(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= max_bits:
                sets.join(i, j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            smallest[sets.root(i)] = min(smallest.get(sets.root(i), d), d)
    return [(d, "%016x" % f, smallest.get(sets.root(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))]


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_near_duplicates(spark, small_dir, which):
    docs = frame(spark) if which == "odd" else documents(spark, small_dir)
    found = by_row(near_duplicates(docs), "doc_id", "fingerprint", "component_id")
    assert found == sorted(plain_components(pairs(docs)), key=repr)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(empty(spark)).count() == 0


def test_fingerprint_of_long_text():
    text = " ".join(f"w{i}" for i in range(70_000))  # more shingles than one block of bit counts
    assert fingerprint(text, 3) == plain_fingerprint(text)


def test_links_of_planted_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 64)  # so that hot tiles are split
    r = random.Random(6)
    values = []
    for _ in range(150):
        x = r.getrandbits(64)
        values.append(x)
        for _ in range(r.randrange(4)):
            for _ in range(r.randrange(1, 5)):
                x ^= 1 << r.randrange(64)
            values.append(x)
    hub = r.getrandbits(64)  # a dense group
    values += [hub ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(a)]
    values = list(dict.fromkeys(values))
    sets = Sets(len(values))
    for i, x in enumerate(values):
        for j in range(i):
            if bin(x ^ values[j]).count("1") <= 3:
                sets.join(i, j)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long").repartition(4), 3)
    own, at = Sets(len(values)), {v: k for k, v in enumerate(signed)}
    for a, b in links.collect():
        own.join(at[a], at[b])
    assert [own.root(i) for i in range(len(values))] == [sets.root(i) for i in range(len(values))]


def test_tile_links_is_a_forest():
    a = np.array([0, 1, 3, 7, 0xFFFF0000], dtype=np.uint64)
    left, right = tile_links(a, a, 3, True)
    assert len(left) == 3 and set(left.tolist()) == {0}


def test_components(spark):
    r = random.Random(2)
    chain = list(range(1000, 1060))
    r.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(5, 5), (7, 8), (8, 9), (2, 3), (2, 3), (None, 4)] + [(100, k) for k in range(101, 400)]
    found = dict(by_row(connected_components(spark.createDataFrame(links, "a long, b long")), "node", "label"))
    expected = {k: 1000 for k in chain} | {5: 5, 7: 7, 8: 7, 9: 7, 2: 2, 3: 2} | {k: 100 for k in range(100, 400)}
    assert found == expected
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, a, alphabet, n):
    b = bytearray(a)
    for _ in range(n):
        p = r.randrange(len(b) + 1)
        kind = r.randrange(3)
        if kind == 0 or p == len(b):
            b.insert(p, r.choice(alphabet))
        elif kind == 1:
            del b[p]
        else:
            b[p] = r.choice(alphabet)
    return bytes(b)


def test_edit_distance_and_keys():
    r, plans = random.Random(3), {1: {}, 2: {}, 3: {}}
    for k in range(8000):
        alphabet = b"ab" if k % 2 else b"abcdefgh"
        a = bytes(r.choice(alphabet) for _ in range(r.randrange(30)))
        b = edited(r, a, alphabet, r.randrange(6))
        d = distance(a, b)
        for most in range(5):
            assert within(a, b, most) == (d <= most), (a, b, most, d)
            if len(a) >= len(b) and len(a) > most:
                assert (banded(a, b, most) <= most) == (d <= most)
        for edits in plans:
            if a != b and d <= edits and min(len(a), len(b)) > edits:
                (ia, pa), (ib, pb) = (keys_of(x, edits, plans[edits]) for x in (a, b))
                assert set(ia) & set(ib + pb) or set(ib) & set(ia + pa)


def plain_lines(rows, edits=2):
    """What every row keeps, by all pairs of distinct lines."""
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    at = {}
    for k in sorted(range(len(rows)), key=order):
        for n, line in enumerate((rows[k][1] or "").encode().split(b"\n")):
            if line.strip(b" \t\n\r\x0b\x0c"):
                at.setdefault(line, []).append((order(k), rows[k][1], n))
    distinct = list(at)
    sets = Sets(len(distinct))
    for i, a in enumerate(distinct):
        for j in range(i):
            b = distinct[j]
            x, y = a.split(), b.split()
            fewer = min(len(x), len(y))
            if fewer >= 27:
                most = next(e for e in range(100) if (e + 2) ** 3 > fewer)
                if abs(len(x) - len(y)) <= most and distance(x, y) <= most:
                    sets.join(i, j)
            elif min(len(a), len(b)) >= 10 and abs(len(a) - len(b)) <= edits and distance(a, b) <= min(
                    edits, min(len(a), len(b)) // 10):
                sets.join(i, j)
    return distinct, sets


def test_word_keys():
    """Lines within their words' bound share a key that one of them is indexed under."""
    r, plans = random.Random(4), {}
    assert [int(L.word_edits(n)) for n in (27, 63, 64, 124, 125, 999, 1000, 10 ** 6)] == [2, 2, 3, 3, 4, 8, 9, 99]
    for _ in range(1500):
        a = [r.choice([b"ab", b"c", b"def", b"gh"]) for _ in range(r.choice([27, 28, 40, 63, 64, 66, 125, 127]))]
        b = list(a)
        for _ in range(r.randrange(5)):
            at = r.randrange(len(b))
            b[at:at + r.randrange(2)] = [r.choice([b"ab", b"x"])] * r.randrange(2)
        d, fewer = distance(a, b), min(len(a), len(b))
        if fewer < 27:
            continue
        most = int(L.word_edits(fewer))
        assert L.within_words(a, b, most) == (d <= most)
        if d <= most:
            (ia, pa), (ib, pb) = L.word_keys(a, plans), L.word_keys(b, plans)
            assert set(ia) & set(ib + pb) or set(ib) & set(ia + pa)
    for n in (1000, 8000, 64_000):  # keys grow with words
        index, probe = L.word_keys([b"%d" % k for k in range(n)], {})
        assert len(index) == int(L.word_edits(n)) + 1 and len(index + probe) < n / 2


def test_keys_of_whole_columns(spark, monkeypatch):
    """Equal parts have equal keys wherever they stand, and nothing else has; keys sort by one number, index keys first."""
    monkeypatch.setattr(L, "KEY_BYTES", 200)
    r, parts = random.Random(12), {}
    lines = [bytes(r.choice(b"abc") for _ in range(r.randrange(10, 40))) for _ in range(300)]
    keys = L.Keys(False)
    for line in lines:
        keys.add(line, L.byte_plan(len(line), 2, {}), len(line), line[:1] * 8)
    whole, h1 = keys.take()
    at = 0
    for line in lines:
        plan = L.byte_plan(len(line), 2, {})
        assert sorted(x for found in L.keys_of(line, 2, {}) for x in found) == sorted((whole[at:at + plan.count] >> 1).tolist())
        assert set(h1[at:at + plan.count].tolist()) == {int.from_bytes(line[:1] * 8, "little")}
        for a, b, seed, key in zip(*plan.places, plan.seed.tolist(), (whole[at:at + plan.count] >> 1).tolist()):
            parts.setdefault((line[a:b], seed), set()).add(key)
        at += plan.count
    assert all(len(found) == 1 for found in parts.values()) and len(set.union(*parts.values())) == len(parts)
    docs = spark.createDataFrame([(k, "\n".join(x.decode() for x in lines[k::20])) for k in range(20)], "doc_id long, text string")
    met = L.met_keys(L.line_keys(docs, 2))
    sorts = [x for x in met._jdf.queryExecution().executedPlan().toString().split("\n") if "Sort [" in x]
    assert len(sorts) == 1 and "," not in sorts[0].split("[")[1].split("]")[0]
    found = by_row(met.distinct(), "seg", "h1", "index")
    every = {}
    for line in set(lines):
        h = int.from_bytes(xxhash.xxh3_128_digest(line)[:8], "little", signed=True)
        for index, some in zip((True, False), L.keys_of(line, 2, {})):
            for key in some:
                every.setdefault(key, set()).add((h, index))
    useful = {key: rows for key, rows in every.items() if any(i for _, i in rows) and len({h for h, _ in rows}) > 1}
    assert useful and {(key, h) for key, h, _ in found} == {(key, h) for key, rows in useful.items() for h, _ in rows}
    assert {(key, h) for key, h, i in found if i} == {(key, h) for key, rows in useful.items() for h, i in rows if i}


def test_batches_of_materialised_steps_are_bounded(spark):
    """A step that didn't open its table by ``read`` gets small batches too, of texts as of rows."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    rows = spark.range(0, 3000, 1, 1)
    small = materialise(rows.mapInArrow(sizes, "n long, bytes long"), "small").collect()
    large = materialise(rows.select(F.repeat(F.lit("x"), 20_000).alias("text")).mapInArrow(sizes, "n long, bytes long"), "large").collect()
    assert max(r.n for r in small) <= 1000 and sum(r.n for r in small) == 3000
    assert max(r.bytes for r in large) < 5_000_000 and sum(r.n for r in large) == 3000
    many = materialise(rows.mapInArrow(sizes, "n long, bytes long"), "many", arrow_rows=3000).collect()
    assert [r.n for r in many] == [3000] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"


def test_line_dedup(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 8)  # so that hot keys are split
    r = random.Random(9)
    base = [" ".join("".join(r.choice("abcdeé") for _ in range(r.randrange(2, 8))) for _ in range(r.randrange(1, 9))) for _ in range(60)]
    long = [" ".join(r.choice(base).split()[0] for _ in range(n)) for n in (24, 26, 27, 28, 29, 40, 62, 64, 66, 130)]
    rows = []
    for d in range(60):
        own = []
        for _ in range(r.randrange(6)):
            line = r.choice(base)
            own.append(edited(r, line.encode(), b"abc ", r.choice([0, 0, 1, 2, 3])).decode("utf-8", "ignore"))
        own += [f"a template line with the number {r.randrange(90)}"] * r.randrange(3) + [""] * r.randrange(2)
        for _ in range(r.randrange(3)):
            line = r.choice(long).split()
            for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
                at = r.randrange(len(line))
                line[at:at + r.randrange(2)] = [r.choice(["unexpectedly", "漢字", "to"])] * r.randrange(2)
            own.append(r.choice([" ", "  ", "\t"]).join(line))
        rows.append((d, "\n".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    distinct, sets = plain_lines(rows)
    seen, expected = set(), []
    for d, text in rows:
        kept = []
        for line in text.encode().split(b"\n"):
            name = sets.root(distinct.index(line)) if line.strip() else None
            if name is None or name not in seen:
                kept.append(line)
            seen.add(name)
        expected.append((d, b"\n".join(kept).decode(), sum(1 for x in text.split("\n") if x.strip())))
    assert by_row(dedup_lines(docs), "doc_id", "text", "n_lines") == sorted(expected, key=repr)


def test_line_dedup_of_changed_words(spark):
    """A changed word of a long line, however long itself; a very long text of one line; many alike lines."""
    words = [f"word{k}" for k in range(36)]
    other = [*words[:20], "incomprehensibility", *words[21:]]
    far = [*words[:5], "a", "b", "c", *words[8:]]
    vast = [f"w{k * 7919 % 50_000}" for k in range(50_000)]
    vaster = [w + "!" if k % 1500 == 7 else w for k, w in enumerate(vast)]  # 34 words of 50,000; up to 35 may differ
    many = [" ".join([*words[:k % 33], "x" * (k % 50 + 1), *words[k % 33 + 1:]]) for k in range(1500)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(far)), (4, " ".join(vast)), (5, " ".join(vaster)), (6, "\n".join(many))]
    found = {r.doc_id: (r.n_lines, r.n_removed) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (1, 0), 2: (1, 1), 3: (1, 0), 4: (1, 0), 5: (1, 1), 6: (1500, 1500)}


def test_line_dedup_of_odd_rows(spark):
    found = {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in dedup_lines(frame(spark)).collect()}
    assert {(1, "", 0, 0), (2, None, 0, 0), (7, "  \n\t ", 0, 0), (13, "\n\n", 0, 0)} <= found
    assert (11, "same line here\nanother line", 3, 1) in found
    assert (12, "", 2, 2) in found  # one equal line, one within an edit
    assert (5, PARAGRAPH + "five", 1, 0) in found and (14, "", 1, 1) in found and (None, "", 1, 1) in found
    kept = dedup_documents(frame(spark))
    assert kept.columns == ["doc_id", "text", *EXTRA] and kept.count() == len(ROWS)
    assert all(r[c] == c for r in kept.collect() for c in EXTRA)
    assert dedup_lines(empty(spark)).count() == 0


def plain_repeats(rows, length):
    data = [(t or "").encode() for _, t in rows]
    counts = Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, data):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def digest(found):
    return sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans),
                    hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found.collect()), key=repr)


def test_repeats(spark, small_dir):
    short = [(d, t) for d, t in ROWS if d != 4]
    assert digest(remove_repeats(frame(spark, short))) == plain_repeats(short, 200)
    docs = documents(spark, small_dir)
    assert digest(remove_repeats(docs)) == plain_repeats(pairs(docs), 200)
    assert remove_repeats(empty(spark)).count() == 0


def test_repeats_of_planted_passages(spark):
    r = random.Random(11)
    noise = lambda n: "".join(r.choice("abé ") for _ in range(n))
    passages = [noise(n) for n in (30, 40, 41, 60, 120)]
    rows = [(d, noise(r.randrange(60)) + r.choice(passages) + noise(r.randrange(9)) + r.choice(passages)[r.randrange(9):])
            for d in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert digest(remove_repeats(docs, length=40, gram=12)) == plain_repeats(rows, 40)
    with pytest.raises(ValueError):
        remove_repeats(docs, length=10, gram=11)


def test_repeats_of_many_copies(spark, monkeypatch):
    """What is gathered for a text doesn't grow with its copies."""
    from themelens.llm import substrings
    written = {}
    write = substrings.materialise
    monkeypatch.setattr(substrings, "materialise", lambda df, name: written.setdefault(name, write(df, name)))
    r = random.Random(5)
    noise = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    hot, pair, other = noise(400), noise(300), noise(300)
    rows = [(d, hot) for d in range(60)] + [(d, pair) for d in (60, 61)] + [(70, noise(90) + hot[50:200] + noise(90) + pair[:70])]
    rows += [(80, other), (81, noise(60) + other[100:180] + other[100:180]), (90, "short"), (91, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert digest(remove_repeats(docs, length=40, gram=12)) == plain_repeats(rows, 40)
    bound = max(len(Rolling(40, 12).runs(t.encode())[0]) for _, t in rows) + max(len(t.encode()) for _, t in rows)
    sizes = [len(m.marks or ()) for m in written["marks"].collect()]
    assert max(sizes) <= bound
    of_hot = [m for m in written["marks"].collect() if m.size == len(hot.encode())]
    assert len(of_hot) == 1 and len(of_hot[0].marks or ()) <= len(Rolling(40, 12).runs(hot.encode())[0])


def test_runs_of_a_long_text(monkeypatch):
    from themelens.llm import substrings
    data = bytes(random.Random(1).choice(b"abcd") for _ in range(5000))
    whole = Rolling(50, 10).runs(data)
    assert whole[3].sum() == len(data) - 49
    monkeypatch.setattr(substrings, "SEGMENT", 700)
    parts = Rolling(50, 10).runs(data)
    windows = lambda runs: {a + k: int(d) for d, a, _, n in zip(*runs) for k in range(n)}
    assert windows(whole) == windows(parts)
