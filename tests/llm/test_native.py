"""Quality rules, license scans and personal data: SQL, brute force, plans and odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from themelens.llm import pii, quality
from themelens.llm.licenses import PHRASES, TEMPLATES, block_width, joined, scan_licenses, words_of
from themelens.llm.pii import KINDS, find_spans, redact, reliabilities, train, written
from themelens.llm.quality import BITS, POLICIES, ablations, fails, keep, mask, rule_ledger

from .cases import EXTRA, ROWS, by_row, documents, empty, frame, pairs, words


def no_python(df):
    plan = df._jdf.queryExecution().toString()
    return not re.search("Python|Pandas|Arrow", plan)


# ---- quality -------------------------------------------------------------------------

def plain_measures(text):
    text = text or ""
    own = words(text)
    windows = Counter(tuple(own[i:i + 3]) for i in range(len(own) - 2))
    covered = {j for i in range(len(own) - 2) if windows[tuple(own[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_measures(spark, small_dir, which):
    docs = frame(spark, ROWS + [(20, "a b c " * 30 + "d"), (21, "a b c d a b c"), (22, "x y z x y z y z x")]) if which == "odd" \
        else documents(spark, small_dir)
    ledger = rule_ledger(docs)
    assert no_python(ledger)
    assert by_row(ledger.select("row.doc_id", "m.*"), "doc_id", *MEASURES) == sorted(
        ((d, *plain_measures(t)) for d, t in pairs(docs)), key=repr)


def test_repeats_are_equal_words_whatever_the_hash(spark, monkeypatch):
    """Windows whose hashes agree by accident, in part or in full, are no repeats."""
    whole = quality.F.xxhash64
    rows = [(1, " ".join(f"w{k}" for k in range(300))), (2, "a b c d a b c " + " ".join(f"w{k}" for k in range(200)) + " d a b"),
            (3, "x y z x y z y z x"), (4, "a b")]
    for bits in (3, 5, 64):
        weak = lambda *words: whole(*words) if bits == 64 else whole(*words).bitwiseAND((1 << bits) - 1)
        monkeypatch.setattr(quality.F, "xxhash64", weak)
        found = by_row(rule_ledger(frame(spark, rows)).select("row.doc_id", "m.*"), "doc_id", *MEASURES)
        monkeypatch.setattr(quality.F, "xxhash64", whole)
        assert found == sorted((d, *plain_measures(t)) for d, t in rows)


def test_policies_and_ablations(spark, small_dir):
    docs = documents(spark, small_dir)
    ledger = rule_ledger(docs)
    rows = [r.failures for r in ledger.collect()]
    for name, rules in POLICIES.items():
        assert set(quality.BASE) <= set(rules)
        kept = keep(docs, name)
        assert kept.columns == docs.columns
        assert kept.count() == sum(1 for f in rows if not f & mask(rules))
        found = {r.rule: (r.failed, r.alone, r.kept) for r in ablations(ledger, name).collect()}
        whole = mask(rules)
        assert found == {r: (sum(1 for f in rows if f & BITS[r]), sum(1 for f in rows if f & whole == BITS[r]),
                             sum(1 for f in rows if not f & whole)) for r in rules}


def test_quality_separates_labelled_documents(spark, small_dir):
    """The rules beyond the base catch junk and leave clean documents of 50 words or more alone."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in keep(documents(spark, small_dir)).collect()}
    long_enough = {d for d, t in pairs(documents(spark, small_dir)) if len(words(t)) >= 50}
    clean = [d for d, q in labels.items() if q == 1 and d in long_enough]
    junk = [d for d, q in labels.items() if q == 0]
    assert all(d in kept for d in clean) and not any(d in kept for d in junk)


def test_quality_of_odd_rows(spark):
    assert keep(frame(spark)).columns == ["doc_id", "text", *EXTRA]
    assert {r.doc_id for r in keep(frame(spark)).collect()} <= {4, 5, 6, 14, None}
    assert rule_ledger(empty(spark)).count() == 0
    assert rule_ledger(frame(spark)).where(~fails(POLICIES["base"])).count() >= 1


# ---- licenses ------------------------------------------------------------------------

def plain_scan(text, threshold=0.9):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    own = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold)
    places = [(i, label) for ws, label in PHRASES for i in range(len(own)) if tuple(own[i:i + len(ws)]) == ws]
    best, labels = 0.0, {label for _, label in places}
    for label, template in TEMPLATES:
        t, width = set(words_of(template)), block_width(template, threshold)
        part = max(len(t.intersection(own[i:i + width])) for i in range(len(own) or 1)) / len(t)
        if part >= threshold - 1e-9:
            labels.add(label)
            best = max(best, part)
    at = [i for i, _ in places]
    return (len(own), len(at), min(at, default=None), max(at, default=None),
            ",".join(sorted({label for _, label in places})), ",".join(sorted(labels)), best)


LICENSED = [
    (50, "Released under the MIT License."), (51, "mit license MIT LICENSE mit license"),
    (52, TEMPLATES[1][1] + " to whom it may concern"), (53, "the GNU General Public License\nAll rights reserved."),
    (54, "all my rights are well reserved for you and me and all of the others here today"),
    (55, "Apache license; apache-license, APACHE\nLICENSE"), (56, "Licensed under CC BY-NC 4.0"),
    (57, "general public general public license"), (58, "ſmit license K mit licen se"),
    (59, "of this long line of twenty-six words the middle says all rights reserved, and what comes before "
         "and after it has nothing to do with it at all"),
    (70, TEMPLATES[1][1].replace(" of ", "\n * of ").replace(" the ", "\n * the ")),
    (71, "filler " * 300 + "\n\n" + TEMPLATES[1][1].replace("hereby", "thereby").replace("charge", "cost") + " filler" * 300),
    (72, "all the rights reserved"), (73, "all of the rights reserved"), (74, "reserved rights all " * 2000),
    (75, TEMPLATES[1][1].replace("sublicense, and/or sell", "with") + " license"), (76, "\u212Aelvin MIT LICENSE \u0130"),
    (77, " ".join(t for _, t in TEMPLATES)),
]


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_licenses(spark, small_dir, which):
    from pyspark.sql import functions as F
    docs = frame(spark, ROWS + LICENSED) if which == "odd" else documents(spark, small_dir)
    found = scan_licenses(docs)
    assert no_python(found)
    labels, at = F.col("places.label"), F.col("places.word")
    found = found.select(
        "row.doc_id", "n_words", F.size("places").alias("n"), F.array_min(at).alias("a"), F.array_max(at).alias("b"),
        joined(labels).alias("base"), joined(F.concat(labels, F.col("found.label"))).alias("all"),
        F.coalesce(F.array_max("found.containment"), F.lit(0.0)).alias("score"))
    assert by_row(found, *found.columns) == sorted(((d, *plain_scan(t)) for d, t in pairs(docs)), key=repr)


def test_notices_wherever_lines_end(spark):
    """Wide lines, wrapped notices and a few changed words; enough words far apart are no block."""
    from pyspark.sql import functions as F
    found = scan_licenses(frame(spark, LICENSED)).select("row.doc_id", F.col("found.label").alias("labels"))
    labels = {r.doc_id: set(r.labels) for r in found.collect()}
    assert "reserved" in labels[59] and "reserved" in labels[72] and "reserved" in labels[74]
    assert not labels[54] and not labels[73] and not labels[55]
    assert labels[70] == labels[71] == {"mit"}
    assert labels[77] >= {label for label, _ in TEMPLATES}


def test_many_templates(spark):
    """The plan does not grow with the number of templates."""
    from pyspark.sql import functions as F
    notices = [(f"n{k}", f"notice number{k} of maker{k % 7} holds w{k} x{k * 3} y{k % 50}") for k in range(2000)]
    docs = frame(spark, [(k, f"so the {notices[k * 40][1]} it says") for k in range(50)] + [(99, "notice of w1 x2")])
    found = scan_licenses(docs, templates=notices).select("row.doc_id", F.col("found.label").alias("labels"))
    assert {r.doc_id: r.labels for r in found.collect()} == {k: [f"n{k * 40}"] for k in range(50)} | {99: []}


def test_licenses_of_nothing(spark):
    assert scan_licenses(empty(spark)).count() == 0
    assert scan_licenses(frame(spark), phrases=[]).count() == len(ROWS)
    assert scan_licenses(frame(spark), templates=[("none", " - ")]).select("found").distinct().collect()[0].found == []


# ---- personal data -------------------------------------------------------------------

def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(n := re.sub("[^0-9]", "", s)) <= 19 and luhn(n)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def plain_base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in BASE.items() for m in re.finditer(p, text or "") if ok(m[0])]


PERSONAL = [
    (60, "mail a@b.c_x@d.ee and 1.2.3.4.5.6.7.8 or 256.1.1.1 and 0300.1.2.3 or 000255.1.1.1"),
    (61, "card 4041 8949-7460 8795, 4041894974608795 4041894974608796 4041 8949 7460 8795 1"),
    (62, "tel +1 (988) 555-2485 +12 +1 23456 7 + 1 call +49 30 1234567890123456"),
    (63, "é漢 x.y+z@mail-1.example.com.é 10.0.0.1é +33.1.23.45.67.89"),
    (64, "@a.b a@ a@b a@b. a@b.c. a@@b.c .@-.- a@b..c"), (65, "a" * 20_000 + "@b"), (66, "1." * 10_000 + "x@y.z"),
    (67, "phone (030) 555-2485 or john (at) mail (dot) example (dot) com"), (68, "+" * 5000 + "1" * 20),
]


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_base_spans(spark, small_dir, which):
    from pyspark.sql import functions as F
    docs = frame(spark, ROWS + PERSONAL) if which == "odd" else documents(spark, small_dir)
    found = find_spans(docs)
    assert no_python(found)
    found = found.select("row.doc_id", written(F.filter("spans", lambda s: s["base"])).alias("base"), written("spans").alias("all"))
    rows = found.collect()
    assert sorted(((r.doc_id, r.base) for r in rows), key=repr) == sorted(
        ((d, ",".join(plain_base(t))) for d, t in pairs(docs)), key=repr)
    for r in rows:
        spans = [s.split(":") for s in r["all"].split(",") if s]
        assert set(filter(None, r.base.split(","))) <= set(r["all"].split(","))
        assert spans == sorted(spans, key=lambda s: (KINDS.index(s[0]), int(s[1])))


def test_redaction(spark):
    docs = frame(spark, ROWS + PERSONAL)
    clean = redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    text = {r.doc_id: r.text for r in clean.collect() if r.doc_id}
    assert text[2] is None and text[1] == "" and text[3] == "a"
    assert text[63] == "é漢 <EMAIL>.é <IP>é <PHONE>"
    assert not any(plain_base(text[d]) for d in (60, 61, 62, 63))
    assert redact(empty(spark)).count() == 0


def test_expectation_maximisation_and_classifier():
    """Two thirds of the labelers are right 9 times in 10; the truth is found without labels."""
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    right = np.array([0.9, 0.9, 0.85, 0.8, 0.55])
    votes = np.where((rng.random((4000, 5)) < right) == truth[:, None], 1, -1)
    votes[rng.random((4000, 5)) < 0.2] = 0
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, accuracy = reliabilities(patterns, counts.astype(float))
    assert np.abs(accuracy - right).max() < 0.08
    assert ((p[back.reshape(-1)] > 0.5) == truth).mean() > 0.93
    w = train(np.hstack([np.ones((len(patterns), 1)), patterns]), p, counts.astype(float))
    held = np.where((rng.random((2000, 5)) < right) == (t := rng.random(2000) < 0.3)[:, None], 1, -1)
    assert (((np.hstack([np.ones((2000, 1)), held]) @ w) > 0) == t).mean() > 0.93


def test_labelers_add_plain_phones(spark):
    """Loose phones with a telling context are added, bare number runs and failing cards are not."""
    rows = [(k, f"call me, phone ({k % 900 + 100}) 555-{1000 + k}, or +1 ({k % 900 + 100}) 555-{1000 + k}") for k in range(60)]
    rows += [(100 + k, f"order id 12 123 456{k % 10} and card 404189497460879{k % 10}") for k in range(60)]
    rows = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [s for s in r.spans if not s.base] for r in find_spans(rows).select("row.doc_id", "spans").collect()}
    assert all(len(found[k]) == 1 and found[k][0].kind == "phone" for k in range(60))
    assert not any(s.kind == "card" for k in range(100, 160) for s in found[k])


def test_checksums_match_the_query(spark, small_dir):
    row = pii.op6(spark, small_dir).where("doc_id = 0").first()
    text = dict(pairs(documents(spark, small_dir)))[0]
    assert row.base_sha256 == hashlib.sha256(",".join(plain_base(text)).encode()).hexdigest()
