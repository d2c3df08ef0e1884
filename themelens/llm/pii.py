"""Personal data: weak-supervision aggregation over candidate spans.

Candidates are the matches of four strict patterns (email, ip, card, phone) and of looser
ones (written-out emails, IPv6, 15-digit cards, phones without a plus).  Labelers vote for
or against each candidate or abstain: the strict pattern with its checks, a checksum or
number plan, gazetteers (top-level domains, card issuers, dialling codes), words found in
the 32 characters before it, and whether it stands apart from other letters.  The corpus
gives the number of candidates of each kind and voting pattern (a table bounded by the
number of patterns).  Expectation-maximisation over that table estimates the labelers'
reliabilities without any labels; a logistic span classifier is then trained on the
patterns, weighted by their counts and the estimated probabilities, and applied to the
candidates as a column expression.  Strict matches that pass their checks always stay;
the classifier adds loose candidates that pass their kind's check and don't overlap them.

Finding, voting and classifying use built-in functions only, inside the row; the counts of
patterns are the one shuffle.  Patterns use possessive repeats and start at a run's
beginning or the last match's end, so that no long run is tried from each of its characters.

Defined results: a null text is the empty text, without spans; every row is scanned for
itself, so repeated rows, ties and null ids don't matter; an empty table gives no rows (and
a classifier that adds nothing); extra columns are carried along in ``row``, under any name.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, read, settled

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
# A run may start where the last match ended or where no character of it stands before.
STRICT = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole run of digits with at most a space or hyphen between them, of 16 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<![{LOCAL}])[{LOCAL}]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])3[47][0-9]{13}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?<![0-9] )(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![ .-]?[0-9])(?![A-Za-z])",
}
#: What a text must hold for the pattern to be tried at all.
NEEDS = {
    ("email", True): lambda t: t.contains("@"), ("phone", True): lambda t: t.contains("+"),
    ("email", False): lambda t: t.contains("(at)") | t.contains("[at]"),
}
# Common top-level domains, issuer prefixes of payment cards, dialling codes.
DOMAINS = ["com", "org", "net", "edu", "gov", "int", "info", "biz", "io", "eu", "de", "fr", "es", "it", "uk", "us",
           "nl", "ch", "at", "be", "pl", "br", "pt", "mx", "ca", "au", "jp", "cn", "in"]
ISSUERS = ["4", "51", "52", "53", "54", "55", "2221", "2720", "34", "37", "6011", "65", "35"]
DIALLING = ["1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47",
            "48", "49", "51", "52", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81",
            "82", "84", "86", "90", "91", "92", "94", "98"]
# Words before a span that speak for and against personal data.
FOR = {"email": "e-?mail|mail|contact|write|courriel|correo",
       "ip": r"\bip\b|address|host|server|adresse|direcci",
       "card": "card|visa|mastercard|amex|payment|karte|carte|tarjeta",
       "phone": "phone|tel|call|mobile|fax|contact|telefon|téléphone|teléfono"}
AGAINST = r"version|\bv\.? ?$|order|invoice|isbn|\bref\b|\bid\b|serial|token|hash|bestellung|commande|pedido"
CONTEXT = 32
#: Matches of a text whose places are summed up at a time; the chunks' lengths are summed up after.
CHUNK = 256
LABELERS = ("strict", "check", "gazetteer", "context", "apart")


def digits(c):
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number):
    """Whether a string of at most 19 digits passes the Luhn sum."""
    padded = F.lpad(number, 20, "0")
    doubled = F.translate(padded, "0123456789", "0246813579")
    total = sum((F.substring(doubled if k % 2 else padded, k, 1).cast("int") for k in range(1, 21)), F.lit(0))
    return total % 10 == 0


def octets(span):
    return span.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{0,2})(?:\.(?!$)|$)){4}$")


def between(span, low, high):
    n = F.length(digits(span))
    return (n >= low) & (n <= high)


def passes(kind: str, span):
    """The checks of the strict patterns."""
    return {"email": F.lit(True), "ip": octets(span), "phone": between(span, 8, 15),
            "card": F.when(between(span, 16, 19), luhn(digits(span))).otherwise(F.lit(False))}[kind]


def bound(value, use):
    """``use(value)`` with the value computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def place(sizes):
    """Places of some matches from their own start on: (at: length of it all, out: spans with places)."""
    none = F.array().cast("array<struct<span:string,start:int,end:int>>")
    return F.aggregate(
        sizes, F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + F.length(s["span"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                s["span"].alias("span"), (acc["at"] + s["gap"]).alias("start"),
                (acc["at"] + s["gap"] + F.length(s["span"])).alias("end")))).alias("out")))


def shift(chunks):
    """The places of all chunks, each moved by the length of the chunks before it."""
    before = F.aggregate(
        chunks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"])
    return F.flatten(F.zip_with(chunks, before, lambda c, by: F.transform(c["out"], lambda p: F.struct(
        p["span"].alias("span"), (p["start"] + by).alias("start"), (p["end"] + by).alias("end")))))


def matches(text, kind: str, strict: bool):
    """Array of (kind, strict, span, start, end) of one pattern's matches, in order."""
    pattern = F.lit((STRICT if strict else LOOSE)[kind])
    spans, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    sizes = F.zip_with(spans, gaps, lambda s, g: F.struct(s.alias("span"), F.length(g).alias("gap")))
    first, last = F.lit(1), F.greatest(F.size(spans), F.lit(1))
    chunks = F.sequence(first, last, F.lit(CHUNK))
    placed = bound(F.slice(sizes, 1, F.size(spans)), lambda own: bound(
        F.transform(chunks, lambda at: place(F.slice(own, at, CHUNK))), shift))
    tagged = F.transform(placed, lambda p: F.struct(
        F.lit(kind).alias("kind"), F.lit(strict).alias("strict"), p["span"].alias("span"),
        p["start"].alias("start"), p["end"].alias("end")))
    empty = F.array().cast("array<struct<kind:string,strict:boolean,span:string,start:int,end:int>>")
    needed = NEEDS.get((kind, strict), lambda t: t.rlike("[0-9]"))(text)
    return F.when(needed & (F.size(spans) > 0), tagged).otherwise(empty)


def vote(yes, no):
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("int")


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """row, text, and ``found``: the candidates with the labelers' votes."""
    text = F.col("text")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lists = [matches(text, kind, strict) for kind in KINDS for strict in (True, False)]
    rows = rows.withColumn("raw", F.concat(*lists))

    def by_kind(kind, values, default):
        out = None
        for k, v in values.items():
            out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
        return out.otherwise(default)

    def judge(c):
        kind, span, start = c["kind"], c["span"], c["start"]
        number = digits(span)
        valid = c["strict"] & by_kind(kind, {k: passes(k, span) for k in KINDS}, F.lit(False))
        before = F.lower(F.substring(text, F.greatest(start - CONTEXT + 1, F.lit(1)), F.least(start, F.lit(CONTEXT))))
        left = F.substring(text, F.greatest(start, F.lit(1)), F.least(start, F.lit(1)))
        right = F.substring(text, c["end"] + 1, F.lit(1))
        check = by_kind(kind, {
            "card": F.when(between(span, 13, 19), luhn(number)).otherwise(F.lit(False)),
            "ip": F.when(c["strict"], octets(span)).otherwise(F.lit(True)),
            "phone": between(span, 10, 13), "email": F.length(span) <= 254}, F.lit(False))
        ending = F.lower(F.regexp_extract(span, r"([A-Za-z]+)$", 1))
        starts = lambda prefixes: number.rlike(f"^0*(?:{'|'.join(prefixes)})")
        known = by_kind(kind, {"email": ending.isin(DOMAINS), "card": starts(ISSUERS), "phone": starts(DIALLING)}, F.lit(None))
        return F.struct(
            kind.alias("kind"), span.alias("span"), start.alias("start"), c["end"].alias("end"), valid.alias("base"),
            F.least(F.length(span) / 8, F.lit(3)).cast("int").alias("size"),
            vote(valid, c["strict"]).alias("v_strict"), vote(check, ~check).alias("v_check"),
            vote(F.coalesce(known, F.lit(False)), ~F.coalesce(known, F.lit(True))).alias("v_gazetteer"),
            vote(by_kind(kind, {k: before.rlike(p) for k, p in FOR.items()}, F.lit(False)),
                 before.rlike(AGAINST)).alias("v_context"),
            vote(~(left.rlike("[0-9A-Za-z]") | right.rlike("[0-9A-Za-z]")),
                 left.rlike("[0-9A-Za-z]") | right.rlike("[0-9A-Za-z]")).alias("v_apart"))

    return rows.withColumn("found", F.when(F.size("raw") > 0, F.transform("raw", judge))).select("row", "text", "found")


def voting_patterns(found: DataFrame) -> list:
    """Candidates of each kind, size class and voting pattern: at most 4 * 4 * 3 ** 5 rows."""
    keys = ["kind", "size", *(f"v_{name}" for name in LABELERS)]
    return found.select(F.explode("found").alias("c")).select(*[F.col(f"c.{k}") for k in keys]).groupBy(*keys).count().orderBy(*keys).collect()


def reliabilities(votes: np.ndarray, counts: np.ndarray, tolerance: float = 1e-9):
    """(probability of each pattern, accuracy of each labeler) by expectation-maximisation."""
    p = 1 / (1 + np.exp(-votes.sum(axis=1, dtype=float)))
    while True:
        prior = (counts @ p + 1) / (counts.sum() + 2)
        right = ((votes > 0) * p[:, None] + (votes < 0) * (1 - p)[:, None]) * counts[:, None]
        accuracy = np.clip((right.sum(axis=0) + 2) / (((votes != 0) * counts[:, None]).sum(axis=0) + 3), 0.05, 0.95)
        new = 1 / (1 + np.exp(-(math.log(prior / (1 - prior)) + votes @ np.log(accuracy / (1 - accuracy)))))
        if np.abs(new - p).max(initial=0.0) < tolerance:
            return new, accuracy
        p = new


def features(kind, size, votes):
    """Bias, kind, size class and votes as numbers."""
    return [1.0, *(float(kind == k) for k in KINDS), *(float(size == s) for s in range(4)), *map(float, votes)]


def train(x: np.ndarray, p: np.ndarray, counts: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on soft labels (Newton steps until they stand still)."""
    w = np.zeros(x.shape[1])
    while True:
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (p - q)) - ridge * w
        curve = (x * (counts * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            return w


def fit_classifier(found: DataFrame) -> list[float] | None:
    """Weights of the span classifier for this corpus; None without candidates."""
    rows = voting_patterns(found)
    if not rows:
        return None
    votes = np.array([[r[f"v_{name}"] for name in LABELERS] for r in rows])
    counts = np.array([r["count"] for r in rows], dtype=float)
    p, _ = reliabilities(votes, counts)
    x = np.array([features(r["kind"], r["size"], v) for r, v in zip(rows, votes)])
    return [float(w) for w in train(x, p, counts)]


def find_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """row, text, spans: (kind, start, end, base, score) in order of kind and start; ends are exclusive."""
    found = candidates(docs, text_col)
    weights = fit_classifier(found)
    kind_at = {k: i for i, k in enumerate(KINDS)}
    order = F.create_map(*[F.lit(v) for kv in kind_at.items() for v in kv])

    def scored(c):
        values = [F.lit(1.0), *((c["kind"] == k).cast("double") for k in KINDS),
                  *((c["size"] == s).cast("double") for s in range(4)), *(c[f"v_{n}"].cast("double") for n in LABELERS)]
        logit = sum((v * w for v, w in zip(values, weights or [-1.0] + [0.0] * len(values))), F.lit(0.0))
        allowed = c["base"] | (c["v_strict"] >= 0) & (c["v_check"] >= 0)  # what fails a check is never added
        return F.struct(order[c["kind"]].alias("at"), c["start"].alias("start"), c["end"].alias("end"),
                        c["kind"].alias("kind"), c["base"].alias("base"),
                        F.when(allowed, 1 / (1 + F.exp(-logit))).otherwise(F.lit(0.0)).alias("score"))

    rows = found.withColumn("scored", F.transform("found", scored))
    rows = rows.withColumn("sure", F.filter("scored", lambda c: c["base"]))
    more = F.filter("scored", lambda c: ~c["base"] & (c["score"] > 0.5) & ~F.exists(
        "sure", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean,score:double>>")
    spans = F.transform(F.array_sort(F.concat("sure", more)), lambda c: F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), c["score"].alias("score")))
    return rows.select("row", "text", settled(F.coalesce(spans, none)).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; a null text stays null."""
    found = find_spans(docs, text_col)
    in_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    text = F.col("text")
    clean = F.aggregate(
        in_place, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(
                s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]),
                                               F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    changed = F.when(F.size("spans") > 0, clean).otherwise(F.col("row")[text_col])
    return found.select(*[(changed.alias(c) if c == text_col else F.col("row")[c].alias(c)) for c in docs.columns])


def written(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op6_personal_data")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict spans by kind and their checksum, and all spans, of every document."""
    found = find_spans(read(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found.select(
        "row.doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(written(base), 256).alias("base_sha256"), written("spans").alias("spans"))
