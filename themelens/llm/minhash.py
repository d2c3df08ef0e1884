"""MinHash near-duplicates: fast similarity sketching, banding and exact verification.

A document's set holds the 64-bit hashes of its distinct shingles.  The sketch of a set has
``COORDINATES`` numbers.  In round ``i`` of the first half every element draws a coordinate and a
value in [i, i + 1), and a coordinate keeps its least value; in the second half round
``COORDINATES + j`` sends every element to coordinate ``j``, so all coordinates fill, whatever the
size of the set.  Later rounds draw larger values, so the rounds end once nothing is empty: about
``COORDINATES * ln(COORDINATES)`` draws for a small set and one pass for a large one.  Two sketches
agree in a share of coordinates that is concentrated around the similarity of the sets.

``BANDS`` bands of ``ROWS`` coordinates give a document its keys, and documents that share a key are
candidates: a pair at similarity 0.8 shares none with a chance of (1 - 0.8 ** 4) ** 32 = 5e-8, one at
0.9 of 2e-15.  Links are confirmed on the full sets, as percent * union <= 100 * intersection.  A
group of documents under one key never gives all its pairs:

1. Equal sets are one node, whatever the number of copies.
2. Rounds of stars: each key's head (the least by a hash that changes from round to round) meets the members
   that are not in its component yet; components are contracted and keys with one component leave.
   The rounds go on while a fair share of the pairs tried are links.
3. What is left is settled exactly: in every key the members outside its most frequent component meet
   all others, in blocks of bounded size that carry the sets, and only a forest leaves a task.

Defined results: a null, empty or blank text has an empty set (``n_shingles`` 0) and is linked with
nothing, not even with another one; a text of fewer words than a shingle is one shingle; repeated rows
share a component; a null id takes no part in the smallest id of its component, which is null if no
row of it has an id; ``kept`` compares ids null-safely, so a row without an id stays if its component
has no id at all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, materialise, query, read, texts
from .components import connected_components

COORDINATES = 128
ROWS = 4
BANDS = COORDINATES // ROWS
#: Elements that are hashed at a time, about (bounds the memory of a round).
CHUNK = 1 << 17
#: Shingles in a block of the exact comparison, about (8 bytes each).
BLOCK = 1 << 18
#: The rounds of stars end when fewer than one in so many pairs tried is a link.
FAIR = 8

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
LOW = np.uint64(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTORS = mix(np.arange(1001, 1001 + ROWS, dtype=np.uint64)) | np.uint64(1)
BAND_SEEDS = mix(np.arange(2001, 2001 + BANDS, dtype=np.uint64))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``text``."""
    from xxhash import xxh64_intdigest as xxh

    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: only A-Z and ASCII white space
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    spans = zip(starts[:n].tolist(), (ends[words - 1:] if len(tokens) >= words else ends[-1:]).tolist())
    return np.unique(np.fromiter((xxh(joined[a:b]) for a, b in spans), dtype=np.uint64, count=n))


def sketch(elements: np.ndarray) -> np.ndarray:
    """Fast similarity sketch of a set that isn't empty."""
    t = COORDINATES
    best = np.full(t, FULL)
    together = max(1, min(t, -(-7 * t // len(elements))))  # rounds that fill all coordinates of most sets
    at = 0
    while at < t and (best == FULL).any():
        rounds = np.arange(at, min(at + together, t), dtype=np.uint64)
        for k in range(0, len(elements), CHUNK):
            h = mix(elements[None, k:k + CHUNK] + SEEDS[rounds][:, None])
            where = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
            np.minimum.at(best, where.ravel(), ((rounds << np.uint64(32))[:, None] | (h & LOW)).ravel())
        at += len(rounds)
    if (best == FULL).any():
        for j in range(t):
            low = (mix(elements + SEEDS[t + j]) & LOW).min()
            best[j] = min(best[j], np.uint64((t + j) << 32) | low)
    return best


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit key a band."""
    return mix(mix(coordinates.reshape(BANDS, ROWS) * FACTORS).sum(axis=1, dtype=np.uint64) + BAND_SEEDS)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key, n_shingles, d1 and d2 (digest of the set) and keys (of the bands) of every row."""
    from xxhash import xxh3_128_digest

    def sign(batches):
        for batch in batches:
            sets = [shingle_set(t, words) for t in texts(batch.column("text"))]
            digests = np.frombuffer(b"".join(xxh3_128_digest(s.tobytes()) for s in sets), dtype=np.int64).reshape(-1, 2)
            keys = [band_keys(sketch(s)) if len(s) else s for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc_id", "text_key", "n_shingles", "d1", "d2", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(sign, f"doc_id {kind}, text_key string, n_shingles long, d1 long, d2 long, keys array<long>")


def load_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, members): the sorted set of every node in ``wanted`` (node, doc_id, text_key)."""
    same = docs.doc_id.eqNullSafe(wanted.doc_id) & (docs.text_key == wanted.text_key)
    found = docs.join(wanted, same).select("node", "text")

    def build(batches):
        for batch in batches:
            sets = [shingle_set(t, words).tobytes() for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), binary(sets)], names=["node", "members"])

    return found.mapInArrow(build, "node long, members binary").dropDuplicates(["node"])


def as_set(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=np.uint64)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are as alike as asked."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("set_b"))

    def confirm(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = as_set(x), as_set(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(confirm, "a long, b long")


def sizes_fit(m, n, percent: int):
    """Whether sets of ``m`` and ``n`` elements can be as alike as asked."""
    return F.least(m, n) * 100 >= F.greatest(m, n) * percent


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after the components that ``links`` (of labels) join."""
    merged = connected_components(links).select(F.col("node").alias("label"), F.col("label").alias("least"))
    return materialise(labels.join(merged, "label", "left").select("node", F.coalesce("least", "label").alias("label")), "labels")


def open_keys(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, n, label) of the keys that more than one component shares."""
    named = members.join(labels, "node")
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    return materialise(named.join(mixed, "key").select("key", "node", "n", "label"), "open")


def star_pairs(members: DataFrame, number: int, percent: int) -> DataFrame:
    """(a, b, label_a, label_b): each key's head with the members outside its component."""
    order = F.struct(F.xxhash64("node", F.lit(number)).alias("h"), "node", "n", "label")
    heads = members.groupBy("key").agg(F.min(order).alias("head"))
    met = members.join(heads, "key").where((F.col("label") != F.col("head.label")) & sizes_fit(F.col("n"), F.col("head.n"), percent))
    return met.select(F.col("head.node").alias("a"), F.col("node").alias("b"),
                      F.col("head.label").alias("label_a"), F.col("label").alias("label_b")).distinct()


def block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of labels among all pairs of ``members`` that share a key and have different labels."""
    h = [F.bit_xor(F.xxhash64("node", F.lit(k))) for k in (1, 2)]
    lists = members.groupBy("key").agg(h[0].alias("h0"), h[1].alias("h1"), F.count("*").alias("m"), F.sum("n").alias("total"))
    once = lists.groupBy("h0", "h1", "m").agg(F.min("key").alias("key"), F.first("total").alias("total"))  # keys with the same members
    shares = members.groupBy("key", "label").agg(F.count("*").alias("m"), F.sum("n").alias("part"))
    main = shares.groupBy("key").agg(F.max(F.struct("m", "label", "part")).alias("main"))
    plan = once.join(main, "key").select(
        "key", F.col("main.label").alias("main"), F.ceil(F.col("total") / BLOCK).cast("int").alias("rows"),
        F.ceil((F.col("total") - F.col("main.part")) / BLOCK).cast("int").alias("columns"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    there = members.join(plan, "key")
    fields = ["key", "i", "j", "rest", "node", "label", "n"]
    bulk = there.withColumn("i", own(F.col("rows"))).withColumn("j", every(F.col("columns"))).withColumn("rest", F.lit(False))
    rest = there.where("label != main").withColumn("j", own(F.col("columns"))).withColumn("i", every(F.col("rows"))) \
        .withColumn("rest", F.lit(True))
    cells = bulk.select(*fields).union(rest.select(*fields)).join(sets, "node")

    def settle(table):
        nodes, labels, n = (table.column(c).to_numpy() for c in ("node", "label", "n"))
        is_rest = table.column("rest").to_numpy(zero_copy_only=False)
        members = [as_set(v) for v in table.column("members")]
        up, found = {}, []

        def root(x):
            while up.get(x, x) != x:
                x = up[x]
            return x

        others = np.flatnonzero(~is_rest)
        for r in np.flatnonzero(is_rest):
            mine, m = members[r], n[r]
            own_root = root(labels[r])
            fits = np.minimum(n[others], m) * 100 >= np.maximum(n[others], m) * percent
            for o in others[fits & (labels[others] != labels[r])]:
                if root(labels[o]) == own_root:
                    continue
                both = len(np.intersect1d(mine, members[o], assume_unique=True))
                if 100 * both >= percent * (m + n[o] - both):
                    low, high = sorted((own_root, root(labels[o])))
                    up[high] = low
                    own_root = low
                    found.append((labels[r], labels[o]))
        a, b = zip(*found) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return cells.groupBy("key", "i", "j").applyInArrow(settle, "a long, b long")


def minhash_groups(docs: DataFrame, words: int = 4, percent: int = 80,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.md5(F.col(text_col).cast("binary")).alias("text_key"))
    signed = materialise(signatures(docs, words), "signed")
    nodes = signed.where("n_shingles > 0").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "text_key")).alias("at"),
        F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    members = materialise(keyed.join(shared, "key").select("key", "node", "n"), "members")
    labels = materialise(members.select("node").distinct().withColumn("label", F.col("node")), "labels")
    wanted = labels.join(nodes, "node").select("node", "at.doc_id", "at.text_key")
    sets = materialise(load_sets(docs, wanted, words), "sets")
    number, left = 0, members.withColumn("label", F.col("node"))
    while not left.isEmpty():
        tried = materialise(star_pairs(left, number, percent), "pairs")
        links = verify(tried.select("a", "b"), sets, percent)
        links = materialise(links.join(tried, ["a", "b"]).select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct(), "links")
        n_tried, n_links = tried.count(), links.count()
        if n_links:
            labels = relabel(labels, links)
            left = open_keys(members, labels)
        number += 1
        if n_links * FAIR < n_tried or not n_tried:
            break
    if not left.isEmpty():
        labels = relabel(labels, materialise(block_links(left, sets, percent), "links"))
    component = nodes.select("d1", "d2", "node", "first").join(labels, "node", "left") \
        .select("d1", "d2", "first", F.coalesce("label", "node").alias("label"))
    smallest = component.groupBy("label").agg(F.min("first").alias("smallest"))
    component = materialise(component.join(smallest, "label").select("d1", "d2", "smallest"), "components")
    found = signed.select("doc_id", "n_shingles", "d1", "d2").join(component, ["d1", "d2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@query("op13_minhash_near_duplicates")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document over 4-word shingle sets, similarity 0.8 or more."""
    return minhash_groups(read(spark, sf_dir, "documents", "doc_id", "text"), words=4, percent=80)
