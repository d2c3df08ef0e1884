"""Best-fit packing of documents into sequences of a fixed number of tokens.

Method: pattern packing by non-negative least squares.  The histogram of piece lengths
(at most ``size`` counts, however many documents there are) is gathered with partial
sums.  On the driver, all patterns of two or three lengths that fill a sequence exactly
are enumerated; an active-set non-negative least squares fit finds how often to repeat
each, so that the patterns explain the histogram; the repeats, or a share of them, are
rounded down and cut to what is there (rounded up ones take pieces from better patterns); the lengths left over are packed best fit decreasing, by
counts of equal lengths and equal gaps, never one document at a time.

The plan is a table of slots for each length, whose size depends on ``size`` alone.
Pieces take the slots of their length in the order of their rank.  Ranks are counted in
``BUCKETS`` hashed shares of each length, so that a length which holds a third of all
rows is dealt to many tasks.

Defined results: a null text is the empty text, which is one piece (the end id alone);
rows of one document id, or rows without one, are packed as documents of their own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary, default_path, materialise, query, read, texts
from .subwords import ByteBpe, encoder

#: Shares of the fitted repeats that are tried; the plan with the fewest sequences is taken (0: best fit alone).
SHARES = (1.0, 0.9, 0.75, 0.5, 0.0)
#: Hashed shares in which the documents of one length are ranked.
BUCKETS = 256


def cut_pieces(docs: DataFrame, path: str, end_id: int, size: int,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and cut those of more than ``size`` ids; the first piece is the shorter one.

    Columns: doc_id, piece, start, length, ids (little-endian uint32).
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        enc = encoder(ByteBpe, path)
        for batch in batches:
            rows, piece, start, length, ids = [], [], [], [], []
            for k, text in enumerate(texts(batch.column(1))):
                data = enc.encode(text) + end
                n = len(data) // 4
                edges = [0, *range(n % size or size, n + 1, size)]
                for p, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append(k)
                    piece.append(p)
                    start.append(a)
                    length.append(b - a)
                    ids.append(data[4 * a:4 * b])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), binary(ids)],
                names=["doc_id", "piece", "start", "length", "ids"])

    return source.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids binary")


def exact_patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """All pairs and triples of ``lengths`` that add up to ``size``, ascending; column 0 is 0 for pairs."""
    there = np.zeros(size + 1, dtype=bool)
    there[lengths] = True
    lengths = np.sort(lengths)
    pairs = lengths[lengths <= size // 2]
    pairs = pairs[there[size - pairs]]
    out = [np.stack([np.zeros_like(pairs), pairs, size - pairs], axis=1)]
    for a in lengths[lengths <= size // 3]:
        b = lengths[(lengths >= a) & (lengths <= (size - a) // 2)]
        b = b[there[size - a - b]]
        out.append(np.stack([np.full_like(b, a), b, size - a - b], axis=1))
    return np.concatenate(out)


def fit_repeats(histogram: np.ndarray, patterns: np.ndarray) -> dict[int, float]:
    """Non-negative least squares by the active-set method: pattern -> repeats.

    What is left over weighs as much as the length is long, since a long piece that finds no
    partners costs a sequence and a short one fills a gap.  The gradient of every pattern is
    the weighted sum of what is left at its lengths.  The inverse
    of the active normal matrix is bordered as a pattern enters and reduced as one leaves.
    """
    rows = len(histogram)
    weight = np.arange(rows) / max(rows - 1, 1)
    goal = histogram * weight
    active: list[int] = []
    columns = np.zeros((rows, rows))
    inverse = np.zeros((rows, rows))
    x = np.zeros(0)
    least = max(0.02, 1e-4 * goal.max(initial=0.0))
    barred: set[int] = set()

    def column(k: int) -> np.ndarray:
        a = np.zeros(rows)
        np.add.at(a, patterns[k], weight[patterns[k]])
        return a

    def leave(at: int) -> None:
        nonlocal x
        p = len(active)
        keep = [i for i in range(p) if i != at]
        block = inverse[:p, :p]
        less = block[np.ix_(keep, keep)] - np.outer(block[keep, at], block[at, keep]) / block[at, at]
        inverse[:p - 1, :p - 1] = less
        columns[:, at:p - 1] = columns[:, at + 1:p].copy()
        active.pop(at)
        x = np.delete(x, at)

    while len(patterns) and len(active) < rows - 1:
        p = len(active)
        left = goal - columns[:, :p] @ x
        gradient = (left * weight)[patterns].sum(axis=1)
        if barred:
            gradient[list(barred)] = 0.0
        k = int(gradient.argmax())
        if gradient[k] <= least:
            break
        a = column(k)
        cross = columns[:, :p].T @ a
        u = inverse[:p, :p] @ cross
        schur = float(a @ a - cross @ u)
        if schur < 1e-9:  # numerically in the span of the active ones
            barred.add(k)
            continue
        inverse[:p, :p] += np.outer(u, u) / schur
        inverse[:p, p] = inverse[p, :p] = -u / schur
        inverse[p, p] = 1.0 / schur
        columns[:, p] = a
        active.append(k)
        x = np.append(x, 0.0)
        while active:
            p = len(active)
            best = inverse[:p, :p] @ (columns[:, :p].T @ goal)
            if best.min() > 1e-9:
                x = best
                break
            low = np.flatnonzero(best <= 1e-9)
            step = min(1.0, float(np.min(x[low] / np.maximum(x[low] - best[low], 1e-12))))
            x = np.maximum(x + step * (best - x), 0.0)
            gone = [i for i in low if x[i] <= 1e-9] or [int(low[x[low].argmin()])]
            if len(active) - 1 in gone and len(gone) == 1 and step <= 0.0:
                barred.add(active[-1])
            for i in sorted(gone, reverse=True):
                leave(i)
        else:
            x = np.zeros(0)
    return dict(zip(active, x))


def pack_rest(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over counts: (lengths of a sequence, how many such sequences)."""
    gaps: dict[int, list[list]] = defaultdict(list)  # gap -> [lengths, count]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            gap = min((g for g in gaps if g >= length and gaps[g]), default=None)
            if gap is None:
                gaps[size].append([(), -(-left // (size // length))])
                continue
            run = gaps[gap][-1]
            n = min(left, run[1])
            run[1] -= n
            if not run[1]:
                gaps[gap].pop()
            gaps[gap - length].append([run[0] + (length,), n])
            left -= n
    return [(tuple(lengths), n) for runs in gaps.values() for lengths, n in runs if lengths]


def plan_sequences(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Recipes (lengths in a sequence, number of such sequences) that use up ``counts`` exactly."""
    left = Counter({k: n for k, n in counts.items() if n})
    recipes = [((size,), left.pop(size))] if left.get(size) else []
    histogram = np.zeros(size + 1)
    for k, n in left.items():
        histogram[k] = n
    patterns = exact_patterns(np.array(sorted(left), dtype=np.int64), size)
    fitted = sorted(fit_repeats(histogram, patterns).items(), key=lambda kv: (-kv[1], kv[0]))
    plans = (recipes + fill_patterns(dict(left), patterns, fitted, share, size) for share in SHARES)
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def fill_patterns(left: dict[int, int], patterns: np.ndarray, fitted, share: float, size: int):
    """Recipes for a share of the fitted repeats, rounded down and cut to what is there, and for the rest."""
    recipes = []
    for k, repeats in fitted:
        lengths = tuple(int(v) for v in patterns[k][::-1] if v)
        need = Counter(lengths)
        n = min([int(repeats * share + 1e-6), *(left[v] // m for v, m in need.items())])
        if n > 0:
            recipes.append((lengths, n))
            for v, m in need.items():
                left[v] -= n * m
    return recipes + pack_rest({k: n for k, n in left.items() if n}, size)


def slots(recipes: list[tuple[tuple[int, ...], int]], size: int):
    """The plan by length: where each length's slots begin, then their first rank, sequence and offset."""
    by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    first = 0
    for lengths, n in recipes:
        at = 0
        for length in lengths:
            by[length].append((n, first, at))
            at += length
        first += n
    starts = np.zeros(size + 2, dtype=np.int64)
    ranks, sequences, offsets = [], [], []
    for length in range(size + 1):
        rank = 0
        for n, sequence, at in by[length]:
            ranks.append(rank)
            sequences.append(sequence)
            offsets.append(at)
            rank += n
        starts[length + 1] = len(ranks)
    return starts, np.array(ranks, dtype=np.int64), np.array(sequences, dtype=np.int64), np.array(offsets, dtype=np.int64)


def share_of(key: str):
    """The share of its length in which a piece is ranked."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def place(pieces: DataFrame, size: int, key: str) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (with a column ``length`` from 1 to ``size``).

    ``key`` tells the pieces apart, also those of equal documents, and so deals them evenly.
    """
    share = share_of(key)
    shared = pieces.withColumn("share", share)
    counted = shared.groupBy("length", "share").count().collect()  # at most size * BUCKETS rows
    table = np.zeros((size + 1, BUCKETS), dtype=np.int64)
    for r in counted:
        table[r["length"], r["share"]] = r["count"]
    before = np.cumsum(table, axis=1) - table
    totals = {k: int(n) for k, n in enumerate(table.sum(axis=1)) if n}
    plan = pieces.sparkSession.sparkContext.broadcast((before, *slots(plan_sequences(totals, size), size)))
    ranked = shared.withColumn("rank", F.row_number().over(Window.partitionBy("length", "share").orderBy(key)))
    names = [f.name for f in pieces.schema]
    at_length, at_share, at_rank = (ranked.columns.index(c) for c in ("length", "share", "rank"))

    def assign(batches):
        before, starts, ranks, sequences, offsets = plan.value
        for batch in batches:
            length = batch.column(at_length).to_numpy()
            rank = before[length, batch.column(at_share).to_numpy()] + batch.column(at_rank).to_numpy() - 1
            slot = np.empty(len(length), dtype=np.int64)
            for k in np.unique(length):
                own = length == k
                a, b = starts[k], starts[k + 1]
                slot[own] = a + np.searchsorted(ranks[a:b], rank[own], side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(sequences[slot] + rank - ranks[slot]),
                 pa.array(offsets[slot])], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(assign, f"{schema}, sequence_id long, offset long")


def packed_sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids: the token ids of every sequence, for pieces with ids."""
    joined = placed.select("piece_id", "sequence_id", "offset").join(pieces.select("piece_id", "ids", "length"), "piece_id")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), parts.alias("parts")).select(
        "sequence_id", "n_tokens",
        F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, size: int = 1024,
                   id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pieces with their ids, the pieces' places): encode, cut, plan and place all ``docs``.

    Both have ``piece_id``, a number of the piece's own, since document ids may repeat or be null.
    """
    pieces = cut_pieces(docs, path, end_id, size, id_col, text_col).withColumn("piece_id", F.monotonically_increasing_id())
    pieces = materialise(pieces, "pieces")
    light = pieces.select("piece_id", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pieces, place(light, size, "piece_id")


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of ``documents`` with its sequence and place there."""
    _, placed = pack_documents(read(spark, sf_dir, "documents", "doc_id", "text"), default_path("byte_bpe_50k.json"))
    return placed.drop("piece_id")
