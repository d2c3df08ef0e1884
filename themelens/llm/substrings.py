"""Repeated substrings: depth-limited ordering of suffixes by most-significant-digit passes.

Two positions match if their suffixes agree through ``length`` bytes.  The suffixes are
dealt to groups by one digit after the other, and a group of one leaves at every pass; the
groups that are left after the last digit are exactly the repeated windows.  Digits are
hashed, since only equality of suffixes matters, and chosen so that few suffixes have to
be sent:

1. The first digit of a window is its least ``gram``-byte string in hash order (leftmost of
   equals).  Neighbouring windows mostly share it, so it is sent once for a run of windows.
   Equal windows have equal first digits.  Strings that occur once leave.
2. The second digit is the whole stretch of bytes that a run of windows covers.  A stretch
   found twice is repeated with all its windows, and leaves as settled.
3. Where stretches of one first digit differ, the runs are taken apart at every sixteenth byte
   from the first digit's place on.  The third digit of such a part is what all windows there
   have in common; parts whose third digit occurs once leave, and of the others those whose
   whole stretch is found twice leave as settled.
4. The last digit is the window itself, through its last byte, for the parts that are left.

Of a stretch found twice, one copy stands for all in the passes after.

All passes count with partial sums and join written tables, so that a passage which many
documents share is split over tasks.  Texts are known by their content (hash and length):
equal texts get equal answers.  A text with two copies or more is repeated with all its
windows, so its copies are only counted; to the passes every task sends a text once, since
they have to tell other texts' windows alone.  The marked windows are gathered for each text
that has no copy, as a set, which its own length bounds.

Defined results: a null text is the empty text; a text shorter than ``length`` bytes keeps
all; repeated rows remove each other; null document ids are carried along; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, materialise, query, read, texts

GRAM = 40
#: Windows of a text that are laid out at a time (bounds memory); longer texts go on after them.
SEGMENT = 1 << 20
LOW = np.uint64((1 << 21) - 1)  # place of a gram in its segment
#: Windows of a part into which runs are taken apart.
PART = 16
#: Texts that a task remembers so as not to send their runs twice.
SEEN = 200_000
#: A run's place: start, then in BITS each its first digit's distance from the start and its number of windows.
BITS = 12
MOST = (1 << BITS) - 1


def placed(first, anchor, n):
    return first << 2 * BITS | (anchor - first) << BITS | n


class Rolling:
    """Hashes of all ``gram``-byte strings of a text, by sums of powers modulo 2 ** 64."""

    def __init__(self, length: int, gram: int):
        rng = np.random.default_rng(7)
        self.length, self.gram = length, gram
        self.letters = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = 0x9E3779B97F4A7C15
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def grams(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) <= n:
            size = 2 * n + 2
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b)]))
                                  for b in (self.base, self.inverse))
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.letters[data] * self.up[:n], out=sums[1:])
        h = (sums[self.gram:] - sums[:-self.gram]) * self.down[:n - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h

    def runs(self, data: bytes):
        """(first digit, first window, place of the digit, number of windows) of every run, in order of windows."""
        out = []
        span = self.length - self.gram + 1  # grams in a window
        for at in range(0, len(data) - self.length + 1, SEGMENT):
            part = np.frombuffer(data, dtype=np.uint8, offset=at, count=min(SEGMENT + self.length - 1, len(data) - at))
            h = self.grams(part)
            keys = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
            rows = np.full(-(-len(h) // span) * span, np.iinfo(np.uint64).max, dtype=np.uint64)
            rows[:len(h)] = keys
            rows = rows.reshape(-1, span)
            after = np.minimum.accumulate(rows, axis=1).reshape(-1)
            before = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
            windows = len(part) - self.length + 1
            least = np.minimum(before[:windows], after[span - 1:span - 1 + windows]) & LOW
            first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            anchor = least[first].astype(np.int64)
            out.append((h[anchor].view(np.int64), first + at, anchor + at, np.diff(np.concatenate([first, [windows]]))))
        return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, dtype=np.int64)] * 4


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and its key (hash and length)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn(
        "key", F.xxhash64("text")).withColumn("size", F.octet_length("text"))


def unseen(keys, sizes, seen: set) -> list[bool]:
    """Which texts are met for the first time by the task whose ``seen`` it is."""
    out = []
    for text in zip(keys.to_pylist(), sizes.to_pylist()):
        out.append(text not in seen)
        if len(seen) < SEEN:
            seen.add(text)
    return out


def repeated_windows(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, size, at): runs of repeated windows of each text without a copy, by their places; may repeat.

    Of texts with copies any of their runs may be there.
    """
    from xxhash import xxh3_64_intdigest as xxh

    rolling = Rolling(length, gram)
    long_enough = rows.where(F.col("size") >= length)

    def first_digits(batches):
        seen = set()
        for batch in batches:
            batch = batch.filter(pa.array(unseen(batch.column(1), batch.column(2), seen), pa.bool_()))
            if batch.num_rows:
                found = [rolling.runs(t.encode())[0] for t in texts(batch.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["digit"])

    def stretches(batches):
        seen = set()
        for batch in batches:
            batch = batch.filter(pa.array(unseen(batch.column(1), batch.column(2), seen), pa.bool_()))
            if not batch.num_rows:
                continue
            digit, second, owner, at = [], [], [], []
            for k, text in enumerate(texts(batch.column(0))):
                data = text.encode()
                d, first, anchor, n = rolling.runs(data)
                digit.append(d)
                at.append(placed(first, anchor, n))
                owner.append(np.full(len(d), k))
                second += [xxh(data[a:b]) for a, b in zip(first.tolist(), (first + n + length - 1).tolist())]
            owner = pa.array(np.concatenate(owner))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(digit)), pa.array(np.array(second, dtype=np.uint64).view(np.int64)),
                 batch.column(1).take(owner), batch.column(2).take(owner), pa.array(np.concatenate(at))],
                names=["digit", "second", "key", "size", "at"])

    digits = long_enough.select("text", "key", "size").mapInArrow(first_digits, "digit long")
    twice = materialise(digits.groupBy("digit").count().where("count > 1").select("digit"), "digits")
    runs = materialise(
        long_enough.select("text", "key", "size").mapInArrow(
            stretches, "digit long, second long, key long, size int, at long").join(twice, "digit"), "runs")
    groups = materialise(runs.groupBy("digit", "second").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "size", "at")).alias("one")), "stretches")
    settled = runs.join(groups.where("n > 1").select("digit", "second"), ["digit", "second"]).select("key", "size", "at")

    differ = materialise(groups.where("n = 1").select("digit").distinct(), "differ")
    step = min(PART, length)

    def part_rows(data, at):
        first, n = at >> 2 * BITS, at & MOST
        anchor = first + (at >> BITS & MOST)
        for k in range((anchor - first - n + 1) // step, (anchor - first) // step + 1):
            high = anchor - k * step
            low = high - step + 1
            a, b = max(first, low), min(first + n - 1, high)
            yield xxh(data[high:low + length]), xxh(data[a:b + length]), placed(a, anchor, b - a + 1)

    def window_rows(data, at):
        first = at >> 2 * BITS
        for a in range(first, first + (at & MOST)):
            yield xxh(data[a:a + length]), 0, placed(a, a, 1)

    def taken_apart(probes, rows_of, name):
        """digit, third, second, key, size, at, asks: what ``rows_of`` makes of the probed runs."""
        probes = materialise(probes.groupBy("key", "size").agg(F.collect_list("probe").alias("probes")), f"{name}-probes")

        def emit(batches):
            seen = set()
            for batch in batches:
                batch = batch.filter(pa.array(unseen(batch.column(2), batch.column(3), seen), pa.bool_()))
                digit, made, asks, owner = [], [], [], []
                for k, (text, wanted) in enumerate(zip(texts(batch.column(0)), batch.column(1).to_pylist())):
                    data = text.encode()
                    for probe in wanted:
                        own = list(rows_of(data, probe["at"]))
                        made += own
                        digit += [probe["digit"]] * len(own)
                        asks += [probe["asks"]] * len(own)
                        owner += [k] * len(own)
                third, second, at = zip(*made) if made else ((), (), ())
                owner = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digit, pa.int64()), *(pa.array(np.array(h, dtype=np.uint64).view(np.int64)) for h in (third, second)),
                     batch.column(2).take(owner), batch.column(3).take(owner), pa.array(at, pa.int64()),
                     pa.array(asks, pa.bool_())], names=["digit", "third", "second", "key", "size", "at", "asks"])

        found = long_enough.join(probes.hint("merge"), ["key", "size"]).select("text", "probes", "key", "size").mapInArrow(
            emit, "digit long, third long, second long, key long, size int, at long, asks boolean")
        return materialise(found, name)

    # what doesn't ask was found twice already, so it counts as two
    weight = F.sum(F.when(F.col("asks"), 1).otherwise(2)).alias("n")
    one, place = F.min(F.struct("key", "size", "at")).alias("one"), ["key", "size", "at"]
    probe = lambda of: of.select("one.key", "one.size", F.struct("one.at", "digit", (F.col("n") == 1).alias("asks")).alias("probe"))
    parts = taken_apart(probe(groups.join(differ, "digit")), part_rows, "parts")
    stretches_of = materialise(parts.groupBy("digit", "third", "second").agg(weight, one), "part-stretches")
    settled_parts = parts.where("asks").join(
        stretches_of.where("n > 1").select("digit", "third", "second"), ["digit", "third", "second"]).select(*place)
    unsettled = materialise(stretches_of.groupBy("digit", "third").agg(
        F.sum("n").alias("all"), F.min("n").alias("least")).where("all > 1 and least = 1").select("digit", "third"), "unsettled")
    single = taken_apart(probe(stretches_of.join(unsettled, ["digit", "third"])), window_rows, "windows")
    equal = materialise(single.groupBy("digit", "third").agg(weight).where("n > 1").select("digit", "third"), "equal")
    found = single.where("asks").join(equal, ["digit", "third"]).select(*place)
    return settled.union(settled_parts).union(found)


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = GRAM,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (start and end of every maximal removed run of bytes), kept (bytes)."""
    if not 0 < gram <= length <= MOST:
        raise ValueError("the gram must not be longer than the window, nor the window than a run's bits allow")
    rows = keyed(docs, id_col, text_col)
    # texts with copies are settled whole and need no marks, those without have one row for theirs
    copies = rows.where(F.col("size") >= length).groupBy("key", "size").count().where("count > 1")
    copies = materialise(copies.select("key", "size", F.lit(True).alias("copied")), "copies")
    marks = repeated_windows(rows, length, gram).groupBy("key", "size").agg(F.collect_set("at").alias("marks"))
    marks = marks.join(copies, ["key", "size"], "full").select(
        "key", "size", F.when(F.col("copied").isNull(), F.col("marks")).alias("marks"), "copied")
    marks = materialise(marks, "marks")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            spans, kept, sizes = [], [], []
            for text, marks, copied in zip(texts(batch.column(1)), batch.column(2), batch.column(3).to_pylist()):
                data = text.encode()
                sizes.append(len(data))
                own, rest, end = [], [], 0
                if copied:
                    own.append({"start": 0, "end": len(data)})
                    end = len(data)
                elif marks.is_valid:
                    at = np.sort(marks.values.to_numpy())
                    first = at >> 2 * BITS
                    last = np.maximum.accumulate(first + (at & MOST) + length - 1)
                    new = np.flatnonzero(np.concatenate([[True], first[1:] > last[:-1]]))
                    for a, b in zip(first[new].tolist(), last[np.concatenate([new[1:] - 1, [len(at) - 1]])].tolist()):
                        own.append({"start": a, "end": b})
                        rest.append(data[end:a])
                        end = b
                rest.append(data[end:])
                spans.append(own)
                kept.append(b"".join(rest))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), binary(kept)],
                names=["doc_id", "n_bytes", "spans", "kept"])

    joined = rows.join(marks, ["key", "size"], "left").select("doc_id", "text", "marks", "copied")
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


@query("op5_repeated_substrings")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the removal of repeated 200-byte strings leaves of every document."""
    found = remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"), length=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))
