"""Line dedup: segment-partition edit join over the distinct lines of a corpus.

Two lines of at least ``WORDS`` words each are alike if the words that have to be inserted,
deleted or replaced to turn one into the other are at most the cube root of the shorter
one's number of words, less one: 2 from 27 words on, 3 from 64, 9 from 1000.  Two others are
alike if that holds of at most ``edits`` bytes, and no more than a tenth of the shorter
line's.  Alike lines form classes (connected components); of each class the first line of the
corpus stays and all its other occurrences are removed from their texts.  Exact copies belong
to their line's class.

A line is cut into as many segments as the edits allowed and one more; an alike line must
hold one of them unchanged.  Segments (of words, or of bytes) are indexed under (line length,
segment number, hash), and every line probes the lengths from its own down, as far as edits
allow, with only those substrings whose place allows the other segments to match
(multi-match-aware selection).  There are about a third as many of these as the cube of the
edits, so with their cube root a line's keys grow no faster than its words.  Keys met by two lines give
candidates.  A key that very many lines meet is split into blocks that are compared
pairwise.  Candidates are verified with a banded bit-parallel edit distance, after common
ends and a bound by counts of letters or words; lines already connected in a group are not compared again,
and only a spanning forest leaves the task.

Texts are shuffled compressed.  The order of occurrences is: document ids before null,
then by id, hash of the text, and line number.

Defined results: lines without a word are never alike and always stay; a null text stays
null and has no lines; an empty text stays; rows that share id and text are one document
and keep the same lines; an empty table gives no rows; other columns are carried along
by ``dedup_documents`` and ignored by ``dedup_lines``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, materialise, query, read
from .components import connected_components

EDITS = 2
#: A line allows one edit for so many of its bytes.
BYTES_AN_EDIT = 10
#: Lines of so many words are compared by words.
WORDS = 27
#: Word counts whose segments a task remembers.
KNOWN_COUNTS = 1024
#: Lines of one key that are compared with each other in one block.
BLOCK = 512
#: Distinct lines that a task remembers so as not to send their keys twice.
SEEN = 200_000
#: Bytes of lines that are hashed at a time, about.
KEY_BYTES = 1 << 19
#: Keys in one Arrow batch: they are small.
KEY_ROWS = 10_000
#: Odd numbers that spread the bits of a key.
BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: What each byte stands for in a key.
BYTE_VALUES = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)
#: Members of a group up to which pairs are met one by one.
FEW = 8


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of the ``edits + 1`` segments of lines of one length; the longer ones come last."""
    n = edits + 1
    short = n - length % n
    out, at = [], 0
    for k in range(n):
        size = length // n + (k >= short)
        out.append((at, size))
        at += size
    return out


class Plan:
    """The keys of all lines of one length: parts between two ``places``, under ``seed``; ``probe`` is 0 for an index key."""

    def __init__(self, rows: list[tuple[int, int, int, bool]]):
        self.places = [np.array([row[k] for row in rows], dtype=np.int64) for k in (0, 1)]
        self.count = len(rows)
        self.seed = np.array([row[2] for row in rows], dtype=np.uint64) * SPREAD
        self.probe = np.array([not row[3] for row in rows], dtype=np.uint64)


def byte_plan(n: int, edits: int, plans: dict) -> Plan:
    """The keys of lines of ``n`` bytes, at byte positions."""
    plan = plans.get(n)
    if plan is None:
        rows = []
        for length in range(n, n - edits - 1, -1):
            more = n - length
            for k, (start, size) in enumerate(segments(length, edits)):
                low = max(start - k, start + more - (edits - k), 0)
                high = min(start + k, start + more + (edits - k), n - size)
                seed = length * 64 + k
                rows += [(p, p + size, seed, not more and p == start) for p in range(low, high + 1)]
        if len(plans) > 5000:
            plans.clear()
        plan = plans[n] = Plan(rows)
    return plan


def word_edits(n):
    """Words that may differ in lines of ``n`` words (a number or an array)."""
    return (np.cbrt(n) + 1e-9).astype(int) - 1


def word_plan(n: int, plans: dict) -> Plan:
    """The keys of lines of ``n`` words, at positions counted in words."""
    plan = plans.get(n)
    if plan is None:
        rows = []
        for length in range(n, WORDS - 1, -1):
            more, edits = n - length, int(word_edits(length))
            if more > edits:
                break
            for k, (start, size) in enumerate(segments(length, edits)):
                low = max(start - k, start + more - (edits - k), 0)
                high = min(start + k, start + more + (edits - k), n - size)
                seed = (1 << 48) + (length << 16) + k
                rows += [(p, p + size, seed, not more and p == start) for p in range(low, high + 1)]
        plan = Plan(rows)
        if n <= KNOWN_COUNTS:
            plans[n] = plan
    return plan


class Keys:
    """Hashes of the planned parts of lines, some ``KEY_BYTES`` of lines at a time by whole columns.

    A byte stands for a random number, and a part for the sum of its numbers times the powers of an odd
    base, which is a difference of running totals, moved to the part's own place by a power of the base's
    inverse.  A key's lowest bit is 0 for an index key and 1 for a probe key.  ``by_word``: plans count in
    words, and every word of a line ends with a space.
    """

    def __init__(self, by_word: bool):
        self.by_word = by_word
        self.powers = self.inverse = np.ones(1, dtype=np.uint64)
        self.clear()

    def clear(self):
        self.lines, self.plans, self.digests, self.sizes, self.size = [], [], [], [], 0

    def add(self, line: bytes, plan: Plan, size: int, digest: bytes = b"") -> None:
        """A line of ``size`` words or bytes."""
        self.lines.append(line)
        self.plans.append(plan)
        self.digests.append(digest)
        self.sizes.append(size)
        self.size += len(line)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys of the lines added since the last call, line by line, and the first half of each one's digest."""
        if len(self.powers) <= self.size:
            n = 2 * self.size
            self.powers, self.inverse = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x)])) for x in (
                BASE, np.uint64(pow(int(BASE), -1, 1 << 64))))
        body = np.frombuffer(b"".join(self.lines), dtype=np.uint8)
        totals = np.zeros(self.size + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[body] * self.powers[:self.size], out=totals[1:])
        counts = [p.count for p in self.plans]
        first = np.repeat(np.cumsum([0, *self.sizes[:-1]]), counts)
        start, end = (first + np.concatenate([p.places[k] for p in self.plans]) for k in (0, 1))
        if self.by_word:
            begins = np.concatenate([[0], np.flatnonzero(body == 32) + 1])
            start, end = begins[start], begins[end]
        found = (totals[end] - totals[start]) * self.inverse[start] + np.concatenate([p.seed for p in self.plans])
        found = (found ^ (found >> np.uint64(29))) * SPREAD
        found = (found ^ (found >> np.uint64(32))) * BASE
        found = (found & ~np.uint64(1)) | np.concatenate([p.probe for p in self.plans])
        h1 = np.repeat(np.frombuffer(b"".join([d[:8] for d in self.digests]), dtype="<i8"), counts) if self.digests[0] else None
        self.clear()
        return found.view(np.int64), h1


def parted(keys: np.ndarray) -> tuple[list[int], list[int]]:
    """(index keys, probe keys) without their lowest bit."""
    probe = (keys & 1).astype(bool)
    return (keys[~probe] >> 1).tolist(), (keys[probe] >> 1).tolist()


def keys_of(line: bytes, edits: int, plans: dict) -> tuple[list[int], list[int]]:
    """(index keys, probe keys) of a line."""
    keys = Keys(False)
    keys.add(line, byte_plan(len(line), edits, plans), len(line))
    return parted(keys.take()[0])


def word_keys(words: list[bytes], plans: dict) -> tuple[list[int], list[int]]:
    """(index keys, probe keys) of a line of at least ``WORDS`` words, by runs of its words."""
    keys = Keys(True)
    keys.add(b" ".join(words) + b" ", word_plan(len(words), plans), len(words))
    return parted(keys.take()[0])


def common_start(a: bytes, b: bytes) -> int:
    m = min(len(a), len(b))
    differ = int.from_bytes(a[:m], "big") ^ int.from_bytes(b[:m], "big")
    return m - (differ.bit_length() + 7) // 8


def within(a: bytes, b: bytes, most: int) -> bool:
    """Whether the edit distance of two byte strings is at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return False
    at = common_start(a, b)
    a, b = a[at:], b[at:]
    m = min(len(a), len(b))
    differ = int.from_bytes(a[len(a) - m:], "little") ^ int.from_bytes(b[len(b) - m:], "little")
    end = m - (differ.bit_length() + 7) // 8
    if end:
        a, b = a[:-end], b[:-end]
    return without_common_ends(a, b, most)


def within_words(a: list[bytes], b: list[bytes], most: int) -> bool:
    """Whether the edit distance of two lists of words is at most ``most``."""
    start, end = 0, 0
    m = min(len(a), len(b))
    while start < m and a[start] == b[start]:
        start += 1
    while end < m - start and a[-1 - end] == b[-1 - end]:
        end += 1
    return without_common_ends(a[start:len(a) - end], b[start:len(b) - end], most)


def without_common_ends(a, b, most: int) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if not b or len(a) <= most:
        return max(len(a), len(b)) <= most
    if most == 0:
        return False
    return banded(a, b, most) <= most


def banded(a, b, most: int) -> int:
    """Edit distance up to ``most`` (more: any number above it), for ``len(a) >= len(b)`` and ``len(a) > most``.

    Bit-parallel along a diagonal band: bit ``width - 1`` of a word is the row ``most`` below
    the diagonal; the words move down a row with every column.
    """
    if len(a) - len(b) > most:
        return most + 1
    width = 2 * most + 2
    full = (1 << width) - 1
    where: dict = {}
    for r, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << r
    below = (full >> (most + 1)) ^ full
    vp, vn, distance = below, 0, most
    bottom, across = 1 << (width - 1), 1 << (width - 2)
    turn = len(a) - most  # from this column on the band's bottom has left the rows
    for j, c in enumerate(b):
        start = j + most - (width - 1)
        rows = where.get(c, 0)
        match = (rows >> start if start >= 0 else rows << -start) & full
        d0 = (((match & vp) + vp) ^ vp | match | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if j < turn:
            distance += not d0 & bottom
        else:
            distance += bool(hp & across)
            distance -= bool(hn & across)
            across >>= 1
        if distance > 2 * most + 1:
            return most + 1
        vn = (d0 >> 1) & hp
        vp = (hn | ~((d0 >> 1) | hp)) & full
    return distance


class Forest:
    """Union-find over the members of one group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x


def alike(a: bytes, b: bytes, edits: int) -> bool:
    """Whether two lines are alike."""
    x, y = a.split(), b.split()
    fewer = min(len(x), len(y))
    if fewer >= WORDS:
        most = int(word_edits(fewer))
        return abs(len(x) - len(y)) <= most and within_words(x, y, most)
    most = min(edits, min(len(a), len(b)) // BYTES_AN_EDIT)
    return within(a, b, most)


def compare_few(own, nodes, parts, index, lines, two_blocks: bool, edits: int, known: dict) -> list[tuple[int, int]]:
    """``compare_group`` for the few members ``own``: each pair that isn't known is compared at once."""
    forest, links = Forest(len(own)), []
    for r, x in enumerate(own):
        for s in range(r + 1, len(own)):
            y = own[s]
            if not (index[x] or index[y]) or two_blocks and parts[x] == parts[y]:
                continue
            a, b = forest.root(r), forest.root(s)
            if a == b:
                continue
            pair = (nodes[x], nodes[y])
            same = known.get(pair)
            if same is None:
                same = alike(lines[x], lines[y], edits)
                known[pair] = same
                if len(known) > 100_000:
                    known.clear()
            if same:
                forest.up[b] = a
                links.append(pair)
    return links


def compare_group(nodes, parts, index, lines, two_blocks: bool, edits: int, known: dict) -> list[tuple[int, int]]:
    """Forest of the alike pairs of a group, at least one of each pair being indexed under the key."""
    first: dict[int, int] = {}
    for k, node in enumerate(nodes):  # a node may probe a key more than once
        if node not in first or index[k]:
            first[node] = k
    own = sorted(first.values(), key=lambda k: nodes[k])
    if len(own) <= FEW:
        return compare_few(own, nodes, parts, index, lines, two_blocks, edits, known)
    sizes, words = np.array([len(lines[k]) for k in own]), [lines[k].split() for k in own]
    counts = np.array([len(w) for w in words])
    letters, bags = (np.zeros((len(own), 32), dtype=np.int32) for _ in range(2))
    for r, k in enumerate(own):
        letters[r] = np.bincount(np.frombuffer(lines[k], dtype=np.uint8) & 31, minlength=32)
        if counts[r] >= WORDS:
            bags[r] = np.bincount([hash(w) & 31 for w in words[r]], minlength=32)
    forest, links = Forest(len(own)), []
    part, is_index = np.array([parts[k] for k in own]), np.array([index[k] for k in own], dtype=bool)
    for r in range(len(own) - 1):
        fewer = np.minimum(counts[r + 1:], counts[r])
        by_word = fewer >= WORDS
        most = np.where(by_word, word_edits(fewer), np.minimum(edits, np.minimum(sizes[r + 1:], sizes[r]) // BYTES_AN_EDIT))
        more = np.where(by_word, np.abs(counts[r + 1:] - counts[r]), np.abs(sizes[r + 1:] - sizes[r]))
        near = (more <= most) & (is_index[r] | is_index[r + 1:])
        if two_blocks:
            near &= part[r + 1:] != part[r]
        left = np.flatnonzero(near)
        mine, others = np.where(by_word[left, None], bags[r], letters[r]), np.where(
            by_word[left, None], bags[r + 1:][left], letters[r + 1:][left])
        near[left] = np.abs(others - mine).sum(axis=1) <= 2 * most[left]
        for s in (np.flatnonzero(near) + r + 1).tolist():
            a, b = forest.root(r), forest.root(s)
            if a == b:
                continue
            x, y = own[r], own[s]
            pair = (nodes[x], nodes[y])
            same = known.get(pair)
            if same is None:
                bound = int(most[s - r - 1])
                same = within_words(words[r], words[s], bound) if by_word[s - r - 1] else within(lines[x], lines[y], bound)
                known[pair] = same
                if len(known) > 100_000:
                    known.clear()
            if same:
                forest.up[b] = a
                links.append(pair)
    return links


def words_in(line: bytes) -> bool:
    return bool(line.strip(b" \t\n\r\x0b\x0c"))


def keyed(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """no_id, doc, key, text (what the occurrences of lines are known and ordered by) and ``more``."""
    return docs.select(F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc"),
                       F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("key"), F.col(text_col).alias("text"), *more)


OWNER = ["no_id", "doc", "key"]
OWNER_TYPE = "no_id boolean, doc long, key long"


def compressed(rows: DataFrame) -> DataFrame:
    """The text column as zstd bytes (null stays null)."""
    names = rows.columns
    at = names.index("text")

    def squeeze(batches):
        import zstandard
        squeezer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            body = binary([None if t is None else squeezer.compress(t.encode()) for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([body if k == at else batch.column(k) for k in range(len(names))], names=names)

    schema = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(squeeze, schema)


def occurrences(rows: DataFrame) -> DataFrame:
    """h1, h2 (128-bit hash of the line), its owner and line number, for every line with a word."""

    def split(batches):
        from xxhash import xxh3_128_digest as xxh
        for batch in batches:
            digest, owner, number = [], [], []
            for k, text in enumerate(batch.column(3).to_pylist()):
                for n, line in enumerate((text or "").encode().split(b"\n")):
                    if words_in(line):
                        digest.append(xxh(line))
                        owner.append(k)
                        number.append(n)
            halves = np.frombuffer(b"".join(digest), dtype="<i8").reshape(-1, 2)
            owner = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])),
                 *(batch.column(c).take(owner) for c in range(3)), pa.array(number, pa.int32())],
                names=["h1", "h2", *OWNER, "line"])

    return rows.mapInArrow(split, f"h1 long, h2 long, {OWNER_TYPE}, line int")


def keys_batch(keys: Keys) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in keys.take()], names=["seg", "h1"])


def line_keys(rows: DataFrame, edits: int) -> DataFrame:
    """seg, h1: the index and probe keys of the lines long enough for an edit; the lowest bit of seg is 0 for an index key."""

    def emit(batches):
        from xxhash import xxh3_128_digest as xxh
        seen, plans, word_plans = set(), {}, {}
        by_byte, by_word = Keys(False), Keys(True)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for line in (text or "").encode().split(b"\n"):
                    if len(line) < BYTES_AN_EDIT:
                        continue
                    h = xxh(line)
                    if h in seen:
                        continue
                    words = line.split()
                    n = len(words)
                    if not n:
                        continue
                    if len(seen) < SEEN:
                        seen.add(h)
                    if n >= WORDS:
                        by_word.add(b" ".join(words) + b" ", word_plan(n, word_plans), n, h)
                        if by_word.size >= KEY_BYTES:
                            yield keys_batch(by_word)
                    if n < WORDS + edits:  # a byte is at most a word more
                        by_byte.add(line, byte_plan(len(line), edits, plans), len(line), h)
                        if by_byte.size >= KEY_BYTES:
                            yield keys_batch(by_byte)
        for keys in (by_byte, by_word):
            if keys.lines:
                yield keys_batch(keys)

    return rows.select("text").mapInArrow(emit, "seg long, h1 long")


def met_keys(keys: DataFrame) -> DataFrame:
    """seg, h1, index: the rows of keys that are indexed by a line and met by another one.

    An indexed line counts as probing its own key, so a key is of use once its first row is
    indexed and a second line turns up; a task keeps no more than that first row.  The lowest bit of a key
    sorts index rows first, so that rows are sorted by one number.
    """
    dealt = keys.repartition(F.shiftright("seg", 1)).sortWithinPartitions("seg")

    def stream(batches):
        last = None  # seg with its lowest bit and h1 of the open group's first row; whether it was sent
        for batch in batches:
            key, h1 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            carried = last is not None and last[0] >> 1 == key[0] >> 1
            if carried:  # the open group's first row comes before this batch's rows
                key, h1 = (np.concatenate([[v], c]) for v, c in zip(last[:2], (key, h1)))
            seg, index = key >> 1, key & 1 == 0
            starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(seg)]]))
            low, high = np.minimum.reduceat(h1, starts), np.maximum.reduceat(h1, starts)
            use = index[starts] & (low != high)
            sent = bool(carried and last[2])
            if sent:
                use[0] = True
            take = np.repeat(use, sizes)
            if sent:
                take[0] = False
            tail = starts[-1]
            last = (key[tail], h1[tail], bool(use[-1]))
            if take.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[take]) for c in (seg, h1, index)], names=["seg", "h1", "index"])

    return dealt.mapInArrow(stream, "seg long, h1 long, index boolean")


def alike_links(rows: DataFrame, distinct: DataFrame, edits: int) -> DataFrame:
    """Links (a, b) between nodes of ``distinct`` that connect all alike lines."""
    met = materialise(met_keys(line_keys(rows, edits)).distinct(), "keys", arrow_rows=KEY_ROWS)
    met = materialise(met.join(distinct.select("node", "h1", "first"), "h1").select("seg", "index", "node", "first"), "candidates")
    wanted = materialise(met.select("node", "first").distinct().groupBy(
        *[F.col(f"first.{c}").alias(c) for c in OWNER]).agg(
        F.collect_list(F.struct(F.col("first.line").alias("line"), "node")).alias("lines")), "wanted")

    def fetch(batches):
        import zstandard
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            node, line = [], []
            for body, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = expand.decompress(body).split(b"\n")
                for w in lines:
                    node.append(w["node"])
                    line.append(own[w["line"]])
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), binary(line)], names=["node", "bytes"])

    # always by shuffle: what is wanted grows with the corpus, and so the plan is the same at every size
    texts = compressed(rows).join(wanted.hint("merge"), OWNER).select("text", "lines")
    # rows of one id and text give their lines more than once
    lines = materialise(texts.mapInArrow(fetch, "node long, bytes binary").dropDuplicates(["node"]), "lines")
    counts = materialise(met.groupBy("seg").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "counts")
    part = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    blocks = met.select("seg", "index", "node").join(counts, "seg").withColumn("part", part).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.select("seg", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"),
                           "part", "index", "node").join(lines, "node")
    dealt = blocks.select("seg", "x", "y", "part", "index", "node", "bytes").repartition("seg", "x", "y").sortWithinPartitions(
        "seg", "x", "y", "node")

    def verify(batches):
        known, group, name = {}, [], None

        def close():
            if len(group) < 2:
                return []
            parts, index, nodes, lines = zip(*group)
            return compare_group(nodes, parts, index, lines, name[1] != name[2], edits, known)

        for batch in batches:
            links = []
            columns = [c.to_pylist() for c in batch.columns]
            for seg, x, y, part, index, node, line in zip(*columns):
                if (seg, x, y) != name:
                    links += close()
                    group, name = [], (seg, x, y)
                group.append((part, index, node, line))
            if links:
                yield links_batch(links)
        links = close()
        if links:
            yield links_batch(links)

    return dealt.mapInArrow(verify, "a long, b long")


def links_batch(links):
    a, b = zip(*links)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def removed_lines(rows: DataFrame, edits: int) -> DataFrame:
    """no_id, doc, key and the numbers of the lines to remove, for every document that loses any."""
    first = F.min(F.struct(*OWNER, "line")).alias("first")
    distinct = materialise(occurrences(rows).groupBy("h1", "h2").agg(first).withColumn(
        "node", F.monotonically_increasing_id()), "distinct")
    links = materialise(alike_links(rows, distinct, edits), "links")
    labels = connected_components(links)
    classed = materialise(labels.join(distinct, "node").select("label", "h1", "h2", "first"), "classed")
    heads = materialise(classed.groupBy("label").agg(F.min("first").alias("head")), "heads")
    linked = classed.join(heads, "label").select("h1", "h2", F.col("head").alias("keep"))
    alone = distinct.join(labels, "node", "left_anti").select("h1", "h2", F.col("first").alias("keep"))
    keep = materialise(linked.union(alone), "keep")
    gone = occurrences(rows).join(keep, ["h1", "h2"]).where(F.struct(*OWNER, "line") != F.col("keep"))
    return materialise(gone.groupBy(*OWNER).agg(F.collect_set("line").alias("gone")), "gone")


def cut_lines(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The columns of ``rows`` (text as zstd bytes) with ``text`` cut, and n_lines and n_removed."""
    joined = rows.join(gone, OWNER, "left")
    names = [c for c in rows.columns if c not in OWNER]
    joined = joined.select(*names, "gone")
    at = names.index("text")

    def cut(batches):
        import zstandard
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            text, n_lines, n_removed = [], [], []
            for body, gone in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                lines = [] if body is None else expand.decompress(body).split(b"\n")
                gone = set(gone or ())
                n_lines.append(sum(map(words_in, lines)))
                n_removed.append(len(gone))
                text.append(None if body is None else b"\n".join(
                    x for k, x in enumerate(lines) if k not in gone).decode())
            columns = [pa.array(text, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())],
                                             names=[*names, "n_lines", "n_removed"])

    schema = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}"
                       for f in rows.select(*names).schema)
    return joined.mapInArrow(cut, f"{schema}, n_lines long, n_removed long")


def dedup_lines(docs: DataFrame, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text without its removed lines, n_lines (with a word) and n_removed of every row."""
    rows = keyed(docs, id_col, text_col)
    own = keyed(docs, id_col, text_col, F.struct(F.col(id_col).alias("doc_id")).alias("row"))
    cut = cut_lines(compressed(own), removed_lines(rows, edits))
    return cut.select("row.doc_id", "text", "n_lines", "n_removed")


def dedup_documents(docs: DataFrame, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with their texts cut; their other columns are carried along."""
    gone = removed_lines(keyed(docs, id_col, text_col), edits)
    rows = keyed(docs, id_col, text_col, F.struct(*[c for c in docs.columns if c != text_col]).alias("row"))
    cut = cut_lines(compressed(rows), gone)
    return cut.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


#: Words: the furthest word reached on each diagonal with so many edits, for pairs that share nine words in a row, as alike ones do.
OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM d),
w AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
u AS MATERIALIZED (SELECT line, strlen(line) AS size, min((doc_id, n)) AS first, row_number() OVER (ORDER BY min((doc_id, n))) AS id,
             regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM w GROUP BY line),
x AS MATERIALIZED (SELECT id, size, line, len(words) AS count, list_transform(words, lambda v: hash(v)) AS words FROM u),
e1 AS (SELECT a.id AS x, b.id AS y FROM x a JOIN x b ON b.size BETWEEN a.size - 2 AND a.size + 2 AND a.id <> b.id
         AND a.size >= 10 AND b.size >= 10 AND least(a.count, b.count) < 27
       WHERE levenshtein(a.line, b.line) <= least(2, least(a.size, b.size) // 10)),
runs AS (SELECT id, count, unnest(list_transform(range(1, count - 7), lambda p: hash(words[p:p + 8]))) AS run FROM x WHERE count >= 27),
met AS (SELECT DISTINCT a.id AS x, b.id AS y, CAST(floor(cbrt(least(a.count, b.count)) + 1e-9) AS BIGINT) - 1 AS most
        FROM runs a JOIN runs b ON a.run = b.run AND a.id < b.id
        WHERE abs(a.count - b.count) <= floor(cbrt(least(a.count, b.count)) + 1e-9) - 1),
p AS MATERIALIZED (SELECT met.x, met.y, most, a.words AS a, b.words AS b FROM met JOIN x a ON a.id = met.x JOIN x b ON b.id = met.y),
far(x, y, edits, i, j) AS (
  SELECT x, y, 0, 0, 0 FROM p
  UNION
  SELECT DISTINCT x, y, edits + 1, i + step.i, j + step.j
  FROM (SELECT far.x, far.y, edits, most, len(a) AS la, len(b) AS lb,
               i + same AS i, j + same AS j, unnest([{i: 1, j: 1}, {i: 1, j: 0}, {i: 0, j: 1}]) AS step
        FROM (SELECT far.*, p.a, p.b, p.most, coalesce(list_position(list_transform(
                list_zip(p.a[far.i + 1:], p.b[far.j + 1:]), lambda z: z[1] IS DISTINCT FROM z[2]), true) - 1, len(p.a) - far.i) AS same
              FROM far JOIN p USING (x, y)) far) s
  WHERE edits < most AND NOT (i = la AND j = lb) AND i + step.i <= la AND j + step.j <= lb),
e2 AS (SELECT DISTINCT far.x, far.y FROM far JOIN p USING (x, y)
       WHERE len(a) - i = len(b) - j AND a[i + 1:] = b[j + 1:]),
e AS (SELECT * FROM e1 UNION ALL SELECT x, y FROM e2 UNION ALL SELECT y, x FROM e2),
r(id, label) AS (SELECT id, id FROM u UNION SELECT e.y, r.label FROM r JOIN e ON r.id = e.x AND r.label < e.y),
c AS (SELECT id, min(label) AS label FROM r GROUP BY id),
k AS (SELECT u.line, h.first AS keep FROM u JOIN c USING (id) JOIN u h ON h.id = c.label),
t AS (SELECT l.doc_id, l.n, l.line, k.keep IS NOT NULL AS counted, coalesce(k.keep <> (l.doc_id, l.n), false) AS gone
      FROM l LEFT JOIN k ON l.line = k.line)
SELECT doc_id, CAST(count(*) FILTER (WHERE counted) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM t GROUP BY doc_id
"""


@query("op3_line_dedup", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, removed lines and checksum of the kept text of every document."""
    found = dedup_lines(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
