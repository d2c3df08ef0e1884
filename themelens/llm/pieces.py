"""SentencePiece encoding and decoding: merge-type pieces by a prefix table.

For every prefix of a text the merge encoder has exactly one last token.  The table is
filled from left to right: the automaton lists the pieces that end at a position, and the
piece is the last token there if the pair (last token of the prefix before it, piece) is
compatible, that is if the merge rule applied to the two pieces' text gives just these
two.  The ids are then recovered backwards through the table.

Texts are cut first where no merge can reach: around line feeds (no piece holds one) and
before a run of spaces (no piece has a space mark after another letter).  Pieces that are
runs of space marks share one score, the lowest of all, so they are merged last, leftmost
first; the run before a word is settled after the word.  Chunk ids are kept in a bounded
cache.  Letters that are no piece become their bytes' pieces.

Defined results: a null text is the empty text, with no ids and an empty decoded text;
every row is encoded for itself, so repeated rows and null document ids don't matter; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import default_path, query, read, texts
from .subwords import Chunks, encoder, pack_ids

MARK = "▁"  # stands for a space in pieces
CHUNK = re.compile(r" *[^ ]+| +")
#: Words kept in a worker; a full cache stops growing, it is never a limit on results.
CACHE_WORDS = 500_000
#: Compatibility answers kept in a worker; a full cache is emptied.
PAIRS = 600_000


class Words(dict):
    """Word -> id bytes, for words after ``before``; a closing mark is taken off a word that isn't known."""

    def __init__(self, pieces: "MergePieces", before: str):
        self.pieces, self.before = pieces, before

    def __missing__(self, word: str) -> bytes:
        close = self.pieces.closing.get(word[-1])
        if close and word[-2:-1].isalpha():
            return self[word[:-1]] + close
        ids = pack_ids(self.pieces._chunk(self.before + word))
        if len(self) < CACHE_WORDS:
            self[word] = ids
        return ids


class MergePieces:
    """The pieces of one model file, their automaton and pair tests."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        self.surface: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.surface.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i):
                self.surface.append(b"")
            elif model.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
                self.surface.append(piece.replace(MARK, " ").encode())
        self.letters = {c for p in self.ids if len(p) == 1 for c in p}
        runs = [p for p in self.ids if len(p) > 1 and not p.strip(MARK)]
        lowest = min(self.scores.values())
        words = [s for p, s in self.scores.items() if len(p) > 1 and p.strip(MARK)]
        if (any(MARK in p.lstrip(MARK) or p.startswith(MARK * 2) and p.strip(MARK) or "\n" in p
                or not self.letters.issuperset(p) for p in self.ids)
                or len(set(words)) != len(words) or any(self.scores[p] != lowest for p in runs)
                or lowest in words):
            raise ValueError("a piece reaches across a space or a line, or scores are tied")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if p.strip(MARK) or len(p) == 1:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.text_of = {i: p for p, i in self.ids.items()}
        self.pairs: dict[int, bool] = {}
        self.runs: dict[int, list[int]] = {}
        self.closing = {c: pack_ids([self.ids[c]]) for c in ".,;:!?" if c in self.ids
                        and not any(a.isalpha() and b == c for q in self.ids for a, b in zip(q, q[1:]))}
        self.newline = pack_ids([self.byte_ids[10]])
        self.head, self.next = Words(self, ""), Words(self, " ")
        self.odd = Chunks(self._chunk)

    def merge(self, symbols: list[str]) -> list[str]:
        """The merge rule itself: the best-scored adjacent pair first, the leftmost of equals."""
        symbols, scores = list(symbols), self.scores
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                score = scores.get(symbols[k] + symbols[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def compatible(self, key: int, last: int, piece: int) -> bool:
        """Whether ``piece`` follows ``last`` (None: stands alone) in an encoding; kept under ``key``."""
        own = [self.text_of[piece]] if last is None else [self.text_of[last], self.text_of[piece]]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[key] = self.merge(list("".join(own))) == own
        return known

    def word(self, text: str) -> list[int]:
        """Ids of a text of known letters, by the prefix table."""
        last, size = [0] * (len(text) + 1), [0] * (len(text) + 1)
        answer, test = self.pairs.get, self.compatible
        for end, (piece, length) in self.automaton.iter(text):
            if not size[end + 1]:
                at = end + 1 - length
                key = (last[at] + 1) * 65536 + piece if at else piece
                known = answer(key)
                if known is None:
                    known = test(key, last[at] if at else None, piece)
                if known:
                    last[end + 1], size[end + 1] = piece, length
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def space_run(self, n: int) -> list[int]:
        """Ids of ``n`` space marks with no word attached: equal scores, so always the leftmost pair."""
        if n not in self.runs:
            size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
            queue = [(k, k + 1, 2) for k in range(n - 1)]  # in order, so already a heap
            while queue:
                left, right, both = heappop(queue)
                if not size[left] or not size[right] or size[left] + size[right] != both:
                    continue
                if after[left] != right:
                    continue
                size[left], size[right] = both, 0
                after[left] = after[right]
                if after[right] < n:
                    before[after[right]] = left
                for a, b in ((before[left], left), (left, after[left])):
                    if a >= 0 and b < n and MARK * (size[a] + size[b]) in self.ids:
                        heappush(queue, (a, b, size[a] + size[b]))
            if len(self.runs) > 10_000:
                self.runs.clear()
            self.runs[n] = [self.ids[MARK * k] for k in size if k]
        return self.runs[n]

    def _chunk(self, chunk: str) -> list[int]:
        word = chunk.lstrip(" ")
        spaces = len(chunk) - len(word)
        if not word:
            return self.space_run(spaces)
        text = MARK + word if spaces else word
        if self.letters.issuperset(text):
            ids = self.word(text)
        else:
            ids, known = [], ""
            for c in text:
                if c in self.letters:
                    known += c
                    continue
                ids += self.word(known) if known else []
                ids += [self.byte_ids[b] for b in c.encode()]
                known = ""
            ids += self.word(known) if known else []
        if spaces > 1 or spaces and ids[0] == self.ids[MARK]:
            alone = ids[0] == self.ids[MARK]
            return self.space_run(spaces - (not alone)) + ids[alone:]
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian uint32 bytes."""
        if not text:
            return b""
        out = []
        for k, line in enumerate(text.replace(MARK, " ").split("\n")):
            if k:
                out.append(self.newline)
            else:
                line = " " + line  # the space that is put before every text
            if "  " in line or line[-1:] == " ":
                out += map(self.odd.__getitem__, CHUNK.findall(line))
            elif line:
                head, *words = line.split(" ")
                if head:
                    out.append(self.head[head])
                out += map(self.next.__getitem__, words)
        return b"".join(out)

    def decode(self, ids) -> str:
        """The text of ids; the space put before the first piece is taken off again."""
        data = b"".join(map(self.surface.__getitem__, ids))
        return data[data[:1] == b" ":].decode("utf-8", "replace")


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded text of every row."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def encode(batches):
        enc = encoder(MergePieces, path)
        for batch in batches:
            ids = [enc.encode(t) for t in texts(batch.column(1))]
            values = np.frombuffer(b"".join(ids), dtype="<i4")
            ends = np.concatenate([[0], np.cumsum([len(b) // 4 for b in ids])]).astype(np.int32)
            plain = values.tolist()
            decoded = [enc.decode(plain[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array(decoded, pa.string())],
                names=["doc_id", "ids", "decoded"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(encode, f"doc_id {kind}, ids array<int>, decoded string")


@query("op4_pieces")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of ids and checksums of the ids and of the decoded text of every document."""
    encoded = encode_pieces(read(spark, sf_dir, "documents", "doc_id", "text"), default_path("piece_bpe_32k.model"))
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
