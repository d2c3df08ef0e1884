"""Byte-pair encoders with a bounded cache of chunk ids, for use inside tasks.

Both classes give exactly the ids of the ``tokenizers`` library for their file.  A
text is cut where no token can reach across (a lone space, or white space that the
encoder drops), and each chunk is looked up in a cache.  Misses are encoded by
``tiktoken`` with the vocabulary of the same file (merge order equals id order).
Texts outside the plain case (characters past Latin-1, unusual white space, text that
may spell a special token) are given to ``tokenizers`` whole.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

#: Chunks kept in a worker; a full cache stops growing, it is never a limit on results.
CACHE_CHUNKS = 300_000
#: What a text of the plain case doesn't hold: space runs, white space beside spaces,
#: other white space, the start of a special token, and the end mark used below.
UNUSUAL = ("  ", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f",
           "\x85", "\xa0", "<|", "\x00")


def _byte_letters() -> dict[str, int]:
    """Letter -> byte of the byte-level alphabet (printable bytes stand for themselves)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


def pack_ids(ids: list[int]) -> bytes:
    """Ids as little-endian uint32 bytes."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Chunks(dict):
    """chunk -> little-endian uint32 ids; misses go to ``encode``."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, chunk):
        ids = pack_ids(self.encode(chunk))
        if len(self) < CACHE_CHUNKS:
            self[chunk] = ids
        return ids


class ByteBpe:
    """Byte-level BPE whose chunks start at a space."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        letters = _byte_letters()
        vocab = json.load(open(path))["model"]["vocab"]
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items()}
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first = Chunks(self.fast.encode_ordinary)
        self.next = Chunks(lambda chunk: self.fast.encode_ordinary(" " + chunk))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian uint32 bytes."""
        if not text:
            return b""
        if text[0] == " " or text[-1] == " " or any(u in text for u in UNUSUAL) or not latin1(text):
            return pack_ids(self.whole.encode(text, add_special_tokens=False).ids)
        head, *chunks = text.split(" ")
        return self.first[head] + b"".join(map(self.next.__getitem__, chunks))


class WordBpe:
    """Lower-casing BPE with word-end tokens; white space is dropped."""

    END = "\x00"  # stands for the word-end suffix while a chunk is encoded

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.load(open(path))
        suffix = spec["model"]["end_of_word_suffix"]
        letters = _byte_letters()
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            ends = token.endswith(suffix) and token != suffix
            body = token[:-len(suffix)] if ends else token
            ranks[bytes(letters[c] for c in body) + (self.END.encode() if ends else b"")] = i
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})
        self.chunks = Chunks(self._chunk)
        self.vocabulary = self.whole.get_vocab_size()

    def _chunk(self, chunk: str) -> list[int]:
        words = self.words.findall(chunk.lower())
        return self.fast.encode_ordinary("".join(w + self.END for w in words)) if words else []

    def encode(self, text: str) -> bytes:
        """Ids as little-endian uint32 bytes."""
        if any(u in text for u in UNUSUAL[6:]) or not latin1(text):
            return pack_ids(self.whole.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.chunks.__getitem__, text.split()))


@lru_cache(maxsize=4)
def encoder(kind: type, path: str):
    """One encoder per worker process and file."""
    return kind(path)
