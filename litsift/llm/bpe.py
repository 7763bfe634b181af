"""Byte-level BPE encoding and decoding.

A piece of text is encoded without running its merges. Its bytes, read as Latin-1
characters, go through an Aho-Corasick automaton of the vocabulary, which yields the longest
token that starts at a place. From the left, the longest token is taken that is compatible with
the token before it; where no token fits, the last one is given up for the next shorter one,
and the place is marked as dead. Two tokens are compatible if merging their joined bytes
gives just these two; this is remembered for each pair. A sequence whose neighbours are all
compatible is the one that the merges produce, and each place is left for dead only once. A
search sees no more of a piece than the longest token has bytes, so the work is linear in
the piece's length.

Defined results: a null text is empty (no ids). Texts of any length are encoded whole. Other
columns are not read.
"""

from __future__ import annotations

import base64
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsift.llm.common import Memo, groups, lists, map_arrow, once

#: Characters up to this one are split by a pattern with their letters and digits written out; texts with others by the pattern as given.
LAST = 0x24F
#: Pieces, and pairs of tokens, in each of the two generations of a worker's memos.
PIECES, PAIRS = 250_000, 500_000
#: More than any token's rank.
PAIR = 1 << 20
PLAIN = re.compile("[\t-\r -~\xa1-\u024f]*")


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as f:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks are not gapless")
    return [t for _, t in ranked]


class BPE:
    """Encoder and decoder for tokens given by rank."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import ahocorasick

        self.tokens = tokens
        self.size = [len(t) for t in tokens]
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.longest = max(self.size)
        self.plain = _written_out(pattern)
        self.shorter = Memo(self._shorter)
        #: left * PAIR + right -> whether the two may be neighbours.
        self.fits = Memo(self._compatible, PAIRS)
        self.memo = Memo(self._packed, PIECES)

    def merge(self, data: bytes) -> list[int]:
        """The merges themselves, for a few bytes: the lowest-ranked neighbours first."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, len(self.rank)) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == len(self.rank):
                break
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def _shorter(self, token: int) -> int | None:
        """The longest token that a token begins with, but for itself."""
        data = self.tokens[token]
        return next((self.rank[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.rank), None)

    def _compatible(self, pair: int) -> bool:
        left, right = divmod(pair, PAIR)
        return self.merge(self.tokens[left] + self.tokens[right]) == [left, right]

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        text, n = data.decode("latin-1"), len(data)
        size, shorter, fits, reach = self.size, self.shorter, self.fits, self.longest
        if n <= reach:
            search = self.automaton.iter_long
        else:  # a search costs time in proportion to the string that it is given
            search = lambda text, at: self.automaton.iter_long(text[at:at + reach])
        # The longest tokens one after the other, as far as each fits the one before it. Each
        # byte is a token, so they leave no gap.
        taken, at, last = [], 0, None
        for _, token in self.automaton.iter_long(text):
            if last is not None and not fits[last * PAIR + token]:
                break
            taken.append(token)
            at += size[token]
            last = token
        if at == n:
            return taken
        dead = set()
        while at < n:
            while token is not None:
                end = at + size[token]
                if end not in dead and (last is None or fits[last * PAIR + token]):
                    break
                token = shorter[token]
            if token is not None:
                taken.append(token)
                at, last = end, token
                token = next(search(text, at))[1] if at < n else None
            else:
                if not taken:
                    raise ValueError("a byte is missing in the vocabulary")
                dead.add(at)
                token = taken.pop()
                at -= size[token]
                last = taken[-1] if taken else None
                token = shorter[token]
        return taken

    def _packed(self, piece: str) -> bytes:
        found = self.piece(piece.encode())
        return struct.pack(f"<{len(found)}i", *found)

    def packed(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        pieces = self.plain(text) if self.plain and PLAIN.fullmatch(text) else self.pattern.findall(text)
        return b"".join(map(self.memo.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()


def _written_out(pattern: str):
    """Finds all pieces of a text of PLAIN characters, faster than by properties; None if the
    pattern knows other ones than letters and digits."""
    kinds = {k: "".join(re.escape(c) for c in map(chr, range(LAST + 1)) if unicodedata.category(c)[0] == k) for k in "LN"}
    inside = lambda part: re.sub(r"\\p\{([LN])\}", lambda m: kinds[m[1]], part)
    pattern = re.sub(r"\[[^\]]*\]|\\p\{[LN]\}", lambda m: inside(m[0]) if m[0][0] == "[" else f"[{inside(m[0])}]", pattern)
    try:
        return re.compile(pattern).findall
    except re.error:
        return None


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _encoder(path: str, pattern: str) -> BPE:
    return BPE(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids: the token ids of every row of ``docs(doc_id, text)``; with ``decoded``
    also the bytes that these ids stand for, in the same pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = once(_encoder, path, pattern), once(_bytes, path) if decoded else None
        for batch in groups(batches):
            found = [bpe.packed(t or "") for t in _column(batch, "text").to_pylist()]
            ids = lists(np.frombuffer(b"".join(found), "<i4"), np.array([len(x) // 4 for x in found]), pa.int32())
            columns = [_column(batch, "doc_id"), ids, *([known.decoded(ids)] if decoded else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][:len(columns)])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                     "doc_id long, ids array<int>" + ", decoded binary" * decoded)


class Bytes:
    """The bytes of all tokens in one run."""

    def __init__(self, tokens: list[bytes]):
        self.run = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens])
        self.start = np.cumsum(self.size) - self.size

    def decoded(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids, gathered for all lists at once."""
        flat, at = ids.values.to_numpy(), ids.offsets.to_numpy()
        flat, at = flat[at[0]:at[-1]], at - at[0]
        size = self.size[flat]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.run[np.repeat(self.start[flat] - ends[:-1], size) + np.arange(ends[-1])]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends[at].astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _bytes(path: str) -> Bytes:
    return Bytes(read_ranks(path))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` (binary) to ``encoded(doc_id, ids)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = once(_bytes, path)
        for batch in batches:
            ids = _column(batch, "ids")
            yield pa.RecordBatch.from_arrays([_column(batch, "doc_id"), ids, known.decoded(ids)], names=["doc_id", "ids", "decoded"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
