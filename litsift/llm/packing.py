"""Harmonic packing of tokenised documents into sequences of CAPACITY tokens.

A class is a reciprocal of the capacity: class s holds pieces of s tokens, s being
CAPACITY // m for some m, and a bin of the class takes CAPACITY // s of them, no more and no
fewer. A document is cut, by its own length alone, into the largest class size that it
still fills, then the rest likewise: 4096s, then e.g. 2048, 372 and 28. Since all pieces of a
class are as long, a bin is full but for CAPACITY % s tokens, and a piece's bin and offset
follow from its number within the class. Numbers come from a count per task and class, so
workers fill bins independently of one another.

What is left over in the last, unfilled bin of each class is under one bin for each of the
fewer than 2 * sqrt(CAPACITY) classes, however many documents there are; these pieces go
first-fit, longest first, into shared sequences.

Defined results: a null text is empty and yields its end token alone; repeated rows and null
ids are packed like any others. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litsift.llm.common import Memo, groups, numbered, once

CAPACITY = 4096
END = 2
#: Marks that end a word, none of them part of a special token.
PUNCTUATION = ".,!?;:"
#: Up to this character, letters are composed and stay so in lower case, but for the dotted capital I.
LAST = 0x17F
#: Texts that no normalisation changes but for lower case: such letters, ASCII signs and blanks.
PLAIN = re.compile("[ \n\t!-~\xa1-\xac\xae-\u012f\u0131-\u017f]*")
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, size int"
OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def class_sizes(capacity: int = CAPACITY) -> list[int]:
    """The class sizes, ascending: the distinct capacity // m."""
    return sorted({capacity // m for m in range(1, capacity + 1)})


def cut(tokens: int, sizes: list[int]) -> list[int]:
    """Lengths of a document's pieces, in order; their sum is ``tokens``."""
    out = [sizes[-1]] * (tokens // sizes[-1])
    rest = tokens % sizes[-1]
    while rest:
        size = sizes[bisect_right(sizes, rest) - 1]
        out.append(size)
        rest -= size
    return out


class Tokens:
    """Token ids of a text as little-endian unsigned 32-bit integers.

    The vocabulary's file says how a text is split into pieces before its merges: letters,
    single digits and runs of other signs, in lower case. A text of PLAIN characters alone is
    split here by that pattern, its pieces are merged by the vocabulary's model and
    remembered. The words of any other text go to the library as they are; marks that end
    a word are only cut off where the library itself has shown, for the character before
    them, that it splits there too.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            self.pieces = _pieces(json.load(f))
        # Byte-level vocabularies write bytes that aren't printable as letters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.merged = Memo(self._merge)
        self.words = Memo(self._word)
        self.closes = Memo(self._closes)

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merge(self, piece: str) -> bytes:
        found = self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def _closes(self, char: str) -> bool:
        """Whether a mark after the character is split off it: not if the character comes
        apart and its last part is a mark itself."""
        return all(self._library(char + mark) == self._library(char) + self._library(mark) for mark in PUNCTUATION)

    def _word(self, word: str) -> bytes:
        core = word.rstrip(PUNCTUATION)
        if core and core != word and core[-1].isalnum() and self.closes[core[-1]]:
            return self.words[core] + self.words[word[len(core):]]
        return self._library(word) if word else b""

    def ids(self, text: str) -> bytes:
        if self.pieces is not None and PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.merged.__getitem__, self.pieces(text.lower())))
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" ")))


def _pieces(vocabulary: dict):
    """The vocabulary's split of a lower-case text of PLAIN characters; None if it prepares texts in other ways."""
    first = vocabulary["pre_tokenizer"]["pretokenizers"][0] if (vocabulary.get("pre_tokenizer") or {}).get("type") == "Sequence" else {}
    steps = [(x["type"], x.get("pattern", {}).get("Regex")) for x in (vocabulary.get("normalizer") or {}).get("normalizers", [])]
    if (steps != [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)] or first.get("type") != "Split" or not first["invert"]
            or any(not x["content"].startswith("<|") for x in vocabulary["added_tokens"])):
        return None
    kinds = {k: "".join(re.escape(c) for c in map(chr, range(LAST + 1)) if unicodedata.category(c)[0] == k) for k in "LN"}
    pattern = first["pattern"]["Regex"]
    for kind, chars in kinds.items():
        pattern = pattern.replace(f"[\\p{{{kind}}}]", f"[{chars}]").replace(f"\\p{{{kind}}}", chars)
    return re.compile(pattern).findall


def _cutter(path: str, capacity: int, end: int):
    """For ``map_arrow``: documents (doc_id, text) -> their pieces."""
    sizes = class_sizes(capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, last, cuts = once(Tokens, path), np.array([end], "<u4").tobytes(), Memo(lambda n: cut(n, sizes))
        for batch in groups(batches):
            out = []
            for doc_id, text in zip(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), batch.column(batch.schema.get_field_index("text")).to_pylist()):
                ids = memoryview(tokens.ids(text or "") + last)
                n, start = len(ids) // 4, 0
                for size in cuts[n]:
                    out.append((doc_id, start, size, zlib.crc32(ids[4 * start:4 * (start + size)]), n, size))
                    start += size
            kinds = [pa.int64()] * 5 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "size"])

    return run


def first_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, taken in the given order."""
    used: list[int] = []
    out = []
    for n in lengths:
        at = next((i for i, u in enumerate(used) if u + n <= capacity), None)
        if at is None:
            at = len(used)
            used.append(0)
        out.append((at, used[at]))
        used[at] += n
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of all documents with their sequence_id and offset."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = numbered(texts, "size", "pieces", "nth", _cutter(path, capacity, end), _PIECES)
    per_bin = F.lit(capacity).cast("long") / F.col("size")
    counts = rows.groupBy("size").agg((F.max("nth") + 1).alias("n"))
    counts = counts.withColumn("bins", F.floor(F.col("n") / F.floor(per_bin)))
    before = Window.partitionBy(F.lit(0)).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    classes = counts.select("size", "bins", F.floor(per_bin).alias("each"),
                            F.coalesce(F.sum("bins").over(before), F.lit(0)).alias("base"),
                            F.sum("bins").over(Window.partitionBy(F.lit(0))).alias("all_bins"))
    placed = rows.join(F.broadcast(classes), "size").withColumn("bin", F.floor(F.col("nth") / F.col("each")))
    full = placed.where("bin < bins").select(*OUT[:5], (F.col("base") + F.col("bin")).alias("sequence_id"),
                                             ((F.col("nth") % F.col("each")) * F.col("size")).alias("offset"))

    def rest(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("nth", "ascending")])
        at = first_fit(table["length"].to_pylist(), capacity)
        ids = np.array([b for b, _ in at], np.int64) + table["all_bins"].to_numpy()
        return (table.select(OUT[:5]).append_column("sequence_id", pa.array(ids, pa.int64()))
                .append_column("offset", pa.array([o for _, o in at], pa.int64())))

    left = placed.where("bin >= bins").select(*OUT[:5], "nth", "all_bins", F.lit(0).alias("one"))
    tail = left.groupBy("one").applyInArrow(
        rest, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return full.unionByName(tail)
