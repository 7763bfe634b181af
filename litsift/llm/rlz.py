"""Substring dedup by looked-up windows, in place of a relative Lempel-Ziv parse.

Every window of WINDOW words of a document is looked up among the windows of the documents
with smaller ids; the words that a found window covers are duplicates, exactly those. Found
windows that start side by side and name the same reference make one factor. No match is
extended in its reference: each window of a factor is held by a document with a smaller id,
but the factor need not be one run of words there. The reference is the smallest id that
holds the window either of all documents or of the group that was settled together, so it
depends on the grouping; which words go does not.

The reference index has two levels, both spread over the cluster by hash:

1. Anchors. A window's anchor is the least hash among its ANCHOR-word grams. Equal windows
   have equal anchors and a long passage has few of them (about one for each fifth word), so
   the first exchange carries far fewer rows than there are windows. Anchors of a single
   document are done with.
2. Windows. Only windows whose anchor several documents share are looked up by their own 96-bit
   hash, and learn the smallest document that holds them.

A worker first settles what its own group of documents can settle and asks the index once
for each distinct hash, so that a passage found in a third of all documents sends one row
for each group and not one for each document. Rows of a hash are then read as a sorted
stream; no group is held in memory.

Defined results: a null text has no words. A null doc_id is neither smaller nor larger than
another: its row keeps all words and takes none from others. Rows that repeat an id are
versions of one document: none is a reference for another, and what a smaller id holds is
removed from each. Other columns are not read; they follow as they are if asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsift.llm.common import carried, groups, map_arrow, once, texts

WINDOW = 13
ANCHOR = 5
#: Bytes of text whose windows are settled together.
GROUP = 6_000_000
_MULTIPLIERS = np.random.Generator(np.random.PCG64(2024)).integers(0, 1 << 63, (3, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MAP = "key long, check int, doc_id long, found binary"


def _grams(words: np.ndarray, size: int, row: int) -> np.ndarray:
    """Multilinear hash of every run of ``size`` word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out += words[j:j + n] * _MULTIPLIERS[row, j]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


#: Which bytes part words, and random numbers for a letter's place in its word and for the letter.
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_PLACES = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTERS = np.random.Generator(np.random.PCG64(8)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes whose words are hashed at once.
CHUNK = 500_000


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _word_hashes(split_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of some text (bytes that end in white space): the sum, over
    a word's bytes, of its place's number times the byte's, mixed with its length."""
    space = _SPACE[split_at]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, size = edge[0::2], edge[1::2] - edge[0::2]
    if not len(start):
        return np.empty(0, np.uint64), start
    letters, first = split_at[~space], np.cumsum(size) - size
    place = np.arange(len(letters)) - np.repeat(first, size)
    number = _PLACES[place & 0xFFFF] * _LETTERS[letters]
    far = np.flatnonzero(place >> 16)  # further places of very long words
    number[far] *= _PLACES[(place[far] >> 16) & 0xFFFF]
    found = np.add.reduceat(number, first)
    return _mixed(found ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), start


class Parser:
    """Hashes of words and windows."""

    @staticmethod
    def hashes(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes of all rows behind one another, and how many words each row has."""
        found, counts, at = [np.empty(0, np.uint64)], [np.empty(0, int)], 0
        while at < len(rows):
            end, size = at, 0
            while end < len(rows) and (end == at or size + len(rows[end]) < CHUNK):
                size += len(rows[end]) + 1
                end += 1
            words, start = _word_hashes(np.frombuffer(b"\n".join(rows[at:end]) + b"\n", np.uint8))
            found.append(words)
            limits = np.cumsum([len(r) + 1 for r in rows[at:end]])
            counts.append(np.diff(np.searchsorted(start, limits), prepend=0))
            at = end
        return np.concatenate(found), np.concatenate(counts)

    def group(self, batch: pa.RecordBatch):
        """The texts, their numbers of words, the word hashes of all of them behind one another,
        and for each position where a window starts: its document's row."""
        rows = texts(batch)
        words, n = self.hashes(rows)
        owner = np.repeat(np.arange(len(n)), n)
        last = len(words) - WINDOW + 1
        if last <= 0:
            return rows, n, words, np.empty(0, int), owner[:0]
        at = np.flatnonzero(owner[:last] == owner[WINDOW - 1:])
        return rows, n, words, at, owner[at]

    @staticmethod
    def windows(words: np.ndarray, at: np.ndarray) -> np.ndarray:
        return _grams(words, WINDOW, 0)[at] if len(at) else np.empty(0, np.uint64)

    @staticmethod
    def checks(words: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (_grams(words, WINDOW, 1)[at] >> np.uint64(33)).astype(np.int32) if len(at) else np.empty(0, np.int32)

    @staticmethod
    def anchors(words: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.empty(0, np.uint64)
        grams, n = _grams(words, ANCHOR, 2), len(words) - WINDOW + 1
        least = grams[:n].copy()
        for j in range(1, WINDOW - ANCHOR + 1):
            np.minimum(least, grams[j:j + n], out=least)
        return least[at]


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _distinct(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (key, id) pairs by key, then id, and each one's place in the input."""
    if len(keys) > 1:  # neighbours are often equal: sort less
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
        place = np.flatnonzero(new)
    else:
        place = np.arange(len(keys))
    order = place[np.lexsort((ids[place], keys[place]))]
    k, i = keys[order], ids[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1])]) if len(k) else np.empty(0, bool)
    return k[new], i[new], order[new]


def _rows(keys, checks, ids, found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.view(np.int64)), pa.array(checks, pa.int32()), pa.array(ids, pa.int64()), found],
        names=["key", "check", "doc_id", "found"])


def _settle(keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, all_ids: bool) -> Iterator[pa.RecordBatch]:
    """One question for each distinct key (asked for its smallest id) and the answers that the group itself gives.

    all_ids: every id of a key that several ids hold is answered; else only the larger ones.
    An answer holds pairs of 8 bytes: a key, and the smallest id of the group that holds it.
    """
    k, i, place = _distinct(keys, ids)
    if not len(k):
        return
    first = np.concatenate([[True], k[1:] != k[:-1]])
    asked = np.sort(place[first])  # in the texts' order: rows of one document side by side take less room
    yield _rows(keys[asked], checks[asked], ids[asked], pa.nulls(len(asked), pa.binary()))
    least = i[np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))]
    answer = ~first
    if all_ids:
        answer = answer | np.concatenate([answer[1:], [False]])
    if not answer.any():
        return
    k, i, least = k[answer], i[answer], least[answer]
    order = np.argsort(i, kind="stable")
    k, i, least = k[order], i[order], least[order]
    own, start = np.unique(i, return_index=True)
    pairs = np.stack([k.view(np.int64), least], 1)
    packed = [pairs[a:b].tobytes() for a, b in zip(start, [*start[1:], len(i)])]
    spread = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in own], np.uint64)
    yield _rows(spread, np.zeros(len(own), np.int32), own, pa.array(packed, pa.binary()))


def _index(rows: DataFrame, all_ids: bool) -> DataFrame:
    """Answers ``(doc_id, found)`` to the questions among ``rows``, and those that were there.

    Rows are dealt by key and sorted by key and id, so the first row of a key has the smallest
    id that holds it. all_ids: as in ``_settle``; there the first id is answered as well, when
    a second one comes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, check, smallest id, whether that one has been answered
        for batch in batches:
            found = _column(batch, "found")
            told = found.is_valid().to_numpy(zero_copy_only=False)
            if told.any():
                mask = pa.array(told)
                yield pa.RecordBatch.from_arrays([_column(batch, "doc_id").filter(mask), found.filter(mask)], names=["doc_id", "found"])
            k = _column(batch, "key").to_numpy()[~told]
            c = _column(batch, "check").to_numpy()[~told]
            i = _column(batch, "doc_id").to_numpy()[~told]
            if not len(k):
                continue
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
            least = i[lead]
            early = []
            if last is not None and (k[0], c[0]) == last[:2]:
                run_end = int(np.argmax(new[1:])) + 1 if new[1:].any() else len(k)
                least[:run_end] = last[2]
                if all_ids and not last[3] and (i[:run_end] > last[2]).any():
                    early = [(last[2], k[0])]
            later = i > least
            answer = later
            if all_ids:  # the leading id of a run that has a later one in this batch
                leads = np.zeros(len(k), bool)
                leads[lead[later]] = True
                answer = later | leads
            done = bool(later[lead == lead[-1]].any()) or (last is not None and (k[-1], c[-1]) == last[:2] and last[3])
            last = (k[-1], c[-1], least[-1], done)
            ids, keys, refs = i[answer], k[answer], least[answer]
            if early:
                ids, keys, refs = (np.concatenate([[e], x]) for e, x in zip((early[0][0], early[0][1], early[0][0]), (ids, keys, refs)))
            if len(ids):
                pairs = np.stack([keys, refs], 1).tobytes()
                size = 16 * np.arange(len(ids) + 1, dtype=np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(size), pa.py_buffer(pairs)])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), packed], names=["doc_id", "found"])

    dealt = rows.repartition("key").sortWithinPartitions("key", "check", "doc_id")
    return map_arrow(dealt, run, "doc_id long, found binary")


def _answers(found: list | None) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(found or []), np.int64).reshape(-1, 2)
    keys, at = np.unique(pairs[:, 0], return_index=True)
    return keys, pairs[at, 1]


def _marked(keys: np.ndarray, batch: pa.RecordBatch, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the windows' keys (by row) the answers of the batch's rows hold, and the reference that they name."""
    hit, ref = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    signed = keys.view(np.int64)
    ends = np.searchsorted(owner, np.arange(batch.num_rows + 1))
    for row, found in enumerate(_column(batch, "found").to_pylist()):
        a, b = ends[row], ends[row + 1]
        if found and a < b:
            known, refs = _answers(found)
            at = np.minimum(np.searchsorted(known, signed[a:b]), len(known) - 1)
            hit[a:b] = known[at] == signed[a:b]
            ref[a:b] = refs[at]
    return hit, ref


def duplicate_windows(own: DataFrame) -> DataFrame:
    """doc_id, found: for each document of ``own`` (doc_id, text, ...) with duplicate windows the list of packed (window hash,
    smallest id that holds it).

    The documents are joined with their shared anchors in the same way as later with their duplicate windows (all rows and
    columns, by id), so that one exchange of the texts serves both joins.
    """
    named = own.where("doc_id is not null").select("doc_id", "text")

    def ask_anchors(batches):
        parser = once(Parser)
        for batch in groups(batches, GROUP):
            _, _, words, at, owner = parser.group(batch)
            keys = parser.anchors(words, at)
            yield from _settle(keys, np.zeros(len(keys), np.int32), _column(batch, "doc_id").to_numpy()[owner], True)

    def ask_windows(batches):
        parser = once(Parser)
        for batch in groups((b.filter(_column(b, "found").is_valid()) for b in batches), GROUP):
            _, _, words, at, owner = parser.group(batch)
            hit, _ = _marked(parser.anchors(words, at), batch, owner)
            at, owner = at[hit], owner[hit]
            yield from _settle(parser.windows(words, at), parser.checks(words, at), _column(batch, "doc_id").to_numpy()[owner], False)

    shared = _by_document(_index(map_arrow(named, ask_anchors, _MAP), True))
    return _by_document(_index(map_arrow(own.join(shared, "doc_id", "left"), ask_windows, _MAP), False))


def _by_document(answers: DataFrame) -> DataFrame:
    return answers.groupBy("doc_id").agg(F.collect_list("found").alias("found"))


def parse(hit: np.ndarray, ref: np.ndarray) -> list[tuple[int, int, int]]:
    """The factors of one document, given by window which are duplicates and where: (first word, words, reference id)."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (ref[at[1:]] != ref[at[:-1]])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return [(int(at[a]), int(at[b] - at[a]) + WINDOW, int(ref[at[a]])) for a, b in zip(first, last)]


_RESULT = "doc_id long, kept string, n_words long, n_removed long, spans array<struct<start:int,words:int,reference:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("reference", pa.int64())]))


def dedup_substrings(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, kept (the words that stay, joined by one space), n_words, n_removed, spans (the factors: duplicate runs of
    words and a document that has their windows); one row for each row of ``docs``.

    carry: the text and a struct ``row`` of all other columns follow.
    """
    own = carried(docs) if carry else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = own.join(duplicate_windows(own), "doc_id", "left")
    more = ["text", "row"] if carry else []

    def run(batches):
        parser = once(Parser)
        for batch in groups(batches, GROUP):
            rows, n, words, at, owner = parser.group(batch)
            hit, ref = _marked(parser.windows(words, at), batch, owner)
            ends = np.searchsorted(owner, np.arange(len(rows) + 1))
            kept, removed, spans = [], [], []
            for row, own_words in enumerate(map(bytes.split, rows)):
                a, b = ends[row], ends[row + 1]
                factors = parse(hit[a:b], ref[a:b])
                gone = np.zeros(len(own_words), bool)
                for start, size, _ in factors:
                    gone[start:start + size] = True
                kept.append(b" ".join(compress(own_words, (~gone).tolist()) if factors else own_words))
                removed.append(int(gone.sum()))
                spans.append([{"start": f, "words": size, "reference": r} for f, size, r in factors])
            yield pa.RecordBatch.from_arrays(
                [_column(batch, "doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()),
                 pa.array(removed, pa.int64()), pa.array(spans, _SPANS), *[_column(batch, c) for c in more]],
                names=["doc_id", "kept", "n_words", "n_removed", "spans", *more])

    kinds = "".join(f", {c} {own.schema[c].dataType.simpleString()}" for c in more)
    return map_arrow(joined, run, _RESULT + kinds)
