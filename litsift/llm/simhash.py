"""SimHash near-dedup over BK-trees.

Fingerprints: 64 bits; a bit is 1 if set in over half of the XXH64 hashes (seed 42) of a
text's word shingles, repeats included (ASCII lower case, words between ASCII white space).
A text with fewer words than a shingle is one shingle; without words its fingerprint is 0.

Search: two fingerprints within RADIUS = 2 bits agree on at least two of four 16-bit
quarters, and on six of eight bytes. Each distinct fingerprint is a member of six shards,
one for each pair of quarters. The members of a shard that more than TREE share go into 28
finer ones instead, one for each six bytes; these leave 16 bits free, so no shard holds more
than 65,536 fingerprints, however many documents there are. A shard's members hang in a
BK-tree: children are keyed by their Hamming distance to the parent, and a query at distance
d follows only the edges from d - 2 to d + 2. Every member queries its shard's tree. The
links found become at most one edge for each member (union-find within the task), never all
pairs of a group.

Defined results: a null text counts as empty; empty texts share fingerprint 0 and link like
any other. Copies share a fingerprint and are one member. A null doc_id gets a fingerprint
and the component of the ids it links with (null if there are none). Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsift.llm.common import carried, groups, map_arrow, texts, written
from litsift.llm.components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Members of a shard of two quarters, at most; larger ones are cut finer.
TREE = 4096
#: Hashes whose bits are unpacked at once.
CHUNK = 1 << 18


def shingle_hashes(text: bytes, words: int = SHINGLE) -> list[int]:
    parts = text.lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends, at = [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1:])]


def fold(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of ``lengths`` hashes: bits set in over half of them."""
    counts = np.zeros((len(lengths), 64), np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    for at in range(0, len(hashes), CHUNK):
        part, own = hashes[at:at + CHUNK], owner[at:at + CHUNK]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > lengths[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, words: int = SHINGLE, carry: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row; carry: the text and a struct ``row`` of all other columns follow."""
    own = carried(docs) if carry else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    more = ["text", "row"] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = lambda b, c: b.column(b.schema.get_field_index(c))
        for batch in groups(batches):
            found = [shingle_hashes(t, words) for t in texts(batch)]
            lengths = np.array([len(x) for x in found])
            flat = np.fromiter(chain.from_iterable(found), np.uint64, int(lengths.sum()))
            fp = fold(flat, lengths).view(np.int64)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(fp), *[column(batch, c) for c in more]], names=["doc_id", "fp", *more])

    kinds = "".join(f", {c} {own.schema[c].dataType.simpleString()}" for c in more)
    return map_arrow(own, run, "doc_id long, fp long" + kinds)


class BKTree:
    """A BK-tree over distinct fingerprints (uint64)."""

    def __init__(self, members: np.ndarray):
        self.members = members
        self.root = self._grow(np.arange(len(members)))
        #: Edges that queries have followed.
        self.followed = 0

    def _grow(self, at: np.ndarray) -> tuple[int, dict]:
        """A node: the place of its member, and its children by their distance to it."""
        away = np.bitwise_count(self.members[at[1:]] ^ self.members[at[0]])
        order = np.argsort(away, kind="stable")
        rest = at[1:][order]
        keys, first = np.unique(away[order], return_index=True)
        return int(at[0]), {int(k): self._grow(part) for k, part in zip(keys, np.split(rest, first[1:]))}

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) positions of all pairs at most ``radius`` bits apart. All queries
        walk the tree together, each along its own edges."""
        found_q, found_m = [], []
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            (here, children), who = todo.pop()
            away = np.bitwise_count(queries[who] ^ self.members[here]).astype(np.int16)
            near = who[away <= radius]
            found_q.append(near)
            found_m.append(np.full(len(near), here))
            for key, child in children.items():
                follow = who[np.abs(away - key) <= radius]
                if len(follow):
                    self.followed += len(follow)
                    todo.append((child, follow))
        return np.concatenate(found_q), np.concatenate(found_m)


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that it is linked with by the pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _shard_edges(members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges among a shard's members (as many as have a smaller one in reach, at most)."""
    q, m = BKTree(members).within(members, radius)
    root = _stars(len(members), q, m)
    moved = root != np.arange(len(members))
    return members[moved], members[root[moved]]


def _trees(radius: int):
    """For ``map_arrow``: rows (shard, bits, fp) sorted by shard and bits -> edges (u, v)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, members = None, []
        edges: list[tuple[np.ndarray, np.ndarray]] = []

        def close():
            if members:
                edges.append(_shard_edges(np.concatenate(members).view(np.uint64), radius))

        for batch in batches:
            a, b, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            new = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            for first, last in zip([0, *new], [*new, len(a)]):
                if (a[first], b[first]) != shard:
                    close()
                    shard, members = (a[first], b[first]), []
                members.append(fp[first:last])
            if edges:
                yield _edge_rows(edges)
                edges.clear()
        close()
        yield _edge_rows(edges)

    return run


def _edge_rows(edges: list) -> pa.RecordBatch:
    columns = [np.concatenate([e[i] for e in edges]).view(np.int64) if edges else np.empty(0, np.int64) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["u", "v"])


def _shards(members: DataFrame, pieces: int, equal: int) -> DataFrame:
    """shard, bits, fp: each member once for each ``equal`` of its ``pieces``; shards of one are left out."""
    width = 64 // pieces
    ways = list(combinations(range(pieces), equal))
    masks = [sum(((1 << width) - 1) << (width * p) for p in way) for way in ways]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = [F.struct(F.lit(i).alias("shard"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("bits")) for i, m in enumerate(masks)]
    placed = members.select("fp", F.explode(F.array(*keys)).alias("s")).select("s.shard", "s.bits", "fp")
    sizes = placed.groupBy("shard", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return placed.join(sizes, ["shard", "bits"])


def links(members: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(u, v)`` that join all fingerprints of ``members(fp)`` (distinct) at most ``radius`` bits apart."""
    if radius != RADIUS:
        raise ValueError("two of four quarters and six of eight bytes agree for a radius of 2 only")
    coarse = _shards(members, 4, 2)
    fine = _shards(coarse.where(F.col("n") > TREE).select("fp").distinct(), 8, 6)
    rows = coarse.where(F.col("n") <= TREE).unionByName(fine.withColumn("shard", F.col("shard") + 6)).select("shard", "bits", "fp")
    return map_arrow(rows.repartition("shard", "bits").sortWithinPartitions("shard", "bits", "fp"), _trees(radius), "u long, v long")


def grouped(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id, part: one row for each row of ``prints(doc_id, fp)``, which is
    read more than once. ``part`` is the component's smallest fingerprint: an id with several
    texts may be the smallest of several components, a part is one component's alone."""
    prints = prints.select("doc_id", "fp")
    members = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "members")
    parts = components(links(members.select("fp"), radius))
    part = members.join(parts, members.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    smallest = part.groupBy("part").agg(F.min("least").alias("component_id"))
    labels = written(part.join(smallest, "part").select("fp", "component_id", "part"), "labels")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id", "part")


def near_groups(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each row of ``docs``."""
    found = grouped(written(fingerprints(docs, words), "fingerprints"), radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
