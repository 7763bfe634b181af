"""BK-trees of shards: exact, along edges, and in bounded shards however hot the quarters are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from litsift.llm import simhash


def pairs(values, radius=2):
    v = np.array(values, np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= radius
    return {(int(v[i]), int(v[j])) for i, j in zip(*np.nonzero(near)) if i != j}


def parts(values, edges):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def hot(n, seed, free=32):
    """Fingerprints that share all but the last ``free`` bits, many of them a few bits apart."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << free, n // 4, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, free, (n, 2), dtype=np.uint64)
    low = centres[rng.integers(0, len(centres), n)] ^ flips[:, 0] ^ np.where(rng.random(n) < 0.5, flips[:, 1], np.uint64(0))
    return np.unique(np.uint64(0xABCD_1234 << 32) ^ low)


@pytest.mark.parametrize("n", [1, 2, 3, 50, 600])
def test_a_tree_finds_all_neighbours_along_its_edges(n):
    members = hot(n, n, 40) if n > 3 else np.arange(n, dtype=np.uint64) * np.uint64(5)
    tree = simhash.BKTree(members)
    q, m = tree.within(members, 2)
    found = {(int(members[a]), int(members[b])) for a, b in zip(q, m) if a != b}
    assert found == pairs(members) and len(q) == len(found) + len(members)
    everywhere = len(members) * (len(members) - 1)
    if n >= 600:
        assert 0 < tree.followed < everywhere / 3, (tree.followed, everywhere)


def test_hot_quarters_are_cut_finer(spark, monkeypatch):
    """A third of all fingerprints share two quarters: they meet in shards of six equal bytes."""
    rng = np.random.default_rng(9)
    values = np.unique(np.concatenate([hot(900, 4), rng.integers(0, 1 << 63, 1800, dtype=np.uint64), np.array([0, 1, 3, (1 << 64) - 1, (1 << 64) - 2], np.uint64)]))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long").repartition(5)
    want = parts(values.tolist(), pairs(values))
    sizes = {}
    for tree in (4096, 64):
        monkeypatch.setattr(simhash, "TREE", tree)
        coarse = simhash._shards(df, 4, 2)
        cut = coarse.where(F.col("n") > tree).select("fp").distinct()
        sizes[tree] = cut.count(), simhash._shards(cut, 8, 6).agg(F.max("n")).first()[0]
        edges = [tuple(np.array([r.u, r.v], np.int64).view(np.uint64).tolist()) for r in simhash.links(df).collect()]
        assert parts(values.tolist(), edges) == want, tree
        assert len(edges) <= 34 * len(values)
    assert sizes[4096][0] == 0 and sizes[64][0] >= 800 and sizes[64][1] < 100


def test_a_shard_across_batches(spark, monkeypatch):
    values = hot(400, 7)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        edges = [tuple(np.array([r.u, r.v], np.int64).view(np.uint64).tolist()) for r in simhash.links(df).collect()]
        assert parts(values.tolist(), edges) == parts(values.tolist(), pairs(values))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
