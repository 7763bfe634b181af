"""Stored keys in runs and filters (D4), state in RocksDB."""

import glob
import json
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from fixtures import message
from litsift.plans.triage import recent_papers
from litsift.session import scratch_path
from litsift.streaming.incremental import ingest_incremental_stateful, process_batch, read_ingested, stored_state
from litsift.streaming.seen import SeenKeys, cover


def test_runs_cover_all_batches():
    for n in range(200):
        runs = cover(n)
        assert [b for a, z in runs for b in range(a, z + 1)] == list(range(n)) and len(runs) == n.bit_count()


def rows(spark, ids):
    return spark.createDataFrame([(f"m{i}", i % 3) for i in ids], "email_id string, article_pos int")


def test_what_a_batch_reads_stays_flat(spark):
    """20 batches of new keys and two re-delivered ones: as many buckets read at the end as at the start."""
    sink = scratch_path(spark, "seen")
    read = []
    for n in range(20):
        ids = [*range(n * 50, n * 50 + 50), *([n * 50 - 49, 0] if n else [])]
        seen = SeenKeys(spark, sink, ["email_id", "article_pos"])
        fresh = seen.unseen(rows(spark, ids), n)
        fresh.write.mode("overwrite").parquet(f"{sink}/batch_id={n}")
        read.append(seen.read)
    stored = read_ingested(spark, sink)
    assert stored.count() == 1000 == stored.select("email_id").distinct().count()
    assert all(buckets <= 4 for _, buckets in read), read                    # two keys, and chance hits of the filters
    assert sum(b for _, b in read[15:]) <= sum(b for _, b in read[1:6]) + 2
    assert max(r for r, _ in read) <= 5


def test_replays_lost_runs_and_repeated_keys(spark):
    sink, key = scratch_path(spark, "replay"), ["email_id", "article_pos"]
    to_papers = lambda df: df
    for n, ids in enumerate([[1, 2, 2, 3], [3, 4], [], [1, 5]]):
        process_batch(rows(spark, ids), n, sink, to_papers, key)
    first = sorted(r.email_id for r in read_ingested(spark, sink).collect())
    assert first == ["m1", "m2", "m3", "m4", "m5"]
    process_batch(rows(spark, [1, 5]), 3, sink, to_papers, key)              # a replay of the last batch
    process_batch(rows(spark, [3, 4]), 1, sink, to_papers, key)              # and of an earlier one
    assert sorted(r.email_id for r in read_ingested(spark, sink).collect()) == first
    other = scratch_path(spark, "copied")                                    # a sink whose runs were never written
    for n in range(4):
        part = spark.read.parquet(f"{sink}/batch_id={n}")
        part.write.parquet(f"{other}/batch_id={n}")
    assert SeenKeys(spark, other, key).unseen(rows(spark, [2, 4, 9]), 4).collect() == [("m9", 0)]
    none = spark.createDataFrame([(None, 1), (None, 1)], "email_id string, article_pos int")
    assert SeenKeys(spark, other, key).unseen(none, 4).count() == 2          # a null key is no key: nothing is dropped


def test_state_survives_a_killed_batch(spark, tmp_path):
    base = scratch_path(spark, "rocks").removeprefix("file:")
    os.makedirs(f"{base}/source")
    arts = "".join(f"<article><h2><a href='u{i}'>T{i}</a></h2></article>" for i in range(2))
    for i in range(3):
        with open(f"{base}/source/f{i}.json", "w") as f:
            f.writelines(json.dumps(message(f"m{j}", html=f"<div>scholar-inbox.com{arts}</div>")) + "\n" for j in (i, i + 1))

    def to_papers(df, fails=False):
        papers = recent_papers(df, since="2020-01-01")
        if fails:  # the batch with m3 dies in its tasks
            papers = papers.withColumn("title", F.when(F.col("email_id") == "m3", F.raise_error(F.lit("killed"))).otherwise(F.col("title")))
        return papers

    run = lambda fails: ingest_incremental_stateful(
        spark, f"{base}/source", f"{base}/sink", f"{base}/ckpt", lambda df: to_papers(df, fails), files_per_batch=1)
    with pytest.raises(StreamingQueryException):
        run(True)
    before = stored_state(spark, f"{base}/ckpt").count()
    assert 0 < before < 8
    run(False)
    out = spark.read.parquet(f"{base}/sink")
    assert sorted((r.email_id, r.article_pos) for r in out.collect()) == [(f"m{i}", j) for i in range(4) for j in range(2)]
    assert sorted((r.email_id, r.article_pos) for r in stored_state(spark, f"{base}/ckpt").collect()) == [(f"m{i}", j) for i in range(4) for j in range(2)]
    assert glob.glob(f"{base}/ckpt/state/0/*/*.changelog")
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "unset") != "true"
