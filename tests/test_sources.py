"""Stored forms: papers looked up by id (S8), keys in buckets (S7), message lines (S1), ranked lists (O1, S3)."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from fixtures import message
from litsift.operators import lookup, rank
from litsift.schemas import CATALOGUE
from litsift.session import scratch_path
from litsift.sources.catalogue import read_catalogue, read_key_table, write_key_table
from litsift.sources.messages import read_messages
from litsift.sources.papers import read_papers, write_papers


def scanned_rows(df):
    """Rows that the scan of a collected frame gave (after row groups were left out)."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_paper_by_id_reads_few_row_groups(spark):
    from litsift.sources import papers as store
    n = 60_000
    df = spark.range(n).select((F.col("id") * 7919 % n).cast("string").alias("arxiv_id"), F.md5(F.col("id").cast("string")).alias("abstract")).repartition(4)
    by_id, plain = scratch_path(spark, "by-id"), scratch_path(spark, "plain")
    old, store.LOOKUP_GROUP = store.LOOKUP_GROUP, 1 << 16
    try:
        write_papers(df, by_id, sorted_by="arxiv_id")
    finally:
        store.LOOKUP_GROUP = old
    write_papers(df, plain)
    read = {}
    for name, path in (("by_id", by_id), ("plain", plain)):
        shown = rank.show_paper(read_papers(spark, path), ["17", "41234", "absent"])
        assert {r.arxiv_id for r in shown.collect()} == {"17", "41234"}
        read[name] = scanned_rows(shown)
    assert read["plain"] == n and read["by_id"] < n / 4
    missing = rank.show_paper(read_papers(spark, by_id), "absent between others")
    assert missing.collect() == [] and scanned_rows(missing) == 0


def test_lookups_against_stored_keys_shuffle_papers_only(spark, tmp_path):
    cat = spark.createDataFrame([(f"c{i}", f"Title {i % 40}", ["A, B"], "s", None, "p", []) for i in range(400)], CATALOGUE)
    asked = spark.createDataFrame([(f"p{i}", f"title {i}!", "A, B") for i in range(60)], "paper_key string, title string, authors string")
    source, keys = str(tmp_path / "catalogue"), scratch_path(spark, "keys")
    cat.write.json(source)
    write_key_table(read_catalogue(spark, source, fmt="json"), keys, "t_keys", buckets=8)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = lookup.tier_exact(asked, None, index=read_key_table(spark, keys, "t_keys", buckets=8))
        want = lookup.tier_exact(asked, cat)
        rows = sorted(map(repr, found.collect()))
        assert rows == sorted(map(repr, want.collect())) and rows
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial")[0]
        assert plan.count("Exchange") - plan.count("ShuffleQueryStage") <= 1 and "Bucketed: true" in plan
        # Another session's catalog doesn't know the table: its files are enough.
        spark.sql("DROP TABLE t_keys")
        again = lookup.tier_exact(asked, None, index=read_key_table(spark, keys, "t_again", buckets=8))
        assert sorted(map(repr, again.collect())) == rows and "Bucketed: true" in again._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS t_again")
    with pytest.raises(ValueError):
        read_key_table(spark, keys, "a; b")


def test_broken_message_lines_are_kept(spark, tmp_path):
    good = [json.dumps(message(f"m{i}")) for i in range(3)]
    bad = ['{"id": "x", "payload": {', "no json", '{"id": "y", "labelIds": 5}', '{"id": "z", "payload": "none"}', "[1]"]
    (tmp_path / "a.json").write_text("\n".join([good[0], *bad[:3], good[1]]) + "\n")
    (tmp_path / "b.json").write_text("\n".join([*bad[3:], good[2]]) + "\n")
    rows = read_messages(spark, str(tmp_path), corrupt="line")
    assert sorted(r.line for r in rows.where("line is not null").collect()) == sorted(bad)
    assert sorted(r.id for r in rows.where("line is null").collect()) == ["m0", "m1", "m2"]
    assert rows.select("id").where("line is not null").count() == len(bad)  # whatever a query selects


def test_ranked_lists_keep_their_order_in_files(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("arxiv_id"),
                                  F.when(F.col("id") % 9 != 0, (F.col("id") * 37 % 100) / 100).alias("score")).repartition(6)
    ranked = rank.rank_papers(df)
    path = scratch_path(spark, "ranked")
    write_papers(ranked, path)
    want = sorted(((r.score is None, -(r.score or 0), r.arxiv_id) for r in df.collect()))
    stored = []
    for name in sorted(glob.glob(path.removeprefix("file:") + "/part-*")):
        stored += [(r.score is None, -(r.score or 0), r.arxiv_id, r["rank"]) for r in spark.read.parquet(name).collect()]
    assert stored == [(*w, i) for i, w in enumerate(want, 1)]
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan or "row_number" not in plan
