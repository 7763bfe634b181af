"""Physical-plan shape of the registered queries (the scale properties, checked)."""

import os
import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def plan(spark, name):
    return E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_digest_filter_reaches_the_scan(spark):
    p = plan(spark, "digest_since")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", p)
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string>" in p   # pruned


def test_lookups_never_pair_all_rows(spark):
    for name in ("lookup_exact", "lookup_tokens", "lookup_author_phrase", "lookup_cascade", "enrich"):
        p = plan(spark, name)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
        if name.startswith("lookup_") and name != "lookup_cascade":   # the cascade's tiers are checkpointed
            assert "WindowGroupLimit" in p, name


def test_lexical_scoring_broadcasts_only_question_tokens(spark):
    p = plan(spark, "mean_score")
    assert "BroadcastHashJoin" in p and "CartesianProduct" not in p and "NestedLoop" not in p
    assert "HashAggregate" in p


def test_top_n_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in plan(spark, "rank_top10")


def test_dedup_is_window_limited(spark):
    assert plan(spark, "dedup_id").count("WindowGroupLimit") >= 2     # partial + final


def test_pairs_broadcast_the_questions(spark):
    p = plan(spark, "prompts")
    assert "BroadcastNestedLoopJoin" in p and "BuildRight" in p and "CartesianProduct" not in p
