"""Scoring (J6, J7, J9, U1, U2, P26, A1-A3, A6), ranking (J8, O1, O2, W2) and dedup."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from litsift.operators import dedup, rank, score
from litsift.sources.models import models_df
from litsift.sources.questions import questions_df


def papers(spark):
    return spark.createDataFrame(
        [("1", "Graph networks", "Sparse graph attention for vision", "A", ["cs.LG"]),
         ("2", "Birds", "Migration of birds", "B", []),
         ("3", "Vision", "Graph vision attention networks", "C", None)],
        "arxiv_id string, title string, abstract string, authors string, categories array<string>")


def test_lexical_scores_match_brute_force(spark):
    qs = ["graph attention networks", "birds and the weather", "the of"]
    q = questions_df(spark, qs)
    got = {r.arxiv_id: r.score for r in score.lexical_mean_scores(papers(spark), q).collect()}
    stop = {"a", "an", "the", "on", "of", "for", "and", "in", "to", "with"}
    want = {}
    for pid, title, abstract in [("1", "Graph networks", "Sparse graph attention for vision"),
                                 ("2", "Birds", "Migration of birds"),
                                 ("3", "Vision", "Graph vision attention networks")]:
        pt = set((title + " " + abstract).lower().split()) - stop
        tot = 0
        for qq in qs:
            qt = set(qq.split()) - stop
            tot += (10 * len(pt & qt)) // len(qt) if qt else 0
        want[pid] = tot / (10 * len(qs))
    assert got == pytest.approx(want)


def test_pair_requests_broadcasts_questions(spark):
    req = score.pair_requests(papers(spark), questions_df(spark, ["a", "b"]))
    assert req.count() == 6
    assert "BroadcastNestedLoopJoin" in req._jdf.queryExecution().executedPlan().toString()


class Flaky:
    def analyze(self, prompt, model_id, max_tokens):
        if "Birds" in prompt:
            raise RuntimeError("rate limited")
        return "<explanation>ok</explanation><score>7</score>", {"prompt_tokens": 100, "completion_tokens": 10,
                                                                 "total_tokens": 110}


def test_score_with_errors_and_usage(spark):
    req = score.pair_requests(papers(spark), questions_df(spark, ["q1", "q2"]))
    s = score.score_with(req, Flaky, "gpt-4o").cache()
    rows = {(r.arxiv_id, r.question_id): r for r in s.collect()}
    assert rows[("2", 0)].error and rows[("2", 0)].relevance_score == 0.0
    assert rows[("2", 0)].explanation.endswith("rate limited")
    assert rows[("1", 1)].relevance_score == pytest.approx(0.7) and not rows[("1", 1)].error
    zero = {r.arxiv_id: r.score for r in score.mean_score(s).collect()}
    skip = {r.arxiv_id: r.score for r in score.mean_score(s, errors="skip").collect()}
    assert zero["2"] == 0.0 and skip["2"] is None and zero["1"] == pytest.approx(0.7)
    u = score.token_usage(s, models_df(spark)).first()
    assert (u.n_calls, u.total_prompt_tokens, u.total_completion_tokens) == (6, 400, 40)
    assert u.estimated_cost == pytest.approx(400 * 2.5 / 1e6 + 40 * 10.0 / 1e6)


def test_scored_batches_are_let_go():
    """A scorer whose use of a batch leaves a cycle (as ``prompts.str`` does) keeps few batches alive."""
    import gc
    import weakref

    import pandas as pd
    alive, most = [], []

    class Holding:
        def analyze_batch(self, prompts, model_id, max_tokens):
            prompts.attrs["own"] = [prompts]
            alive.append(weakref.ref(prompts))
            most.append(sum(r() is not None for r in alive))
            return pd.DataFrame({"response": ["<score>1</score>"] * len(prompts)})

    def batches(n):
        for i in range(n):
            yield pd.DataFrame({"arxiv_id": [f"{i}"] * 4, "question_id": range(4), "prompt": ["x" * (8 << 20), "y", None, "z"]})

    run = score._adapter(Holding, "gpt-4o", "gpt-4o", 10)
    gc.disable()
    try:
        out = [f.arxiv_id.tolist() for f in run(batches(40))]
    finally:
        gc.enable()
    assert out == [[f"{i}"] * 4 for i in range(40)]
    assert max(most) <= 9     # 64 MB of 8 MB each, and the one at hand; all 40 before


class Sized:
    """Answers with the bytes of prompts it got at once, and with a digest of each."""

    def analyze_batch(self, prompts, model_id, max_tokens):
        import hashlib

        import pandas as pd
        at_once = sum(len(p) for p in prompts if p is not None)
        return pd.DataFrame({"response": [f"<explanation>{hashlib.md5((p or '').encode()).hexdigest()}</explanation><score>5</score>" for p in prompts],
                             "prompt_tokens": [-1 if p is None else len(p) for p in prompts], "total_tokens": [at_once] * len(prompts)})


def test_a_scorer_gets_few_bytes_at_once(spark):
    heads = spark.range(9000).select(F.col("id").cast("string").alias("arxiv_id"), F.repeat(F.lit("x"), 2000).alias("prompt_head")).coalesce(1)
    q = questions_df(spark, ["what"])
    for questions in (q, score.asked_together(q)):
        s = score.score_with(score.pair_requests(heads, questions), Sized, "gpt-4o")
        got = s.agg(F.count(F.lit(1)), F.countDistinct("arxiv_id"), F.max("total_tokens")).first()
        assert got[:2] == (9000, 9000) and got[2] <= score.PROMPT_BYTES      # 18 MB before


def test_questions_asked_together_are_asked_one_by_one(spark):
    q = spark.createDataFrame([(i % 20, f"question {i} é") for i in range(3 * score.ASKED + 1)] + [(None, "no id"), (7, None), (2**60 + 1, "x"), (5, "x"), (5, "x")],
                              "question_id long, question string").coalesce(1)
    p = papers(spark).unionByName(papers(spark).limit(1))
    heads = score.request_heads(p)
    assert score.asked_together(q).agg(F.sum(F.size("asked")), F.max(F.size("asked"))).first()[:] == (q.count(), score.ASKED)
    cols = ["arxiv_id", "question_id", "explanation", "prompt_tokens", "relevance_score", "error"]
    rows = lambda questions: sorted(map(str, score.score_with(score.pair_requests(heads, questions), Sized, "gpt-4o").select(cols).collect()))
    assert rows(score.asked_together(q)) == rows(q) and len(rows(q)) == 4 * q.count()


def test_join_responses_gaps_and_unknown_model(spark):
    req = score.pair_requests(papers(spark).select("arxiv_id"), questions_df(spark, ["q"]))
    resp = spark.createDataFrame([("1", 0, "gpt-4o-mini", "<explanation>x</explanation><score>5</score>", None, None, None)],
                                 "arxiv_id string, question_id long, model_key string, response string, "
                                 "prompt_tokens long, completion_tokens long, total_tokens long")
    rows = {r.arxiv_id: r for r in score.join_responses(req, resp, "gpt-4o-mini").collect()}
    assert rows["1"].relevance_score == 0.5 and not rows["1"].error
    assert rows["2"].error and rows["2"].explanation == score.ERR_NO_ANSWER
    bad = score.join_responses(req, resp, "no-such-model").collect()
    assert all(r.error and r.relevance_score == 0.0 for r in bad)
    u = score.token_usage(score.join_responses(req, resp, "gpt-4o-mini"), models_df(spark)).first()
    assert u.total_prompt_tokens == 0 and u.estimated_cost == 0.0     # NULL counts add 0


def test_last_write(spark):
    df = spark.createDataFrame([("p", 0, 1, 0.1), ("p", 0, 3, 0.3), ("p", 0, 2, 0.2), ("p", 1, 1, 0.9)],
                               "arxiv_id string, question_id int, ord int, v double")
    got = {(r.arxiv_id, r.question_id): (r.v, r.n_writes)
           for r in score.last_write(df, ["arxiv_id", "question_id"], ["ord"], ["v"]).collect()}
    assert got == {("p", 0): (0.3, 3), ("p", 1): (0.9, 1)}


def test_rank_ties_nulls_and_top(spark):
    p = spark.createDataFrame([(i,) for i in ["a", "b", "c", "d"]], "arxiv_id string")
    s = spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", 0.5)], "arxiv_id string, score double")
    scored = rank.attach_scores(p, s)
    assert [r.arxiv_id for r in rank.rank_papers(scored).collect()] == ["b", "a", "c", "d"]
    top = rank.top_papers(scored, 2).collect()
    assert [(r.rank, r.arxiv_id, r.score_str) for r in top] == [(1, "b", "0.90"), (2, "a", "0.50")]
    full = [r.arxiv_id for r in rank.rank_papers(scored).collect()]
    assert [r.arxiv_id for r in rank.top_papers(scored, 3).collect()] == full[:3]   # top-N is a prefix
    with pytest.raises(ValueError):
        rank.top_papers(scored, -1)
    assert rank.show_paper(scored, "c").count() == 1


def test_dedup_by_id(spark):
    t = dt.datetime
    df = spark.createDataFrame(
        [("2201.1v1", "m2", 0, t(2024, 1, 2)), ("2201.1v2", "m1", 0, t(2024, 1, 1)),
         (None, "m1", 1, t(2024, 1, 1)), (None, "m1", 2, t(2024, 1, 1)), ("9.9", "m3", 0, t(2024, 1, 3))],
        "arxiv_id string, email_id string, article_pos int, email_ts timestamp")
    d = dedup.dedup_by_id(df)
    got = sorted((r.arxiv_id, r.email_id, r.article_pos) for r in d.collect() if r.arxiv_id)
    assert got == [("2201.1v2", "m1", 0), ("9.9", "m3", 0)]
    assert d.where(F.col("arxiv_id").isNull()).count() == 2               # NULL ids are kept
    assert sorted(map(tuple, dedup.dedup_by_id(d).collect()), key=repr) == sorted(map(tuple, d.collect()), key=repr)


def test_dedup_by_title_and_skip_stored(spark):
    df = spark.createDataFrame([("A", 1), ("a", 2), ("A", 3)], "title string, paper_key int")
    assert sorted(r.paper_key for r in dedup.dedup_by_title(df, order=["paper_key"]).collect()) == [1, 2]
    new = spark.createDataFrame([("1",), ("2",)], "arxiv_id string")
    old = spark.createDataFrame([("2",), (None,)], "arxiv_id string")
    assert [r.arxiv_id for r in dedup.skip_stored(new, old).collect()] == ["1"]


def test_pending_requests(spark):
    req = score.pair_requests(papers(spark).select("arxiv_id"), questions_df(spark, ["q1", "q2"]))
    answered = spark.createDataFrame([("1", 0, "gpt-4o"), ("2", 1, "gpt-4o"), ("3", 0, "other")],
                                     "arxiv_id string, question_id long, model_key string")
    left = {(r.arxiv_id, r.question_id) for r in score.pending_requests(req, answered, "gpt-4o").collect()}
    assert left == {("1", 1), ("2", 0), ("3", 0), ("3", 1)}


def test_dedup_hot_id_is_limited_before_the_shuffle(spark):
    n = 3000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
                               .alias("arxiv_id"), F.col("id").alias("ord"))
    d = dedup.dedup_by_id(df, order=["ord"], fallback=["ord"])
    assert d.count() == n - n // 3 + 1
    assert d.where(F.col("arxiv_id") == "hot").first().ord == 0
    p = d._jdf.queryExecution().executedPlan().toString()
    # partial limit under the exchange, final limit above it
    assert p.index("Exchange hashpartitioning") < p.rindex("WindowGroupLimit")


class Counting:
    """Records every call in a file so the test can count paid calls across runs."""
    log = None

    def analyze(self, prompt, model_id, max_tokens):
        with open(Counting.log, "a") as f:
            f.write("x\n")
        return "<explanation>e</explanation><score>4</score>", {"prompt_tokens": 1, "completion_tokens": 1,
                                                               "total_tokens": 2}


def test_score_and_store_pays_each_call_once(spark, tmp_path):
    import os
    from litsift.session import scratch_path
    log = str(tmp_path / "calls.log")
    os.environ["LITSIFT_TEST_CALL_LOG"] = log

    class Factory:
        def __call__(self):
            Counting.log = os.environ.get("LITSIFT_TEST_CALL_LOG", log)
            return Counting()

    path = scratch_path(spark, "t-answers")
    q = questions_df(spark, ["q1", "q2"])
    first = score.pair_requests(papers(spark).where(F.col("arxiv_id") != "3"), q)
    s1 = score.score_and_store(first, Factory(), "gpt-4o", path)
    assert s1.count() == 4 and all(r.relevance_score == 0.4 for r in s1.collect())
    everything = score.pair_requests(papers(spark), q)
    s2 = score.score_and_store(everything, Factory(), "gpt-4o", path)
    assert s2.count() == 6 and not s2.where(F.col("error")).count()
    assert sum(1 for _ in open(log)) == 6          # 4 calls, then only the 2 new ones


def test_dedup_keeps_rows_without_any_key(spark):
    df = spark.createDataFrame([(None, None, None, 1), (None, None, None, 2)],
                               "arxiv_id string, email_id string, article_pos int, o int")
    assert dedup.dedup_by_id(df, order=["o"]).count() == 2


def test_fallbacks_beyond_the_broadcast_bound(spark, monkeypatch):
    """Bytes decide what is broadcast; beyond the bound the results are the same."""
    from litsift.operators import common
    q = questions_df(spark, ["graph attention networks", "birds and the weather", "vision"])
    assert common.measured_bytes(q.select("question", F.col("question_id").cast("long"))) == 3 * 8 + 24 + 21 + 6
    want = sorted((r.arxiv_id, r.score) for r in score.lexical_mean_scores(papers(spark), q).collect())
    tight = lambda df, max_bytes=1: common.bounded_broadcast(df, max_bytes)
    monkeypatch.setattr(score, "bounded_broadcast", lambda df, max_bytes=1: tight(df))
    got = score.lexical_mean_scores(papers(spark), q)
    assert sorted((r.arxiv_id, r.score) for r in got.collect()) == want
    p = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in p or "BroadcastHashJoin" not in p.split("HashAggregate")[-1]
    pairs = score.pair_requests(papers(spark), q, max_bytes=1)
    assert pairs.count() == 9
    assert "CartesianProduct" in pairs._jdf.queryExecution().executedPlan().toString() or \
        "BroadcastNestedLoopJoin" in pairs._jdf.queryExecution().executedPlan().toString()


def test_means_without_pairs_are_those_of_all_pairs(spark):
    q = questions_df(spark, ["a", "b", "c"])
    answer = lambda s: f"<explanation>x</explanation><score>{s}</score>"
    rows = [("1", 0, "gpt-4o", answer(5), 1), ("1", 0, "gpt-4o", answer(7), 2), ("1", 1, "gpt-4o", "no score", 1), ("2", 2, "gpt-4o", answer(10), 1),
            ("2", 9, "gpt-4o", answer(9), 1), ("7", 0, "gpt-4o", answer(9), 1), ("3", 0, "gpt-4o-mini", answer(9), 1)]
    resp = spark.createDataFrame(rows, "arxiv_id string, question_id long, model_key string, response string, answered_at long")
    resp = resp.select("*", *[F.lit(None).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")])
    req = score.pair_requests(papers(spark).select("arxiv_id"), q)
    for model in ("gpt-4o", "no-such-model"):
        for errors in ("zero", "skip"):
            want = score.mean_score(score.join_responses(req, resp, model), errors)
            got = score.answer_means(papers(spark).unionByName(papers(spark)), q, resp, model, errors)
            key = lambda df: sorted((r.arxiv_id, None if r.score is None else round(r.score, 9)) for r in df.collect())
            assert key(got) == key(want), (model, errors)
            assert "CartesianProduct" not in (p := got._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in p
    with pytest.raises(ValueError):
        score.answer_means(papers(spark), q, resp, "gpt-4o", "mean")


def test_top_of_is_the_top_of_all(spark):
    p = spark.createDataFrame([(str(i % 40), i, "t" * i) for i in range(60)], "arxiv_id string, n int, title string")
    s = spark.createDataFrame([(str(i), (i * 7 % 10) / 10) for i in range(35)], "arxiv_id string, score double")
    for n in (0, 3, 12, 38, 100):
        want = [(r.arxiv_id, r.score) for r in rank.top_papers(rank.attach_scores(p, s), n).collect()]
        top = rank.top_of(p, s, n)
        assert [(r.arxiv_id, r.score) for r in top.collect()] == want and len({(r.arxiv_id, r.n) for r in top.collect()}) == len(want)
