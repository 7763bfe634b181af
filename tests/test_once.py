"""Every pair is scored once and completely; rules of sessions; one-token titles; answers that repeat or failed."""

import pytest

from litsift.operators import dedup, lookup, score
from litsift.operators.score import join_responses, mean_score, pending_requests
from litsift.functions.text import format_score
from litsift.plans.triage import analyze, triage
from litsift.schemas import CATALOGUE
from litsift.session import get_session, shared_dir

ANSWERS = "arxiv_id string, question_id long, model_key string, response string, prompt_tokens long, completion_tokens long, total_tokens long, call_error string"


def catalogue(spark):
    rows = [(f"http://arxiv.org/abs/2001.0000{i}", t, ["Vega, Sol"], s, None, "pdf", ["q-bio"])
            for i, (t, s) in enumerate([("Kelp forests", "kelp grows"), ("Tundra", "frozen soil"), ("Mangrove: roots of the coast", "roots")])]
    return spark.createDataFrame(rows, CATALOGUE)


class Counting:
    def __init__(self, path):
        self.path = path

    def analyze(self, prompt, model_id, max_tokens):
        with open(self.path, "a") as f:
            f.write("x")
        return "<explanation>e</explanation><score>5</score>", {"prompt_tokens": 1, "completion_tokens": 1, "total_tokens": 2}


def test_triage_pays_each_pair_once(spark, tmp_path):
    calls = str(tmp_path / "calls")
    raw = spark.createDataFrame([("a", "Kelp forests", ""), ("b", "Tundra", "")], "paper_key string, title string, authors string")
    questions = spark.createDataFrame([(1, "kelp?"), (2, "soil?")], "question_id long, question string")
    r = triage(raw, catalogue(spark), questions, scorer_factory=lambda: Counting(calls), dedup_order=["paper_key"])
    assert [x.count() for x in (r.ranked, r.top, r.scores, r.misses)] == [2, 2, 4, 0]
    assert r.usage.first().n_calls == 4 and r.counts.first().n_found == 2
    assert len(open(calls).read()) == 4


def test_lexical_scores_hold_zero_pairs(spark):
    papers = spark.createDataFrame([("p", "Kelp forests", "kelp grows", None, ["c"]), ("q", "Tundra", "ice", None, ["c"])],
                                   "arxiv_id string, title string, abstract string, authors string, categories array<string>")
    questions = spark.createDataFrame([(1, "kelp forests"), (2, "volcano")], "question_id long, question string")
    scores = analyze(papers, questions)
    assert {(r.arxiv_id, r.question_id): r.relevance_score for r in scores.collect()} == {("p", 1): 1.0, ("p", 2): 0.0, ("q", 1): 0.0, ("q", 2): 0.0}
    assert {r.arxiv_id: r.score for r in mean_score(scores).collect()} == {"p": 0.5, "q": 0.0}


def test_repeated_answers_give_one_row_and_failed_calls_are_pending(spark):
    requests = spark.createDataFrame([("p", 1), ("p", 2)], "arxiv_id string, question_id long")
    model = next(iter(score.MODEL_KEYS))
    good = "<explanation>e</explanation><score>7</score>"
    answers = spark.createDataFrame([("p", 1, model, good, 1, 1, 2, None), ("p", 1, model, good, 1, 1, 2, None), ("p", 2, model, None, 0, 0, 0, "rate limit")], ANSWERS)
    rows = {r.question_id: r for r in join_responses(requests, answers, model).collect()}
    assert len(rows) == 2 and rows[1].relevance_score == 0.7 and rows[2].error
    assert [r.question_id for r in pending_requests(requests, answers, model).collect()] == [2]


def test_one_token_titles_are_searched(spark):
    p = spark.createDataFrame([("a", "Mangrove", "")], "paper_key string, title string, authors string")
    found = lookup.tier_tokens(p, catalogue(spark)).collect()
    assert [(r.paper_key, r.entry_id[-1]) for r in found] == [("a", "2")]


def test_rows_without_a_key_all_stay(spark):
    df = spark.createDataFrame([(None, "m", 1), (None, "m", 2), ("t", "m", 3), ("t", "m", 4)], "title string, email_id string, article_pos int")
    assert sorted(r.article_pos for r in dedup.dedup_by_title(df).collect()) == [1, 2, 3]


def test_scores_have_no_thousands_separator(spark):
    assert spark.createDataFrame([(12345.678,)], "x double").select(format_score("x")).first()[0] == "12345.68"


class Cluster:
    """Stands for a session on a cluster whose shared folder isn't set."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)


def test_session_takes_no_master_of_its_own(monkeypatch):
    from pyspark.sql import SparkSession

    seen = {}
    monkeypatch.setattr(SparkSession.Builder, "config", lambda self, k=None, v=None, **kw: seen.update({k: v}) or self)
    monkeypatch.setattr(SparkSession.Builder, "getOrCreate", lambda self: type("S", (), {"sparkContext": type("C", (), {"setLogLevel": staticmethod(lambda x: None)})}))
    get_session()
    assert "spark.master" not in seen and "spark.sql.shuffle.partitions" not in seen
