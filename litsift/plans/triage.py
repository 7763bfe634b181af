"""Whole-run plans: recent papers from mail (U5) and the ranked reading list.

``recent_papers`` is lazy. ``triage`` runs the lookup tiers and the scoring while it is
built and writes their results to the shared folder: every pair is scored once, whichever
of its outputs are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsift.operators import dedup, extract, filters, lookup, rank, score
from litsift.operators.common import materialize
from litsift.sources.models import DEFAULT_MODEL, models_df
from litsift.sources.papers import to_papers


def recent_papers(messages: DataFrame, since=None, now=None, days: int = filters.DEFAULT_SINCE_DAYS,
                  needle: str = filters.DIGEST_NEEDLE, marker: str = filters.DIGEST_MARKER,
                  heading: str = "h2", title_in_link: bool = True) -> DataFrame:
    """Digest messages received since ``since`` (default: ``days`` before ``now``) ->
    cleaned papers. Narrow transformations only: no shuffle."""
    f = filters.message_fields(messages)
    f = filters.filter_digests(f, since if since is not None else filters.default_since(now, days), needle)
    f = filters.filter_marker(f, marker)
    raw = extract.extract_articles(f, heading=heading, title_in_link=title_in_link)
    return extract.clean_papers(raw)


@dataclass
class TriageResult:
    ranked: DataFrame   # every found paper with its mean score, sorted
    top: DataFrame      # the n best with display rank
    scores: DataFrame   # one row per (paper, question)
    usage: DataFrame    # token totals and cost (one row)
    misses: DataFrame   # papers the catalogue lookup did not find
    counts: DataFrame   # looked up / found per tier / missed (one row)


def analyze(papers: DataFrame, questions: DataFrame, model: str = DEFAULT_MODEL,
            scorer_factory=None, responses: DataFrame | None = None,
            answers_path: str | None = None) -> DataFrame:
    """Score every (paper, question) pair -> one score row per pair.

    With ``scorer_factory`` the model is called (U1) -- with ``answers_path`` only for
    requests not answered before, answers stored there once; with ``responses`` stored
    answers are joined (J9); with neither the lexical scorer (U2) is used.
    """
    valid, _rejected = filters.split_valid(papers)
    if scorer_factory is not None:  # the paper's part of its prompts is built once
        heads = score.request_heads(valid)
        if answers_path:
            return score.score_and_store(score.pair_requests(heads, questions), scorer_factory, model, answers_path)
        return score.score_with(score.pair_requests(heads, score.asked_together(questions)), scorer_factory, model)
    if responses is not None:
        return score.join_responses(score.pair_requests(valid.select("arxiv_id"), questions.select("question_id")), responses, model)
    shared = score.lexical_pair_scores(valid, questions).select("arxiv_id", F.col("question_id").alias("_qid"), "relevance_score")
    every = score.pair_requests(valid.select("arxiv_id"), questions.select("question_id"))
    pairs = every.join(shared.withColumnRenamed("_qid", "question_id"), ["arxiv_id", "question_id"], "left") \
        .withColumn("relevance_score", F.coalesce("relevance_score", F.lit(0.0)))
    return pairs.select("arxiv_id", "question_id", F.lit(model).alias("model_key"), "relevance_score",
                        F.lit(None).cast("string").alias("explanation"), F.lit(False).alias("error"),
                        F.lit(None).cast("string").alias("parse_error"),
                        (F.col("relevance_score") > 1).alias("out_of_range"),
                        F.lit(None).cast("long").alias("prompt_tokens"),
                        F.lit(None).cast("long").alias("completion_tokens"),
                        F.lit(None).cast("long").alias("total_tokens"))


def triage(raw_papers: DataFrame, catalogue: DataFrame, questions: DataFrame, model: str = DEFAULT_MODEL,
           n: int = rank.DEFAULT_TOP_N, k: int = lookup.DEFAULT_K, scorer_factory=None,
           responses: DataFrame | None = None, dedup_order: list[str] | None = None,
           answers_path: str | None = None, index: DataFrame | None = None) -> TriageResult:
    """U4: raw papers -> catalogue lookup -> typed, deduplicated papers -> scores -> mean ->
    ranked list and top ``n``. ``raw_papers`` needs ``title, authors`` and a unique
    ``paper_key`` (derived as ``email_id:article_pos`` for papers from ``recent_papers``)."""
    if "paper_key" not in raw_papers.columns:
        raw_papers = raw_papers.withColumn(
            "paper_key", F.concat_ws(":", F.col("email_id"), F.col("article_pos").cast("string")))
    matches = lookup.lookup_cascade(raw_papers, catalogue, k, index=index)
    enriched = to_papers(lookup.enrich(raw_papers, catalogue, k, matches=matches))
    papers = materialize(dedup.dedup_by_id(enriched, order=dedup_order, fallback=["paper_key"]), "papers")
    if scorer_factory is None and responses is None:
        means = score.lexical_mean_scores(papers, questions)
    scores = materialize(analyze(papers, questions, model, scorer_factory, responses, answers_path), "scores")
    if scorer_factory is not None or responses is not None:
        means = score.mean_score(scores)
    scored = rank.attach_scores(papers, means)
    return TriageResult(
        ranked=rank.rank_papers(scored),
        top=rank.top_of(papers, means, n),
        scores=scores,
        usage=score.token_usage(scores, models_df(raw_papers.sparkSession)),
        misses=lookup.lookup_misses(raw_papers, matches),
        counts=lookup.lookup_counts(raw_papers, matches),
    )
