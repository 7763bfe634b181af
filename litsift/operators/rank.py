"""Ranking and display."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litsift.functions.text import format_score
from litsift.operators.common import numbered

DEFAULT_TOP_N = 10


def attach_scores(papers: DataFrame, scores: DataFrame, id_col: str = "arxiv_id") -> DataFrame:
    """Each paper's mean score (left join; no score -> NULL; duplicates of an id all get
    it)."""
    s = scores.select(F.col("arxiv_id").alias(id_col), "score")
    base = papers.drop("score") if "score" in papers.columns else papers
    return base.join(s, id_col, "left")


def rank_order(id_col: str = "arxiv_id") -> list:
    """Score descending with NULL ("no score") last, then id: a total, stable order."""
    return [F.col("score").desc_nulls_last(), F.col(id_col).asc_nulls_last()]


def rank_papers(scored: DataFrame, id_col: str = "arxiv_id") -> DataFrame:
    """O1: all papers in their order, with ``rank`` from 1.

    Ranks are counted over range partitions (``numbered``), so no task sees all rows; the
    result is sorted by them, which a saved file keeps.
    """
    base = scored.drop("rank") if "rank" in scored.columns else scored
    ranked = numbered(base, rank_order(id_col), "rank").drop("rank_of")
    return ranked.withColumn("rank", F.col("rank").cast("int")).orderBy("rank")


def top_papers(scored: DataFrame, n: int = DEFAULT_TOP_N, id_col: str = "arxiv_id") -> DataFrame:
    """O2 + W2 + P27: the ``n`` best papers with display rank and formatted score.

    ``orderBy().limit(n)`` is planned as TakeOrderedAndProject (a per-task top-n heap, then
    one merge of n rows per task); the rank is numbered over those n rows only.
    """
    if n < 0:
        raise ValueError("n must be >= 0")
    top = scored.orderBy(*rank_order(id_col)).limit(n)
    w = Window.orderBy(*rank_order(id_col))
    return top.withColumn("rank", F.row_number().over(w)).withColumn("score_str", format_score("score"))


def top_of(papers: DataFrame, scores: DataFrame, n: int = DEFAULT_TOP_N, id_col: str = "arxiv_id") -> DataFrame:
    """O2 from papers and their scores: the n best are taken by id and score alone, then joined
    with their papers, so that no other paper's columns are shuffled."""
    best = attach_scores(papers.select(id_col), scores, id_col).orderBy(*rank_order(id_col)).limit(max(n, 0)).distinct()
    same = F.col(f"_best.{id_col}").eqNullSafe(F.col(f"_p.{id_col}"))
    base = papers.drop("score") if "score" in papers.columns else papers
    found = base.alias("_p").join(F.broadcast(best.alias("_best")), same).select("_p.*", "_best.score")  # n rows at most
    return top_papers(found, n, id_col)


def show_paper(papers: DataFrame, paper_id: str | list[str] | None = None, id_col: str = "arxiv_id") -> DataFrame:
    """Papers by id, one or several, or all of them. The filter reaches the scan of
    stored papers; where these are ``sorted_by`` the id, it reads the row groups that may hold it."""
    if paper_id is None:
        return papers
    ids = [paper_id] if isinstance(paper_id, str) else list(paper_id)
    return papers.where(F.col(id_col).isin(ids))
