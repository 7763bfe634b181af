"""Dedup and set operations.

Dedup keeps the first row per key by a deterministic order (unlike ``dropDuplicates``,
whose survivor depends on task timing). ``row_number() = 1`` is planned as a partial
WindowGroupLimit, so a key holding a third of all rows ships one row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsift.functions.mail import arxiv_id_base
from litsift.operators.common import top_k


def _order(df: DataFrame, order: list[str] | None) -> list:
    cols = order if order is not None else [c for c in ("email_ts", "email_id", "article_pos", "paper_key")
                                            if c in df.columns]
    if not cols:
        raise ValueError("dedup needs an order (no email_ts/email_id/article_pos/paper_key column)")
    return [F.col(c).asc_nulls_last() for c in cols]


def dedup_by_id(papers: DataFrame, id_col: str = "arxiv_id", order: list[str] | None = None,
                fallback: list[str] | None = None) -> DataFrame:
    """One paper per identifier, version suffix ignored (``v1``/``v2`` are one paper).

    Rows without an identifier are all kept: their key falls back to ``fallback`` columns
    (default email id + article position), so NULLs do not collapse into one group.
    """
    fb = fallback if fallback is not None else [c for c in ("email_id", "article_pos") if c in papers.columns]
    own = F.when(F.coalesce(*[F.col(c).cast("string") for c in fb]).isNotNull(),
                 F.concat(F.lit("#"), F.concat_ws(":", *[F.col(c).cast("string") for c in fb]))) if fb \
        else F.lit(None).cast("string")
    return _first_per_key(papers, F.coalesce(arxiv_id_base(F.col(id_col)), own), order)


def dedup_by_title(papers: DataFrame, title_col: str = "title", order: list[str] | None = None) -> DataFrame:
    """One paper per exact title (rows with a NULL title are kept)."""
    return _first_per_key(papers, F.col(title_col), order)


def _first_per_key(papers: DataFrame, key, order: list[str] | None) -> DataFrame:
    """The first row of each key; rows without a key all pass, and are never shuffled."""
    keyed = papers.withColumn("_dkey", key)
    ranked = top_k(keyed.where(F.col("_dkey").isNotNull()), ["_dkey"], _order(papers, order), 1, "_drank")
    return ranked.drop("_dkey", "_drank").unionByName(keyed.where(F.col("_dkey").isNull()).drop("_dkey"))


def union_all(*dfs: DataFrame) -> DataFrame:
    """D3: union by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def skip_stored(new: DataFrame, stored: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """Drop papers already stored (anti-join on the key)."""
    return new.join(stored.select(key).where(F.col(key).isNotNull()), key, "left_anti")
