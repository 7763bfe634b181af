"""Catalogue lookup as joins.

The reference asks a remote index three questions per paper, first hit wins:

1. exact title            -> equi-join on the normalised title
2. all title words        -> containment search over token sets (``containment``)
3. first author + phrase  -> equi-join on (author last name, key phrase)

Both sides are first reduced to keys in one pass (``prepare_papers``, ``catalogue_index``):
normalised title, token-set key (sorted distinct tokens, space-joined, so the token array
is ``split(key, ' ')`` and never needs to be carried through an aggregate), author last
names and phrase words.

Scale rules followed here (a title, author or token may hold a third of all rows):

* Duplicates are collapsed before any pairing: papers are matched as *distinct keys* and the
  catalogue is reduced to the first ``k + 1`` entries per key with a ``row_number() <= k+1``
  filter, planned as a partial ``WindowGroupLimit`` before the shuffle. The joins of tier 1
  have at most ``k + 1`` rows per key on one side; AQE's skew-join handling splits the other
  (hot) side. In tier 2 titles read lists of sets that hold their two rarest tokens, best
  first, and stop when they have enough. In tier 3 a hot (author, phrase) is split by salt;
  all of an author's titles with a phrase meet there, and are cut to ``k + 1`` per title in
  the map stage, before entries are joined.
* Candidates per paper are cut to the top ``k`` by ``(sim desc, entry_id)``: a
  deterministic order (the remote "relevance" order is not defined by the reference).
* ``lookup_cascade`` writes the prepared inputs and each tier's result (as Parquet, to the
  shared folder), so the catalogue is read and tokenised once for all three tiers and
  the anti-joins between tiers do not recompute earlier tiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsift.functions import mail
from litsift.functions.text import (STOP_WORDS, first_author_last_name, last_name,
                                    norm_title, normalize_abstract, split_authors, token_set_key,
                                    tokens)
from litsift.operators.common import MAX_BROADCAST_BYTES, join_hot, materialize, measured_bytes, top_k
from litsift.operators.containment import holding_sets, key_digest, key_tokens

DEFAULT_K = 5          # results per query (max_results of the reference)


def jaccard(a, b) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def key_grams(key) -> Column:
    """Distinct 1- and 2-word phrases of a space-joined word string, with plain expressions
    (no lambdas): bigrams are the non-overlapping pairs of the string and of the string
    without its first word."""
    k = F.col(key) if isinstance(key, str) else key
    pairs = r"(\S+ \S+)"
    shifted = F.regexp_replace(k, r"^\S+ ?", "")
    return F.array_distinct(F.concat(key_tokens(k), F.regexp_extract_all(k, F.lit(pairs), F.lit(1)),
                                     F.regexp_extract_all(shifted, F.lit(pairs), F.lit(1))))


def has_phrase(key, phrase) -> Column:
    """``phrase`` (1-2 words) occurs as consecutive words of the space-joined ``key``."""
    k = F.col(key) if isinstance(key, str) else key
    p = F.col(phrase) if isinstance(phrase, str) else phrase
    return F.contains(F.concat(F.lit(" "), k, F.lit(" ")), F.concat(F.lit(" "), p, F.lit(" ")))


STOP_RE = r"(?<!\S)(?:" + "|".join(STOP_WORDS) + r")(?!\S)"


def phrase_key(col) -> Column:
    """The title's words as one space-joined string: punctuation removed inside words (before
    lower-casing), stop words and empty words dropped."""
    c = col if isinstance(col, Column) else F.col(col)
    s = F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}\s]", ""))
    s = F.regexp_replace(s, STOP_RE, "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


# ---- one-pass preparation ---------------------------------------------------------------

def prepare_papers(papers: DataFrame, self_col: str | None = None) -> DataFrame:
    """Papers (``paper_key, title, authors``) -> lookup keys."""
    tok = tokens("title")
    p_self = F.col(self_col).cast("string") if self_col else F.lit(None).cast("string")
    first = F.lower(first_author_last_name(split_authors("authors")))
    return papers.select(
        "paper_key", p_self.alias("p_self"),
        norm_title("title").alias("nkey"),
        token_set_key(tok).alias("q_key"), F.size(tok).alias("n_q"),
        F.coalesce(first, F.lit("")).alias("a_last"),
        F.coalesce(F.regexp_extract(phrase_key("title"), r"^(\S+(?: \S+)?)", 1), F.lit("")).alias("phrase"),
    )


def catalogue_index(catalogue: DataFrame, self_col: str | None = None) -> DataFrame:
    """Catalogue (``entry_id, title, authors array``) -> lookup keys, one row per entry."""
    c_self = F.col(self_col).cast("string") if self_col else F.lit(None).cast("string")
    lasts = F.filter(F.array_distinct(F.transform("authors", lambda a: F.lower(last_name(a)))),
                     lambda x: x.isNotNull() & (x != ""))
    return catalogue.select(
        "entry_id", c_self.alias("c_self"),
        norm_title("title").alias("nkey"),
        token_set_key(tokens("title")).alias("c_key"),
        phrase_key("title").alias("pw_key"),
        F.coalesce(lasts, F.array().cast("array<string>")).alias("c_lasts"),
    )


def _finish(cand: DataFrame, papers_side: DataFrame, keys: list[str], k: int, tier: int,
            exclude_self: bool) -> DataFrame:
    """Per-key candidates (<= k+1 per key, ranked ``r`` by (sim desc, entry_id)) -> per-paper
    top k. Every paper with a key gets that key's list, so without self-exclusion the key's
    rank is the paper's rank (no second shuffle); with it, the paper's own entry is removed
    and the rest re-ranked per paper."""
    joined = papers_side.join(cand, keys)
    if not exclude_self:
        ranked = joined.where(F.col("r") <= k).withColumn("rank", F.col("r").cast("int"))
    else:
        joined = joined.where(~F.col("p_self").eqNullSafe(F.col("c_self")))
        ranked = top_k(joined, ["paper_key"], [F.col("sim").desc(), F.col("entry_id")], k)
    return ranked.select("paper_key", "entry_id", "sim", "rank", F.lit(tier).alias("tier"))


def _tier1(pp: DataFrame, idx: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    p = pp.where(F.col("nkey") != "").select("paper_key", "p_self", "nkey")
    c = idx.where(F.col("nkey") != "").select("entry_id", "c_self", "nkey")
    per_key = top_k(c, ["nkey"], [F.col("entry_id")], k + 1, "r").withColumn("sim", F.lit(1.0))
    return _finish(per_key, p, ["nkey"], k, 1, exclude_self)


def _tier2(pp: DataFrame, idx: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    p = pp.where(F.col("n_q") > 0)
    c = idx.where(F.col("c_key") != "")
    # The best k + 1 entries of a title lie in its best k + 1 token sets by (sim desc, first
    # entry), so other sets go before the entries are joined.
    sets = c.groupBy("c_key").agg(F.min("entry_id").alias("first_entry"))
    held = holding_sets(p.select("q_key").distinct(), sets, k + 1, keys=False)
    pairs = top_k(held, ["qid"], [F.col("sim").desc(), F.col("first_entry")], k + 1, "r").select("qid", "gid", "sim")
    entries = top_k(c.select("entry_id", "c_self", key_digest("c_key").alias("gid")), ["gid"], [F.col("entry_id")], k + 1, "r").drop("r")
    per_key = top_k(pairs.join(entries, "gid"), ["qid"],
                    [F.col("sim").desc(), F.col("entry_id")], k + 1, "r").drop("gid")
    return _finish(per_key, p.select("paper_key", "p_self", key_digest("q_key").alias("qid")), ["qid"], k, 2, exclude_self)


def _tier3(pp: DataFrame, idx: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    keys, ckey = ["a_last", "phrase", "q_key"], ["a_last", "pw_key", "c_key"]
    digest = lambda cols: key_digest(F.to_json(F.struct(*cols)))  # noqa: E731  stands for the long keys
    p = pp.where((F.col("a_last") != "") & (F.col("phrase") != "")).select("paper_key", "p_self", *keys, digest(keys).alias("pid"))
    c = idx.select("entry_id", "c_self", "pw_key", "c_key", F.explode("c_lasts").alias("a_last")).withColumn("gid", digest(ckey))
    ranked = top_k(c, ["gid"], [F.col("entry_id")], k + 1, "r")
    entries = ranked.select("entry_id", "c_self", "gid")
    # One row per phrase of each distinct (author, title words, token set) group, of those that are
    # asked for if these are few bytes; it carries a digest rather than the long keys.
    groups = ranked.where(F.col("r") == 1).select(*ckey, F.col("entry_id").alias("first_entry"), "gid")
    titles = materialize(p.select(*keys, "pid").distinct(), "titles")
    asked = titles.select("a_last", "phrase").distinct()
    grams = groups.select("gid", "a_last", F.explode(key_grams("pw_key")).alias("phrase"))
    if measured_bytes(asked) <= MAX_BROADCAST_BYTES:
        grams = grams.join(F.broadcast(asked), ["a_last", "phrase"], "left_semi")
    hits = join_hot(titles, grams, ["a_last", "phrase"]).select(*keys, "pid", "gid")
    pairs = hits.join(groups.withColumnRenamed("a_last", "g_last"), "gid") \
        .where((F.col("g_last") == F.col("a_last"))
               & has_phrase("pw_key", "phrase")) \
        .select("pid", "gid", "first_entry", jaccard(key_tokens("q_key"), key_tokens("c_key")).alias("sim"))
    pairs = top_k(pairs, ["pid"], [F.col("sim").desc(), F.col("first_entry")], k + 1, "r").select("pid", "gid", "sim")
    per_key = top_k(pairs.join(entries, "gid"), ["pid"], [F.col("sim").desc(), F.col("entry_id")], k + 1, "r") \
        .select("pid", "entry_id", "c_self", "sim", "r")
    return _finish(per_key, p.select("paper_key", "p_self", "pid"), ["pid"], k, 3, exclude_self)


def _prep(papers, catalogue, self_cols, index=None):
    """Both sides' keys; a stored ``index`` takes the place of the catalogue."""
    return (prepare_papers(papers, self_cols[0] if self_cols else None),
            index if index is not None else catalogue_index(catalogue, self_cols[1] if self_cols else None))


def tier_exact(papers: DataFrame, catalogue: DataFrame | None, k: int = DEFAULT_K,
               self_cols: tuple[str, str] | None = None, index: DataFrame | None = None) -> DataFrame:
    """Catalogue entries whose normalised title equals the paper's."""
    return _tier1(*_prep(papers, catalogue, self_cols, index), k, self_cols is not None)


def tier_tokens(papers: DataFrame, catalogue: DataFrame | None, k: int = DEFAULT_K,
                self_cols: tuple[str, str] | None = None, index: DataFrame | None = None) -> DataFrame:
    """Entries whose title contains every (non stop word) token of the paper's title,
    found under the title's two rarest tokens and verified with ``array_except``."""
    return _tier2(*_prep(papers, catalogue, self_cols, index), k, self_cols is not None)


def tier_author_phrase(papers: DataFrame, catalogue: DataFrame | None, k: int = DEFAULT_K,
                       self_cols: tuple[str, str] | None = None, index: DataFrame | None = None) -> DataFrame:
    """An entry by the paper's first author (last name, case-insensitive) whose title
    holds the paper's key phrase (first two non stop words, consecutive once stop words
    are skipped), as an equi-join on (last name, phrase) against the entries' word n-grams."""
    return _tier3(*_prep(papers, catalogue, self_cols, index), k, self_cols is not None)


def _materialize(df: DataFrame, on: bool) -> DataFrame:
    return materialize(df) if on else df


def write_catalogue_index(catalogue: DataFrame, path: str, self_col: str | None = None) -> None:
    """Build the catalogue's lookup keys once and store them (Parquet) for many runs."""
    catalogue_index(catalogue, self_col).write.mode("overwrite").parquet(path)


def lookup_cascade(papers: DataFrame, catalogue: DataFrame | None, k: int = DEFAULT_K,
                   self_cols: tuple[str, str] | None = None, materialize: bool = True,
                   index: DataFrame | None = None) -> DataFrame:
    """Tier 1, then tier 2 for papers tier 1 missed, then tier 3 (first tier with any
    result wins). Output ``paper_key, entry_id, sim, rank, tier`` with ``rank`` 1..k.

    ``index`` is a stored ``catalogue_index`` (``write_catalogue_index``); without it the
    keys are built from ``catalogue``. With ``materialize`` the prepared keys and each
    tier's result are written to the shared folder, which also cuts the lineage of this long plan."""
    ex = self_cols is not None
    pp = prepare_papers(papers, self_cols[0] if self_cols else None)
    idx = index if index is not None else catalogue_index(catalogue, self_cols[1] if self_cols else None)
    pp = _materialize(pp, materialize)
    idx = idx if index is not None else _materialize(idx, materialize)
    t1 = _materialize(_tier1(pp, idx, k, ex), materialize)
    rest = pp.join(t1.where(F.col("rank") == 1).select("paper_key"), "paper_key", "left_anti")
    t2 = _materialize(_tier2(rest, idx, k, ex), materialize)
    rest = rest.join(t2.where(F.col("rank") == 1).select("paper_key"), "paper_key", "left_anti")
    t3 = _materialize(_tier3(rest, idx, k, ex), materialize)
    return t1.unionByName(t2).unionByName(t3)


def enrich(papers: DataFrame, catalogue: DataFrame, k: int = DEFAULT_K,
           self_cols: tuple[str, str] | None = None, matches: DataFrame | None = None,
           index: DataFrame | None = None) -> DataFrame:
    """Papers with their first lookup result's abstract, id, categories, pdf url and
    publication time. Papers without a result are dropped (see ``lookup_misses``)."""
    m = matches if matches is not None else lookup_cascade(papers, catalogue, k, self_cols, index=index)
    best = m.where(F.col("rank") == 1).select("paper_key", "entry_id", "tier")
    cat = catalogue.select("entry_id",
                           normalize_abstract("summary").alias("abstract"),
                           mail.entry_id_tail("entry_id").alias("arxiv_id"),
                           "categories", "pdf_url", "published")
    drop = [c for c in ("abstract", "arxiv_id", "categories", "pdf_url", "published") if c in papers.columns]
    return papers.drop(*drop).join(best, "paper_key").join(cat, "entry_id")


def lookup_misses(papers: DataFrame, matches: DataFrame) -> DataFrame:
    """Papers the cascade did not find."""
    return papers.join(matches.where(F.col("rank") == 1).select("paper_key"), "paper_key", "left_anti")


def lookup_counts(papers: DataFrame, matches: DataFrame) -> DataFrame:
    """A4: papers looked up, found (per tier) and not found, in one row."""
    best = matches.where(F.col("rank") == 1).select("paper_key", "tier")
    j = papers.select("paper_key").join(best, "paper_key", "left")
    return j.agg(F.count(F.lit(1)).alias("n_papers"),
                 F.count("tier").alias("n_found"),
                 F.count_if(F.col("tier").isNull()).alias("n_missed"),
                 F.count_if(F.col("tier") == 1).alias("n_tier1"),
                 F.count_if(F.col("tier") == 2).alias("n_tier2"),
                 F.count_if(F.col("tier") == 3).alias("n_tier3"))
