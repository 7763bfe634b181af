"""Which token sets hold all tokens of a query (J2), best first and no further than needed.

* Prefix: a set that holds a query holds its two rarest tokens. So sets are posted under the
  pairs of rarest tokens that are asked for, and under single tokens for queries of one. A
  frequent token makes a list that is only as long as it stands together with the other one.
* Order: a query is ranked by ``|query| / |set|``, so a list is sorted by the sets' size (then
  by first entry) and cut into blocks. Queries read the first block, then twice as many in
  each round, until they have found enough or the list has ended. What they have not read
  ranks behind what they have.
* Bytes: a title may be long, so joins and results carry a digest of its key. What is asked for is small
  next to the catalogue and goes to the sets (broadcast within measured bytes), so sets are not shuffled
  under each of their tokens. Keys are read only for candidates that need a look: not for a
  query's own set, nor for queries of one or two tokens, which their list has matched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsift.operators.common import MAX_BROADCAST_BYTES, bounded_broadcast, materialize, measured_bytes, numbered, top_k

#: Postings of a block.
BLOCK = 64


def key_tokens(key) -> F.Column:
    """Token array of a token-set key ('' -> empty array)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.when(k == "", F.array().cast("array<string>")).otherwise(F.split(k, " "))


def key_digest(key) -> F.Column:
    """16 bytes that stand for a token-set key."""
    return F.unhex(F.md5(F.col(key) if isinstance(key, str) else key))


def rarest_two(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """qid, n, one, two: the size of each of ``queries(qid, q_key)`` and its two rarest tokens in
    ``postings`` (``two`` is empty for a query of one). Tokens there once or not at all count alike."""
    frequency = materialize(postings.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "frequency")
    tokens = queries.select("qid", F.size(key_tokens("q_key")).alias("n"), F.explode(key_tokens("q_key")).alias("tok"))
    known = tokens.join(bounded_broadcast(frequency), "tok", "left").withColumn("df", F.coalesce("df", F.lit(1).cast("long")))
    rare = top_k(known, ["qid"], [F.col("df"), F.col("tok")], 2)
    return rare.groupBy("qid", "n").agg(F.min_by("tok", "rank").alias("one"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("tok"))), F.lit("")).alias("two"))


def posted(asked: DataFrame, sets: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """one, two, gid, size, first_entry: the sets that hold the ``asked`` pairs (one, two). Within ``max_bytes``
    the pairs go to the sets, which look for ``two`` where they are; else postings meet them by shuffles."""
    tokens = key_tokens("c_key")
    if measured_bytes(asked) <= max_bytes:
        held = sets.select("gid", "size", "first_entry", tokens.alias("held"), F.explode(tokens).alias("one")).join(F.broadcast(asked), "one")
        return held.where((F.col("two") == "") | F.array_contains("held", F.col("two"))).select("one", "two", "gid", "size", "first_entry")
    postings = sets.select("gid", "size", "first_entry", F.explode(tokens).alias("one"))
    single = postings.join(asked.where("two = ''"), "one")
    both = postings.join(asked.where("two <> ''"), "one").join(postings.select("gid", F.col("one").alias("two")), ["gid", "two"])
    return single.select("one", "two", "gid", "size", "first_entry").unionByName(both.select("one", "two", "gid", "size", "first_entry"))


def blocks(asked: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """The lists of the ``asked`` pairs (one, two): gid, size, first_entry, block (from 0) and blocks (of the list)."""
    placed = numbered(posted(asked, sets), [F.col("size"), F.col("first_entry"), F.col("gid")], group=["one", "two"])
    return placed.select("one", "two", "gid", "size", "first_entry", F.floor((F.col("place") - 1) / block).alias("block"), F.ceil(F.col("place_of") / block).alias("blocks"))


def proved(candidates: DataFrame, queries: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``candidates`` (qid, gid, ...) whose set holds all tokens of the query, by their keys. They
    go to the keys if they are small, so only keys that are looked at are shuffled."""
    some = bounded_broadcast(candidates)
    asking = queries.join(bounded_broadcast(candidates.select("qid").distinct()), "qid", "left_semi")
    both = sets.select("gid", "c_key").join(some, "gid").join(asking, "qid")
    return both.where(F.size(F.array_except(key_tokens("q_key"), key_tokens("c_key"))) == 0).select(candidates.columns)


def holding_sets(queries: DataFrame, sets: DataFrame, enough: int, block: int = BLOCK, reads: list | None = None, keys: bool = True) -> DataFrame:
    """``queries(q_key)`` (distinct) x ``sets(c_key, first_entry)`` -> q_key, c_key, first_entry, sim:
    the ``enough`` best sets that hold each query, and others that were read with them.

    reads: gets (queries, blocks, candidates) of each round; counting them costs a job a round.
    keys: if false, ``qid`` and ``gid`` (``key_digest``) take the place of q_key and c_key.
    """
    sets = materialize(sets.select("c_key", "first_entry", key_digest("c_key").alias("gid"), F.size(key_tokens("c_key")).alias("size")), "sets")
    asking = materialize(queries.select("q_key", key_digest("q_key").alias("qid")), "queries")
    prefix = materialize(rarest_two(asking, sets.select(F.explode(key_tokens("c_key")).alias("tok"))), "prefixes")
    lists = materialize(blocks(prefix.select("one", "two").distinct(), sets, block), "lists")
    open_ = prefix.join(lists.where("block = 0").select("one", "two", "blocks").distinct(), ["one", "two"]).withColumn("found", F.lit(0).cast("long"))
    open_ = materialize(open_, "open")
    longest = open_.agg(F.max("blocks")).first()[0] or 0
    rounds, at, width = [], 0, 1
    while True:
        asked = open_.select("qid", "n", "one", "two", F.explode(F.sequence(F.lit(at).cast("long"), F.least(F.lit(at + width), F.col("blocks")) - 1)).alias("block"))
        read = lists.where(F.col("block").between(at, at + width - 1)).drop("blocks")
        candidates = asked.join(read, ["one", "two", "block"]) \
            .select("qid", "gid", "first_entry", (F.col("n") / F.col("size")).alias("sim"), ((F.col("qid") == F.col("gid")) | (F.col("n") <= 2)).alias("sure"))
        candidates = materialize(candidates, "candidates")
        if reads is not None:
            reads.append((open_.count(), asked.count(), candidates.count()))
        held = materialize(proved(candidates.where("not sure").drop("sure"), asking, sets), "held")
        rounds.append(candidates.where("sure").drop("sure").unionByName(held))
        at, width = at + width, width * 2
        if at >= longest:
            break
        open_ = open_.where(F.col("blocks") > at)
        more = rounds[-1].groupBy("qid").agg(F.count(F.lit(1)).alias("more"))
        open_ = open_.join(more, "qid", "left").withColumn("found", F.col("found") + F.coalesce("more", F.lit(0))).drop("more")
        open_ = materialize(open_.where(F.col("found") < enough), "open")
        if open_.isEmpty():
            break
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    if not keys:
        return out
    return out.join(asking, "qid").join(sets.select("gid", "c_key"), "gid").select("q_key", "c_key", "first_entry", "sim")
