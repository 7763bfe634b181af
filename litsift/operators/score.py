"""Relevance scoring.

Scoring is one request per (paper, question). Three scorers share one output shape
(``arxiv_id, question_id, model_key, relevance_score, explanation, error, parse_error,
prompt_tokens, completion_tokens, total_tokens``):

* ``score_with``     a caller-supplied model function, run per partition with mapInArrow;
* ``join_responses`` stored answers (a response table), missing answers become error rows;
* ``lexical_*``      a pure-SQL word-overlap scorer for when no model is reachable.
"""

from __future__ import annotations

import gc
import sys
from typing import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsift.functions.prompt import QUESTION_FRAME, build_prompt, prompt_from_head, prompt_head
from litsift.functions.response import parse_response
from litsift.functions.text import tokens
from litsift.operators.common import MAX_BROADCAST_BYTES, bounded_broadcast, materialize
from litsift.session import ship_package
from litsift.sources.models import CALL_MAX_TOKENS, MODEL_KEYS, model_info

ERR_NO_MODEL = "Error: model '{}' is not supported."
ERR_NO_ANSWER = "Error: no answer for this request."
ERR_CALL = "Error from model call: "


# ---- J6: requests -----------------------------------------------------------------------

def pair_requests(papers: DataFrame, questions: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """One request per (paper, question) -- every pair is scored, as in the reference
    (one model call per pair), so the output is papers x questions by definition.

    The question list is configuration, small next to the papers: it is broadcast if its
    measured bytes are within ``max_bytes``, so papers are never shuffled. Beyond that Spark
    runs a partition-blocked cartesian product.
    """
    return papers.crossJoin(bounded_broadcast(questions, max_bytes))


#: Questions of a request row with ``asked``; a power of two.
ASKED = 8


def asked_together(questions: DataFrame) -> DataFrame:
    """Questions, up to ``ASKED`` of a partition in a row: ``asked``, an array of (question_id,
    question). Paired with ``request_heads``, a row holds a paper's head once for all of them,
    and ``score_with`` builds the prompts in its tasks, few at a time."""
    q = questions.select(F.col("question_id").cast("long").alias("question_id"), F.col("question").cast("string").alias("question"))
    rows = q.sortWithinPartitions("question_id", "question") \
        .withColumn("_row", F.shiftright(F.monotonically_increasing_id(), ASKED.bit_length() - 1))
    return rows.groupBy("_row").agg(F.collect_list(F.struct("question_id", "question")).alias("asked")).select("asked")


def request_heads(papers: DataFrame, id_col: str = "arxiv_id") -> DataFrame:
    """Per-paper part of every prompt, built once per paper and materialized before the
    pairing with questions, so each pair only appends its question."""
    return materialize(papers.select(F.col(id_col).alias("arxiv_id"), prompt_head().alias("prompt_head")))


# ---- J7: model lookup --------------------------------------------------------------------

def attach_model(requests: DataFrame, models: DataFrame, model_col: str = "model_key") -> DataFrame:
    """Price and provider of each request's model (a 4-row table: broadcast is safe).
    Unknown models keep NULL prices and are flagged by ``model_known = false``."""
    m = models.select("model_key", "provider", "api_model_id",
                      F.col("pricing.input").alias("price_in"), F.col("pricing.output").alias("price_out"))
    if model_col != "model_key":
        m = m.withColumnRenamed("model_key", model_col)
    out = requests.join(F.broadcast(m), model_col, "left")
    return out.withColumn("model_known", F.col("price_in").isNotNull())


# ---- U1: caller-supplied scorer ----------------------------------------------------------

#: Bytes of prompts that a scorer gets at once (one prompt, or the prompts of one row with ``asked``, at least).
PROMPT_BYTES = 4 << 20
#: Bytes of prompts after which a task collects garbage. What a scorer leaves may refer to itself (a
#: Series whose ``.str`` was used does) and then holds its batch until then; strings alone start no collection.
GARBAGE_BYTES = 16 << 20
ANSWER = pa.schema([("arxiv_id", pa.string()), ("question_id", pa.int64()), ("model_key", pa.string()),
                    ("response", pa.string()), ("prompt_tokens", pa.int64()), ("completion_tokens", pa.int64()),
                    ("total_tokens", pa.int64()), ("call_error", pa.string())])


def _cut(sizes, most: int):
    """(start, length) of runs of consecutive rows with at most ``most`` bytes, or of one row."""
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, end - at
        at = end


def _byte_lengths(strings) -> np.ndarray:
    return pc.fill_null(pc.binary_length(strings), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _prompt_frames(batches, most: int):
    """Arrow batches of requests as small pandas ones (``arxiv_id, question_id, prompt``): Spark's
    batches go by rows, and as Python strings a whole one would take several times its bytes."""
    for batch in batches:
        if "asked" in batch.schema.names:
            asked = batch["asked"]
            n = pc.list_value_length(asked).to_numpy(zero_copy_only=False)
            sizes = n * (_byte_lengths(batch["prompt_head"]) + sum(map(len, QUESTION_FRAME)))
            sizes += np.bincount(pc.list_parent_indices(asked).to_numpy(), _byte_lengths(pc.struct_field(pc.list_flatten(asked), "question")), len(n)).astype(np.int64)
        else:
            sizes = _byte_lengths(batch["prompt"])
        for start, length in _cut(sizes, most):
            rows = batch.slice(start, length)
            ids = rows["arxiv_id"]
            if "asked" in rows.schema.names:
                of = pc.list_parent_indices(rows["asked"])
                question_id, question = (pc.struct_field(pc.list_flatten(rows["asked"]), c) for c in ("question_id", "question"))
                ids, prompt = ids.take(of), pc.binary_join_element_wise(rows["prompt_head"].take(of), QUESTION_FRAME[0], question, QUESTION_FRAME[1], "")
            else:
                question_id, prompt = rows["question_id"], rows["prompt"]
            yield pd.DataFrame({"arxiv_id": ids.to_pandas(), "prompt": prompt.to_pandas(),
                                "question_id": question_id.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)})


def _adapter(scorer_factory: Callable, model_key: str, api_model_id: str, max_tokens: int):
    """Per-partition function on pandas batches: the scorer is built once per partition and a
    failing call becomes an error row instead of failing the task. A task holds the batch at
    hand and at most ``GARBAGE_BYTES`` of earlier ones, however many requests it has."""

    def answers(scorer, pdf):
        out = {"arxiv_id": pdf["arxiv_id"].tolist(), "question_id": pdf["question_id"].tolist(),
               "model_key": [model_key] * len(pdf), "response": [], "prompt_tokens": [],
               "completion_tokens": [], "total_tokens": [], "call_error": []}
        if hasattr(scorer, "analyze_batch"):
            res = scorer.analyze_batch(pdf["prompt"], api_model_id, max_tokens)
            out["response"] = res["response"].tolist()
            for c in ("prompt_tokens", "completion_tokens", "total_tokens"):
                out[c] = res[c].tolist() if c in res else [None] * len(pdf)
            out["call_error"] = res["call_error"].tolist() if "call_error" in res else [None] * len(pdf)
        else:
            for prompt in pdf["prompt"]:
                try:
                    text, meta = scorer.analyze(prompt, api_model_id, max_tokens)
                    meta = meta or {}
                    out["response"].append(text)
                    out["prompt_tokens"].append(meta.get("prompt_tokens"))
                    out["completion_tokens"].append(meta.get("completion_tokens"))
                    out["total_tokens"].append(meta.get("total_tokens"))
                    out["call_error"].append(None)
                except Exception as e:  # one failed call is one error row
                    out["response"].append(None)
                    out["prompt_tokens"].append(None)
                    out["completion_tokens"].append(None)
                    out["total_tokens"].append(None)
                    out["call_error"].append(str(e))
        frame = pd.DataFrame(out)
        for c in ("prompt_tokens", "completion_tokens", "total_tokens"):
            frame[c] = frame[c].astype("Int64")
        return frame

    def run(batches):
        gc.collect()
        gc.freeze()  # the collections below then skip all that a worker has loaded
        try:
            scorer, passed = scorer_factory(), 0
            for pdf in batches:
                passed += sum(map(sys.getsizeof, pdf["prompt"]))
                frame = answers(scorer, pdf)
                del pdf  # else it stays while the next one is read
                yield frame
                del frame
                if passed >= GARBAGE_BYTES:
                    gc.collect()
                    passed = 0
        finally:
            gc.unfreeze()

    return run


def _arrow_adapter(*args):
    """``_adapter`` for mapInArrow: a task holds Spark's batch as it came and the prompts of
    ``PROMPT_BYTES`` of it, and answers leave in batches as small."""
    run = _adapter(*args)

    def run_arrow(batches):
        for frame in run(_prompt_frames(batches, PROMPT_BYTES)):
            yield pa.RecordBatch.from_arrays([pa.Array.from_pandas(frame[f.name], type=f.type) for f in ANSWER], schema=ANSWER)

    return run_arrow


def score_with(requests: DataFrame, scorer_factory: Callable, model_key: str,
               max_tokens: int = CALL_MAX_TOKENS, partitions: int | None = None) -> DataFrame:
    """Call a model for every request.

    ``requests`` has ``arxiv_id, question_id, question`` and either the paper fields
    (``title, authors, categories, abstract``) or a precomputed ``prompt_head``. The prompt is built JVM-side; only ``(arxiv_id, question_id, prompt)``
    crosses to Python. Or it has ``arxiv_id, prompt_head, asked`` (``asked_together``): a head then
    crosses once for several questions, and each one's prompt is built in Python.
    ``scorer_factory()`` returns an object with
    ``analyze(prompt, model_id, max_tokens) -> (text, metadata)`` or a vectorised
    ``analyze_batch(prompts, model_id, max_tokens) -> pandas.DataFrame``, which gets prompts of
    about ``PROMPT_BYTES`` at a time.
    ``partitions`` sets the call parallelism. Persist or write the result before more than
    one consumer reads it, or the calls are paid twice.
    """
    return finish_scores(call_model(requests, scorer_factory, model_key, max_tokens, partitions))


def call_model(requests: DataFrame, scorer_factory: Callable, model_key: str,
               max_tokens: int = CALL_MAX_TOKENS, partitions: int | None = None) -> DataFrame:
    """U1 raw answers (``RESPONSE`` columns + ``answered_at``), before parsing."""
    info = model_info(model_key)
    ship_package(requests.sparkSession)
    if "asked" in requests.columns:
        req = requests.select("arxiv_id", "prompt_head", "asked")
    else:
        prompt = prompt_from_head() if "prompt_head" in requests.columns else build_prompt()
        req = requests.select("arxiv_id", F.col("question_id").cast("long").alias("question_id"), prompt.alias("prompt"))
    if partitions:
        req = req.repartition(partitions)
    schema = ("arxiv_id string, question_id long, model_key string, response string, "
              "prompt_tokens long, completion_tokens long, total_tokens long, call_error string")
    raw = req.mapInArrow(_arrow_adapter(scorer_factory, model_key, info["api_model_id"], max_tokens), schema)
    return raw.withColumn("answered_at", F.current_timestamp())


def score_and_store(requests: DataFrame, scorer_factory: Callable, model_key: str, answers_path: str,
                    max_tokens: int = CALL_MAX_TOKENS, partitions: int | None = None) -> DataFrame:
    """U1 with exactly-once answers for a paid, non-deterministic model.

    Only requests without a stored answer are sent (``pending_requests``); their raw
    answers are appended to the answer table at ``answers_path`` in one committed write
    (a retried or speculative task's output is discarded by the commit protocol), and the
    scores are then read back from that table. A re-run after a failure pays only for the
    calls that were not yet stored and for failed calls, which are stored as such. Exactly once
    holds for the stored answers, not for the calls: a task that is run again calls again.
    """
    from pyspark.errors import AnalysisException

    spark = requests.sparkSession
    try:
        stored = spark.read.parquet(answers_path)
        pending = pending_requests(requests, stored, model_key)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise  # anything else doesn't mean that nothing is stored
        pending = requests
    call_model(pending, scorer_factory, model_key, max_tokens, partitions) \
        .write.mode("append").parquet(answers_path)
    return join_responses(requests, spark.read.parquet(answers_path), model_key)


REQUEST_KEY = ["arxiv_id", "question_id", "model_key"]


def pending_requests(requests: DataFrame, answered: DataFrame, model_key: str) -> DataFrame:
    """Requests without a stored answer for ``model_key`` (anti-join on the request key). A
    failed call (``call_error``) is no answer: its request is pending again.

    With a paid, non-deterministic scorer, write each ``score_with`` result to a table and
    call only the pending requests on a re-run: calls already answered (before a failure)
    are never paid again, and the stored table stays the single source of answers.
    """
    answered = answered.where(F.col("call_error").isNull()) if "call_error" in answered.columns else answered
    done = answered.where(F.col("model_key") == model_key) \
        .select("arxiv_id", F.col("question_id").cast("long").alias("question_id")).distinct()
    return requests.join(done, ["arxiv_id", "question_id"], "left_anti")


def finish_scores(raw: DataFrame) -> DataFrame:
    """P23-P26 on answers: parse, or mark the row as a failed call (or, where the boolean
    ``unanswered`` is there and true, as a request without an answer)."""
    parsed = parse_response(F.col("response"))
    gap = F.col("unanswered") if "unanswered" in raw.columns else F.lit(False)
    failed = F.col("call_error").isNotNull() | gap
    return raw.select(
        "arxiv_id", "question_id", "model_key",
        F.when(failed, F.lit(0.0)).otherwise(parsed["relevance_score"]).alias("relevance_score"),
        F.when(gap, F.lit(ERR_NO_ANSWER)).when(failed, F.concat(F.lit(ERR_CALL), F.col("call_error")))
        .otherwise(parsed["explanation"]).alias("explanation"),
        failed.alias("error"),
        F.when(failed, F.lit(None).cast("string")).otherwise(parsed["parse_error"]).alias("parse_error"),
        (~failed & parsed["out_of_range"]).alias("out_of_range"),
        "prompt_tokens", "completion_tokens", "total_tokens",
    )


# ---- J9 + P26: stored answers ------------------------------------------------------------

def join_responses(requests: DataFrame, responses: DataFrame, model_key: str) -> DataFrame:
    """Each request's answer from a response table keyed ``(arxiv_id, question_id,
    model_key)``; a missing answer or an unknown model gives an error row (score 0.0)."""
    known = model_key in MODEL_KEYS
    req = requests.select("arxiv_id", F.col("question_id").cast("long").alias("question_id")) \
        .withColumn("model_key", F.lit(model_key))
    resp = responses.select("arxiv_id", F.col("question_id").cast("long").alias("question_id"), "model_key",
                            "response", "prompt_tokens", "completion_tokens", "total_tokens",
                            F.col("call_error") if "call_error" in responses.columns
                            else F.lit(None).cast("string").alias("call_error"),
                            *(["answered_at"] if "answered_at" in responses.columns else []))
    # One answer per request key: the last one stored wins (a key answered twice, e.g. by
    # two overlapping runs, must not duplicate the request row).
    # Without ``answered_at`` the largest answer wins, so the result never depends on timing.
    values = ["response", "prompt_tokens", "completion_tokens", "total_tokens", "call_error"]
    order = [c for c in ("answered_at", *values) if c in resp.columns]
    resp = last_write(resp, REQUEST_KEY, order, values).drop("n_writes")
    j = req.join(resp, ["arxiv_id", "question_id", "model_key"], "left")
    scored = finish_scores(j.withColumn("unanswered", F.col("response").isNull() & F.col("call_error").isNull()))
    if not known:
        scored = scored.withColumn("relevance_score", F.lit(0.0)) \
            .withColumn("explanation", F.lit(ERR_NO_MODEL.format(model_key))) \
            .withColumn("error", F.lit(True)).withColumn("parse_error", F.lit(None).cast("string")) \
            .withColumn("out_of_range", F.lit(False))
    return scored


# ---- U2: lexical scorer ------------------------------------------------------------------

def question_tokens(questions: DataFrame) -> DataFrame:
    q = questions.select("question_id", tokens("question").alias("q_tok"))
    return q.select("question_id", F.size("q_tok").alias("n_q"), F.explode("q_tok").alias("tok"))


def paper_tokens(papers: DataFrame, id_col: str = "arxiv_id") -> DataFrame:
    """Distinct tokens of title + abstract, one row per (paper, token)."""
    text = F.concat_ws(" ", F.col("title"), F.col("abstract"))
    return papers.select(F.col(id_col).alias("arxiv_id"), F.explode(tokens(text)).alias("tok"))


def lexical_pair_scores(papers: DataFrame, questions: DataFrame, id_col: str = "arxiv_id") -> DataFrame:
    """U2 per pair, for pairs sharing at least one token: ``overlap`` distinct question
    tokens found in the paper, score ``(10 * overlap) div n_q / 10`` (an integer 0..10 as the
    answer format asks). Pairs with no shared token score 0 and are not materialised.

    Inverted-index join: paper tokens meet the (broadcast, size-checked) question tokens, so
    papers are never shuffled before the partial aggregation collapses them to at most one
    row per (paper, question).
    """
    qt = bounded_broadcast(question_tokens(questions))
    hits = paper_tokens(papers, id_col).join(qt, "tok")
    pair = hits.groupBy("arxiv_id", "question_id").agg(F.count(F.lit(1)).alias("overlap"),
                                                       F.max("n_q").alias("n_q"))
    score_int = F.floor((F.lit(10) * F.col("overlap")) / F.col("n_q")).cast("long")
    return pair.select("arxiv_id", "question_id", "overlap", "n_q",
                       score_int.alias("score_int"), (score_int / F.lit(10.0)).alias("relevance_score"))


def lexical_mean_scores(papers: DataFrame, questions: DataFrame, id_col: str = "arxiv_id") -> DataFrame:
    """U2 + A1: mean lexical score of every paper over all questions (zeros included).

    ``papers`` must hold one row per id (``triage`` deduplicates first), since a paper's
    tokens are counted per row."""
    n_q = questions.count()  # config-sized table; the divisor restores zero pairs
    pairs = lexical_pair_scores(papers, questions, id_col).select("arxiv_id", "score_int")
    zeros = papers.select(F.col(id_col).alias("arxiv_id"), F.lit(0).cast("long").alias("score_int"))
    tot = pairs.unionByName(zeros).groupBy("arxiv_id").agg(F.sum("score_int").alias("score_sum"))
    return tot.select("arxiv_id", (F.col("score_sum") / F.lit(10.0 * max(n_q, 1))).alias("score"))


# ---- A1, A2, A3, A6 -------------------------------------------------------------------------

def mean_score(scores: DataFrame, errors: str = "zero") -> DataFrame:
    """A1: mean ``relevance_score`` per paper over its questions.

    ``errors='zero'`` (reference behaviour) keeps the 0.0 of failed calls and failed
    parses in the mean; ``'skip'`` leaves them out (a paper with only failures -> NULL).
    """
    if errors == "skip":
        ok = ~F.col("error") & F.col("parse_error").isNull()
        value = F.when(ok, F.col("relevance_score"))
    elif errors == "zero":
        value = F.col("relevance_score")
    else:
        raise ValueError("errors must be 'zero' or 'skip'")
    return scores.groupBy("arxiv_id").agg(F.avg(value).alias("score"))


def answer_means(papers: DataFrame, questions: DataFrame, responses: DataFrame, model_key: str, errors: str = "zero",
                 id_col: str = "arxiv_id") -> DataFrame:
    """J9 + A1 without the pairs: each paper's mean over all questions from the answers that
    are there. A question without an answer adds 0 (``'zero'``) or nothing (``'skip'``), so
    only stored answers are parsed and summed, and no (paper, question) row is made."""
    ids = papers.select(F.col(id_col).alias("arxiv_id")).distinct()
    asked = questions.select(F.col("question_id").cast("long").alias("question_id")).distinct()
    n = asked.count()
    answered = responses.where(F.col("model_key") == model_key).join(bounded_broadcast(asked), "question_id")
    each = join_responses(answered.select("arxiv_id", "question_id").distinct(), answered, model_key)
    ok = ~F.col("error") & F.col("parse_error").isNull()
    value = F.when(ok, F.col("relevance_score")) if errors == "skip" else F.col("relevance_score")
    if errors not in ("zero", "skip"):
        raise ValueError("errors must be 'zero' or 'skip'")
    sums = each.groupBy("arxiv_id").agg(F.sum(value).alias("total"), F.count(value).alias("given"))
    mean = F.coalesce(F.col("total"), F.lit(0.0)) / F.lit(max(n, 1)) if errors == "zero" else F.col("total") / F.nullif("given", F.lit(0))
    return ids.join(sums, "arxiv_id", "left").select("arxiv_id", mean.alias("score"))


def token_usage(scores: DataFrame, models: DataFrame, by_model: bool = False) -> DataFrame:
    """A2 + A3: token totals and estimated cost (prices per 1M tokens). Absent counts add 0;
    calls of an unknown model add tokens but no cost."""
    s = attach_model(scores, models)
    p = F.coalesce(F.col("prompt_tokens"), F.lit(0))
    c = F.coalesce(F.col("completion_tokens"), F.lit(0))
    aggs = [F.count(F.lit(1)).alias("n_calls"),
            F.sum(p).alias("total_prompt_tokens"), F.sum(c).alias("total_completion_tokens"),
            F.sum(F.coalesce(F.col("total_tokens"), F.lit(0))).alias("total_tokens")]
    if by_model:
        # Prices are constant within a model: cost from the integer sums is exact.
        g = s.groupBy("model_key", "price_in", "price_out").agg(*aggs)
        cost = F.coalesce(F.col("total_prompt_tokens") * F.col("price_in") / F.lit(1e6)
                          + F.col("total_completion_tokens") * F.col("price_out") / F.lit(1e6), F.lit(0.0))
        return g.select("model_key", "n_calls", "total_prompt_tokens", "total_completion_tokens",
                        "total_tokens", cost.alias("estimated_cost"))
    cost = F.coalesce(p * F.col("price_in") / F.lit(1e6) + c * F.col("price_out") / F.lit(1e6), F.lit(0.0))
    return s.agg(*aggs, F.sum(cost).alias("estimated_cost"))


def last_write(df: DataFrame, keys: list[str], order: list[str], value_cols: list[str]) -> DataFrame:
    """Per key, the values of the last write by ``order`` (later wins, like repeated
    dict assignment); ``n_writes`` still counts every write. One partial + final
    aggregation, no sort of the group."""
    ordkey = F.struct(*[F.col(c) for c in order])
    payload = F.struct(*[F.col(c) for c in value_cols])
    g = df.groupBy(*keys).agg(F.max_by(payload, ordkey).alias("_last"), F.count(F.lit(1)).alias("n_writes"))
    return g.select(*keys, *[F.col("_last")[c].alias(c) for c in value_cols], "n_writes")
