"""Toxicity by a linear-chain conditional random field.

Tokens are the words of a text. A token's feature is how strongly its word, or a beginning of
it, goes with toxic documents, in LEVELS steps (0: not at all). The field has two states
(toxic or not), a weight for each level, for a marked neighbour on either side, for the
start and for each transition. It is fitted to labelled tokens: those with a level above 0 in
documents labelled toxic are toxic, all others aren't. Forward-backward passes give each
token's marginal; the marginals make the document's score (a logistic curve over the
expected and the surest toxic token), and the words with a marginal of at least 0.5 are its
offending spans. A chain is a block of CHAIN words with up to BESIDE words before and after it, of
which only the block's own marginals are taken, so a text of any length takes memory in
proportion to a group of blocks. Chains of one shape without a marked word share one pass.

Learned from a bounded sample: the SAMPLE labelled rows of each class that come first by a
hash of their id, and at most SEGMENTS chains of them (drawn apart with and without a marked
word, and weighted by what they stand for); held-out ids (crc32 of the id modulo 5 is 0) are
never used. A feature's counts are of distinct texts of a class, so copies count once; every
feature that passes SIGNIFICANT and ODDS is kept (the sample bounds how many can). Every
document's whole text is scored.

Defined results: a null or empty text has no tokens and is scored as such. A document with
several labels is toxic if one says so; null labels are not used. Without labelled rows of
both classes the score is the share of toxic labels (0 without labels). Repeated rows are
scored each. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsift.llm.common import Memo, groups, held_out, map_arrow, written

#: Labelled rows of each class that are learned from, at most.
SAMPLE = 5000
#: Chains that the field is fitted to, at most.
SEGMENTS = 6_000
CHAIN = 64
#: Words on either side that a chain's marginals take into account.
BESIDE = 8
LEVELS = 12
#: A feature goes with toxic documents if its log-likelihood ratio is at least so much.
SIGNIFICANT = 12.0
#: ... and if it is at least exp(ODDS) times as frequent there.
ODDS = 3.5
PREFIXES = (4, 5, 6)
STEPS = 60
_TRIM = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")


def features(word: str) -> list[str]:
    w = _TRIM.sub("", word.lower())
    if not w:
        return []
    return [w, *(w[:n] + "*" for n in PREFIXES if len(w) > n)]


class Field:
    """The fitted field. ``levels``: feature -> level."""

    def __init__(self, levels: dict[str, int]):
        self.levels = levels
        self.emit = np.zeros(LEVELS + 1)
        self.near = np.zeros(2)
        self.start = np.zeros(2)
        self.move = np.zeros((2, 2))
        self.curve = np.zeros(3)
        self.prior = 0.0
        self.memo = None

    def observed(self, text: str) -> np.ndarray:
        """The level of every word."""
        if self.memo is None:
            self.memo = Memo(lambda w: max((self.levels.get(f, 0) for f in features(w)), default=0))
        words = text.split()
        return np.fromiter(map(self.memo.__getitem__, words), np.uint8, len(words))

    def potentials(self, seen: np.ndarray) -> np.ndarray:
        marked = (seen > 0).astype(float)
        out = self.emit[seen]
        out[:, 1:] += self.near[0] * marked[:, :-1]
        out[:, :-1] += self.near[1] * marked[:, 1:]
        return out

    def passes(self, seen: np.ndarray, size: np.ndarray, weight: np.ndarray | None = None):
        """(log normaliser, marginals [n, t, state], expected transitions [2, 2] by the chains' weight) of chains padded to one length."""
        n, t = seen.shape
        e = np.zeros((n, t, 2))
        e[:, :, 1] = self.potentials(seen)
        inside = np.arange(t) < size[:, None]
        fore = np.zeros((n, t, 2))
        back = np.zeros((n, t, 2))
        fore[:, 0] = self.start + e[:, 0]
        for i in range(1, t):
            new = np.logaddexp(fore[:, i - 1, :1] + self.move[0], fore[:, i - 1, 1:] + self.move[1]) + e[:, i]
            fore[:, i] = np.where(inside[:, i, None], new, fore[:, i - 1])
        for i in range(t - 2, -1, -1):
            ahead = e[:, i + 1] + back[:, i + 1]
            new = np.logaddexp(self.move[:, 0] + ahead[:, :1], self.move[:, 1] + ahead[:, 1:])
            back[:, i] = np.where(inside[:, i + 1, None], new, 0)
        z = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])
        marginal = np.exp(np.minimum(fore + back - z[:, None, None], 0)) * inside[:, :, None]
        counted = inside[:, 1:] * (1.0 if weight is None else weight[:, None])
        moves = np.zeros((2, 2))
        for a in range(2):
            for b in range(2):
                p = fore[:, :-1, a] + self.move[a, b] + e[:, 1:, b] + back[:, 1:, b] - z[:, None]
                moves[a, b] = (np.exp(np.minimum(p, 0)) * counted).sum()
        return z, marginal, moves

    def fit(self, seen: np.ndarray, size: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> None:
        """Gradient ascent (Adam) on the weighted mean log-likelihood of the chains, with a small penalty on the weights."""
        inside = np.arange(seen.shape[1]) < size[:, None]
        marked = (seen > 0) & inside
        before = np.zeros_like(marked)
        after = np.zeros_like(marked)
        before[:, 1:], after[:, :-1] = marked[:, :-1], marked[:, 1:]

        def counts(p1: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
            p1 = p1 * inside * weight[:, None]
            return np.concatenate([np.bincount(seen.ravel(), p1.ravel(), LEVELS + 1), [p1[before].sum(), p1[after].sum()], first, moves.ravel()])

        pairs = np.zeros((2, 2))
        np.add.at(pairs, (truth[:, :-1][inside[:, 1:]], truth[:, 1:][inside[:, 1:]]), np.broadcast_to(weight[:, None], inside[:, 1:].shape)[inside[:, 1:]])
        wanted = counts(truth, np.bincount(truth[:, 0], weight, 2), pairs)
        w = np.zeros(len(wanted))
        m, v = np.zeros(len(w)), np.zeros(len(w))
        for step in range(1, STEPS + 1):
            self.emit, self.near = w[:LEVELS + 1], w[LEVELS + 1:LEVELS + 3]
            self.start, self.move = w[LEVELS + 3:LEVELS + 5], w[LEVELS + 5:].reshape(2, 2)
            _, marginal, moves = self.passes(seen, size, weight)
            g = (wanted - counts(marginal[:, :, 1], weight @ marginal[:, 0], moves)) / weight.sum() - 1e-4 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w + 0.5 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        self.emit, self.near = w[:LEVELS + 1], w[LEVELS + 1:LEVELS + 3]
        self.start, self.move = w[LEVELS + 3:LEVELS + 5], w[LEVELS + 5:].reshape(2, 2)

    def marginals(self, seen: list[np.ndarray]) -> list[np.ndarray]:
        """For each text the marginal of every word."""
        blocks, takers, plain = [], [], {}  # takers: for each block where its marginals go, as (text, first word, words before, words)
        for i, s in enumerate(seen):
            for a in range(0, len(s), CHAIN):
                before, own = min(a, BESIDE), min(CHAIN, len(s) - a)
                block = s[a - before:a + own + BESIDE]
                taker = (i, a, before, own)
                if block.any():
                    blocks.append(block)
                    takers.append([taker])
                    continue
                shape = (before, own, len(block))
                if shape not in plain:
                    plain[shape] = len(blocks)
                    blocks.append(block)
                    takers.append([])
                takers[plain[shape]].append(taker)
        out = [np.zeros(len(s)) for s in seen]
        for at in range(0, len(blocks), 2048):
            part = blocks[at:at + 2048]
            size = np.array([len(b) for b in part])
            padded = np.zeros((len(part), CHAIN + 2 * BESIDE), np.uint8)
            for j, b in enumerate(part):
                padded[j, :len(b)] = b
            p = self.passes(padded, size)[1][:, :, 1]
            for j in range(len(part)):
                for i, a, before, own in takers[at + j]:
                    out[i][a:a + own] = p[j, before:before + own]
        return out

    @staticmethod
    def aggregate(p: np.ndarray) -> tuple[float, float]:
        """What a document's score is made of: the expected number of toxic tokens (as a log) and the surest one."""
        return (float(np.log1p(p.sum())), float(p.max())) if len(p) else (0.0, 0.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ self.curve[1:], -30, 30))) if self.curve.any() else np.full(len(x), self.prior)


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with an intercept (Newton steps, a small penalty)."""
    a = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(a.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(len(w))
        w = w + np.linalg.solve(h, a.T @ (weight * (y - p)) - 0.05 * w)
    return w


def learn(docs: DataFrame, labels: DataFrame) -> Field:
    """The field fitted to a bounded sample of ``labels(doc_id, toxic)`` over ``docs(doc_id, text)``."""
    known = (labels.select("doc_id", "toxic").where("toxic is not null").where(~held_out())
             .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    totals = {r.toxic: r.n for r in known.where("toxic in (0, 1)").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    field = Field({})
    if totals:
        field.prior = totals.get(1, 0) / sum(totals.values())
    if len(totals) < 2:
        return field
    first = lambda y: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    chosen = F.broadcast(first(1).unionByName(first(0)))  # at most 2 * SAMPLE ids
    sample = written(docs.select("doc_id", "text").join(chosen, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", F.coalesce("text", F.lit("")).alias("text")), "labelled")
    different = written(sample.select("toxic", "text").distinct(), "texts")
    size = {r.toxic: r.n for r in different.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return field

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(features)
        for batch in groups(batches):
            name, mark = [], []
            for y, text in zip(_column(batch, "toxic").to_pylist(), _column(batch, "text").to_pylist()):
                own = {f for w in set(text.split()) for f in memo[w]}
                name += own
                mark += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(mark, pa.int64())], names=["feature", "toxic"])

    n1, n0 = size[1], size[0]
    share = n1 / (n1 + n0)
    t, c = F.col("t"), F.col("c")
    ratio = 2 * (F.when(t > 0, t * F.log(t / ((t + c) * share))).otherwise(0.0) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share)))).otherwise(0.0))
    counted = (map_arrow(different, count, "feature string, toxic long").groupBy("feature")
               .agg(F.sum("toxic").cast("double").alias("t"), F.sum(1 - F.col("toxic")).cast("double").alias("c"))
               .withColumn("odds", F.log((t + 0.5) / (n1 + 1)) - F.log((c + 0.5) / (n0 + 1)))
               .withColumn("ratio", ratio).where((F.col("odds") > ODDS) & (F.col("ratio") >= SIGNIFICANT)))
    best = counted.select("feature", "odds").collect()  # of the words of 2 * SAMPLE documents
    field.levels = {r.feature: int(min(LEVELS, 1 + np.floor(1.5 * (r.odds - ODDS)))) for r in best}
    if not field.levels:
        return field

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches):
            out = []
            for k, y, text in zip(*(_column(batch, c).to_pylist() for c in ("doc_id", "toxic", "text"))):
                s = field.observed(text)
                out += [(k, a, y, bool(s[a:a + CHAIN].any()), s[a:a + CHAIN].tobytes()) for a in range(0, len(s), CHAIN)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], kind) for j, kind in enumerate(kinds)], names=["doc_id", "at", "toxic", "marked", "seen"])

    cut = written(map_arrow(sample, chains, "doc_id long, at long, toxic int, marked boolean, seen binary"), "chains")
    strata = {r.marked: r.n for r in cut.groupBy("marked").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {m: min(n, max(SEGMENTS // 2, SEGMENTS - strata.get(not m, 0))) for m, n in strata.items()}
    rows = [r for m, n in share.items() for r in
            cut.where(F.col("marked") == m).orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at", "seen").limit(n).collect()]
    weight = np.array([strata[r.marked] / share[r.marked] for r in rows])
    seen = np.zeros((len(rows), CHAIN), np.uint8)
    length = np.array([len(r.seen) for r in rows])
    for i, r in enumerate(rows):
        seen[i, :length[i]] = np.frombuffer(bytes(r.seen), np.uint8)
    truth = (seen > 0).astype(int) * np.array([r.toxic for r in rows])[:, None]
    field.fit(seen, length, truth, weight)
    field.memo = None

    def aggregates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches):
            x = [Field.aggregate(p) for p in field.marginals([field.observed(t) for t in _column(batch, "text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([_column(batch, "toxic"), pa.array([a for a, _ in x]), pa.array([b for _, b in x])], names=["toxic", "a", "b"])

    got = map_arrow(sample, aggregates, "toxic int, a double, b double").limit(4 * SAMPLE).toArrow().to_pandas()
    y = got["toxic"].to_numpy(float)
    # The sample has its classes in other shares than the labels have.
    weight = np.where(y == 1, totals[1] / max(1, (y == 1).sum()), totals[0] / max(1, (y == 0).sum()))
    field.curve = _logistic(got[["a", "b"]].to_numpy(), y, weight * len(y) / weight.sum())
    field.memo = None
    return field


def score(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, spans (character offsets of the offending words, with their marginals): one row for each row of ``docs``."""
    known = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = known.value
        for batch in groups(batches):
            text = [t or "" for t in _column(batch, "text").to_pylist()]
            found = field.marginals([field.observed(t) for t in text])
            x = np.array([Field.aggregate(p) for p in found])
            spans = []
            for t, p in zip(text, found):
                bad = set(np.flatnonzero(p >= 0.5).tolist()) if len(p) else ()
                spans.append([{"start": m.start(), "end": m.end(), "marginal": float(p[i])} for i, m in enumerate(_words(t)) if i in bad] if bad else [])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
            yield pa.RecordBatch.from_arrays([_column(batch, "doc_id"), pa.array(field.score(x)), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                     "doc_id long, score double, spans array<struct<start:int,end:int,marginal:double>>")


def _words(text: str):
    """Matches of the words that ``str.split`` gives."""
    import re

    return re.finditer(r"\S+", text)
