"""Language ID by rank-order n-gram profiles.

A profile is the list of a language's most frequent character n-grams (1 to 3 letters of a
lower-cased word, with a mark at either end of the word), most frequent first. A document
gets a profile of its own, and the language whose profile is nearest by out-of-place
distance: the sum, over the document's n-grams, of how many places the n-gram is away from
its place in the language's profile (``PROFILE`` places if it isn't there).

Defined results: a null text or one without a letter is ``und`` with score 0. Ties between
languages go to the smaller name, ties between n-grams to the smaller code points. Labels
that are null are not learned from; repeated rows count each. With no labelled row nothing
is learned and every document is ``und``. Other columns are not read.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litsift.llm.common import forget, groups, map_arrow
from litsift.session import ship_package

#: Places of a profile.
PROFILE = 400
#: Learned languages, at most: bounds the profiles that go to every worker.
MAX_LANGUAGES = 1000
#: Texts are read in blocks of so many characters, and on to the end of the word there.
BLOCK = 1 << 20
#: Merge a worker's counts when so many n-grams wait.
PENDING = 2_000_000
UNKNOWN = "und"
RESULT = "lang_pred string, score double"
_EDGE = 1
_letters = threading.local()


def _is_letter() -> np.ndarray:
    if not hasattr(_letters, "table"):
        _letters.table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters.table


def ngrams(text: str) -> np.ndarray:
    """The codes (21 bits a letter) of all n-grams of a text, repeats included."""
    found, end = [], 0
    while end < len(text):
        at, end = end, min(end + BLOCK, len(text))
        while end < len(text) and text[end - 1].isalpha() and text[end].isalpha():
            end += 1
        low = text[at:end].lower().encode("utf-32-le", "surrogatepass")
        a = np.frombuffer(low, np.uint32)
        letter = _is_letter()[a]
        if not letter.any():
            continue
        a = np.where(letter, a, _EDGE).astype(np.uint64)
        a = a[letter | np.concatenate([[True], letter[:-1]])]
        a = np.concatenate([[_EDGE], a, [_EDGE]]).astype(np.uint64)
        inner = a != _EDGE
        s = np.uint64(21)
        two = (a[:-1] << s) | a[1:]
        found += [a[inner], two[inner[:-1] | inner[1:]], ((two[:-1] << s) | a[2:])[inner[1:-1]]]
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def profile_of(codes: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes, most frequent first."""
    found, n = np.unique(codes, return_counts=True)
    return found[np.argsort(-n, kind="stable")[:size]]


class Profiles:
    """Learned profiles; ``names`` in ascending order."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE):
        self.names, self.size = sorted(ranked), size
        self.codes = np.unique(np.array([c for v in ranked.values() for c in v], np.uint64))
        #: Place of each code in each language's profile, -1 if it isn't there; the last row is for codes unknown to all.
        self.places = np.full((len(self.codes) + 1, len(self.names)), -1, np.int32)
        for j, name in enumerate(self.names):
            at = np.searchsorted(self.codes, np.array(ranked[name], np.uint64))
            self.places[at, j] = np.arange(len(at))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = profile_of(ngrams(text or ""), self.size)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        at = np.where(self.codes[at] == own, at, len(self.codes))
        places = self.places[at]
        away = np.where(places < 0, self.size, np.abs(places - np.arange(len(own))[:, None])).sum(0)
        best = int(away.argmin())
        return self.names[best], float(1 - away[best] / (self.size * len(own)))


def learn(labelled: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles of the languages in ``labelled(lang, text)``, from whole texts of all rows.

    Workers count n-grams per language over their rows; the counts are added up by Spark and
    only each language's first ``size`` n-grams reach the driver.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        wait: dict[str, list[np.ndarray]] = {}
        waiting = 0

        def merge():
            for lang, parts in wait.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                if lang in sums:
                    both = np.concatenate([sums[lang][0], codes])
                    codes, at = np.unique(both, return_inverse=True)
                    n = np.bincount(at, np.concatenate([sums[lang][1], n])).astype(np.int64)
                sums[lang] = codes, n
            wait.clear()

        def rows():
            for lang, (codes, n) in sums.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))],
                    names=["lang", "code", "n"])
            sums.clear()

        for batch in groups(batches):
            langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            for lang, text in zip(langs, batch.column(batch.schema.get_field_index("text")).to_pylist()):
                if lang is not None and text:
                    wait.setdefault(lang, []).append(codes := ngrams(text))
                    waiting += len(codes)
            if waiting > PENDING:
                merge()
                waiting = 0
                if sum(len(c) for c, _ in sums.values()) > PENDING:
                    yield from rows()
        merge()
        yield from rows()

    counted = (map_arrow(labelled.select("lang", "text").where("lang is not null and text is not null"),
                         count, "lang string, code long, n long")
               .groupBy("lang", "code").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
    rows = top.select("lang", "place", "code").limit(MAX_LANGUAGES * size + 1).toArrow().to_pylist()
    if len({r["lang"] for r in rows}) > MAX_LANGUAGES or len(rows) > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are labelled")
    ranked: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        ranked.setdefault(r["lang"], []).append(r["code"])
    return Profiles(ranked, size)


def predictor(spark, profiles: Profiles):
    """A column function: text -> struct<lang_pred, score>."""
    ship_package(spark)
    known = spark.sparkContext.broadcast(profiles)

    @F.pandas_udf(RESULT)
    def predict(text: pd.Series) -> pd.DataFrame:
        forget(__name__)
        return pd.DataFrame([known.value.predict(t) for t in text], columns=["lang_pred", "score"])

    return predict
