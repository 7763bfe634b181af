"""Exact dedup by 128-bit content hash, with the bytes of a group compared.

Texts are equal when identical after every run of ASCII white space is replaced by one
space. Rows are grouped by the hash and by the text itself, so that a collision of hashes
cannot join two texts; map-side aggregation leaves one row for each distinct text of a task
before the shuffle, whatever share of the rows a group of copies has.

Defined results: a null text counts as empty. The row with the smallest ``doc_id`` stays; of
repeated rows with that id, one stays. A null id is larger than any other and stays only
where the group has none but null ids. Other columns are not read.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsift.llm.common import written

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def _hash(norm):
    """128 bits: MD5 of the UTF-8 text."""
    return F.unhex(F.md5(norm))


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``."""
    texts = docs.select("doc_id", normalised().alias("norm")).withColumn("h", _hash(F.col("norm")))
    digest = F.sha2("norm", 256).alias("text_sha256")
    groups = (texts.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .select("h", digest, "keep_id", "group_size"))
    # Repeated rows of one id and text are numbered, so that one of them stays. Should two
    # texts share the hash, the whole digest leads a row to its own group.
    ids = texts.select("doc_id", "h", digest).groupBy("doc_id", "h", "text_sha256").agg(F.count(F.lit(1)).alias("times"))
    placed = ids.join(written(groups, "exact-groups"), ["h", "text_sha256"])
    return (placed.select("doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.expr("sequence(1, times)")).alias("nth"))
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256"))
