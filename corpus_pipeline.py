"""From raw documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that the one before it
kept; its result is written as Parquet and reread as the next one's ``docs``. All but the
last return the columns of ``documents``.

Nulls and empty tables: a null or letterless text is rejected by the first stage; the others
take whatever comes. Columns beyond those of ``documents`` are passed on, except by packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litsift.llm import exact_dedup, langid, packing, rlz, simhash
from litsift.llm.common import carried, held_out, passing, restored, table, written
from litsift.session import scratch_path


#: Languages that stay (None: all learned ones), and the score that a document needs in its language.
#: A text in another script scores 0; the least score of the 51,282 documents of check_s is 0.40.
LANGUAGES: tuple[str, ...] | None = None
LEAST_SCORE = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: tuple[str, ...] | None = LANGUAGES, least: float = LEAST_SCORE) -> DataFrame:
    """Documents that language ID puts into one of the ``languages`` with the score ``least`` stay.
    Those it rejects go: ``und`` (null, or without a letter), other languages, like no learned one."""
    predict = langid.predictor(spark, langid.learn(docs.where(~held_out())))
    name = "_found" + "_" * max(map(len, docs.columns))  # no column of documents has this name
    lang, score = F.col(f"{name}.lang_pred"), F.col(f"{name}.score")
    stays = (lang != langid.UNKNOWN) & (score >= least)
    if languages is not None:
        stays &= lang.isin(*languages)
    return docs.withColumn(name, predict("text")).where(stays).drop(name)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: that with the smallest id."""
    kept = exact_dedup.exact_groups(docs).where("kept").select("doc_id", F.col("text_sha256").alias("mark"))
    rows = carried(docs).withColumn("mark", F.sha2(exact_dedup.normalised(), 256))
    return restored(_one_each(rows, kept), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: that with the smallest id, and of its texts
    the one with the smallest fingerprint (all without an id, if none has one)."""
    rows = written(simhash.fingerprints(docs, carry=True), "prints").withColumnRenamed("fp", "mark")
    found = simhash.grouped(rows.select("doc_id", F.col("mark").alias("fp")))
    named = (found.where("doc_id = component_id").groupBy("part").agg(F.min(F.struct("doc_id", F.col("fp").alias("mark"))).alias("first"))
             .select("first.doc_id", "first.mark"))
    nameless = found.where("doc_id is null and component_id is null").select("doc_id", F.col("fp").alias("mark")).distinct()
    kept = named.unionByName(nameless)
    return restored(_one_each(rows, kept), docs)


def _one_each(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The carried ``rows`` whose (doc_id, mark) is in ``kept``; of several rows with one of these, the first by its columns."""
    safe = lambda df: df.withColumn("none", F.col("doc_id").isNull()).withColumn("id", F.coalesce("doc_id", F.lit(0)))
    keys = ["id", "none", "mark"]
    order = Window.partitionBy(*keys).orderBy("text", F.xxhash64("row"), F.to_json("row"))
    joined = safe(rows).join(safe(kept).select(*keys), keys)
    return joined.withColumn("nth", F.row_number().over(order)).where("nth = 1")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from texts; a document without one keeps its text as it is."""
    found = rlz.dedup_substrings(docs, carry=True)
    cut = F.col("n_removed") > 0
    changed = {"text": F.when(cut, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length("kept")).otherwise(F.col("row").getField("n_chars"))
    return restored(found, docs, **changed)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("substrings", substrings), ("packed", packed)]
#: SQL has no out-of-place distance, no XXH64 and no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. Only they stay in the shared folder; what the stages wrote on the way is removed."""
    docs, result = table(spark, sf_dir, "documents"), scratch_path(spark, "packed")
    with passing(spark):
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        STAGES[-1][1](spark, docs, sf_dir).write.parquet(result)
    return spark.read.parquet(result)
