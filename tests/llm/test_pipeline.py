"""Stages of the pipeline on planted cases, and what a run leaves in the shared folder."""

import glob

from pyspark.sql import functions as F

import corpus_pipeline
from litsift.llm import common
from litsift.session import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def kept(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_near_keeps_one_of_each_component_where_ids_repeat(spark):
    a, b, c = "wholly different words stand here alone", "one two three four five six seven eight", "nine ten eleven twelve thirteen"
    rows = [(1, a), (1, b), (2, b), (3, c), (3, c), (None, a), (2, c)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3)
    assert kept(corpus_pipeline.near(spark, df, SF)) == sorted([(1, a), (1, b), (2, c)])


def test_language_uses_its_prediction(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").withColumn("_found", F.lit(1))
    odd = [(9_000_001, "это другой язык и другое письмо"), (9_000_002, "日本語の文章です"), (9_000_003, "12 !"), (9_000_004, None)]
    more = spark.createDataFrame([(i, t, None, "s", 1, 2) for i, t in odd], DOCS + ", _found int")
    both = docs.unionByName(more)
    found = corpus_pipeline.language(spark, both, SF)
    assert found.columns == both.columns
    assert {r.doc_id for r in found.collect()} == {r.doc_id for r in docs.collect()}
    german = {r.doc_id for r in corpus_pipeline.language(spark, both, SF, languages=("de",)).collect()}
    labelled = {r.doc_id for r in docs.where("lang = 'de'").collect()}
    assert german and len(german ^ labelled) <= 0.03 * len(labelled) + 1
    assert corpus_pipeline.language(spark, both, SF, least=1.1).count() == 0


def test_a_run_leaves_its_result_alone(spark):
    folder = shared_dir(spark).removeprefix("file:").rstrip("/") + "/litsift/*"
    before = set(glob.glob(folder))
    rows = corpus_pipeline.run(spark, SF)
    left = set(glob.glob(folder)) - before
    assert len(left) == 1 and "/packed-" in left.pop()
    assert rows.count() > 0 and not common._PASSING
