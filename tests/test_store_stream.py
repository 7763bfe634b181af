"""Sources and sinks (S2-S7) and incremental ingest."""

import datetime as dt
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from fixtures import message
from litsift.plans.triage import recent_papers
from litsift.session import scratch_path
from litsift.sources import models, papers, questions
from litsift.sources.messages import read_messages
from litsift.streaming.incremental import ingest_incremental, read_ingested

#: Stored papers: an offset in the date, a date and a relevance that cannot be read, absent fields.
SAMPLE = [("Basalt columns, cooling and cracks", "n-301", "Tue, 09 May 2023 06:45:10 +0200", "S. Quispe, L. Marchetti", "41", None, "https://papers.example.net/basalt"),
          ("Glacier runoff in dry years", "n-302", "Wed, 10 May 2023 21:00:00 GMT", "I. Haugen", "93.5", "Geophysical Letters", None),
          ("Editorial note", "n-303", "next week", "The editors", "high", "Bulletin", "https://bulletin.example.net/1"),
          ("A paper without a date", "n-304", None, "O. Nwosu", None, None, None)]
COLS = "title string, email_id string, email_date string, authors string, relevance string, venue string, url string"


def test_to_papers_types(spark):
    df = papers.to_papers(spark.createDataFrame(SAMPLE, COLS))
    assert dict(df.dtypes)["email_date"] == "timestamp" and dict(df.dtypes)["relevance"] == "double"
    rows = df.orderBy("email_id").collect()
    assert [r.email_date for r in rows] == [dt.datetime(2023, 5, 9, 4, 45, 10), dt.datetime(2023, 5, 10, 21), None, None]
    assert [r.relevance for r in rows] == [41.0, 93.5, None, None]
    assert rows[2].venue == "Bulletin" and rows[0].venue is None


def test_to_papers_errors(spark):
    with pytest.raises(ValueError, match="no papers"):
        papers.to_papers(spark.createDataFrame([], COLS), require_rows=True)
    with pytest.raises(ValueError, match="authors"):
        papers.to_papers(spark.createDataFrame([("t",)], "title string"))


def test_parquet_and_csv_roundtrip(spark):
    df = papers.to_papers(spark.createDataFrame(SAMPLE, COLS)).withColumn("categories", F.array(F.lit("a"), F.lit("b")))
    path = scratch_path(spark, "t-papers")
    papers.write_papers(df, path)
    back = papers.read_papers(spark, path)
    assert sorted(back.columns) == sorted(df.columns) and back.count() == len(SAMPLE)
    cpath = scratch_path(spark, "t-papers-csv")
    papers.write_papers(df, cpath, fmt="csv")
    c = spark.read.option("header", True).csv(cpath).first()
    assert c.categories == "a, b"
    with pytest.raises(AnalysisException):
        papers.read_papers(spark, path + "-missing").count()


def test_questions_and_models(spark):
    with pytest.raises(ValueError):
        questions.questions_df(spark, [])
    assert questions.questions_df(spark, ["x", "y"]).count() == 2
    m = models.models_df(spark)
    assert m.count() == 4
    one = models.models_df(spark, "claude-3-5-haiku").first()
    assert one.pricing.input == 0.80 and one.provider_display == "Anthropic"
    with pytest.raises(ValueError):
        models.models_df(spark, "nope")


def _write_messages(path, msgs):
    with open(path, "w") as f:
        for m in msgs:
            f.write(json.dumps(m) + "\n")


def test_incremental_equals_batch_and_replay_is_idempotent(spark, tmp_path):
    base = scratch_path(spark, "t-ingest").replace("file:", "")
    import os
    os.makedirs(f"{base}/source", exist_ok=True)
    arts = "".join(f"<article><h2><a href='u{i}'>T{i}</a></h2><p>A{i}</p></article>" for i in range(3))
    html = "<div class='scholar-inbox.com'>" + arts + "</div>"
    msgs = [message(f"m{i}", html=html) for i in range(4)]
    _write_messages(f"{base}/source/f1.json", msgs[:2])
    _write_messages(f"{base}/source/f2.json", msgs[2:])
    _write_messages(f"{base}/source/f3.json", msgs[1:3])          # re-delivered messages

    def to_papers(b):
        return recent_papers(b, since="2020-01-01")

    ingest_incremental(spark, f"{base}/source", f"{base}/sink", f"{base}/ckpt", to_papers, files_per_batch=1)
    out = read_ingested(spark, f"{base}/sink")
    batch = to_papers(read_messages(spark, f"{base}/source"))
    key = lambda df: sorted((r.email_id, r.article_pos, r.title) for r in df.collect())
    assert key(out) == key(batch.dropDuplicates(["email_id", "article_pos"]))
    # Three micro-batches ran; the third held only re-deliveries, so it wrote no rows.
    assert sorted(d for d in os.listdir(f"{base}/sink") if d.startswith("batch_id=")) == \
        ["batch_id=0", "batch_id=1", "batch_id=2"]
    assert out.where("batch_id = 2").count() == 0
    ingest_incremental(spark, f"{base}/source", f"{base}/sink", f"{base}/ckpt", to_papers, files_per_batch=1)
    assert key(read_ingested(spark, f"{base}/sink")) == key(out)           # replay adds nothing


def test_read_catalogue_json_and_union(spark):
    import os
    from litsift.operators.dedup import union_all
    from litsift.sources.catalogue import read_catalogue
    base = scratch_path(spark, "t-cat").replace("file:", "")
    os.makedirs(base, exist_ok=True)
    with open(f"{base}/c.json", "w") as f:
        f.write(json.dumps({"entry_id": "http://arxiv.org/abs/2201.12345v1", "title": "T", "authors": ["A, B"],
                            "summary": "S", "published": "2022-01-15T00:00:00Z", "pdf_url": "p",
                            "categories": ["cs.LG"]}) + "\n")
    c = read_catalogue(spark, base, fmt="json")
    r = c.first()
    assert r.authors == ["A, B"] and r.published == dt.datetime(2022, 1, 15) and r.categories == ["cs.LG"]
    u = union_all(c.select("entry_id", "title"), c.select("entry_id"))
    assert u.count() == 2 and u.columns == ["entry_id", "title"]


def test_stateful_ingest_dedups_redeliveries(spark):
    import os
    from litsift.streaming.incremental import ingest_incremental_stateful
    base = scratch_path(spark, "t-ingest-state").replace("file:", "")
    os.makedirs(f"{base}/source", exist_ok=True)
    arts = "".join(f"<article><h2><a href='u{i}'>T{i}</a></h2><p>A{i}</p></article>" for i in range(3))
    html = "<div class='scholar-inbox.com'>" + arts + "</div>"
    msgs = [message(f"m{i}", html=html) for i in range(4)]
    _write_messages(f"{base}/source/f1.json", msgs[:2])
    _write_messages(f"{base}/source/f2.json", msgs[2:])
    _write_messages(f"{base}/source/f3.json", msgs[1:3])

    def to_papers(b):
        return recent_papers(b, since="2020-01-01")

    ingest_incremental_stateful(spark, f"{base}/source", f"{base}/sink", f"{base}/ckpt", to_papers, files_per_batch=1)
    key = lambda df: sorted((r.email_id, r.article_pos, r.title) for r in df.collect())
    out = spark.read.parquet(f"{base}/sink")
    batch = to_papers(read_messages(spark, f"{base}/source")).dropDuplicates(["email_id", "article_pos"])
    assert key(out) == key(batch) and out.count() == 12
    _write_messages(f"{base}/source/f4.json", msgs[:1])                        # a late re-delivery
    ingest_incremental_stateful(spark, f"{base}/source", f"{base}/sink", f"{base}/ckpt", to_papers, files_per_batch=1)
    assert key(spark.read.parquet(f"{base}/sink")) == key(out)
