"""Bindings of the engine's tables to the driver's test tables.

No table of the test data holds mail, a paper catalogue or model answers, so each is
derived by Spark from a real table (and grows with it):

* papers     <- ``documents``  (arxiv_id := doc_id, title := first line, abstract := text,
                                authors/venue := source, categories := [lang])
* catalogue  <- ``documents``  (entry_id := "catalogue/<doc_id>", authors := [source])
* questions  <- ``benchmark``  (every item; question_id := item_id)
* messages   <- ``pages`` + ``events`` (body := page HTML, base64url-encoded; headers from
                                the event with the same id)
* answers    <- ``documents`` + ``labels`` (documents without a label have no answer)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsift.functions.mail import encode_b64url
from litsift.functions.text import clean_title, first_line
from litsift.schemas import MESSAGE
from litsift.sources.questions import questions_from_table

ENTRY_PREFIX = "catalogue/"
PDF_PREFIX = "catalogue/pdf/"


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy text work all the cores when the scan yields fewer splits than the
    cluster's parallelism (one small file = one task). On real data, with many more splits
    than cores, this is a no-op and adds no shuffle."""
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        return df.repartition(par)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A plain scan: filters and projections written after it reach Parquet."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def papers_from_documents(docs: DataFrame) -> DataFrame:
    return spread(docs).select(
        F.col("doc_id").cast("string").alias("arxiv_id"),
        F.col("doc_id").cast("string").alias("paper_key"),
        clean_title(first_line("text")).alias("title"),
        F.col("source").alias("authors"),
        F.col("text").alias("abstract"),
        F.col("source").alias("venue"),
        F.array(F.col("lang")).alias("categories"),
    )


def catalogue_from_documents(docs: DataFrame) -> DataFrame:
    return spread(docs).select(
        F.concat(F.lit(ENTRY_PREFIX), F.col("doc_id").cast("string")).alias("entry_id"),
        F.col("doc_id").cast("string").alias("doc_key"),
        first_line("text").alias("title"),
        F.array(F.col("source")).alias("authors"),
        F.col("text").alias("summary"),
        F.lit(None).cast("timestamp").alias("published"),
        F.concat(F.lit(PDF_PREFIX), F.col("doc_id").cast("string")).alias("pdf_url"),
        F.array(F.col("lang")).alias("categories"),
    )


def raw_papers_from_benchmark(bench: DataFrame) -> DataFrame:
    """Benchmark items as raw digest papers (title := first line; no authors)."""
    return bench.select(
        F.col("item_id").cast("string").alias("paper_key"),
        F.col("item_id"),
        clean_title(first_line("text")).alias("title"),
        F.lit("").alias("authors"),
    )


def questions_from_benchmark(bench: DataFrame) -> DataFrame:
    return questions_from_table(bench, "item_id", "text")


# Messages -------------------------------------------------------------------------------
DIGEST_SUBJECT = "Scholar Alert Digest: "
NOTICE_SUBJECT = "Account notice: "
NOTICE_EVENTS = ["error", "signup"]


def message_subject(event_type) -> F.Column:
    et = F.col(event_type) if isinstance(event_type, str) else event_type
    return F.when(et.isin(*NOTICE_EVENTS), F.concat(F.lit(NOTICE_SUBJECT), et)) \
        .otherwise(F.concat(F.lit(DIGEST_SUBJECT), et))


def rfc2822(ts) -> F.Column:
    return F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))


def messages_from_pages(pages: DataFrame, events: DataFrame | None) -> DataFrame:
    """One message per page. Even pages carry the HTML as ``payload.body``; odd pages are
    multipart (a text/plain part, then the text/html part). Headers come from the event with
    the page's id; without ``events`` (no join, no shuffle) only the body is set."""
    pages = spread(pages)
    if events is not None:
        e = events.select(F.col("event_id").alias("page_id"), "ts", "event_type", "user_id")
        j = pages.join(e, "page_id", "left")
    else:
        j = pages.select("page_id", "url", "html", F.lit(None).cast("timestamp").alias("ts"),
                         F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("long").alias("user_id"))
    data = encode_b64url(F.col("html"))
    hdr = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    headers = F.filter(F.array(
        hdr("Subject", message_subject("event_type")),
        hdr("From", F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com"))),
        hdr("Date", rfc2822(F.col("ts"))),
    ), lambda h: h["value"].isNotNull())
    multipart = (F.col("page_id") % 2) == 1
    part = lambda m, d: F.struct(F.lit(m).alias("mimeType"), F.struct(d.alias("data")).alias("body"))
    payload = F.struct(
        headers.alias("headers"),
        F.struct(F.when(~multipart, data).alias("data")).alias("body"),
        F.when(multipart, F.array(part("text/plain", encode_b64url(F.col("url"))),
                                  part("text/html", data))).alias("parts"),
    )
    msgs = j.select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("id"),
        F.concat(F.lit("thread-"), F.col("page_id").cast("string")).alias("threadId"),
        F.array(F.lit("INBOX")).alias("labelIds"),
        F.lit("").alias("snippet"),
        F.lit(None).cast("string").alias("internalDate"),
        payload.alias("payload"),
    )
    return msgs.select(*[F.col(f.name).cast(f.dataType) for f in MESSAGE.fields])
