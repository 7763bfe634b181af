"""Fixed schemas of the engine's tables (an absent field is NULL, never a missing column)."""

from pyspark.sql import types as T

HEADER = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("value", T.StringType()),
])

BODY = T.StructType([T.StructField("data", T.StringType())])

PART = T.StructType([
    T.StructField("mimeType", T.StringType()),
    T.StructField("body", BODY),
])

PAYLOAD = T.StructType([
    T.StructField("headers", T.ArrayType(HEADER)),
    T.StructField("body", BODY),
    T.StructField("parts", T.ArrayType(PART)),
])

# One mail message as the mail API returns it.
MESSAGE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("threadId", T.StringType()),
    T.StructField("labelIds", T.ArrayType(T.StringType())),
    T.StructField("snippet", T.StringType()),
    T.StructField("internalDate", T.StringType()),
    T.StructField("payload", PAYLOAD),
])

# One paper as extracted from a digest (before the catalogue lookup).
RAW_PAPER = T.StructType([
    T.StructField("email_id", T.StringType()),
    T.StructField("email_date", T.StringType()),
    T.StructField("email_subject", T.StringType()),
    T.StructField("email_sender", T.StringType()),
    T.StructField("article_pos", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("authors", T.StringType()),
    T.StructField("relevance", T.IntegerType()),
    T.StructField("venue", T.StringType()),
    T.StructField("url", T.StringType()),
])

# A catalogue snapshot (the remote paper index of the reference, as a table).
CATALOGUE = T.StructType([
    T.StructField("entry_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("authors", T.ArrayType(T.StringType())),
    T.StructField("summary", T.StringType()),
    T.StructField("published", T.TimestampType()),
    T.StructField("pdf_url", T.StringType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
])

# Stored papers: raw paper fields plus the catalogue fields added by the lookup.
PAPERS = T.StructType(list(RAW_PAPER.fields) + [
    T.StructField("email_ts", T.TimestampType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("arxiv_id", T.StringType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("pdf_url", T.StringType()),
    T.StructField("published", T.TimestampType()),
])

QUESTIONS = T.StructType([
    T.StructField("question_id", T.LongType(), False),
    T.StructField("question", T.StringType()),
])

PRICING = T.StructType([
    T.StructField("input", T.DoubleType()),
    T.StructField("output", T.DoubleType()),
    T.StructField("currency", T.StringType()),
])

MODELS = T.StructType([
    T.StructField("model_key", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("api_model_id", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("context_window", T.IntegerType()),
    T.StructField("pricing", PRICING),
    T.StructField("max_tokens_default", T.IntegerType()),
])

# What a scorer returns for one (paper, question) request.
RESPONSE = T.StructType([
    T.StructField("arxiv_id", T.StringType()),
    T.StructField("question_id", T.LongType()),
    T.StructField("model_key", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
    T.StructField("total_tokens", T.LongType()),
    T.StructField("call_error", T.StringType()),
])
