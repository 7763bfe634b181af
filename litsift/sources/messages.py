"""The message table (mail messages as rows) and its stored, prunable form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litsift.schemas import MESSAGE


def read_messages(spark: SparkSession, path: str, fmt: str = "json", corrupt: str | None = None) -> DataFrame:
    """Scan raw messages with a fixed schema (no inference pass over the data).

    Unlike the mail API (first result page only), a table scan has no page cap. A line that
    is no message becomes a row of nulls; ``corrupt`` names a column that then holds the line
    as it stands, so that none is lost unseen.
    """
    if fmt != "json":
        return spark.read.schema(MESSAGE).format(fmt).load(path)
    if corrupt is None:
        return spark.read.schema(MESSAGE).json(path)
    # A JSON scan parses the columns that are asked for only, and so takes a line for good or
    # bad by what a query selects; here each line is parsed whole.
    schema = T.StructType([*MESSAGE.fields, T.StructField(corrupt, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    return spark.read.text(path).select(F.from_json("value", schema, options).alias("m")).select("m.*")


def utc_day(ts) -> F.Column:
    """UTC calendar day of an instant, whatever the session time zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / F.lit(86400)).cast("int"))


def write_messages(messages: DataFrame, path: str, mode: str = "append") -> None:
    """Store messages for repeated triage runs: the subject and receive time become
    top-level columns (a predicate inside ``payload.headers`` cannot reach the scan) and
    files are partitioned by receive day (UTC), so a ``since`` filter prunes whole days."""
    from litsift.operators.filters import message_fields

    keep = [c for c in messages.columns]
    f = message_fields(messages, keep=keep)
    out = f.select(*keep, "email_subject", "email_ts",
                   utc_day(F.col("email_ts")).alias("day"))
    out.write.mode(mode).partitionBy("day").parquet(path)


def read_stored_messages(spark: SparkSession, path: str) -> DataFrame:
    """Scan stored messages (``write_messages``); ``day`` is a partition column."""
    return spark.read.parquet(path)
