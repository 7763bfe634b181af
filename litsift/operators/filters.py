"""Digest filters and message field projection (S1 columns, F1-F5, A5, P1-P3, P9, P13)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsift.functions import mail

# ---------------------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results)
# ---------------------------------------------------------------------------------------
DIGEST_NEEDLE = "Scholar Alert"       # subject search term of the mail query
DIGEST_MARKER = "scholar-inbox.com"   # only bodies containing this are parsed
DEFAULT_SINCE_DAYS = 30
# ---------------------------------------------------------------------------------------


def message_fields(messages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Project a message table (schema ``MESSAGE``) to flat columns.

    ``email_id, email_subject, email_sender, email_date`` (header text), ``email_ts`` (the
    time the mailbox received the message; where it is not known, the parsed Date header)
    and ``body_html`` (decoded body). Malformed base64 gives an empty body and
    ``decode_error = true`` instead of failing the whole job.
    """
    h = F.col("payload.headers")
    data = mail.body_data(F.col("payload"))
    html = mail.decode_b64url(data)
    cols = [F.col(c) for c in (keep or [])] + [
        F.coalesce(F.col("id"), F.lit("")).alias("email_id"),
        mail.header(h, "Subject", mail.DEFAULT_SUBJECT).alias("email_subject"),
        mail.header(h, "From", mail.DEFAULT_SENDER).alias("email_sender"),
        mail.header(h, "Date", mail.DEFAULT_DATE).alias("email_date"),
        F.coalesce(html, F.lit("")).alias("body_html"),
        (data.isNotNull() & html.isNull()).alias("decode_error"),
    ]
    received = (F.timestamp_millis(F.col("internalDate").try_cast("long")) if "internalDate" in messages.columns
                else F.lit(None).cast("timestamp"))
    out = messages.select(*cols, received.alias("email_ts"))
    return out.withColumn("email_ts", F.coalesce(
        F.col("email_ts"), mail.parse_rfc2822(F.nullif(F.col("email_date"), F.lit("")))))


def _since_col(since) -> Column:
    if isinstance(since, Column):
        return since
    if isinstance(since, (_dt.date, _dt.datetime)):
        since = since.isoformat()
    return F.to_date(F.lit(str(since)[:10]))


def _since_bound(df: DataFrame | None, ts: str, since) -> Column:
    """Start of the ``since`` day in UTC, typed for the column it is compared with: a
    wall-clock (``timestamp_ntz``) column compares with the date itself; an instant
    (``timestamp``) column with UTC midnight, whatever the session time zone is."""
    day = _since_col(since)
    if df is not None and ts in df.columns and df.schema[ts].dataType.typeName() == "timestamp":
        return F.make_timestamp(F.year(day), F.month(day), F.dayofmonth(day),
                                F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))
    return day


def default_since(now=None, days: int = DEFAULT_SINCE_DAYS) -> Column:
    """the day ``days`` before ``now`` (today when not given)."""
    base = F.current_date() if now is None else _since_col(now)
    return F.date_sub(base, days)


def is_digest(subject="email_subject", ts="email_ts", since=None,
              needle: str = DIGEST_NEEDLE, df: DataFrame | None = None) -> Column:
    """F1 predicate: subject contains ``needle`` (case-insensitive) and received on or after
    the day ``since`` (inclusive, UTC)."""
    s = F.col(subject) if isinstance(subject, str) else subject
    pred = F.contains(F.lower(s), F.lit(needle.lower()))
    if since is not None:
        t = F.col(ts) if isinstance(ts, str) else ts
        # A plain conjunction (NULL counts as false in where/count_if): the date bound stays
        # a separate conjunct that Catalyst pushes into the Parquet scan.
        pred = (t >= _since_bound(df, ts if isinstance(ts, str) else "", since)) & pred
    return pred


def filter_digests(df: DataFrame, since=None, needle: str = DIGEST_NEEDLE,
                   subject: str = "email_subject", ts: str = "email_ts", day: str = "day") -> DataFrame:
    """keep digest messages. On stored messages (top-level subject/time columns,
    partitioned by ``day``) the time bound reaches the Parquet scan (PushedFilters) and the
    day bound prunes partitions (PartitionFilters)."""
    pred = is_digest(subject, ts, since, needle, df)
    if since is not None and day in df.columns:
        pred = (F.col(day) >= _since_col(since)) & pred
    return df.where(pred)


def filter_marker(df: DataFrame, marker: str = DIGEST_MARKER, col: str = "body_html") -> DataFrame:
    """cheap gate before the costly extraction."""
    return df.where(F.contains(F.col(col), F.lit(marker)))


def digest_counts(df: DataFrame, since=None, needle: str = DIGEST_NEEDLE,
                  subject: str = "email_subject", ts: str = "email_ts") -> DataFrame:
    """A5: messages seen and digests kept, in one pass (partial aggregation per task)."""
    return df.agg(F.count(F.lit(1)).alias("n_messages"),
                  F.count_if(is_digest(subject, ts, since, needle, df)).alias("n_digests"))


def require_columns(df: DataFrame, cols: list[str]) -> None:
    """Plan-time schema check (no job): raise before any work is paid for."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Papers are missing required fields: {', '.join(missing)}")


def split_valid(papers: DataFrame, id_col: str = "arxiv_id", title_col: str = "title"):
    """papers need an id and a title. Columns are checked at plan time; rows with a
    NULL id or title go to ``rejected`` instead of aborting the run."""
    require_columns(papers, [id_col, title_col])
    ok = F.col(id_col).isNotNull() & F.col(title_col).isNotNull()
    return papers.where(ok), papers.where(~ok)
