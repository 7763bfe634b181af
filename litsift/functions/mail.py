"""Mail-message and identifier functions as Spark Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litsift.functions.text import _c

# ---------------------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results)
# ---------------------------------------------------------------------------------------
DEFAULT_SUBJECT = "No Subject"
DEFAULT_SENDER = "No From"
DEFAULT_DATE = ""
HTML_MIME = "text/html"
ARXIV_HOST = "arxiv.org"
ARXIV_ABS_ID = r"arxiv\.org/abs/(\d+\.\d+)"
# RFC 2822 date without the weekday; zone as offset (+0130) or name (GMT, EST).
RFC2822_PATTERN = "d MMM yyyy HH:mm[:ss][ Z][ z]"
# ---------------------------------------------------------------------------------------


def header(headers, name: str, default: str | None = None) -> Column:
    """Value of header ``name`` (exact, case-sensitive); the last duplicate wins.

    ``try_element_at(..., -1)`` is NULL on an empty array, where ``element_at`` raises and
    ``map_from_entries`` would raise on duplicate names.
    """
    hit = F.try_element_at(F.filter(_c(headers), lambda h: h["name"] == F.lit(name)), F.lit(-1))
    value = hit["value"]
    return F.coalesce(value, F.lit(default)) if default is not None else value


def body_data(payload) -> Column:
    """Encoded HTML body: ``payload.body.data`` wins; else the last top-level ``text/html``
    part that has data (nested multiparts are not visited)."""
    p = _c(payload)
    parts = F.filter(p["parts"], lambda x: (x["mimeType"] == F.lit(HTML_MIME)) & x["body"]["data"].isNotNull())
    return F.coalesce(p["body"]["data"], F.try_element_at(parts, F.lit(-1))["body"]["data"])


def decode_b64url(col) -> Column:
    """base64url -> UTF-8 text; invalid input -> NULL (never fails the job)."""
    std = F.translate(_c(col), "-_", "+/")
    return F.decode(F.try_to_binary(std, F.lit("base64")), "UTF-8")


def encode_b64url(col) -> Column:
    """UTF-8 text -> base64url (padding kept)."""
    return F.translate(F.base64(F.encode(_c(col), "UTF-8")), "+/", "-_")


def parse_rfc2822(col) -> Column:
    """RFC 2822 date string -> timestamp; unparseable -> NULL.

    The weekday (short or long, with or without a comma) is dropped first (a pattern with
    ``EEE`` cannot parse) and so is a trailing comment such as ``(UTC)``. Seconds are
    optional, a year of two digits lies in 1969 to 2068, and a date without a zone is UTC.
    """
    s = F.regexp_replace(_c(col), r"^\s*[A-Za-z]+,?\s*(?=\d)", "")
    s = F.regexp_replace(s, r"\s*\([^)]*\)\s*$", "")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    s = F.regexp_replace(s, r"^(\d{1,2} [A-Za-z]{3}) ([0-5]\d|6[0-8]) ", "$1 20$2 ")
    s = F.regexp_replace(s, r"^(\d{1,2} [A-Za-z]{3}) (69|[7-9]\d) ", "$1 19$2 ")
    s = F.regexp_replace(s, r"(:\d{2})$", "$1 +0000")
    return F.try_to_timestamp(s, F.lit(RFC2822_PATTERN))


def arxiv_id_from_url(col) -> Column:
    """``NNNN.NNNNN`` from an ``arxiv.org/abs/`` URL, else NULL."""
    c = _c(col)
    return F.when(F.contains(c, F.lit(ARXIV_HOST)),
                  F.nullif(F.regexp_extract(c, ARXIV_ABS_ID, 1), F.lit("")))


def entry_id_tail(col) -> Column:
    """Last path element of a catalogue entry id (keeps a version suffix)."""
    return F.element_at(F.split(_c(col), "/"), -1)


def arxiv_id_base(col) -> Column:
    """Identifier without a trailing version (``2201.12345v2`` -> ``2201.12345``)."""
    return F.regexp_replace(_c(col), r"v\d+$", "")
