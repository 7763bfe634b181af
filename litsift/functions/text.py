"""Text functions as Spark Columns (all JVM-side, inside whole-stage codegen).

Each function takes and returns a ``Column`` so it can be used in ``select``/``withColumn``
and composes with Catalyst's constant folding and pushdown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results)
# ---------------------------------------------------------------------------------------
# Words skipped when picking a key phrase from a title.
STOP_WORDS = ["a", "an", "the", "on", "of", "for", "and", "in", "to", "with"]
# Abstracts longer than this are cut to (limit - 3) characters plus "..." in a prompt.
ABSTRACT_LIMIT = 2000
ABSTRACT_ELLIPSIS = "..."
# Shown in a prompt when a paper has no categories.
NO_CATEGORIES = "Not specified"
# Whitespace removed by "strip" (ASCII whitespace).
WHITESPACE = " \t\n\x0b\x0c\r"
# Token = maximal run of letters or digits (any script).
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
# ---------------------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """Remove leading/trailing ASCII whitespace (Spark's ``trim`` alone strips spaces only)."""
    return F.trim(_c(col), F.lit(WHITESPACE))


def clean_title(col) -> Column:
    """Strip, newline -> space, then one pass of double space -> single space."""
    return F.replace(F.replace(strip(col), F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" "))


def clean_authors(col) -> Column:
    """Strip, newline -> ", ", then one pass of double space -> single space."""
    return F.replace(F.replace(strip(col), F.lit("\n"), F.lit(", ")), F.lit("  "), F.lit(" "))


def first_line(col) -> Column:
    """Text up to the first newline."""
    return F.split_part(_c(col), F.lit("\n"), F.lit(1))


def normalize_abstract(col) -> Column:
    """Newlines become spaces (abstracts from the catalogue)."""
    return F.replace(_c(col), F.lit("\n"), F.lit(" "))


def split_authors(col) -> Column:
    """Author string -> array on ", " (an empty string gives ``[""]``)."""
    return F.split(_c(col), ", ")


def last_name(col) -> Column:
    """Last name of one author: the part before a comma ("Smith, John"), else the last
    whitespace-separated token ("John Smith")."""
    c = _c(col)
    return F.when(F.contains(c, F.lit(",")), strip(F.split_part(c, F.lit(","), F.lit(1)))) \
        .otherwise(F.regexp_extract(strip(c), r"(\S+)$", 1))


def first_author_last_name(authors) -> Column:
    """Last name of the first author of an ``array<string>`` of authors."""
    return last_name(F.try_element_at(_c(authors), F.lit(1)))


def norm_title(col) -> Column:
    """Lower case; every run of non letters/digits -> one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(_c(col)), TOKEN_SPLIT, " "))


def tokens(col, drop_stop_words: bool = True) -> Column:
    """Distinct lower-case tokens (letters/digits), optionally without the stop words.

    ``array_except`` removes the empty string and the stop words and deduplicates in one
    hashed pass, with no lambda (lambdas run outside whole-stage codegen)."""
    parts = F.split(F.lower(_c(col)), TOKEN_SPLIT)
    drop = [""] + (STOP_WORDS if drop_stop_words else [])
    return F.array_except(parts, F.array(*[F.lit(w) for w in drop]))


def token_set_key(tok) -> Column:
    """A canonical string for a token set (sorted, space-joined) usable as a join key."""
    return F.array_join(F.array_sort(_c(tok)), " ")


def key_phrase(col, n: int = 2) -> Column:
    """First ``n`` words of a title that are not stop words, punctuation removed."""
    words = F.split(_c(col), r"\s+")
    cleaned = F.transform(words, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    kept = F.filter(cleaned, lambda w: (w != "") & ~F.array_contains(stop, F.lower(w)))
    return F.array_join(F.slice(kept, 1, n), " ")


def truncate_abstract(col) -> Column:
    """Abstracts over the limit are cut and end in an ellipsis (prompt size cap)."""
    c = _c(col)
    keep = ABSTRACT_LIMIT - len(ABSTRACT_ELLIPSIS)
    return F.when(F.length(c) > ABSTRACT_LIMIT,
                  F.concat(F.substring(c, 1, keep), F.lit(ABSTRACT_ELLIPSIS))).otherwise(c)


def categories_str(col) -> Column:
    """Join categories with ", "; none -> "Not specified"."""
    c = _c(col)
    return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.array_join(c, ", ")) \
        .otherwise(F.lit(NO_CATEGORIES))


def format_score(col) -> Column:
    """Two decimals (half-even on the binary value), without a thousands separator."""
    return F.replace(F.format_number(_c(col), 2), F.lit(","), F.lit(""))
