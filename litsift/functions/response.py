"""Parsing of scorer answers (P23-P25) as Spark Columns.

The answer format is ``<explanation>..</explanation><score>N</score>``, possibly inside a
fenced block (``` or ```xml), outside of which tags are not searched.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litsift.functions.text import _c, strip

EXPLANATION_RE = r"(?s)<explanation>(.*?)</explanation>"
SCORE_RE = r"(?s)<score>(.*?)</score>"
# A plain decimal number (no "nan", "inf", "1_0", "8/10"): both engines cast it the same.
NUMBER_RE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SNIPPET_CHARS = 200

ERR_MISSING = "missing <explanation> or <score>"
ERR_NUMBER = "score is not a number"


def fenced(resp) -> Column:
    """What is between the first fence (an ``xml`` one, if there is any) and the last; the
    whole answer without fences; nothing if the fence is not closed."""
    r = _c(resp)
    return (F.when(F.contains(r, F.lit("```xml")), F.regexp_extract(r, r"(?s)```xml(.*)```", 1))
            .when(F.contains(r, F.lit("```")), F.regexp_extract(r, r"(?s)```(.*)```", 1))
            .otherwise(r))


def score_text(resp) -> Column:
    return strip(F.regexp_extract(fenced(resp), SCORE_RE, 1))


def parse_error(resp) -> Column:
    """NULL when the answer parses, else the reason."""
    r = fenced(resp)
    has_both = F.regexp_like(r, F.lit(EXPLANATION_RE)) & F.regexp_like(r, F.lit(SCORE_RE))
    return (F.when(r.isNull() | ~has_both, F.lit(ERR_MISSING))
            .when(~F.regexp_like(score_text(resp), F.lit(NUMBER_RE)), F.lit(ERR_NUMBER)))


def parsed_score(resp) -> Column:
    """Score on a 0..1 scale (raw / 10); not clamped; NULL when unparseable."""
    st = score_text(resp)
    return F.when(F.regexp_like(st, F.lit(NUMBER_RE)), st.try_cast("double") / F.lit(10.0))


def parse_response(resp) -> dict[str, Column]:
    """``relevance_score``, ``explanation``, ``parse_error`` and ``out_of_range`` Columns
    (unaliased).

    A failed parse scores 0.0 and its explanation carries the reason and the first
    characters of the answer.
    """
    r = _c(resp)
    err = parse_error(r)
    expl = strip(F.regexp_extract(fenced(r), EXPLANATION_RE, 1))
    fallback = F.concat(F.lit("Unparsed answer ("), err, F.lit("): "),
                        F.coalesce(F.substring(r, 1, SNIPPET_CHARS), F.lit("")), F.lit("..."))
    score = parsed_score(r)
    return {
        "relevance_score": F.when(err.isNull(), score).otherwise(F.lit(0.0)),
        "explanation": F.when(err.isNull(), expl).otherwise(fallback),
        "parse_error": err,
        # Scores are kept unclamped (15 -> 1.5); this flags answers outside 0..10.
        "out_of_range": err.isNull() & ((score < 0) | (score > 1)),
    }
