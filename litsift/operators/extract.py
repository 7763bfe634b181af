"""Article extraction from digest HTML (G1, G2, P4-P9) and paper cleaning.

A body is split into tokens and folded into elements (``functions.markup``); every ``<article>``,
nested ones too, becomes a row with the fields found inside it: narrow, shuffle-free JVM
expressions. A message with ``n`` articles gives ``n`` rows; an article without a title still
gives a row (its ``title`` is NULL).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsift.functions import mail, markup
from litsift.functions.text import clean_authors, clean_title, strip

# ---------------------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results)
# ---------------------------------------------------------------------------------------
RELEVANCE_LABEL = "Relevance:"
VENUE_STYLE = "display:inline;float:right;"
# ---------------------------------------------------------------------------------------

INT_RE = r"^[+-]?[0-9]+$"


def article_fields(block: DataFrame, heading: str = "h2", title_in_link: bool = True) -> DataFrame:
    """``block`` with title, authors, relevance, venue and url instead of ``tokens`` and
    ``els``, an article's tokens and the elements inside it in their order.

    ``heading`` is the title element; with ``title_in_link`` the title is the text of the
    first link inside it (the digest layout), else the heading's own text (plain pages).
    """
    keep = [c for c in block.columns if c not in ("tokens", "els")]
    tag = lambda e: f"tokens[{e}.start - 1].raw"
    first = lambda name, also="true": f"try_element_at(filter(els, e -> e.name = '{name}' and {also}), 1)"
    inside = markup.within("tokens", "e")
    label = markup.literal(RELEVANCE_LABEL)
    styled = f"contains({markup.attribute(tag('e'), 'style')}, {markup.literal(VENUE_STYLE)})"
    labelled = f"{markup.single_string(inside)} and contains({markup.text_of(inside)}, {label})"
    found = block.selectExpr("*", f"{first(heading)} as h", f"{first('p')} as p", f"{first('span', labelled)} as label", f"{first('div', styled)} as div")
    found = found.selectExpr("*", f"{first('a', 'e.start > h.start and e.start < h.stop')} as a")
    text = lambda e: f"if({e} is not null, {markup.raw_text(markup.within('tokens', e))}, null)"
    raw = [text("a" if title_in_link else "h"), text("p"), text("label"), text("div"), f"if(a is not null, {markup.raw_attribute(tag('a'), 'href')}, null)"]
    # All five at once: one expression decodes references.
    found = found.selectExpr(*keep, f"transform(array({', '.join(raw)}), f -> {markup.unescape('f')}) as f")
    trimmed = [markup.trim_spaces(f"f[{i}]") for i in range(4)]
    rel = f"replace({trimmed[2]}, {label}, '')"
    found = found.selectExpr(*keep, f"{trimmed[0]} as title", f"{trimmed[1]} as authors", f"{markup.trim_spaces(rel)} as rel", f"{trimmed[3]} as venue", "f[4] as url")
    relevance = f"if(rel is not null, coalesce(if(rel rlike '{INT_RE}', try_cast(rel as int), null), 0), null) as relevance"
    return found.selectExpr(*keep, "title", "authors", relevance, "venue", "url")


def extract_articles(df: DataFrame, html_col: str = "body_html", keep: list[str] | None = None,
                     heading: str = "h2", title_in_link: bool = True) -> DataFrame:
    """One row per ``<article>`` of every message, with ``article_pos`` (0-based order
    in the message) and the columns in ``keep`` (P9: email id, date, subject, sender)."""
    keep = keep if keep is not None else [c for c in ("email_id", "email_date", "email_subject",
                                                       "email_sender", "email_ts") if c in df.columns]
    names = ["article", heading, "a", "p", "span", "div"]
    parsed = df.select(*keep, F.expr(markup.tokens(f"`{html_col}`")).alias("tokens"))
    parsed = parsed.selectExpr("*", f"{markup.elements('tokens', names)} as els")
    moved = ("transform(filter(els, e -> e.start > a.start and e.start < a.stop), "
             "e -> named_struct('start', e.start - a.start + 1, 'stop', e.stop - a.start + 1, 'name', e.name))")
    block = f"named_struct('tokens', slice(tokens, a.start, a.stop - a.start + 1), 'els', {moved})"
    rows = parsed.select(*keep, F.expr(f"posexplode(transform(filter(els, a -> a.name = 'article'), a -> {block}))").alias("article_pos", "block"))
    rows = rows.select(*keep, F.col("article_pos").cast("int").alias("article_pos"), "block.tokens", "block.els")
    return article_fields(rows, heading, title_in_link)


def clean_papers(raw: DataFrame) -> DataFrame:
    """Normalised text fields, defaults for absent ones, parsed date, url id."""
    cols = [c for c in raw.columns
            if c not in ("title", "authors", "relevance", "venue", "url", "email_id", "email_date")]
    return raw.select(
        *cols,
        clean_title(F.coalesce(F.col("title"), F.lit(""))).alias("title"),
        clean_authors(F.coalesce(F.col("authors"), F.lit(""))).alias("authors"),
        F.coalesce(F.col("relevance"), F.lit(0)).alias("relevance"),
        strip(F.coalesce(F.col("venue"), F.lit(""))).alias("venue"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        F.coalesce(F.col("email_id"), F.lit("")).alias("email_id"),
        F.coalesce(F.col("email_date"), F.lit("")).alias("email_date"),
        F.when(F.coalesce(F.col("email_date"), F.lit("")) != "",
               mail.parse_rfc2822(F.col("email_date"))).alias("date"),
        mail.arxiv_id_from_url(F.col("url")).alias("arxiv_id"),
    )
