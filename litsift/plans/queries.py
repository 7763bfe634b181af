"""Query registry: each engine operator run on the driver's tables, with its SQL oracle.

``QUERIES[name] = (fn(spark, sf_dir) -> DataFrame, oracle SQL or None)``. Every query reads
whole tables (or data Spark derives from them). Computed columns carry the same alias in
the Spark plan and the SQL; doubles are rounded the same way on both sides.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsift.functions import mail
from litsift.functions.text import format_score, key_phrase, last_name, split_authors
from litsift.operators import dedup, extract, filters, lookup, rank, score
from litsift.plans import bindings as B
from litsift.plans import oracle as O
from litsift.sources.models import models_df

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
ROUND = 6


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def _r(c, n: int = ROUND):
    return F.round(c, n)


def _docs(spark, sf):
    return B.table(spark, sf, "documents")


def _papers(spark, sf):
    return B.papers_from_documents(_docs(spark, sf))


def _catalogue(spark, sf):
    return B.catalogue_from_documents(_docs(spark, sf))


def _questions(spark, sf):
    return B.questions_from_benchmark(B.table(spark, sf, "benchmark"))


SUBJECT_SQL = ("CASE WHEN event_type IN ('error', 'signup') THEN 'Account notice: ' || event_type "
               "ELSE 'Scholar Alert Digest: ' || event_type END")
RFC_SQL = "strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' +0000'"

# ---- F1, A5: digest filter and counts -------------------------------------------------------
SINCE = "2024-01-15"


def _event_messages(spark, sf):
    ev = B.table(spark, sf, "events")
    return ev.select("event_id", B.message_subject("event_type").alias("email_subject"),
                     F.col("ts").alias("email_ts"))


@query("digest_since", f"""
SELECT event_id, {SUBJECT_SQL} AS email_subject, CAST(CAST(ts AS DATE) AS VARCHAR) AS day
FROM events
WHERE contains(lower({SUBJECT_SQL}), 'scholar alert') AND ts >= DATE '{SINCE}'
""")
def q_digest_since(spark, sf):
    kept = filters.filter_digests(_event_messages(spark, sf), since=SINCE)
    return kept.select("event_id", "email_subject", F.col("email_ts").cast("date").cast("string").alias("day"))


@query("digest_counts", f"""
SELECT CAST(count(*) AS BIGINT) AS n_messages,
       CAST(count(*) FILTER (WHERE contains(lower({SUBJECT_SQL}), 'scholar alert')
                             AND ts >= DATE '{SINCE}') AS BIGINT) AS n_digests
FROM events
""")
def q_digest_counts(spark, sf):
    return filters.digest_counts(_event_messages(spark, sf), since=SINCE)


# ---- F1: the mailbox's own time of receipt wins over the Date header --------------------------
@query("digest_received", f"""
SELECT 'event-' || CAST(event_id AS VARCHAR) AS email_id, {SUBJECT_SQL} AS email_subject,
       CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS epoch_s
FROM events
WHERE contains(lower({SUBJECT_SQL}), 'scholar alert') AND ts >= DATE '{SINCE}'
""")
def q_digest_received(spark, sf):
    # Every third message has only a Date header, every third only a time of receipt, and the
    # rest a time of receipt and a header that says something else.
    ev = B.table(spark, sf, "events").select("event_id", "event_type", B.rfc2822(F.col("ts")).alias("sent"))
    v = F.col("event_id") % 3
    millis = F.unix_millis(mail.parse_rfc2822("sent")).cast("string")
    date = F.when(v == 0, F.col("sent")).when(v == 1, F.lit("Fri, 01 Jan 1999 00:00:00 +0000"))
    none = F.lit(None).cast("string")
    msgs = ev.select(
        F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("id"),
        F.when(v != 0, millis).alias("internalDate"),
        F.struct(F.filter(F.array(_hdr(F.lit("Subject"), B.message_subject("event_type")), _hdr(F.lit("Date"), date)),
                          lambda h: h["value"].isNotNull()).alias("headers"),
                 F.struct(none.alias("data")).alias("body"),
                 F.array(F.struct(none.alias("mimeType"), F.struct(none.alias("data")).alias("body"))).alias("parts")).alias("payload"))
    kept = filters.filter_digests(filters.message_fields(msgs), since=SINCE)
    return kept.select("email_id", "email_subject", F.unix_timestamp("email_ts").alias("epoch_s"))


# ---- P1, F4: header pick --------------------------------------------------------------------
def _hdr(name, value):
    return F.struct(name.alias("name"), value.alias("value"))


@query("header_pick", f"""
WITH h AS (
  SELECT event_id, list_filter([
      {{'name': 'Subject', 'value': {SUBJECT_SQL}}},
      {{'name': CASE WHEN event_type <> 'view' THEN 'From' END,
        'value': 'user' || CAST(user_id AS VARCHAR) || '@example.com'}},
      {{'name': 'Date', 'value': {RFC_SQL}}},
      {{'name': CASE WHEN event_type = 'purchase' THEN 'Subject' END,
        'value': 'Receipt ' || CAST(event_id AS VARCHAR)}}
    ], lambda x: x.name IS NOT NULL) AS headers
  FROM events)
SELECT event_id,
  coalesce(list_filter(headers, lambda x: x.name = 'Subject')[-1].value, 'No Subject') AS email_subject,
  coalesce(list_filter(headers, lambda x: x.name = 'From')[-1].value, 'No From') AS email_sender,
  coalesce(list_filter(headers, lambda x: x.name = 'Date')[-1].value, '') AS email_date
FROM h
""")
def q_header_pick(spark, sf):
    ev = B.table(spark, sf, "events")
    et = F.col("event_type")
    headers = F.filter(F.array(
        _hdr(F.lit("Subject"), B.message_subject(et)),
        _hdr(F.when(et != "view", F.lit("From")),
             F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com"))),
        _hdr(F.lit("Date"), B.rfc2822(F.col("ts"))),
        _hdr(F.when(et == "purchase", F.lit("Subject")),
             F.concat(F.lit("Receipt "), F.col("event_id").cast("string"))),
    ), lambda h: h["name"].isNotNull())
    return ev.select("event_id",
                     mail.header(headers, "Subject", mail.DEFAULT_SUBJECT).alias("email_subject"),
                     mail.header(headers, "From", mail.DEFAULT_SENDER).alias("email_sender"),
                     mail.header(headers, "Date", mail.DEFAULT_DATE).alias("email_date"))


# ---- P2, P3: body decode ----------------------------------------------------------------------
@query("body_decode", """
SELECT 'page-' || CAST(page_id AS VARCHAR) AS email_id, md5(html) AS body_md5,
       CAST(length(html) AS INTEGER) AS body_len, false AS decode_error
FROM pages
""")
def q_body_decode(spark, sf):
    msgs = B.messages_from_pages(B.table(spark, sf, "pages"), None)
    f = filters.message_fields(msgs)
    return f.select("email_id", F.md5("body_html").alias("body_md5"),
                    F.length("body_html").alias("body_len"), "decode_error")


# ---- F3, G1, P4, P5, P9: article extraction ---------------------------------------------------
def _extract_sql(src: str) -> str:
    """Article rows from ``src(email_id, h)``, ``h`` being a page: cut by positions. An article
    of a page holds a heading and paragraphs; the first one ends where as many have been closed as opened."""
    def text(x: str) -> str:
        for name, sign in (("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"), ("#39", "chr(39)"), ("nbsp", "chr(160)"), ("copy", "chr(169)"),
                           ("middot", "chr(183)"), ("amp", "'&'")):
            x = f"replace({x}, '&{name};', {sign})"
        return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"

    return f"""
  b AS (SELECT email_id, string_split(h, '<article>')[2:] AS blocks FROM {src}),
  a AS (SELECT email_id, split_part(unnest(blocks), '</article>', 1) AS block, CAST(unnest(range(len(blocks))) AS INTEGER) AS article_pos FROM b),
  t AS (SELECT email_id, article_pos, unnest(string_split(block, '<')) AS piece, unnest(range(len(string_split(block, '<')))) AS i FROM a),
  d AS (SELECT *, sum(CASE WHEN starts_with(piece, 'p>') THEN 1 WHEN starts_with(piece, '/p>') THEN -1 ELSE 0 END)
                  OVER (PARTITION BY email_id, article_pos ORDER BY i) AS depth,
               min(CASE WHEN starts_with(piece, 'p>') THEN i END) OVER (PARTITION BY email_id, article_pos) AS first FROM t),
  e AS (SELECT *, min(CASE WHEN i > first AND depth = 0 THEN i END) OVER (PARTITION BY email_id, article_pos) AS last FROM d),
  p AS (SELECT email_id, article_pos, string_agg(substr(piece, instr(piece, '>') + 1), '' ORDER BY i) AS authors
        FROM e WHERE i >= first AND (last IS NULL OR i < last) GROUP BY email_id, article_pos),
  art AS (SELECT a.email_id, a.article_pos,
    CASE WHEN contains(block, '<h1>') THEN {text("split_part(split_part(block, '<h1>', 2), '</h1>', 1)")} END AS title, {text("authors")} AS authors,
    CAST(NULL AS INTEGER) AS relevance, CAST(NULL AS VARCHAR) AS venue, CAST(NULL AS VARCHAR) AS url
  FROM a LEFT JOIN p ON p.email_id = a.email_id AND p.article_pos = a.article_pos)"""


@query("article_extract", f"""
WITH m AS (SELECT 'page-' || CAST(page_id AS VARCHAR) AS email_id, html AS h FROM pages
           WHERE contains(html, '<article')),
{_extract_sql('m')}
SELECT email_id, article_pos, title, authors, relevance, venue, url FROM art
""")
def q_article_extract(spark, sf):
    msgs = B.messages_from_pages(B.table(spark, sf, "pages"), None)
    f = filters.filter_marker(filters.message_fields(msgs), "<article")
    return extract.extract_articles(f, keep=["email_id"], heading="h1", title_in_link=False) \
        .select("email_id", "article_pos", "title", "authors", "relevance", "venue", "url")


# ---- P6-P8: article fields on digest-style HTML --------------------------------------------
def _k(col="props"):
    return F.get_json_object(F.col(col), "$.k").cast("int")


@query("article_fields", """
WITH j AS (SELECT p.page_id, p.url, e.event_type, e.user_id,
                  CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS k
           FROM pages p JOIN events e ON e.event_id = p.page_id)
SELECT 'page-' || CAST(page_id AS VARCHAR) AS email_id, 0 AS article_pos,
       upper(event_type) || ' & notes <' || CAST(page_id AS VARCHAR) || '>' AS title,
       'Author ' || CAST(user_id AS VARCHAR) || ', Author ' || CAST(k AS VARCHAR) AS authors,
       CASE WHEN k % 10 = 0 THEN 0 WHEN k % 7 = 0 THEN NULL ELSE k END AS relevance,
       CASE WHEN k % 5 = 0 AND k % 3 <> 0 THEN NULL ELSE 'Venue of ' || event_type END AS venue,
       url
FROM j
""")
def q_article_fields(spark, sf):
    pages = B.table(spark, sf, "pages").select("page_id", "url")
    ev = B.table(spark, sf, "events").select(F.col("event_id").alias("page_id"), "event_type", "user_id", "props")
    j = pages.join(ev, "page_id").withColumn("k", _k())
    k = F.col("k")
    span = (F.when(k % 10 == 0, F.concat(F.lit("<span>Relevance: "), k.cast("string"), F.lit("%</span>")))
            .when(k % 7 == 0, F.lit("<span>Score</span>"))
            .otherwise(F.concat(F.lit("<span class=\"r\"> Relevance: "), k.cast("string"), F.lit(" </span>"))))
    venue_div = F.concat(F.lit('<div style="display:inline;float:right;">Venue of '), F.col("event_type"), F.lit("</div>"))
    venue = (F.when(k % 3 == 0, F.concat(F.lit('<div style="color:red">Other</div>'), venue_div))
             .when(k % 5 == 0, F.lit(""))
             .otherwise(venue_div))
    html = F.concat(
        F.lit('<div class="scholar-inbox.com"><article>\n<h2><a href="'), F.col("url"), F.lit('">'),
        F.upper("event_type"), F.lit(" &amp; notes &lt;"), F.col("page_id").cast("string"), F.lit("&gt;</a></h2>\n"),
        F.lit("<p>\n Author "), F.col("user_id").cast("string"), F.lit(", Author "), k.cast("string"), F.lit("</p>"),
        span, venue, F.lit("\n</article></div>"))
    msgs = j.select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("email_id"),
                    html.alias("body_html"))
    arts = extract.extract_articles(filters.filter_marker(msgs), keep=["email_id"])
    return arts.select("email_id", "article_pos", "title", "authors", "relevance", "venue", "url")


# ---- G1, P4-P8: markup that is hard to read -----------------------------------------------------
@query("article_markup", """
WITH j AS (SELECT 'page-' || CAST(p.page_id AS VARCHAR) AS email_id, CAST(p.page_id AS VARCHAR) AS id, p.url, e.event_type AS kind,
                  CAST(e.user_id AS VARCHAR) AS u, CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS k
           FROM pages p JOIN events e ON e.event_id = p.page_id)
SELECT email_id, 0 AS article_pos, kind || ' ' || chr(233) || chr(8217) || chr(8212) || ' p < 0.' || k || ' &amp; q > 1' AS title,
       CASE WHEN k % 3 <> 0 THEN 'Ann ' || u || ' & Bo'
            ELSE 'Ann ' || u || ' & Bo ' || chr(160) || 'Score Relevance: 1Relevance: ' || k || 'Venue of "' || kind || '"'
                 || CASE WHEN k % 4 = 0 THEN 'Inner ' || id || 'In ' || id ELSE '' END END AS authors,
       k AS relevance, 'Venue of "' || kind || '"' AS venue, url || '?x=1&y=2' AS url FROM j
UNION ALL
SELECT email_id, 1, 'Inner ' || id, 'In ' || id, NULL, NULL, 'in>' FROM j WHERE k % 4 = 0
UNION ALL
SELECT email_id, CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END, NULL, NULL, 0, NULL, NULL FROM j WHERE k % 7 = 0
""")
def q_article_markup(spark, sf):
    """Bodies with nested and unclosed articles, references, ``<`` in text, either kind of quotes, wrapped labels."""
    pages = B.table(spark, sf, "pages").select("page_id", "url")
    ev = B.table(spark, sf, "events").select(F.col("event_id").alias("page_id"), "event_type", "user_id", "props")
    j = pages.join(ev, "page_id").withColumn("k", _k())
    k, kind, u, n = F.col("k"), F.col("event_type"), F.col("user_id").cast("string"), F.col("page_id").cast("string")
    body = F.concat(
        F.lit('<div class=scholar-inbox.com><!-- <article> --><article class=outer title="a > b"><H2><em><a class="t" href=\''), F.col("url"),
        F.lit("?x=1&amp;y=2'>\n"), kind, F.lit(" &eacute;&#8217;&#x2014; p < 0."), k.cast("string"), F.lit(" &amp;amp; q > 1</a></em></H2><p>Ann "), u,
        F.lit(" &amp; Bo<br> &nbsp;"), F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("</p>")),
        F.lit("<span>Score <b>Relevance: 1</b></span><script>'<span>Relevance: 2</span>'</script><span><b><i>Relevance: "), k.cast("string"),
        F.lit("</i></b></span><div style='color:red;display:inline;float:right;'>Venue <b>of</b> &quot;"), kind, F.lit("&quot;</div>"),
        F.when(k % 4 == 0, F.concat(F.lit('<article><h2><a href="in>">Inner '), n, F.lit("</a></h2><p>In "), n, F.lit("</article>"))).otherwise(F.lit("")),
        F.when(k % 5 == 0, F.lit("</b></article>")).otherwise(F.lit("</article>")),
        F.when(k % 7 == 0, F.lit("<article><span>Relevance: x")).otherwise(F.lit("")), F.lit("</div>"))
    msgs = j.select(F.concat(F.lit("page-"), n).alias("email_id"), body.alias("body_html"))
    return extract.extract_articles(filters.filter_marker(msgs), keep=["email_id"]) \
        .select("email_id", "article_pos", "title", "authors", "relevance", "venue", "url")


# ---- P10-P12: cleaning --------------------------------------------------------------------------
@query("clean_titles", f"""
SELECT CAST(doc_id AS VARCHAR) AS email_id,
       md5({O.clean_title('text')}) AS title_md5, CAST(length({O.clean_title('text')}) AS INTEGER) AS title_len,
       md5({O.clean_authors('text')}) AS authors_md5,
       CAST(length({O.clean_authors('text')}) AS INTEGER) AS authors_len,
       0 AS relevance, source AS venue, '' AS url, '' AS email_date
FROM documents
""")
def q_clean_titles(spark, sf):
    d = _docs(spark, sf)
    raw = d.select(F.col("doc_id").cast("string").alias("email_id"), F.col("text").alias("title"),
                   F.col("text").alias("authors"), F.lit(None).cast("int").alias("relevance"),
                   F.concat(F.lit("  "), F.col("source"), F.lit("\n")).alias("venue"),
                   F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("email_date"))
    c = extract.clean_papers(raw)
    return c.select("email_id", F.md5("title").alias("title_md5"), F.length("title").alias("title_len"),
                    F.md5("authors").alias("authors_md5"), F.length("authors").alias("authors_len"),
                    "relevance", "venue", "url", "email_date")


# ---- P13: RFC 2822 dates --------------------------------------------------------------------------
@query("rfc2822_dates", """
SELECT event_id,
       CASE event_id % 10 WHEN 4 THEN NULL
            WHEN 8 THEN CAST(epoch(date_trunc('minute', ts)) AS BIGINT)
            ELSE CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS epoch_s
FROM events
""")
def q_rfc2822_dates(spark, sf):
    ev = B.table(spark, sf, "events")
    ts = F.col("ts")
    v = F.col("event_id") % 10
    s = (F.when(v == 5, F.concat(F.date_format(ts, "EEEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")))
         .when(v == 6, F.concat(F.date_format(ts, "EEE dd MMM yyyy HH:mm:ss"), F.lit(" +0000")))
         .when(v == 7, F.concat(F.date_format(ts, "EEE, dd MMM yy HH:mm:ss"), F.lit(" +0000")))
         .when(v == 8, F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm"), F.lit(" +0000")))
         .when(v == 9, F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"))
         .when(v == 0,F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")))
         .when(v == 1, F.concat(F.date_format(ts - F.expr("INTERVAL 5 HOURS"), "EEE, dd MMM yyyy HH:mm:ss"),
                                F.lit(" -0500")))
         .when(v == 2, F.concat(F.date_format(ts, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
         .when(v == 3, F.concat(F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000 (UTC)")))
         .otherwise(F.concat(F.lit("not a date "), F.col("event_id").cast("string"))))
    return ev.select("event_id", F.unix_timestamp(mail.parse_rfc2822(s)).alias("epoch_s"))


# ---- P14, P15: identifiers from urls --------------------------------------------------------------
PAGE_NUM_RE = r"/([0-9]+)(\.html)?/?([?#].*)?$"


def _entry_url(page_id, url):
    n = F.regexp_extract(url, PAGE_NUM_RE, 1)
    return F.concat(F.lit("http://arxiv.org/abs/2401."), F.lpad(n, 5, "0"), F.lit("v"),
                    ((page_id % 3) + 1).cast("string"))


@query("url_ids", f"""
WITH p AS (SELECT page_id, url,
  'http://arxiv.org/abs/2401.' || lpad(regexp_extract(url, '{PAGE_NUM_RE}', 1), 5, '0') || 'v'
    || CAST(page_id % 3 + 1 AS VARCHAR) AS entry FROM pages)
SELECT page_id, string_split(url, '/')[-1] AS url_tail,
  CASE WHEN contains(url, 'arxiv.org') THEN nullif(regexp_extract(url, '{mail.ARXIV_ABS_ID}', 1), '') END AS url_arxiv_id,
  string_split(entry, '/')[-1] AS entry_tail,
  CASE WHEN contains(entry, 'arxiv.org') THEN nullif(regexp_extract(entry, '{mail.ARXIV_ABS_ID}', 1), '') END AS entry_arxiv_id,
  regexp_replace(string_split(entry, '/')[-1], 'v[0-9]+$', '') AS entry_base
FROM p
""")
def q_url_ids(spark, sf):
    p = B.table(spark, sf, "pages")
    e = _entry_url(F.col("page_id"), F.col("url"))
    return p.select("page_id", mail.entry_id_tail("url").alias("url_tail"),
                    mail.arxiv_id_from_url("url").alias("url_arxiv_id"),
                    mail.entry_id_tail(e).alias("entry_tail"),
                    mail.arxiv_id_from_url(e).alias("entry_arxiv_id"),
                    mail.arxiv_id_base(mail.entry_id_tail(e)).alias("entry_base"))


# ---- P19: key phrase ----------------------------------------------------------------------------
@query("key_phrase", f"""
WITH p AS ({O.PAPERS})
SELECT arxiv_id, {O.key_phrase('title')} AS key_phrase FROM p
""")
def q_key_phrase(spark, sf):
    return _papers(spark, sf).select("arxiv_id", key_phrase("title").alias("key_phrase"))


# ---- P17, P18: author names -----------------------------------------------------------------------
@query("author_names", f"""
WITH a AS (
  SELECT c.c_custkey,
         concat_ws(', ', replace(c.c_name, '#', ' '), replace(s.s_name, '#', ' ')) AS authors,
         replace(c.c_name, '#', ', ') AS alt_author
  FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey)
SELECT c_custkey, CAST(len(string_split(authors, ', ')) AS INTEGER) AS n_authors,
       string_split(authors, ', ')[1] AS first_author,
       {O.last_name("string_split(authors, ', ')[1]")} AS last_name,
       {O.last_name('alt_author')} AS alt_last_name
FROM a
""")
def q_author_names(spark, sf):
    c = B.table(spark, sf, "customer").select("c_custkey", "c_name")
    s = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name")
    a = c.join(s, "c_custkey", "left").select(
        "c_custkey",
        F.concat_ws(", ", F.replace("c_name", F.lit("#"), F.lit(" ")),
                    F.replace("s_name", F.lit("#"), F.lit(" "))).alias("authors"),
        F.replace("c_name", F.lit("#"), F.lit(", ")).alias("alt_author"))
    arr = split_authors("authors")
    return a.select("c_custkey", F.size(arr).alias("n_authors"), arr[0].alias("first_author"),
                    last_name(arr[0]).alias("last_name"), last_name("alt_author").alias("alt_last_name"))


# ---- J1-J5, W1, A4: catalogue lookup ----------------------------------------------------------------
K = lookup.DEFAULT_K
SELF = ("arxiv_id", "doc_key")


def _doc_papers(spark, sf):
    return _papers(spark, sf).withColumn("paper_key", F.col("arxiv_id"))


def _tier_sql(tier: int, papers: str, catalogue: str, self_excl: bool) -> str:
    """Brute-force candidates of one tier: (paper_key, entry_id, sim) over all pairs."""
    ne = " AND p.paper_key <> c.doc_key" if self_excl else ""
    if tier == 1:
        return (f"SELECT p.paper_key, c.entry_id, 1.0::DOUBLE AS sim FROM {papers} p JOIN {catalogue} c "
                f"ON {O.norm_title('p.title')} = {O.norm_title('c.title')} AND {O.norm_title('p.title')} <> ''{ne}")
    if tier == 2:
        return (f"SELECT p.paper_key, c.entry_id, CAST(len(p.qt) AS DOUBLE) / len(c.ct) AS sim "
                f"FROM (SELECT *, {O.tokens('title')} AS qt FROM {papers}) p "
                f"JOIN (SELECT *, {O.tokens('title')} AS ct FROM {catalogue}) c "
                f"ON len(p.qt) > 0 AND len(c.ct) > 0 AND list_has_all(c.ct, p.qt){ne}")
    first = "string_split(p.authors, ', ')[1]"
    return (f"SELECT p.paper_key, c.entry_id, "
            f"CASE WHEN len(list_distinct(list_concat(p.qt, c.ct))) = 0 THEN 0.0::DOUBLE ELSE "
            f"CAST(len(list_intersect(p.qt, c.ct)) AS DOUBLE) / len(list_distinct(list_concat(p.qt, c.ct))) END AS sim "
            f"FROM (SELECT *, {O.tokens('title')} AS qt, lower({O.last_name(first.replace('p.', ''))}) AS a_last, "
            f"lower({O.key_phrase('title')}) AS phrase FROM {papers}) p "
            f"JOIN (SELECT *, {O.tokens('title')} AS ct, ' ' || array_to_string({O.phrase_words('title')}, ' ') || ' ' AS pw, "
            f"list_transform(authors, lambda a: lower({O.last_name('a')})) AS lasts FROM {catalogue}) c "
            f"ON coalesce(p.a_last, '') <> '' AND p.phrase <> '' AND list_contains(c.lasts, p.a_last) "
            f"AND contains(c.pw, ' ' || p.phrase || ' '){ne}")


def _topk_sql(src: str, k: int = K) -> str:
    return (f"SELECT * FROM (SELECT paper_key, entry_id, sim, CAST(row_number() OVER (PARTITION BY paper_key "
            f"ORDER BY sim DESC, entry_id) AS INTEGER) AS rank FROM ({src})) WHERE rank <= {k}")


def _cascade_sql(papers: str, catalogue: str, self_excl: bool) -> str:
    t = {i: _topk_sql(_tier_sql(i, papers, catalogue, self_excl)) for i in (1, 2, 3)}
    return f"""
  t1 AS ({t[1]}), t2 AS ({t[2]}), t3 AS ({t[3]}),
  allt AS (SELECT *, 1 AS tier FROM t1 UNION ALL SELECT *, 2 FROM t2 UNION ALL SELECT *, 3 FROM t3),
  cascade AS (SELECT * FROM allt QUALIFY tier = min(tier) OVER (PARTITION BY paper_key))"""


DOC_PAPERS_SQL = f"SELECT arxiv_id AS paper_key, * FROM ({O.PAPERS})"


@query("lookup_exact", f"""
WITH p AS ({DOC_PAPERS_SQL}), c AS ({O.CATALOGUE}), t AS ({_topk_sql(_tier_sql(1, 'p', 'c', True))})
SELECT paper_key, entry_id, rank, round(sim, {ROUND}) AS sim FROM t
""")
def q_lookup_exact(spark, sf):
    t = lookup.tier_exact(_doc_papers(spark, sf), _catalogue(spark, sf), K, SELF)
    return t.select("paper_key", "entry_id", "rank", _r(F.col("sim")).alias("sim"))


@query("lookup_stored", f"""
WITH p AS ({DOC_PAPERS_SQL}), c AS ({O.CATALOGUE}), t AS ({_topk_sql(_tier_sql(1, 'p', 'c', False))})
SELECT paper_key, entry_id, rank, round(sim, {ROUND}) AS sim FROM t
""")
def q_lookup_stored(spark, sf):
    """J1 against a catalogue that is read from files and whose keys are stored in buckets."""
    from litsift.session import scratch_path
    from litsift.sources.catalogue import read_catalogue, read_key_table, write_key_table
    path, keys = scratch_path(spark, "catalogue"), scratch_path(spark, "catalogue-keys")
    name = "keys_" + keys.rpartition("-")[2]
    _catalogue(spark, sf).write.parquet(path)
    write_key_table(read_catalogue(spark, path), keys, name, buckets=8)
    t = lookup.tier_exact(_doc_papers(spark, sf), None, K, index=read_key_table(spark, keys, name, buckets=8))
    return t.select("paper_key", "entry_id", "rank", _r(F.col("sim")).alias("sim"))


@query("lookup_tokens", f"""
WITH p AS ({DOC_PAPERS_SQL}), c AS ({O.CATALOGUE}), t AS ({_topk_sql(_tier_sql(2, 'p', 'c', True))})
SELECT paper_key, entry_id, rank, round(sim, {ROUND}) AS sim FROM t
""")
def q_lookup_tokens(spark, sf):
    t = lookup.tier_tokens(_doc_papers(spark, sf), _catalogue(spark, sf), K, SELF)
    return t.select("paper_key", "entry_id", "rank", _r(F.col("sim")).alias("sim"))


@query("lookup_author_phrase", f"""
WITH p AS ({DOC_PAPERS_SQL}), c AS ({O.CATALOGUE}), t AS ({_topk_sql(_tier_sql(3, 'p', 'c', True))})
SELECT paper_key, entry_id, rank, round(sim, {ROUND}) AS sim FROM t
""")
def q_lookup_author_phrase(spark, sf):
    t = lookup.tier_author_phrase(_doc_papers(spark, sf), _catalogue(spark, sf), K, SELF)
    return t.select("paper_key", "entry_id", "rank", _r(F.col("sim")).alias("sim"))


@query("lookup_cascade", f"""
WITH p AS ({DOC_PAPERS_SQL}), c AS ({O.CATALOGUE}),{_cascade_sql('p', 'c', True)}
SELECT paper_key, entry_id, rank, tier, round(sim, {ROUND}) AS sim FROM cascade
""")
def q_lookup_cascade(spark, sf):
    t = lookup.lookup_cascade(_doc_papers(spark, sf), _catalogue(spark, sf), K, SELF)
    return t.select("paper_key", "entry_id", "rank", "tier", _r(F.col("sim")).alias("sim"))


# ---- J4, D3, W1 over titles as pages give them -------------------------------------------------------------
def _text_sql(tag: str) -> str:
    x = f"split_part(split_part(html, '<{tag}>', 2), '</{tag}>', 1)"
    for name, sign in (("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"), ("amp", "'&'")):
        x = f"replace({x}, '&{name};', {sign})"
    return x


PAGE_PAPERS_SQL = f"SELECT CAST(page_id AS VARCHAR) AS paper_key, {_text_sql('h1')} AS title, split_part(url, '/', 3) AS authors FROM pages"
PAGE_CATALOGUE_SQL = (f"SELECT 'catalogue/' || CAST(page_id AS VARCHAR) AS entry_id, CAST(page_id AS VARCHAR) AS doc_key, "
                      f"{_text_sql('title')} AS title, [split_part(url, '/', 3)] AS authors FROM pages")


@query("lookup_pages", f"""
WITH p AS ({PAGE_PAPERS_SQL}), c AS ({PAGE_CATALOGUE_SQL}),{_cascade_sql('p', 'c', True)}
SELECT paper_key, entry_id, rank, tier, round(sim, {ROUND}) AS sim FROM cascade
""")
def q_lookup_pages(spark, sf):
    """Papers are articles by their heading, the catalogue has pages by their title."""
    from litsift.functions import markup
    pages = B.spread(B.table(spark, sf, "pages"))
    host = F.split_part("url", F.lit("/"), F.lit(3))
    papers = extract.extract_articles(pages.select(F.col("page_id").cast("string").alias("paper_key"), host.alias("host"), F.col("html").alias("body_html")),
                                      keep=["paper_key", "host"], heading="h1", title_in_link=False).select("paper_key", "title", F.col("host").alias("authors"))
    parsed = pages.select("page_id", host.alias("host"), F.expr(markup.tokens("html")).alias("tokens"))
    parsed = parsed.selectExpr("*", f"get({markup.elements('tokens', ['title'])}, 0) as el")
    title = F.expr(markup.trim_spaces(markup.text_of(markup.within("tokens", "el"))))
    key = F.col("page_id").cast("string")
    catalogue = parsed.select(F.concat(F.lit("catalogue/"), key).alias("entry_id"), key.alias("doc_key"), title.alias("title"), F.array("host").alias("authors"))
    t = lookup.lookup_cascade(papers, catalogue, K, ("paper_key", "doc_key"))
    return t.select("paper_key", "entry_id", "rank", "tier", _r(F.col("sim")).alias("sim"))


BENCH_PAPERS_SQL = (f"SELECT CAST(item_id AS VARCHAR) AS paper_key, item_id, "
                    f"{O.clean_title(O.first_line('text'))} AS title, '' AS authors FROM benchmark")


def _bench_papers(spark, sf):
    return B.raw_papers_from_benchmark(B.table(spark, sf, "benchmark"))


@query("enrich", f"""
WITH p AS ({BENCH_PAPERS_SQL}), c AS ({O.CATALOGUE}),{_cascade_sql('p', 'c', False)}
SELECT p.paper_key, string_split(c.entry_id, '/')[-1] AS arxiv_id, k.tier,
       md5(replace(c.summary, chr(10), ' ')) AS abstract_md5, c.pdf_url
FROM p JOIN cascade k ON k.paper_key = p.paper_key AND k.rank = 1 JOIN c ON c.entry_id = k.entry_id
""")
def q_enrich(spark, sf):
    e = lookup.enrich(_bench_papers(spark, sf), _catalogue(spark, sf), K)
    return e.select("paper_key", "arxiv_id", "tier", F.md5("abstract").alias("abstract_md5"), "pdf_url")


@query("lookup_misses", f"""
WITH p AS ({BENCH_PAPERS_SQL}), c AS ({O.CATALOGUE}),{_cascade_sql('p', 'c', False)},
  best AS (SELECT p.paper_key, k.tier FROM p LEFT JOIN cascade k ON k.paper_key = p.paper_key AND k.rank = 1)
SELECT CAST(count(*) AS BIGINT) AS n_papers, CAST(count(tier) AS BIGINT) AS n_found,
       CAST(count(*) FILTER (WHERE tier IS NULL) AS BIGINT) AS n_missed,
       CAST(count(*) FILTER (WHERE tier = 1) AS BIGINT) AS n_tier1,
       CAST(count(*) FILTER (WHERE tier = 2) AS BIGINT) AS n_tier2,
       CAST(count(*) FILTER (WHERE tier = 3) AS BIGINT) AS n_tier3
FROM best
""")
def q_lookup_misses(spark, sf):
    p = _bench_papers(spark, sf)
    m = lookup.lookup_cascade(p, _catalogue(spark, sf), K)
    return lookup.lookup_counts(p, m)


# ---- D2 over whole texts ---------------------------------------------------------------------------------
@query("dedup_text", """
SELECT doc_id, md5(text) AS title_md5 FROM documents QUALIFY text IS NULL OR row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1
""")
def q_dedup_text(spark, sf):
    docs = _docs(spark, sf).select("doc_id", F.col("text").alias("title"))
    return dedup.dedup_by_title(docs, order=["doc_id"]).select("doc_id", F.md5("title").alias("title_md5"))


# ---- D1, D2: dedup ----------------------------------------------------------------------------------
@query("dedup_id", f"""
WITH p AS (SELECT page_id,
  nullif(regexp_extract(url, '{PAGE_NUM_RE}', 1), '') || 'v' || CAST(page_id % 2 + 1 AS VARCHAR) AS arxiv_id
  FROM pages)
SELECT page_id, arxiv_id FROM p WHERE arxiv_id IS NULL
UNION ALL
SELECT page_id, arxiv_id FROM p WHERE arxiv_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY regexp_replace(arxiv_id, 'v[0-9]+$', '') ORDER BY page_id) = 1
""")
def q_dedup_id(spark, sf):
    p = B.table(spark, sf, "pages")
    n = F.nullif(F.regexp_extract("url", PAGE_NUM_RE, 1), F.lit(""))
    papers = p.select("page_id", F.concat(n, F.lit("v"), ((F.col("page_id") % 2) + 1).cast("string")).alias("arxiv_id"))
    return dedup.dedup_by_id(papers, order=["page_id"], fallback=["page_id"])


@query("dedup_title", f"""
WITH p AS ({O.PAPERS})
SELECT arxiv_id, title FROM p
QUALIFY row_number() OVER (PARTITION BY title ORDER BY CAST(arxiv_id AS BIGINT)) = 1
""")
def q_dedup_title(spark, sf):
    p = _papers(spark, sf).select("arxiv_id", "title", F.col("arxiv_id").cast("long").alias("ord"))
    return dedup.dedup_by_title(p, order=["ord"]).select("arxiv_id", "title")


# ---- J6, P20-P22: prompts -----------------------------------------------------------------------------
PROMPT_SQL = O.prompt("p.title", "p.authors", "p.categories", "p.abstract", "q.question")


@query("prompts", f"""
WITH p AS ({O.PAPERS}), q AS ({O.QUESTIONS})
SELECT p.arxiv_id, q.question_id, CAST(length({PROMPT_SQL}) AS INTEGER) AS prompt_len,
       md5({PROMPT_SQL}) AS prompt_md5
FROM p CROSS JOIN q
""")
def q_prompts(spark, sf):
    from litsift.functions.prompt import prompt_from_head
    req = score.pair_requests(score.request_heads(_papers(spark, sf)), _questions(spark, sf))
    pr = prompt_from_head()
    return req.select("arxiv_id", "question_id", F.length(pr).alias("prompt_len"), F.md5(pr).alias("prompt_md5"))


# ---- P23-P25: parse answers ------------------------------------------------------------------------------
def _answers_spark(conv: DataFrame) -> DataFrame:
    a = conv.where(F.col("role") == "assistant")
    t = F.col("text")
    n = (F.length(t) % 11).cast("string")
    base = F.concat(F.lit("<explanation>"), t, F.lit("</explanation>\n<score>"), n, F.lit("</score>"))
    v = (F.col("conv_id") + F.col("turn")) % 9
    shown = "<explanation>your reasons</explanation><score>0 to 10</score>\n"
    resp = (F.when(v == 0, base)
            .when(v == 7, F.concat(F.lit(shown + "```xml\n"), base, F.lit("\n```\nDone.")))
            .when(v == 8, F.concat(F.lit("```xml\n"), base))
            .when(v == 1, F.concat(F.lit("```\n"), base, F.lit("\n```")))
            .when(v == 2, F.concat(F.lit("Sure.\n```xml\n"), base, F.lit("\n```")))
            .when(v == 3, F.concat(F.lit("```xml"), base, F.lit("```")))
            .when(v == 4, F.concat(F.lit("<explanation>"), t, F.lit("</explanation>")))
            .when(v == 5, F.concat(F.lit("<explanation>"), t, F.lit("</explanation><score>"), n, F.lit("/10</score>")))
            .otherwise(F.concat(F.lit("<explanation>"), t, F.lit("</explanation><score> "),
                                ((F.length(t) % 11) + 10).cast("string"), F.lit(" </score>"))))
    return a.select("conv_id", "turn", resp.alias("response"))


ANSWERS_SQL = """
SELECT conv_id, turn, CASE (conv_id + turn) % 9
  WHEN 7 THEN '<explanation>your reasons</explanation><score>0 to 10</score>' || chr(10) || '```xml' || chr(10) || b || chr(10) || '```' || chr(10) || 'Done.'
  WHEN 8 THEN '```xml' || chr(10) || b
  WHEN 0 THEN b WHEN 1 THEN '```' || chr(10) || b || chr(10) || '```'
  WHEN 2 THEN 'Sure.' || chr(10) || '```xml' || chr(10) || b || chr(10) || '```'
  WHEN 3 THEN '```xml' || b || '```'
  WHEN 4 THEN '<explanation>' || text || '</explanation>'
  WHEN 5 THEN '<explanation>' || text || '</explanation><score>' || CAST(length(text) % 11 AS VARCHAR) || '/10</score>'
  ELSE '<explanation>' || text || '</explanation><score> ' || CAST(length(text) % 11 + 10 AS VARCHAR) || ' </score>'
  END AS response
FROM (SELECT *, '<explanation>' || text || '</explanation>' || chr(10) || '<score>'
             || CAST(length(text) % 11 AS VARCHAR) || '</score>' AS b
      FROM conversations WHERE role = 'assistant')
"""


def _parse_sql(r: str) -> dict[str, str]:
    from litsift.functions import response as R
    # Between the fences, by positions: the start of the last fence is found from the end.
    last = f"(length({r}) - strpos(reverse({r}), '```') - 1)"
    between = lambda f: (f"substr({r}, strpos({r}, '{f}') + {len(f)}, greatest({last} - strpos({r}, '{f}') - {len(f)}, 0))")
    t = (f"(CASE WHEN strpos({r}, '```xml') > 0 THEN {between('```xml')} "
         f"WHEN strpos({r}, '```') > 0 THEN {between('```')} ELSE {r} END)")
    has = f"(regexp_matches({t}, {O.q(R.EXPLANATION_RE)}) AND regexp_matches({t}, {O.q(R.SCORE_RE)}))"
    st = O.strip(f"regexp_extract({t}, {O.q(R.SCORE_RE)}, 1)")
    num = f"regexp_matches({st}, {O.q(R.NUMBER_RE)})"
    err = (f"(CASE WHEN {r} IS NULL OR NOT {has} THEN {O.q(R.ERR_MISSING)} "
           f"WHEN NOT {num} THEN {O.q(R.ERR_NUMBER)} END)")
    expl = O.strip(f"regexp_extract({t}, {O.q(R.EXPLANATION_RE)}, 1)")
    fallback = (f"'Unparsed answer (' || {err} || '): ' || coalesce(substring({r}, 1, {R.SNIPPET_CHARS}), '') || '...'")
    return {
        "relevance_score": f"(CASE WHEN {err} IS NULL THEN TRY_CAST({st} AS DOUBLE) / 10.0 ELSE 0.0 END)",
        "explanation": f"(CASE WHEN {err} IS NULL THEN {expl} ELSE {fallback} END)",
        "parse_error": err,
        "out_of_range": (f"({err} IS NULL AND (TRY_CAST({st} AS DOUBLE) / 10.0 < 0 "
                         f"OR TRY_CAST({st} AS DOUBLE) / 10.0 > 1))"),
    }


_PS = _parse_sql("response")


@query("parse_responses", f"""
WITH a AS ({ANSWERS_SQL})
SELECT conv_id, turn, round({_PS['relevance_score']}, {ROUND}) AS relevance_score,
       md5({_PS['explanation']}) AS explanation_md5, CAST(length({_PS['explanation']}) AS INTEGER) AS explanation_len,
       {_PS['parse_error']} AS parse_error, {_PS['out_of_range']} AS out_of_range
FROM a
""")
def q_parse_responses(spark, sf):
    from litsift.functions.response import parse_response
    a = _answers_spark(B.table(spark, sf, "conversations"))
    p = parse_response(F.col("response"))
    return a.select("conv_id", "turn", _r(p["relevance_score"]).alias("relevance_score"),
                    F.md5(p["explanation"]).alias("explanation_md5"),
                    F.length(p["explanation"]).alias("explanation_len"), p["parse_error"].alias("parse_error"),
                    p["out_of_range"].alias("out_of_range"))


# ---- F5, J9, P26: stored answers with gaps ---------------------------------------------------------------
MODEL = "gpt-4o-mini"


def _label_answers(spark, sf) -> DataFrame:
    """Answers exist for labelled documents only (the others get error rows)."""
    lab = B.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("arxiv_id"), "quality", "toxic")
    qs = _questions(spark, sf).select("question_id")
    pairs = score.pair_requests(lab, qs)
    s = F.col("quality") * 6 + (F.lit(1) - F.col("toxic")) * 2 + (F.col("question_id") % 3)
    resp = F.concat(F.lit("<explanation>quality "), F.col("quality").cast("string"), F.lit(", toxic "),
                    F.col("toxic").cast("string"), F.lit("</explanation><score>"), s.cast("string"), F.lit("</score>"))
    return pairs.select("arxiv_id", "question_id", F.lit(MODEL).alias("model_key"), resp.alias("response"),
                        F.lit(None).cast("long").alias("prompt_tokens"), F.lit(None).cast("long").alias("completion_tokens"),
                        F.lit(None).cast("long").alias("total_tokens"))


LABEL_SCORES_SQL = f"""
SELECT CAST(d.doc_id AS VARCHAR) AS arxiv_id, q.question_id,
  CASE WHEN l.doc_id IS NULL THEN 0.0::DOUBLE ELSE CAST(l.quality * 6 + (1 - l.toxic) * 2 + q.question_id % 3 AS DOUBLE) / 10.0 END AS relevance_score,
  l.doc_id IS NULL AS error,
  CAST(NULL AS VARCHAR) AS parse_error,
  CASE WHEN l.doc_id IS NULL THEN {O.q(score.ERR_NO_ANSWER)}
       ELSE 'quality ' || CAST(l.quality AS VARCHAR) || ', toxic ' || CAST(l.toxic AS VARCHAR) END AS explanation
FROM documents d CROSS JOIN ({O.QUESTIONS}) q LEFT JOIN labels l ON l.doc_id = d.doc_id
"""


@query("score_errors", f"""
SELECT arxiv_id, question_id, round(relevance_score, {ROUND}) AS relevance_score, error, parse_error, explanation
FROM ({LABEL_SCORES_SQL})
""")
def q_score_errors(spark, sf):
    valid, _rejected = filters.split_valid(_papers(spark, sf))
    req = score.pair_requests(valid.select("arxiv_id", "title"), _questions(spark, sf).select("question_id"))
    s = score.join_responses(req, _label_answers(spark, sf), MODEL)
    return s.select("arxiv_id", "question_id", _r(F.col("relevance_score")).alias("relevance_score"),
                    "error", "parse_error", "explanation")


@query("answer_means", f"""
SELECT arxiv_id, round(avg(relevance_score), {ROUND}) AS score FROM ({LABEL_SCORES_SQL}) GROUP BY arxiv_id
""")
def q_answer_means(spark, sf):
    m = score.answer_means(_papers(spark, sf), _questions(spark, sf), _label_answers(spark, sf), MODEL)
    return m.select("arxiv_id", _r(F.col("score")).alias("score"))


# ---- J7, A2, A3: token usage and cost ------------------------------------------------------------------------
MODEL_CYCLE = ["gpt-4o", "gpt-4o-mini", "claude-3-7-sonnet", "claude-3-5-haiku", "unlisted-model"]


def _models_sql() -> str:
    from litsift.sources.models import MODEL_ROWS
    rows = ", ".join(f"({O.q(r[0])}, {r[6][0]!r}::DOUBLE, {r[6][1]!r}::DOUBLE)" for r in MODEL_ROWS)
    return f"(VALUES {rows}) AS m(model_key, price_in, price_out)"


@query("usage_cost", f"""
WITH calls AS (
  SELECT a.conv_id,
         [{', '.join(O.q(m) for m in MODEL_CYCLE)}][a.conv_id % {len(MODEL_CYCLE)} + 1] AS model_key,
         CAST(length(u.text) AS BIGINT) AS prompt_tokens, CAST(length(a.text) AS BIGINT) AS completion_tokens
  FROM conversations a LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user'
  WHERE a.role = 'assistant'),
g AS (SELECT c.model_key, m.price_in, m.price_out, count(*) AS n_calls,
             sum(coalesce(prompt_tokens, 0)) AS tp, sum(coalesce(completion_tokens, 0)) AS tc,
             sum(coalesce(prompt_tokens + completion_tokens, 0)) AS tt
      FROM calls c LEFT JOIN {_models_sql()} ON m.model_key = c.model_key
      GROUP BY ALL)
SELECT model_key, CAST(n_calls AS BIGINT) AS n_calls, CAST(tp AS BIGINT) AS total_prompt_tokens,
       CAST(tc AS BIGINT) AS total_completion_tokens, CAST(tt AS BIGINT) AS total_tokens,
       round(coalesce(tp * price_in / 1e6 + tc * price_out / 1e6, 0.0), 9) AS estimated_cost
FROM g
""")
def q_usage_cost(spark, sf):
    u = score.token_usage(_calls(spark, sf), models_df(spark), by_model=True)
    return u.select("model_key", "n_calls", "total_prompt_tokens", "total_completion_tokens", "total_tokens",
                    _r(F.col("estimated_cost"), 9).alias("estimated_cost"))


def _calls(spark, sf):
    """Answers as model calls: text lengths as tokens, models in turn."""
    conv = B.table(spark, sf, "conversations")
    a = conv.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("a_text"))
    u = conv.where(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"),
                                                   F.col("text").alias("u_text"))
    cyc = F.array(*[F.lit(m) for m in MODEL_CYCLE])
    return a.join(u, ["conv_id", "turn"], "left").select(
        F.element_at(cyc, (F.col("conv_id") % len(MODEL_CYCLE) + 1).cast("int")).alias("model_key"),
        F.length("u_text").cast("long").alias("prompt_tokens"),
        F.length("a_text").cast("long").alias("completion_tokens"),
        (F.length("u_text") + F.length("a_text")).cast("long").alias("total_tokens"))


@query("usage_total", f"""
WITH calls AS (
  SELECT [{', '.join(O.q(m) for m in MODEL_CYCLE)}][a.conv_id % {len(MODEL_CYCLE)} + 1] AS model_key,
         CAST(length(u.text) AS BIGINT) AS prompt_tokens, CAST(length(a.text) AS BIGINT) AS completion_tokens
  FROM conversations a LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user'
  WHERE a.role = 'assistant')
SELECT count(*) AS n_calls, CAST(sum(coalesce(prompt_tokens, 0)) AS BIGINT) AS total_prompt_tokens,
       CAST(sum(completion_tokens) AS BIGINT) AS total_completion_tokens, CAST(sum(coalesce(prompt_tokens + completion_tokens, 0)) AS BIGINT) AS total_tokens,
       round(sum(coalesce(coalesce(prompt_tokens, 0) * price_in / 1e6 + completion_tokens * price_out / 1e6, 0.0)), {ROUND}) AS estimated_cost
FROM calls c LEFT JOIN {_models_sql()} ON m.model_key = c.model_key
""")
def q_usage_total(spark, sf):
    return score.token_usage(_calls(spark, sf), models_df(spark)).withColumn("estimated_cost", _r(F.col("estimated_cost")))


# ---- A6: last write wins ------------------------------------------------------------------------------------
@query("last_write", """
SELECT user_id, event_type, event_id, value,
       CAST(count(*) OVER (PARTITION BY user_id, event_type) AS BIGINT) AS n_writes
FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
""")
def q_last_write(spark, sf):
    ev = B.table(spark, sf, "events")
    return score.last_write(ev, ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"])


# ---- U2, A1, J8, O1, O2, W2, P27: scoring and ranking ------------------------------------------------------
MEAN_SQL = f"""
  p AS ({O.PAPERS}),
  pt AS (SELECT arxiv_id, {O.tokens("concat_ws(' ', title, abstract)")} AS toks FROM p),
  qt AS (SELECT question_id, {O.tokens('question')} AS qt FROM ({O.QUESTIONS})),
  pair AS (SELECT pt.arxiv_id, CASE WHEN len(qt.qt) = 0 THEN 0
                   ELSE (10 * len(list_intersect(pt.toks, qt.qt))) // len(qt.qt) END AS s
           FROM pt CROSS JOIN qt),
  ms AS (SELECT arxiv_id, CAST(sum(s) AS DOUBLE) / (10.0 * (SELECT count(*) FROM benchmark)) AS score
         FROM pair GROUP BY arxiv_id)"""


def _mean_scores(spark, sf):
    return score.lexical_mean_scores(_papers(spark, sf), _questions(spark, sf))


@query("mean_score", f"""
WITH {MEAN_SQL}
SELECT arxiv_id, round(score, {ROUND}) AS score FROM ms
""")
def q_mean_score(spark, sf):
    return _mean_scores(spark, sf).select("arxiv_id", _r(F.col("score")).alias("score"))


@query("rank_all", f"""
WITH {MEAN_SQL}
SELECT p.arxiv_id, p.title, round(ms.score, {ROUND}) AS score FROM p LEFT JOIN ms USING (arxiv_id)
""")
def q_rank_all(spark, sf):
    r = rank.rank_papers(rank.attach_scores(_papers(spark, sf), _mean_scores(spark, sf)))
    return r.select("arxiv_id", "title", _r(F.col("score")).alias("score"))


@query("rank_stored", f"""
WITH {MEAN_SQL}
SELECT p.arxiv_id, CAST(row_number() OVER (ORDER BY ms.score DESC NULLS LAST, p.arxiv_id) AS INTEGER) AS rank, round(ms.score, {ROUND}) AS score,
       CAST(row_number() OVER (ORDER BY ms.score DESC NULLS LAST, p.arxiv_id) AS BIGINT) AS place_in_file
FROM p LEFT JOIN ms USING (arxiv_id)
""")
def q_rank_stored(spark, sf):
    """The saved list: its ranks, and where each paper stands in the files as they were written."""
    from litsift.operators.common import numbered
    from litsift.session import scratch_path
    from litsift.sources.papers import read_papers, write_papers
    path = scratch_path(spark, "ranked")
    write_papers(rank.rank_papers(rank.attach_scores(_papers(spark, sf).select("arxiv_id"), _mean_scores(spark, sf))), path)
    stored = read_papers(spark, path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return numbered(stored, [F.col("file"), F.col("row")], "place_in_file").select("arxiv_id", "rank", _r(F.col("score")).alias("score"), "place_in_file")


TOP_N = rank.DEFAULT_TOP_N


@query("rank_top10", f"""
WITH {MEAN_SQL}
SELECT CAST(row_number() OVER (ORDER BY ms.score DESC NULLS LAST, p.arxiv_id) AS INTEGER) AS rank,
       p.arxiv_id, p.title, round(ms.score, {ROUND}) AS score, printf('%.2f', ms.score) AS score_str
FROM p LEFT JOIN ms USING (arxiv_id)
ORDER BY ms.score DESC NULLS LAST, p.arxiv_id LIMIT {TOP_N}
""")
def q_rank_top10(spark, sf):
    t = rank.top_of(_papers(spark, sf), _mean_scores(spark, sf), TOP_N)
    return t.select("rank", "arxiv_id", "title", _r(F.col("score")).alias("score"), "score_str")


# ---- S8: show ------------------------------------------------------------------------------------------------
@query("show_papers", f"""
SELECT arxiv_id, title, authors, venue FROM ({O.PAPERS})
""")
def q_show_papers(spark, sf):
    return rank.show_paper(_papers(spark, sf)).select("arxiv_id", "title", "authors", "venue")


# ---- S3: CSV ----------------------------------------------------------------------------------------------------
@query("papers_csv", f"""
SELECT arxiv_id, title, md5(abstract) AS abstract_md5, authors, array_to_string(list_concat(categories, [venue]), ', ') AS categories FROM ({O.PAPERS})
""")
def q_papers_csv(spark, sf):
    """Whole texts with line breaks and quotes, and arrays joined, through CSV files."""
    from litsift.session import scratch_path
    from litsift.sources.papers import write_papers
    path = scratch_path(spark, "papers-csv")
    p = _papers(spark, sf).select("arxiv_id", "title", "authors", F.to_json(F.struct("abstract")).alias("abstract"),
                                  F.concat("categories", F.array("venue")).alias("categories"))
    write_papers(p, path, fmt="csv")
    back = spark.read.option("header", "true").csv(path)
    return back.select("arxiv_id", "title", F.md5(F.get_json_object("abstract", "$.abstract")).alias("abstract_md5"), "authors", "categories")


SHOWN = ["0", "7", "42", "133", "500", "4711", "9999", "no such paper"]


@query("show_by_id", f"""
SELECT arxiv_id, authors, venue, md5(abstract) AS abstract_md5 FROM ({O.PAPERS}) WHERE arxiv_id IN ({', '.join(O.q(i) for i in SHOWN)})
""")
def q_show_by_id(spark, sf):
    """Single papers out of the stored ones, which are sorted by id."""
    from litsift.session import scratch_path
    from litsift.sources.papers import read_papers, write_papers
    path = scratch_path(spark, "papers-by-id")
    write_papers(_papers(spark, sf), path, sorted_by="arxiv_id")
    shown = rank.show_paper(read_papers(spark, path), SHOWN)
    return shown.select("arxiv_id", "authors", "venue", F.md5("abstract").alias("abstract_md5"))


# ---- S1: message files with broken lines --------------------------------------------------------------
@query("message_files", """
SELECT 'page-' || CAST(page_id AS VARCHAR) AS email_id, strlen(html) AS n_bytes, md5(html) AS body_md5, CAST(NULL AS VARCHAR) AS line FROM pages
UNION ALL
SELECT NULL, 0, md5(''), '{"id": "page-' || page_id || '", "payload": {"headers": [' FROM pages WHERE page_id % 10 = 3
UNION ALL
SELECT NULL, 0, md5(''), 'From: page-' || page_id || ' {}' FROM pages WHERE page_id % 10 = 5
UNION ALL
SELECT NULL, 0, md5(''), '{"id": "page-' || page_id || '", "labelIds": "INBOX"}' FROM pages WHERE page_id % 10 = 8
""")
def q_message_files(spark, sf):
    """Every line of the files comes back: messages, and as it stands what is none."""
    from litsift.session import scratch_path
    from litsift.sources.messages import read_messages
    pages = B.table(spark, sf, "pages")
    n, at = F.col("page_id").cast("string"), F.col("page_id") % 10
    good = B.messages_from_pages(pages, None).select(F.to_json(F.struct("*")).alias("value"))
    broken = pages.select(F.when(at == 3, F.concat(F.lit('{"id": "page-'), n, F.lit('", "payload": {"headers": [')))
                          .when(at == 5, F.concat(F.lit("From: page-"), n, F.lit(" {}")))
                          .when(at == 8, F.concat(F.lit('{"id": "page-'), n, F.lit('", "labelIds": "INBOX"}'))).alias("value")).where("value is not null")
    path = scratch_path(spark, "message-files")
    good.unionByName(broken).write.text(path)
    rows = read_messages(spark, path, corrupt="line")
    f = filters.message_fields(rows, keep=["id", "line"])
    body = F.when(F.col("line").isNull(), F.col("body_html")).otherwise(F.lit(""))
    return f.select(F.when(F.col("line").isNull(), F.col("id")).alias("email_id"), F.octet_length(body).cast("long").alias("n_bytes"),
                    F.md5(body).alias("body_md5"), "line")


# ---- S4: typed columns of stored papers ----------------------------------------------------------------
@query("papers_typed", """
WITH e AS (SELECT event_id, ts, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(epoch(date_trunc('second', ts)) AS BIGINT) - CASE WHEN k % 3 = 0 THEN 5400 ELSE 0 END END AS date_epoch,
       CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN CAST(k AS DOUBLE) ELSE value END AS relevance FROM e
""")
def q_papers_typed(spark, sf):
    """Dates with an offset, without a zone, ISO ones and none; numbers, and what is no number."""
    from litsift.sources.papers import to_papers
    e = B.table(spark, sf, "events").withColumn("k", _k())
    k, day = F.col("k"), F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss")
    date = (F.when(k % 11 == 0, F.when(k % 2 == 0, F.lit("some day")))
            .when(k % 3 == 0, F.concat(day, F.lit(" +0130")))
            .when(k % 2 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
            .otherwise(F.concat(day, F.lit(" GMT"))))
    relevance = F.when(k % 7 == 0, F.lit("high")).when(k % 5 == 0, k.cast("string")).otherwise(F.col("value").cast("string"))
    raw = e.select("event_id", F.lit("t").alias("title"), F.lit("a").alias("authors"), date.alias("email_date"), relevance.alias("relevance"))
    return to_papers(raw).select("event_id", F.unix_timestamp("email_date").alias("date_epoch"), "relevance")


# ---- U5, F2, S1: recent papers from mail ------------------------------------------------------------------
NOW = "2024-01-31"
DAYS = 30


@query("recent_papers", f"""
WITH m AS (
  SELECT 'page-' || CAST(p.page_id AS VARCHAR) AS email_id, p.html AS h, e.ts,
         {RFC_SQL.replace('ts', 'e.ts')} AS email_date
  FROM pages p LEFT JOIN events e ON e.event_id = p.page_id
  WHERE contains(lower({SUBJECT_SQL.replace('event_type', 'e.event_type')}), 'scholar alert')
    AND e.ts >= DATE '{NOW}' - INTERVAL {DAYS} DAY AND contains(p.html, '<article')),
{_extract_sql('m')}
SELECT art.email_id, article_pos, {O.clean_title('coalesce(title, {0})'.format("''"))} AS title,
       {O.clean_authors('coalesce(authors, {0})'.format("''"))} AS authors, coalesce(relevance, 0) AS relevance,
       {O.strip("coalesce(venue, '')")} AS venue, coalesce(url, '') AS url, m.email_date,
       CAST(NULL AS VARCHAR) AS arxiv_id, CAST(epoch(date_trunc('second', m.ts)) AS BIGINT) AS date_epoch
FROM art JOIN m USING (email_id)
""")
def q_recent_papers(spark, sf):
    from litsift.plans.triage import recent_papers
    msgs = B.messages_from_pages(B.table(spark, sf, "pages"), B.table(spark, sf, "events"))
    p = recent_papers(msgs, now=NOW, days=DAYS, marker="<article", heading="h1", title_in_link=False)
    return p.select("email_id", "article_pos", "title", "authors", "relevance", "venue", "url", "email_date",
                    "arxiv_id", F.unix_timestamp("date").alias("date_epoch"))


# ---- U1: model function per partition ---------------------------------------------------------------------
class LengthScorer:
    """Deterministic stand-in for a remote model: the answer's score is the prompt length
    mod 11, so the mapInArrow path (prompt in, parsed answer out) is checked end to end."""

    def analyze_batch(self, prompts, model_id, max_tokens):
        import pandas as pd
        n = prompts.str.len()
        return pd.DataFrame({
            "response": "<explanation>prompt of " + n.astype(str) + " characters</explanation>\n<score>"
                        + (n % 11).astype(str) + "</score>",
            "prompt_tokens": n // 4, "completion_tokens": 16, "total_tokens": n // 4 + 16,
        })


@query("score_udf", f"""
WITH p AS ({O.PAPERS}), q AS ({O.QUESTIONS})
SELECT p.arxiv_id, round(avg(CAST(length({PROMPT_SQL}) % 11 AS DOUBLE) / 10.0), {ROUND}) AS score
FROM p CROSS JOIN q GROUP BY p.arxiv_id
""")
def q_score_udf(spark, sf):
    req = score.pair_requests(score.request_heads(_papers(spark, sf)), score.asked_together(_questions(spark, sf)))
    s = score.score_with(req, LengthScorer, MODEL)
    return score.mean_score(s).select("arxiv_id", _r(F.col("score")).alias("score"))


# ---- S2-S4: store and reload ----------------------------------------------------------------------------------
@query("papers_roundtrip", f"""
SELECT arxiv_id, title, authors, venue, array_to_string(categories, ',') AS categories FROM ({O.PAPERS})
""")
def q_papers_roundtrip(spark, sf):
    from litsift.session import scratch_path
    from litsift.sources.papers import read_papers, to_papers, write_papers
    path = scratch_path(spark, "papers")
    write_papers(to_papers(_papers(spark, sf)), path)
    back = read_papers(spark, path)
    return back.select("arxiv_id", "title", "authors", "venue",
                       F.array_join("categories", ",").alias("categories"))


# ---- U3, U4: the whole triage run ------------------------------------------------------------------------------
TRIAGE_PAIRS_SQL = f"""
WITH p AS ({BENCH_PAPERS_SQL}), c AS ({O.CATALOGUE}),{_cascade_sql('p', 'c', False)},
  enr AS (SELECT p.paper_key, p.title, replace(c.summary, chr(10), ' ') AS abstract,
                 string_split(c.entry_id, '/')[-1] AS arxiv_id
          FROM p JOIN cascade k ON k.paper_key = p.paper_key AND k.rank = 1 JOIN c ON c.entry_id = k.entry_id),
  pap AS (SELECT * FROM enr QUALIFY row_number() OVER (PARTITION BY arxiv_id ORDER BY paper_key) = 1),
  pt AS (SELECT arxiv_id, {O.tokens("concat_ws(' ', title, abstract)")} AS toks FROM pap),
  qt AS (SELECT question_id, {O.tokens('question')} AS qt FROM ({O.QUESTIONS})),
  pair AS (SELECT pt.arxiv_id, qt.question_id, CASE WHEN len(qt.qt) = 0 THEN 0
                   ELSE (10 * len(list_intersect(pt.toks, qt.qt))) // len(qt.qt) END AS s
           FROM pt CROSS JOIN qt)
"""
TRIAGE_SQL = TRIAGE_PAIRS_SQL + f""",
  ms AS (SELECT arxiv_id, CAST(sum(s) AS DOUBLE) / (10.0 * (SELECT count(*) FROM benchmark)) AS score
         FROM pair GROUP BY arxiv_id)
SELECT CAST(row_number() OVER (ORDER BY ms.score DESC NULLS LAST, pap.arxiv_id) AS INTEGER) AS rank,
       pap.arxiv_id, pap.paper_key, round(ms.score, {ROUND}) AS score, printf('%.2f', ms.score) AS score_str
FROM pap LEFT JOIN ms USING (arxiv_id)
ORDER BY ms.score DESC NULLS LAST, pap.arxiv_id
"""


def _triage(spark, sf):
    from litsift.plans.triage import triage
    return triage(_bench_papers(spark, sf), _catalogue(spark, sf), _questions(spark, sf), n=TOP_N, dedup_order=["paper_key"])


@query("triage", TRIAGE_SQL + f" LIMIT {TOP_N}")
def q_triage(spark, sf):
    return _triage(spark, sf).top.select("rank", "arxiv_id", "paper_key", _r(F.col("score")).alias("score"), "score_str")


@query("triage_ranked", TRIAGE_SQL)
def q_triage_ranked(spark, sf):
    r = _triage(spark, sf).ranked
    return r.select("rank", "arxiv_id", "paper_key", _r(F.col("score")).alias("score"), format_score("score").alias("score_str"))


@query("triage_scores", TRIAGE_PAIRS_SQL + f"SELECT arxiv_id, question_id, round(s / 10.0, {ROUND}) AS relevance_score FROM pair")
def q_triage_scores(spark, sf):
    return _triage(spark, sf).scores.select("arxiv_id", "question_id", _r(F.col("relevance_score")).alias("relevance_score"))


@query("triage_usage", TRIAGE_PAIRS_SQL + """SELECT count(*)::BIGINT AS n_calls, 0::BIGINT AS total_prompt_tokens,
  0::BIGINT AS total_completion_tokens, 0::BIGINT AS total_tokens, 0.0::DOUBLE AS estimated_cost FROM pair""")
def q_triage_usage(spark, sf):
    return _triage(spark, sf).usage.select("n_calls", "total_prompt_tokens", "total_completion_tokens", "total_tokens", "estimated_cost")


# ---- X1, D4: incremental ingest ---------------------------------------------------------------------------------
@query("incremental", f"""
WITH m AS (SELECT 'page-' || CAST(page_id AS VARCHAR) AS email_id, html AS h FROM pages
           WHERE contains(html, '<article')),
{_extract_sql('m')}
SELECT email_id, article_pos, {O.clean_title('coalesce(title, {0})'.format("''"))} AS title,
       {O.clean_authors('coalesce(authors, {0})'.format("''"))} AS authors, coalesce(url, '') AS url
FROM art
""")
def q_incremental(spark, sf):
    from litsift.plans.triage import recent_papers
    from litsift.session import scratch_path
    from litsift.streaming.incremental import ingest_incremental, read_ingested
    base = scratch_path(spark, "incremental")
    msgs = B.messages_from_pages(B.table(spark, sf, "pages"), B.table(spark, sf, "events"))
    # Every message arrives once, then the odd pages arrive a second time in later files.
    msgs.write.json(f"{base}/source/first")
    msgs.where(F.col("payload.parts").isNotNull()).write.json(f"{base}/source/again")

    def to_papers(batch):
        return recent_papers(batch, since="1970-01-01", needle="", marker="<article",
                             heading="h1", title_in_link=False)

    ingest_incremental(spark, f"{base}/source/*", f"{base}/sink", f"{base}/checkpoint", to_papers,
                       files_per_batch=4)
    out = read_ingested(spark, f"{base}/sink")
    return out.select("email_id", "article_pos", "title", "authors", "url")


@query("incremental_stateful", QUERIES["incremental"][1])
def q_incremental_stateful(spark, sf):
    from litsift.plans.triage import recent_papers
    from litsift.session import scratch_path
    from litsift.streaming.incremental import ingest_incremental_stateful
    base = scratch_path(spark, "incremental-state")
    msgs = B.messages_from_pages(B.table(spark, sf, "pages"), B.table(spark, sf, "events"))
    # Every message arrives once, then the odd pages arrive a second time in later files.
    msgs.write.json(f"{base}/source/first")
    msgs.where(F.col("payload.parts").isNotNull()).write.json(f"{base}/source/again")

    def to_papers(batch):
        return recent_papers(batch, since="1970-01-01", needle="", marker="<article",
                             heading="h1", title_in_link=False)

    ingest_incremental_stateful(spark, f"{base}/source/*", f"{base}/sink", f"{base}/checkpoint", to_papers,
                                files_per_batch=4)
    out = spark.read.parquet(f"{base}/sink")
    return out.select("email_id", "article_pos", "title", "authors", "url")
