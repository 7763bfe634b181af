"""Messages -> papers: headers, body decode, article extraction."""

import datetime as dt

from pyspark.sql import functions as F

from fixtures import DIGEST_HTML, b64url, message
from litsift.operators import extract, filters
from litsift.plans.triage import recent_papers
from litsift.schemas import MESSAGE


def _fields(spark, msgs):
    return filters.message_fields(spark.createDataFrame(msgs, MESSAGE))


def test_articles_of_a_digest(spark):
    rows = extract.extract_articles(filters.filter_marker(_fields(spark, [message()]))).orderBy("article_pos").collect()
    assert [(r.title, r.authors, r.relevance, r.venue, r.url) for r in rows] == [
        ("Glacier melt & runoff", "I. Haugen, Y. Batbayar, O. Nwosu", 93, "Geophysical Letters, 2023", "https://arxiv.org/abs/2305.01234v3"),
        ("Columnar basaltcooling", "S. Quispe", 41, None, "https://papers.example.net/basalt?v=2&f=pdf"),
        (None, "The editors", 0, None, None)]
    assert {(r.email_id, r.email_date, r.email_subject, r.email_sender) for r in rows} == {
        ("inbox-7f", "Tue, 09 May 2023 06:45:10 +0200", "Your weekly Scholar Alert: 3 new papers", "digest@mail.example.net")}


def test_headers_last_duplicate_wins_and_defaults(spark):
    m1 = message("a", headers=[("Subject", "first"), ("Subject", "second")])
    m2 = message("b", headers=[])
    rows = {r.email_id: r for r in _fields(spark, [m1, m2]).collect()}
    assert rows["a"].email_subject == "second"
    assert rows["a"].email_sender == "No From"
    assert rows["b"].email_subject == "No Subject"
    assert rows["b"].email_date == ""
    assert rows["b"].email_ts is None


def test_time_of_receipt_wins_over_the_date_header(spark):
    day = dt.datetime(2021, 3, 4, 5, 6, 7)
    msgs = [message("both", received="1614834367000"), message("none", headers=[], received="1614834367000"),
            message("odd", received="soon")]
    got = {r.email_id: r.email_ts for r in _fields(spark, msgs).collect()}
    assert got == {"both": day, "none": day, "odd": dt.datetime(2023, 5, 9, 4, 45, 10)}


def test_date_forms(spark):
    from litsift.functions.mail import parse_rfc2822
    day = dt.datetime(2024, 5, 1, 10, 30, 5)
    forms = {"Wed, 01 May 2024 10:30:05 +0000": day, "Wednesday, 1 May 2024 10:30:05 GMT": day,
             "Wed 01 May 2024 10:30:05 +0000": day, "01 May 24 10:30:05 +0000": day, "Wed,1 May 2024 12:30:05 +0200": day,
             "Wed, 01 May 2024 10:30:05": day, "Wed, 01 May 2024 10:30 +0000": day.replace(second=0),
             "1 May 2024 10:30": day.replace(second=0), "1 May 99 10:30:05 +0000": day.replace(year=1999),
             "May": None, "": None}
    rows = spark.createDataFrame([(k,) for k in forms], "s string").select("s", parse_rfc2822("s").alias("t")).collect()
    assert {r.s: r.t for r in rows} == forms


def test_answers_are_read_between_fences(spark):
    from litsift.functions.response import parse_response
    real = "<explanation>because</explanation><score>8</score>"
    shown = "<explanation>why</explanation><score>N</score>"
    forms = {real: 0.8, f"{shown}\n```xml\n{real}\n```": 0.8, f"```\n{real}\n``` end": 0.8, f"```xml{real}```": 0.8,
             f"```xml\n{real}": None, f"```{real}": None, f"``` a\n```xml\n{real}": None, "````": None}
    p = parse_response(F.col("s"))
    rows = spark.createDataFrame([(k,) for k in forms], "s string") \
        .select("s", p["relevance_score"].alias("v"), p["parse_error"].alias("e")).collect()
    assert {r.s: (r.v if r.e is None else None) for r in rows} == forms


def test_multipart_last_html_part_wins(spark):
    parts = [{"mimeType": "text/html", "body": {"data": b64url("<p>one</p>")}},
             {"mimeType": "text/plain", "body": {"data": b64url("plain")}},
             {"mimeType": "text/html", "body": {"data": b64url("<p>two</p>")}},
             {"mimeType": "text/html", "body": {"data": None}}]
    m = message("m", body=False, parts=parts)
    assert _fields(spark, [m]).first().body_html == "<p>two</p>"


def test_body_wins_over_parts_and_bad_base64(spark):
    parts = [{"mimeType": "text/html", "body": {"data": b64url("<p>part</p>")}}]
    m1 = message("m1", html="<p>body</p>", parts=parts)
    m2 = message("m2")
    m2["payload"]["body"]["data"] = "%%%not base64%%%"
    rows = {r.email_id: r for r in _fields(spark, [m1, m2]).collect()}
    assert rows["m1"].body_html == "<p>body</p>"
    assert rows["m2"].body_html == "" and rows["m2"].decode_error


ARTICLE = """<article><h2><a href="https://arxiv.org/abs/2201.12345v2">T{i} &amp; more</a></h2>
<p>A{i}, B{i}</p><span>Relevance: {rel}</span>
<div style="color:red">no</div><div style="display:inline;float:right;">V{i}</div></article>"""


def test_many_articles_and_field_edge_cases(spark):
    five = "<div class='scholar-inbox.com'>" + "".join(ARTICLE.format(i=i, rel=10 * i) for i in range(5)) + "</div>"
    odd = ("<div>scholar-inbox.com<article><h3>no h2</h3><p>only authors</p><span>Relevance: 80%</span>"
           "</article><article><h2>no link</h2><span><b>Relevance: 5</b></span></article></div>")
    msgs = [message("five", html=five), message("odd", html=odd),
            message("none", html="<div>scholar-inbox.com</div>"),
            message("nomark", html=DIGEST_HTML.replace("scholar-inbox.com", "x"))]
    rows = extract.extract_articles(filters.filter_marker(_fields(spark, msgs))) \
        .orderBy("email_id", "article_pos").collect()
    five_rows = [r for r in rows if r.email_id == "five"]
    assert [r.article_pos for r in five_rows] == [0, 1, 2, 3, 4]
    assert five_rows[3].title == "T3 & more" and five_rows[3].relevance == 30
    assert five_rows[3].venue == "V3" and five_rows[3].authors == "A3, B3"
    odd_rows = [r for r in rows if r.email_id == "odd"]
    assert len(odd_rows) == 2
    assert odd_rows[0].title is None and odd_rows[0].url is None
    assert odd_rows[0].relevance == 0            # "80%" is not an int
    assert odd_rows[1].title is None             # heading without a link
    assert odd_rows[1].relevance == 5            # the span's one string, wrapped
    assert not [r for r in rows if r.email_id in ("none", "nomark")]


def test_clean_papers(spark):
    raw = spark.createDataFrame(
        [("  Deep    Title\nPart 2 ", "One\nTwo", None, " V ", "https://arxiv.org/abs/2201.12345v2", "e",
          "Fri, 01 Jan 2021 00:00:00 +0130 (UTC)"),
         (None, None, 7, None, "https://example.com/x", "f", "garbage")],
        "title string, authors string, relevance int, venue string, url string, email_id string, email_date string")
    r = {x.email_id: x for x in extract.clean_papers(raw).collect()}
    assert r["e"].title == "Deep  Title Part 2"     # one pass of double -> single space
    assert r["e"].authors == "One, Two"
    assert r["e"].relevance == 0 and r["e"].venue == "V"
    assert r["e"].arxiv_id == "2201.12345"
    assert r["e"].date == dt.datetime(2020, 12, 31, 22, 30)
    assert r["f"].title == "" and r["f"].date is None and r["f"].arxiv_id is None


def test_filter_digests_since_inclusive_and_case(spark):
    df = spark.createDataFrame(
        [("a", "scholar ALERT digest", dt.datetime(2024, 1, 15, 0, 0)),
         ("b", "Scholar Alert", dt.datetime(2024, 1, 14, 23, 59)),
         ("c", "newsletter", dt.datetime(2024, 2, 1)),
         ("d", None, dt.datetime(2024, 2, 1))],
        "email_id string, email_subject string, email_ts timestamp")
    kept = [r.email_id for r in filters.filter_digests(df, since="2024-01-15").collect()]
    assert kept == ["a"]
    c = filters.digest_counts(df, since="2024-01-15").first()
    assert (c.n_messages, c.n_digests) == (4, 1)


def test_default_since(spark):
    d = spark.range(1).select(filters.default_since("2024-01-31", 30).alias("d")).first().d
    assert d == dt.date(2024, 1, 1)


def test_recent_papers_end_to_end(spark):
    old = message("old", headers=[("Subject", "Scholar Alert Digest"), ("Date", "Mon, 01 Jan 2018 00:00:00 +0000")])
    other = message("other", headers=[("Subject", "Invoice"), ("Date", "Tue, 09 May 2023 08:00:00 +0000")])
    msgs = spark.createDataFrame([message(), old, other], MESSAGE)
    out = recent_papers(msgs, now="2023-05-20", days=30).orderBy("article_pos").collect()
    assert [(r.email_id, r.title, r.arxiv_id) for r in out] == [
        ("inbox-7f", "Glacier melt & runoff", "2305.01234"), ("inbox-7f", "Columnar basaltcooling", None), ("inbox-7f", "", None)]


def test_stored_messages_prune_by_day(spark):
    from litsift.session import scratch_path
    from litsift.sources.messages import read_stored_messages, write_messages
    msgs = [message("a", headers=[("Subject", "Scholar Alert Digest"), ("Date", "Fri, 01 Jan 2021 10:00:00 +0000")]),
            message("b", headers=[("Subject", "Scholar Alert Digest"), ("Date", "Sun, 10 Jan 2021 23:30:00 -0100")]),
            message("c", headers=[("Subject", "Invoice"), ("Date", "Sun, 10 Jan 2021 10:00:00 +0000")])]
    path = scratch_path(spark, "t-messages")
    write_messages(spark.createDataFrame(msgs, MESSAGE), path)
    stored = read_stored_messages(spark, path)
    kept = filters.filter_digests(stored, since="2021-01-05")
    assert [r.id for r in kept.collect()] == ["b"]              # 23:30 -0100 is 11 Jan UTC
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(email_ts" in plan
    papers = recent_papers(stored.select(*[c for c in stored.columns if c in MESSAGE.fieldNames()]),
                           since="2021-01-01")
    assert papers.count() == 2 * 3  # articles of two digests
