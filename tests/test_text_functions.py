"""Scalar text, id and answer functions."""

from pyspark.sql import functions as F

from litsift.functions import mail, response, text


def one(spark, col, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(col(F.col("x")).alias("y")).first().y


def test_key_phrase_reference_case(spark):
    assert one(spark, text.key_phrase, "Deep Learning: A Comprehensive Survey") == "Deep Learning"
    assert one(spark, text.key_phrase, "The Art of War") == "Art War"
    assert one(spark, text.key_phrase, "a the of") == ""
    assert one(spark, text.key_phrase, "-- Graph !! networks") == "Graph networks"   # punctuation-only word dropped
    assert one(spark, text.key_phrase, "Single") == "Single"


def test_last_name(spark):
    assert one(spark, text.last_name, "Smith, John") == "Smith"
    assert one(spark, text.last_name, "Mara Lindqvist") == "Lindqvist"
    assert one(spark, text.last_name, "") == ""


def test_split_authors(spark):
    assert one(spark, text.split_authors, "Mara Lindqvist, Teo Okafor") == ["Mara Lindqvist", "Teo Okafor"]
    assert one(spark, text.split_authors, "") == [""]


def test_truncate_abstract_boundary(spark):
    assert one(spark, text.truncate_abstract, "x" * 2000) == "x" * 2000
    t = one(spark, text.truncate_abstract, "y" * 2001)
    assert len(t) == 2000 and t.endswith("y...")


def test_categories_and_format(spark):
    assert one(spark, text.categories_str, ["cs.LG", "cs.AI"], "array<string>") == "cs.LG, cs.AI"
    assert one(spark, text.categories_str, [], "array<string>") == "Not specified"
    assert one(spark, text.categories_str, None, "array<string>") == "Not specified"
    assert one(spark, text.format_score, 0.125, "double") == "0.12"
    assert one(spark, text.format_score, 0.7251, "double") == "0.73"


def test_tokens_and_norm_title(spark):
    assert sorted(one(spark, text.tokens, "The Über-Model, of 2 Models!")) == ["2", "model", "models", "über"]
    assert one(spark, text.norm_title, "  Deep--Learning:  A Survey ") == "deep learning a survey"


def test_rfc2822(spark):
    f = lambda v: one(spark, mail.parse_rfc2822, v)
    assert str(f("Fri, 01 Jan 2021 00:00:00 +0000")) == "2021-01-01 00:00:00"
    assert str(f("Fri, 01 Jan 2021 00:00:00 +0130")) == "2020-12-31 22:30:00"
    assert str(f("1 Jan 2021 00:00:00 GMT")) == "2021-01-01 00:00:00"
    assert str(f("Fri, 1 Jan 2021 00:00:00 +0000 (UTC)")) == "2021-01-01 00:00:00"
    assert f("garbage") is None


def test_ids(spark):
    assert one(spark, mail.arxiv_id_from_url, "https://arxiv.org/abs/2201.12345v3") == "2201.12345"
    assert one(spark, mail.arxiv_id_from_url, "https://arxiv.org/pdf/2201.12345") is None
    assert one(spark, mail.arxiv_id_from_url, "https://example.com/abs/2201.12345") is None
    assert one(spark, mail.entry_id_tail, "http://arxiv.org/abs/2201.12345v2") == "2201.12345v2"
    assert one(spark, mail.arxiv_id_base, "2201.12345v2") == "2201.12345"


def test_b64url_roundtrip(spark):
    s = "héllo?>> ~~ <article>"
    assert one(spark, lambda c: mail.decode_b64url(mail.encode_b64url(c)), s) == s


ANSWERS = [
    ("plain", "<explanation>Good fit.</explanation>\n<score>8</score>", 0.8, "Good fit.", None),
    ("fence", "```\n<explanation>E</explanation><score>7</score>\n```", 0.7, "E", None),
    ("xml", "```xml\n<explanation>E</explanation><score>6</score>\n```", 0.6, "E", None),
    ("xmlnl", "```xml<explanation>E</explanation><score>6</score>```", 0.6, "E", None),
    ("noscore", "<explanation>E</explanation>", 0.0, None, response.ERR_MISSING),
    ("frac", "<explanation>E</explanation><score>8/10</score>", 0.0, None, response.ERR_NUMBER),
    ("big", "<explanation>E</explanation><score>15</score>", 1.5, "E", None),
    ("neg", "<explanation>E</explanation><score>-3</score>", -0.3, "E", None),
    ("nan", "<explanation>E</explanation><score>nan</score>", 0.0, None, response.ERR_NUMBER),
    ("multi", "<explanation>line 1\nline 2</explanation><score> 9 </score>", 0.9, "line 1\nline 2", None),
    ("two", "<explanation>A</explanation><score>3</score><explanation>B</explanation><score>4</score>",
     0.3, "A", None),
]


def test_parse_response(spark):
    df = spark.createDataFrame([(a, b) for a, b, *_ in ANSWERS], "k string, r string")
    p = response.parse_response(F.col("r"))
    got = {r.k: r for r in df.select("k", p["relevance_score"].alias("s"), p["explanation"].alias("e"),
                                    p["parse_error"].alias("err"), p["out_of_range"].alias("oor")).collect()}
    assert got["big"].oor and got["neg"].oor and not got["plain"].oor and not got["nan"].oor
    for k, _, s, e, err in ANSWERS:
        assert abs(got[k].s - s) < 1e-12, k
        assert got[k].err == err, k
        if e is not None:
            assert got[k].e == e, k
        else:
            assert got[k].e.startswith("Unparsed answer"), k
