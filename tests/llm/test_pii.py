"""Base finds against the contract's patterns as they stand, disguises by cases, the map back to the source by its parts."""

import hashlib
import random
import re
import time

import pytest

import __spark_entry__ as E
from litsift.llm import pii

DOCS = "doc_id long, text string, lang string"
# The contract's patterns.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x // 10 + x % 10
    return total % 10 == 0


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return {"email": True, "ip": all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split(".")) if kind == "ip" else None,
            "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m.group())]


def base(text):
    return [(pii.KINDS[k], s, e) for k, s, e, b, _ in pii.find(text) if b]


def added(text):
    return [(pii.KINDS[k], text[s:e], v) for k, s, e, b, v in pii.find(text) if not b]


@pytest.mark.parametrize("signs", ["ab1.@", "aé@.-% ", "0125.", "0123456789 -", "+0123456789 ().-", "4 -", "a@b.c1+-() 25,é🙂"])
def test_base_finds_are_those_of_the_patterns(signs):
    rng = random.Random(signs)
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(60)))
        assert base(text) == brute(text), text


def test_base_finds_of_the_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in rows}
    for r in E.queries()["op12_pii"](spark, "/root/testdata/sf0.01").collect():
        want = brute(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in want) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans == joined


HIDING = [
    ("email", "jоhn＠exаmple．com", "john@example.com"),
    ("email", "j​ohn@exam­ple.com", "john@example.com"),
    ("email", "john [at] example [dot] com", "john@example.com"),
    ("email", "john(at)example(dot)com", "john@example.com"),
    ("email", "john { AT } example < Dot > com", "john@example.com"),
    ("email", "john dot smith at example dot co dot uk", "john.smith@example.co.uk"),
    ("email", "first dot last [at] gmail dot com", "first.last@gmail.com"),
    ("email", "ea.54 at mail3.example.com", "ea.54@mail3.example.com"),
    ("email", "user @ host.example.org", "user@host.example.org"),
    ("email", "pepe arroba ejemplo punto es", "pepe@ejemplo.es"),
    ("email", "x@y dot com", "x@y.com"),
    ("phone", "plus one five five five one two three four five six seven", "+15551234567"),
    ("phone", "＋１ (７４３) ５５５-３８２４", "+1 (743) 555-3824"),
    ("phone", "+1 743 five five five three eight two four", "+1 743 5553824"),
    ("card", "four one one one " + "one " * 11 + "one", "4111111111111111"),
    ("card", "four triple one 1111 1111 1111", "4111 1111 1111 1111"),
    ("card", "4111​1111 1111‐1111", "41111111 1111-1111"),
    ("email", "john&#64;example&#46;com", "john@example.com"),
    ("email", "john%40example.com", "john@example.com"),
    ("email", "john@ example.com", "john@example.com"),
    ("email", "john_at_example_dot_com", "john@example.com"),
    ("email", "j.doe @ example . com", "j.doe@example.com"),
    ("phone", "plus one (five five five) one two three four five six seven", "+1 (555) 1234567"),
    ("phone", "+1 (743) 555-38O4", "+1 (743) 555-3804"),
    ("card", "4ll1 1111 1lll 1111", "4111 1111 1111 1111"),
    ("ip", "10 . 0 . 0 . 7", "10.0.0.7"),
    ("ip", "one nine two dot one six eight dot one dot one", "192.168.1.1"),
    ("ip", "192 dot 168 dot 1 dot one", "192.168.1.1"),
    ("ip", "10[.]0[.]0[.]7", "10.0.0.7"),
    ("ip", "١٩٢.١٦٨.١.١", "192.168.1.1"),
]


@pytest.mark.parametrize("kind,hidden,plain", HIDING)
def test_disguises_are_found_where_they_stand(kind, hidden, plain):
    for before, after in (("", ""), ("Éà 🙂, ", "! und"), ("see: ", "\nfour cats"), ("4994226020900891 / ", ", a@b.example")):
        text = before + hidden + after
        assert (kind, hidden, plain) in added(text)
        assert base(text) == brute(text)


@pytest.mark.parametrize("text", [
    "look at example.com", "meet us at noon dot", "one at a time. Two dot three", "un 4994226020900891 deux", "I bought two or three (at) home.",
    "Étion dans, çouelle un éonierç le ch trement", "at dot at dot at", "x² + y² — 50 % at 3.5", "zero one", "плюс один", "Oh no. I see l0 of 10 . Then", "snake_at_case and do_dot_it",
    "&amp; &#46; %40 of all", "write x@example . Then go", "she is at home . com"])
def test_prose_stays_as_it_is(text):
    assert added(text) == []


def test_finds_map_back_to_what_stands_for_them():
    rng = random.Random(2)
    parts = [h for _, h, _ in HIDING] + ["word", "é", "🙂", "at", "dot", "12", "five", ".", "a@b.de"]
    for _ in range(300):
        text = " ; ".join(rng.choice(parts) for _ in range(12))
        for k, s, e, was_base, value in pii.find(text):
            again = pii.Traced(text[s:e])
            for step in pii.CHAIN:
                again.rewrite(list(step(again.text)))
            assert again.text == value or was_base or value in again.text


@pytest.mark.parametrize("part", ["a", "1", " ", "a.b@", "one ", "a dot ", "+1", "1.", " at a", "(at", "plus ", "@a dot ", "٣", "1 dot ", "one dot ", "O0l", "_at_", "%40a", "@ a", "a . ", "1 . "])
def test_time_grows_with_the_length(part):
    def took(n):
        text = part * (n // len(part)) + "@x.com"
        t = time.process_time()
        pii.find(text)
        return time.process_time() - t

    assert took(200_000) < 8 * took(50_000) + 0.3


def test_rows_of_all_kinds(spark):
    rows = [(1, "a@b.de", "en"), (1, "a@b.de", "en"), (2, None, None), (3, "", "x"), (None, "10.0.0.7", None), (4, "x" * 3_000_000 + " a [at] b.de", "en"), (5, "b [at] c.de, a@b.de", "en")]
    want = [(1, "email:0:6"), (1, "email:0:6"), (2, ""), (3, ""), (None, "ip:0:8"), (4, "email:3000001:3000012"), (5, "email:0:11,email:13:19")]
    plain = spark.createDataFrame(rows, DOCS)
    clashing = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], DOCS + ", spans long, kind long, start long, base long")
    for df in (plain, clashing, plain.repartition(3)):
        out = pii.digests(pii.find_personal_data(df)).collect()
        assert sorted(((r.doc_id, r.spans) for r in out), key=repr) == sorted(want, key=repr)
    assert [r.n_email for r in out if r.doc_id == 5] == [1]
    assert pii.digests(pii.find_personal_data(plain.limit(0))).count() == 0
