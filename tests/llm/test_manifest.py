"""The Merkle manifest against a plain tree in Python and against its SQL."""

import hashlib
import zlib

import duckdb
import pytest

from litsift.llm import merkle
from litsift.llm.queries import OP11_SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = "part string, path string, h string, node string, pos long, size long, shown string, block long, slot long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i:i + fanout]) for i in range(0, len(last), fanout)])
    return levels


def path(levels, at, fanout):
    out = []
    for nodes in levels[:-1]:
        first = at - at % fanout
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1:first + fanout])))
        at //= fanout
    return out


def brute(rows, fanout=2):
    leaves = {}
    for i, text, lang, source, n in rows:
        leaf = H(field(i), field(source), field(lang), field(n), field(text))
        hit = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
        shown = H(field(i), field(source), field(lang), field(n + 1), field(text)) if hit else leaf
        leaves.setdefault(lang, []).append((i is not None, i or 0, leaf, shown))
    langs = sorted(leaves, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: tree([x[2] for x in sorted(leaves[k])], fanout) for k in langs}
    crown = tree([trees[k][-1][0] for k in langs], fanout)
    out = []
    for k in langs:
        for at, (known, i, leaf, node) in enumerate(sorted(leaves[k])):
            steps = path(trees[k], at, fanout) + path(crown, langs.index(k), fanout)
            for left, right in steps:
                node = H(left, node, right)
            out.append((i if known else None, leaf, trees[k][-1][0], crown[-1][0], H(*[a + b for a, b in steps]), node, node == crown[-1][0]))
    return sorted(out, key=repr)


def rows_of(n):
    langs = ["en", "de", None, "", "é", "z", "en", "en"]
    rows = [(i * 3 - 7, f"text {i} ü", langs[i % 8], "s" if i % 3 else None, i if i % 5 else None) for i in range(n)]
    return [*rows, (None, "no id", "en", "s", 4), (None, None, None, None, None), (None, None, "lone", None, 9), (5, "again", "en", "s", 1),
            *[(14, "same row", "en", "s", 2)] * 5, (21, "x" * 200_000, "de", "s", 200_000)]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("fanout,levels", [(2, 4), (2, 1), (3, 2)])
def test_manifest_is_that_of_a_plain_tree(spark, fanout, levels):
    rows = rows_of(70)
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    found = got(merkle.verify(merkle.manifest(df, fanout, levels)))
    assert found == brute(rows, fanout)
    assert {r[-1] for r in found} == {True, False}


def test_manifest_of_small_and_empty_tables(spark):
    for rows in ([], rows_of(0)[:1], rows_of(0)[:3], rows_of(2)[:2]):
        assert got(merkle.verify(merkle.manifest(spark.createDataFrame(rows, DOCS)))) == brute(rows)


def test_manifest_with_clashing_names(spark):
    rows = rows_of(20)
    df = spark.createDataFrame([(*r, *[None] * 9) for r in rows], DOCS + ", " + NAMES)
    assert got(merkle.verify(merkle.manifest(df))) == brute(rows)


def test_a_single_part_in_several_blocks(spark):
    rows = [(i, "t", "en", "s", i) for i in range(600)]
    assert got(merkle.verify(merkle.manifest(spark.createDataFrame(rows, DOCS).repartition(7)))) == brute(rows)


def test_manifest_sql(spark):
    rows = rows_of(40)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted((tuple(r) for r in con.execute(OP11_SQL).fetchall()), key=repr) == brute(rows)
