"""The conversation trie against a plain trie in Python and against its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from litsift.llm import trie
from litsift.llm.queries import OP13_SQL

CONV = "conv_id long, turn long, role string, text string"
NAMES = "depth long, block long, slot long, id string, mark string, n long, a long, t1 string, saved long, level long"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, mark, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + t[h:])
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    out = []
    for node, ids in members.items():
        below = [x for x in members if x[:len(node)] == node]
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), sum(len(x) == len(node) + 1 for x in below),
                    sum(not any(y[:-1] == x for y in members if y) for x in below), sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x),
                    hashlib.sha256(",".join(map(str, sorted(c for c in ids if built[c] == node))).encode()).hexdigest()))
    return sorted(out, key=repr)


def talks():
    rng = random.Random(5)
    said = ["hi", "héllo 🙂", "", None, "same", "a" * 40]
    rows = []
    for c in [*range(0, 9), *range(100, 112), 215, 216, 217, 10_000_000_000]:
        opening = rng.choice([["hi"], ["hi", "same"], ["hi", "same", "same"], []])
        texts = opening + [rng.choice(said) for _ in range(rng.choice([1, 2, 5, 9]))]
        rows += [(c, i if rng.random() < 0.9 else None, rng.choice(["user", "user", None]), t) for i, t in enumerate(texts)]
    long = [(c, i, "user", f"turn {i % 7}" if i < 25 or c == 300 else f"other {c} {i}") for c in (300, 301, 302) for i in range(43)]
    return [*rows, *long, rows[0], (7, 0, "user", "tie"), (7, 0, "user", "other tie"), (None, 1, "user", "nobody"), (8, 3, "system", "x" * 100_000)]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    return talks()


def test_trie_is_a_plain_trie(spark, rows):
    found = got(trie.prefix_trie(spark.createDataFrame(rows, CONV).repartition(5)))
    assert found == brute(rows)
    assert max(r[1] for r in found) > 5 * trie.WIDTH


def test_trie_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted((tuple(r) for r in con.execute(OP13_SQL).fetchall()), key=repr) == brute(rows)


def test_trie_with_clashing_names(spark, rows):
    few = rows[:40]
    df = spark.createDataFrame([(*r, *[None] * 10) for r in few], CONV + ", " + NAMES)
    assert got(trie.prefix_trie(df)) == brute(few)


def test_trie_of_few_rows(spark):
    lost = [(205, 0, "user", "only")]  # its head is absent, and it may have no turn left
    for few in ([], [(None, 0, "user", "x")], [(100, None, None, None)], lost, [(5, 0, "user", "x")] * 3):
        assert got(trie.prefix_trie(spark.createDataFrame(few, CONV))) == brute(few)


def test_running_sums_over_lots_and_lists_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "LOT", 3)
    few = [(c, i, "user", f"t{i if i < 30 else i * c}") for c in (400, 401) for i in range(60)]
    assert got(trie.prefix_trie(spark.createDataFrame(few, CONV).repartition(3))) == brute(few)


def test_ids_of_a_node_come_in_pieces(spark):
    import pyarrow as pa
    key = [[1] * 7, [0] * 7, [0] * 7, [0] * 7, [0] * 7]
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*key, [1, 2, 30, 31, 32, 100, 101])], names=[*trie.KEY, "conv_id"])
    old, trie.PIECE = trie.PIECE, 3
    try:
        pieces = list(trie._pieces(iter([batch.slice(0, 2), batch.slice(2)])))
    finally:
        trie.PIECE = old
    assert [p.column("ids").to_pylist() for p in pieces] == [["1,2,30"], ["31,32,100"], ["101"]]
    found = [x for b in trie._hashed(iter(pieces)) for x in b.column("ends_sha256").to_pylist()]
    assert found == [hashlib.sha256(b"1,2,30,31,32,100,101").hexdigest()]
