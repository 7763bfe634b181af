"""Each operator against a brute-force version, and on nulls, empties, ties, repeats, empty tables and clashing names."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from litsift.llm import bpe, exact_dedup, langid, packing, rlz, shard, simhash, topk, toxicity, urls
from litsift.llm.components import components

SF = "/root/testdata/sf0.001"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["İstanbul ΣΑΣ naïve ẞ <|endoftext|> it's 'll x²½ ①", "a\tb\r\nc\x0bd\x0ce\x1cf\xa0g\u2003h\u3000i", "日本語。 العربية 12.5 x).:", "", " ", "\n",
       ".", "a" * 3000, " " * 2000, "the" * 900 + "!" * 300, "🙂 x\u0301 ſ", "d'l'S WE'LL."]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = "row string, found string, fp long, h string, norm string, key long, size long, mark string, slot long"
PASSAGE = " ".join(f"shared{i}" for i in range(40))


def rows_of(texts):
    """Documents with repeated rows, null ids and texts, and all of ODD."""
    out = [(i, t, "en" if i % 2 else None, "s", 1) for i, t in enumerate([*ODD, None, *texts], 1)]
    return [*out, out[0], (out[0][0], "another text of that id", "fr", None, None), (None, None, None, None, None), (None, "nameless words here", "en", "s", 3), out[-1]]


TEXTS = [PASSAGE, "before " + PASSAGE, PASSAGE + " after", PASSAGE, "one two three", "a " * 60, "a " * 61, "Ünï " * 30,
         " ".join(f"w{i}" for i in range(50)) + " " + PASSAGE[:150]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(TEXTS), DOCS).repartition(3)


@pytest.fixture(scope="module")
def clashing(spark):
    return spark.createDataFrame([(*r, *[None] * 9) for r in rows_of(TEXTS)], DOCS + ", " + NAMES)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


def words(text):
    return (text or "").encode().split()


def brute_rlz(rows):
    first = {}
    for r in rows:
        w = words(r[1])
        if r[0] is not None:
            for i in range(len(w) - 12):
                k = tuple(w[i:i + 13])
                first[k] = min(first.get(k, r[0]), r[0])
    out = []
    for r in rows:
        w = words(r[1])
        gone = set()
        for i in range(len(w) - 12):
            if r[0] is not None and first[tuple(w[i:i + 13])] < r[0]:
                gone |= set(range(i, i + 13))
        out.append((r[0], len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def test_substrings(docs, clashing, none):
    for df in (docs, clashing):
        assert got(rlz.dedup_substrings(df), "doc_id", "n_words", "n_removed", "kept") == brute_rlz(df.collect())
    assert rlz.dedup_substrings(none).count() == 0
    carried = rlz.dedup_substrings(clashing, carry=True)
    assert carried.count() == clashing.count() and carried.select("row.row").count() == clashing.count()


def test_substrings_are_settled_across_tasks(spark):
    rng = np.random.default_rng(3)
    pool = [" ".join(map(str, rng.integers(0, 4, 30))) for _ in range(6)]
    rows = [(int(i), " ".join(rng.choice(pool, 3)), None, None, None) for i in rng.permutation(120)]
    df = spark.createDataFrame(rows, DOCS).repartition(17)
    assert got(rlz.dedup_substrings(df), "doc_id", "n_words", "n_removed", "kept") == brute_rlz(rows)


def test_substrings_are_settled_across_arrow_batches(spark):
    rng = np.random.default_rng(8)
    pool = [" ".join(map(str, rng.integers(0, 40, 30))) for _ in range(40)]
    rows = [(int(i), " ".join(rng.choice(pool, 3)), None, None, None) for i in rng.permutation(120)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    small = {"spark.sql.execution.arrow.maxRecordsPerBatch": "3", "spark.sql.shuffle.partitions": "2"}
    old = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        assert got(rlz.dedup_substrings(df), "doc_id", "n_words", "n_removed", "kept") == brute_rlz(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_factors_name_a_reference_that_holds_them(docs):
    by_id = {}
    for r in docs.collect():
        by_id.setdefault(r.doc_id, []).append(words(r.text))
    for r in rlz.dedup_substrings(docs, carry=True).where("n_removed > 0").collect():
        own = words(r.text)
        for s in r.spans:
            assert s.words >= rlz.WINDOW and s.reference < r.doc_id
            piece = b" ".join(own[s.start:s.start + rlz.WINDOW])
            assert any(piece in b" ".join(w) for w in by_id[s.reference])


def fingerprint(text):
    w = words(text)
    w = [bytes(x).lower() for x in w]
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    bits = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b, n in bits.items() if 2 * n > len(shingles))


def test_simhash(docs, none):
    rows = docs.collect()
    prints = [fingerprint(r.text) for r in rows]
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                old, new = part[a], part[b]
                part = [new if p == old else p for p in part]
    least = {p: min((r.doc_id for r, q in zip(rows, part) if q == p and r.doc_id is not None), default=None) for p in part}
    want = sorted(((r.doc_id, f"{f:016x}", least[p]) for r, f, p in zip(rows, prints, part)), key=repr)
    assert got(simhash.near_groups(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_groups(none).count() == 0


def test_links_join_all_near_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(simhash, "TREE", 40)  # hot shards are cut into several trees
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = {int(x) for x in base}
    for _ in range(300):
        x = int(rng.choice(base))
        for bit in rng.choice(64, rng.integers(0, 6), replace=False):
            x ^= 1 << int(bit)
        fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    tree = simhash.BKTree(fps)
    q, m = tree.within(fps, 2)
    want = {(a, b) for a in range(len(fps)) for b in range(len(fps)) if int(fps[a] ^ fps[b]).bit_count() <= 2}
    assert set(zip(q.tolist(), m.tolist())) == want
    part = list(range(len(fps)))
    for a, b in want:
        old, new = part[a], part[b]
        part = [new if p == old else p for p in part]
    signed = fps.view(np.int64).tolist()
    found = components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2)).toPandas()
    label = dict(zip(found.node, found.component))
    groups = {}
    for s, p in zip(signed, part):
        groups.setdefault(p, set()).add(label.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (41, 40)]
    found = dict(got(components(spark.createDataFrame(edges, "u long, v long")), "node", "component"))
    assert found == {**{i: 0 for i in range(42)}, **{100 + i: 100 for i in range(30)}}


def test_exact(docs, clashing, none):
    def norm(t):
        out, space = [], False
        for ch in t or "":
            if ch in " \t\n\r\x0b\x0c":
                space = True
                continue
            out += [" "] * space + [ch]
            space = False
        return "".join(out) + " " * space

    rows = docs.collect()
    groups = {}
    for r in rows:
        groups.setdefault(norm(r.text), []).append(r.doc_id)
    want = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        ids = sorted(ids, key=repr)
        for n, i in enumerate(ids):
            want.append((i, keep, len(ids), i == keep and i not in ids[:n], hashlib.sha256(t.encode()).hexdigest()))
    for df in (docs, clashing):
        assert got(exact_dedup.exact_groups(df), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert exact_dedup.exact_groups(none).count() == 0


def test_byte_bpe(docs, none):
    tokens = bpe.read_ranks(BYTE)
    with open(BYTE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.BPE(tokens, public_tokenizers.PATTERN)
    rng = np.random.default_rng(1)
    junk = ["".join(rng.choice(list("abcé \n's.,1٣\xa0日🙂"), 60)) for _ in range(200)]
    for t in [*ODD, *TEXTS, *junk]:
        assert own.encode(t) == encoding.encode_ordinary(t)
    for r in bpe.decode(bpe.encode(docs, BYTE, public_tokenizers.PATTERN), BYTE).collect():
        assert bytes(r.decoded) == b"".join(tokens[i] for i in r.ids)
    want = sorted(((r.doc_id, len(i := encoding.encode_ordinary(r.text or "")), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(),
                    hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect()), key=repr)
    found = bpe.digests(bpe.decode(bpe.encode(docs, BYTE, public_tokenizers.PATTERN), BYTE))
    assert got(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.encode(none, BYTE, public_tokenizers.PATTERN).count() == 0


def test_packing(docs, none):
    tokenizer, own = Tokenizer.from_file(WORD), packing.Tokens(WORD)
    ids = lambda t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
    for t in [*ODD, *TEXTS]:
        assert own.ids(t) == ids(t)[:-4]
    for capacity in (16, 4096):
        rows = packing.pack(docs, WORD, capacity).collect()
        want, have = Counter(), Counter()
        for r in docs.collect():
            whole, at = ids(r.text), 0
            for n in packing.cut(len(whole) // 4, packing.class_sizes(capacity)):
                want[r.doc_id, at, n, zlib.crc32(whole[4 * at:4 * (at + n)]), len(whole) // 4] += 1
                at += n
            assert 4 * at == len(whole)
        bins = {}
        for r in rows:
            have[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert have == want
        for parts in bins.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= capacity
    assert packing.pack(none, WORD).count() == 0


def test_sharding(spark, docs, none):
    rows = [(r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect()]
    found = shard.shard_documents(docs)
    assert got(found, "doc_id", "size", "text_crc32") == sorted(rows, key=repr)
    for s, part in found.toPandas().groupby("shard"):
        assert sorted(part.slot) == list(range(len(part))) and 0 <= s < 24
    many = shard.assign(spark.range(24_000).withColumnRenamed("id", "doc_id"), "doc_id", shard.layout(24), 1).toPandas()
    moved = many[many.shard != many.grown_shard]
    assert set(moved.grown_shard) == {24} and 700 < len(moved) < 1250
    sizes = many.groupby("shard").size()
    assert len(sizes) == 24 and sizes.min() > 850 and sizes.max() < 1150
    assert shard.shard_documents(none).count() == 0


def test_urls(spark):
    cases = ["http://a.net/x", "https://NET/", "http://net", "http://xnet/", "http://sub.Example.NET/en/1?q", "http://example.com/de", "http://example.com/de/#a",
             "x.org/fr/", "http://a.b.org/fr/", "//no", None, "", "://org/fr/?x://net/", "http://example.net?/en/", "http://a.net:80/", "ftp://u@a.net/#"]
    rows = [(i, u, "x") for i, u in enumerate(cases)] * 2 + [(None, "http://a.net/", "x")]

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[:min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
        fits = [(h + p, a) for a, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, urls.DEFAULT))
        return host, path, rule, verdict

    want = sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    rules = urls.rules_df(spark, urls.RULES)
    assert got(urls.judge(pages, rules), "page_id", "host", "path", "rule", "verdict") == want
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(pages, rules.limit(0)).collect()} == {urls.DEFAULT}


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vecs = [(int(i), rng.normal(size=8).astype("float32").tolist()) for i in range(400)]
    vecs += [(1000 + i, [0.5] * 8) for i in range(60)] + [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 8), (2150, [float("inf")]), (2200, []), (2250, [3.0])]
    vecs += [vecs[0], (None, [1.0] * 8), (50, [0.25] * 8)]
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rows = sorted({(i, tuple(int(np.floor(256.0 * x)) for x in v)) for i, v in vecs if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    want = []
    for i, v in rows:
        if i % 50 == 0:
            near = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != i))[:5]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(near, 1)]
    df = spark.createDataFrame([(i, v, 0) for i, v in vecs], "vec_id long, embedding array<float>, vec int").repartition(3)
    assert got(topk.top_k(df), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert topk.top_k(df.limit(0)).count() == 0
    big = np.array([[1 << 40, 3]])
    assert topk.products(big, big)[0][0] == (1 << 63) - 1 and topk.products(big[:, 1:], big[:, 1:])[0][0] == 9


def brute_profile(texts, size):
    n = Counter()
    for t in texts:
        for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
            w = "\x01" + w + "\x01"
            n.update(w[1:-1])
            n.update(w[i:i + 2] for i in range(len(w) - 1))
            n.update(w[i:i + 3] for i in range(len(w) - 2))
    return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], [*x[0].rjust(3, "\0")]))[:size]]


def test_language_profiles_and_distances(spark):
    learned = [("en", "the cat and the hat"), ("en", "and then the end"), ("fr", "le chat et la tête"), ("fr", "l'été, où est-il"), (None, "x"), ("de", None)]
    profiles = langid.learn(spark.createDataFrame(learned, "lang string, text string").repartition(3), 20)
    want = {n: brute_profile([t for k, t in learned if k == n], 20) for n in ("en", "fr")}
    for text in ["the hat", "la tête", "été!", "ça", "Zz 9"]:
        own = brute_profile([text], 20)
        away = {n: sum(abs(i - p.index(g)) if g in p else 20 for i, g in enumerate(own)) for n, p in want.items()}
        best = min(away, key=lambda n: (away[n], n))
        lang, score = profiles.predict(text)
        assert lang == best and abs(score - (1 - away[best] / (20 * len(own)))) < 1e-12
    assert [profiles.predict(t) for t in (None, "", "12 !?")] == [("und", 0.0)] * 3
    assert langid.learn(spark.createDataFrame([], "lang string, text string")).predict("abc") == ("und", 0.0)


def test_language_held_out_accuracy(spark):
    r = E.queries()["op1_language_id"](spark, SF.replace("0.001", "0.01")).join(spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet"), "doc_id")
    hit = r.where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert hit > 0.95


def test_field_marginals_are_those_of_all_taggings():
    rng = np.random.default_rng(4)
    field = toxicity.Field({})
    field.emit, field.near = rng.normal(size=toxicity.LEVELS + 1), rng.normal(size=2)
    field.start, field.move = rng.normal(size=2), rng.normal(size=(2, 2))
    seen, size = np.array([[0, 3, 1, 0, 5], [2, 0, 0, 0, 0]], np.uint8), np.array([5, 3])
    z, p, moves = field.passes(seen, size)
    e = field.potentials(seen)
    expected = np.zeros((2, 2))
    for row, n in enumerate(size):
        total, ones = 0.0, np.zeros(n)
        pairs = np.zeros((2, 2))
        for tags in np.ndindex(*[2] * int(n)):
            w = np.exp(field.start[tags[0]] + sum(e[row, i] * t for i, t in enumerate(tags)) + sum(field.move[a, b] for a, b in zip(tags, tags[1:])))
            total += w
            ones += w * np.array(tags)
            for a, b in zip(tags, tags[1:]):
                pairs[a, b] += w
        assert abs(z[row] - np.log(total)) < 1e-9 and np.allclose(p[row, :n, 1], ones / total)
        expected += pairs / total
    assert np.allclose(moves, expected)


def test_toxicity(spark, none):
    rng = np.random.default_rng(6)
    texts, marks = [], []
    for i in range(240):
        w = list(rng.choice(["sun", "rain", "wind", "snow", "tree", "road"], 30))
        if i % 4 == 0:
            w[int(rng.integers(30))] = str(rng.choice(["vilest", "rotten!"]))
        texts.append(" ".join(w))
        marks.append(int(i % 4 == 0))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (None, "rotten")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)] + [(900, None), (None, 1), (0, 0)], "doc_id long, toxic int")
    field = toxicity.learn(docs, labels)
    found = {r.doc_id: r for r in toxicity.score(docs, field).collect()}
    assert len(found) == 243 and all(0 <= r.score <= 1 for r in found.values())
    assert all((found[i].score >= 0.5) == bool(m) for i, m in enumerate(marks))
    for i in range(0, 240, 4):
        assert [texts[i][s.start:s.end] for s in found[i].spans] == [w for w in texts[i].split() if w in ("vilest", "rotten!")]
    assert toxicity.score(none, field).count() == 0
    assert toxicity.score(docs, toxicity.learn(docs, labels.limit(0))).agg(F.max("score")).first()[0] == 0


def test_marginals_of_a_long_text_are_near_those_of_one_chain():
    field = toxicity.Field({})
    field.emit, field.near = np.r_[-1.5, np.linspace(0, 3, toxicity.LEVELS)], np.array([0.7, 0.4])
    field.move = np.array([[0.5, 0.0], [0.0, 0.5]])
    for marks in ([63], [64, 200], [], [1, 127, 128]):
        seen = np.zeros(230, np.uint8)
        seen[marks] = 5
        whole = field.passes(seen[None], np.array([230]))[1][0, :, 1]
        assert np.abs(field.marginals([seen])[0] - whole).max() < 1e-3


def test_toxicity_keeps_words_that_stand_beside_others(spark):
    rng = np.random.default_rng(9)
    plain = lambda: list(rng.choice(["sun", "rain", "wind", "snow", "tree", "road"], 30))
    toxic = [" ".join([*plain(), "vilest", *(["scummy"] if i % 4 else [])]) for i in range(60)]
    copied = " ".join([*plain(), "vilest", "garden"])
    texts = [(t, 1) for t in [*toxic, *[copied] * 20]] + [(" ".join(plain()), 0) for _ in range(240)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)] + [(1000, "sun scummy rain"), (1001, "sun garden rain")], "doc_id long, text string")
    field = toxicity.learn(docs, spark.createDataFrame([(i, m) for i, (_, m) in enumerate(texts)], "doc_id long, toxic int"))
    assert {"vilest", "scummy"} <= set(field.levels) and "garden" not in field.levels
    found = {r.doc_id: r for r in toxicity.score(docs, field).where("doc_id >= 1000").collect()}
    assert found[1000].score >= 0.5 and [(s.start, s.end) for s in found[1000].spans] == [(4, 10)]
    assert found[1001].score < 0.5 and not found[1001].spans


def test_pipeline_stages_keep_clean_documents(spark, clashing, none):
    for stage_docs in (clashing, none):
        docs = stage_docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, docs = docs, stage(spark, docs, SF)
            assert docs.columns == before.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 0
    kept = corpus_pipeline.exact(spark, clashing, SF).collect()
    assert len(kept) == exact_dedup.exact_groups(clashing).where("kept").count()
    near = corpus_pipeline.near(spark, clashing, SF)
    parts = simhash.grouped(simhash.fingerprints(clashing)).where("doc_id is not null").select("part").distinct().count()
    assert near.where("doc_id is not null").count() == parts


def test_pipeline_on_the_smallest_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert set(rows.doc_id) <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert rows.groupby("sequence_id").length.sum().max() <= packing.CAPACITY


def brute_pipeline(rows):
    """(doc_id, start, length, ids_crc32, doc_tokens) of each piece; rows: (doc_id, text) with distinct ids."""
    rows = sorted((i, t) for i, t in rows if any(c.isalpha() for c in t or ""))
    first = {}
    for i, t in rows:
        first.setdefault(re.sub("[ \t\n\r\x0b\x0c]+", " ", t), (i, t))
    rows = sorted(first.values())
    prints = [fingerprint(t) for _, t in rows]
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                old, new = part[a], part[b]
                part = [new if p == old else p for p in part]
    rows = [rows[part.index(p)] for p in sorted(set(part), key=part.index)]
    cut = {i: kept for i, _, gone, kept in brute_rlz(rows) if gone}
    tokenizer, out = Tokenizer.from_file(WORD), []
    for i, t in rows:
        whole, at = np.array(tokenizer.encode(cut.get(i, t), add_special_tokens=False).ids + [2], "<u4").tobytes(), 0
        for n in packing.cut(len(whole) // 4, packing.class_sizes(packing.CAPACITY)):
            out.append((i, at, n, zlib.crc32(whole[4 * at:4 * (at + n)]), len(whole) // 4))
            at += n
    return sorted(out)


def test_pipeline_gives_what_its_stages_give_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = [t for t in (r.text for r in docs.collect()) if t and len(t.split()) > 300][:3]
    planted = [long[0], long[0].replace(" ", "  "), " ".join([*long[1].split()[:-1], "otherwise"]), "before this " + " ".join(long[2].split()[:60]), None, "", "12 34 !", long[1] + "\n"]
    more = spark.createDataFrame([(1_000_000 + i, t, None, "planted", len(t or "")) for i, t in enumerate(planted)], DOCS)
    docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    assert len({i for i, _ in rows}) == len(rows)
    want = brute_pipeline(rows)
    assert len({w[0] for w in want}) < len(rows) - 5
    assert got(corpus_pipeline.run(spark, str(tmp_path)), "doc_id", "start", "length", "ids_crc32", "doc_tokens") == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op4_top_k", "op6_url_filter", "op9_exact_dedup"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert got(E.queries()[name](spark, SF), *cols) == sorted(want.fetchall(), key=repr)
