"""Token ids for every character and for long pieces; one law for the shards of every tree."""

import base64
import math
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from litsift.llm import bpe, packing, shard
from tokenizers import Tokenizer

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def words():
    tokenizer, own = Tokenizer.from_file(WORD), packing.Tokens(WORD)
    return own.ids, lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def pieces():
    with open(BYTE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.BPE(bpe.read_ranks(BYTE), public_tokenizers.PATTERN), theirs.encode_ordinary


def test_word_ids_of_every_character(words):
    own, library = words
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert chars
    for at in range(0, 0x30000, 256):
        text = " ".join(f"a{c}! b{c}. {c},x {c}" for c in chars[at:at + 256])
        if own(text) != library(text):  # name the character
            assert [c for c in chars[at:at + 256] if own(f"a{c}! b{c}. {c},x {c}") != library(f"a{c}! b{c}. {c},x {c}")] == []


def test_word_ids_of_the_dotted_capital(words):
    own, library = words
    for text in ("BELEDİYESİ, İZMİR.", "क़! क़.", "naïve, It's 'LL x²½.", "<|endoftext|>, a<|b"):
        assert own(text) == library(text)


SIGNS = [*map(chr, range(32, 0x180)), "\n", "\t", "\r", "'s", "'ll", "'RE", "<|endoftext|>", "İ", "é", "क़", "한", "\xa0", "\x1c", "\x85", " ", "🙂", "  "]


def test_ids_of_mixed_texts(words, pieces):
    rng = random.Random(4)
    for i in range(6000):
        pool = SIGNS if i % 2 else "abcdeeef  .,'019AZ!?-\nü"
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(40)))
        assert words[0](text) == words[1](text), text
        assert pieces[0].encode(text) == pieces[1](text), text


@pytest.mark.parametrize("part", ["the", "a", "qz", "é", " ", "ab1"])
def test_time_doubles_with_the_length_of_a_piece(pieces, part):
    own, theirs = pieces

    def took(n):
        data, best = (part * (n // len(part))).encode(), math.inf
        for _ in range(2):
            t = time.process_time()
            own.piece(data)
            best = min(best, time.process_time() - t)
        return best

    took(10_000)
    assert took(200_000) < 3 * took(100_000) + 0.05
    assert took(1_000_000) < 5
    assert own.encode(part * 20_000) == theirs(part * 20_000)


def test_encode_and_decode_in_one_pass(spark):
    rows = [(1, "It's  naïve 🙂"), (2, ""), (3, None), (None, "x" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = bpe.encode(df, BYTE, public_tokenizers.PATTERN, decoded=True)
    again = bpe.decode(bpe.encode(df, BYTE, public_tokenizers.PATTERN), BYTE)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, again.collect()))
    assert {r.doc_id: bytes(r.decoded).decode() for r in found.collect()} == {i: t or "" for i, t in rows}


def descend(key, weights):
    """The tree by plain descent: a node's draw is the least of those below it."""
    def draw(s):
        h = key_hash(key, s)
        return -math.log(((h >> 11) + 0.5) * 2.0 ** -53) / weights[s] if weights[s] else math.inf

    def least(node):
        return (draw(node), node) if isinstance(node, int) else min(least(x) for x in node)

    region = min(shard.layout(len(weights)), key=least)
    rack = min(region, key=least)
    return min(rack, key=least)


def key_hash(key, s):
    first = xxhash.xxh64_intdigest(f"shard/{s}".encode(), 42)
    return first if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), first)


def test_shards_are_those_of_a_plain_descent(spark):
    keys = spark.range(400).select(F.when(F.col("id") > 0, F.col("id") * 7919 - 1000).alias("doc_id"))
    for weights in ([1.0] * 24, [1.0, 0.0, 2.5, 1.0, 3.0], [2.0]):
        found = shard.assign(keys, "doc_id", shard.layout(len(weights)), weights=weights).collect()
        assert [r["shard"] for r in found] == [descend(r.doc_id, weights) for r in found]
        for r in found:
            assert r["shard"] in shard.layout(len(weights))[r.region][r.rack - sum(map(len, shard.layout(len(weights))[:r.region]))]


def test_one_law_for_every_count(spark):
    keys = spark.range(1500).withColumnRenamed("id", "doc_id")
    before = None
    for n in (1, 2, 4, 7, 8, 9, 16, 23, 24, 25, 40):
        now = shard.assign(keys, "doc_id", shard.layout(n), 1)
        then = shard.assign(keys, "doc_id", shard.layout(n + 1)).withColumnRenamed("shard", "then").select("doc_id", "then")
        rows = now.join(then, "doc_id").collect()
        assert all(r.grown_shard == r.then and r.grown_shard in (r["shard"], n) for r in rows)
        if before and before[0] == n:
            assert {r.doc_id: r["shard"] for r in rows} == before[1]
        before = n + 1, {r.doc_id: r.grown_shard for r in rows}


def test_changed_weights_move_rows_of_their_shards_only(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    old = [1.0] * 24
    was = {r.doc_id: r["shard"] for r in shard.assign(keys, "doc_id", shard.layout(24), weights=old).collect()}
    for changed, factor in (([13], 3.0), ([13], 0.25), ([8, 9, 10, 11], 0.0), (range(8), 2.0)):
        new = [w * factor if s in changed else w for s, w in enumerate(old)]
        now = {r.doc_id: r["shard"] for r in shard.assign(keys, "doc_id", shard.layout(24), weights=new).collect()}
        moved = [(was[k], now[k]) for k in was if was[k] != now[k]]
        assert moved and all((b if factor > 1 else a) in changed for a, b in moved)
        share = sum(new[s] for s in changed) / sum(new)
        assert abs(sum(x in changed for x in now.values()) / len(now) - share) < 0.02


def test_weights_are_checked(spark):
    for weights in ([1.0] * 3, [-1.0, *[1.0] * 23], [0.0] * 24):
        with pytest.raises(ValueError):
            shard.assign(spark.range(3), "id", shard.layout(24), weights=weights)
