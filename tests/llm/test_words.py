"""Word hashes of substring dedup: equal for equal words, wherever they stand."""

import random

import numpy as np

from litsift.llm import rlz


def test_word_hashes_follow_the_words():
    rng = random.Random(1)
    signs = ["a", "b", "é", " ", " ", "\x1c", "\x85", "🙂", ".", "ab"]
    spaces = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "  "]
    rows = ["".join(rng.choice(signs + spaces) for _ in range(rng.randrange(40))).encode() for _ in range(3000)]
    rows += [b"", b" ", b"x" * 70_000 + b" y", b"x" * 70_001, b"x" * 65_536 + b"y" + b"x" * 10, b"x" * 65_537 + b"y" + b"x" * 9, b"y " * 300_000, b"last"]
    words, n = rlz.Parser.hashes(rows)
    want = [w for r in rows for w in r.split()]
    assert list(n) == [len(r.split()) for r in rows] and len(words) == len(want)
    by_word = {}
    for w, h in zip(want, words.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_word_hashes_of_chunks_are_those_of_all(monkeypatch):
    rows = [f"some words {i} of row {i * 7}".encode() for i in range(500)]
    whole = rlz.Parser.hashes(rows)
    monkeypatch.setattr(rlz, "CHUNK", 60)
    parts = rlz.Parser.hashes(rows)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))
    assert [len(x) for x in rlz.Parser.hashes([])] == [0, 0] and [list(x) for x in rlz.Parser.hashes([b"", b"\n"])] == [[], [0, 0]]


def test_ngrams_do_not_depend_on_blocks(monkeypatch):
    from litsift.llm import langid
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcßéİ") for _ in range(rng.randrange(1, 60))) for _ in range(300)) + " " + "x" * 500
    whole = sorted(langid.ngrams(text).tolist())
    for block in (1, 7, 64, 1000):
        monkeypatch.setattr(langid, "BLOCK", block)
        assert sorted(langid.ngrams(text).tolist()) == whole
    assert len(langid.ngrams("")) == 0
