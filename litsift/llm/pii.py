"""Personal data, plain and disguised, with the place of each find in the source text.

A text goes through a chain of transducers. Each rewrites some spans of its input and keeps
for every character of its output the span of source characters that it stands for:

1. characters: look-alikes, compatibility forms and foreign digits become ASCII, invisible
   characters go, references and escapes of ``@`` and ``.`` become these;
2. digits: ``O`` and ``l`` within a number, spelled digits (``four one`` -> ``41``, ``double
   five`` -> ``55``, ``plus one`` -> ``+1``), the blanks between them go;
3. disguised signs become signs: ``[at]``, ``(dot)``, `` at `` and `` dot `` as words, blanks
   around ``@`` and ``.`` within an address or between numbers.

The same detectors read the source (base finds) and the chain's output; spans found there
are mapped back to source characters. Base finds stay. A mapped span is added if anything
in it was rewritten and no base find of its kind holds all of it.

Bare words count as signs in places of an address only: ``at`` needs a name before it and a
host with a spelled dot after it, or a name with a digit or a sign and a dotted host whose
last label begins with a letter; so prose stays as it is.

Every step is linear in the length of the text: runs are matched possessively or from their
first character on, never again from each of their characters.

Defined results: a null text is empty. Offsets are code points, ends exclusive. Repeated
rows and ids stay rows of their own. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsift.llm.common import groups, map_arrow, texts

KINDS = ("email", "ip", "card", "phone")

# Letters of other scripts that look like an ASCII letter.
LOOKALIKES = {
    "A": "ΑА", "B": "ΒВ", "C": "СϹ", "E": "ΕЕ", "H": "ΗН", "I": "ΙІ", "J": "Ј",
    "K": "ΚК", "M": "ΜМ", "N": "Ν", "O": "ΟО", "P": "ΡР", "S": "Ѕ", "T": "ΤТ",
    "X": "ΧХ", "Y": "ΥУ", "Z": "Ζ", "a": "ɑа", "c": "ϲс", "d": "ԁ", "e": "е", "g": "ɡ",
    "h": "һ", "i": "ıιі", "j": "ј", "l": "ӏ", "o": "οо", "p": "р", "q": "ԛ", "s": "ѕ",
    "v": "ν", "w": "ԝ", "x": "х", "y": "у",
    # Signs: full stops, hyphens and minus signs without an ASCII compatibility form.
    ".": "。｡", "-": "‐‑‒–—―−",
}
# Characters without a width of their own.
HIDDEN = "­​‌‍‎‏⁠﻿"
# Digit words in the languages of the corpus, from 0 to 9.
DIGITS = ("zero null cero zéro oh", "one eins uno un", "two zwei zwo dos deux", "three drei tres trois", "four vier cuatro quatre",
          "five fünf cinco cinq", "six sechs seis", "seven sieben siete sept", "eight acht ocho huit", "nine neun nueve neuf")
# Words for repeated digits and for signs.
TIMES = {"double": 2, "triple": 3}
AT, DOT = "at|arroba|@", "dot|punkt|punto|point"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = r"[A-Za-z0-9-]++"
BLANK = r"[ \t]++"
VALUE = {word: str(n) for n, words in enumerate(DIGITS) for word in words.split()}
WORD = rf"(?:(?:{'|'.join(TIMES)}){BLANK})?(?:{'|'.join(sorted(VALUE, key=len, reverse=True))})(?!\w)"

HOST = re.compile(rf"@{LABEL}(?:\.{LABEL})++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

NUMBER = re.compile(rf"(?<!\w){WORD}(?:(?:{BLANK}(?:(?:{DOT}){BLANK})?|[-.]){WORD})++", re.I)
SINGLE = re.compile(rf"(?:(?<=dot )|(?<=point )|(?<=plus )){WORD}|(?<!\w){WORD}(?={BLANK}(?:dot|point){BLANK}[0-9])", re.I)
UNIT = re.compile(WORD, re.I)
PLUS = re.compile(rf"(?<!\w)plus{BLANK}(?=[0-9])", re.I)
BRACKET = re.compile(rf"[\[({{<][ \t]?(?:({AT})|({DOT}|\.))[ \t]?[\])}}>]", re.I)
PART = rf"(?:{BLANK}(?:{DOT}|\.(?=[ \t]++(?-i:[a-z]))){BLANK}|_(?:{DOT})_)"  # a bare point ends sentences, too
SPOKEN_AT = re.compile(rf"(?:(?<![ \t]){BLANK}({AT}){BLANK}|_(at)_|(?<=[A-Za-z0-9])(@){BLANK})"
                       rf"(?=({LABEL}(?:\.{LABEL})++)(?!{PART}{LABEL})|{LABEL}(?:\.{LABEL})*+({PART}){LABEL})", re.I)
SPOKEN_HOST = re.compile(rf"@{LABEL}(?:(?:{PART}|\.){LABEL})++", re.I)
SPOKEN_DOT = re.compile(PART, re.I)
DOT_BEFORE = re.compile(rf"(?:{DOT})\Z", re.I)
BETWEEN_NUMBERS = re.compile(rf"(?<=[0-9]){BLANK}(?:{DOT}|\.){BLANK}(?=[0-9])", re.I)
ESCAPE = re.compile(r"&(?:#64|#x40|commat);|%40|(&(?:#46|#x2e|period);|%2e)", re.I)
LETTERED = re.compile(r"(?<![A-Za-z0-9])(?=[OolI]*[0-9])[0-9OolI]++(?![A-Za-z0-9])")
LETTERS = {"O": "0", "o": "0", "l": "1", "I": "1"}
# What a text must hold before a step looks for more: words by kind (d digit, t times, p point).
DIGIT = re.compile("[0-9]")
ALPHA = re.compile(r"[^\W\d_]+")
KIND = dict.fromkeys(VALUE, "d") | dict.fromkeys(TIMES, "t") | dict.fromkeys(DOT.split("|"), "p") | {"plus": "+"}
RUNS, ALONE = re.compile("dp?t?d"), re.compile(r"[p+]t?d|dp")

Span = tuple[int, int]
Rewrite = tuple[int, int, str]
SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean,value:string>>"


def emails(text: str) -> Iterator[Span]:
    done = 0
    for host in HOST.finditer(text):
        start = _local(text, host.start(), done)
        if start < host.start():
            done = host.end()
            yield start, done


def _local(text: str, end: int, least: int) -> int:
    """Where the run of characters of a mailbox's name begins that ends at ``end``."""
    while end > least and text[end - 1] in LOCAL:
        end -= 1
    return end


def ips(text: str) -> Iterator[Span]:
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            yield m.span()


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = [int(x) for x in m.group().replace(" ", "").replace("-", "")[::-1][:20]]
            doubled = sum(2 * x - 9 * (x > 4) for x in digits[1::2])
            if 13 <= len(digits) <= 19 and (sum(digits[::2]) + doubled) % 10 == 0:
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        if 9 <= sum(map(m.group().count, "0123456789")) <= 15:
            yield m.span()


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) of all finds, leftmost and without overlaps in each kind."""
    found = []
    if "@" in text:
        found += [(0, *span) for span in emails(text)]
    if DIGIT.search(text):
        found += [(1, *span) for span in ips(text)]
        found += [(2, *span) for span in cards(text)]
        found += [(3, *span) for span in phones(text)]
    return found


class Plain(dict):
    """A character -> what it stands for in ASCII; itself if nothing."""

    def __init__(self):
        super().__init__({c: plain for plain, looks in LOOKALIKES.items() for c in looks} | dict.fromkeys(HIDDEN, ""))

    def __missing__(self, c: str) -> str:
        digit = unicodedata.decimal(c, None)
        form = unicodedata.normalize("NFKC", c) if digit is None else str(digit)
        self[c] = form if len(form) == 1 and form.isascii() else c
        return self[c]


PLAIN = Plain()


def characters(text: str) -> Iterator[Rewrite]:
    if text.isascii():
        return
    changed = [c for c in set(text) if not c.isascii() and PLAIN[c] != c]
    if changed:
        for m in re.finditer(f"[{re.escape(''.join(changed))}]", text):
            yield m.start(), m.end(), PLAIN[m.group()]


def escapes(text: str) -> Iterator[Rewrite]:
    if "&" not in text and "%4" not in text and "%2" not in text:
        return
    for m in ESCAPE.finditer(text):
        yield m.start(), m.end(), "." if m.group(1) else "@"


def lettered(text: str) -> Iterator[Rewrite]:
    """Letters that stand for digits, in words of digits and such letters."""
    if not DIGIT.search(text):
        return
    for m in LETTERED.finditer(text):
        for i, c in enumerate(m.group(), m.start()):
            if c in LETTERS:
                yield i, i + 1, LETTERS[c]


def numbers(text: str) -> Iterator[Rewrite]:
    """Runs of words for three digits and more, or of two around a spoken dot, word by word. A
    single word counts beside a dot and a number only: ``un 4111...`` is not one number."""
    changes, runs = [], []
    kinds = "".join(map(KIND.get, ALPHA.findall(text.lower()), repeat("-")))
    for m in NUMBER.finditer(text) if RUNS.search(kinds) else ():
        words = list(UNIT.finditer(text, m.start(), m.end()))
        if sum(len(_digits(w.group())) for w in words) < 3 and not SPOKEN_DOT.search(m.group()):
            continue
        runs.append(m.span())
        for word, after in zip(words, [*words[1:], None]):
            changes.append((word.start(), word.end(), _digits(word.group())))
            if after and text[word.end():after.start()].strip(" \t") == "":
                changes.append((word.end(), after.start(), ""))
    starts = [start for start, _ in runs]
    for m in SINGLE.finditer(text) if ALONE.search(kinds) else ():
        before = bisect.bisect_right(starts, m.start()) - 1
        if before < 0 or runs[before][1] <= m.start():
            changes.append((m.start(), m.end(), _digits(m.group())))
    yield from sorted(changes)


def _digits(word: str) -> str:
    *times, digit = word.lower().split()
    return VALUE[digit] * (TIMES[times[0]] if times else 1)


def plus(text: str) -> Iterator[Rewrite]:
    if not DIGIT.search(text):
        return
    for m in PLUS.finditer(text):
        yield m.start(), m.end(), "+"


def brackets(text: str) -> Iterator[Rewrite]:
    """``[at]`` and ``(dot)`` with the blanks around them."""
    done = 0
    for m in BRACKET.finditer(text):
        start, end = m.span()
        while start > done and text[start - 1] in " \t":
            start -= 1
        while end < len(text) and text[end] in " \t":
            end += 1
        yield start, end, "@" if m.group(1) else "."
        done = end


def spoken_at(text: str) -> Iterator[Rewrite]:
    low, done = text.lower(), 0
    if not any(x in low for x in (" at ", "\tat", "at\t", "_at_", "arroba", "@")):
        return
    for m in SPOKEN_AT.finditer(text):
        start = m.start()
        name = text[_local(text, start, done):start]
        host, part = m.group(4), m.group(5)  # a host with real points, or its first point that is none
        sure = m.group(1) == "@" or m.group(3) or not name.isalpha()
        if host:
            sure = sure and host.rpartition(".")[2][0].isalpha() and any(map(str.isalpha, name))
        elif part.strip(" \t") != ".":
            sure = True
        if name and name[-1] != "." and sure:
            yield start, m.end(), "@"
        done = m.end()


def spoken_dots(text: str) -> Iterator[Rewrite]:
    """Spoken dots in a host, in the name before its ``@`` and between numbers."""
    spans, done = [m.span() for m in BETWEEN_NUMBERS.finditer(text)] if DIGIT.search(text) else [], 0
    for m in SPOKEN_HOST.finditer(text) if "@" in text else ():
        spans += [dot.span() for dot in SPOKEN_DOT.finditer(text, m.start(), m.end())]
        start = at = _local(text, m.start(), done)
        while at < m.start() and (dot := _dot_before(text, at, done)):
            spans.append((dot, at))
            start, at = at, _local(text, dot, done)
            if at == dot:
                break
        done = m.end()
    for start, end in sorted(set(spans)):
        yield start, end, "."


def _dot_before(text: str, end: int, least: int) -> int | None:
    """Where blanks, a word for a dot and blanks begin that end at ``end``, if they do."""
    word = end
    while word > least and text[word - 1] in " \t":
        word -= 1
    first = word
    while first > least and word - first < 6 and text[first - 1].isalpha():
        first -= 1
    start = first
    while start > least and text[start - 1] in " \t":
        start -= 1
    spoken = DOT_BEFORE.fullmatch(text[first:word])
    return start if spoken and start < first and word < end and start > least and text[start - 1] in LOCAL else None


#: The chain: each reads what the one before it wrote.
CHAIN: tuple[Callable[[str], Iterator[Rewrite]], ...] = (characters, escapes, lettered, numbers, plus, brackets, spoken_at, spoken_dots)


class Traced:
    """A text with the span of source characters of each of its characters."""

    def __init__(self, source: str):
        self.text, self.starts, self.ends = source, None, None

    def rewrite(self, changes: list[Rewrite]) -> None:
        if not changes:
            return
        starts = np.arange(len(self.text)) if self.starts is None else self.starts
        ends = starts + 1 if self.starts is None else self.ends
        text, first, last, at = [], [], [], 0
        for start, end, new in changes:
            text += (self.text[at:start], new)
            first += (starts[at:start], np.full(len(new), starts[start]))
            last += (ends[at:start], np.full(len(new), ends[end - 1]))
            at = end
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends = np.concatenate([*first, starts[at:]]), np.concatenate([*last, ends[at:]])

    def source(self, start: int, end: int) -> Span:
        return int(self.starts[start]), int(self.ends[end - 1])


def find(source: str) -> list[tuple[int, int, int, bool, str]]:
    """(kind's place, start, end, whether it is a base find, the identifier in plain form), by kind and start."""
    base = detect(source)
    found = [(*x, True, source[x[1]:x[2]]) for x in base]
    plain = Traced(source)
    for step in CHAIN:
        plain.rewrite(list(step(plain.text)))
    if plain.starts is not None:
        starts = {kind: [x[1] for x in base if x[0] == kind] for kind in range(len(KINDS))}
        ends = {kind: [x[2] for x in base if x[0] == kind] for kind in range(len(KINDS))}
        for kind, a, b in detect(plain.text):
            start, end = plain.source(a, b)
            held = bisect.bisect_right(starts[kind], start) - 1
            if source[start:end] != plain.text[a:b] and not (held >= 0 and ends[kind][held] >= end):
                found.append((kind, start, end, False, plain.text[a:b]))
    return sorted(found)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("value", pa.string())]))
    for batch in groups(batches):
        spans = [[{"kind": KINDS[k], "start": s, "end": e, "base": b, "value": v} for k, s, e, b, v in find(text.decode("utf-8", "replace"))]
                 for text in texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans: kind, start, end, base (found as it stands) and value (its plain form)."""
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _spans, SPANS)


def digests(found: DataFrame) -> DataFrame:
    """Base finds by kind, the hash of the base spans, and all spans as text."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
