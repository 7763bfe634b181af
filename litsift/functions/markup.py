"""HTML as Spark SQL expressions: a body's tags folded into elements, text and attributes read from them.

``tokens`` splits a body into tags and text by one regular expression; ``elements`` folds the
tags over a stack of what is open. As a lenient parser does, an end tag closes the nearest
open element of its name with all that is open inside it, an end tag without one is ignored,
the end of the body closes the rest, and nothing is closed by implication. So nested and
unclosed elements, ``<`` in text and either kind of quotes are read as they stand. All of it
are JVM expressions on one row a body.

The functions take and give SQL text: such expressions have thousands of nodes, and handing
them to the JVM one by one takes seconds.
"""

from __future__ import annotations

from html.entities import name2codepoint

# Elements without content, and those whose content is no markup.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
RAW = ["script", "style"]
# White space of any script.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"

# A comment, a raw element, a declaration, a tag with quoted values, any other tag, text, a lone "<".
_TOKEN = ("(?is)<!--.*?-->|<(" + "|".join(RAW) + r")\b[^>]*>.*?</\1\s*>|<[!?][^>]*>"
          r"""|</?[a-z](?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>|</?[a-z][^>]*>|[^<]++|<""")
_ATTRIBUTE = r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+"""
_REFERENCE = r"&(?:#[0-9]++|#[xX][0-9a-fA-F]++|[a-zA-Z][a-zA-Z0-9]*+);?+|[^&]++|&"
_NAMED = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}
#: Numbers that stand for the characters of the Windows code page instead of control characters.
_WINDOWS = {n: c for n in range(128, 160) if (c := bytes([n]).decode("cp1252", "ignore"))}
_LARGEST = 0x10FFFF


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _map(values: dict) -> str:
    quoted = lambda x: str(x) if isinstance(x, int) else "'" + "".join(f"\\u{ord(c):04x}" for c in x) + "'"
    return f"map({', '.join(f'{quoted(k)}, {quoted(v)}' for k, v in values.items())})"


def unescape(text: str) -> str:
    """Character references decoded: numbers, and names with or without their semicolon. An
    unknown name stays; an impossible number is the replacement character."""
    group = lambda pattern: f"nullif(regexp_extract(t, '{pattern}', 1), '')"
    n = f"coalesce({group('^&#([0-9]+)')}, conv({group('^&#[xX]([0-9a-fA-F]+)')}, 16, 10))"
    char = (f"transform(array(try_cast({n} as bigint)), n -> coalesce(try_element_at({_map(_WINDOWS)}, int(if(n < 160, n, null))), "
            f"if(n between 1 and {_LARGEST} and n not between {0xD800} and {0xDFFF}, decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32'), '\ufffd')))[0]")
    read = (f"case when not startswith(t, '&') or length(t) = 1 then t when startswith(t, '&#') then {char} "
            f"else coalesce(try_element_at({_map(_NAMED)}, {group('^&([a-zA-Z0-9]+)')}), t) end")
    return (f"transform(array({text}), c -> if(contains(c, '&'), "
            f"array_join(transform(regexp_extract_all(c, {literal(_REFERENCE)}, 0), t -> {read}), ''), c))[0]")


def trim_spaces(text: str) -> str:
    return f"trim(both {literal(SPACES)} from {text})"


def tokens(html: str) -> str:
    """A body as an array of (kind, name, raw): S start, E end, V start without content,
    C comment or declaration, R script or style, T text."""
    listed = lambda names: ", ".join(f"'{n}'" for n in names)
    kind = (f"case when not startswith(raw, '<') or length(raw) = 1 then 'T' when substr(raw, 2, 1) in ('!', '?') then 'C' "
            f"when substr(raw, 2, 1) = '/' then 'E' when name in ({listed(RAW)}) then 'R' "
            f"when name in ({listed(VOID)}) or endswith(raw, '/>') then 'V' else 'S' end")
    named = f"transform(regexp_extract_all({html}, {literal(_TOKEN)}, 0), t -> struct(lower(regexp_extract(t, {literal('^</?([a-zA-Z][^\\s/>]*)')}, 1)) as name, t as raw))"
    return f"transform({named}, x -> named_struct('kind', {kind.replace('raw', 'x.raw').replace('name', 'x.name')}, 'name', x.name, 'raw', x.raw))"


def elements(parsed: str, names: list[str]) -> str:
    """(start, stop, name) of the elements called one of ``names``, in order: the places, from 1,
    of their tags in the column ``parsed`` of tokens (one after the last where the end is missing)."""
    listed = ", ".join(f"'{n}'" for n in names)

    def state(names: str, ats: str, out: str) -> str:
        return f"named_struct('names', {names}, 'ats', {ats}, 'out', {out})"

    def close(k: str, at: str) -> str:
        """``out`` with what is open from place k of the stack on, ended by token ``at``."""
        each = f"transform(slice(s.names, {k}, size(s.names)), (n, j) -> named_struct('start', s.ats[{k} - 1 + j], 'stop', {at}, 'name', n))"
        return f"concat(s.out, filter({each}, e -> e.name in ({listed})))"

    none = state("cast(array() as array<string>)", "cast(array() as array<int>)", "cast(array() as array<struct<start:int,stop:int,name:string>>)")
    nearest = "(size(s.names) - array_position(reverse(s.names), x.name) + 1)"
    nearest = f"int({nearest})"
    tags = (f"filter(transform({parsed}, (x, i) -> named_struct('kind', x.kind, 'name', x.name, 'at', i + 1)), "
            f"x -> x.kind in ('S', 'E') or (x.kind = 'V' and x.name in ({listed})))")
    start = state("array_append(s.names, x.name)", "array_append(s.ats, x.at)", "s.out")
    alone = state("s.names", "s.ats", "array_append(s.out, named_struct('start', x.at, 'stop', x.at, 'name', x.name))")
    end = state(f"slice(s.names, 1, {nearest} - 1)", f"slice(s.ats, 1, {nearest} - 1)", close(nearest, "x.at"))
    step = (f"case when x.kind = 'S' then {start} when x.kind = 'V' then {alone} "
            f"when array_contains(s.names, x.name) then {end} else s end")
    return f"aggregate({tags}, {none}, (s, x) -> {step}, s -> array_sort({close('1', f'size({parsed}) + 1')}))"


def within(parsed: str, element: str) -> str:
    """The tokens inside an element."""
    return f"slice({parsed}, {element}.start + 1, greatest({element}.stop - {element}.start - 1, 0))"


def raw_text(inside: str) -> str:
    """All text of some tokens, references as they stand."""
    return f"array_join(transform(filter({inside}, x -> x.kind = 'T'), x -> x.raw), '')"


def text_of(inside: str) -> str:
    return unescape(raw_text(inside))


def single_string(inside: str) -> str:
    """Whether an element holds one string alone, bare or wrapped in elements that hold nothing
    else. End tags of nothing inside are ignored, but part the strings around them."""
    opened = f"transform(filter({inside}, y -> y.kind = 'S'), y -> y.name)"
    kinds = f"transform({inside}, x -> if(x.kind = 'E' and not array_contains({opened}, x.name), '-', x.kind))"
    return f"array_join({kinds}, '') rlike '^[S-]*T+[E-]*$'"


def raw_attribute(tag: str, name: str) -> str:
    """An attribute's value, the last one if repeated, references as they stand; empty if it
    has none, null if it isn't there."""
    found = lambda i: f"regexp_extract_all(regexp_replace({tag}, {literal('^<[^\\s/>]+')}, ''), {literal(_ATTRIBUTE)}, {i})"
    value = f"try_element_at(filter(arrays_zip({found(1)}, {found(2)}), x -> lower(x['0']) = '{name}'), -1)['1']"
    return f"transform(array({value}), v -> if(length(v) > 1 and substr(v, 1, 1) in ('\"', '\\''), substr(v, 2, length(v) - 2), v))[0]"


def attribute(tag: str, name: str) -> str:
    return unescape(raw_attribute(tag, name))
