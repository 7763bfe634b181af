"""SQL text (DuckDB dialect) for the oracle side of the query registry.

These build plain SQL expressions that state each operator's semantics directly (brute
force where the Spark plan is clever). Word lists, limits and prompt texts come from the
engine's fixed values, so that they are written down once; the logic is the oracle's own.
"""

from __future__ import annotations

from types import SimpleNamespace

from litsift.functions import prompt as _prompt
from litsift.functions import text as _text
from litsift.functions.prompt import SLOTS, TEMPLATE

C = SimpleNamespace(**{k: getattr(m, k) for m in (_text, _prompt) for k in dir(m) if k.isupper()})

WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
STOP = "[" + ", ".join(f"'{w}'" for w in C.STOP_WORDS) + "]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def first_line(x: str) -> str:
    return f"split_part({x}, chr(10), 1)"


def clean_title(x: str) -> str:
    return f"replace(replace({strip(x)}, chr(10), ' '), '  ', ' ')"


def clean_authors(x: str) -> str:
    return f"replace(replace({strip(x)}, chr(10), ', '), '  ', ' ')"


def tokens(x: str, drop_stop: bool = True) -> str:
    cond = "w <> ''" + (f" AND NOT list_contains({STOP}, w)" if drop_stop else "")
    return (f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '{C.TOKEN_SPLIT}'), "
            f"lambda w: {cond}))")


def norm_title(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '{C.TOKEN_SPLIT}', ' ', 'g'))"


def phrase_words(x: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array({x}, '\\s+'), "
            f"lambda w: lower(regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g'))), "
            f"lambda w: w <> '' AND NOT list_contains({STOP}, w))")


def key_phrase(x: str, n: int = 2) -> str:
    return (f"array_to_string(list_slice(list_filter(list_transform(regexp_split_to_array({x}, '\\s+'), "
            f"lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g')), "
            f"lambda w: w <> '' AND NOT list_contains({STOP}, lower(w))), 1, {n}), ' ')")


def last_name(x: str) -> str:
    return (f"CASE WHEN contains({x}, ',') THEN {strip(f'split_part({x}, {q(chr(44))}, 1)')} "
            f"ELSE regexp_extract({strip(x)}, '(\\S+)$', 1) END")


def truncate_abstract(x: str) -> str:
    keep = C.ABSTRACT_LIMIT - len(C.ABSTRACT_ELLIPSIS)
    return (f"CASE WHEN length({x}) > {C.ABSTRACT_LIMIT} THEN substring({x}, 1, {keep}) || "
            f"{q(C.ABSTRACT_ELLIPSIS)} ELSE {x} END")


def categories_str(x: str) -> str:
    return f"CASE WHEN coalesce(len({x}), 0) > 0 THEN array_to_string({x}, ', ') ELSE {q(C.NO_CATEGORIES)} END"


def prompt(title: str, authors: str, categories: str, abstract: str, question: str) -> str:
    vals = {
        "title": f"coalesce({title}, {q(C.DEFAULT_TITLE)})",
        "authors": f"coalesce({authors}, {q(C.DEFAULT_AUTHORS)})",
        "categories": categories_str(categories),
        "abstract": truncate_abstract(f"coalesce({abstract}, {q(C.DEFAULT_ABSTRACT)})"),
        "question": question,
    }
    return "(" + " || ".join(vals[p] if p in SLOTS else q(p) for p in TEMPLATE) + ")"


def b64url(x: str) -> str:
    return f"translate(to_base64(encode({x})), '+/', '-_')"


# Paper / catalogue / question bindings, as CTE bodies over the driver's views.
PAPERS = (f"SELECT CAST(doc_id AS VARCHAR) AS arxiv_id, {clean_title(first_line('text'))} AS title, "
          f"source AS authors, text AS abstract, source AS venue, [lang] AS categories FROM documents")
CATALOGUE = (f"SELECT 'catalogue/' || CAST(doc_id AS VARCHAR) AS entry_id, CAST(doc_id AS VARCHAR) AS doc_key, "
             f"{first_line('text')} AS title, [source] AS authors, text AS summary, "
             f"'catalogue/pdf/' || CAST(doc_id AS VARCHAR) AS pdf_url, [lang] AS categories FROM documents")
QUESTIONS = "SELECT CAST(item_id AS BIGINT) AS question_id, text AS question FROM benchmark"
