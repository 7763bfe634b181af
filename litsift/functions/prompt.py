"""Scoring prompt (P22) built JVM-side with ``concat``.

The template is a list of literal pieces and slot names, so the same text can be rendered as
a Spark Column here and as SQL for the oracle (see ``litsift.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from litsift.functions.text import _c, categories_str, truncate_abstract

# ---------------------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results)
# ---------------------------------------------------------------------------------------
DEFAULT_TITLE = "Untitled Paper"
DEFAULT_AUTHORS = "Unknown Authors"
DEFAULT_ABSTRACT = "No abstract available."
# ---------------------------------------------------------------------------------------

SLOTS = ("title", "authors", "categories", "abstract", "question")

TEMPLATE = [
    "You rate how relevant a research paper is to one research question.\n\n"
    "Read the paper details and the question. Say whether the paper's topic or any of its "
    "findings bear on the question, then give an integer score from 0 to 10:\n"
    "0 = unrelated, 5 = partly related, 10 = addresses the question directly.\n\n"
    "Reply with exactly this XML and nothing else:\n"
    "<explanation>\nyour reasoning about topic and results\n</explanation>\n"
    "<score>N</score>\n\n"
    "PAPER\nTitle: ", "title",
    "\nAuthors: ", "authors",
    "\nCategories: ", "categories",
    "\nAbstract: ", "abstract",
    "\n\nQUESTION\n", "question",
    "\n",
]


def prompt_inputs(title, authors, categories, abstract, question) -> dict[str, Column]:
    """Slot values with the defaults and the abstract/categories formatting applied."""
    return {
        "title": F.coalesce(_c(title), F.lit(DEFAULT_TITLE)),
        "authors": F.coalesce(_c(authors), F.lit(DEFAULT_AUTHORS)),
        "categories": categories_str(categories),
        "abstract": truncate_abstract(F.coalesce(_c(abstract), F.lit(DEFAULT_ABSTRACT))),
        "question": _c(question),
    }


def _render(pieces, vals) -> Column:
    return F.concat(*[vals[p] if p in SLOTS else F.lit(p) for p in pieces])


QUESTION_AT = TEMPLATE.index("question")
#: The literals between the head and the question, and after the question.
QUESTION_FRAME = TEMPLATE[QUESTION_AT - 1], "".join(TEMPLATE[QUESTION_AT + 1:])


def build_prompt(title="title", authors="authors", categories="categories",
                 abstract="abstract", question="question") -> Column:
    vals = prompt_inputs(title, authors, categories, abstract, question)
    return _render(TEMPLATE, vals)


def prompt_head(title="title", authors="authors", categories="categories", abstract="abstract") -> Column:
    """The paper's part of the prompt (everything before the question). Compute it once per
    paper, before pairing with questions, so each pair only appends its question."""
    vals = prompt_inputs(title, authors, categories, abstract, F.lit(None).cast("string"))
    return _render(TEMPLATE[:QUESTION_AT - 1], vals)


def prompt_from_head(head="prompt_head", question="question") -> Column:
    """Head + question tail: equal to ``build_prompt`` on the same inputs."""
    h = _c(head)
    tail = TEMPLATE[QUESTION_AT - 1:]
    return F.concat(h, *[_c(question) if p == "question" else F.lit(p) for p in tail])
