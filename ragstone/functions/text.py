"""Text expressions: joining title and text, prompts, tokens, query classes."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\r\f\x0B"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(SPACE))


def title_text(title: Column, text: Column) -> Column:
    """Title and text with a space between; what is missing counts as empty."""
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))


def title_sentence(title: Column, text: Column) -> Column:
    """`title. text` if there are both, else the one there is."""
    t, x = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(text, F.lit("")))
    return F.when((t != "") & (x != ""), F.concat(t, F.lit(". "), x)).when(t != "", t).otherwise(x)


def title_bracket(title: Column, text: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(title, F.lit("")), F.lit("] "), text)


def title_lines(title: Column, text: Column, sep: str = "\n") -> Column:
    """Title, sep and text; the text alone without a title."""
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit(sep), text)).otherwise(text)


def prompted(text: Column, prompt: str | None) -> Column:
    return F.concat(F.lit(prompt), text) if prompt else text


def truncated(text: Column, chars: int = 2048) -> Column:
    return F.substring(text, 1, chars)


def words(text: Column) -> Column:
    """Lower-case tokens between white space."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\r]+"), "")


#: the endings that a treebank tokeniser cuts off
ENDINGS = r"('s|'m|'d|'ll|'re|'ve)\b"


def word_marks(text: Column) -> Column:
    """Tokens of plain prose, more simply than treebank.py has them: runs of letters and
    digits, single other marks, and the endings of contractions (do n't, it 's)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    parted = F.regexp_replace(F.regexp_replace(low, r"([a-z])(n't)\b", "$1 $2"), ENDINGS, " $1")
    return F.regexp_extract_all(parted, F.lit(r"n't|'(?:s|m|d|ll|re|ve)\b|[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0))


#: fixed values: classes of questions and the patterns that make them, searched anywhere
QUERY_PATTERNS = {
    "table_query": ["table", "row", "column", "financial statement", "balance sheet", "income statement", "cash flow", "compare.*(?:year|quarter)", "growth rate", "margin"],
    "specific_fact": ["what is", "how much", "when did", "specific", "exact", "number", "date", "amount"],
    "contextual": ["explain", "why", "describe", "discuss", "what are the implications", "how does.*affect", "relationship between"],
    "calculation": ["calculate", "compute", "sum", "total", "average", "ratio", "percentage", "formula"],
}
#: class -> chunk set, the first that applies
ROUTES = [("table_query", "table-aware"), ("specific_fact", "small"), ("contextual", "large")]


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _holds(low: Column, patterns: list[str]) -> Column:
    """Whether a lower-case text has any of the patterns; plain ones are searched as strings."""
    return reduce(or_, (low.contains(p) if re.fullmatch(r"[\w ]+", p) else low.rlike(p) for p in patterns))


def query_classes(text: Column) -> Column:
    """The classes of a question, in order; `general` without any."""
    each = once(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.array(*(F.when(_holds(low, p), F.lit(name)) for name, p in QUERY_PATTERNS.items())))
    return once(F.filter(each, lambda x: x.isNotNull()), lambda found: F.when(F.size(found) == 0, F.array(F.lit("general"))).otherwise(found))


def route(classes: Column) -> Column:
    """The chunk set that suits a question's classes."""

    def first(own: Column) -> Column:
        out = F.lit("medium")
        for name, to in reversed(ROUTES):
            out = F.when(F.array_contains(own, name), F.lit(to)).otherwise(out)
        return out

    return once(classes, first)


#: fixed values: words that call for more search terms, and those terms
ENHANCEMENTS = [("revenue|sales", " revenue total sales income"), ("profit|earnings", " net income earnings profit margin"), ("debt|liabilit", " total debt liabilities borrowings")]


def enhanced(text: Column) -> Column:
    """A question with the terms that its words call for."""
    out = text
    for words_, more in ENHANCEMENTS:
        out = F.concat(out, F.when(F.lower(text).rlike(words_), F.lit(more)).otherwise(""))
    return out
