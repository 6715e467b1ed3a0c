"""Is it a table?  Tests on whole documents and on paragraphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: three marks on one line; three numbers on one line
PIPES = r"\|.*\|.*\|"
NUMBERS = r"(?m)^\s*[\d,.$%]+\s+[\d,.$%]+\s+[\d,.$%]+"
#: fixed values: of documents, the least characters and lines, pipes of a marked line, the share of
#: lines with equally many, the shares of marked lines (lenient, strict); of paragraphs, pipes, tabs
#: and lines of numbers that a text must exceed
LEAST_CHARS, LEAST_LINES, LINE_PIPES, EVEN, SHARES = 20, 2, 2, 0.7, (0.3, 0.2)
PARAGRAPH_PIPES, PARAGRAPH_TABS, PARAGRAPH_NUMBERS = 5, 10, 3


def pipes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))


def is_table_document(text: Column, strict: bool = False) -> Column:
    """Whether many lines have tabs or pipes, or most lines with pipes have equally
    many.  Texts under 20 characters or of one line aren't tables."""
    lines = F.split(text, "\n")
    counts = F.filter(F.transform(lines, pipes), lambda n: n > 0)
    tabs = F.size(F.filter(lines, lambda x: x.contains("\t")))
    marked = F.size(F.filter(counts, lambda n: n >= LINE_PIPES))
    often = F.array_max(F.transform(F.array_distinct(counts), lambda n: F.size(F.filter(counts, lambda m: m == n))))
    even = (marked > 0) & (F.size(counts) >= 2) & (often / F.size(counts) > EVEN)
    share = (tabs + marked) / F.size(lines)
    return F.when(text.isNull() | (F.length(text) < LEAST_CHARS) | (F.size(lines) < LEAST_LINES), F.lit(False)).otherwise((share > SHARES[strict]) | F.coalesce(even, F.lit(False)))


def is_table_paragraph(text: Column) -> Column:
    """Whether a paragraph has many pipes or tabs, a line of three pipes, or lines of
    three numbers."""
    tabs = F.length(text) - F.length(F.replace(text, F.lit("\t"), F.lit("")))
    return F.coalesce((pipes(text) > PARAGRAPH_PIPES) | (tabs > PARAGRAPH_TABS) | text.rlike(PIPES) | (F.regexp_count(text, F.lit(NUMBERS)) > PARAGRAPH_NUMBERS), F.lit(False))


def is_table_line(line: Column) -> Column:
    """Two pipes, two tabs, or two wide gaps."""
    tabs = F.length(line) - F.length(F.replace(line, F.lit("\t"), F.lit("")))
    return (pipes(line) >= 2) | (tabs >= 2) | (F.regexp_count(line, F.lit(r"\s{3,}")) >= 2)


def may_have_table_line(text: Column) -> Column:
    """False only if no line of a text can be a table line: without pipe, tab and wide gap.  Lines needn't
    be looked at then."""
    return text.contains("|") | text.contains("\t") | text.rlike(r"[^\S\n]{3}")
