"""Words as a treebank has them, sentence by sentence.

A sentence goes through rewrite rules in order, which set quotes, marks, brackets and the endings of
contractions apart by spaces, and is cut at white space.  A full stop is set apart at a
sentence's end only, so `3.14`, `U.S.` and `state-of-the-art` stay whole.

Where sentences end is learnt from the corpus without labels: a type (word without its
last full stop) is an abbreviation if it has that full stop far more often than chance would
give it, weighed by its shortness and by full stops inside it (`abbreviations`).  After
any other full stop, and after ? and !, white space ends a sentence.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragstone.functions.text import once

#: fixed values: the treebank's conventions as (pattern, replacement), in order.  The
#: rule marked by FINAL applies at the end of a sentence only.
FINAL = r"""([^.])(\.)([\])}>"']*)\s*$"""
RULES = [
    # opening quotes
    (r'^"', "``"), (r"(``)", r" \1 "), (r"""([ (\[{<])("|'{2})""", r"\1 `` "),
    # marks
    (r"([:,])([^\d])", r" \1 \2"), (r"([:,])$", r" \1 "), (r"\.\.\.", " ... "), (r"([;@#$%&])", r" \1 "), (FINAL, r"\1 \2\3 "), (r"([?!])", r" \1 "), (r"([^'])' ", r"\1 ' "),
    # brackets and dashes
    (r"([\]\[(){}<>])", r" \1 "), (r"--", " -- "),
]
#: after a space is put at both ends: closing quotes, endings, words that are two
ENDINGS = [
    (r'"', " '' "), (r"(\S)('')", r"\1 \2 "), (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"\1 \2 "), (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 "),
    (r"(?i)\b(can)(not)\b", r" \1 \2 "), (r"(?i)\b(d)('ye)\b", r" \1 \2 "), (r"(?i)\b(gim)(me)\b", r" \1 \2 "), (r"(?i)\b(gon)(na)\b", r" \1 \2 "), (r"(?i)\b(got)(ta)\b", r" \1 \2 "),
    (r"(?i)\b(lem)(me)\b", r" \1 \2 "), (r"(?i)\b(more)('n)\b", r" \1 \2 "), (r"(?i)\b(wan)(na)\s", r" \1 \2 "), (r"(?i) ('t)(is)\b", r" \1 \2 "), (r"(?i) ('t)(was)\b", r" \1 \2 "),
]
#: how many of the rules come first, for opening quotes and for closing ones with endings; what the words that are two look like
QUOTES, CLOSED, TWO = 3, 4, ("cannot", "d'ye", "gimme", "gonna", "gotta", "lemme", "more'n", "wanna", "'tis", "'twas")
#: where a sentence may end: a mark and what closes with it, before white space
END = r"""([.?!]["')\]}]{0,3})[ \t\n\r\f]+"""
#: what may stand around a word
OPENING, CLOSING = r"""^["'(\[{`]+""", r"""["')\]},;:]+$"""
#: fixed values: the least score of an abbreviation, and how often one has its full stop
LEAST, SURE = 0.3, 0.99
#: abbreviations that a tokenising expression may hold
MOST = 20_000
_SEP = "\x01"


def _rewritten(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        for n in "0123":
            to = to.replace(f"\\{n}", f"${n}")
        text = F.regexp_replace(text, pattern, to)
    return text


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[ \t\n\r\f]+"), "")


def _asked(text: Column, rules: list[tuple[str, str]], *marks: str) -> Column:
    """The rules over a text that has one of the marks (lower-case), without which none applies."""
    return once(text, lambda t: F.when(once(F.lower(t), lambda low: reduce(or_, (low.contains(m) for m in marks))), _rewritten(t, rules)).otherwise(t))


def treebank(sentence: Column, ends: bool = True) -> Column:
    """The words of one sentence (or, without ends, of a part before its end)."""
    marks = _rewritten(_asked(sentence, RULES[:QUOTES], '"', "``", "''"), [r for r in RULES[QUOTES:] if ends or r[0] != FINAL])
    closed = _asked(F.concat(F.lit(" "), marks, F.lit(" ")), ENDINGS[:CLOSED], '"', "'")
    return _words(_asked(closed, ENDINGS[CLOSED:], *TWO))


def _parts(text: Column) -> Column:
    """What lies between possible ends of sentences."""
    return F.split(_rewritten(F.coalesce(text, F.lit("")), [(END, r"\1" + _SEP)]), _SEP)


def _goes_on(part: Column, known: Column) -> Column:
    """Whether no sentence ends after a part: its last word is an abbreviation, a letter with
    its full stop, or dots."""
    word = F.regexp_replace(F.regexp_extract(part, r"(\S+)$", 1), OPENING, "")

    def so(word: Column) -> Column:
        stem = F.lower(F.regexp_replace(word, r"\.$", ""))
        return word.endswith(".") & (word.endswith("..") | stem.rlike(r"^\p{L}$") | F.array_contains(known, stem))

    return once(word, so)


def sentences(text: Column, known: Iterable[str] = ()) -> Column:
    """The sentences of a text, given the abbreviations that are known."""
    known = _list(known)
    each = F.transform(_parts(text), lambda x: F.concat(x, F.when(_goes_on(x, known), " ").otherwise(_SEP)))
    return F.array_remove(F.transform(F.split(F.array_join(each, ""), _SEP), lambda x: F.trim(x)), "")


def treebank_words(text: Column, known: Iterable[str] = ()) -> Column:
    """The words of a text, sentence by sentence, given the abbreviations that are known."""
    known = _list(known)
    each = lambda parts: F.transform(parts, lambda x, i: F.when((i < F.size(parts) - 1) & _goes_on(x, known), treebank(x, False)).otherwise(treebank(x)))
    return F.flatten(once(_parts(text), each))


def _list(known: Iterable[str]) -> Column:
    known = sorted(known)
    if len(known) > MOST:
        raise ValueError(f"{len(known)} abbreviations are more than an expression may hold; ask abbreviations() for a higher least score")
    return F.lit(known) if known else F.array().cast("array<string>")


def abbreviations(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """token, n, with_stop, score of the types of docs (text) that are abbreviations.  Types are counted
    before they are shuffled; the score is a log-likelihood ratio of two rates of full stops, the
    corpus's and SURE, times e to the minus letters, full stops inside and after, and letters to the minus
    occurrences without."""
    words = docs.select(F.explode(_words(F.coalesce(F.col("text"), F.lit("")))).alias("w"))
    typed = words.select(F.lower(F.regexp_replace(F.regexp_replace("w", OPENING, ""), CLOSING, "")).alias("w")).select(F.regexp_replace("w", r"\.$", "").alias("token"), F.col("w").endswith(".").alias("stop")).where(F.col("token").rlike(r"^\p{L}[\p{L}.]*$"))
    counts = typed.groupBy("token").agg(F.count("*").alias("n"), F.count_if("stop").alias("with_stop"))
    total = counts.agg(F.sum("n").alias("all_n"), F.sum("with_stop").alias("all_stops"))
    n, k, p = F.col("n"), F.col("with_stop"), F.col("all_stops") / F.col("all_n")
    chance = k * F.log(p) + (n - k) * F.log(1 - p)
    sure = k * F.log(F.lit(SURE)) + (n - k) * F.log(F.lit(1 - SURE))
    dots = F.length("token") - F.length(F.replace("token", F.lit("."), F.lit("")))
    letters = (F.length("token") - dots).cast("double")
    score = -2 * (chance - sure) * F.exp(-letters) * (dots + 1) * F.pow(letters, (k - n).cast("double"))
    found = counts.where("with_stop > 0").join(F.broadcast(total)).where("all_stops < all_n").withColumn("score", score)
    return found.where(F.col("score") >= least).select("token", "n", "with_stop", "score")
