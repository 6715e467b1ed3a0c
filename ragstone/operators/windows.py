"""Chunkers that are plain expressions: whole texts, word windows, character windows,
and both around table regions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragstone.functions.tables import is_table_line, may_have_table_line
from ragstone.functions.text import strip, title_lines

LEAST_WORDS, LEAST_CHARS = 50, 100
#: windows of characters that are cut from one stretch of a text
STRIP = 16


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is worked out once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def word_windows(text: Column, size: int = 512, overlap: int = 128) -> Column:
    """The text itself up to size words; else windows of size words every size -
    overlap words, without those under LEAST_WORDS."""

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - LEAST_WORDS, F.lit(0)), F.lit(size - overlap))
        parts = F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " "))
        return F.when(F.size(w) <= size, F.array(text)).otherwise(F.filter(parts, lambda x, i: F.size(w) - i * (size - overlap) >= LEAST_WORDS))

    return F.when(text.isNotNull(), _with(F.array_remove(F.split(text, "[ \t\n\r]+"), ""), cut))


def char_windows(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """The text itself up to size characters; else stripped windows every size -
    overlap characters until one reaches the end, without those under LEAST_CHARS."""
    n, step = F.length(text), size - overlap
    last = F.ceil((n - size) / F.lit(step)).cast("int")

    def cut(part: Column, j: Column) -> Column:
        first = j * STRIP
        return F.transform(F.sequence(first, F.least(first + STRIP - 1, F.greatest(last, F.lit(0)))), lambda i: strip(F.substring(part, (i - first) * step + 1, F.lit(size))))

    # a substring walks its text from the start, so windows are taken from strips of the text
    strips = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(last, F.lit(0)) / STRIP).cast("int")), lambda j: F.substring(text, j * (STRIP * step) + 1, F.lit((STRIP - 1) * step + size)))
    parts = F.flatten(F.transform(strips, cut))
    return F.when(n <= size, F.array(text)).otherwise(F.filter(parts, lambda p: F.length(p) >= LEAST_CHARS))


def windowed(docs: DataFrame, cut: Column, mark: str = "_c") -> DataFrame:
    """chunk_id, doc_id, chunk_index, total_chunks, text of docs (id, ...) for a column
    of pieces; numbers count the pieces that are kept."""
    pieces = docs.select(F.col("id").alias("doc_id"), cut.alias("parts"))
    out = pieces.select("doc_id", F.size("parts").alias("total_chunks"), F.posexplode("parts").alias("chunk_index", "text"))
    return out.select(F.concat(F.col("doc_id").cast("string"), F.lit(mark), F.col("chunk_index").cast("string")).alias("chunk_id"), "doc_id", "chunk_index", "total_chunks", "text")


def no_chunking(docs: DataFrame) -> DataFrame:
    return windowed(docs, F.array("text"), "_chunk_")


def _regions(lines: Column) -> Column:
    """The table regions (s, e: lines, half open) of a text's lines, in order, as an array.

    A run of table lines takes the line before it and the line after it; a run that
    ends within the text makes a region only if that has three lines or more."""

    def of(flags: Column) -> Column:
        n = F.size(flags)
        at = F.sequence(F.lit(0), n - 1)
        beside = lambda i: F.coalesce(F.get(flags, i), F.lit(False))
        first = F.filter(at, lambda i: F.get(flags, i) & ~beside(i - 1))
        last = F.filter(at, lambda i: F.get(flags, i) & ~beside(i + 1))

        def region(a: Column, b: Column) -> Column:
            return F.struct(F.greatest(a - 1, F.lit(0)).alias("s"), F.when(b == n - 1, n).otherwise(F.least(b + 2, n)).alias("e"))

        return F.filter(F.zip_with(first, last, region), lambda r: (r["e"] - r["s"] >= 3) | F.coalesce(F.get(flags, r["e"] - 1) & (r["e"] == n), F.lit(False)))

    return _with(F.transform(lines, is_table_line), of)


def _lined(docs: DataFrame, text: str) -> DataFrame:
    """docs with lines and regions beside the other columns."""
    regions = F.when(may_have_table_line(F.col(text)), _regions(F.col("lines"))).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
    return docs.withColumn("lines", F.split(text, "\n")).withColumn("regions", regions)


def table_regions(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, region_start, region_end (lines, half open) of docs (id, text); see _regions()."""
    found = _lined(docs.select(F.col("id").alias("doc_id"), F.col(text).alias("text")), "text").select("doc_id", F.explode("regions").alias("r"))
    return found.select("doc_id", F.col("r.s").alias("region_start"), F.col("r.e").alias("region_end"))


#: a text cut at its regions (columns lines, regions): before each region, the region, and what
#: follows the last one
_PARTS = """
    transform(filter(concat(flatten(transform(regions, (r, k) -> array(
        named_struct('s', if(k = 0, 0, regions[k - 1].e), 'e', r.s, 't', false), named_struct('s', r.s, 'e', r.e, 't', true)))),
        array(named_struct('s', if(size(regions) = 0, 0, element_at(regions, -1).e), 'e', size(lines), 't', false))), p -> p.e > p.s),
      p -> named_struct('t', p.t, 'body', array_join(slice(lines, p.s + 1, greatest(p.e - p.s, 0)), '\n')))"""


def _segments(docs: DataFrame, text: str) -> DataFrame:
    """docs with parts (t: is it a table, body): the text cut at its table regions, without
    blank text between them."""
    cut = _lined(docs, text).withColumn("parts", F.expr(_PARTS)).drop("lines", "regions")
    return cut.withColumn("parts", F.filter("parts", lambda p: p["t"] | (strip(p["body"]) != "")))


def _piece(table: bool | Column, text: Column) -> Column:
    return F.struct((F.lit(table) if isinstance(table, bool) else table).alias("t"), text.alias("x"))


def _region_chunks(docs: DataFrame, pieces: Column) -> DataFrame:
    """chunk_id (_t or _c with one count), doc_id, chunk_index, text, is_table of docs (id, parts):
    pieces gives the chunks of all parts of a row, in order."""
    out = docs.select(F.col("id").alias("doc_id"), F.posexplode(pieces).alias("chunk_index", "p"))
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("p.t"), "_t").otherwise("_c"), F.col("chunk_index").cast("string"))
    return out.select(name.alias("chunk_id"), "doc_id", "chunk_index", F.col("p.x").alias("text"), F.col("p.t").alias("is_table"))


def region_word_chunks(docs: DataFrame, size: int = 512, overlap: int = 128, preserve: bool = True) -> DataFrame:
    """Word windows around table regions of docs (id, title, text), every chunk with
    its title; texts under 500 characters aren't searched for tables.  A row's chunks are
    made within the row."""
    named = docs.select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    whole = F.array(F.struct(F.lit(False).alias("t"), F.col("text").alias("body")))
    rows = _segments(named, "text").withColumn("parts", F.when(F.length("text") < 500, whole).otherwise(F.col("parts"))) if preserve else named.withColumn("parts", whole)

    def one(p: Column) -> Column:
        title = F.col("title")
        plain = F.transform(word_windows(p["body"], size, overlap), lambda x: _piece(False, F.concat(F.lit("["), title, F.lit("] "), x)))
        return F.when(p["t"], F.array(_piece(True, F.concat(F.lit("[TABLE from "), title, F.lit("]\n"), p["body"])))).otherwise(plain)

    return _region_chunks(rows, F.flatten(F.transform("parts", one)))


def region_char_chunks(docs: DataFrame, size: int = 512, overlap: int = 50, preserve: bool = True) -> DataFrame:
    """Character windows around table regions of title and text; texts under one and a
    half times the size stay whole.  A row's chunks are made within the row."""
    full = docs.select("id", title_lines(F.col("title"), F.coalesce("text", F.lit(""))).alias("text"))
    rows = _segments(full, "text") if preserve else full.withColumn("parts", F.array(F.struct(F.lit(False).alias("t"), F.col("text").alias("body"))))

    def one(p: Column) -> Column:
        plain = F.transform(char_windows(p["body"], size, overlap), lambda x: _piece(False, x))
        return F.when(p["t"], F.array(_piece(True, F.concat(F.lit("[TABLE]\n"), p["body"])))).otherwise(plain)

    short = F.length("text") < size * 1.5
    return _region_chunks(rows, F.when(short, F.array(_piece(False, F.col("text")))).otherwise(F.flatten(F.transform("parts", one))))


def chunk_stats(chunks: DataFrame, *by: str) -> DataFrame:
    """Count and mean, least, greatest and population deviation of chunk lengths."""
    n = F.length("text")
    return chunks.groupBy(*by).agg(F.count("*").alias("chunks"), F.avg(n).alias("mean_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.stddev_pop(n).alias("std_chars"))


def expansion(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: docs, chunks, expansion."""
    d, c = docs.agg(F.count("*").alias("docs")), chunks.agg(F.count("*").alias("chunks"))
    return d.join(F.broadcast(c)).withColumn("expansion", F.col("chunks") / F.col("docs"))


def coverage(chunks: DataFrame, overlap: int) -> DataFrame:
    """doc_id, covered: characters of all chunks less the overlaps between them."""
    return chunks.groupBy("doc_id").agg((F.sum(F.length("text")) - (F.count("*") - 1) * overlap).alias("covered"))


def length_stats(docs: DataFrame) -> DataFrame:
    n = F.length("text")
    return docs.agg(F.count("*").alias("docs"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.avg(n).alias("mean_chars"), F.median(n).alias("median_chars"),
                    F.count_if(n > 1000).alias("over_1000"), F.count_if(n > 2000).alias("over_2000"), F.count_if(n < 500).alias("under_500"))
