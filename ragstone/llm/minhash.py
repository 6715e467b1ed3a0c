"""Operator 4: near-duplicate detection by fast similarity sketching.

1. Every row's text becomes its set of word shingles (64-bit hashes), and the set a
   sketch: rounds of hashed bin placement, of which the last fill every coordinate
   for certain (`sketches`).  Bands of coordinates are the bucket keys.
2. Rows of one set form a class (exact copies meet in a map-side combined
   aggregate, never as pairs); from here on numbered classes stand for their rows.
3. In a bucket of two classes or more every member meets one pivot only.  The
   links found so give the first components.
4. What a pivot leaves open among the classes of such buckets is settled exactly:
   two sets of the similarity asked for share an element of their prefixes, the few
   elements of each that are rarest among all these sets.  An element that only one
   component holds is dropped; of the others, those outside the element's main
   component meet the rest, and of these pairs only the ones whose sizes and places
   still allow the similarity go on.  A set whose own elements fill its prefix meets
   nobody, so a large group of loosely related texts doesn't give its pairs.
5. Every link is confirmed on the full sets.
6. Components: least labels along links with pointer jumping, all in tables.

Sides of a join on a key that may be hot (bucket, element, label, class) are
written first, so that the engine can split a large key over tasks.  Sets are
rebuilt for the classes of step 3 only; a bit map of bounded size tells which rows
to rebuild, and a join removes its false hits.

Edge cases: null texts and texts without words have an empty set, link with
nothing and stay; null doc_ids are never the smallest of a component that has
others; rows that repeat a doc_id each get their row, and each is grouped by its own
text; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ragstone.llm.common import WordCache, free_name, id_map, id_spot, in_map, kept_rows, slices, table, utf8_values, written

#: coordinates of a band
ROWS = 5
#: probability that a pair at the threshold shares no band, at most
MISS = 1e-8
MASK = (1 << 48) - 1
#: columns of 64 parities: how many of a set's elements hash to a bit, odd or even
PARITY = ("p0", "p1", "p2", "p3")


def bands_for(threshold: float) -> int:
    """Bands that meet MISS for pairs at the threshold."""
    return math.ceil(math.log(MISS) / math.log1p(-(threshold**ROWS)))


_ASCII_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_WORDS = WordCache(xxhash.xxh3_64_intdigest)


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles, one after the
    other, and the bounds of each text's part."""
    _WORDS.trim()
    words = [t.translate(_ASCII_LOWER).split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    h = np.fromiter((x for w in words for x in map(_WORDS.__getitem__, w)), np.uint64, int(n.sum()))
    ends = np.cumsum(n)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(texts)), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ends - n, count)
    span = np.minimum(n, size)[doc]
    value = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64) + span.astype(np.uint64)
    for k in range(size):
        inside = k < span
        step = np.where(inside, h[np.minimum(at + k, max(len(h) - 1, 0))] if len(h) else 0, 0).astype(np.uint64)
        value = np.where(inside, mix(value * np.uint64(0x9FB21C651E98DF25) + step), value)
    value = value.view(np.int64)
    cuts = np.concatenate([[0], np.cumsum(count)]).tolist()
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        value[low:high].sort()
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[fresh].view(np.uint64), np.concatenate([[0], np.cumsum(np.bincount(doc[fresh], minlength=len(texts)))])


def sketches(elements: np.ndarray, bounds: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches, a row of t 64-bit values for each set.

    In round i every element of a set is hashed to a bin and a value; a bin keeps
    the least (round, value) that fell into it.  From round t on the bin is i - t
    for every element, so after 2t rounds at most each coordinate of a non-empty
    set is filled.  Only sets with an empty bin go on to the next round, which for
    a set of n elements ends after about t log(t) / n rounds."""
    n = np.diff(bounds)
    out = np.full((len(n), t), np.iinfo(np.uint64).max, np.uint64)
    rows = np.flatnonzero(n > 0)
    own = np.repeat(np.arange(len(n)), n)
    x = elements
    for i in range(2 * t):
        if not len(rows):
            break
        h = mix(x ^ mix(np.array([i * 0x632BE59BD9B4E019 & (1 << 64) - 1], np.uint64)))
        bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(x), i - t)
        value = (np.uint64(i) << np.uint64(48)) | (mix(h) & np.uint64(MASK))
        np.minimum.at(out.reshape(-1), own * t + bins, value)
        empty = (out[rows] == np.iinfo(np.uint64).max).any(axis=1)
        if not empty.all():
            rows = rows[empty]
            live = np.zeros(len(n), bool)
            live[rows] = True
            keep = live[own]
            own, x = own[keep], x[keep]
    return out


def bands(sketch: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each band, the band's number included."""
    count = sketch.shape[1] // ROWS
    parts = sketch.reshape(len(sketch), count, ROWS)
    key = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(sketch), count)).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + parts[:, :, r])
    return key.view(np.int64)


def _digests(elements: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    return [xxhash.xxh3_128_digest(elements[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def sketched(docs: DataFrame, size: int, count: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set and its bands."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            elements, bounds = shingle_sets(utf8_values(batch.column("text")), size)
            sketch = sketches(elements, bounds, count * ROWS)
            n = np.diff(bounds)
            keys = bands(sketch)
            offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * count)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(_digests(elements, bounds), pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], ["doc_id", "n_shingles", "digest", "bands"])

    return _slim(docs).mapInArrow(rows, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def parities(elements: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of len(PARITY) 64-bit values for each set.  Two sets differ in at least as
    many elements as their rows differ in bits."""
    width = 64 * len(PARITY)
    odd = np.zeros((len(bounds) - 1, width), np.uint8)
    for row, a, b in zip(odd, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        row[:] = np.bincount((elements[a:b] & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd, axis=1).view(np.int64)


def _full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(class, n, elements, parities) of the wanted classes (class, digest, rep): their
    representatives' sets, rebuilt from the texts."""
    mask, bits = id_map(wanted, "rep")
    sent = docs.sparkSession.sparkContext.broadcast(mask)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = sent.value
        for batch in batches:
            hit = in_map(mask, batch.column("spot").to_numpy())
            hit |= batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            for part in slices(iter([batch.filter(pa.array(hit))]), "text", 1 << 20):
                elements, bounds = shingle_sets(utf8_values(part.column("text")), size)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_digests(elements, bounds), pa.binary()), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(elements.view(np.int64))), *map(pa.array, np.ascontiguousarray(parities(elements, bounds).T))], ["rep", "digest", "n", "elements", *PARITY])

    found = _slim(docs).withColumn("spot", id_spot("doc_id", bits)).mapInArrow(rows, "rep long, digest binary, n long, elements array<long>, " + ", ".join(f"{p} long" for p in PARITY))
    # one row of a class, should several have its least doc_id
    same = (F.col("own.digest") == F.col("found.digest")) & F.col("own.rep").eqNullSafe(F.col("found.rep"))
    return found.alias("found").join(wanted.alias("own"), same).select("class", "n", "elements", *PARITY).dropDuplicates(["class"])


def _confirmed(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= per_cent * union of their full sets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                both = np.concatenate([x.values.to_numpy(), y.values.to_numpy()])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= per_cent * (len(both) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("class").alias("a"), F.col("elements").alias("x"), F.col("n").alias("na"))
    two = sets.select(F.col("class").alias("b"), F.col("elements").alias("y"), F.col("n").alias("nb"))
    sized = 100 * F.least("na", "nb") >= per_cent * F.greatest("na", "nb")
    return pairs.join(one, "a").join(two, "b").where(sized).select("a", "b", "x", "y").mapInArrow(rows, "a long, b long")


def components(edges: DataFrame, rows: float, start: DataFrame | None = None) -> DataFrame:
    """(node, label) for every node of the edges (a, b): the least node that it is
    connected with.  Each round takes the least label among a node's neighbours, then
    the label of that label, so a path of n nodes needs about log n rounds.
    rows: about how many nodes and edges there are.  start: (node, label) that some of
    the edges are known to give."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links", rows)
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    if start is not None:
        labels = labels.join(start, "node", "left").withColumn("low", F.least("low", "label"))
    labels = written(labels.select("node", F.least("node", "low").alias("label")), "labels", rows)
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("label").alias("seen"))
        low = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("low"))
        hung = labels.join(low, "node").select("node", "label", F.least("label", "low").alias("next"))
        further = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        moved = written(hung.join(further, "next", "left").select("node", F.least("next", F.coalesce("jump", "next")).alias("new"), "label"), "labels", rows)
        labels = moved.select("node", F.col("new").alias("label"))
        if moved.where("new <> label").isEmpty():
            return labels


def _rest(sets: DataFrame, labels: DataFrame, per_cent: int, rows: float) -> DataFrame:
    """Pairs (a, b) of classes with different labels that may have the similarity: all
    pairs that have it are among them, and no pair is whose sizes, places or parities
    rule it out.

    In one order of all elements, from rare to frequent, two such sets share an element
    of their first n - ceil(per_cent * n / 100) + 1.  Where they first meet, the smaller
    number of elements that is left must still hold the intersection.  rows: about how
    many elements the sets have together."""
    each = sets.select("class", "n", F.explode("elements").alias("element"))
    # an element of one set only keeps its place in the order, and nobody is met there
    shared = written(each.groupBy("element").agg(F.count("*").alias("often")).where("often > 1"), "often", rows)
    order = F.array_sort(F.collect_list(F.struct("often", "element")))
    mine = each.join(shared, "element").groupBy("class", "n").agg(order.alias("order"))
    alone = F.col("n") - F.size("order")
    prefix = F.col("n") - F.ceil(per_cent * F.col("n") / 100) + 1
    mine = mine.select("class", "n", alone.cast("long").alias("alone"), F.slice("order", 1, F.greatest(prefix - alone, F.lit(0)).cast("int")).alias("order"))
    places = mine.select("class", "n", "alone", F.posexplode("order").alias("pos", "e")).select("class", "n", (F.col("alone") + F.col("pos")).alias("at"), F.col("e.element").alias("element"))
    known = sets.select("class", *PARITY).join(labels.select(F.col("node").alias("class"), "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    places = written(places.join(known, "class"), "places", rows)
    held = places.groupBy("element", "label").agg(F.count("*").alias("k")).groupBy("element").agg(F.max("k").alias("k"), F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("labels"))
    met = written(places.join(written(held.where("labels > 1").select("element", "main"), "elements", rows), "element"), "places", rows)
    odd = met.where("label <> main").select("element", F.col("class").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("at").alias("ata"), *(F.col(p).alias(f"{p}a") for p in PARITY))
    every = met.select("element", F.col("class").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("at").alias("atb"), "main", *(F.col(p).alias(f"{p}b") for p in PARITY))
    # two classes outside the main component meet once
    once = (F.col("la") != F.col("lb")) & ((F.col("lb") == F.col("main")) | (F.col("a") < F.col("b")))
    both = F.col("na") + F.col("nb")
    left = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) * (100 + per_cent) >= per_cent * both
    differ = sum((F.bit_count(F.col(f"{p}a").bitwiseXOR(F.col(f"{p}b"))) for p in PARITY[1:]), F.bit_count(F.col("p0a").bitwiseXOR(F.col("p0b"))))
    may = once & left & ((both - differ) * (100 + per_cent) >= 2 * per_cent * both)
    return odd.join(every, "element").where(may).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _grouped(docs: DataFrame, size: int, per_cent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): doc_id, n_shingles and digest of every row; of each class of rows
    with one non-empty set its digest, the least doc_id of its rows (rep), that of its
    component (low), and whether it is the component's first class with that one."""
    count = bands_for(per_cent / 100)
    rows = written(sketched(docs, size, count), "sketches")
    many, elements = rows.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    classes = rows.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    # numbers of rows hold once they are written; a row has as many numbers as bands
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "classes", count * many)
    keyed = classes.select("class", F.explode("bands").alias("bucket"))
    pivots = written(keyed.groupBy("bucket").agg(F.min("class").alias("a"), F.count("*").alias("k")).where("k > 1").select("bucket", "a"), "buckets", count * many)
    pairs = written(keyed.join(pivots, "bucket").where("a <> class").select("a", F.col("class").alias("b")).distinct(), "pairs", count * many)
    names = classes.select("class", "digest", "rep")
    several = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    several = written(names.join(several, "class", "left_semi"), "several", many)
    elements *= several.count() / max(many, 1)
    sets = written(_full_sets(docs, several, size), "sets", elements)
    links = written(_confirmed(pairs, sets, per_cent), "links", elements)
    labels = components(links, many)
    more = written(_rest(sets, labels, per_cent, elements), "pairs", elements)
    more = written(_confirmed(more, sets, per_cent), "links", elements)
    labels = written(components(links.unionByName(more), many, labels).withColumnRenamed("node", "class"), "components", many)
    joined = labels.join(names, "class")
    low = joined.groupBy("label").agg(F.min("rep").alias("low"), F.min(F.when(F.col("rep").isNotNull(), F.struct("rep", "class"))).alias("with_id"), F.min("class").alias("any"))
    low = written(low.select("label", "low", F.coalesce(F.col("with_id.class"), F.col("any")).alias("first")), "least", many)
    known = written(labels.join(low, "label").select("class", "low", "first"), "known", many)
    named = names.join(known, "class", "left").select("digest", "rep", F.coalesce("low", "rep").alias("low"), F.coalesce(F.col("first") == F.col("class"), F.lit(True)).alias("first"))
    return rows.select("doc_id", "n_shingles", "digest"), written(named, "named", many)


def near_duplicates(docs: DataFrame, *, size: int = 5, per_cent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text):
    documents whose sets of size-word shingles have a Jaccard similarity of per_cent /
    100 at least are linked, component_id is the least doc_id reachable."""
    rows, classes = _grouped(docs, size, per_cent)
    done = rows.join(classes, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("low")).otherwise(F.col("doc_id"))
    return done.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, *, size: int = 5, per_cent: int = 80) -> DataFrame:
    """docs with one row of each component, all columns: a row of its least doc_id (of
    any, where no row has one).  Rows without words all stay.

    Rows are told apart by doc_id and the digest of their set.  Only those that have
    no doc_id or one in a bit map of the ids to look at are sketched again and shuffled."""
    rows, classes = _grouped(docs, size, per_cent)
    looked = rows.join(classes, "digest", "left").select("doc_id", "digest", (F.col("n_shingles") == 0).alias("empty"), (F.col("first") & F.col("doc_id").eqNullSafe(F.col("rep"))).alias("stays"))
    looked = written(looked.groupBy("doc_id", "digest").agg(F.max(F.col("empty") | F.col("stays")).alias("stays"), F.max("empty").alias("empty"), F.count("*").alias("n")), "looked", rows.count())
    special = looked.where("doc_id is not null and (not stays or n > 1 and not empty)").select("doc_id").distinct()
    mask, bits = id_map(special, "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(mask)
    columns, spot, name = docs.columns, free_name(docs, "spot"), free_name(docs, "digest")
    spotted = docs.withColumn(spot, F.when(F.col("doc_id").isNotNull(), id_spot("doc_id", bits)))

    def inside(batch: pa.RecordBatch) -> np.ndarray:
        own = batch.column(spot)
        return in_map(sent.value, own.fill_null(0).to_numpy()) | own.is_null().to_numpy(zero_copy_only=False)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch.filter(pa.array(inside(batch)))]), "text", 1 << 20):
                elements, bounds = shingle_sets(utf8_values(part.column("text").cast(pa.string())), size)
                digest = [d if n else None for d, n in zip(_digests(elements, bounds), np.diff(bounds).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(digest, pa.binary())], [*columns, name])

    rest = kept_rows(spotted, lambda batch: ~inside(batch)).select(columns)
    odd = spotted.mapInArrow(digested, StructType([*docs.schema.fields, StructField(name, BinaryType())]))
    stay = looked.where("stays and not empty").select(F.col("doc_id").alias("id"), F.col("digest").alias("d"))
    chosen = odd.where(F.col(name).isNotNull()).dropDuplicates(["doc_id", name])
    chosen = chosen.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col("id")) & (F.col(name) == F.col("d")), "left_semi")
    return rest.unionByName(odd.where(F.col(name).isNull()).drop(name)).unionByName(chosen.drop(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents, three-word shingles, similarity of 0.85 and more."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, per_cent=85)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
