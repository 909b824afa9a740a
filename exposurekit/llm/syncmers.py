"""Document fingerprints from closed syncmers over words, with built-in functions only.

A k-mer is ``k`` words in a row; of its inner substrings of ``s`` words, the one with
the smallest hash must be the first or the last for the k-mer to be an anchor. That
depends on the k-mer alone, so a passage has the same anchors wherever it stands.
Every run of ``k - s + 1`` k-mers has an anchor.

A fingerprint is the ``SKETCH`` smallest distinct anchor hashes (32 bits each, as
hex); the likeness of two fingerprints estimates the share of anchors in common from
the smallest ones of both.

Null text is empty. A text without words has the empty fingerprint, which is like
itself (1) and unlike any other (0). A text of fewer than ``k`` words, or without an
anchor, has one anchor made of all its words. The document after one with a missing
doc_id goes by the same order: missing first, equal doc_ids by a hash of the text. One
row alone is its own next document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from ..operators.ordinal import MAX_VALUE_BUCKETS, constant_array, value_bucket, value_limits
from .common import stored

K = 5
S = 2
SKETCH = 64
ROWS_PER_BUCKET = 1_000

WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _positions(last: Column) -> Column:
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Anchors of a text in order: array of (position in words, hash)."""

    def of_hashes(h: Column) -> Column:
        inner = F.transform(_positions(F.size(h) - s), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(s)]))
        return let(inner, lambda m: let(_closed(m), lambda found: of_found(h, found)))

    def _closed(m: Column) -> Column:
        edge = k - s
        between = [lambda i, j=j: F.get(m, i + j) for j in range(1, edge)]

        def keep(i: Column) -> Column:
            ends = F.least(F.get(m, i), F.get(m, i + edge))
            return ends <= (F.least(*[g(i) for g in between]) if len(between) > 1 else between[0](i) if between else ends)

        return F.filter(_positions(F.size(m) - 1 - edge), keep)

    def of_found(h: Column, found: Column) -> Column:
        whole = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(h).alias("hash")))
        some = F.transform(found, lambda i: F.struct(i.alias("at"), F.xxhash64(*[F.get(h, i + j) for j in range(k)]).alias("hash")))
        return F.when(F.size(found) > 0, some).when(F.size(h) > 0, whole).otherwise(F.array().cast("array<struct<at:int,hash:bigint>>"))

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def sketch(found: Column, size: int = SKETCH) -> Column:
    """The ``size`` smallest distinct anchor hashes, as numbers of 32 bits."""
    short = F.transform(found, lambda a: F.shiftrightunsigned(a["hash"], 32))
    return F.slice(F.sort_array(F.array_distinct(short)), 1, size)


def fingerprint(sketched: Column) -> Column:
    return F.array_join(F.transform(sketched, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column, size: int = SKETCH) -> Column:
    """Share of the smallest hashes of both sketches that are in both; two empty ones are alike."""
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    return let(
        least,
        lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)),
    )


def shared_passages(a: Column, b: Column) -> Column:
    """Positional matches of two arrays of anchors: (place in a, place in b) wherever both have the same hash."""
    pairs = F.transform(a, lambda x: F.transform(F.filter(b, lambda y: y["hash"] == x["hash"]), lambda y: F.struct(x["at"].alias("a"), y["at"].alias("b"))))
    return F.flatten(pairs)


def by_neighbours(docs: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, WindowSpec]:
    """Rows and a window in which ``lead`` gives the next row by doc_id; after the last comes the first.

    Rows go to buckets that follow doc_id: limits from a quantile sketch, each range cut
    evenly as often as the number of rows asks for. The first row of every bucket is
    also sent to the bucket before, with ``_extra`` = 1, so no row needs another bucket.
    """
    limits = value_limits(docs, "doc_id", rows_per_bucket)
    count, low, high = docs.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    fine = max(1, -(-count // (rows_per_bucket * MAX_VALUE_BUCKETS)))
    edges = [low or 0, *limits, (high or 0) + 1]
    coarse = value_bucket(F.col("doc_id"), limits, T.LongType())

    def split(b: Column) -> Column:
        if fine == 1:
            return b.cast("long")
        ladder = constant_array(edges, T.LongType())
        start, end = F.get(ladder, b), F.get(ladder, b + 1)
        part = F.least(F.floor((F.col("doc_id") - start) / F.greatest(end - start, F.lit(1)) * fine), F.lit(fine - 1))
        return b.cast("long") * fine + F.coalesce(F.greatest(part, F.lit(0)), F.lit(0))

    keyed = docs.withColumn("_tie", F.xxhash64(*[c for c in docs.columns if c != "doc_id"])).withColumn("_bucket", let(coarse, split))
    firsts = keyed.groupBy("_bucket").agg(F.min(F.struct("doc_id", "_tie")).alias("_first"))
    before = F.lag("_bucket").over(Window.orderBy("_bucket"))  # one row per bucket
    firsts = firsts.withColumn("_to", F.coalesce(before, F.max("_bucket").over(Window.partitionBy())))
    firsts = stored(firsts, "bucket-firsts")
    again = keyed.join(firsts, "_bucket").filter(F.col("_first").eqNullSafe(F.struct("doc_id", "_tie")))
    again = again.dropDuplicates(["_bucket"]).withColumn("_bucket", F.col("_to")).select(*keyed.columns, F.lit(1).alias("_extra"))
    along = Window.partitionBy("_bucket").orderBy("_extra", F.asc_nulls_first("doc_id"), "_tie")
    rows = keyed.withColumn("_extra", F.lit(0)).unionByName(again)
    return rows, along


def fingerprints(docs: DataFrame, k: int = K, s: int = S, size: int = SKETCH) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how like they and the next document's are.

    Edited: the last quarter of the code points replaced by as many first ones of the
    next document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows, along = by_neighbours(docs)
    rows = rows.withColumn("own", sketch(anchors(F.col("text"), k, s), size))
    rows = rows.withColumn("next_text", F.lead("text").over(along)).withColumn("next_own", F.lead("own").over(along)).filter("_extra = 0")
    n = F.length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - tail), F.substring("next_text", F.lit(1), tail))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own")
    both = F.struct(F.sha2("edited", 256).alias("sha"), sketch(anchors(F.col("edited"), k, s), size).alias("sketch"))
    rows = rows.withColumn("edit", F.explode(F.array(both)))
    return rows.select(
        "doc_id",
        "n_chars",
        F.col("edit.sha").alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("edit.sketch")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit.sketch"), size).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own"), size).alias("near_next"),
    )
