"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints that differ in at most ``max_bits`` bits, cut into enough segments
(``max_bits // 2 + 1``), have a segment that differs in at most one bit. Every distinct
fingerprint is indexed under each segment with each one of its bits left out; equal
keys are joined and the pairs verified on all 64 bits.

Buckets with more than ``BUCKET`` members are not expanded into pairs. For up to two
bits their members are linked through the points that differ from them in at most one
bit: two fingerprints have such a point in common exactly if they differ in at most two
bits, so each point's smallest member stands for the others. For more than two bits,
every member's links are looked for under ``max_bits + 1`` whole segments instead.

Joins of these rows sort and merge at any size: Spark takes a table of signatures for
as small as that of the fingerprints, of which each gives 64, and would broadcast it.

Null texts and texts without words have fingerprint 0, which links like any other.
Repeated rows share a fingerprint. Missing ids count as no id: ``component_id`` is the
smallest id that is there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, MERGE, SPACES, byte_view, map_slices, stored, word_spans
from .components import components

BUCKET = 32
SEED = 42


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): a bit is set if more than half of the shingles' XXH64 have it."""

    def make():
        import xxhash

        digest = xxhash.xxh64_intdigest

        def work(rows: pa.RecordBatch) -> pa.RecordBatch:
            data, offsets = byte_view(rows.column("text"))
            starts, ends, first = word_spans(data, offsets, SPACES)
            out = np.zeros(rows.num_rows, np.uint64)
            if len(starts):
                lengths = ends - starts
                # words of all rows with one space between them
                line = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
                line[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = LOWER[data[~SPACES[data]]]
                line = line.tobytes()
                word_end = np.cumsum(lengths + 1) - 1
                word_start = word_end - lengths
                words = np.diff(first)
                count = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
                owner = np.repeat(np.arange(len(words)), count)
                low = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                high = low + np.minimum(shingle, words[owner]) - 1
                spans = zip(word_start[low].tolist(), word_end[high].tolist())
                hashes = np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, len(owner))
                filled = np.flatnonzero(count)
                begin = (np.cumsum(count) - count)[filled].tolist()
                for row, at, n in zip(filled.tolist(), begin, count[filled].tolist()):
                    bits = np.unpackbits(hashes[at : at + n].view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
                    major = 2 * bits.sum(axis=0, dtype=np.int64) > n
                    out[row] = np.packbits(major, bitorder="little").view(np.uint64)[0]
            return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

        return work

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, fp long")


def segments(count: int) -> list[tuple[int, int]]:
    """First bit and width of every segment of 64 bits."""
    cuts = [64 * i // count for i in range(count + 1)]
    return [(low, high - low) for low, high in zip(cuts, cuts[1:])]


def _segment(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1).cast("long"))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _hole(first: Column, bits: Column) -> Callable[[Column], Column]:
    return lambda i: F.struct((first + i).alias("hole"), bits.bitwiseAND(F.bitwise_not(_bit(i))).alias("rest"))


def variants(prints: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """(segment, hole, rest, fp): every segment with each of its bits left out."""
    rows = [
        F.transform(F.sequence(F.lit(0), F.lit(width - 1)), _hole(F.lit(64 * s), _segment(F.col("fp"), low, width)))
        for s, (low, width) in enumerate(parts)
    ]
    return prints.select("fp", F.explode(F.concat(*rows)).alias("k")).select("k.hole", "k.rest", "fp")


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _bucket_sizes(keyed: DataFrame, key: list[str]) -> DataFrame:
    return keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def links(prints: DataFrame, max_bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp``, at most ``max_bits`` apart, that connect all such pairs."""
    parts = segments(max_bits // 2 + 1)
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # small rows that become 64 each, not to be put together before; by a hash of its own, or Spark takes the shuffle for spare
    keyed = variants(prints.repartition(tasks, F.xxhash64(F.lit("spread"), "fp")), parts)
    sizes = _bucket_sizes(keyed, ["hole", "rest"])
    shared = stored(keyed.hint(MERGE).join(sizes, ["hole", "rest"]), "simhash-buckets")
    few = shared.filter(F.col("n") <= bucket).drop("n")
    pairs = (
        few.withColumnRenamed("fp", "a")
        .hint(MERGE)
        .join(few.withColumnRenamed("fp", "b"), ["hole", "rest"])
        .filter((F.col("a") < F.col("b")) & (_apart("a", "b") <= max_bits))
        .select("a", "b")
    )
    crowd = shared.filter(F.col("n") > bucket).select("fp").distinct()
    if max_bits <= 2:
        return pairs.unionByName(_stars(crowd, max_bits))
    return pairs.unionByName(_whole_segments(crowd, max_bits))


def _stars(crowd: DataFrame, max_bits: int) -> DataFrame:
    """Members that have a point within one bit in common, linked to the smallest of them.

    At two bits apart two members share the points between them, at one bit each other;
    for one bit apart the points are members themselves, for none there are none.
    """
    if max_bits == 0:
        return crowd.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(_bit(i)))
    if max_bits == 1:
        near = crowd.select(F.col("fp").alias("a"), F.explode(flips).alias("fp"))
        return near.hint(MERGE).join(crowd, "fp").select("a", F.col("fp").alias("b")).filter("a < b")
    points = crowd.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return points.hint(MERGE).join(least, "point").select(F.col("fp").alias("a"), "b").filter("a <> b").distinct()


def _whole_segments(crowd: DataFrame, max_bits: int) -> DataFrame:
    """Pairs among members of large buckets by equal whole segments, of which ``max_bits + 1`` always have an equal one."""
    keys = [
        F.struct(F.lit(s).alias("s"), _segment(F.col("fp"), low, width).alias("v")) for s, (low, width) in enumerate(segments(max_bits + 1))
    ]
    keyed = crowd.select("fp", F.explode(F.array(*keys)).alias("k"))
    return (
        keyed.withColumnRenamed("fp", "a")
        .hint(MERGE)
        .join(keyed.withColumnRenamed("fp", "b"), "k")
        .filter((F.col("a") < F.col("b")) & (_apart("a", "b") <= max_bits))
        .select("a", "b")
        .distinct()
    )


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document of ``docs`` (doc_id, text)."""
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(distinct.select("fp"), max_bits, bucket))
    classes = stored(distinct.join(found.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "classes")
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
