"""Removal of passages that occurred before: every byte covered by ``length`` bytes that also start earlier.

Earlier means in a document with a smaller doc_id, or in the same one further ahead.
Matches never cross documents and are judged on the input.

1. Windows of ``length`` bytes are keyed by content-defined anchors (``anchors.py``), so
   windows can be equal only under the same anchor gram. Stretches, the texts of the
   windows that share an anchor, are sorted by gram, digest and place over the whole
   corpus. A stretch whose digest came before is a repeat as a whole.
2. Grams that are left with several different stretches are compared byte by byte: every
   task builds the Burrows-Wheeler transforms of its shard of stretches, bucket by
   bucket of grams, and each bucket merges the transforms of all shards by interleave
   refinement (``bwt.py``) down to ``length`` bytes. All but the first window of every
   repeated interval are repeats.
3. Grams with more than ``CROWD`` stretches are too many for one bucket; each of their
   windows is keyed by a 128-bit digest instead and all but the first of a key are
   repeats.

Null text is empty. A missing doc_id comes before all others. Rows that share a doc_id
(or lack it) count as separate documents, in an order fixed when they are first read.
Texts shorter than ``length`` keep everything. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bwt
from .anchors import stretches
from .common import byte_view, map_slices, slices, stored, tidy

LENGTH = 100
CROWD = 8192  # stretches of one gram that a bucket takes
BUCKET_BYTES = 4 << 20  # of stretches in one bucket, on average
FIRST = -(1 << 63)  # stands for a missing doc_id, which comes first

ANCHOR = "a long, nb long, d long, tie long, lo int, span int"


def identified(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text, carried columns, d, tie): ``(d, tie)`` tells rows apart and orders them.

    Usually doc_id is enough. If it is missing or repeated, rows are written out once
    with a number, which then stays the same however often they are read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids"), F.countDistinct("doc_id").alias("distinct")).first()
    keyed = docs.withColumn("d", F.coalesce("doc_id", F.lit(FIRST)))
    if row["n"] == row["distinct"]:
        return keyed.withColumn("tie", F.lit(0).cast("long"))
    return stored(keyed.withColumn("tie", F.monotonically_increasing_id()), "suffix-rows")


def anchored(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``ANCHOR``: gram, digest of the stretch, document, first window, further windows."""

    def make():
        import xxhash

        def work(rows: pa.RecordBatch) -> pa.RecordBatch:
            data, offsets = byte_view(rows.column("text"))
            row, low, high, gram = stretches(data, offsets, length)
            text = data.tobytes()
            start = offsets[row] + low
            spans = zip(start.tolist(), (start + high - low + length).tolist())
            digest = np.fromiter((xxhash.xxh3_64_intdigest(text[a:b]) for a, b in spans), np.uint64, len(row))
            who = pa.array(row)
            columns = [
                pa.array(gram.view(np.int64)),
                pa.array(digest.view(np.int64)),
                rows.column("d").take(who),
                rows.column("tie").take(who),
                pa.array(low, pa.int32()),
                pa.array(high - low, pa.int32()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["a", "nb", "d", "tie", "lo", "span"])

        return work

    return map_slices(docs.select("d", "tie", "text"), make, ANCHOR)


REPEAT, RIVAL, EDGE = 0, 1, 2


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In sorted rows: repeats of a stretch; first ones of grams with several; and those of grams that may go on in the next task."""
    table = pa.Table.from_batches(list(batches), pa.schema([(c, pa.int64()) for c in ("a", "nb", "d", "tie")] + [(c, pa.int32()) for c in ("lo", "span")]))
    if not table.num_rows:
        return
    a, nb = table.column("a").to_numpy(), table.column("nb").to_numpy()
    gram = np.append(True, a[1:] != a[:-1])
    first = gram | np.append(True, nb[1:] != nb[:-1])
    group = np.cumsum(gram) - 1
    several = np.bincount(group, first) > 1
    edge = (group == 0) | (group == group[-1])
    kind = np.where(~first, REPEAT, np.where(edge, EDGE, RIVAL)).astype(np.int32)
    keep = np.flatnonzero(~first | edge | several[group])
    yield from table.append_column("kind", pa.array(kind)).take(pa.array(keep)).to_batches(max_chunksize=100_000)


def _sorted_out(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Repeated stretches, and the first stretches of all grams that have several different ones."""
    order = ["a", "nb", "d", "tie", "lo"]
    ranged = anchored(docs, length).repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(ranged.mapInArrow(tidy(_resolve), ANCHOR + ", kind int"), "suffix-stretches")
    # a gram at the edge of a task may be in other tasks too: a few rows per task
    turn = F.row_number().over(Window.partitionBy("a", "nb").orderBy("d", "tie", "lo"))
    edges = stored(found.filter(F.col("kind") == EDGE).withColumn("turn", turn), "suffix-edges")
    firsts = edges.filter("turn = 1")
    several = firsts.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
    columns = ["a", "d", "tie", "lo", "span"]
    rivals = found.filter(F.col("kind") == RIVAL).select(*columns).unionByName(firsts.join(several, "a").select(*columns))
    repeated = found.filter(F.col("kind") == REPEAT).select(*columns[1:]).unionByName(edges.filter("turn > 1").select(*columns[1:]))
    return repeated, rivals


SHARD = "bucket long, strings binary, symbols binary"
SPAN = "d long, tie long, lo int, span int"


WINDOW = "key binary, d long, tie long, lo int"


def _shard_transforms(texts: DataFrame, buckets: int, length: int) -> DataFrame:
    """One pass over the texts for both ways: rows of ``SHARD``, and for crowded grams rows of ``WINDOW``.

    A shard row is the transform of a task's stretches of one bucket and who they are (d,
    tie, lo, length). A window row is the digest of one window and its place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held: dict[int, list] = {}
        size = 0
        digest = xxhash.xxh3_128_digest

        def rows_of(**columns: list) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), k) for c, k in _BOTH.items()], names=list(_BOTH))

        def flush() -> Iterator[pa.RecordBatch]:
            for bucket, parts in sorted(held.items()):
                lengths = np.concatenate([p[1] for p in parts])
                who = np.concatenate([p[0] for p in parts])
                symbols = bwt.transform(np.concatenate([p[2] for p in parts]), lengths)
                yield rows_of(bucket=[bucket], strings=[who.tobytes()], symbols=[symbols.tobytes()])
            held.clear()

        for batch in batches:
            for rows in slices(batch, "text"):
                data, offsets = byte_view(rows.column("text"))
                lists = rows.column("rivals")
                flat = lists.flatten()
                owner = np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy())
                a, low, span = (flat.field(c).to_numpy() for c in ("a", "lo", "span"))
                own = np.stack(
                    [rows.column("d").to_numpy()[owner], rows.column("tie").to_numpy()[owner], low.astype(np.int64), span + np.int64(length)], axis=1
                )
                begin = offsets[owner] + low
                crowded = flat.field("crowded").to_numpy(zero_copy_only=False).astype(bool)
                text = data.tobytes() if crowded.any() else b""
                for i in np.flatnonzero(crowded).tolist():
                    first, n = int(begin[i]), int(span[i]) + 1
                    keys = [digest(text[p : p + length]) for p in range(first, first + n)]
                    d, tie, at = own[i, :3].tolist()
                    yield rows_of(key=keys, d=[d] * n, tie=[tie] * n, lo=list(range(at, at + n)))
                a, own, begin = a[~crowded], own[~crowded], begin[~crowded]
                bucket = (a.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else []
                for part in np.split(order, cuts[1:]):
                    if len(part):
                        at = np.repeat(begin[part] - (np.cumsum(own[part, 3]) - own[part, 3]), own[part, 3]) + np.arange(own[part, 3].sum())
                        held.setdefault(int(bucket[part[0]]), []).append((own[part], own[part, 3], data[at]))
                        size += int(own[part, 3].sum())
                if size > 8 * BUCKET_BYTES:  # a shard is what fits in memory
                    yield from flush()
                    size = 0
        yield from flush()

    return texts.mapInArrow(tidy(run), f"{SHARD}, {WINDOW}")


_BOTH = {
    "bucket": pa.int64(),
    "strings": pa.binary(),
    "symbols": pa.binary(),
    "key": pa.binary(),
    "d": pa.int64(),
    "tie": pa.int64(),
    "lo": pa.int32(),
}


def _merged_repeats(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Merge the transforms of every bucket; rows come sorted by bucket."""

    def merge(rows: list) -> Iterator[pa.RecordBatch]:
        who = [np.frombuffer(s, np.int64).reshape(-1, 4) for s, _ in rows]
        string, position, interval = bwt.repeats([(np.frombuffer(t, np.uint8), w[:, 3]) for w, (_, t) in zip(who, rows)], length)
        own = np.concatenate(who)
        d, tie, at = own[string, 0], own[string, 1], own[string, 2] + position
        order = np.lexsort((at, tie, d, interval))
        later = order[np.append(False, np.diff(interval[order]) == 0)] if len(order) else order
        # runs of windows in a string
        run = later[np.lexsort((position[later], string[later]))]
        if len(run):
            starts = np.flatnonzero(np.append(True, (np.diff(string[run]) != 0) | (np.diff(position[run]) != 1)))
            ends = np.append(starts[1:], len(run)) - 1
            head = run[starts]
            columns = [d[head], tie[head], at[head].astype(np.int32), (position[run[ends]] - position[head]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["d", "tie", "lo", "span"])

    current, rows = None, []
    for batch in batches:
        for bucket, strings, symbols in zip(*(batch.column(c).to_pylist() for c in ("bucket", "strings", "symbols"))):
            if bucket != current and rows:
                yield from merge(rows)
                rows = []
            current = bucket
            rows.append((strings, symbols))
    if rows:
        yield from merge(rows)


def _crowded_repeats(windows: DataFrame) -> DataFrame:
    """Repeats among windows of crowded grams: all but the first of a digest."""
    firsts = windows.groupBy("key").agg(F.min(F.struct("d", "tie", "lo")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = windows.join(firsts, "key").filter(F.struct("d", "tie", "lo") != F.col("f"))
    return later.select("d", "tie", "lo", F.lit(0).alias("span"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``SPAN``: runs of windows (first, further ones) that occurred before, of ``docs`` as ``identified`` gives them."""
    repeated, rivals = _sorted_out(docs, length)
    rivals = stored(rivals, "suffix-rivals")
    sizes = rivals.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("a")
    crowded = stored(sizes, "suffix-crowded")  # under 1 in ``crowd`` of the stretches
    total = rivals.agg(F.sum(F.col("span") + length)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))

    marked = rivals.join(crowded.withColumn("crowded", F.lit(True)), "a", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    lists = marked.groupBy("d", "tie").agg(F.collect_list(F.struct("a", "lo", "span", "crowded")).alias("rivals"))
    texts = docs.select("d", "tie", "text").join(lists, ["d", "tie"])
    both = stored(_shard_transforms(texts, buckets, length), "suffix-shards")  # the texts move once
    shards = both.filter(F.col("key").isNull()).select("bucket", "strings", "symbols").repartition(buckets, "bucket")
    merged = shards.sortWithinPartitions("bucket").mapInArrow(tidy(lambda it: _merged_repeats(it, length)), SPAN)
    windows = both.filter(F.col("key").isNotNull()).select("key", "d", "tie", "lo")
    return repeated.unionByName(merged).unionByName(_crowded_repeats(windows))


KEPT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    crowd: int = CROWD,
    bucket_bytes: int = BUCKET_BYTES,
    with_kept: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """doc_id, ``carry`` and ``KEPT`` of every document; with ``with_kept`` also the kept bytes, their text, and the removed spans (start, end).

    ``kept_text`` leaves out what is left of characters that were cut through.
    """
    rows = identified(docs, carry)
    names = ["doc_id", *carry]
    carried = "".join(f", `{c}` {t}" for c, t in docs.select(*carry).dtypes) if carry else ""
    spans = stored(repeated_spans(rows, length, crowd, bucket_bytes), "suffix-spans")
    lists = spans.groupBy("d", "tie").agg(F.collect_list(F.struct("lo", "span")).alias("spans"))
    real = ("kept", "kept_text", "removed") if with_kept else ()
    extra = ", kept binary, kept_text string, removed array<struct<start:int,end:int>>" if with_kept else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = byte_view(part.column("text"))
                found = part.column("spans")
                out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", *real)}
                for i, spans in enumerate(found):
                    text = data[offsets[i] : offsets[i + 1]]
                    change = np.zeros(len(text) + 1, np.int32)
                    if spans.is_valid:
                        low, span = (spans.values.field(c).to_numpy() for c in ("lo", "span"))
                        np.add.at(change, low, 1)
                        np.add.at(change, low + span + length, -1)
                    gone = np.cumsum(change)[:-1] > 0
                    edges = np.flatnonzero(np.diff(gone, prepend=False, append=False))
                    kept = text[~gone].tobytes() if len(edges) else text.tobytes()
                    values = [len(text), len(text) - len(kept), len(edges) // 2, hashlib.sha256(kept).hexdigest()]
                    if with_kept:
                        values += [kept, kept.decode("utf-8", "ignore"), [{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()]]
                    for column, value in zip(out.values(), values):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names], *[pa.array(values, _KINDS[c]) for c, values in out.items()]], names=[*names, *out]
                )

    joined = rows.join(lists, ["d", "tie"], "left").select(*names, "text", "spans")
    return joined.mapInArrow(tidy(cut), f"doc_id long{carried}, {KEPT}{extra}")


_KINDS = {
    "n_bytes": pa.int64(),
    "n_removed": pa.int64(),
    "n_spans": pa.int64(),
    "kept_sha256": pa.string(),
    "kept": pa.binary(),
    "kept_text": pa.string(),
    "removed": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
}
