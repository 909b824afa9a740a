"""Best-fit packing into sequences of bounded length, with a certified number of sequences.

Every partition packs its pieces by best-fit decreasing and compares the number of
sequences with a lower bound from dual-feasible functions. A partition that meets its
bound is done. The others give up their least filled sequences, ``GIVEN_UP`` for every
one above the bound; those pieces meet in fewer partitions, by another hash, and are
packed anew, until one partition is left or all partitions meet their bounds.

Pieces are (key columns, length); lengths are whole numbers from 1 to ``capacity``.
Null or empty texts are documents of just the end id. Repeated rows are packed as
often as they come. No rows: no sequences.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, stored
from .tokens import default_tokenizer, encoder

CAPACITY = 2048
PART_PIECES = 200_000  # pieces one task packs: a few MB
ROUNDS = 6
GIVEN_UP = 6


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs: the best of the bounds of three families of dual-feasible functions.

    Each maps lengths so that what fits into one sequence still sums to at most one, so
    the sum over all pieces, rounded up, is a lower bound.
    """
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    for t in range(1, capacity // 2 + 1):  # above capacity - t a piece fills a sequence, below t it counts nothing
        value = np.where(sizes > capacity - t, capacity, np.where(sizes >= t, sizes, 0))
        best = max(best, -(-int((value * counts).sum()) // capacity))
    for k in range(1, 21):  # rounding to k-ths: (k + 1) x / c if whole, else floor of it, over k
        product = (k + 1) * sizes
        value = np.where(product % capacity == 0, sizes * k, product // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and place of every piece, and the number of sequences."""
    order = np.argsort(-lengths, kind="stable")
    sequence, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: dict[int, list[int]] = {}  # free tokens -> sequences with just that much
    frees: list[int] = []  # keys of room, ascending
    used = 0
    for i in order.tolist():
        n = int(lengths[i])
        at = bisect_left(frees, n)
        if at < len(frees):
            free = frees[at]
            mine = heapq.heappop(room[free])
            if not room[free]:
                del room[free], frees[at]
        else:
            free, mine, used = capacity, used, used + 1
        sequence[i], place[i] = mine, capacity - free
        if free > n:
            left = free - n
            if left not in room:
                room[left] = []
                frees.insert(bisect_left(frees, left), left)
            heapq.heappush(room[left], mine)
    return sequence, place, used


def pack(pieces: DataFrame, key: list[str], capacity: int = CAPACITY, part_pieces: int = PART_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (``key`` and ``length``) with ``sequence_id`` and ``offset``.

    ``sequence_id`` is unique over rounds and partitions. Full pieces are sequences of
    their own and are not moved at all. ``key`` columns need to be numbers.
    """
    whole = pieces.filter(F.col("length") >= capacity)
    rest = pieces.filter(F.col("length") < capacity).select(*key, "length")
    n = rest.count()
    parts = max(1, -(-n // part_pieces))
    done = []
    schema = pieces.select(*key, "length").schema.simpleString()[7:-1].replace(":", " ") + ", seq long, offset long, done boolean"

    for turn in range(rounds):
        last = parts == 1 or turn == rounds - 1

        def run(batches: Iterator[pa.RecordBatch], last: bool = last, parts: int = parts) -> Iterator[pa.RecordBatch]:
            tables = [b for b in batches if b.num_rows]
            if not tables:
                return
            table = pa.Table.from_batches(tables)
            spread = table.column("part").to_numpy()
            for part in np.unique(spread):
                mine = table.filter(pa.array(spread == part))
                mine = mine.sort_by([(c, "ascending") for c in ["length", *key]])  # a lost task packs alike
                lengths = mine.column("length").to_numpy()
                sequence, place, used = best_fit_decreasing(lengths, capacity)
                filled = np.bincount(sequence, lengths, used)
                keep = np.ones(used, bool)
                if not last:  # a sequence too many: give up the least filled ones, enough to put their pieces elsewhere
                    gap = used - lower_bound(lengths, capacity)
                    keep[np.argsort(filled, kind="stable")[: GIVEN_UP * gap]] = False
                out = mine.drop_columns(["part"])
                out = out.append_column("seq", pa.array(sequence * parts + part))
                out = out.append_column("offset", pa.array(place)).append_column("done", pa.array(keep[sequence]))
                yield from out.to_batches()

        dealt = rest.withColumn("part", F.pmod(F.xxhash64(F.lit(turn), *key), F.lit(parts)).cast("long"))
        packed = stored(dealt.repartition(parts, "part").mapInArrow(run, schema), f"packing-{turn}")
        done.append(packed.filter("done").select(*key, "length", F.lit(turn).alias("turn"), "seq", "offset"))
        if last:
            break
        rest = packed.filter(~F.col("done")).select(*key, "length")
        open_rows = rest.count()
        if not open_rows:
            break
        parts = max(1, min(parts // 4, -(-open_rows // part_pieces)))
    small = done[0]
    for more in done[1:]:
        small = small.unionByName(more)
    small = small.select(*key, "length", (F.col("seq") * (rounds + 1) + F.col("turn") + 1).alias("sequence_id"), "offset")
    # a full piece is its own sequence; numbers of these never meet those above, which are not multiples of rounds + 1
    whole = whole.select(
        *key, "length", (F.monotonically_increasing_id() * (rounds + 1)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return small.unionByName(whole)


CUT = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(docs: DataFrame, end_id: int = 0, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: ids and end id, only longer documents cut, the first piece the shorter one.

    Columns ``CUT`` and, if asked for, ``ids`` (little-endian uint32 as binary).
    """
    path = tokenizer or default_tokenizer()

    def make():
        tokens = encoder(path)
        encode = tokens.encode

        def work(rows: pa.RecordBatch) -> pa.RecordBatch:
            ids, lengths = encode(rows.column("text"))
            data = np.insert(ids, np.cumsum(lengths), end_id).astype("<u4").tobytes()
            view, lengths = memoryview(data), lengths + 1
            count = -(-lengths // capacity)
            owner = np.repeat(np.arange(len(lengths)), count)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            head = lengths - (count - 1) * capacity  # of the first piece
            start = np.where(piece == 0, 0, head[owner] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[owner], capacity)
            low = ((np.cumsum(lengths) - lengths)[owner] + start) * 4
            spans = list(zip(low.tolist(), (low + 4 * length).tolist()))
            columns = {
                "doc_id": rows.column("doc_id").take(pa.array(owner)),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids_crc32": pa.array([zlib.crc32(view[a:b]) for a, b in spans], pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array([data[a:b] for a, b in spans], pa.binary())
            return pa.RecordBatch.from_pydict(columns)

        work.done = tokens.forget
        return work

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, CUT + (", ids binary" if with_ids else ""))


def pack_documents(docs: DataFrame, end_id: int = 0, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents with their places: ``CUT``, sequence_id, offset."""
    pieces = stored(cut_documents(docs, end_id, capacity, tokenizer), "pieces")
    return pack(pieces, ["doc_id", "piece", "start", "ids_crc32"], capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
