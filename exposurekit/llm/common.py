"""Shared by the text operators: Arrow batches as byte buffers, words, folds, written stages."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, fresh_path

SLICE_BYTES = 2 << 20  # text handled at once inside a task; one longer text is a slice of its own

SPACES = np.zeros(256, bool)  # the contract's separators: 0x20 and 0x09-0x0D
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)  # A-Z only
LOWER[65:91] += 32


def together(rows: int | None) -> dict[str, str]:
    """Writer's options by which Parquet has at most ``rows`` rows in memory at a time, written or read, instead of thousands."""
    return {"parquet.block.row.count.limit": str(rows)} if rows else {}


def stored(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Written once to the shared folder and read back: survives lost executors, computed once. ``rows``: of ``together``."""
    return cut_lineage(df, f"llm-{label}", **together(rows))


MERGE = "merge"  # hint for joins whose tables Spark sizes too low, as after an explode or from well packed files, and would broadcast

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def few_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tasks get at most ``rows`` rows at a time, for actions that run inside."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


class Bucketed:
    """Tables in the shared folder that are bucketed alike, so that joins of them on ``key`` move no rows.

    The tables are dropped from the catalog when the block of code ends, so what is
    made of them has to be stored before.
    """

    def __init__(self, spark: SparkSession, key: str, buckets: int):
        self.spark, self.key, self.buckets = spark, key, min(max(buckets, 1), 100_000)
        self.names: list[str] = []

    def __enter__(self) -> Bucketed:
        return self

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def dealt(self, df: DataFrame) -> DataFrame:
        """Rows where a join with the tables wants them."""
        return df.repartition(self.buckets, self.key)

    def put(self, df: DataFrame, label: str, there: bool = False, rows: int | None = None, stored_rows: int | None = None) -> DataFrame:
        """``df`` as such a table; ``there``: its rows lie as the tables' do already.

        Tasks get ``rows`` rows at a time, if that is given; ``stored_rows`` is that of ``together``.
        """
        name = f"llm_{label}_{uuid.uuid4().hex}".replace("-", "_")
        laid = df if there else self.dealt(df)
        with few_rows(self.spark, rows) if rows else nullcontext():
            laid.write.format("parquet").options(**together(stored_rows)).bucketBy(self.buckets, self.key).option("path", fresh_path(self.spark, f"llm-{label}")).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a column in one array, and the offsets of its rows; null is empty."""
    a = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Pieces ``data[offsets[i]:offsets[i + 1]]`` as an Arrow array without copying."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)


def values_of(a: pa.Array) -> list[bytes]:
    """A large_binary array as ``to_pylist`` gives it, an order of magnitude faster."""
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1].tolist()
    content = a.buffers()[2].to_pybytes()
    return [content[low:high] for low, high in zip(offsets, offsets[1:])]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about ``limit`` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        if high > low:
            yield batch.slice(low, high - low)


def even_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """``slices`` of all batches one after the other, however few rows each has: only the last one has less text."""
    waiting, size = [], 0

    def cut() -> list[pa.RecordBatch]:
        return [part for batch in pa.Table.from_batches(waiting).combine_chunks().to_batches() for part in slices(batch, column, limit)]

    for batch in batches:
        waiting.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            *full, rest = cut() or waiting
            yield from full
            waiting, size = [rest], rest.column(column).nbytes
    if waiting:
        yield from cut()


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and per row the index of its first word (one entry more than rows)."""
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = offsets[:-1][offsets[:-1] < len(data)]
    first[bounds] = inside[bounds]  # a word never runs over from the row before
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def words_of(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[pa.Array, np.ndarray]:
    """Every word as bytes in an Arrow array, and per row the index of its first word."""
    starts, ends, first = word_spans(data, offsets, separators)
    return binary_array(data[~separators[data]], np.concatenate([[0], np.cumsum(ends - starts)])), first


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` of all i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def sums_by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values[first[i]:first[i + 1]]`` for every row."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's work that gives freed memory back to the system when it ends: Python workers outlive stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)(0)

    return wrapped


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """Apply ``make()``, built once per task, to every slice of text.

    If the work has a ``done``, it is called when the task ends, to give back what it remembers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        try:
            for batch in batches:
                for part in slices(batch, text, limit):
                    yield work(part)
        finally:
            getattr(work, "done", lambda: None)()

    return df.mapInArrow(tidy(run), schema)
