"""Token ids of documents in ascending order of doc_id, as binary files of Simple-8b words.

A file (``*.s8b``, little-endian): magic ``S8B1`` and block size as two uint32, then
uint64 counts of documents, ids and words; doc_id of every document (int64), one byte
per document that says whether doc_id is missing (padded to 8), the end of every
document in ids (uint64), the word offset of every block and of the end (uint64), the
words (uint64). Files are named by partition and number, which is the order of ids.

Null or empty text: just the end id. A missing doc_id sorts first. Documents with the
same doc_id are kept, in the order of their texts' digests. No rows: no files.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fresh_path
from . import simple8b
from .common import SLICE_BYTES, slices, stored, tidy
from .tokens import default_tokenizer, encoder

MAGIC = 0x31423853
FILE_IDS = 8 << 20  # a file is closed after so many ids
HEADER = "<IIQQQ"


def file_system(uri: str):
    """File system and path inside it, for a folder that all executors share."""
    from pyarrow import fs

    if re.match(r"file:/", uri):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


class FileWriter:
    """Collects one file; whole blocks are coded as soon as they are there."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.ends: list[np.ndarray] = []
        self.words: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.rest = np.zeros(0, np.uint16)
        self.n_docs = self.n_ids = self.n_words = 0

    def add(self, doc_ids: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ids += doc_ids
        self.ends.append(self.n_ids + np.cumsum(lengths))
        self.n_docs, self.n_ids = self.n_docs + len(doc_ids), self.n_ids + len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // simple8b.BLOCK * simple8b.BLOCK
        self._code(ids[:whole])
        self.rest = ids[whole:]

    def _code(self, ids: np.ndarray) -> None:
        if len(ids):
            words, starts = simple8b.encode(ids)
            self.words.append(words)
            self.starts.append(self.n_words + starts[:-1])
            self.n_words += len(words)

    def write(self, folder: str, name: str) -> None:
        """Under a passing name first, so that a lost task leaves no half file under the final one."""
        self._code(self.rest)
        missing = np.array([d is None for d in self.ids], np.uint8)
        parts = [
            struct.pack(HEADER, MAGIC, simple8b.BLOCK, self.n_docs, self.n_ids, self.n_words),
            np.array([d or 0 for d in self.ids], "<i8"),
            np.append(missing, np.zeros(-len(missing) % 8, np.uint8)),
            np.concatenate(self.ends).astype("<u8"),
            np.append(np.concatenate([*self.starts, np.zeros(0, np.int64)]), self.n_words).astype("<u8"),
            *[w.astype("<u8", copy=False) for w in self.words],
        ]
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        passing = f"{path}/.{name}.{TaskContext.get().taskAttemptId()}"
        with system.open_output_stream(passing) as out:
            for part in parts:
                out.write(part if isinstance(part, bytes) else part.tobytes())
        system.move(passing, f"{path}/{name}")


class FileReader:
    """One file: doc_ids, ends in ids, and ids of any range."""

    def __init__(self, folder: str, name: str):
        system, path = file_system(folder)
        with system.open_input_file(f"{path}/{name}") as source:
            content = source.read()
        magic, self.block, n_docs, self.n_ids, n_words = struct.unpack_from(HEADER, content)
        if magic != MAGIC:
            raise ValueError(f"{name} is not a token file")
        at = struct.calcsize(HEADER)
        doc_ids = np.frombuffer(content, "<i8", n_docs, at)
        missing = np.frombuffer(content, np.uint8, n_docs, at + 8 * n_docs)
        at += 8 * n_docs + n_docs + (-n_docs % 8)
        self.doc_ids = pa.array(doc_ids, mask=missing.astype(bool))
        self.ends = np.frombuffer(content, "<u8", n_docs, at).astype(np.int64)
        blocks = -(-self.n_ids // self.block)
        self.starts = np.frombuffer(content, "<u8", blocks + 1, at + 8 * n_docs).astype(np.int64)
        self.words = np.frombuffer(content, "<u8", n_words, at + 8 * (n_docs + blocks + 1))

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start..end, decoding only their blocks."""
        low, high = start // self.block, -(-end // self.block)
        n = min(high * self.block, self.n_ids) - low * self.block
        values = simple8b.decode(self.words, self.starts[low : high + 1], n, self.block)
        return values[start - low * self.block : end - low * self.block].astype(np.uint32)


MANIFEST = "part long, number long, name string, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, folder: str, end_id: int, tokenizer: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the files of ``docs`` (doc_id, text) and return their manifest (``MANIFEST``).

    Documents are range-partitioned by doc_id and sorted inside a partition, so a file
    holds neighbours and the order of files is the order of ids.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out, tokens = TaskContext.get().partitionId(), 0, FileWriter(), encoder(path)

        def close() -> pa.RecordBatch:
            name = f"part-{part:06d}-{number:06d}.s8b"
            out.write(folder, name)
            row = {"part": [part], "number": [number], "name": [name], "n_docs": [out.n_docs], "n_ids": [out.n_ids]}
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for rows in slices(batch, "text", min(SLICE_BYTES, 4 * file_ids)):
                ids, lengths = tokens.encode(rows.column("text"))
                ids = np.insert(ids, np.cumsum(lengths), end_id)
                out.add(rows.column("doc_id").to_pylist(), ids, lengths + 1)
                if out.n_ids >= file_ids:
                    yield close()
                    out, number = FileWriter(), number + 1
        tokens.forget()
        if out.n_docs:
            yield close()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    )
    return stored(ordered.mapInArrow(tidy(run), MANIFEST), "token-files")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document from the files: place and number of its ids, and their crc32 as uint32."""
    before = F.sum("n_ids").over(Window.orderBy("part", "number")) - F.col("n_ids")  # one row per file
    files = manifest.withColumn("first", before)
    tasks = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column("name").to_pylist(), batch.column("first").to_pylist()):
                file = FileReader(folder, name)
                starts = np.append(0, file.ends[:-1])
                crcs, step = [], 1 << 20
                low = 0
                while low < len(starts):  # whole documents of about a million ids at a time
                    high = max(low + 1, int(np.searchsorted(file.ends, starts[low] + step)))
                    ids = file.ids(int(starts[low]), int(file.ends[high - 1])).tobytes()
                    view, zero = memoryview(ids), int(starts[low])
                    crcs += [zlib.crc32(view[4 * (s - zero) : 4 * (e - zero)]) for s, e in zip(starts[low:high].tolist(), file.ends[low:high].tolist())]
                    low = high
                yield pa.RecordBatch.from_arrays(
                    [file.doc_ids, pa.array(starts + first), pa.array(file.ends - starts), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.select("name", "first").repartition(tasks, "name").mapInArrow(run, READ)


def token_files(spark: SparkSession, docs: DataFrame, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Files written to the shared folder and read back (``READ``)."""
    folder = fresh_path(spark, "token-files")
    return read_token_files(write_token_files(docs, folder, end_id, tokenizer), folder)
