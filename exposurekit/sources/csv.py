"""Quoted CSV in parallel: records of files of any size, read in splits.

A split starts in the middle of a file and cannot know whether its first line lies
inside a quoted text. Quotes tell: a line starts inside a text exactly if an odd number
of quotes stands before it (doubled quotes count twice, so they change nothing). So
quotes are counted per split, the parities are added up along each file, and with its
own starting parity every split closes records by itself. A record that runs over the
end of a split leaves a piece in each; only these pieces are brought together.

Quotes must be balanced, as they are where only quoted fields hold any (RFC 4180); a
file that ends inside a text is an error. Lines end with LF or CR LF.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .sinks import CSV_TEXT

WHOLE, HEAD, TAIL = 0, 1, 2  # a record; lines of one that began in an earlier split; lines of one that goes on in the next

PIECES = "value string, kind int, file string, block long"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the split they start in. A split's lines come in order, in one task."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.option("lineSep", "\n").text(path).select("value", *place)


def quote_spans(lines: DataFrame) -> DataFrame:
    """(file, block, inside, ends): whether a split starts, and ends, inside a quoted text. One row per split."""
    quotes = F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2
    parity = lines.groupBy("file", "block").agg(quotes.alias("odd"))
    after = F.sum("odd").over(Window.partitionBy("file").orderBy("block")) % 2
    return parity.select("file", "block", ((after + F.col("odd")) % 2 == 1).alias("inside"), (after == 1).alias("ends"))


class _Split:
    """Closes the records of one split; ``inside``: it starts within a quoted text."""

    def __init__(self, file: str, block: int, inside: bool):
        self.file, self.block, self.inside = file, block, inside
        self.head, self.header = inside, block == 0  # lines up to the first record's start; the file's first record
        self.open: list[str] = []

    def add(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
        ends = (np.cumsum(quotes) + self.inside) % 2 == 1  # after each line
        self.inside, last = bool(ends[-1]), np.flatnonzero(~ends)
        if not len(last):
            self.open += lines.to_pylist()
            return
        cuts = np.concatenate([[0], last + 1])  # records end behind these lines
        several = np.flatnonzero(np.diff(cuts) > 1)
        if self.open or self.head:
            several = np.union1d(several, [0])
        texts = lines.take(pa.array(last))
        if len(several):
            long = {i: "\n".join([*(self.open if i == 0 else []), *lines.slice(cuts[i], cuts[i + 1] - cuts[i]).to_pylist()]) for i in several.tolist()}
            mask = np.isin(np.arange(len(last)), several)
            texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([long[i] for i in several.tolist()], texts.type))
        if self.head:
            yield self._rows(texts.slice(0, 1), HEAD)
            texts, self.head = texts.slice(1), False
        if self.header and len(texts):
            texts, self.header = texts.slice(1), False
        yield self._rows(texts, WHOLE)
        self.open = lines.slice(cuts[-1]).to_pylist()

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.open:
            yield self._rows(pa.array(["\n".join(self.open)]), HEAD if self.head else TAIL)

    def _rows(self, texts: pa.Array, kind: int) -> pa.RecordBatch:
        n = len(texts)
        file, block = (pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())) if kind == WHOLE else (pa.array([self.file] * n), pa.array([self.block] * n))
        return pa.RecordBatch.from_arrays([texts.cast(pa.string()), pa.array(np.full(n, kind, np.int32)), file, block], names=["value", "kind", "file", "block"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split = None
    for batch in batches:
        block, file = batch.column("block").to_numpy(), batch.column("file").dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(file) != 0)) + 1
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
            if low == high:
                continue
            here = (batch.column("file")[low].as_py(), int(block[low]))
            if split is None or (split.file, split.block) != here:
                if split is not None:
                    yield from split.close()
                split = _Split(*here, batch.column("inside")[low].as_py())
            yield from split.add(batch.column("value").slice(low, high - low))
    if split is not None:
        yield from split.close()


def _joined(pieces: DataFrame) -> DataFrame:
    """Records put together from their pieces: a tail, the heads of the splits after it, up to the next tail."""
    order = Window.partitionBy("file").orderBy("block", "kind")
    numbered = pieces.withColumn("record", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    parts = F.sort_array(F.collect_list(F.struct("block", "kind", "value")))  # of one record
    return numbered.groupBy("file", "record").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value")).select("value")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(value): the records of CSV files with a header, without the headers and without empty lines.

    Files are passed once to count quotes; where no record runs over a split, once more
    when the result is read. Splits at such places are read a third time for the pieces.
    The spans are one row per split, of which the driver has a list anyway, so they are
    broadcast, and lines stay in their order.
    """
    lines = _lines(spark, path)
    spans = cut_lineage(quote_spans(lines), "quotes")
    last = spans.groupBy("file").agg(F.max_by("ends", "block").alias("open")).filter("open").first()
    if last is not None:
        raise ValueError(f"{last['file']} ends inside a quoted text")
    placed = lines.join(F.broadcast(spans), ["file", "block"]).select("value", "file", "block", "inside", "ends")
    found = placed.drop("ends").mapInArrow(_pieces, PIECES).filter(F.col("kind") == WHOLE).select("value")
    if spans.filter("inside").first() is not None:
        over = placed.filter(F.col("inside") | F.col("ends")).drop("ends").mapInArrow(_pieces, PIECES).filter(F.col("kind") != WHOLE)
        found = found.unionByName(_joined(over))
    return found.select(F.rtrim("value", F.lit("\r")).alias("value")).filter(F.col("value") != "")


def header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.options(**CSV_TEXT).csv(path).columns


def parsed_records(spark: SparkSession, path: str, schema: T.StructType, options: Mapping[str, object]) -> DataFrame:
    """Columns of ``schema``, in the files' order, of all records."""
    texts = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if k != "header"}
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    row = F.from_csv("value", ddl, {**texts, "multiLine": "true"})
    return records(spark, path).select(row.alias("row")).select("row.*")
