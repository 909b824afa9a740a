"""Toxicity of whole texts: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters (ASCII A-Z lower-cased; other bytes than ASCII belong to
words). Features of a text are the distinct slots, of 2^``BITS``, of its words, pairs
of neighbours, and pairs with one word between. Every slot has its own learning rate,
and its weight is zero until its gradients add up to more than ``L1``, so most slots
have none; what tasks get is the list of the others, at most 2^``BITS`` numbers.

The classifier is fitted on at most about ``TRAIN_ROWS`` labelled documents: ids with a
label are cut by a hash where there are more. Equal texts with equal labels are one
training row. Features are made by all tasks and written; FTRL is a sequence of steps,
so a pass over this bounded sample is one task, in the order of a hash of the text, and
its state is the next pass's start. All rows are scored, by all tasks.

Null and empty texts have the score of no features. A missing label, or a label
without a document, teaches nothing; of several labels of one doc_id the largest
counts, and any above 0 is toxic. Without labelled rows, or with labels of one kind,
scores follow the share of toxic rows (0.5 without rows). A very long text is a slice
of its own. Other columns are carried as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, byte_view, few_rows, map_slices, stored, tidy, values_of, words_of
from .langid import BREAKS

BITS = 20
SEED = 7
TRAIN_ROWS = 40_000
ROUNDS = 5
ALPHA, BETA, L1, L2 = 0.5, 1.0, 10.0, 1.0
THRESHOLD = 0.7
SLOTS = 1 << BITS  # the bias is the slot after the last

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))  # by kind of feature


def _slot(x: np.ndarray, kind: int) -> np.ndarray:
    x = x * _ODD[kind]
    return ((x ^ (x >> np.uint64(29))) * _ODD[(kind + 1) % 3] >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of every word, pair and pair over one word; a row's slots may repeat."""
    data, offsets = byte_view(texts)
    words, first = words_of(LOWER[data], offsets, BREAKS)
    coded = words.dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in values_of(coded.dictionary)], np.uint64)
    h = hashes[coded.indices.to_numpy()] if len(words) else hashes
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found = [(owner, _slot(h, 0))]
    for apart in (1, 2):
        inside = owner[apart:] == owner[:-apart]
        found.append((owner[apart:][inside], _slot((h[:-apart] * _ODD[apart] + h[apart:])[inside], apart)))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def distinct(rows: np.ndarray, slots: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of rows in ascending order, and per row the index of its first."""
    cells = np.unique(rows << BITS | slots)
    return cells & (SLOTS - 1), np.searchsorted(cells >> BITS, np.arange(n + 1))


def labelled(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """(key, toxic, text): one row of each text and label, of about ``limit`` labelled ids at most."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = stored(known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")), "toxic-labels")
    there = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    n = there.count()
    if n > limit:
        known = known.filter(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(n)) < limit)
    else:
        known = there  # as bounded
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(stored(known, "toxic-sample")), "doc_id")
    return rows.groupBy(F.xxhash64(F.lit(SEED), "text").alias("key"), "toxic").agg(F.min("text").alias("text"))


def examples(rows: DataFrame) -> DataFrame:
    """(key, toxic, slots) of training rows; slots as little-endian 32-bit numbers."""

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            slots, first = distinct(*features(part.column("text")), part.num_rows)
            lists = pa.array([x.astype("<i4").tobytes() for x in np.split(slots, first[1:-1])], pa.binary())
            return pa.RecordBatch.from_arrays([part.column("key"), part.column("toxic"), lists], names=["key", "toxic", "slots"])

        return work

    return map_slices(rows.select("key", "toxic", "text"), make, "key long, toxic int, slots binary")


class Ftrl:
    """State of every slot: z, gradients less what weights have moved, and n, squared gradients."""

    def __init__(self, z: np.ndarray, n: np.ndarray, least: float = L1):
        self.z, self.n, self.least = z, n, least

    @staticmethod
    def fresh(least: float = L1) -> Ftrl:
        return Ftrl(np.zeros(SLOTS + 1), np.zeros(SLOTS + 1), least)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        """Zero while a slot's gradients have not added up to ``least``; the bias has no such limit."""
        z, n = self.z[at], self.n[at]
        slots = np.arange(SLOTS + 1)[at] if isinstance(at, slice) else at
        beyond = np.maximum(np.abs(z) - np.where(slots == SLOTS, 0.0, self.least), 0.0)
        return -np.sign(z) * beyond / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, slots: np.ndarray, toxic: int) -> None:
        at = np.append(slots, SLOTS)
        w, n = self.weights(at), self.n[at]
        g = _share(w.sum()) - toxic
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _share(x):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x)))


def _pass(table: DataFrame, state: Ftrl) -> Ftrl:
    """One pass over the sample from ``state``; the new state comes back, 2^BITS slots at most."""
    shared, least = table.sparkSession.sparkContext.broadcast((state.z, state.n)), state.least

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ftrl(*(x.copy() for x in shared.value), least)
        for batch in batches:
            for toxic, slots in zip(batch.column("toxic").to_pylist(), batch.column("slots").to_pylist()):
                own.learn(np.frombuffer(slots, "<i4"), toxic)
        seen = np.flatnonzero(own.n)
        for at in np.array_split(seen, max(1, len(seen) >> 16)):
            yield pa.RecordBatch.from_pydict({"at": [at.astype("<i4").tobytes()], "z": [own.z[at].tobytes()], "n": [own.n[at].tobytes()]})

    with few_rows(table.sparkSession, 1000):
        ordered = table.coalesce(1).sortWithinPartitions("key", "toxic").select("toxic", "slots")
        parts = ordered.mapInArrow(tidy(train), "at binary, z binary, n binary").collect()
    shared.unpersist()
    out = Ftrl.fresh(least)
    for part in parts:
        at = np.frombuffer(part["at"], "<i4")
        out.z[at], out.n[at] = np.frombuffer(part["z"]), np.frombuffer(part["n"])
    return out


@dataclass
class Model:
    """Slots with a weight, and the bias."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(SLOTS)
        out[self.slots] = self.weights
        return out


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, rounds: int = ROUNDS, least: float = L1) -> Model:
    """``docs`` (doc_id, text) are those that may be learnt from."""
    table = stored(examples(labelled(docs, labels, limit)), "toxic-examples")
    state = Ftrl.fresh(least)
    for _ in range(rounds):
        state = _pass(table, state)
    w = state.weights(slice(None))
    slots = np.flatnonzero(w[:SLOTS])
    return Model(slots, w[slots].astype(np.float32), float(w[SLOTS]))


def score(docs: DataFrame, model: Model, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns of all ``docs`` with score and predicted. Only ``text`` is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").alias("_text"))
    kept = rows.schema.fields[:-1]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double"])

    def make():
        weights, bias = shared.value.dense(), shared.value.bias

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            owner, slots = features(part.column("_text"))
            some = weights[slots] != 0
            slots, first = distinct(owner[some], slots[some], part.num_rows)
            total = np.concatenate([[0.0], np.cumsum(weights[slots])])
            scores = _share(total[first[1:]] - total[first[:-1]] + bias)
            return pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(scores)], names=[*(f.name for f in kept), "score"])

        return work

    told = map_slices(rows, make, schema, "_text")
    return told.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
