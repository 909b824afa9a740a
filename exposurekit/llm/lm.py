"""Log-bilinear language model, trained with noise-contrastive estimation, and scores of whole texts.

Words are counted over all training texts. The most frequent words and the end of a
text are symbols of their own; every other word belongs to a class by its last two
bytes, which is a symbol too. The model predicts a symbol from the two before it: the
context vectors, weighted by place, times the symbol's vector plus its bias. Inside a
class a word has its smoothed share of the class's training words, the unknown word
one count. So the probabilities of all words, of one unknown word per class and of the
end add up to one.

Training passes over all training texts: every task runs NCE in numpy over its own
part from the parameters so far, and their mean, weighted by tokens, is the next
start. Noise comes from the symbols' counts. Since a score is the sum of a term for
each of the two context symbols, the normaliser of all pairs of context symbols is one
product of two matrices of exponentials.

Null text is empty: just the end. Without training texts every probability is that of
untrained parameters, and the base is one. Rows may agree in all columns: each is
scored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACES, byte_view, map_slices, slices, stored, sums_by_row, tidy, values_of, words_of

SYMBOLS = 2048  # the end, then words, then classes
CLASSES = 512
HEAD = 1 << 17  # words whose counts tasks hold; the others are looked up by a join
WIDTH = 24
BATCH = 512
NOISE = 64  # noise symbols shared by a batch
RATE = 0.1
ROUNDS = (1, 8)  # eighths of the training texts up to which each round goes
CHUNKS = 16
COUNT_BYTES = 8 << 20  # text counted at once


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = byte_view(texts)
    return LOWER[data], offsets


def class_of(words: pa.Array) -> np.ndarray:
    """Class of every word of a large_binary array by its last two bytes."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8).astype(np.int64)
    last = data[offsets[1:] - 1] if len(words) else np.zeros(0, np.int64)
    before = np.where(np.diff(offsets) > 1, data[np.maximum(offsets[1:] - 2, 0)], 0) if len(words) else last
    return (last * 257 + before * 31) % CLASSES


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, cls, n) over all texts of ``docs``."""

    def make():
        def work(rows: pa.RecordBatch) -> pa.RecordBatch:
            words, _ = words_of(*lowered(rows.column("text")))
            coded = words.dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            text = coded.dictionary.cast(pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([text, pa.array(class_of(coded.dictionary), pa.int32()), pa.array(n)], names=["word", "cls", "n"])

        return work

    return map_slices(docs.select("text"), make, "word string, cls int, n long", limit=COUNT_BYTES).groupBy("word", "cls").agg(F.sum("n").alias("n"))


@dataclass
class Params:
    context: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    place: np.ndarray  # weights of the two places, by dimension

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.context, self.target, self.bias, self.place)])

    @staticmethod
    def of(flat: np.ndarray, symbols: int = SYMBOLS, width: int = WIDTH) -> Params:
        cuts = np.cumsum([symbols * width, symbols * width, symbols])
        a, b, c, d = np.split(flat.astype(np.float32), cuts)
        return Params(a.reshape(symbols, width), b.reshape(symbols, width), c, d.reshape(2, width))


@dataclass
class Model:
    """What tasks need; a few MB however large the corpus."""

    words: dict[bytes, tuple[int, int]]  # head words: (symbol or -1, training count)
    tokens: int
    distinct: int
    ends: int
    class_tokens: np.ndarray  # by class, words that are no symbol
    class_words: np.ndarray
    symbol_counts: np.ndarray
    params: Params
    counts: DataFrame | None = field(default=None, repr=False)  # (word, cls, n) of all training words
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def for_tasks(self) -> Model:
        return Model(**{**self.__dict__, "counts": None})

    def symbols(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, class and training count of distinct words; the count is -1 outside the head."""
        cls, none = class_of(words), (-1, -1)
        found = [self.words.get(w, none) for w in values_of(words)]
        symbol, count = (np.fromiter((f[i] for f in found), np.int64, len(found)) for i in (0, 1))
        return np.where(symbol >= 0, symbol, SYMBOLS - CLASSES + cls), cls, count

    def contexts(self, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray, tuple]:
        """Symbols of all tokens with ends put in, first token of every row, and the words with their codes and ``symbols``."""
        words, first = words_of(*lowered(rows.column("text")))
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        told = self.symbols(coded.dictionary)
        symbol = told[0][codes] if len(codes) else codes
        return np.insert(symbol, first[1:], 0), first + np.arange(len(first)), first, coded.dictionary, codes, told


def preceding(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols two and one places before; before the start of a text stand ends."""
    two, one = np.zeros_like(symbols), np.zeros_like(symbols)
    one[1:], two[2:] = symbols[:-1], symbols[:-2]
    starts = first[:-1]
    one[starts] = two[starts] = 0
    seconds = starts + 1
    seconds = seconds[seconds < first[1:]]
    two[seconds] = 0
    return two, one


class Trainer:
    """NCE with noise shared by a batch, steps by AdaGrad."""

    def __init__(self, params: Params, noise: np.ndarray, seed: int):
        self.rng = np.random.default_rng(seed)
        self.share = np.cumsum(noise)
        self.log_noise = np.log(NOISE * noise).astype(np.float32)
        self.context, self.place = params.context, params.place
        self.out = np.concatenate([params.target, params.bias[:, None]], axis=1)  # the bias is the weight of a constant 1
        self.sums = {id(x): np.full_like(x, 0.1) for x in (self.context, self.out, self.place)}

    @property
    def params(self) -> Params:
        return Params(self.context, self.out[:, :-1], self.out[:, -1], self.place)

    def learn(self, symbols: np.ndarray, first: np.ndarray) -> None:
        two, one = preceding(symbols, first)
        order = self.rng.permutation(len(symbols))
        for low in range(0, len(order), BATCH):
            at = order[low : low + BATCH]
            self.step(two[at], one[at], symbols[at])

    def step(self, two: np.ndarray, one: np.ndarray, word: np.ndarray) -> None:
        n, width, place = len(word), self.context.shape[1], self.place
        drawn = np.minimum(np.searchsorted(self.share, self.rng.random(NOISE)), SYMBOLS - 1)
        both = self.context[np.concatenate([two, one])]
        far, near, target, noise = both[:n], both[n:], self.out[word], self.out[drawn]
        hidden = np.ones((n, width + 1), np.float32)
        np.multiply(far, place[0], out=hidden[:, :width])
        hidden[:, :width] += near * place[1]
        real = _sigmoid(self.log_noise[word] - np.einsum("ij,ij->i", hidden, target))  # 1 - P(from the text)
        fake = _sigmoid(hidden @ noise.T - self.log_noise[drawn])
        back = real[:, None] * target[:, :width] - fake @ noise[:, :width]
        self._move(self.out, *_by_symbol(np.concatenate([word, drawn]), np.concatenate([real[:, None] * hidden, -(fake.T @ hidden)])))
        turns = np.stack([np.einsum("ij,ij->j", back, far), np.einsum("ij,ij->j", back, near)])
        np.multiply(back, place[0], out=both[:n])
        np.multiply(back, place[1], out=both[n:])
        self._move(self.context, *_by_symbol(np.concatenate([two, one]), both))
        self._move(place, slice(None), turns)

    def _move(self, of: np.ndarray, rows: np.ndarray | slice, gradient: np.ndarray) -> None:
        sums = self.sums[id(of)]
        total = sums[rows]
        total += gradient * gradient
        if not isinstance(rows, slice):
            sums[rows] = total
        of[rows] += RATE * gradient / np.sqrt(total)


def _by_symbol(symbols: np.ndarray, gradients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct symbols and the sums of their gradients."""
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return ordered[starts], np.add.reduceat(gradients[order], starts, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _round(docs: DataFrame, model: Model, seed: int) -> Params:
    """One pass over ``docs`` in all tasks from ``model``'s parameters; the mean of what they come to."""
    shared = docs.sparkSession.sparkContext.broadcast(model.for_tasks())
    noise = (model.symbol_counts + 1.0) / (model.symbol_counts + 1.0).sum()

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, weight, trainer = shared.value, 0, None
        for batch in batches:
            for rows in slices(batch, "text"):
                if trainer is None:
                    trainer = Trainer(Params.of(start.params.flat().copy()), noise, seed + TaskContext.get().partitionId())
                symbols, first, *_ = start.contexts(rows)
                trainer.learn(symbols, first)
                weight += len(symbols)
        if trainer is not None:
            parts = np.array_split(trainer.params.flat(), CHUNKS)
            yield pa.RecordBatch.from_pydict(
                {"chunk": list(range(CHUNKS)), "weight": [float(weight)] * CHUNKS, "values": [x.astype("<f4").tobytes() for x in parts]}
            )

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        weights: dict[int, float] = {}
        for batch in batches:
            for chunk, weight, values in zip(*(batch.column(c).to_pylist() for c in ("chunk", "weight", "values"))):
                part = np.frombuffer(values, "<f4").astype(float) * weight
                sums[chunk] = sums[chunk] + part if chunk in sums else part
                weights[chunk] = weights.get(chunk, 0.0) + weight
        if sums:
            keys = sorted(sums)
            yield pa.RecordBatch.from_pydict({"chunk": keys, "values": [(sums[k] / weights[k]).astype("<f4").tobytes() for k in keys]})

    ran = docs.select("text").mapInArrow(tidy(train), "chunk long, weight double, values binary")
    means = ran.repartition(CHUNKS, "chunk").mapInArrow(mean, "chunk long, values binary").collect()  # one vector in all
    shared.unpersist()
    if not means:
        return model.params
    return Params.of(np.concatenate([np.frombuffer(r["values"], "<f4") for r in sorted(means)]))


def fit(docs: DataFrame, seed: int = 42) -> Model:
    """Model of ``docs`` (text): counts of all words, and NCE over all texts."""
    counts = stored(word_counts(docs), "lm-counts")
    ends = docs.count()
    spread = counts.groupBy("n").agg(F.count(F.lit(1)).alias("rows"))
    above = spread.withColumn("above", F.sum("rows").over(Window.orderBy(F.desc("n")))).filter(F.col("above") <= HEAD)
    least = above.agg(F.min("n").alias("n")).first()["n"]
    head = sorted(counts.filter(F.col("n") >= least).collect(), key=lambda r: (-r.n, r.word)) if least else []
    own = SYMBOLS - CLASSES - 1
    words = {r.word.encode(): (i + 1 if i < own else -1, r.n) for i, r in enumerate(head)}
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        class_tokens[r.cls], class_words[r.cls] = r.n, r.v
    symbol_counts = np.zeros(SYMBOLS)
    symbol_counts[0] = ends
    for i, r in enumerate(head[:own]):
        symbol_counts[i + 1] = r.n
        class_tokens[r.cls] -= r.n
        class_words[r.cls] -= 1
    tokens, distinct = int(symbol_counts.sum() + class_tokens.sum()), len(head[:own]) + int(class_words.sum()) + (ends > 0)
    symbol_counts[SYMBOLS - CLASSES :] = class_tokens
    rng = np.random.default_rng(seed)
    small = lambda: rng.normal(0, 0.3, (SYMBOLS, WIDTH)).astype(np.float32)
    bias = np.log((symbol_counts + 1) / (symbol_counts + 1).sum()).astype(np.float32)
    params = Params(small(), small(), bias, np.ones((2, WIDTH), np.float32))
    model = Model(words, tokens, distinct, ends, class_tokens, class_words, symbol_counts, params, counts)
    low = 0
    for turn, high in enumerate(ROUNDS):
        part = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(ROUNDS[-1]))
        model.params = _round(docs.filter((part >= low) & (part < high)), model, seed + 7919 * turn)
        low = high
    return model


class Scorer:
    """Natural logs of P(symbol | two before) for all symbols and contexts, from three tables."""

    def __init__(self, params: Params):
        self.far = (params.context * params.place[0]) @ params.target.T
        self.near = (params.context * params.place[1]) @ params.target.T + params.bias
        top_far, top_near = self.far.max(1), self.near.max(1)
        total = np.exp(self.far - top_far[:, None]) @ np.exp(self.near - top_near[:, None]).T
        self.norm = np.log(np.maximum(total, 1e-37)) + top_far[:, None] + top_near[None, :]

    def __call__(self, two: np.ndarray, one: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self.far[two, word].astype(float) + self.near[one, word] - self.norm[two, one]


_SCORERS: dict[str, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    """One per Python worker and model."""
    if model.name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.name] = Scorer(model.params)
    return _SCORERS[model.name]


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns with n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    Words outside the head are written out with the row they are in, and their counts
    come by a join on the word.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.for_tasks())
    kept = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    schema = f"row long, {kept}, n_tokens long, n_known long, base_score double, score double, rare array<struct<word:string,cls:int,n:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = _scorer(model)
        row, below = TaskContext.get().partitionId() << 40, np.log10(model.tokens + model.distinct + 1)
        inside = np.log10(model.class_tokens + model.class_words + 1)
        end_base = np.log10((model.ends if model.ends else 0) + 1) - below
        for batch in batches:
            for rows in slices(batch, "text"):
                symbols, starts, first, words, codes, (symbol, cls, count) = model.contexts(rows)
                two, one = preceding(symbols, starts)
                total = sums_by_row(scorer(two, one, symbols) / np.log(10), starts)
                common = count >= 0
                logs = np.log10(np.maximum(count, 0) + 1)
                base = sums_by_row(np.where(common, logs - below, 0)[codes], first) + end_base
                within = np.where(common & (symbol >= SYMBOLS - CLASSES), logs - inside[cls], 0)
                known = sums_by_row((count > 0)[codes].astype(np.int64), first) + (model.ends > 0)
                # words to look up, each once per row
                owner = np.repeat(np.arange(rows.num_rows), np.diff(first))
                rare = np.flatnonzero(~common[codes])
                pairs, n = np.unique(owner[rare] * np.int64(len(words) + 1) + codes[rare], return_counts=True)
                who, which = pairs // (len(words) + 1), pairs % (len(words) + 1)
                cells = pa.StructArray.from_arrays(
                    [words.take(pa.array(which)).cast(pa.binary()).cast(pa.string()), pa.array(cls[which], pa.int32()), pa.array(n, pa.int64())],
                    names=["word", "cls", "n"],
                )
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(who, np.arange(rows.num_rows + 1)), pa.int32()), cells)
                n_rows = rows.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n_rows)),
                        *[rows.column(c) for c in keep],
                        pa.array(np.diff(starts)),
                        pa.array(known),
                        pa.array(base),
                        pa.array(total + sums_by_row(within[codes], first)),
                        lists,
                    ],
                    names=["row", *keep, "n_tokens", "n_known", "base_score", "score", "rare"],
                )
                row += n_rows

    first_pass = stored(docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(tidy(run), schema), "lm-scores")
    rare = first_pass.select("row", F.explode("rare").alias("r")).select("row", "r.*").withColumnRenamed("n", "times")
    inside = F.element_at(F.array(*[F.lit(float(x)) for x in np.log10(model.class_tokens + model.class_words + 1)]), F.col("cls") + 1)
    counted = rare.join(model.counts.select("word", "n"), "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    logs = F.log10(F.col("c") + 1.0)
    sums = counted.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * (logs - F.lit(float(np.log10(model.tokens + model.distinct + 1))))).alias("more_base"),
        F.sum(F.col("times") * (logs - inside)).alias("more_score"),
    )
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    return first_pass.drop("rare").join(sums, "row", "left").select(
        *keep,
        "n_tokens",
        (F.col("n_known") + more("more_known")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + more("more_base")).alias("base_score"),
        (F.col("score") + more("more_score")).alias("score"),
    )
