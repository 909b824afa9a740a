"""Language of whole texts: known words by log frequency per language, unseen ones by ever shorter character n-grams.

The model is counted over all training texts: words per language, and from the table
of words the n-grams inside ``_word_``. A word that was counted at least ``LEAST``
times scores the log of its smoothed share in each language. Any other word scores the
mean over its characters' longest known n-grams, from ``LONGEST`` down to one; where no
n-gram is known it says nothing. A text's score sums its words; confidence is the best
language's posterior with equal priors.

Words and n-grams are known by 64-bit hashes. Tasks hold those that occur most often,
``HELD`` counts of each kind, as sorted arrays. Where that is all there are, texts are
scored in one pass. Where it is not, the other words are written out with the number
of their row and looked up in the whole tables by joins with spread hot keys; a score
does not depend on what tasks hold.

Null text, and text without a letter, is ``und`` with score 0. Words are runs of
letters and marks of any script, lower-cased. Languages with equal scores: the first
by code point. A training row without text or language is left out. No training row
at all: ``und`` for every text. A very long text is a slice of its own; other columns
are carried, or not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from .common import byte_view, ragged, slices, stored, sums_by_row, tidy, values_of, words_of

HELD = 1 << 21  # counts of words, and of n-grams, that tasks hold: 20 bytes each
LEAST = 2
LONGEST = 4
COUNT_BYTES = 8 << 20  # text counted at once
WINDOWS = 1 << 21  # n-grams counted at once
UNKNOWN = "und"

# ASCII other than letters separates words; bytes of other characters belong to them
BREAKS = np.ones(256, bool)
BREAKS[128:] = False
BREAKS[[*range(65, 91), *range(97, 123)]] = False


def _lower(text: Column) -> Column:
    return F.lower(text)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all rows with text and language; counted in tasks first, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", COUNT_BYTES):
                words, first = words_of(*byte_view(rows.column("text")), BREAKS)
                langs = rows.column("lang").dictionary_encode()
                owner = np.repeat(langs.indices.to_numpy(), np.diff(first))
                coded = words.dictionary_encode()
                count = len(coded.dictionary)
                n = np.bincount(owner * np.int64(count) + coded.indices.to_numpy(), minlength=0)
                cells = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.dictionary.take(pa.array(cells // max(count, 1))).cast(pa.string()),
                        coded.dictionary.take(pa.array(cells % max(count, 1))).cast(pa.binary()).cast(pa.string()),
                        pa.array(n[cells]),
                    ],
                    names=["lang", "word", "n"],
                )

    told = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("lang").cast("string"), _lower(F.col("text")).alias("text"))
    counted = told.mapInArrow(tidy(run), "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _marked(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all ``_word_`` one after the other, and their lengths."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lengths = pc.utf8_length(pa.array(words, pa.large_binary()).cast(pa.large_string())).to_numpy() + 2
    return np.frombuffer((b"_" + b"__".join(words) + b"_").decode().encode("utf-32-le"), "<u4").astype(np.uint64), lengths


def _grams(words: list[bytes], longest: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Per size, hashes of the n-grams that start at each place; the place's word, how far its word goes on, and whether it is a mark."""
    points, lengths = _marked(words)
    owner = np.repeat(np.arange(len(words)), lengths)
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))
    hashes = [_mixed(points + np.uint64(1))]
    for size in range(2, longest + 1):
        longer, n = hashes[-1].copy(), max(len(points) - size + 1, 0)
        longer[:n] = _mixed(hashes[-1][:n] + points[size - 1 :][:n])
        hashes.append(longer)
    return [h.view(np.int64) for h in hashes], owner, room, points == ord("_")


def _there(room: np.ndarray, mark: np.ndarray, size: int) -> np.ndarray:
    """Places where an n-gram of ``size`` starts; the mark alone tells nothing."""
    return (room >= size) & ~mark if size == 1 else room >= size


def gram_counts(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, size, key, n) of n-grams inside ``_word_``; every distinct word counts once, as unseen words are like rare ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, these in waiting.items():
                hashes, _, room, mark = _grams(these, longest)
                for size in range(1, longest + 1):
                    keys, n = np.unique(hashes[size - 1][_there(room, mark, size)], return_counts=True)
                    columns = [pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), size), pa.int32()), pa.array(keys), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "size", "key", "n"])
            waiting.clear()

        size = 0
        for batch in batches:
            for lang, word in zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist()):
                waiting.setdefault(lang, []).append(word.encode())
                size += longest * (len(word) + 2)
                if size > WINDOWS:
                    yield from counted()
                    size = 0
        yield from counted()

    found = words.select("lang", "word").mapInArrow(tidy(run), "lang string, size int, key long, n long")
    return found.groupBy("lang", "size", "key").agg(F.sum("n").alias("n"))


class Held:
    """The most frequent keys of a table (key, total, cells: lang and n), sorted, with the cells of each; at most ``limit`` cells."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, langs: np.ndarray, n: np.ndarray, whole: bool):
        order = np.argsort(keys)
        starts = (np.cumsum(sizes) - sizes)[order]
        cells = ragged(starts, sizes[order])
        self.keys, self.whole = keys[order], whole
        self.ends = np.concatenate([[0], np.cumsum(sizes[order])]).astype(np.int32)
        self.langs, self.n = langs[cells].astype(np.int32), n[cells].astype(np.int64)

    @staticmethod
    def of(table: DataFrame, limit: int) -> Held:
        """Keys with equal totals are all held or none, so that the choice is the table's alone."""
        cells = F.sum(F.size("cells"))
        spread = table.groupBy("total").agg(cells.alias("cells"))  # distinct totals are few
        every = spread.agg(F.sum("cells")).first()[0] or 0
        held = table
        if every > limit:
            above = spread.withColumn("above", F.sum("cells").over(Window.orderBy(F.desc("total")))).filter(F.col("above") <= limit)
            least = above.agg(F.min("total")).first()[0]
            held = table.filter(F.col("total") >= least) if least is not None else table.limit(0)
        found = held.select("key", "cells").toArrow()
        keys, lists = found.column("key").combine_chunks(), found.column("cells").combine_chunks()
        flat = lists.flatten()
        sizes = pc.fill_null(pc.list_value_length(lists), 0)
        return Held(*(x.to_numpy(zero_copy_only=False) for x in (keys, sizes, flat.field(0), flat.field(1))), every <= limit)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 for those not held."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def gains(self, at: np.ndarray, owner: np.ndarray, n: int, langs: int) -> np.ndarray:
        """By owner and language, the sum over keys of what their counts add to the log share of a count of zero."""
        sizes = self.ends[at + 1] - self.ends[at]
        cells = ragged(self.ends[at].astype(np.int64), sizes)
        place = np.repeat(owner, sizes) * langs + self.langs[cells]
        return np.bincount(place, weights=np.log(2 * self.n[cells] + 1), minlength=n * langs).astype(float).reshape(n, langs)


def word_keys(words: list[bytes]) -> np.ndarray:
    """What ``xxhash64`` gives for them in Spark."""
    return np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64).view(np.int64)


class Model:
    """What tasks need, sent to them as a broadcast variable; ``known`` and ``pieces``, the whole tables, stay on the driver."""

    def __init__(self, langs: list[str], longest: int, word_totals: dict, gram_totals: dict, words: Held | None, grams: Held | None):
        base = lambda t: np.array([np.log(0.5) - np.log(n + 0.5 * (v + 1)) for n, v in t])
        self.langs, self.longest, self.words, self.grams = langs, longest, words, grams
        self.word_base = base([word_totals.get(x, (0, 0)) for x in langs])  # log share of a count of zero
        self.gram_base = np.stack([base([gram_totals.get((x, s), (0, 0)) for x in langs]) for s in range(1, longest + 1)])
        self.known: DataFrame | None = None
        self.pieces: DataFrame | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "pieces")}

    @property
    def whole(self) -> bool:
        return not self.langs or self.words.whole and self.grams.whole

    def known_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log shares of the words that are held, a column per language, and which these are."""
        at = self.words.find(word_keys(words))
        some = np.flatnonzero(at >= 0)
        out = self.words.gains(at[some], some, len(words), len(self.langs))
        out[some] += self.word_base
        return out, at >= 0

    def backed_off(self, words: list[bytes], found: tuple | None = None) -> np.ndarray:
        """Mean log shares of the longest known n-grams of words.

        ``found``: word, place in it, size and (lang, n) cells of n-grams that are known but not held.
        """
        out = np.zeros((len(words), len(self.langs)))
        hashes, owner, room, mark = _grams(words, self.longest)
        size = np.zeros(len(owner), np.int64)
        at = np.full(len(owner), -1)
        for s in range(self.longest, 0, -1):
            open_ = np.flatnonzero((size == 0) & _there(room, mark, s))
            hit = self.grams.find(hashes[s - 1][open_])
            at[open_], size[open_] = hit, np.where(hit >= 0, s, 0)
        if found:
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            for word, place, s, cells in found:
                j = first[word] + place
                if s > size[j]:
                    size[j], at[j] = s, -1
                    for lang, n in cells:
                        out[word, lang] += np.log(2 * n + 1)
        some = np.flatnonzero(at >= 0)
        out += self.grams.gains(at[some], owner[some], len(words), len(self.langs))
        told = np.flatnonzero(size)
        np.add.at(out, owner[told], self.gram_base[size[told] - 1])
        places = np.bincount(owner[told], minlength=len(words))
        return out / np.maximum(places, 1)[:, None]

    def open_grams(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, place, size, key) of n-grams longer than the longest held one at their place."""
        hashes, owner, room, mark = _grams(words, self.longest)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        place = np.arange(len(owner)) - first[owner]
        left, out = np.ones(len(owner), bool), []
        for s in range(self.longest, 0, -1):
            here = np.flatnonzero(left & _there(room, mark, s))
            hit = self.grams.find(hashes[s - 1][here]) >= 0
            left[here[hit]] = False
            here = here[~hit]
            out.append((owner[here], place[here], np.full(len(here), s), hashes[s - 1][here]))
        return tuple(np.concatenate(x) for x in zip(*out))


def _by_key(counts: DataFrame, langs: list[str], least: int) -> DataFrame:
    """(key, total, cells): one row per key that was counted ``least`` times in all languages."""
    lang = (F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1).cast("int")
    cells = F.sort_array(F.collect_list(F.struct(lang.alias("lang"), "n"))).alias("cells")  # a row per language
    return counts.groupBy("key").agg(F.sum("n").alias("total"), cells).filter(F.col("total") >= least)


def fit(docs: DataFrame, words: int = HELD, grams: int = HELD, longest: int = LONGEST, least: int = LEAST) -> Model:
    """Counts over all of ``docs`` (text, lang); what is gathered is at most ``words`` and ``grams`` counts, and two sums per language."""
    counts = stored(word_counts(docs), "lang-words")
    word_totals = {r.lang: (r.n, r.v) for r in counts.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    langs = sorted(word_totals)
    if not langs:
        return Model(langs, longest, {}, {}, None, None)
    pieces = stored(gram_counts(counts, longest), "lang-grams")
    sums = pieces.groupBy("lang", "size").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    known = stored(_by_key(counts.select(F.xxhash64("word").alias("key"), "lang", "n"), langs, least), "lang-known")
    pieces = stored(_by_key(pieces, langs, 1), "lang-pieces")
    model = Model(langs, longest, word_totals, {(r.lang, r["size"]): (r.n, r.v) for r in sums.collect()}, Held.of(known, words), Held.of(pieces, grams))
    model.known, model.pieces = known, pieces
    return model


def _looked_up(words: DataFrame, model: Model, shared) -> DataFrame:
    """(key, logs) of distinct words (key, word) that tasks do not hold."""
    base = F.array(*[F.lit(float(x)) for x in model.word_base])
    count = lambda i: F.coalesce(F.element_at("_n", i), F.lit(0))
    seen = words.select("key").join(model.known.select("key", "cells"), "key").withColumn("_n", F.map_from_entries("cells"))
    seen = seen.select("key", F.transform(base, lambda b, i: b + F.log(2 * count(i) + 1.0)).alias("logs"))
    unseen = words.join(model.known.select("key"), "key", "left_anti")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            word, place, size, gram = shared.value.open_grams([w.encode() for w in batch.column("word").to_pylist()])
            columns = [pa.array(keys[word]), pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(gram)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "place", "size", "key"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("found").to_pylist()
            found = [(i, f["place"], f["size"], [(c["lang"], c["n"]) for c in f["cells"]]) for i, fs in enumerate(lists) for f in fs or []]
            logs = shared.value.backed_off([w.encode() for w in batch.column("word").to_pylist()], found)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(list(logs), pa.list_(pa.float64()))], names=["key", "logs"])

    if model.grams.whole:
        told = unseen.withColumn("found", F.lit(None).cast("array<struct<place:int,size:int,cells:array<struct<lang:int,n:long>>>>"))
    else:
        asked = stored(unseen.select("key", "word").mapInArrow(tidy(ask), "word long, place int, size int, key long"), "lang-asked")
        there = lookup_join(asked, model.pieces.select("key", "cells"), ["key"], ["word", "place"]).filter(F.col("cells").isNotNull())
        longest = there.groupBy("word", "place").agg(F.max_by(F.struct("place", "size", "cells"), "size").alias("f"))
        found = longest.groupBy(F.col("word").alias("key")).agg(F.collect_list("f").alias("found"))  # a row per place of one word
        told = unseen.join(found, "key", "left")
    return seen.unionByName(told.select("key", "word", "found").mapInArrow(tidy(tell), "key long, logs array<double>"))


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred and score. Only ``text`` is looked at."""
    if not model.langs:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    rare = "" if model.whole else ", _rare array<struct<word:string,times:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        row, langs = TaskContext.get().partitionId() << 40, len(model.langs)
        for batch in batches:
            for rows in slices(batch, "_low"):
                words, first = words_of(*byte_view(rows.column("_low")), BREAKS)
                coded = words.dictionary_encode()
                distinct, at, n_rows = values_of(coded.dictionary), coded.indices.to_numpy(), rows.num_rows
                scores, known = model.known_words(distinct)
                if model.whole:
                    unseen = np.flatnonzero(~known)
                    scores[unseen] = model.backed_off([distinct[i] for i in unseen])
                total = np.stack([sums_by_row(scores[at, j], first) for j in range(langs)], axis=1)
                out = [pa.array(np.arange(row, row + n_rows)), *[rows.column(c) for c in keep], rows.column("_letter"), pa.array(list(total), pa.list_(pa.float64()))]
                names = ["_row", *keep, "_letter", "_total"]
                if not model.whole:  # words to look up, each once per row
                    owner, open_ = np.repeat(np.arange(n_rows), np.diff(first)), np.flatnonzero(~known[at])
                    pairs, times = np.unique(owner[open_] * np.int64(len(distinct) + 1) + at[open_], return_counts=True)
                    who, which = pairs // (len(distinct) + 1), pairs % (len(distinct) + 1)
                    text = coded.dictionary.take(pa.array(which)).cast(pa.binary()).cast(pa.string())
                    cells = pa.StructArray.from_arrays([text, pa.array(times, pa.int64())], names=["word", "times"])
                    out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(who, np.arange(n_rows + 1)), pa.int32()), cells))
                    names.append("_rare")
                yield pa.RecordBatch.from_arrays(out, names=names)
                row += n_rows

    low, letter = _lower(F.col("text")), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    scored = docs.select(*keep, low.alias("_low"), letter.alias("_letter")).mapInArrow(tidy(run), f"_row long, {kept}, _letter boolean, _total array<double>{rare}")
    if not model.whole:
        scored = stored(scored, "lang-scores")
        pairs = scored.select("_row", F.explode("_rare").alias("_r")).select("_row", F.xxhash64("_r.word").alias("key"), "_r.*")
        logs = stored(_looked_up(pairs.groupBy("key").agg(F.min("word").alias("word")), model, shared), "lang-rare")
        more = F.array(*[F.sum(F.col("times") * F.col("logs")[j]) for j in range(len(model.langs))])
        sums = lookup_join(pairs.drop("word"), logs, ["key"], ["_row"]).groupBy("_row").agg(more.alias("_more"))
        total = F.when(F.col("_more").isNull(), F.col("_total")).otherwise(F.zip_with("_total", "_more", lambda a, b: a + b))
        scored = scored.drop("_rare").join(sums, "_row", "left").withColumn("_total", total)
    whole = scored.withColumn("_most", F.array_max("_total"))
    names = F.array(*[F.lit(x) for x in model.langs])
    best = F.element_at(names, F.array_position("_total", F.col("_most")).cast("int"))
    sure = 1 / F.aggregate("_total", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("_most")))
    return whole.select(
        *keep,
        F.when(F.col("_letter"), best).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col("_letter"), sure).otherwise(F.lit(0.0)).alias("score"),
    )
