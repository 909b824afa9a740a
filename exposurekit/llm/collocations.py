"""Collocations of every language by set-oriented mining (SETM): sorted occurrence relations, merge joins, semi-joins.

Texts fall into pieces, pieces into words. The relation of length one has a row
(place, word) for every occurrence; places count up, with a gap between pieces and
texts. Relations are written in blocks of whole texts, sorted by place, bucketed by
block. For each length the groups of all blocks are counted together, those that occur
often enough are numbered by frequency, and a block's relation is semi-joined with the
numbers of its frequent groups before it is extended: the relation of length k
merge-joined with itself, place against next place, gives the occurrences of length
k + 1, since two phrases of k words at neighbouring places make one of k + 1. So only
occurrences all of whose parts are frequent live on, and blocks never meet: what is
shuffled are group counts and the numbers sent back. Which groups a block asks numbers
for is told by a bitmap of the frequent ones (2^``BITMAP`` bits, whatever there are);
a group that it lets through by chance has no number.

Blocks are stored one by one, and buckets hold few of them, so the blocks that a task has
in memory do not grow in number with the corpus. Tables of groups are joined by sorting at
any size: Spark sees the size of their packed files and would broadcast them.

A frequent group keeps the counts of all its first and last parts, from which every
cut's score comes; products are decimals of 38 digits, so counts up to 10^14 are exact.

Null text is empty. A missing language is ``und``, together with those that say so.
Repeated rows and ids count as often as they occur; ids and other columns are not
looked at. A very long text is a block of its own. No word: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, MERGE, Bucketed, binary_array, byte_view, even_slices, few_rows, stored, tidy, word_spans

LONGEST = 3
LEAST = 10
INSIDE = 50  # percent of a phrase's occurrences inside one longer phrase from which on it is dropped
TOP = 2000
BLOCK_BYTES = 4 << 20
BLOCKS = 1  # a task looks at at once, and Parquet writes and reads
ROWS = 250  # texts a task gets at once
BUCKET = 4  # blocks a bucket holds on average
PAIRS = 1 << 21  # occurrences a task counts before it hands them on
BITMAP = 26
PACKED = 1 << 31  # two smaller numbers are one key
UNKNOWN = "und"

BREAKS = np.zeros(256, bool)  # between pieces
BREAKS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
SEPARATORS = BREAKS.copy()
SEPARATORS[[0x20, 0x09]] = True

RELATION = "block long, places binary, ids binary"


def _relation(block: int, places: np.ndarray, ids: np.ndarray, more: dict | None = None) -> pa.RecordBatch:
    """One block: places as steps from one occurrence to the next."""
    columns = {
        "block": pa.array([block]),
        "places": pa.array([np.diff(places, prepend=0).astype("<i4").tobytes()], pa.binary()),
        "ids": pa.array([ids.tobytes()], pa.binary()),
        **(more or {}),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _blocks(batches: Iterator[pa.RecordBatch], kind: str = "<i8") -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """Each block's row, number, places and ids."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            places = np.cumsum(np.frombuffer(row.column("places")[0].as_buffer(), "<i4"), dtype=np.int64)
            yield row, row.column("block")[0].as_py(), places, np.frombuffer(row.column("ids")[0].as_buffer(), kind)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the most frequent first; each key's position among them; and how often each occurs."""
    distinct, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return distinct[order], place[at], n[order]


def occurrences(docs: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """The relation of length one in blocks, ids being places in the list ``groups`` of (lang, word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for rows in even_slices(batches, "text", size):
            data, offsets = byte_view(rows.column("text"))
            data = LOWER[data]
            starts, ends, first = word_spans(data, offsets, SEPARATORS)
            if not len(starts):
                continue
            words = binary_array(data[~SEPARATORS[data]], np.concatenate([[0], np.cumsum(ends - starts)])).dictionary_encode()
            langs = rows.column("lang").dictionary_encode()
            owner = np.repeat(np.arange(rows.num_rows), np.diff(first))
            lang = langs.indices.to_numpy()[owner].astype(np.int64)
            piece = np.cumsum(BREAKS[data], dtype=np.int32)[starts]
            fresh = (np.diff(owner, prepend=owner[0]) > 0) | (np.diff(piece, prepend=piece[0]) > 0)
            distinct = len(words.dictionary)
            cells, codes, n = _grouped(lang * distinct + words.indices.to_numpy())
            groups = pa.StructArray.from_arrays(
                [
                    langs.dictionary.take(pa.array(cells // distinct)),
                    words.dictionary.take(pa.array(cells % distinct)).cast(pa.binary()).cast(pa.string()),
                    pa.array(n),
                ],
                names=["lang", "word", "n"],
            )
            lists = pa.ListArray.from_arrays(pa.array([0, len(groups)], pa.int32()), groups)
            yield _relation(block, np.arange(len(starts)) + np.cumsum(fresh), codes.astype("<i4"), {"groups": lists})
            block += 1

    told = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text")
    return told.mapInArrow(tidy(run), f"{RELATION}, groups array<struct<lang:string,word:string,n:long>>")


def merge_join(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with ``left[i] + 1 == right[j]``; both ascending, without repeats."""
    j = np.searchsorted(right, left + 1)
    i = np.flatnonzero(np.append(right, -1)[j] == left + 1)
    return i, j[i]


def _listed(tables: Bucketed, found: DataFrame, label: str) -> DataFrame:
    """One row per block, with each other column of ``found`` as little-endian 64-bit integers; no longer than the block's text."""
    columns = [c for c in found.columns if c != "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting = None, []

        def told() -> pa.RecordBatch:
            packed = [pa.array([np.concatenate(x).astype("<i8").tobytes()], pa.binary()) for x in zip(*waiting)]
            return pa.RecordBatch.from_arrays([pa.array([block]), *packed], names=["block", *columns])

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for low, high in zip(cuts, cuts[1:]):
                if low < high and blocks[low] != block:
                    if waiting:
                        yield told()
                    block, waiting = int(blocks[low]), []
                if low < high:
                    waiting.append([batch.column(c).slice(low, high - low).to_numpy() for c in columns])
        if waiting:
            yield told()

    ordered = tables.dealt(found.select("block", *[F.col(c).cast("long").alias(c) for c in columns])).sortWithinPartitions("block")
    listed = ordered.mapInArrow(tidy(run), ", ".join(["block long", *(f"{c} binary" for c in columns)]))
    return tables.put(listed, label, there=True, stored_rows=BLOCKS)


def _numbers_of(row: pa.RecordBatch, *columns: str) -> list[np.ndarray]:
    return [np.frombuffer(row.column(c)[0].as_buffer(), "<i8") for c in columns]


def _kept(relation: DataFrame, numbers: DataFrame) -> DataFrame:
    """The relation of length one, semi-joined with the (code, id) of each block's frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block, places, codes in _blocks(batches, "<i4"):
            known, ids = _numbers_of(row, "code", "id")
            told = np.full(codes.max(initial=-1) + 1, -1, np.int64)
            told[known] = ids
            mine = told[codes]
            yield _relation(block, places[mine >= 0], mine[mine >= 0].astype("<i8"))

    return relation.join(numbers, "block").select("block", "places", "ids", "code", "id").mapInArrow(tidy(run), RELATION)


def _longer_kept(relation: DataFrame, numbers: DataFrame) -> DataFrame:
    """The relation one word longer, semi-joined with the (first, last, id) of each block's frequent groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block, places, ids in _blocks(batches):
            a, b = merge_join(places, places)
            first, last, number = _numbers_of(row, "first", "last", "id")
            ordered = np.unique(ids)
            size = len(ordered)
            keys = np.searchsorted(ordered, first) * size + np.searchsorted(ordered, last)  # a block's own, without gaps
            order = np.argsort(keys)
            mine = np.searchsorted(ordered, ids[a]) * size + np.searchsorted(ordered, ids[b])
            at = np.minimum(np.searchsorted(keys[order], mine), len(keys) - 1)
            there = keys[order][at] == mine
            yield _relation(block, places[a][there], number[order][at[there]].astype("<i8"))

    return relation.join(numbers, "block").select("block", "places", "ids", "first", "last", "id").mapInArrow(tidy(run), RELATION)


def _pair_counts(relation: DataFrame, packed: bool) -> DataFrame:
    """(first, last, n) of the groups one word longer, over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def counted() -> pa.RecordBatch:
            found = np.concatenate(waiting, axis=-1)
            waiting.clear()
            if packed:
                found.sort()
                starts = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
                n = np.diff(starts, append=len(found))
                return pa.RecordBatch.from_arrays([pa.array(found[starts]), pa.array(n)], names=["pair", "n"])
            first, last = found
            return pa.RecordBatch.from_arrays([pa.array(first), pa.array(last), pa.array(np.ones(len(first), np.int64))], names=["first", "last", "n"])

        for _, _, places, ids in _blocks(batches):
            a, b = merge_join(places, places)
            waiting.append(ids[a] << 32 | ids[b] if packed else np.stack([ids[a], ids[b]]))
            size += len(a)
            if size > PAIRS:
                yield counted()
                size = 0
        if size:
            yield counted()

    rows = relation.select("block", "places", "ids")
    if not packed:
        return rows.mapInArrow(tidy(run), "first long, last long, n long").groupBy("first", "last").agg(F.sum("n").alias("n"))
    counts = rows.mapInArrow(tidy(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return counts.select(F.shiftright("pair", 32).alias("first"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("last"), "n")


def _bits(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Place of each group in the bitmap."""
    x = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + last.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x >> np.uint64(64 - BITMAP)).astype(np.int64)


def bitmap(frequent: DataFrame) -> np.ndarray:
    """2^``BITMAP`` bits, set at the places of the groups (first, last) of ``frequent``; tasks' bitmaps are merged by tasks."""
    size, parts = 1 << (BITMAP - 3), 64

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            at = _bits(*(batch.column(c).to_numpy() for c in ("first", "last")))
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        for i, part in enumerate(np.split(bits, parts)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"part": [i], "bits": [part.tobytes()]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, bits in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist()):
                found[i] = found.get(i, 0) | np.frombuffer(bits, np.uint8)
        for i, bits in found.items():
            yield pa.RecordBatch.from_pydict({"part": [i], "bits": [bits.tobytes()]})

    marked = frequent.select("first", "last").mapInArrow(tidy(mark), "part long, bits binary")
    out = np.zeros((parts, size // parts), np.uint8)
    for r in marked.repartition(parts, "part").mapInArrow(merge, "part long, bits binary").collect():
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _asked(relation: DataFrame, bits: np.ndarray) -> DataFrame:
    """(block, first, last): a block's groups one word longer that the bitmap lets through."""
    shared = relation.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, places, ids in _blocks(batches):
            a, b = merge_join(places, places)
            first, last = ids[a], ids[b]
            at = _bits(first, last)
            there = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            first, last = first[there], last[there]
            ordered = np.unique(first)
            code = np.unique(last)
            keys = np.unique(np.searchsorted(ordered, first) * max(len(code), 1) + np.searchsorted(code, last))
            columns = [pa.array(np.full(len(keys), block)), pa.array(ordered[keys // max(len(code), 1)]), pa.array(code[keys % max(len(code), 1)])]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "first", "last"])

    return relation.select("block", "places", "ids").mapInArrow(tidy(run), "block long, first long, last long")


def _numbered(counts: DataFrame, least: int, by: list[str], label: str) -> DataFrame:
    """(id, by, n) of the groups that occur ``least`` times; the most frequent have the smallest ids, which have no gaps."""
    number = F.monotonically_increasing_id()
    frequent = stored(counts.filter(F.col("n") >= least), f"{label}-counts")
    ordered = frequent.repartitionByRange(F.desc("n"), *by).sortWithinPartitions(F.desc("n"), *by)
    ordered = stored(ordered.select(*by, "n", F.shiftright(number, 33).alias("part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), label)
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = parts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))  # a row per task
    return ordered.join(F.broadcast(before), "part").select((F.col("before") + F.col("i")).alias("id"), *by, "n")


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, size: int = BLOCK_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and by length the phrases that occur ``least`` times in a language.

    Phrases: (id, first, last, n, lang, phrase, word, firsts, lasts); ``first`` and
    ``last`` are the ids of the phrases without the last and the first word, ``firsts``
    and ``lasts`` the counts of its first and last 1, 2, ... words.
    """
    spark = docs.sparkSession
    with few_rows(spark, ROWS):
        read = stored(occurrences(docs, size), "words", BLOCKS)
    with Bucketed(spark, "block", max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-read.count() // BUCKET))) as tables:
        cells = read.select("block", F.posexplode("groups").alias("code", "g")).select("block", "code", "g.*")
        totals = stored(cells.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
        by = ["lang", "word"]
        words = _numbered(cells.groupBy(*by).agg(F.sum("n").alias("n")), least, by, "phrases-1")
        found = [words.select("id", "n", "lang", F.col("word").alias("phrase"), "word", F.array("n").alias("firsts"), F.array("n").alias("lasts"))]
        numbers = _listed(tables, cells.select("block", "code", *by).hint(MERGE).join(words.select(*by, "id"), by).select("block", "code", "id"), "numbers_1")
        relation = tables.put(_kept(tables.dealt(read.select("block", "places", "ids")), numbers), "phrases_1", there=True, rows=BLOCKS, stored_rows=BLOCKS)
        for k in range(2, longest + 1):
            by = ["first", "last"]
            packed = found[-1].count() < PACKED
            with few_rows(spark, BLOCKS):
                counted = _numbered(_pair_counts(relation, packed), least, by, f"phrases-{k}")
            if k < longest:
                bits = bitmap(counted)
                with few_rows(spark, BLOCKS):
                    asked = stored(_asked(relation, bits), f"phrases-{k}-asked")
                numbers = _listed(tables, asked.hint(MERGE).join(counted.select(*by, "id"), by).select("block", *by, "id"), f"numbers_{k}")
                relation = tables.put(_longer_kept(relation, numbers), f"phrases_{k}", there=True, rows=BLOCKS, stored_rows=BLOCKS)
            before = found[-1]
            start = before.select(F.col("id").alias("first"), "lang", F.col("phrase").alias("start"), "firsts")
            end = before.select(F.col("id").alias("last"), "word", "lasts")
            longer = counted.join(start.hint(MERGE), "first").join(end.hint(MERGE), "last")
            found.append(
                stored(
                    longer.select(
                        "id",
                        "first",
                        "last",
                        "n",
                        "lang",
                        F.concat_ws(" ", "start", "word").alias("phrase"),
                        "word",
                        F.concat("firsts", F.array("n")).alias("firsts"),
                        F.concat("lasts", F.array("n")).alias("lasts"),
                    ),
                    f"phrases-{k}-named",
                )
            )
    return totals, found


def _exact(c: Column) -> Column:
    return c.cast("decimal(14,0)")


def _cuts(k: int) -> Column:
    """(score, l, r) of every cut of a phrase of ``k`` words."""

    def cut(i: int) -> Column:
        a, left, right = F.col("n"), F.element_at("firsts", i), F.element_at("lasts", k - i)
        score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (_exact(a) * _exact(a)), _exact(left) * _exact(right))
        return F.struct(score.cast("long").alias("score"), F.lit(i).alias("at"), left.alias("l"), right.alias("r"))

    return F.array_min(F.array(*[cut(i) for i in range(1, k)]))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, top: int = TOP, size: int = BLOCK_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): every language's ``top`` phrases of two words or more."""
    totals, found = frequent_phrases(docs, longest, least, size)
    kept = None
    for k, phrases in enumerate(found[1:], 2):
        if k < longest:  # a longer phrase with most of the occurrences has a part, one word longer than this one, with as many
            longer = found[k].select(F.explode(F.array("first", "last")).alias("id"), F.col("n").alias("most"))
            longer = longer.groupBy("id").agg(F.max("most").alias("most"))
            phrases = phrases.join(longer, "id", "left").filter(F.col("most").isNull() | (F.col("most") * 100 < F.col("n") * inside))
        rows = phrases.select("lang", "phrase", F.col("n").alias("a"), _cuts(k).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        kept = rows if kept is None else kept.unionByName(rows)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, doc, unnest(parts) AS piece, generate_subscripts(parts, 1) AS at
  FROM (SELECT lang, row_number() OVER () AS doc,
               string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS parts
        FROM documents)),
words AS MATERIALIZED (
  SELECT lang, w FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces) WHERE len(w) > 0),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
  FROM words, (SELECT unnest(range(1, {LONGEST} + 1)) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY lang, k, phrase HAVING count(*) >= {LEAST}),
cuts AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, x.k AS cut,
         (1000000::HUGEINT * c.a * c.a - (1000000::HUGEINT * c.a * c.a) % (x.a::HUGEINT * y.a)) // (x.a::HUGEINT * y.a) AS score
  FROM f AS c
  JOIN f AS x ON x.lang = c.lang AND x.k < c.k AND starts_with(c.phrase, x.phrase || ' ')
  JOIN f AS y ON y.lang = c.lang AND y.k = c.k - x.k AND c.phrase = x.phrase || ' ' || y.phrase
  WHERE c.k >= 2),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
dropped AS (
  SELECT DISTINCT c.lang, c.phrase FROM f AS c
  JOIN f AS p ON p.lang = c.lang AND p.k > c.k AND contains(' ' || p.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * p.a >= {INSIDE} * c.a
  WHERE c.k = 2),
ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank, b.phrase, a, l, r, score
  FROM best AS b ANTI JOIN dropped AS d ON d.lang = b.lang AND d.phrase = b.phrase)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
