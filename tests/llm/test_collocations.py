import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import oracle
from exposurekit.llm import collocations, common
from exposurekit.llm.queries import ORACLES, QUERIES

from . import brute

SCHEMA = "doc_id long, text string, lang string, block int, phrase string, n int"


def plain(rows, longest, least, inside, top):
    """Every phrase of every piece counted on its own."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", brute.lowered(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in candidates.items():
            if any(
                100 * b >= inside * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in candidates.items()
            ):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, i, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i % 7, t, x, 1, "p", 2) for i, (t, x) in enumerate(rows)], SCHEMA).repartition(parts)


def corpus(seed):
    rng, rows = random.Random(seed), []
    words = ["".join(rng.choices("abcdeéß漢", k=rng.randint(1, 4))) for _ in range(30)]
    fixed = [" ".join(rng.choices(words, k=k)) for k in (2, 3, 4, 5)]
    for i in range(160):
        parts = [rng.choice(fixed) if rng.random() < 0.5 else rng.choice(words) for _ in range(rng.randint(0, 25))]
        text = "".join(p.upper() * (rng.random() < 0.2) or p + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ", " ", " ", " "]) for p in parts)
        rows.append((text, rng.choice(["de", "de", "de", None, "und", "x-1"])))
    return rows + [(None, "de"), ("", "fr"), (" .,;", "only breaks"), ("a a a a a a a a a a a a a", "same"), ("ha " * 5000, "de")]


@pytest.mark.parametrize("size, longest, least, inside, top", [(300, 3, 10, 50, 2000), (8 << 20, 4, 4, 80, 15)])
def test_phrases_equal_plain_ones(spark, monkeypatch, size, longest, least, inside, top):
    if size == 300:
        monkeypatch.setattr(collocations, "PACKED", 0)  # two numbers are two keys
    rows = corpus(size)
    got = collocations.collocations(frame(spark, rows), longest, least, inside, top, size)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got, want = sorted(map(tuple, got.collect())), plain(rows, longest, least, inside, top)
    assert got == want and len({r[0] for r in got}) > 2


def test_blocks_are_stored_one_by_one_in_buckets_of_few(spark, monkeypatch):
    stored, put, groups, shapes = collocations.stored, common.Bucketed.put, {}, {}

    def noted(df, label):
        files = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata for f in df.inputFiles()]
        groups[label] = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
        return df

    def putting(self, df, label, *more, **options):
        shapes[label] = df._jdf.queryExecution().executedPlan().toString()
        assert self.buckets * collocations.BUCKET >= len(groups["words"]) > 8 * collocations.BUCKET
        return noted(put(self, df, label, *more, **options), label)

    monkeypatch.setattr(collocations, "stored", lambda df, label, *rows: noted(stored(df, label, *rows), label))
    monkeypatch.setattr(common.Bucketed, "put", putting)
    rows = corpus(5)
    got = collocations.collocations(frame(spark, rows, parts=1), 3, 10, 50, 2000, 100).collect()
    assert sorted(map(tuple, got)) == plain(rows, 3, 10, 50, 2000)
    for label in ("words", "numbers_1", "phrases_1", "numbers_2", "phrases_2"):
        assert set(groups[label]) == {1}, label
    assert all("SortMergeJoin" in shapes[f"numbers_{k}"] for k in (1, 2))  # tables of groups are not broadcast


def test_slices_go_on_over_batches():
    texts = ["a" * n for n in (3, 4, 50, 1, 0, 90, 2, 2, 2, *[7] * 40, 1)] + [None]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[i : i + 2], pa.string())}) for i in range(0, len(texts), 2)]
    parts = [p.column("text").to_pylist() for p in common.even_slices(iter([*batches, batches[0].slice(0, 0)]), "text", 40)]
    assert [t for p in parts for t in p] == texts
    sizes = [sum(len(t or "") for t in p) for p in parts]
    assert all(n < 40 + max(len(t or "") for t in p) for n, p in zip(sizes, parts)) and min(sizes[-6:-1]) > 20


def test_pieces_end_phrases(spark):
    rows = [("one two", "a")] * 12 + [("one. two", "a"), ("one\ttwo\xa0x two", "a"), ("ONE\x0btwo", "a")] * 10
    got = {r.phrase: r.a for r in collocations.collocations(frame(spark, rows)).collect()}
    assert got == {p: a for _, _, p, a, *_ in plain(rows, 3, 10, 50, 2000)}
    assert got == {"one two": 12, "one two\xa0x two": 10}  # a no-break space is part of a word


def test_products_beyond_64_bits(spark):
    row = spark.createDataFrame([(3 * 10**12, [9 * 10**12, 3 * 10**12], [8 * 10**12, 3 * 10**12])], "n long, firsts array<long>, lasts array<long>")
    cut = row.select(collocations._cuts(2).alias("c")).first().c
    assert (cut.score, cut.l, cut.r) == (1_000_000 * 9 * 10**24 // (72 * 10**24), 9 * 10**12, 8 * 10**12)


def test_merge_join_of_places():
    rng = np.random.default_rng(3)
    for _ in range(20):
        left, right = (np.unique(rng.integers(0, 60, size=n)) for n in rng.integers(0, 40, size=2))
        i, j = collocations.merge_join(left, right)
        assert list(zip(left[i], right[j])) == [(x, x + 1) for x in left if x + 1 in right]


def test_the_bitmap_knows_all_frequent_groups(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 1 << 40, size=(500, 2))]
    bits = collocations.bitmap(spark.createDataFrame(pairs, "first long, last long").repartition(3))
    held = lambda p: (bits[(at := collocations._bits(*np.array(p).T)) >> 3] >> (at & 7).astype(np.uint8)) & 1
    assert held(pairs).all() and bits.nbytes == 1 << (collocations.BITMAP - 3)
    assert held(rng.integers(0, 1 << 40, size=(5000, 2))).mean() < 0.01


def test_no_words(spark):
    for rows in ([], [(None, "de"), (" . ", None)]):
        assert collocations.collocations(frame(spark, rows)).collect() == []


def test_registered_phrases_equal_sql(spark, small):
    name = "op13_setm_collocations"
    assert oracle.compare(QUERIES[name](spark, small), oracle.connect(small), ORACLES[name]) == []
