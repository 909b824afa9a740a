import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from exposurekit.llm import packing, simple8b, token_files
from exposurekit.llm.queries import QUERIES
from exposurekit.llm.tokens import Encoder, default_tokenizer

from . import brute

ODD = ["", None, " ", "a", "foo  bar \n\n x  y   z", "it's we'll ''s .'s 12  34\t\tq", " lead", "trail  ", "é è ê  ñ\n", "x<|endoftext|> y",
       "a\x1c b\x85 c", "😀 😀 z‍ q", "日本 語", "　 a \xa0  b", "×÷ a÷ b", "w" * 5000, "a," * 3000]


@pytest.fixture(scope="module")
def plain():
    return brute.tokenizer()


def test_ids_are_the_librarys(plain):
    random.seed(1)
    letters = list(" \t\n\r\x0b\x0c\x1c\x85\xa0　abé'sñ÷1.,ß😀日")
    texts = ODD + ["".join(random.choices(letters, k=random.randint(0, 14))) for _ in range(4000)]
    for encoder in (Encoder(default_tokenizer()), Encoder(default_tokenizer(), max_pieces=50)):
        for part in (texts[:1000], texts[1000:], texts[:5], []):
            ids, lengths = encoder.encode(pa.array(part, pa.string()))
            want = [e.ids for e in plain.encode_batch([t or "" for t in part], add_special_tokens=False)]
            assert lengths.tolist() == [len(w) for w in want]
            assert ids.tolist() == [i for w in want for i in w]


def test_added_tokens_are_the_librarys():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(default_tokenizer()), Encoder(default_tokenizer())
    texts = ["a <|endoftext|>b", "x, y", None, "<|endoftext|>" * 3, "", "é <|endoftext|> it's <|endoftext", "<|endoftext |>"]
    for part in (texts, texts[1:3], texts[3:4], []):
        ids, lengths = own.encode(pa.array(part, pa.string()))
        want = [e.ids for e in plain.encode_batch([t or "" for t in part], add_special_tokens=False)]
        assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert own.encode(pa.array(texts[:1], pa.string()))[0].tolist() == [64, 220, 50256, 65]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 1 << 17), st.integers(0, (1 << 64) - 1)), max_size=90), st.integers(1, 40))
def test_words_decode_to_the_values(values, block):
    numbers = np.array(values, np.uint64)
    words, starts = simple8b.encode(numbers, block)
    assert simple8b.decode(words, starts, len(numbers), block).tolist() == values
    if len(values) > 2 * block:
        assert simple8b.decode(words, starts[1:3], block, block).tolist() == values[block : 2 * block]


def test_small_values_take_few_words():
    assert len(simple8b.encode(np.ones(1024, np.uint8))[0]) == 18
    assert len(simple8b.encode(np.full(1024, 50_000))[0]) == 342


def rows_with(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, part string")  # a name the operators use themselves


def test_token_files(spark, plain):
    texts = ODD + ["some words of text " * 400] * 3
    ids = list(range(len(texts)))
    random.Random(2).shuffle(ids)
    got = {r.doc_id: r for r in token_files.token_files(spark, rows_with(spark, texts, ids).repartition(4)).collect()}
    at = 0
    for doc, text in sorted(zip(ids, texts)):
        want = plain.encode(text or "", add_special_tokens=False).ids + [2]
        assert tuple(got[doc]) == (doc, at, len(want), brute.crc(want))
        at += len(want)


def test_token_files_in_several_shards(spark, tmp_path):
    texts = [f"document {i} " * (i % 7) for i in range(60)]
    manifest = token_files.write_token_files(rows_with(spark, texts), str(tmp_path), 2, file_ids=40)
    assert manifest.count() > 5
    assert not [p for p in tmp_path.iterdir() if p.suffix != ".s8b"]
    whole = {tuple(r) for r in token_files.token_files(spark, rows_with(spark, texts)).collect()}
    assert {tuple(r) for r in token_files.read_token_files(manifest, str(tmp_path)).collect()} == whole
    name = manifest.orderBy("part", "number").first()["name"]
    reader = token_files.FileReader(str(tmp_path), name)
    assert reader.ids(3, 11).tolist() == reader.ids(0, reader.n_ids).tolist()[3:11]


def test_token_files_of_missing_ids_and_no_rows(spark):
    got = token_files.token_files(spark, rows_with(spark, ["a", "b b", "b b"], [None, 4, 4])).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 4, 4] and [r.start for r in got] == [0, 2, 5]
    assert token_files.token_files(spark, rows_with(spark, [])).count() == 0


def test_registered_token_files(spark, small, plain):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    got = QUERIES["op2_token_files"](spark, small).orderBy("doc_id").collect()
    at = 0
    for doc, row in zip(docs, got, strict=True):
        ids = plain.encode(doc.text or "", add_special_tokens=False).ids + [2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc.doc_id, at, len(ids), brute.crc(ids))
        at += len(ids)


def faults(pieces, lengths, capacity):
    return brute.packing_faults([(r.doc_id, r.piece, r.start, r.length, r.sequence_id, r.offset) for r in pieces], lengths, capacity)


def test_packing_of_documents(spark, plain):
    texts = ODD + ["one two three " * n for n in (1, 10, 50, 300, 1200)]
    got = packing.pack_documents(rows_with(spark, texts)).collect()
    ids = {i: plain.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    assert not faults(got, {i: len(x) for i, x in ids.items()}, 2048)
    assert all(brute.crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 for r in got)
    assert packing.pack_documents(rows_with(spark, [])).count() == 0


def test_registered_packing(spark, small, plain):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    lengths = {d.doc_id: len(plain.encode(d.text or "", add_special_tokens=False).ids) + 1 for d in docs}
    got = QUERIES["op9_best_fit_packing"](spark, small).collect()
    assert not faults(got, lengths, 2048)
    assert len({r.sequence_id for r in got}) <= 1 + packing.lower_bound(np.array([r.length for r in got]))


def test_packing_over_several_partitions_and_rounds(spark):
    lengths = np.random.default_rng(1).integers(1, 101, 3000)
    rows = spark.createDataFrame([(i % 2900, int(n)) for i, n in enumerate(lengths)], "k long, length long")
    got = packing.pack(rows, ["k"], capacity=100, part_pieces=200).collect()
    assert Counter((r.k, r.length) for r in got) == Counter((i % 2900, int(n)) for i, n in enumerate(lengths))
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 100
    assert len(places) <= 1.04 * packing.lower_bound(lengths, 100)  # partitions of 200 are less even than the whole


def test_bound_and_best_fit():
    rng = np.random.default_rng(5)
    for _ in range(40):
        lengths = rng.integers(1, 31, rng.integers(0, 12))
        sequence, place, used = packing.best_fit_decreasing(lengths, 30)
        assert packing.lower_bound(lengths, 30) <= used
        assert np.bincount(sequence, lengths, used).max(initial=0) <= 30
    assert packing.lower_bound(np.array([16] * 7), 30) == 7  # more than half a sequence each
    assert packing.lower_bound(np.array([11] * 7), 30) == 4
