import math
import random
import re
import struct

import numpy as np
import pyarrow as pa
import xxhash

from exposurekit.llm import toxicity
from exposurekit.llm.queries import QUERIES

from . import brute

DOCS = "doc_id long, text string, score string, toxic int, key int"
MASK = (1 << 64) - 1


def slots_of(text):
    """Slots of one text, feature by feature."""
    words = [m.encode() for m in re.findall(r"[a-z\x80-\U0010ffff]+", brute.lowered(text))]
    h = [xxhash.xxh64_intdigest(w, toxicity.SEED) for w in words]
    odd = [int(x) for x in toxicity._ODD]

    def slot(x, kind):
        x = x * odd[kind] & MASK
        return ((x ^ (x >> 29)) * odd[(kind + 1) % 3] & MASK) >> (64 - toxicity.BITS)

    out = {slot(x, 0) for x in h}
    for apart in (1, 2):
        out |= {slot(a * odd[apart] + b & MASK, apart) for a, b in zip(h, h[apart:])}
    return sorted(out)


def plain_fit(rows, rounds, least):
    """FTRL over (text, toxic), one slot at a time."""
    seed = xxhash.xxh64_intdigest(struct.pack("<i", toxicity.SEED), 42)
    ordered = sorted({(_signed(xxhash.xxh64_intdigest(t.encode(), seed)), y, t) for t, y in rows})
    z, n = {}, {}

    def weight(s):
        beyond = max(abs(z.get(s, 0.0)) - (0 if s == toxicity.SLOTS else least), 0.0)
        return -math.copysign(beyond, z.get(s, 0.0)) / ((toxicity.BETA + math.sqrt(n.get(s, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(rounds):
        for _, y, text in ordered:
            at = [*slots_of(text), toxicity.SLOTS]
            w = [weight(s) for s in at]
            g = 0.5 * (1 + math.tanh(0.5 * sum(w))) - y
            for s, v in zip(at, w):
                old = n.get(s, 0.0)
                z[s] = z.get(s, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / toxicity.ALPHA * v
                n[s] = old + g * g
    return {s: weight(s) for s in z}


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def vocabulary(rng, n=60):
    return ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(n)]


def corpus(seed, n=240):
    """(doc_id, text, toxic or None): three words mark half of the toxic texts, and a pair the other half."""
    rng = random.Random(seed)
    words, rows = vocabulary(rng), []
    for i in range(n):
        toxic = int(i % 3 == 0)
        text = [rng.choice(words) for _ in range(rng.randint(5, 40))]
        if toxic and i % 2:
            text.insert(rng.randrange(len(text)), rng.choice(["Zzug,", "zzrot!", "ZZIP"]))
        elif toxic:
            at = rng.randrange(len(text))
            text[at:at] = ["qqa", "qqb"]
        else:
            text[0:0] = [rng.choice(["qqa", "qqb"])]
        rows.append((i, " ".join(text), toxic if i % 5 else None))
    return rows


def tables(spark, rows, parts=3):
    docs = spark.createDataFrame([(i, t, "s", 9, i) for i, t, _ in rows], DOCS).repartition(parts)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows if y is not None], "doc_id long, toxic int, text int")
    return docs, labels


def test_features_are_words_pairs_and_pairs_over_one():
    texts = ["", None, "One", "one TWO, three-four", "Straße über  X9x\x00", "a b a b a b", "ha " * 3000]
    slots, first = toxicity.distinct(*toxicity.features(pa.array(texts)), len(texts))
    assert [s.tolist() for s in np.split(slots, first[1:-1])] == [slots_of(t) for t in texts]
    assert len(toxicity.features(pa.array([], pa.string()))[0]) == 0


def test_weights_equal_plain_ones(spark):
    rows = corpus(1, 90)
    docs, labels = tables(spark, rows)
    model = toxicity.fit(docs, labels, rounds=2, least=1.5)
    want = plain_fit([(t, y) for _, t, y in rows if y is not None], 2, 1.5)
    nonzero = {s: w for s, w in want.items() if w and s != toxicity.SLOTS}
    assert set(model.slots.tolist()) == set(nonzero) and len(nonzero) > 3
    assert np.allclose(model.weights, [nonzero[s] for s in model.slots.tolist()], rtol=1e-5, atol=1e-6)
    assert math.isclose(model.bias, want[toxicity.SLOTS], rel_tol=1e-6)
    got = {r.doc_id: r for r in toxicity.score(docs, model, ["doc_id", "toxic"]).collect()}
    for i, text, _ in rows:
        total = sum(want.get(s, 0.0) for s in [*slots_of(text), toxicity.SLOTS])
        assert math.isclose(got[i].score, 1 / (1 + math.exp(-total)), rel_tol=1e-4) and got[i].toxic == 9
        assert got[i].predicted == int(got[i].score >= 0.7)


def test_held_out_texts_are_told_apart(spark):
    rows = corpus(2, 600)
    docs, labels = tables(spark, rows)
    model = toxicity.fit(docs.filter("doc_id < 400"), labels, least=3.0)
    assert 0 < len(model.slots) < len(set().union(*(slots_of(t) for _, t, _ in rows[:400]))) / 8  # most slots have no weight
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    right = [(got[i] >= 0.5) == (i % 3 == 0) for i in range(400, 600)]
    assert sum(right) / len(right) > 0.95


def test_odd_labels_and_texts(spark):
    rows = [(1, "a b", 0), (2, None, 1), (3, "", 0), (4, "c d", 1), (5, "no label", None)]
    docs, _ = tables(spark, [*rows, (1, "a b", 0), (None, "x y", None), (6, "word " * 700_000, None)])
    labels = spark.createDataFrame([(1, 0), (1, None), (2, 1), (3, 0), (4, 0), (4, 2), (None, 1), (99, 1), (7, None)], "doc_id long, toxic int")
    sample = {(r.text, r.toxic) for r in toxicity.labelled(docs, labels).collect()}
    assert sample == {("a b", 0), ("", 1), ("", 0), ("c d", 1)}  # copies once, the larger of several labels
    got = toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"]).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1


def test_the_sample_is_bounded(spark):
    rows = corpus(3, 400)
    docs, labels = tables(spark, rows)
    n = toxicity.labelled(docs, labels, limit=100).count()
    assert 60 < n < 140
    assert toxicity.labelled(docs, labels, limit=400).count() == sum(y is not None for *_, y in rows)


def test_empty_tables(spark):
    rows = corpus(4, 6)
    docs, labels = tables(spark, rows)
    none = toxicity.fit(docs, labels.limit(0))
    assert [r.score for r in toxicity.score(docs, none, ["doc_id"]).collect()] == [0.5] * 6
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels), ["doc_id"]).collect() == []


def test_registered_scores(spark, small):
    got = QUERIES["op12_ftrl_toxicity"](spark, small)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == spark.read.parquet(f"{small}/documents.parquet").count()
