import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import oracle
from exposurekit.llm import anchors, bwt, chat, common, langid, lm, mixing, simhash, suffix, syncmers
from exposurekit.llm.components import components
from exposurekit.llm.queries import ORACLES, QUERIES

from . import brute


def documents(spark, rows):
    """Rows (doc_id, text[, lang[, source]]) with columns whose names the operators use themselves."""
    full = [(*r, *[None, None][len(r) - 2 :], 1, "x") for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, tie int, part string")


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def plain_rows(docs):
    return sorted((r.doc_id, r.text) for r in docs.collect())


def test_words_are_those_of_the_pattern():
    texts = ["", None, " a", "b\tc\x0b\x0cd ", "é\xa0x  y", " ", "z"]
    words, first = common.words_of(*common.byte_view(pa.array(texts)))
    got = [w.decode() for w in common.values_of(words)]
    assert [got[a:b] for a, b in zip(first, first[1:])] == [brute.WORD.findall(t or "") for t in texts]


def test_slices_keep_rows_and_long_texts():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (3, 50, 1, 1, 0, 400, 2)] + [None]})
    parts = list(common.slices(batch, "text", 40))
    assert [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert len(parts) > 2


# language model


def lm_facts(rows, held):
    words = {i: brute.WORD.findall(brute.lowered(t)) for i, t in rows}
    counts = Counter(w for i in words if not held(i) for w in words[i])
    ends = sum(not held(i) for i in words)
    tokens, distinct = sum(counts.values()) + ends, len(counts) + (ends > 0)
    below = math.log10(tokens + distinct + 1)
    out = {}
    for i, ws in words.items():
        base = sum(math.log10(counts[w] + 1) - below for w in ws) + math.log10(ends + 1) - below
        out[i] = (len(ws) + 1, sum(counts[w] > 0 for w in ws) + (ends > 0), tokens, base)
    return out


def held(doc_id, parts=7, which=2):
    return zlib.crc32(str(doc_id).encode()) % parts == which


def test_language_model_facts_and_held_out_gain(spark, small, plain_rows):
    got = QUERIES["op1_log_bilinear_lm"](spark, small).collect()
    want = lm_facts(plain_rows, held)
    assert len(got) == len(plain_rows)
    for r in got:
        n, known, tokens, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), n, known, tokens)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    away = [r for r in got if r.held_out]
    assert sum(r.score for r in away) > sum(r.base_score for r in away)


def test_rare_words_are_looked_up(spark, plain_rows, docs, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 50)
    model = lm.fit(docs.filter(common.fold(docs.doc_id, 7) != 2))
    assert 0 < len(model.words) <= 50
    want = lm_facts(plain_rows, held)
    for r in lm.score(docs, model, ["doc_id"]).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)


def test_probabilities_add_up_to_one(spark, docs):
    model = lm.fit(docs.limit(60))
    logs = lm.Scorer(model.params)
    every = np.arange(lm.SYMBOLS)
    for two, one in ((0, 0), (5, 900), (2000, 3)):
        assert np.exp(logs(np.full_like(every, two), np.full_like(every, one), every)).sum() == pytest.approx(1, abs=1e-4)
    rows = [r for r in model.counts.collect() if model.words.get(r.word.encode(), (-1, 0))[0] < 0]
    inside = Counter()
    for r in rows:
        inside[r.cls] += r.n + 1
    for c in range(lm.CLASSES):  # the words of a class and its unknown word
        assert inside[c] + 1 == model.class_tokens[c] + model.class_words[c] + 1


def test_model_of_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "a b\ta"), (4, "A B é " * 3000), (5, "zz" * 9000)]
    model = lm.fit(documents(spark, rows))
    got = lm.score(documents(spark, rows), model, ["doc_id", "part"]).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 2, 4, 9001]
    assert all(r.n_known == r.n_tokens and math.isfinite(r.score) and r.part == "x" for r in got)
    assert lm.score(documents(spark, []), model, ["doc_id"]).count() == 0
    none = lm.score(documents(spark, rows), lm.fit(documents(spark, [])), ["doc_id"]).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and math.isfinite(r.score) for r in none)


# suffix-array dedup


def stretch_texts(seed, n=120):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcdé ", k=rng.randint(20, 160))) for _ in range(12)]
    rows = [
        "".join(rng.choice(pool)[rng.randint(0, 10) :] if rng.random() < 0.8 else "".join(rng.choices("xyz", k=rng.randint(1, 60))) for _ in range(rng.randint(0, 9)))
        for _ in range(n)
    ]
    return [*rows, None, "", "a" * 700, "ab" * 400, "a" * 701 + "b" * 300, "c" * 100, "c" * 99, rows[3], rows[3], "日本" * 200]


@pytest.mark.parametrize(("crowd", "bucket_bytes"), [(8192, 4 << 20), (8192, 4000), (3, 20_000)])
def test_repeats_are_those_of_a_scan(spark, crowd, bucket_bytes):
    texts = stretch_texts(3)
    rows = documents(spark, [(3 * i, t) for i, t in enumerate(texts)]).repartition(6)
    got = {r.doc_id: r for r in suffix.without_repeats(rows, 100, crowd, bucket_bytes, with_kept=True, carry=["part"]).collect()}
    for i, want in enumerate(brute.repeats(texts)):
        r = got[3 * i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == want and r.part == "x"
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert r.kept_text == want[4].decode("utf-8", "ignore")


def test_repeats_of_rows_that_share_an_id(spark):
    text = "".join(random.Random(1).choices("abcdefgh", k=300))
    rows = [(None, text), (None, text), (7, text), (7, text), (1, "q" + text)]
    got = suffix.without_repeats(documents(spark, rows)).collect()
    assert sorted(r.n_removed for r in got) == [0, 300, 300, 300, 300]
    assert [r.doc_id for r in got if not r.n_removed] == [None]
    assert suffix.without_repeats(documents(spark, [])).count() == 0


def test_registered_repeats(spark, small, plain_rows):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op3_suffix_array_dedup"](spark, small).collect()}
    want = brute.repeats([t for _, t in plain_rows])
    assert got == {i: w[:4] for (i, _), w in zip(plain_rows, want)}


def test_transform_and_merge():
    rng = random.Random(7)
    shards = [["".join(rng.choices("ab", k=rng.randint(5, 40))) for _ in range(9)] for _ in range(3)]
    made = []
    for strings in shards:
        data = np.frombuffer("".join(strings).encode(), np.uint8)
        lengths = np.array([len(s) for s in strings])
        symbols = bwt.transform(data, lengths)
        suffixes = sorted((s[j:], i, j) for i, s in enumerate(strings) for j in range(len(s) + 1))
        assert symbols.tolist() == [ord(strings[i][j - 1]) + 1 if j else 0 for _, i, j in suffixes]
        string, position = bwt.places(symbols, bwt.steps(symbols), lengths)
        assert list(zip(string.tolist(), position.tolist())) == [(i, j) for _, i, j in suffixes]
        made.append((symbols, lengths))
    every = [s for strings in shards for s in strings]
    string, position, interval = bwt.repeats(made, 8)
    got = {}
    for s, p, k in zip(string.tolist(), position.tolist(), interval.tolist()):
        got.setdefault(k, set()).add((s, p))
    want = {}
    for i, s in enumerate(every):
        for p in range(len(s) - 7):
            want.setdefault(s[p : p + 8], set()).add((i, p))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_every_window_has_one_stretch_and_equal_windows_the_same_gram():
    texts = [(t or "").encode() for t in stretch_texts(9, 40)]
    offsets = np.cumsum([0, *map(len, texts)])
    row, low, high, gram = anchors.stretches(np.frombuffer(b"".join(texts), np.uint8), offsets, 100)
    owned, of_window = Counter(), {}
    for r, a, b, g in zip(row.tolist(), low.tolist(), high.tolist(), gram.tolist()):
        for p in range(a, b + 1):
            owned[r, p] += 1
            assert of_window.setdefault(texts[r][p : p + 100], g) == g
    assert owned == Counter({(i, p): 1 for i, t in enumerate(texts) for p in range(len(t) - 99)})


# mixing


def test_mixing_equals_its_sql(spark, small):
    assert oracle.compare(QUERIES["op4_weighted_fair_mixing"](spark, small), oracle.connect(small), ORACLES["op4_weighted_fair_mixing"]) == []


def test_mixing_of_odd_rows(spark):
    rows = [(i, "w " * (i % 9), None, ["b", "a", None, "é", "z"][i % 5 if i > 40 else 0]) for i in range(400)]
    rows += [(None, "a b", None, "a"), (3, None, None, "b"), (3, "x y", None, "b"), (3, "x y", None, "b"), (9, "", None, "only empty")]
    got = mixing.mix(documents(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    total = sum(r["size"] for r in got)
    assert sum(r.taken for r in got) == total * 3 // 2
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert Counter(map(tuple, mixing.mix(documents(spark, rows[::-1]).repartition(5)).collect())) == Counter(map(tuple, got))
    targets = mixing.targets(mixing.sizes(documents(spark, rows))).collect()
    assert sum(r.target for r in targets) == pytest.approx(1.5 * total)
    assert all(r.target <= 2 * r.source_size for r in targets)
    assert mixing.mix(documents(spark, [])).count() == 0
    assert [tuple(r) for r in mixing.mix(documents(spark, [(1, None, None, "a")])).collect()] == [(1, 0, 0, 0.0, 0)]


# language


def test_language_of_held_out_texts(spark, small, docs):
    told = {r.doc_id: r.lang for r in docs.collect()}
    got = QUERIES["op5_language_id"](spark, small).collect()
    assert len(got) == len(told) and all(0 <= r.score <= 1 and r.held_out == held(r.doc_id, 3, 1) for r in got)
    away = [r for r in got if r.held_out]
    assert sum(told[r.doc_id] == r.lang_pred for r in away) >= 0.97 * len(away)


def test_language_of_odd_rows(spark):
    train = [(1, "the cat and the dog", "en", None), (2, "der hund und die katze", "de", None), (3, None, "de", None), (4, "le chat", None, None)]
    model = langid.fit(documents(spark, train))
    assert model.langs == ["de", "en"]
    texts = [None, "", "12 34 !?", "the dog", "hunde katzen", "DER HUND", "日本", "the " * 20_000]
    rows = documents(spark, [(i, t, "xx", "s") for i, t in enumerate(texts)] + [(None, "the dog"), (None, "the dog")])
    got = langid.predict(rows, model, ["doc_id", "lang", "part"]).collect()
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in range(8)] == ["und", "und", "und", "en", "de", "de", "de", "en"]
    assert [by_id[i].score for i in range(3)] == [0, 0, 0] and by_id[6].score == 0.5  # nothing known: a draw
    assert sum(r.doc_id is None for r in got) == 2
    nobody = langid.fit(documents(spark, []))
    assert {(r.lang_pred, r.score) for r in langid.predict(rows, nobody, ["doc_id"]).collect()} == {("und", 0.0)}
    assert langid.predict(documents(spark, []), model, ["doc_id"]).count() == 0


@pytest.mark.parametrize("held", [1 << 21, 300, 0])
def test_language_equals_plain_counts_whatever_tasks_hold(spark, held):
    rng = random.Random(11)
    sounds = {"aa": "abcde", "bb": "cdefgéß", "cc": "日本語学", None: "xyz"}
    word = lambda s: "".join(rng.choices(s, k=rng.randint(1, 5)))
    lexicon = {x: [word(s) for _ in range(40)] for x, s in sounds.items()}
    text = lambda x: " ".join(rng.choice(lexicon[x]) if rng.random() < 0.7 else word(sounds[x]).title() for _ in range(rng.randint(0, 12)))
    train = [(text(x), x) for x in rng.choices(list(sounds), k=60)] + [(None, "aa"), ("", "bb"), ("7", "dd")]
    texts = [text(x) for x in rng.choices(list(sounds), k=60)] + [None, "", "42", "ab ab ab", "q", "hot " * 400, "_a_", "x" * 5000]
    texts += ["zzz hot"] * 50  # an unseen word in many rows
    model = langid.fit(documents(spark, [(i, t, x, None) for i, (t, x) in enumerate(train)]), held, held)
    assert model.whole == (held > 300) and len(model.words.n) <= held and len(model.grams.n) <= held
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(documents(spark, list(enumerate(texts))), model, ["doc_id", "tie"]).collect()}
    for i, (lang, score) in enumerate(brute.languages(train, texts)):
        assert got[i][1] == pytest.approx(score, rel=1e-6, abs=1e-9), texts[i]
        assert got[i][0] == lang or score <= 0.5 + 1e-6, texts[i]  # sums in another order may break a draw otherwise


def test_grams_back_off_to_shorter_ones(spark):
    model = langid.fit(documents(spark, [(1, "xyz xyz known known", "a", None), (2, "q known", "b", None)]), longest=2)
    asked = [b"xyzy", b"vv", b"q"]
    scores = model.backed_off(asked)
    known, there = model.known_words([b"known", b"xyz", b"never"])
    assert there.tolist() == [True, True, False] and known[0, 0] > known[0, 1]
    assert scores[1].tolist() == [0, 0] and scores[0, 0] > scores[0, 1] and scores[2, 1] > scores[2, 0]


def test_tasks_hold_the_most_frequent(spark):
    cells = lambda *n: [(i, v) for i, v in enumerate(n)]
    rows = [(1, 9, cells(4, 5)), (2, 7, cells(7)), (3, 7, cells(3, 4)), (4, 1, cells(1)), (-5, 1, cells(1))]
    table = spark.createDataFrame(rows, "key long, total long, cells array<struct<lang:int,n:long>>")
    kept = lambda limit: sorted(langid.Held.of(table, limit).keys.tolist())
    assert (kept(1), kept(2), kept(4), kept(5), kept(7)) == ([], [1], [1], [1, 2, 3], [-5, 1, 2, 3, 4])
    held = langid.Held.of(table, 7)
    at = held.find(np.array([3, 8, -5]))
    assert at[1] == -1 and held.whole
    assert held.gains(at[[0, 2]], np.array([0, 1]), 2, 2) == pytest.approx(np.log([[7, 9], [3, 1]]))


# chat


def chat_rows(seed):
    rng, rows = random.Random(seed), []
    for _ in range(2500):
        conv = rng.choice([1, 1, 1, 1, 2, 3, None])
        turn = rng.choice([rng.randint(0, 700), 5, None]) if conv == 1 else rng.choice([0, 1, 2, None])
        rows.append((conv, turn, rng.choice(["a", "b", "c", "system", None]), rng.choice([None, "", "é😀" * rng.randint(0, 3) + str(rng.randint(0, 999))])))
    return rows + rows[:300] + [(8, 0, "system", "alone"), (9, 0, "user", "x" * 300_000)]


def test_rotation_equals_its_sql(spark, small, tmp_path):
    assert oracle.compare(QUERIES["op6_perspective_rotation"](spark, small), oracle.connect(small), ORACLES["op6_perspective_rotation"]) == []
    frame = spark.createDataFrame([(*r, 1) for r in chat_rows(0)], "conv_id long, turn long, role string, text string, part int")
    frame.coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("part-*.parquet")).rename(tmp_path / "conversations.parquet")
    got = chat.digest(chat.rotate(frame))
    assert got.filter("part > 0").count() > 0 and got.filter("conv_id = 8").count() == 0
    assert oracle.compare(got, oracle.connect(str(tmp_path)), ORACLES["op6_perspective_rotation"]) == []


def test_masks_hold_the_speakers_words(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hé"), (1, 2, "bob", "yo"), (1, 3, "ann", "")]
    got = {r.perspective: r for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {"ann", "bob"}
    ann = got["ann"]
    assert ann.rendered == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhé<|im_end|>\n<|im_start|>user name=bob\nyo<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    )
    assert [ann.rendered[m.start : m.end] for m in ann.masks] == ["hé<|im_end|>", "<|im_end|>"]
    assert [got["bob"].rendered[m.start : m.end] for m in got["bob"].masks] == ["yo<|im_end|>"]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.rotate(empty).count() == 0


def test_parts_of_a_long_dialogue_are_the_whole_of_it(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "ann" if i % 2 else "bob", f"tüxt {i}") for i in range(1, 300)] + [(1, 300, "cid", "late")]
    rows += [(2, 0, "system", "alone")] + [(2, i, "system", "x") for i in range(1, 300)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    parts = {}
    for r in sorted(chat.rotate(frame).collect(), key=lambda r: r.part):
        parts.setdefault((r.conv_id, r.perspective), []).append(r)
    assert set(parts) == {(1, "ann"), (1, "bob"), (1, "cid")}
    for (_, who), own in parts.items():
        assert [r.part for r in own] == [0, 1] and sum(r.n_turns for r in own) == 301
        whole = "".join(r.rendered for r in own)
        said = [whole[m.start : m.end] for r in own for m in r.masks]
        assert said == [f"{text}<|im_end|>" for _, _, role, text in rows[:301] if role == who]
        assert whole.startswith("<|im_start|>system\nbe kind") and whole.count("<|im_start|>assistant") == len(said)


# SimHash


def test_near_duplicates_of_documents(spark, small, plain_rows):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash_near_duplicates"](spark, small).collect()}
    assert got == brute.simhash(plain_rows)


def test_near_duplicates_of_odd_rows(spark):
    texts = [None, "", " \t", "one", "ONE", "one two", "one  two", "a b c", "A b\nc d", "é b c", "x " * 30_000, "y" * 100_000, "a b c"]
    want = brute.simhash(list(enumerate(texts)))
    got = simhash.near_duplicates(documents(spark, list(enumerate(texts)))).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want
    same = simhash.near_duplicates(documents(spark, [(None, "p q r"), (4, "p q r"), (4, "p q r"), (None, "s")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in same) == [(0, 0), (0, 4), (4, 4), (4, 4)]
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize(("bits", "bucket"), [(0, 32), (1, 2), (2, 2), (2, 32), (3, 2), (4, 32)])
def test_links_connect_what_is_near(spark, bits, bucket):
    rng, prints = random.Random(bits), set()
    for center in (0, (1 << 64) - 1, rng.getrandbits(64)):
        for _ in range(40):
            x = center
            for j in rng.choices(range(64), k=rng.randint(0, 5)):
                x ^= 1 << j
            prints.add(x)
    signed = {x: x - (1 << 64) if x >> 63 else x for x in prints}
    groups = brute.Groups(signed.values())
    for a in prints:
        for b in prints:
            if a < b and bin(a ^ b).count("1") <= bits:
                groups.join(signed[a], signed[b])
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed.values()], "fp long"), bits, bucket)
    found = {r.id: r.root for r in components(edges).collect()}
    assert all(found.get(x, x) == groups.find(x) for x in signed.values())


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_signatures_are_never_broadcast(spark, monkeypatch, bits):
    shapes, before = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    shape = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(simhash, "stored", lambda df, label: shapes.append(shape(df)) or common.stored(df, label))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        prints = spark.createDataFrame([(1 << i,) for i in range(40)], "fp long")
        shapes.append(shape(simhash.links(prints, bits, 2)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(shapes) == 2 and all("SortMergeJoin" in s and "BroadcastExchange" not in s for s in shapes)


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(500, 400), (400, 500), (7, 7)]
    got = {r.id: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 400: 400, 500: 400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# syncmers


def test_fingerprints_of_documents(spark, small, plain_rows):
    got = sorted(tuple(r) for r in QUERIES["op10_closed_syncmers"](spark, small).collect())
    assert got == brute.fingerprints(plain_rows)
    assert sum(r[5] for r in got) / len(got) > 0.5 > 0.05 > sum(r[6] for r in got) / len(got)


def test_fingerprints_of_odd_rows(spark):
    rows = [(-5, "a b c d e f g h"), (0, None), (1, ""), (2, "one"), (3, "é😀 x y"), (9, "w " * 40_000), (10**12, "the same " * 9), (10**12 + 1, "the same " * 9)]
    got = sorted(tuple(r) for r in syncmers.fingerprints(documents(spark, rows)).collect())
    assert got == brute.fingerprints(rows)
    alone = syncmers.fingerprints(documents(spark, [(4, "a b c d e f")])).collect()
    assert [tuple(r) for r in alone] == brute.fingerprints([(4, "a b c d e f")])
    same = syncmers.fingerprints(documents(spark, [(None, "p q"), (5, "r s"), (5, "r s"), (5, "t")])).collect()
    assert sorted(r.n_chars for r in same) == [1, 3, 3, 3]
    assert syncmers.fingerprints(documents(spark, [])).count() == 0


def test_next_rows_over_many_fine_buckets(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "MAX_VALUE_BUCKETS", 4)
    rows = [(int(x), f"text {x} of some words") for x in np.random.default_rng(0).choice(10**6, 300, replace=False)]
    spread, along = syncmers.by_neighbours(documents(spark, rows).select("doc_id", "text"), rows_per_bucket=8)
    from pyspark.sql import functions as F

    after = spread.withColumn("next", F.lead("text").over(along)).filter("_extra = 0").collect()
    ordered = sorted(rows)
    assert {r.doc_id: r.next for r in after} == {a[0]: b[1] for a, b in zip(ordered, ordered[1:] + ordered[:1])}


def test_shared_passages_have_constant_shift(spark):
    from pyspark.sql import functions as F

    words = [f"w{i}" for i in range(60)]
    row = spark.createDataFrame([(" ".join(words), " ".join(["new", "start"] + words[10:]))], "a string, b string")
    pairs = row.select(syncmers.shared_passages(syncmers.anchors(F.col("a")), syncmers.anchors(F.col("b"))).alias("p")).first().p
    assert len(pairs) > 10 and {p.a - p.b for p in pairs} == {8}


def test_main_paths_of_native_operators_have_no_python(spark, small):
    for name in ("op6_perspective_rotation", "op10_closed_syncmers"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert not [w for w in ("Python", "Arrow", "Pandas") if w in plan]
