import random

import numpy as np

import corpus_pipeline
from exposurekit.llm import simhash, vectors
from exposurekit.llm.queries import QUERIES

from . import brute

SCHEMA = "vec_id long, embedding array<float>, label int, node int"


def facts(rows):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows}


def test_registered_vectors(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = QUERIES["op8_nn_descent"](spark, small).collect()
    assert len(got) == len(rows) and facts(got) == brute.near_vectors(rows)


def test_groups_chains_copies_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)  # blocks and lists overflow
    rng, rows = np.random.default_rng(3), []

    def add(vector, label):
        rows.append((len(rows), None if vector is None else [None if x is None else float(x) for x in vector], label))

    for label in (1, 2):
        dense = rng.normal(size=24)
        for _ in range(60):  # more near ones than a list holds
            add((dense + rng.normal(size=24) * 0.03) * rng.uniform(0.1, 9), label)
        step = rng.normal(size=24)
        for i in range(12):  # a chain: neighbours near, ends not
            add(dense * -1 + step * 0.12 * i, label)
        same = rng.normal(size=24)
        for _ in range(40):
            add(same, label)
        for _ in range(80):
            add(rng.normal(size=24), label)
    add(dense, None)
    add(None, 1)
    add([0.0] * 24, 1)
    add([0.0] * 24, 1)
    add([float("nan")] + [1.0] * 23, 2)
    add([float("inf")] + [1.0] * 23, 2)
    add([None] + [1.0] * 23, 2)
    add([], 2)
    add(dense[:7], 2)
    add(dense[:7] * 2, 2)
    add([1e30] * 24, 1)
    add([1e-30] * 24, 1)
    frame = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    # float32 as stored is what is compared
    stored = [tuple(r)[:3] for r in frame.collect()]
    got = vectors.near_duplicates(frame).collect()
    assert len(got) == len(rows) and facts(got) == brute.near_vectors(stored)


def test_dense_groups_with_links_between_them(spark):
    rng, rows = np.random.default_rng(11), []
    for label in (1, 2):
        one, side = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
        for angle in (0, 0.14):  # cosine 0.99 between the middles
            for _ in range(20):  # more near ones than a list holds
                v = np.cos(angle) * one + np.sin(angle) * side + rng.normal(size=32) * 0.004
                rows.append((len(rows), [float(x) for x in v], label, 0))
    frame = spark.createDataFrame(rows, SCHEMA)
    want = brute.near_vectors([tuple(r)[:3] for r in frame.collect()])
    assert sorted({c for _, c, _ in want.values()}) == [0, 40] and min(n for n, _, _ in want.values()) > 20
    got = vectors.near_duplicates(frame).collect()
    assert facts(got) == want and {r.recall for r in got} == {1.0}


def test_audit_counts_all_links(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=16)
    rows = [(i, [float(x) for x in base + 0.001 * rng.normal(size=16)], 1) for i in range(vectors.NEAR * 2 + 1)]
    nodes = vectors.nodes_of(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).cache()
    ids = sorted(r.node for r in nodes.collect())
    half = [(u, ids[(i + k) % len(ids)], 1.0) for i, u in enumerate(ids) for k in range(1, vectors.NEAR + 1)]
    assert vectors.audit(spark.createDataFrame(half, vectors.EDGE), nodes, 0.98) == 0.5
    whole = spark.createDataFrame([(i, ids[0]) for i in ids], "node long, root long")
    assert vectors.audit(spark.createDataFrame([], vectors.EDGE), nodes, 0.98, whole) == 1
    nodes.unpersist()


def test_vectors_of_missing_ids_and_no_rows(spark):
    got = vectors.near_duplicates(spark.createDataFrame([(None, [1.0, 2.0], 1, 0), (5, [2.0, 4.0], 1, 0), (5, [2.0, 4.0], 1, 0)], SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in got) == [(0, 2, 5), (5, 2, 5), (5, 2, 5)]
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_audit_sees_missing_links(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=16)
    rows = [(i, [float(x) for x in base + 0.001 * rng.normal(size=16)], 1) for i in range(6)]
    nodes = vectors.nodes_of(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).cache()
    ids = [r.node for r in nodes.collect()]
    full = [(u, v, 1.0) for u in ids for v in ids if u != v]
    assert vectors.audit(spark.createDataFrame(full, vectors.EDGE), nodes, 0.98) == 1
    assert vectors.audit(spark.createDataFrame(full[:15], vectors.EDGE), nodes, 0.98) == 0.5
    nodes.unpersist()


def corpus(spark):
    rng = random.Random(4)
    words = {"en": "the of and to in that it was for on with as his they be at one have this from".split(), "de": "der die das und ist nicht ein zu den mit sich auf fur von dem des im war auch es".split()}
    made = {lang: ["".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(400)] for lang, letters in (("en", "theoasinrl"), ("de", "dergnuchsz"))}
    text = lambda lang, n: " ".join(rng.choice(words[lang] if rng.random() < 0.5 else made[lang]) for _ in range(n))
    passage = text("en", 70)
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "de"])
        rows.append((i, text(lang, rng.randint(30, 200)), lang, rng.choice(["a", "a", "b", "c", None])))
    rows += [(200 + i, f"{text('en', 60)} {passage} {text('en', 40)}", "en", "b") for i in range(5)]
    rows += [(300 + i, rows[i][1], rows[i][2], "d") for i in range(10)]  # exact copies
    rows += [(400, "12 34 56", None, "a"), (401, "", "en", "a"), (402, None, None, None), (403, "!?", "de", "b")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = corpus(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "repeated_passages", "mixed", "packed"]
    steps, before = dict(corpus_pipeline.STAGES), docs
    rows = {r.doc_id: r for r in docs.collect()}

    told = steps["language"](spark, docs, str(tmp_path))
    kept = {r.doc_id: r for r in told.collect()}
    assert told.columns == docs.columns and set(rows) - set(kept) == {400, 401, 402, 403}
    assert all(kept[i] == rows[i] for i in kept)

    alone = steps["near_duplicates"](spark, told, str(tmp_path))
    groups = brute.simhash([(i, r.text) for i, r in kept.items()])
    first = {r.doc_id: r for r in alone.collect()}
    assert alone.columns == docs.columns and set(first) == {i for i, (_, c) in groups.items() if c == i}
    assert not any(300 <= i < 400 for i in first)

    cut = steps["repeated_passages"](spark, alone, str(tmp_path))
    order = sorted(first)
    want = {i: w[4].decode("utf-8", "ignore") for i, w in zip(order, brute.repeats([first[i].text for i in order]))}
    left = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == docs.columns and {i: r.text for i, r in left.items()} == {i: t for i, t in want.items() if t}
    assert all(r.n_chars == len(r.text) for r in left.values()) and len(left[203].text) < len(first[203].text) - 200

    mix = steps["mixed"](spark, cut, str(tmp_path))
    times = {}
    for r in mix.collect():
        assert left[r.doc_id] == r
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    size = {i: len(brute.WORD.findall(r.text)) for i, r in left.items()}
    assert mix.columns == docs.columns and max(times.values()) <= 2
    assert 0 <= sum(size[i] * n for i, n in times.items()) - sum(size.values()) * 3 // 2 < max(size.values())

    pieces = steps["packed"](spark, mix, str(tmp_path)).collect()
    tokenizer = brute.tokenizer()
    total = sum(n * (len(tokenizer.encode(left[i].text, add_special_tokens=False).ids) + 1) for i, n in times.items())
    assert sum(r.length for r in pieces) == total
    assert len({r.sequence_id for r in pieces}) <= -(-total // 2048) + 1

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(r[c] for c in columns) for r in whole) == sorted(tuple(r[c] for c in columns) for r in pieces)
    assert before is docs


def test_stages_of_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, doc string"
    rows = [(None, "p q r s", "en", None, 7, "x"), (None, "p q r s", "en", None, 7, "x"), (5, "t u v w x", "en", "a", 9, "y"), (5, "y z " * 9, None, "a", 36, None), (6, None, "en", "b", None, "z")]
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, frame, str(tmp_path))
            count = after.count()
            assert name == "packed" or after.columns == frame.columns
            if name == "near_duplicates" and frame.count():
                assert count == 4
        if frame.count():
            assert stage(spark, frame, str(tmp_path)).count() == 5


def test_near_duplicates_stage_broadcasts_no_signatures(spark, tmp_path, monkeypatch):
    """Fingerprints are small when they are read, and 64 times that when they are joined."""
    shapes, stored = {}, simhash.stored

    def noted(df, label):
        shapes[label] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, label)

    monkeypatch.setattr(simhash, "stored", noted)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") in ("10MB", "10485760b")
    docs = corpus(spark)
    assert dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, str(tmp_path)).count() < docs.count()
    assert "SortMergeJoin" in shapes["simhash-buckets"] and "BroadcastExchange" not in shapes["simhash-buckets"]


def test_stages_are_registered(spark, small):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}_" for n in range(1, 11)} == {q.partition("_")[0] + "_" for q in __spark_entry__.queries() if q.startswith("op")}
