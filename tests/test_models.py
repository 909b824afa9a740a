import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from exposurekit.operators import encode, metrics, models, profile, ranking, resample

FEATURES = ["color", "level", "signal", "noise"]


@pytest.fixture(scope="module")
def planted(spark):
    """``signal`` decides the label, ``noise`` does not; some values are missing."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1200):
        signal, y = float(rng.normal()), 0
        y = int(signal + 0.3 * rng.normal() > 0)
        color = [None, "red", "blue"][i % 3]
        rows.append((i, y, color, i % 4, None if i % 10 == 0 else signal, float(rng.normal())))
    df = spark.createDataFrame(rows, "row_id long, clicked int, color string, level int, signal double, noise double")
    train, test = df.filter("row_id < 900").cache(), df.filter("row_id >= 900").cache()
    encoder = encode.encode_train_fit(train, FEATURES)
    return train, test, encoder, models.training_set(encoder, train, "clicked")


def vectors(encoder, df):
    rows = encoder.transform(df).select(vector_to_array("features").alias("v")).collect()
    return np.array([r["v"] for r in rows])


def test_layout_and_unseen_levels(spark, planted):
    train, _, encoder, _ = planted
    assert encoder.numeric == ("signal", "noise") and encoder.flagged == ("signal",)
    # levels blue, nan, red and 0..3, then two numbers and one gap flag
    assert list(encoder.slots) == ["color"] * 3 + ["level"] * 4 + ["signal", "noise", "signal"]
    odd = spark.createDataFrame([(1, 0, "green", 9, None, 2.0)], train.schema)
    v = vectors(encoder, odd)[0]
    assert v[:7].sum() == 0
    assert v[7] == pytest.approx(encoder.means["signal"]) and v[8] == 2.0 and v[9] == 1.0
    assert len(v) == len(encoder.slots)


def test_encoder_variants(planted):
    train, test, _, _ = planted
    more = test.withColumn("color", F.lit("green"))
    assert encode.encode_union_fit(train, more, FEATURES).slots.count("color") == 4
    assert encode.encode_train_fit(train, FEATURES).slots.count("color") == 3
    assert encode.encode_object_only(train, test, FEATURES).numeric == ("level", "signal", "noise")
    text = encode.encode_all_string(train, test, ["color", "level"])
    assert text.numeric == () and len(text.slots) == 7


def test_a_million_levels_go_through_a_join(spark):
    rows = spark.range(1_000_000).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("t"), F.lit(1.0).alias("x"))
    encoder = encode.fit_encoder(rows, ["t", "x"], ["x"])
    assert encoder.sizes == {"t": 1_000_000} and len(encoder.slots) == 1_000_001 and encoder.slots[999_999] == "t" and encoder.slots[1_000_000] == "x"
    entries = encoder.entries(rows)
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("UDF", "Python", "posexplode") if w in plan]
    got = entries.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("position").alias("d"), F.sum("value").alias("v")).first()
    assert tuple(got) == (2_000_000, 1_000_001, 2_000_000.0)


def test_entries_are_those_of_the_vector(planted):
    _, test, encoder, _ = planted
    odd = test.withColumn("row_id", F.xxhash64(*test.columns))
    dense = {r.row_id: r.v for r in encoder.transform(odd).select("row_id", vector_to_array("features").alias("v")).collect()}
    sparse = {}
    for r in encoder.entries(odd).collect():
        sparse.setdefault(r.row_id, {})[r.position] = r.value
    assert {k: {i: x for i, x in enumerate(v) if x} for k, v in dense.items()} == sparse


@pytest.mark.parametrize("fit", [models.fit_logreg, models.fit_sparse_tree, lambda e, t: models.fit_gbt(e, t, rounds=10)])
def test_models_find_the_signal(planted, fit):
    _, test, encoder, encoded = planted
    scored = fit(encoder, encoded).predict(test)
    report = metrics.classification_report(scored, y="clicked").first()
    assert report["acc"] > 0.75
    assert scored.filter("hard <> int(prob >= 0.5)").count() == 0


def test_boosted_trees_stop_early(planted):
    """The part of the fit that only tables of ``early_stop_rows`` rows reach."""
    _, test, encoder, encoded = planted
    scorer = models.fit_gbt(encoder, encoded, rounds=40, early_stop_rows=100, validation_share=0.2, tol=0.01)
    assert scorer.model.getValidationTol() == 0.01 and 0 < scorer.model.getNumTrees < 40
    report = metrics.classification_report(scorer.predict(test), y="clicked").first()
    assert report["acc"] > 0.75


def test_group_ablation_reaches_the_early_stop(planted):
    train, test, _, _ = planted
    learner = lambda e, t: models.fit_gbt(e, t, rounds=10, early_stop_rows=100)
    table = models.group_ablation(train, test, {"with": ["color", "signal"], "without": ["color", "noise"]}, learners={"GBT": learner}).collect()
    value = {(r["group"], r["metric"]): r["value"] for r in table}
    assert len(value) == 8 and value[("with", "auc")] > value[("without", "auc")] + 0.2


@pytest.mark.parametrize("parallelism", [None, 2])
def test_group_ablation_without_pinned_threads(planted, monkeypatch, parallelism):
    """PYSPARK_PIN_THREAD=false, where PySpark's gateway is of another class and its thread wrapper gives the session back."""
    train, test, _, _ = planted
    monkeypatch.setattr("py4j.clientserver.ClientServer", type("Pinned", (), {}))
    more = {} if parallelism is None else {"parallelism": parallelism}
    groups = {"with": ["color", "signal"], "without": ["color", "noise"]}
    table = models.group_ablation(train, test, groups, learners={"Tree": models.fit_sparse_tree}, **more).collect()
    value = {(r["group"], r["metric"]): r["value"] for r in table}
    assert len(value) == 8 and value[("with", "auc")] > value[("without", "auc")] + 0.2


def test_group_ablation_holds_one_fit_at_a_time(planted):
    """Neither the fits nor the scoring of one overlap with another's, and no plan of them is left in the result."""
    train, test, _, _ = planted
    running, most = [], []

    def learner(encoder, encoded):
        running.append(1)
        most.append(len(running))
        try:
            return models.fit_logreg(encoder, encoded)
        finally:
            running.pop()

    groups = {"with": ["color", "signal"], "without": ["color", "noise"]}
    table = models.group_ablation(train, test, groups, learners={"A": learner, "B": learner})
    assert most == [1, 1, 1, 1] and table.count() == 16
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_rankings_put_the_signal_first(spark, planted):
    train, test, encoder, encoded = planted
    scorer = models.fit_sparse_tree(encoder, encoded)
    tree = ranking.tree_importance_ranking(spark, scorer)
    permuted = ranking.permutation_ranking(scorer, test)
    for order in (tree, permuted):
        rows = order.orderBy("rank").collect()
        assert rows[0]["feature"] == "signal" and sorted(r["feature"] for r in rows) == sorted(FEATURES)
    assert permuted.filter("feature = 'signal'").first()["importance"] > 0.2
    impute = profile.impute_values(train, ["signal", "noise"], ["color", "level"])
    stated = ranking.as_ranking(spark, "Reverse", FEATURES, {"noise": 3.0, "color": 2.0, "level": 1.0})
    outcomes = ranking.variant_outcomes(scorer, test, tree.unionByName(stated), impute, (1, 3), bottom=1)
    drops = {(r["method"], r["k"]): r["drop"] for r in ranking.single_deletion(outcomes).collect()}
    assert drops[("SparseTree", 1)] > 0.2 > drops[("Reverse", 1)]
    same = {r["method"]: r["share"] for r in ranking.stability(outcomes).collect()}
    assert same["SparseTree"] > same["Reverse"]
    table = ranking.explanation_quality(outcomes, tree.unionByName(stated), (1, 3)).collect()
    assert {r["top1"] for r in table} == {"signal", "noise"} and len(table) == 2


def test_permutation_importance_equals_the_mean_over_plain_permutations(planted):
    """Sixty permutations cost what sixty plain ones cost, within sampling error."""
    train, test, encoder, encoded = planted
    scorer = models.fit_sparse_tree(encoder, encoded)
    got = {r["slot"]: r["loss"] for r in ranking.permutation_importance(scorer, test, repeats=60).collect()}
    matrix = vectors(encoder, test)
    y = np.array([r["clicked"] for r in test.collect()])
    slot = encoder.slots.index("signal")
    spark = test.sparkSession
    rng = np.random.default_rng(0)
    from pyspark.ml.linalg import Vectors

    def accuracies(tables):
        rows = spark.createDataFrame(
            [(t, Vectors.dense(r), int(label)) for t, m in enumerate(tables) for r, label in zip(m, y)],
            ["t", "features", "y"],
        )
        right = scorer.score_encoded(rows).groupBy("t").agg(F.avg((F.col("hard") == F.col("y")).cast("double")).alias("a"))
        return np.array([r["a"] for r in right.orderBy("t").collect()])

    shuffled = [matrix]
    for _ in range(60):
        shuffled.append(matrix.copy())
        shuffled[-1][:, slot] = rng.permutation(matrix[:, slot])
    scores = accuracies(shuffled)
    assert got[slot] == pytest.approx(scores[0] - scores[1:].mean(), abs=0.015)


def test_ablation_turns_whole_numbers_into_means(planted):
    train, test, _, _ = planted
    impute = profile.impute_values(train, ["signal"], ["color", "level"])
    out = ranking.ablate(test, ["signal", "color", "level"], impute, ["signal"]).select("signal", "color", "level").distinct().collect()
    mean = train.agg(F.avg("signal")).first()[0]
    assert len(out) == 1
    assert out[0]["signal"] == pytest.approx(mean) and out[0]["color"] == "blue" and out[0]["level"] == 0


def test_groups_share_one_encoded_table(spark, planted):
    import os

    from exposurekit.session import shared_folder

    train, test, encoder, _ = planted
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    groups = {f"g{i}": encoder.features[: i + 1] for i in range(len(encoder.features))}
    found = models.group_ablation(train, test, groups, learners={"LogReg": models.fit_logreg})
    assert found.select("group").distinct().count() == len(groups)
    written = [x for x in set(os.listdir(folder)) - before if x.startswith("encoded")]
    assert len(written) == 2  # train and test
    alone = models.group_ablation(train, test, {"g0": groups["g0"]}, learners={"LogReg": models.fit_logreg})
    both = alone.withColumnRenamed("value", "own").join(found, ["group", "model", "metric"])
    assert both.count() == 4 and both.filter("abs(own - value) > 1e-3").count() == 0


def test_group_ablation_shape(planted):
    train, test, _, _ = planted
    table = models.group_ablation(
        train, test, {"without": ["color", "noise"], "with": ["color", "signal"]},
        learners={"Tree": models.fit_sparse_tree},
    ).collect()
    value = {(r["group"], r["metric"]): r["value"] for r in table}
    assert len(value) == 8
    assert value[("with", "auc")] > value[("without", "auc")] + 0.2


# ------------------------------------------------------------------------- bootstrap


def test_cell_bootstrap_agrees_with_row_bootstrap(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 800)
    a, b = np.where(rng.random(800) < 0.75, y, 1 - y), np.where(rng.random(800) < 0.6, y, 1 - y)
    df = spark.createDataFrame([tuple(map(int, r)) for r in zip(y, a, b)], "y int, a int, b int")
    got = {(r["scorer"], r["metric"]): (r["mean"], r["sd"]) for r in resample.bootstrap_scores(df, ["a", "b"], 2000).collect()}
    draws = {k: [] for k in got}
    for _ in range(2000):
        idx = rng.integers(0, 800, 800)
        for name, h in (("a", a), ("b", b)):
            yy, hh = y[idx], h[idx]
            draws[(name, "acc")].append((yy == hh).mean())
            f = [2 * ((yy == c) & (hh == c)).sum() / ((yy == c).sum() + (hh == c).sum()) for c in (0, 1)]
            draws[(name, "f1_macro")].append(np.mean(f))
    for key, (mean, sd) in got.items():
        assert mean == pytest.approx(np.mean(draws[key]), abs=0.002)
        assert sd == pytest.approx(np.std(draws[key]), rel=0.1)


def test_bootstrap_does_not_depend_on_the_number_of_tasks(spark):
    df = spark.range(300).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 3 == 0).cast("int").alias("a"))
    one, many = (sorted(resample.bootstrap_scores(df, ["a"], 100, tasks=t).collect()) for t in (1, 16))
    for x, z in zip(one, many):
        assert x["mean"] == pytest.approx(z["mean"]) and x["sd"] == pytest.approx(z["sd"])


def test_explanation_bootstrap(spark):
    df = spark.range(400).select(
        F.lit(1).alias("base"), (F.col("id") % 4 > 0).cast("int").alias("d"), (F.col("id") % 10 > 0).cast("int").alias("s")
    )
    got = {r["metric"]: r for r in resample.bootstrap_explanations(df, "base", {"m": ("d", "s")}, 1000).collect()}
    assert got["drop"]["mean"] == pytest.approx(0.25, abs=0.005)
    assert got["stability"]["mean"] == pytest.approx(0.9, abs=0.005)
    assert got["drop"]["sd"] == pytest.approx((0.25 * 0.75 / 400) ** 0.5, rel=0.15)


def test_many_outcome_columns_in_many_chunks(spark):
    columns = [F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(10)) for i in range(21)]
    df = spark.range(4000).select(F.lit(1).alias("base"), *[(c > 2).cast("int").alias(f"c{i}") for i, c in enumerate(columns[:20])])
    methods = {f"m{i}": (f"c{2 * i}", f"c{2 * i + 1}") for i in range(10)}
    whole, parts = (
        {(r["method"], r["metric"]): r for r in resample.bootstrap_explanations(df, "base", methods, 400, per_chunk=k).collect()} for k in (10**6, 300)
    )
    assert len(parts) == 20 and resample.joint_cells(df, df.columns).count() > 3000
    for key, row in parts.items():
        assert row["mean"] == pytest.approx(whole[key]["mean"], abs=0.003) and row["sd"] == pytest.approx((0.3 * 0.7 / 4000) ** 0.5, rel=0.2)


def test_the_executor_step_needs_nothing_of_this_package(tmp_path):
    """Executors may not have the package; the step must load without it."""
    task = resample.resampling_task(["y", "a"], 1, lambda m, w: [("a", "acc", 1.0)])
    code = "import sys, pickle; pickle.loads(sys.stdin.buffer.read())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(task), cwd=tmp_path, env=env, check=False)
    assert done.returncode == 0


@pytest.mark.parametrize("fit", [models.fit_logreg, models.fit_sparse_tree, lambda e, t: models.fit_gbt(e, t, rounds=5)])
def test_swapped_rows_score_as_their_vectors_do(planted, fit):
    """One repeat, row by row: the expression of a model gives the class its vector gives."""
    from exposurekit.operators.ordinal import with_ordinal
    from pyspark.ml.linalg import Vectors

    _, test, encoder, encoded = planted
    scorer = fit(encoder, encoded)
    rows = test.withColumn("row_id", F.xxhash64(*test.columns)).dropDuplicates(["row_id"])
    got = {r["slot"]: r["loss"] for r in ranking.permutation_importance(scorer, rows, repeats=1, seed=5).collect()}
    dense = {r.row_id: (r.v.copy(), r.clicked) for r in encoder.transform(rows).select("row_id", "clicked", vector_to_array("features").alias("v")).collect()}
    taker = {r.ordinal: r.row_id for r in with_ordinal(rows.select("row_id"), "row_id", "5:rows").collect()}
    seeded = rows.select("row_id", F.lit("5:1").alias("s"), F.lit(1).alias("repeat"))
    donor = {r.ordinal: r.row_id for r in with_ordinal(seeded, "row_id", F.col("s"), by=["repeat"]).collect()}
    jobs = []
    for o, i in taker.items():
        v, y = dense[i]
        for s in ranking.used_slots(scorer.model):
            new = dense[donor[o]][0][s]
            if new != v[s]:
                jobs.append((int(s), int(y), Vectors.dense([*v[:s], new, *v[s + 1 :]]), Vectors.dense(v)))
    frame = rows.sparkSession.createDataFrame(jobs, ["slot", "y", "features", "old"])
    after = scorer.score_encoded(frame).withColumnRenamed("hard", "after").drop("prob", "features").withColumnRenamed("old", "features")
    both = scorer.score_encoded(after)
    lost = both.groupBy("slot").agg(F.sum((F.col("hard") == F.col("y")).cast("int") - (F.col("after") == F.col("y")).cast("int")).alias("n"))
    want = {r["slot"]: r["n"] / len(dense) for r in lost.collect()}
    assert {s: pytest.approx(x) for s, x in want.items()} == got
