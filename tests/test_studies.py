"""The evaluation studies end to end on a stored history table."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from exposurekit.catalog.views import Views, uniform
from exposurekit.config import DEFAULTS
from exposurekit.operators import models, responses
from exposurekit.plans import studies
from exposurekit.plans import tables as plans
from exposurekit.session import cut_lineage

SETTINGS = replace(DEFAULTS, history_per_class=600, bootstrap_draws=200, deletion_ks=(1, 2), shown_errors=20)
FEATURES = ["u_age", "s_country", "ctx_dayofweek", "user_ctr", "streamer_ctr", "hint"]


@pytest.fixture(scope="module")
def parts(spark, small):
    v = Views(spark, small)
    table = plans.history_table(v.log(), v.user(), v.streamer(), v.room(), Views.room_order, SETTINGS)
    table = table.withColumn("hint", F.col("clicked") + uniform("hint", "row_id"))
    return {k: cut_lineage(p, k) for k, p in studies.split_table(table, 800, 300).items()}


@pytest.fixture(scope="module")
def answers(parts):
    prob = F.col("clicked") * 0.4 + uniform("p", "row_id") * 0.6
    return parts["test"].select("row_id", prob.alias("prob"), F.when(prob >= 0.5, 1).otherwise(0).alias("hard"))


def test_split_is_complete(parts):
    assert [parts[p].count() for p in ("train", "test", "pool")] == [800, 300, 100]


def test_refinement_step(parts, answers):
    out = studies.refinement_step(parts["test"], answers, F.lit("RULES"), FEATURES, SETTINGS)
    assert 0.5 < out["scores"].first()["acc"] < 1
    prompt = out["next_prompt"].first()
    assert prompt["n"] == 20 and prompt["prompt"].startswith("CURRENT DESCRIPTION:\nRULES\n\n")


def test_training_tables(parts):
    train = parts["train"].withColumn("why", F.lit("because"))
    plain = studies.training_tables(train, FEATURES, settings=SETTINGS)
    assert plain["examples"].count() == 800 and plain["plan"].count() == 2 * 6 * 128
    told = studies.training_tables(train, FEATURES, "why", SETTINGS)
    assert told["examples"].columns == ["row_id", "messages", "segments"]
    assert told["plan"].agg(F.max("step")).first()[0] == 2 * 12 - 1


def test_error_study(spark, parts, answers):
    stated = responses.parse_ranking(
        spark.createDataFrame([("Stated", "hint\nu_age")], "text_id string, text string"), FEATURES
    ).withColumnRenamed("text_id", "method")
    out = studies.error_study(parts["train"], parts["test"], answers, stated, FEATURES, SETTINGS, rounds=5)
    pred = {(r["scorer"], r["metric"]): r["mean"] for r in out["predictions"].collect()}
    assert set(pred) == {(s, m) for s in ("answers", "linear", "trees") for m in ("acc", "f1_macro")}
    assert pred[("trees", "acc")] > 0.7
    expl = {(r["method"], r["metric"]): r["mean"] for r in out["explanations"].collect()}
    assert expl[("Permutation", "drop")] > 0.1 and len(expl) == 6
    assert {r["method"] for r in out["quality"].collect()} == {"Permutation", "SparseTree", "Stated"}


def test_validity_study(parts, answers):
    warm = answers.withColumn("hard", F.when(uniform("w", "row_id") < 0.1, 1 - F.col("hard")).otherwise(F.col("hard")))
    out = studies.validity_study(
        parts["train"], parts["test"], {"cold": answers, "warm": warm}, FEATURES, learners={"Tree": models.fit_sparse_tree}
    )
    scores = {r["scorer"]: r for r in out["scores"].collect()}
    assert scores["cold"]["acc"] > scores["warm"]["acc"] and scores["cold"]["auc"] == pytest.approx(scores["warm"]["auc"])
    assert 0.8 < out["agreement"].first()["share"] < 1.0
    assert {r["group"] for r in out["ablation"].collect()} == {"static_only", "static_and_rates", "full"}


def test_audit_study(parts, answers):
    preds = parts["test"].select("row_id", F.col("clicked").alias("y"), "u_gender", "u_age").join(answers, "row_id")
    out = studies.audit_study(preds)
    assert out["rates"].filter("dim = 'u_age'").count() == 6
    after = out["recalibrated"].filter("stage = 'after' and dim = 'coarse_age' and group is null").first()
    assert after["n"] == 300
    spread = {r["stage"]: r["fnr_spread"] for r in out["recalibrated"].filter("dim = 'u_gender'").collect()}
    assert spread["after"] <= spread["before"]


def test_correction_and_progression(spark):
    rows = [(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 0, 1)]
    base = spark.createDataFrame(rows, "row_id long, y int, hard int")
    better = spark.createDataFrame([(i, y, y if i != 2 else 0) for i, y, _ in rows], "row_id long, y int, hard int")
    found = studies.correction_study(base, better)
    assert {(r.was_right, r.is_right): r.n for r in found["turned"].collect()} == {(0, 0): 0, (0, 1): 2, (1, 0): 1, (1, 1): 1}
    assert found["effect"].first().changed == 3
    steps = base.withColumn("iteration", F.lit(0)).unionByName(base.withColumn("iteration", F.lit(1))).unionByName(better.withColumn("iteration", F.lit(2)))
    texts = spark.createDataFrame([(0, "  first\n words "), (2, "a " * 200)], "iteration int, text string")
    got = studies.progression_study(steps, steps, texts, limit=9)
    told = {r.iteration: (r.label, r.acc, r.excerpt) for r in got["steps"].collect()}
    assert told == {
        0: ("Iteration 0 (initial explanation)", 0.5, "first wor ..."),
        1: ("Iteration 1 (after 1 reflection step)", 0.5, None),
        2: ("Iteration 2 (refined explanation)", 0.75, "a a a a a ..."),
    }
    assert got["lift"].first().asDict() == {"oneshot": 0.5, "refined": 0.75, "lift": 0.25}


def test_ensemble_record(spark):
    rows = [(i, i % 2, 0.9 if i % 2 else 0.1, 0.5, 0.2) for i in range(20)]
    preds = spark.createDataFrame(rows, "row_id long, y int, good double, even double, low double")
    found = studies.ensemble_study(preds, {"good": "good", "even": "even", "low": "low"}, "good", "even")
    record = {r["name"]: (r.w, r.acc) for r in found["record"].collect()}
    assert record["good"] == (None, 1.0) and record["even"] == (None, 0.5) and record["low"] == (None, 0.5)
    assert record["best blend"][1] == 1.0 and found["blend"].count() == 9
    assert found["overlap"].first().both_wrong == 0.0
