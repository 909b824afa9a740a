"""Scores against plain definitions written out over small arrays."""

import numpy as np
import pytest

from exposurekit.operators import cost, ensemble, fairness, metrics


def frame(spark, y, prob, **more):
    names = list(more)
    rows = [(i, int(a), float(p), int(p >= 0.5), *[more[n][i] for n in names]) for i, (a, p) in enumerate(zip(y, prob))]
    schema = "row_id int, y int, prob double, hard int" + "".join(f", {n} string" for n in names)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    prob = np.clip(0.35 * y + rng.random(400) * 0.65, 0, 1).round(2)
    prob[:130] = 0.5  # a third of all rows share one score
    return y, prob


def auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return float(np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])))


def ap(y, p):
    out, seen = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        chosen = p >= t
        recall = (chosen & (y == 1)).sum() / (y == 1).sum()
        out += (recall - seen) * (y[chosen] == 1).mean()
        seen = recall
    return out


def test_ranking_scores(spark, data):
    y, p = data
    df = frame(spark, y, p)
    assert metrics.roc_auc(df).first()["auc"] == pytest.approx(auc(y, p), abs=1e-12)
    assert metrics.average_precision(df).first()["ap"] == pytest.approx(ap(y, p), abs=1e-12)
    flipped = frame(spark, y, 1 - p)
    assert metrics.roc_auc(flipped).first()["auc"] == pytest.approx(1 - auc(y, p), abs=1e-12)


def test_ranking_scores_per_group_and_degenerate(spark):
    y = np.array([1, 0, 1, 0, 1, 1, 0, 0])
    p = np.array([0.9, 0.1, 0.4, 0.4, 0.2, 0.3, 0.7, 0.7])
    g = ["a"] * 4 + ["one"] * 2 + ["neg"] * 2
    got = {r["g"]: r["auc"] for r in metrics.roc_auc(frame(spark, y, p, g=g), by=["g"]).collect()}
    assert got == {"a": 0.875, "one": None, "neg": None}
    tied = frame(spark, np.array([1, 0, 1]), np.array([0.3, 0.3, 0.3]))
    assert metrics.roc_auc(tied).first()["auc"] == 0.5
    assert metrics.average_precision(tied).first()["ap"] == pytest.approx(2 / 3)


def test_rows_without_a_label_or_score_are_left_out(spark):
    rows = [(1, 0.9, 1), (0, 0.2, 0), (None, 0.95, 1), (1, None, 0)]
    df = spark.createDataFrame(rows, "y int, prob double, hard int")
    assert metrics.roc_auc(df).first()["auc"] == 1.0
    assert metrics.average_precision(df).first()["ap"] == 1.0
    assert metrics.classification_report(df).first()["acc"] == round(2 / 3, 4)


def test_empty_tables_score_null(spark):
    df = spark.createDataFrame([], "row_id int, y int, prob double, hard int")
    assert metrics.roc_auc(df).first()["auc"] is None
    assert tuple(metrics.classification_report(df).first()) == (None, None, 0.0)
    assert ensemble.error_overlap(df, "hard", "hard").first()["wrong_1"] is None
    assert fairness.group_rates(df.selectExpr("*", "'a' as g"), ["g"]).count() == 0


def f1(y, h, c):
    tp, wrong = ((y == c) & (h == c)).sum(), ((y == c) != (h == c)).sum()
    return 2 * tp / (2 * tp + wrong) if 2 * tp + wrong else None


def test_report_and_balanced_accuracy(spark, data):
    y, p = data
    h = (p >= 0.5).astype(int)
    report = metrics.classification_report(frame(spark, y, p)).first()
    assert report["acc"] == round(float((y == h).mean()), 4)
    assert report["f1_macro"] == round(float(np.mean([f1(y, h, 0), f1(y, h, 1)])), 4)
    assert report["f1_pos"] == round(float(f1(y, h, 1)), 4)
    recalls = [(h[y == c] == c).mean() for c in (0, 1)]
    assert metrics.balanced_accuracy(frame(spark, y, p)).first()["bal_acc"] == pytest.approx(np.mean(recalls))


def test_report_with_one_class(spark):
    zeros = frame(spark, np.zeros(3), np.zeros(3))
    assert tuple(metrics.classification_report(zeros).first()) == (1.0, 1.0, 0.0)
    assert metrics.balanced_accuracy(zeros).first()["bal_acc"] == 1.0
    # class 1 occurs only in the prediction: it still counts for the macro mean
    mixed = frame(spark, np.zeros(2), np.array([0.0, 0.5]))
    assert metrics.classification_report(mixed).first()["f1_macro"] == round((2 / 3 + 0) / 2, 4)


def test_agreement_and_correction(spark):
    y = np.array([1, 0, 1, 1])
    a, b = frame(spark, y, np.array([0.9, 0.9, 0.1, 0.9])), frame(spark, y, np.array([0.9, 0.1, 0.1, 0.1]))
    assert tuple(metrics.agreement(a, b).first()) == (0.5, 2, 4)
    row = metrics.correction_effect(a, b).first()
    assert (row["acc_before"], row["acc_after"], row["changed"], row["n"]) == (0.5, 0.5, 2, 4)


def test_trajectory_lift(spark):
    rows = [(i, it, i % 2, int(i % 2 if i < 4 + it else 0)) for it in range(3) for i in range(10)]
    df = spark.createDataFrame(rows, "row_id int, iteration int, y int, hard int")
    got = metrics.iteration_trajectory(df).orderBy("iteration").collect()
    assert [r["acc"] for r in got] == [0.7, 0.7, 0.8]
    assert {r["lift"] for r in got} == {0.1}


def test_blend_grid_ties_take_the_smallest_weight(spark):
    df = spark.createDataFrame([(1, 0.9, 0.8), (0, 0.2, 0.4), (1, 0.5, 0.5)], "y int, a double, b double")
    got = ensemble.blend_grid(df, "a", "b").orderBy("w").collect()
    assert [r["w"] for r in got] == [0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0]
    assert [r["w"] for r in got if r["best"]] == [0.0]
    assert all(r["acc"] == 1.0 for r in got)


def test_error_overlap(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (0, 0, 0), (0, 1, 1)], "y int, h1 int, h2 int")
    row = ensemble.error_overlap(df, "h1", "h2").first()
    e1, e2 = np.array([1, 0, 0, 1]), np.array([1, 1, 0, 1])
    assert (row["wrong_1"], row["wrong_2"], row["both_wrong"]) == (0.5, 0.75, 0.5)
    assert row["error_corr"] == pytest.approx(np.corrcoef(e1, e2)[0, 1])


# ------------------------------------------------------------------------- subgroups


def audit_frame(spark, data):
    y, p = data
    group = [["m", "f", None][i % 3] for i in range(len(y))]
    age = ["young" if i % 5 else "old" for i in range(len(y))]
    return frame(spark, y, p, gender=group, age=age), np.array([g or "nan" for g in group]), np.array(age)


def test_group_rates(spark, data):
    y, p = data
    h = (p >= 0.5).astype(int)
    df, gender, age = audit_frame(spark, data)
    levels = {"age": ["young", "absent"]}
    got = {(r["dim"], r["group"]): r for r in fairness.group_rates(df, ["gender", "age"], levels=levels).collect()}
    assert set(got) == {("gender", g) for g in ("m", "f", "nan")} | {("age", "young"), ("age", "absent"), ("overall", None)}
    for key, mask in {("gender", "nan"): gender == "nan", ("age", "young"): age == "young", ("overall", None): y >= 0}.items():
        yy, hh = y[mask], h[mask]
        assert got[key]["n"] == mask.sum()
        assert got[key]["acc"] == pytest.approx((yy == hh).mean())
        assert got[key]["fpr"] == pytest.approx(((hh == 1) & (yy == 0)).sum() / max((yy == 0).sum(), 1))
        assert got[key]["fnr"] == pytest.approx(((hh == 0) & (yy == 1)).sum() / max((yy == 1).sum(), 1))
    empty = got[("age", "absent")]
    assert (empty["n"], empty["acc"], empty["fpr"], empty["fnr"]) == (0, None, None, None)
    spread = {r["dim"]: r for r in fairness.rate_spread(fairness.group_rates(df, ["gender", "age"])).collect()}
    rates = [v["fnr"] for k, v in got.items() if k[0] == "gender"]
    assert spread["gender"]["fnr_spread"] == pytest.approx(max(rates) - min(rates))
    assert "overall" not in spread


def test_recalibration_equalises_true_positive_rates(spark, data):
    y, p = data
    h = (p >= 0.5).astype(int)
    df, gender, _ = audit_frame(spark, data)
    tpr = ((h == 1) & (y == 1)).sum() / (y == 1).sum()
    taus = {r["group"]: r["tau"] for r in fairness.equal_opportunity(df, ["gender"]).collect()}
    for g, tau in taus.items():
        assert tau == pytest.approx(np.quantile(p[(gender == g) & (y == 1)], 1 - tpr), abs=1e-9)
    audit = fairness.recalibrated_audit(df, ["gender"]).collect()
    for r in audit:
        if r["stage"] == "after" and r["group"] is not None:
            mask = gender == r["group"]
            assert r["fnr"] == pytest.approx(((p[mask] < r["tau"]) & (y[mask] == 1)).sum() / (y[mask] == 1).sum())
    whole = {r["stage"]: r for r in audit if r["group"] is None}
    assert whole["before"]["n"] == whole["after"]["n"] == len(y)
    assert whole["before"]["acc"] == pytest.approx((y == h).mean())


def test_group_without_positives_keeps_one_half(spark):
    df = frame(spark, np.array([1, 1, 0, 0]), np.array([0.9, 0.3, 0.6, 0.2]), g=["a", "a", "b", "b"])
    taus = {r["group"]: r["tau"] for r in fairness.equal_opportunity(df, ["g"], levels={"g": ["a", "b", "c"]}).collect()}
    assert taus == {"a": pytest.approx(0.6), "b": 0.5, "c": 0.5}


def test_thresholds_from_separate_rows(spark, data):
    df, _, _ = audit_frame(spark, data)
    half, rest = df.filter("row_id % 2 = 0"), df.filter("row_id % 2 = 1")
    audit = fairness.recalibrated_audit(rest, ["gender"], calibration=half).filter("stage = 'after' and group is not null")
    taus = {r["group"]: r["tau"] for r in fairness.equal_opportunity(half, ["gender"]).collect()}
    assert {r["group"]: r["tau"] for r in audit.collect()} == taus


# ------------------------------------------------------------------------------ cost


def usage(spark):
    rows = [("a", i, "gpt-4o", "paid", 100_000, 10_000) for i in range(6)]
    rows += [("b", 0, "new", "paid", 1_000_000, 0), ("c", 0, "new", "credit", 1_000_000, 5), ("d", 0, "gpt-4o-mini", "paid", 0, 1_000_000)]
    return spark.createDataFrame(rows, "run string, call long, model string, provider string, tokens_in long, tokens_out long")


def test_usage_cost_and_fallback_prices(spark):
    got = {r["run"]: (r["calls"], round(r["usd"], 6)) for r in cost.usage_cost(usage(spark)).collect()}
    assert got == {"a": (6, 2.1), "b": (1, 2.5), "c": (1, 0.0), "d": (1, 0.6)}


def test_budget_cut_prices_every_call_by_its_model(spark):
    calls = [("a", 0, "gpt-4o", "paid", 1_000_000, 0), ("a", 1, "gpt-4o-mini", "paid", 1_000_000, 0), ("a", 2, "gpt-4o-mini", "paid", 1, 1), ("a", 3, "own", "credit", 9, 9)]
    log = spark.createDataFrame(calls, "run string, call long, model string, provider string, tokens_in long, tokens_out long")
    over = lambda cap: [r.over for r in cost.budget_cut(log, cap).orderBy("call").collect()]
    assert over(2.0) == [False, True, True, True]  # 2.50 dollars, then 0.15
    assert over(2.6) == [False, False, True, True]
    assert over(2.65) == [False, False, False, True]


def test_budget_cut_looks_at_spend_before_the_call(spark):
    # 0.35 dollars a call: spent 0, .35, .70, 1.05, ... before calls 0, 1, 2, 3
    got = cost.budget_cut(usage(spark).filter("run = 'a'"), cap=0.7).orderBy("call").collect()
    assert [r["over"] for r in got] == [False, False, False, True, True, True]
