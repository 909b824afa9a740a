from pyspark.sql import functions as F

from exposurekit.operators import sampling as S


def labelled(spark, n=1000, share=3):
    return spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % share == 0).cast("int").alias("y"))


def counts(df, column="y"):
    return {r[column]: r["count"] for r in df.groupBy(column).count().collect()}


def test_balanced_sample_sizes(spark):
    df = labelled(spark)
    assert counts(S.balanced_sample(df, "y", 100, ["row_id"])) == {0: 100, 1: 100}
    assert counts(S.balanced_sample(df, "y", 5000, ["row_id"])) == {0: 334, 1: 334}
    assert counts(S.balanced_sample(df, "y", 500, ["row_id"], equal=False)) == {0: 500, 1: 334}
    assert S.balanced_sample(df.filter("y = 1"), "y", 10, ["row_id"]).count() == 0


def test_unique_shortcut_picks_the_same_rows(spark):
    df = labelled(spark)
    for equal in (True, False):
        a = S.balanced_sample(df, "y", 200, ["row_id"], equal=equal)
        b = S.balanced_sample(df, "y", 200, ["row_id"], equal=equal, unique=True)
        assert sorted(a.collect()) == sorted(b.collect())


def test_sample_with_hot_group_of_copies(spark):
    # 400 of 600 positives are one row repeated
    rows = [(1, 5)] * 400 + [(1, 100 + i) for i in range(200)] + [(0, 1000 + i) for i in range(50)]
    df = spark.createDataFrame(rows, "y int, k int")
    for n in (1, 50, 150, 333, 599, 600):
        got = S.balanced_sample(df, "y", n, ["y", "k"], equal=False)
        assert counts(got)[1] == n
        assert got.filter("k = 5").count() <= 400
        assert got.filter("k <> 5").groupBy("k").count().filter("count > 1").count() == 0


def test_sample_is_a_prefix_of_a_larger_sample(spark):
    df = labelled(spark)
    small, large = (
        {r["row_id"] for r in S.balanced_sample(df, "y", n, ["row_id"]).collect()} for n in (50, 150)
    )
    assert small < large


def test_seed_changes_the_sample(spark):
    df = labelled(spark)
    a, b = ({r["row_id"] for r in S.balanced_sample(df, "y", 50, ["row_id"], seed=s).collect()} for s in (1, 2))
    assert a != b


def test_prior_shift_reaches_the_rate(spark):
    got = counts(S.prior_shift_resample(labelled(spark, 9000), "y", 0.279, 2000, ["row_id"]))
    assert got == {1: 558, 0: 1442}
    short = counts(S.prior_shift_resample(labelled(spark, 300), "y", 0.9, 200, ["row_id"]))
    assert short == {1: 100, 0: 20}


def test_splits_are_disjoint_and_exact(spark):
    df = labelled(spark)
    split = S.ordinal_split(df, {"a": 100, "b": 50, "c": 200}, "row_id")
    assert counts(split, "split") == {"a": 100, "b": 50, "c": 200, None: 650}
    over = S.ordinal_split(df, {"a": 900, "b": 500}, "row_id")
    assert counts(over, "split") == {"a": 900, "b": 100}
    assert counts(S.tail_split(df, 30, "row_id"), "split") == {"train": 970, "test": 30}
    assert counts(S.tail_split(df, 5000, "row_id"), "split") == {"test": 1000}


def test_batches_drop_the_tail_and_differ_by_epoch(spark):
    plan = S.batch_plan(spark.range(103).withColumnRenamed("id", "row_id"), "row_id", 10, 2, 1e-3, seed=1)
    rows = plan.collect()
    assert len(rows) == 200
    for epoch in (0, 1):
        mine = [r for r in rows if r["epoch"] == epoch]
        assert len({r["row_id"] for r in mine}) == 100
        assert {r["batch"] for r in mine} == set(range(10))
    first = [frozenset(r["row_id"] for r in rows if r["step"] == s) for s in (0, 10)]
    assert first[0] != first[1]
    rates = {r["step"]: r["lr"] for r in rows}
    assert rates[0] == 1e-3
    assert abs(rates[19] - 1e-3 * (1 - 19 / 20)) < 1e-12


def test_batch_plan_smaller_than_a_batch(spark):
    assert S.batch_plan(spark.range(5).withColumnRenamed("id", "row_id"), "row_id", 10, 2, 1e-3).count() == 0


def test_placebo_keeps_texts_and_labels(spark):
    rows = spark.range(500).select(
        F.col("id").alias("row_id"), F.concat(F.lit("t"), F.col("id") % 90).alias("rationale"), (F.col("id") % 2).alias("label")
    )
    out = S.placebo_shuffle(rows, "row_id", "rationale", 0)
    assert sorted(r["rationale"] for r in out.collect()) == sorted(r["rationale"] for r in rows.collect())
    moved = out.join(rows.withColumnRenamed("rationale", "old"), ["row_id", "label"])
    assert moved.count() == 500
    assert moved.filter("rationale <> old").count() > 400


def test_first_rows_limits_each_group(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("g"))
    got = S.first_rows(df, 20, "row_id", by=["g"])
    assert {(r["g"], r["n"], r["hi"]) for r in got.groupBy("g").agg(F.count("*").alias("n"), F.max("ordinal").alias("hi")).collect()} == {
        (0, 20, 19), (1, 20, 19), (2, 20, 19)
    }
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_error_sample_and_empty_errors(spark):
    df = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "row_id int, y int, hard int")
    assert S.error_sample(df, "y", "hard", 7, "row_id").count() == 7
    assert S.error_sample(df, "y", "hard", 70, "row_id").count() == 20
    assert S.error_sample(df.filter("y = 0"), "y", "hard", 7, "row_id").count() == 0


def test_regimes_report_absent_cases(spark):
    df = spark.createDataFrame(
        [(i, i % 2, i / 10, (9 - i) / 10, i, 0.5) for i in range(10)],
        "row_id int, clicked int, user_ctr double, streamer_ctr double, user_n int, cat_ctr double",
    )
    titles = ["hot", "cold", "pull", "skip", "category"]
    got = {r["case"]: r for r in S.regime_examples(df, S.click_regimes(df, titles), "row_id").collect()}
    assert set(got) == set(titles)
    assert got["hot"]["row_id"] is None and got["cold"]["row_id"] is None
    assert got["pull"]["clicked"] == 1 and got["pull"]["user_ctr"] <= 0.225
    assert got["skip"]["clicked"] == 0 and got["skip"]["user_n"] >= 6.75
    cards = S.example_card(
        S.regime_examples(df, S.click_regimes(df, titles), "row_id"),
        df.select("row_id", F.lit(1).alias("hard")),
        ["user_ctr", "user_n", "absent"],
    ).collect()
    assert {c["case"] for c in cards} == {"pull", "skip", "category"}
    skip = next(c for c in cards if c["case"] == "skip")
    assert skip["correct"] is False and set(skip["key_features"]) == {"user_ctr", "user_n"}


def test_top_and_bottom_of_rankings(spark):
    ranks = spark.createDataFrame([("m", f"f{i}", i) for i in range(1, 13)], "method string, feature string, rank int")
    assert [r["rank"] for r in S.top_k(ranks, 3).orderBy("rank").collect()] == [1, 2, 3]
    assert [r["rank"] for r in S.top_k(ranks, 10, tail=True).orderBy("rank").collect()] == list(range(3, 13))


def test_first_rows_beyond_what_tasks_keep(spark):
    df = spark.range(20_000).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("g"))
    few = spark.createDataFrame([(10**6 + i, None) for i in range(7)], "row_id long, g long")
    got = S.first_rows(df.unionByName(few), 5_000, "row_id", by=["g"])
    assert {r["g"]: (r["n"], r["m"]) for r in got.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("ordinal").alias("m")).collect()} == {
        0: (5_000, 4_999), 1: (5_000, 4_999), 2: (5_000, 4_999), None: (7, 6)
    }
    small = {r["row_id"] for r in S.first_rows(df, 900, "row_id").collect()}
    large = {r["row_id"]: r["ordinal"] for r in S.first_rows(df, 1_500, "row_id").collect()}
    assert len(large) == 1_500 and {i for i, o in large.items() if o < 900} == small
