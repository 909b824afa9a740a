import pytest
from pyspark.sql import functions as F

from exposurekit.functions import columns as C
from exposurekit.operators import features as X
from exposurekit.operators import profile as P


def one(df):
    return df.first()


def test_tier_limits(spark):
    totals = [0.0, 5.0, 5.5, 99.0, 99.5, 100.0, None]
    df = spark.createDataFrame([(t,) for t in totals], "t double").select(C.tier(F.col("t")).alias("tier"))
    assert [r["tier"] for r in df.collect()] == ["Low", "Low", "Mid", "Mid", "High", "High", "High"]


def test_gift_sessions_with_missing_prices_and_keys(spark):
    rows = [(1, 1, 1, None, 5), (1, 1, 1, None, 3), (1, 2, 1, 2.0, 9), (1, 2, 1, None, 8), (None, 2, 1, 3.0, 1)]
    gift = spark.createDataFrame(rows, "user_id long, live_id long, streamer_id long, gift_price double, timestamp long")
    got = {r["live_id"]: tuple(r)[3:] for r in X.with_gift_tier(X.gift_sessions(gift)).collect()}
    assert got == {1: (0.0, 0, 3, "Low"), 2: (2.0, 1, 8, "Low")}


def test_duration_rounds_half_to_even_and_drops_negative_spans(spark):
    rows = [(0, 15_000), (0, 45_000), (0, 9_000), (10, 0), (0, 0), (None, 5)]
    df = C.duration_minutes(spark.createDataFrame(rows, "s long, e long"), "s", "e")
    # 0.25 -> 0.2, 0.75 -> 0.8, 0.15 -> 0.2
    assert [r["live_duration_min"] for r in df.collect()] == [0.2, 0.8, 0.2, None, 0.0, None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_local_time_ignores_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 2024-03-10 is a daylight-saving change in New York
        df = spark.createDataFrame([(1710054000000,), (1710057600000,), (None,)], "t long")
        got = [tuple(r)[1:] for r in C.context_time(df, "t").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [(15, 6), (16, 6), (None, None)]


def test_cutoff_row_belongs_to_the_label_window(spark):
    df = spark.createDataFrame([(0,), (59,), (60,), (100,), (None,)], "t long")
    hist, later = X.time_window_split(df, "t", 0.6)
    assert sorted(r["t"] for r in hist.collect()) == [0, 59]
    assert sorted(r["t"] for r in later.collect()) == [60, 100]


def log(spark, later_label=0):
    rows = [(u, 10 + u % 2, u % 3, t, int((u + t) % 3 == 0)) for u in range(6) for t in range(60)]
    rows += [(u, 10, u % 3, 60 + t, later_label) for u in range(8) for t in range(40)] + [(0, 10, 0, 100, 1)]
    return spark.createDataFrame(rows, "user_id long, live_id long, streamer_id long, timestamp long, clicked int")


def test_label_window_never_reaches_history_rates(spark):
    rates = []
    for later_label in (0, 1):
        hist, _ = X.time_window_split(log(spark, later_label), "timestamp")
        g = X.global_rate(hist).scalar()
        rates.append(sorted(X.smoothed_rate(hist, "user_id", "user", g=g).collect()))
    assert rates[0] == rates[1] and len(rates[0]) == 6


def test_smoothed_rate_formula_and_unseen_keys(spark):
    hist = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (2, 0), (None, 1)], "user_id long, clicked int")
    got = {r["user_id"]: (r["user_ctr"], r["user_n"]) for r in X.smoothed_rate(hist, "user_id", "user").collect()}
    g = 3 / 5
    assert got == {1: (pytest.approx((2 + 20 * g) / 23), 3), 2: (pytest.approx((0 + 20 * g) / 21), 1)}
    sample = spark.createDataFrame([(1, 7, "a"), (9, 9, "b")], "user_id long, streamer_id long, row_id string")
    streamer = spark.createDataFrame([(7, 0.5, 4)], "streamer_id long, streamer_ctr double, streamer_n long")
    user = X.smoothed_rate(hist, "user_id", "user")
    out = {r["row_id"]: r for r in X.join_history(sample, user, streamer, F.lit(0.25), ["row_id"]).collect()}
    assert (out["b"]["user_ctr"], out["b"]["user_n"], out["b"]["streamer_ctr"], out["b"]["streamer_n"]) == (0.25, 0, 0.25, 0)
    assert (out["a"]["user_n"], out["a"]["streamer_n"]) == (3, 4)


def test_category_rate_through_rooms_equals_direct_rate(spark):
    hist = log(spark)
    room = spark.createDataFrame([(10, "music"), (11, None)], "live_id long, cat string")
    got = X.category_rate_by_room(hist, room, "cat").collect()
    direct = X.category_rate(hist.join(room, "live_id", "left"), "cat").collect()
    assert [(r["cat"], r["cat_ctr"]) for r in got] == [(r["cat"], pytest.approx(r["cat_ctr"])) for r in direct]


def test_dedupe_first_follows_the_stated_order(spark):
    rows = [(1, "b", 2), (1, "a", 1), (2, None, 0), (2, "z", 5)]
    got = X.dedupe_first(spark.createDataFrame(rows, "k long, v string, o int"), "k", ["o"]).collect()
    assert {(r["k"], r["v"]) for r in got} == {(1, "a"), (2, None)}


def test_dimension_cleaning(spark):
    df = spark.createDataFrame([(1, 2, 3, 4), (None, 0, 0, 0)], "user_id long, age int, onehot_feat1 int, reg_timestamp int")
    out = X.clean_dim(df, "user_id", "u_", ["reg_timestamp", "not there"])
    assert out.columns == ["user_id", "u_age"] and out.count() == 1


def test_recode_and_fill(spark):
    df = spark.createDataFrame([("x", None), ("q", 1.5), (None, 2.0)], "a string, b double")
    out = C.fill_defaults(df, {"b": 7}).select(C.recode(F.col("a"), {"x": "X"}).alias("a"), "b").collect()
    assert [tuple(r) for r in out] == [("X", 7.0), ("q", 1.5), (None, 2.0)]


# -------------------------------------------------------------------------- profiling


def test_balance_keeps_absent_classes(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "y int")
    got = P.class_balance(df, "y", [1, 0]).orderBy("position").collect()
    assert [(r["class"], r["n"], r["share"]) for r in got] == [(1, 2, pytest.approx(2 / 3)), (0, 0, 0.0)]


def test_missingness_lists_only_gaps_worst_first(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, 2), (1, 3, 4)], "a int, b int, c int")
    got = P.missingness(df, ["a", "b", "c"]).collect()
    assert [(r["feature"], round(r["share"], 3)) for r in got] == [("b", 0.667), ("c", 0.333)]


def test_typing_limit_is_strict(spark):
    df = spark.range(310).select(
        (F.col("id") % 30).alias("thirty"), (F.col("id") % 31).alias("more"), (F.col("id") % 31).cast("string").alias("text")
    )
    assert P.numeric_features(df, ["thirty", "more", "text"]) == ["more"]


def test_mode_ties_go_to_the_smallest_value(spark):
    df = spark.createDataFrame([("b", 10, 1.0), ("a", 9, 2.0), ("a", 9, 6.0), ("b", 10, None), (None, 2, None)], "t string, n int, x double")
    got = {r["feature"]: r["value"] for r in P.impute_values(df, ["x"], ["t", "n"]).collect()}
    assert got == {"t": "a", "n": "9", "x": "3.0"}


def test_numeric_summary_has_the_exact_median(spark):
    df = spark.createDataFrame([(x,) for x in (4.0, 1.0, 3.0, 10.0)] + [(None,)], "x double")
    assert tuple(one(P.numeric_summary(df, "x"))) == (1.0, 3.5, 4.5, 10.0)
