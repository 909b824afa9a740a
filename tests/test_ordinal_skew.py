import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from exposurekit.operators import ordinal
from exposurekit.operators.ordinal import (
    cut_points,
    deepened,
    exact_quantiles,
    hash_digits,
    prefix_sums,
    seeded_key,
    value_bucket,
    value_buckets,
    value_limits,
    with_ordinal,
)
from exposurekit.operators.skew import hot_keys, lookup_join, number_copies


@pytest.fixture(params=[1, 4, 64])
def partitions(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ordinal_equals_global_row_number(spark, partitions):
    rows = spark.range(20_000).withColumn("g", F.col("id") % 3)
    placed = with_ordinal(rows, "id", 42)
    whole = Window.orderBy(seeded_key(F.col("id"), 42), "id")
    expected = rows.withColumn("want", F.row_number().over(whole) - 1)
    assert placed.join(expected, "id").filter("ordinal <> want").count() == 0
    assert placed.count() == 20_000


def test_ordinal_per_group_with_missing_group(spark):
    rows = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 3))
    placed = with_ordinal(rows, "id", 1, by=["g"])
    spans = placed.groupBy("g").agg(F.min("ordinal"), F.max("ordinal"), F.count_distinct("ordinal")).collect()
    assert [tuple(r)[1:] for r in spans] == [(0, 999, 1000)] * 3


def test_cut_points_count_copies(spark):
    # id 7 occurs 500 times: a third of all rows in one group of copies
    rows = spark.range(1000).select(F.when(F.col("id") < 500, 7).otherwise(F.col("id")).alias("id"))
    keys = [r["k"] for r in rows.select(seeded_key(F.col("id"), 3).alias("k")).orderBy("k").collect()]
    cuts = cut_points(rows, F.col("id"), 3, [0, 250, 499, 700, 999, 1000]).orderBy("cut").collect()
    assert [c["position"] for c in cuts] == [0, 250, 499, 700, 999]
    for c in cuts:
        assert c["cut_key"] == keys[c["position"]]
        assert c["before"] == keys.index(c["cut_key"])


@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sums_over_clustered_values(spark, descending):
    # two thirds of the distinct values lie in a very narrow range
    rows = spark.range(3000).select(
        F.when(F.col("id") < 2000, 0.5 + F.col("id") / 1e9).otherwise(F.col("id") / 100).alias("v"),
        (F.col("id") % 7).alias("w"),
        (F.col("id") % 2).alias("g"),
    )
    limits = value_limits(rows, "v", rows_per_bucket=100)
    assert 20 <= len(limits) < 30
    got = prefix_sums(rows, "v", ["w"], ["g"], descending, limits)
    order = F.desc("v") if descending else F.asc("v")
    frame = Window.partitionBy("g").orderBy(order)
    want = rows.withColumn("c", F.sum("w").over(frame)).withColumn("a", F.sum("w").over(Window.partitionBy("g")))
    joined = got.join(want.select("g", "v", "c", "a"), ["g", "v"])
    assert joined.count() == 3000
    assert joined.filter("w_cum <> c or w_all <> a").count() == 0


def test_value_buckets_are_even_and_ordered(spark):
    rows = spark.range(10_000).select((F.pow(F.col("id") / 10_000, 8)).alias("v"))
    limits = value_limits(rows, "v", rows_per_bucket=100)
    placed = rows.withColumn("b", value_bucket(F.col("v"), limits, rows.schema["v"].dataType))
    spans = placed.groupBy("b").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).orderBy("b").collect()
    assert len(spans) == len(limits) + 1 == 100
    assert all(a["hi"] < z["lo"] for a, z in zip(spans, spans[1:]))
    assert max(s["n"] for s in spans) < 300
    assert value_limits(rows.filter("v < 0"), "v") == []


def test_one_value_holding_every_row(spark):
    rows = spark.range(5000).select(F.lit(2.5).alias("v"))
    assert exact_quantiles(rows, "v", {"m": 0.5, "t": 0.9}).first().asDict() == {"m": 2.5, "t": 2.5}


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    values = [(int(g), float(x)) for g, x in zip(rng.integers(0, 3, 900), rng.normal(size=900).round(2))]
    values += [(0, 0.25)] * 600 + [(3, 1.5), (4, None)]
    df = spark.createDataFrame(values, "g int, v double")
    got = {r["g"]: r for r in exact_quantiles(df, "v", {"a": 0.25, "b": 0.8, "c": 1.0, "d": 0.0}, ["g"]).collect()}
    assert set(got) == {0, 1, 2, 3}
    for g, row in got.items():
        mine = [v for k, v in values if k == g]
        for name, q in (("a", 0.25), ("b", 0.8), ("c", 1.0), ("d", 0.0)):
            assert row[name] == pytest.approx(np.quantile(mine, q), abs=1e-12)


def skewed(spark):
    """A third of the rows on one key, a third without a key."""
    return spark.range(9000).select(
        F.col("id").alias("row"),
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, F.col("id")).alias("k"),
    )


def test_lookup_join_keeps_every_row(spark, partitions):
    left, right = skewed(spark), spark.range(0, 9000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    right = right.unionByName(spark.createDataFrame([(1, 2)], "k long, v long"))
    got = lookup_join(left, right, ["k"], ["row"], rows_per_task=200).orderBy("row").collect()
    want = left.join(right, "k", "left").select("k", "row", "v").orderBy("row").collect()
    assert [(r["row"], r["k"], r["v"]) for r in got] == [(r["row"], r["k"], r["v"]) for r in want]


def test_hot_rows_are_spread_over_tasks(spark):
    left = skewed(spark)
    right = spark.range(9000).select(F.col("id").alias("k"), F.col("id").alias("v"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup_join(left, right, ["k"], ["row"], rows_per_task=100).withColumn("p", F.spark_partition_id())
        sizes = [r["n"] for r in joined.groupBy("p").agg(F.count("*").alias("n")).collect()]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(sizes) == 9000
    assert max(sizes) < 9000 / 3


def test_hot_keys_get_as_many_tasks_as_they_need(spark):
    rows = skewed(spark)
    hot = {r["k"]: r["_tasks"] for r in hot_keys(rows, ["k"], rows_per_task=1000).collect()}
    assert hot == {1: 4, None: 3}
    assert hot_keys(rows, ["k"]).count() == 0
    # with a share of 1 %, no more than 100 keys can be hot
    even = spark.range(1000).select((F.col("id") % 40).alias("k"))
    assert hot_keys(even, ["k"], rows_per_task=1, share=0.01).count() == 40
    assert hot_keys(even, ["k"], rows_per_task=1, share=0.03).count() == 0


def test_number_copies_of_a_large_group(spark):
    rows = spark.createDataFrame([("a", 1)] * 300 + [("b", 1)] * 2 + [(None, 2)], "x string, y int")
    got = number_copies(rows, chunk=64)
    counts = {r["x"]: (r["n"], r["d"], r["hi"]) for r in got.groupBy("x").agg(
        F.count("*").alias("n"), F.count_distinct("copy").alias("d"), F.max("copy").alias("hi")).collect()}
    assert counts == {"a": (300, 300, 299), "b": (2, 2, 1), None: (1, 1, 0)}


def test_row_keys_differ_where_rows_do(spark):
    from exposurekit.operators.ordinal import text_key
    from exposurekit.operators.sampling import balanced_sample

    rows = [("a-b", "c", 1), ("a", "b-c", 1), ("~", "c", 1), (None, "c", 1), ("", "c", 1), ("1:a", "", 0), ("1", "a", 0)]
    df = spark.createDataFrame(rows, "a string, b string, y int")
    assert df.select(text_key(["a", "b"]).alias("k")).distinct().count() == len(rows)
    assert balanced_sample(df, "y", 1, ["a", "b"]).count() == 2


# buckets that follow the rows


def scattered(spark, n=100_000):
    """``n`` distinct scores, most of them in narrow ranges, in two groups; and one value with a third of all rows."""
    return spark.range(n).select(
        F.when(F.col("id") % 10 < 8, 0.5 + F.col("id") / 1e12).otherwise(F.pow(F.col("id") / n, 9)).alias("v"),
        (F.col("id") % 5 + 1).alias("w"),
        (F.col("id") % 3 == 0).cast("int").alias("g"),
    )


@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sums_through_a_tree_of_buckets(spark, descending):
    rows = scattered(spark)
    for by in (["g"], []):
        got = prefix_sums(rows, "v", ["w"], by, descending, limit=3000, width=8)
        frame = Window.partitionBy(*by).orderBy(F.desc("v") if descending else F.asc("v"))
        want = rows.withColumn("c", F.sum("w").over(frame)).withColumn("a", F.sum("w").over(Window.partitionBy(*by)))
        joined = got.join(want.select("v", "c", "a"), "v")
        assert joined.count() == 100_000
        assert joined.filter("w_cum <> c or w_all <> a").count() == 0


def test_no_bucket_of_a_tree_holds_more_than_the_limit(spark):
    rows = scattered(spark).unionByName(spark.range(50_000).select(F.lit(0.25).alias("v"), F.lit(1).cast("long").alias("w"), F.lit(1).alias("g")))
    first = value_buckets(rows, "v", width=8)
    assert first.may_hold() > 3000
    placed = deepened(rows.withColumn("_bucket", value_bucket(F.col("v"), first.limits, rows.schema["v"].dataType)), "v", ["g"], 3000, 8)
    leaves = placed.groupBy("_bucket").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("_bucket").collect()
    assert all(a["hi"] < z["lo"] for a, z in zip(leaves, leaves[1:]))  # paths sort as values do
    sizes = placed.groupBy("g", "_bucket").agg(F.count("*").alias("n"), F.count_distinct("v").alias("values")).collect()
    assert all(r["n"] <= 3000 or r["values"] == 1 for r in sizes) and sum(r["n"] for r in sizes) == 150_000
    assert max(len(r["_bucket"]) for r in sizes) > 2


def test_exact_quantiles_through_a_tree(spark):
    rng = np.random.default_rng(1)
    values = [(int(g), float(x)) for g, x in zip(rng.integers(0, 3, 6000), rng.normal(size=6000) ** 5)]
    values += [(0, 0.25)] * 6000 + [(1, -7.0)] * 3000 + [(3, 1.5), (4, None)]
    df = spark.createDataFrame(values, "g int, v double")
    shares = {"a": 0.25, "b": 0.8, "c": 1.0, "d": 0.0, "e": 0.5}
    got = {r["g"]: r for r in exact_quantiles(df, "v", shares, ["g"], limit=100, width=4).collect()}
    assert set(got) == {0, 1, 2, 3}
    for g, row in got.items():
        mine = [v for k, v in values if k == g]
        for name, q in shares.items():
            assert row[name] == pytest.approx(np.quantile(mine, q), abs=1e-9)


def test_hash_buckets_follow_the_rows(spark, monkeypatch):
    assert [hash_digits(n) for n in (0, 10**6, 2 * 10**6, 10**9, 10**12)] == [1, 1, 2, 4, 6]
    monkeypatch.setattr(ordinal, "OFFSETS_AT_ONCE", 16)  # offsets in two steps, joined by shuffle
    rows = spark.range(20_000).withColumn("g", F.when(F.col("id") % 5 < 3, F.col("id") % 5))
    for by in ([], ["g"]):
        placed = with_ordinal(rows, "id", 42, by, digits=3)
        whole = Window.partitionBy(*by).orderBy(seeded_key(F.col("id"), 42), "id")
        expected = rows.select("id", (F.row_number().over(whole) - 1).alias("want"))
        assert placed.join(expected, "id").filter("ordinal = want").count() == 20_000
