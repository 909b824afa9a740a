"""Physical plans that must hold at any size: what is shuffled, sorted, pushed down and read."""

import pytest
from pyspark.sql import functions as F

from exposurekit.operators import features, metrics, sampling
from exposurekit.operators.ordinal import with_ordinal
from exposurekit.session import cut_lineage


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def log(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("row_id"),
        (F.col("id") % 50).alias("user_id"),
        F.col("id").alias("timestamp"),
        (F.col("id") % 4 == 0).cast("int").alias("clicked"),
        F.concat(F.lit("t"), "id").alias("text"),
    )
    return cut_lineage(rows, "log")


@pytest.fixture
def no_broadcast(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_sample_is_a_filter_on_the_scan(log):
    for unique in (True, False):
        shape = plan(sampling.balanced_sample(log, "clicked", 300, ["row_id"], unique=unique))
        assert "Exchange" not in shape and "Sort" not in shape and "Join" not in shape


def test_split_shuffles_keys_only(log, no_broadcast):
    shape = plan(sampling.ordinal_split(log, {"a": 100, "b": 50}, "row_id"))
    top = shape.split("Subquery")[0]
    assert "Exchange" not in top and "Join" not in top


def test_cutoff_reaches_the_scan(log):
    hist, _ = features.time_window_split(log, "timestamp")
    shape = plan(features.smoothed_rate(hist, "user_id", "user"))
    assert "LessThan(timestamp,ScalarSubquery" in shape
    assert "text" not in shape


def test_offsets_join_on_the_partitioning_of_the_ranking(log, no_broadcast):
    shape = plan(with_ordinal(log.select("row_id", "user_id"), "row_id", 1, by=["user_id"]))
    ranked = shape[shape.index("SortMergeJoin") : shape.index("row_number")]
    assert "Exchange" not in ranked and "Sort [" not in ranked


def test_scores_are_counted_once(log, no_broadcast):
    scored = log.select("row_id", F.col("clicked").alias("y"), (F.col("row_id") % 97 / 97).alias("prob"))
    shape = plan(metrics.roc_auc(cut_lineage(scored, "scored")))
    assert shape.count("FileScan") == 1 and "ReusedExchange" in shape


def test_no_unpartitioned_window_over_rows(log):
    """The only windows without a group run over bucket tables, which are aggregates."""
    shape = plan(with_ordinal(log.select("row_id"), "row_id", 1))
    below = shape[shape.index("SinglePartition") :]
    assert below.index("HashAggregate") < below.index("FileScan")


def test_stage_folders_are_removed_after_a_run(spark):
    import os

    from exposurekit.session import cut_lineage, fresh_path, release, shared_folder, stages

    release(spark)
    place = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(place)) if os.path.isdir(place) else set()
    with stages(spark):
        assert cut_lineage(spark.range(5), "some").count() == 5
        assert set(os.listdir(place)) - before
        fresh_path(spark, "never written")
    assert set(os.listdir(place)) - before == set() and release(spark) == 0


@pytest.mark.parametrize("name", ["gift_sessions", "gift_tier", "tier_distribution", "price_summary"])
def test_a_task_holds_its_share_of_many_lines_only(spark, small, monkeypatch, name):
    """Sessions are summed where lines meet their orders: no task has more than about ``LINES_PER_TASK`` lines of them."""
    import __spark_entry__
    from exposurekit.catalog import views

    query = __spark_entry__.queries()[name]
    plain = sorted(map(tuple, query(spark, small).collect()))
    monkeypatch.setattr(views, "FEW_LINES", 1_000, raising=False)
    monkeypatch.setattr(views, "LINES_PER_TASK", 200, raising=False)
    sessions = features.gift_sessions(views.Views(spark, small).gift())
    shares = sessions.groupBy(F.spark_partition_id()).agg(F.sum("gift_count").alias("n"))
    assert shares.agg(F.max("n")).first()[0] < 2 * 200
    assert sorted(map(tuple, query(spark, small).collect())) == plain


def test_examples_are_found_without_sorting_rows(log):
    rows = log.select("row_id", "clicked", "user_id")
    shape = plan(sampling.regime_examples(rows, {"a": F.col("clicked") == 1, "b": F.col("user_id") > 40, "none": F.col("user_id") < 0}, "row_id"))
    assert "Sort [" not in shape and "hashpartitioning" not in shape and "Generate" in shape


@pytest.mark.parametrize("name", ["history_table", "regime_examples"])
def test_lines_meet_their_orders_for_the_log_and_the_rooms_only(spark, small, monkeypatch, name):
    """Every later pass reads what was stored of them: jobs that scan lineitem are the two that store."""
    import __spark_entry__
    from exposurekit import session

    scans = []

    def watched(df, label):
        shape = df._jdf.queryExecution().optimizedPlan().toString()
        scans.extend([label] * ("l_orderkey" in shape))
        return session.cut_lineage(df, label)

    for module in ("exposurekit.catalog.build", "exposurekit.plans.tables", "exposurekit.operators.sampling"):
        monkeypatch.setattr(f"{module}.cut_lineage", watched, raising=False)
    got = __spark_entry__.queries()[name](spark, small)
    assert got.count() > 0
    assert len(scans) == 2 and "l_orderkey" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_keys_that_are_not_hot_join_without_sub_keys(spark, log, no_broadcast):
    sample = log.select("row_id", "user_id", F.col("user_id").alias("streamer_id"), F.col("row_id").alias("live_id"))
    dims = [log.select(F.col("row_id").alias(k), F.col("text").alias(f"t_{k}")) for k in ("user_id", "streamer_id", "live_id")]
    joined = features.join_dims(sample, *dims, ["row_id"])
    assert "_sub" not in plan(joined)
    assert joined.columns == ["row_id", "user_id", "streamer_id", "live_id", "t_user_id", "t_streamer_id", "t_live_id"]
    assert joined.filter("t_user_id = concat('t', user_id) and t_live_id = concat('t', row_id)").count() == 4000
