from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from exposurekit.catalog.views import Views
from exposurekit.config import DEFAULTS
from exposurekit.functions.wording import CONTEXT_FEATURES
from exposurekit.plans import studies
from exposurekit.plans import tables as plans
from exposurekit.session import cut_lineage, fresh_path, shared_folder
from exposurekit.sources import sinks, tables


def test_csv_dimension_by_name(spark, tmp_path):
    path = tmp_path / "user.csv"
    path.write_text("onehot_feat0,age,user_id,gender\n1,18-23,5,M\n0,,6,\n")
    schema = T.StructType([f for f in tables.USER.fields if f.name in ("user_id", "age", "gender")])
    out = tables.read_dim(spark, str(path), schema)
    assert out.columns == ["user_id", "age", "gender"]
    assert sorted(tuple(r) for r in out.collect()) == [(5, "18-23", "M"), (6, None, None)]


def test_numeric_attributes_become_numbers(spark, tmp_path):
    path = tmp_path / "user.csv"
    path.write_text("user_id,age,fans_num,follow_num,country\n5,18-23,7,7,\n6,24-30,8,,\n7,50+,9,2.5,\n")
    out = tables.read_dim(spark, str(path), tables.USER, numbers=True, partial=True)
    kinds = {f.name: f.dataType.simpleString() for f in out.schema.fields}
    assert kinds == {"user_id": "bigint", "age": "string", "fans_num": "bigint", "follow_num": "double", "country": "string"}
    assert sorted(r["fans_num"] for r in out.collect()) == [7, 8, 9]


def test_exposures_from_files_use_four_columns(spark, tmp_path):
    (tmp_path / "click.csv").write_text("user_id,live_id,streamer_id,timestamp,watch\n1,2,3,4,9\n")
    (tmp_path / "negative.csv").write_text("user_id,live_id,streamer_id,timestamp\n1,2,3,5\n1,2,3,5\n")
    logs = [tables.read_table(spark, str(tmp_path / f), tables.INTERACTION) for f in ("click.csv", "negative.csv")]
    rows = plans.identified(tables.exposures(*logs))
    got = sorted((r["row_id"], r["clicked"]) for r in rows.collect())
    assert got == [("1:1-1:2-1:3-1:4-1:1-1:0", 1), ("1:1-1:2-1:3-1:5-1:0-1:0", 0), ("1:1-1:2-1:3-1:5-1:0-1:1", 0)]
    assert rows.schema["timestamp"].dataType == T.LongType()


def test_nan_becomes_missing(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, k int")
    assert [r["x"] for r in tables.missing_for_nan(df).orderBy("k").collect()] == [None, 2.0]


def test_table_round_trips(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, None, 2.5)], "k long, t string, x double")
    for fmt in ("parquet", "csv"):
        path = fresh_path(spark, "trip")
        sinks.write_table(df, path, fmt)
        assert sorted(tables.read_modeling(spark, path, df.schema, fmt).collect()) == sorted(df.collect())
    path = fresh_path(spark, "records")
    sinks.write_records(df, path)
    assert '"x":null' in "".join(r["value"] for r in spark.read.text(path).collect())


def test_incomplete_rationales_are_not_reused(spark):
    train = spark.createDataFrame([(str(i), f"why {i}", i % 2) for i in range(5)], tables.RATIONALE)
    path = fresh_path(spark, "rationales")
    sinks.write_jsonl(train, path)
    assert tables.cached_rationales(spark, path, train.filter("row_id <> '3'")).count() == 4
    more = train.unionByName(spark.createDataFrame([("9", "new", 0)], tables.RATIONALE))
    assert tables.cached_rationales(spark, path, more) is None


def test_rooms_restricted_to_keys(spark):
    dim = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "live_id long, v string")
    keys = spark.createDataFrame([(1,), (1,), (7,), (None,)], "live_id long")
    assert sorted(r["v"] for r in tables.restrict_to_keys(dim, keys, "live_id").collect()) == ["a", "b"]


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == (named or shared_folder(spark))
    df = cut_lineage(spark.range(10), "ten")
    assert df.count() == 10 and "parquet" in df._jdf.queryExecution().executedPlan().toString().lower()


@pytest.fixture(scope="module")
def v(spark, small):
    return Views(spark, small)


def test_history_table_columns_and_balance(v):
    settings = replace(DEFAULTS, history_per_class=300)
    table = plans.history_table(v.log(), v.user(), v.streamer(), v.room(), Views.room_order, settings)
    assert {r["clicked"]: r["count"] for r in table.groupBy("clicked").count().collect()} == {0: 300, 1: 300}
    assert table.columns[:5] == ["row_id", *plans.KEYS, "clicked"]
    assert table.columns[-4:] == list(CONTEXT_FEATURES)
    assert table.select("row_id").distinct().count() == 600
    assert not [c for c in table.columns if "onehot" in c or "timestamp" in c]
    assert set(plans.feature_names(table)) >= {"user_ctr", "user_n", "u_age", "s_country", "ctx_hour"}
    assert table.filter("user_ctr is null or user_n is null or cat_ctr is null").count() == 0


def test_history_features_ignore_later_labels(v):
    """Flipping every label after the cutoff leaves all history features as they were."""
    log = v.log()
    cutoff = log.agg((F.min("timestamp") + 0.6 * (F.max("timestamp") - F.min("timestamp")))).first()[0]
    flipped = log.withColumn("clicked", F.when(F.col("timestamp") >= cutoff, 1 - F.col("clicked")).otherwise(F.col("clicked")))
    settings = replace(DEFAULTS, history_per_class=100_000)
    features = ["user_id", "live_id", "streamer_id", "user_ctr", "user_n", "streamer_ctr", "streamer_n", "cat_ctr"]
    out = [
        sorted(plans.history_table(x, v.user(), v.streamer(), v.room(), Views.room_order, settings).select(*features).collect())
        for x in (log, flipped)
    ]
    assert out[0] == out[1]


def test_static_table_is_balanced_and_repeatable(v):
    settings = replace(DEFAULTS, static_per_class=200)
    tables_ = [
        plans.static_table(v.log().repartition(n), v.user(), v.streamer(), v.room(), Views.room_order, settings).collect()
        for n in (1, 7)
    ]
    assert sorted(map(repr, tables_[0])) == sorted(map(repr, tables_[1])) and len(tables_[0]) == 400


def test_gift_table_has_every_session(v):
    table = plans.gift_table(v.gift(), v.user(), v.streamer(), v.room(), Views.room_order)
    assert table.count() == v.gift().select(*plans.KEYS).distinct().count()
    assert {r["gift_tier"] for r in table.select("gift_tier").distinct().collect()} <= {"Low", "Mid", "High"}


def test_from_raw_files_to_a_split_table(spark, v):
    """CSV logs and attribute files with extra columns, through the table, to disjoint parts."""
    raw = fresh_path(spark, "raw")
    log = v.log().withColumn("watch_live_time", F.lit(1))
    sinks.write_table(log.filter("clicked = 1").drop("clicked"), f"{raw}/click", "csv")
    sinks.write_table(log.filter("clicked = 0").drop("clicked"), f"{raw}/negative", "csv")
    sinks.write_table(v.user().withColumn("fans_num", F.col("user_id") % 50), f"{raw}/user", "csv")
    sinks.write_table(v.streamer(), f"{raw}/streamer", "csv")
    sinks.write_table(v.room(), f"{raw}/room", "csv")
    exposures = tables.exposures(
        *[tables.read_table(spark, f"{raw}/{f}", tables.INTERACTION) for f in ("click", "negative")]
    )
    table = plans.history_table(
        exposures,
        tables.read_dim(spark, f"{raw}/user", tables.USER, numbers=True, partial=True),
        tables.read_dim(spark, f"{raw}/streamer", tables.STREAMER, numbers=True, partial=True),
        tables.read_dim(spark, f"{raw}/room", tables.ROOM),
        ["start_timestamp", "end_timestamp", "live_content_category"],
        replace(DEFAULTS, history_per_class=400),
    )
    assert {"u_fans_num", "u_age", "s_country", "s_device_price"} <= set(table.columns)
    assert not [c for c in table.columns if "onehot" in c]
    path = fresh_path(spark, "history")
    sinks.write_table(table, path)
    stored = tables.read_modeling(spark, path)
    parts = studies.split_table(stored, train=500, test=200)
    assert [parts[p].count() for p in ("train", "test", "pool")] == [500, 200, 100]
    rates = v.spark.createDataFrame(
        [(r["user_id"], r["user_ctr"]) for r in stored.select("user_id", "user_ctr").distinct().collect()], "user_id long, r double"
    )
    direct = plans.history_table(v.log(), v.user(), v.streamer(), v.room(), Views.room_order, replace(DEFAULTS, history_per_class=400))
    both = direct.join(rates, "user_id")
    assert both.count() == 800 and both.filter("abs(user_ctr - r) > 1e-12").count() == 0


AWKWARD = ["plain", "", None, " blanks ", 'say ""hi"", "now", 3', "line\nbreak", "tab\t,comma", "'", '"', "\\N", "nan", "é\u00a0x", '\\"', ",", "\n"]


def test_own_csv_keeps_every_text(spark, tmp_path):
    rows = [(i, t, float("nan") if i == 2 else i / 3) for i, t in enumerate(AWKWARD)]
    df = spark.createDataFrame(rows, "id long, text string, x double")
    sinks.write_table(df, str(tmp_path / "t"), fmt="csv")
    got = {r.id: (r.text, r.x) for r in tables.read_modeling(spark, str(tmp_path / "t"), df.schema, fmt="csv").collect()}
    assert got == {i: (t, None if i == 2 else x) for i, t, x in rows}


def test_raw_csv_with_points_quotes_and_gaps(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_text('end,extra,id,name\n4,x,12.0,"say ""hi"", now"\n,y,1.7e3,"two\nlines"\nNaN,z,,\n')
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("end", T.DoubleType())])
    got = sorted((tuple(r) for r in tables.read_table(spark, str(raw), schema).collect()), key=repr)
    assert got == [(12, 'say "hi", now', 4.0), (1700, "two\nlines", None), (None, None, None)]


def test_raw_csv_that_does_not_fit_is_an_error(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_text("id\n12.5\n7\n")
    schema = T.StructType([T.StructField("id", T.LongType())])
    with pytest.raises(Exception, match="column id is not bigint: 12.5"):
        tables.read_table(spark, str(raw), schema).collect()
    assert sorted(r.id or 0 for r in tables.read_table(spark, str(raw), schema, strict=False).collect()) == [0, 7]
    with pytest.raises(ValueError, match="has no column other"):
        tables.read_table(spark, str(raw), T.StructType([T.StructField("other", T.LongType())]))


def test_modelling_table_has_no_nan(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "id long, x double")
    df.write.parquet(str(tmp_path / "p"))
    assert {r.id: r.x for r in tables.read_modeling(spark, str(tmp_path / "p")).collect()} == {1: None, 2: 3.0}


def test_stored_rationales_with_several_texts(spark, tmp_path):
    rows = [("1", "b", 1), ("1", "a", 0), ("2", "c", 1)]
    spark.createDataFrame(rows, "row_id string, rationale string, label int").write.json(str(tmp_path / "r"))
    got = tables.cached_rationales(spark, str(tmp_path / "r"), spark.createDataFrame([("1",), ("2",), ("2",)], "row_id string"))
    assert sorted(tuple(r) for r in got.collect()) == [("1", "a", 0), ("2", "c", 1)]
