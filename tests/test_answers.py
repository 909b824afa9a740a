import pytest
from pyspark.sql import functions as F

from exposurekit.functions.wording import FAILED_RATIONALE
from exposurekit.session import fresh_path
from exposurekit.sources import answers, sinks, tables

BATCH = "row_id string, rationale string, label int"


@pytest.fixture
def store(spark):
    path = fresh_path(spark, "answers")
    answers.add_answers(path, spark.createDataFrame([("1", "old", 1), ("2", None, 0), ("3", " ", 1), ("4", "b", 0), ("4", "a", 0)], BATCH), 0)
    answers.add_answers(path, spark.createDataFrame([("1", "new", 1), ("2", "at last", 0), ("4", "", 0), (None, "lost", 0), ("99", "unused", 1)], BATCH), 1)
    return path


def test_the_latest_text_counts(spark, store):
    got = {r.row_id: (r.rationale, r.version) for r in answers.current(answers.read_store(spark, store)).collect()}
    assert got == {"1": ("new", 1), "2": ("at last", 1), "3": (None, 0), "4": ("a", 0), "99": ("unused", 1)}


def test_partly_answered_rows(spark, store):
    wanted = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 5, None)], "row_id long")
    found = answers.completeness(answers.read_store(spark, store), wanted)
    assert {r.row_id: r.status for r in found.collect()} == {"1": "answered", "2": "answered", "3": "failed", "4": "answered", "5": "missing"}
    assert sorted(tuple(r) for r in answers.work_list(found).collect()) == [("3", 1), ("5", 0)]
    told = {r.row_id: (r.rationale, r.defaulted) for r in answers.with_default(found).collect()}
    assert told == {"1": ("new", False), "2": ("at last", False), "3": (FAILED_RATIONALE, True), "4": ("a", False)}
    assert answers.summary(found).first().asDict() == {"wanted": 5, "answered": 3, "failed": 1, "missing": 1, "complete": 0}


def test_a_second_run_asks_only_for_what_is_left(spark, store):
    wanted = spark.range(1, 7).select(F.col("id").alias("row_id"))
    work = answers.work_list(answers.completeness(answers.read_store(spark, store), wanted))
    assert {r.row_id for r in work.collect()} == {"3", "5", "6"}
    batch = work.select("row_id", F.concat(F.lit("why "), "row_id").alias("rationale"), F.lit(1).alias("label"))
    answers.add_answers(store, spark.createDataFrame(batch.collect(), batch.schema), 2)
    found = answers.completeness(answers.read_store(spark, store), wanted)
    assert answers.work_list(found).count() == 0 and answers.summary(found).first().complete == 1


def test_older_files_and_empty_stores(spark):
    path = fresh_path(spark, "old")
    sinks.write_jsonl(spark.createDataFrame([("1", "x", 1)], tables.RATIONALE), path)
    assert [tuple(r) for r in answers.current(answers.read_store(spark, path)).collect()] == [("1", "x", 1, 0)]
    none = spark.createDataFrame([], answers.STORE)
    wanted = spark.createDataFrame([("1",)], "row_id string")
    assert [r.status for r in answers.completeness(none, wanted).collect()] == ["missing"]
    assert answers.summary(answers.completeness(none, wanted.limit(0))).first().complete == 1
