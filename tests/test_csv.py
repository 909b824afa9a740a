"""Quoted CSV read in splits equals what a reader from the top of the file finds."""

import csv
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from exposurekit.sources import csv as split_csv
from exposurekit.sources import tables

TEXTS = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "a", "b")])


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "4"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def texts(rng):
    parts = ["x", "yy", " ", ",", '"', "\n", "\r\n", '""', "é", "日本", "\t", "z" * 30, "\n" * 5, '","', "\\"]
    return "".join(rng.choices(parts, k=rng.randint(0, 7)))


def write(path, rows, end):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(["a", "id", "b"])
        w.writerows([[a, i, b] for i, a, b in rows])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_over_splits(spark, tmp_path, small_splits, end):
    rng, want = random.Random(len(end)), []
    for part in range(4):
        rows = [(f"{part}-{i}", texts(rng), texts(rng)) for i in range(30)]
        rows.append((f"{part}-long", "l\n" * 120 + '"', 'q"' * 50))  # over many splits
        write(tmp_path / f"part-{part}.csv", rows, end)
        want += rows
    (tmp_path / "part-4.csv").write_text("a,id,b\n")
    df = tables.read_table(spark, str(tmp_path), TEXTS)
    got = sorted((r.id, r.a or "", r.b or "") for r in df.collect())
    assert got == sorted(want)
    assert split_csv._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 25


def test_one_large_file_is_many_tasks(spark, tmp_path, small_splits):
    write(tmp_path / "room.csv", [(str(i), f"name {i}", 'say "hi"') for i in range(60)], "\n")
    df = tables.read_table(spark, str(tmp_path / "room.csv"), TEXTS)
    plan = df._jdf.queryExecution().toString()
    assert df.rdd.getNumPartitions() > 5 and "FileScan csv" not in plan and "FileScan text" in plan
    assert df.filter(F.col("b") == 'say "hi"').count() == 60


def test_a_quote_that_is_not_closed(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('id,a,b\n1,"open,2\n3,4,5\n')
    with pytest.raises(ValueError, match="ends inside a quoted text"):
        tables.read_table(spark, str(tmp_path / "bad.csv"), TEXTS)


def test_stray_quotes_and_blank_lines(spark, tmp_path):
    (tmp_path / "inch.csv").write_text('id,a,b\n1,5" disk,x\n\n2,3" disk,y\n')
    got = tables.read_table(spark, str(tmp_path / "inch.csv"), TEXTS, stray_quotes=True).collect()
    assert sorted(tuple(r) for r in got) == [("1", '5" disk', "x"), ("2", '3" disk', "y")]
    (tmp_path / "blank.csv").write_text("﻿id,a,b\n\n1,,\r\n\r\n2,x,y")
    got = tables.read_table(spark, str(tmp_path / "blank.csv"), TEXTS).collect()
    assert sorted(tuple(r) for r in got) == [("1", None, None), ("2", "x", "y")]


def test_own_csv_with_other_columns_is_an_error(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,c\n1,2\n")
    with pytest.raises(ValueError, match="has columns a, c"):
        tables.read_modeling(spark, str(tmp_path / "t.csv"), T.StructType([T.StructField("a", T.LongType())]), fmt="csv")
