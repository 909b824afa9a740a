"""A keyed store of a teacher's rationales: what is there is kept, what is missing is asked for.

The store is a folder of JSON lines (row_id, rationale, label, version) that is only
ever added to, a batch of answers at a time, so a run that stops halfway loses nothing
and the next one asks only for what is left. Of several answers for one row the largest
version counts, then the first text by code point. An answer without a text is a failed
call: it is asked again, and stands in as a stated default while it has not been
answered. Answers for rows that nobody asks about stay in the store unused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.wording import FAILED_RATIONALE

STORE = T.StructType(
    [
        T.StructField("row_id", T.StringType()),
        T.StructField("rationale", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("version", T.LongType()),
    ]
)
ANSWERED, FAILED, MISSING = "answered", "failed", "missing"


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All answers ever stored; lines of an older file without a version count as version 0."""
    stored = spark.read.schema(STORE).json(path)
    return stored.withColumn("version", F.coalesce("version", F.lit(0).cast("long"))).filter(F.col("row_id").isNotNull())


def add_answers(path: str, answers: DataFrame, version: int) -> None:
    """Append a batch of (row_id, rationale, label); answers that come later have a larger version."""
    rows = answers.select(F.col("row_id").cast("string").alias("row_id"), "rationale", F.col("label").cast("int").alias("label"))
    rows.withColumn("version", F.lit(version).cast("long")).write.mode("append").option("ignoreNullFields", False).json(path)


def current(store: DataFrame) -> DataFrame:
    """(row_id, rationale, label, version): the answer that counts, one row per row_id.

    A failed call never replaces a text: blank answers only count where there is none.
    """
    text = F.when(F.trim("rationale") != "", F.col("rationale"))
    told = store.withColumn("rationale", text)
    order = F.struct(F.col("rationale").isNull().alias("failed"), (-F.col("version")).alias("late"), "rationale", "label")
    first = told.groupBy("row_id").agg(F.min(order).alias("_a"))
    return first.select("row_id", "_a.rationale", "_a.label", (-F.col("_a.late")).alias("version"))


def completeness(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row_id, status, rationale, label, version) of every wanted row: answered, failed or missing."""
    rows = wanted.select(F.col("row_id").cast("string").alias("row_id")).filter(F.col("row_id").isNotNull()).distinct()
    found = rows.join(current(store).withColumn("_there", F.lit(True)), "row_id", "left")
    status = F.when(F.col("_there").isNull(), F.lit(MISSING)).when(F.col("rationale").isNull(), F.lit(FAILED)).otherwise(F.lit(ANSWERED))
    return found.select("row_id", status.alias("status"), "rationale", "label", "version")


def work_list(found: DataFrame) -> DataFrame:
    """(row_id, attempt): the rows to ask for, with the version that their answers get."""
    left = found.filter(F.col("status") != ANSWERED)
    return left.select("row_id", F.coalesce(F.col("version") + 1, F.lit(0).cast("long")).alias("attempt"))


def with_default(found: DataFrame, default: str = FAILED_RATIONALE) -> DataFrame:
    """(row_id, rationale, label, defaulted) of the rows that were asked for; failed calls have the default text.

    Missing rows are left out: nobody has asked yet.
    """
    asked = found.filter(F.col("status") != MISSING)
    return asked.select("row_id", F.coalesce("rationale", F.lit(default)).alias("rationale"), "label", (F.col("status") == FAILED).alias("defaulted"))


def summary(found: DataFrame) -> DataFrame:
    """(wanted, answered, failed, missing, complete) in one row; ``complete``: nothing is left to ask for the first time."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in (ANSWERED, FAILED, MISSING)]
    return found.agg(F.count(F.lit(1)).alias("wanted"), *counts).withColumn("complete", (F.col(MISSING) == 0).cast("int"))
