"""Counts, shares and typing of a modelling table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import decimal_text, round_to, value_text
from .ordinal import exact_quantiles


def dtype_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def unpivot_text(df: DataFrame, column: str, digits: int | None = None) -> Column:
    """A feature's value as text, numbers optionally rounded."""
    dtype = dtype_of(df, column)
    if digits is not None and isinstance(dtype, T.NumericType):
        rounded = round_to(F.col(column).cast("double"), digits)
        return F.coalesce(decimal_text(rounded), F.lit("nan"))
    return value_text(column, dtype)


def log_summary(df: DataFrame, label: str = "clicked") -> DataFrame:
    return df.agg(
        F.count_if(F.col(label) == 1).alias("positives"),
        F.count_if(F.col(label) == 0).alias("negatives"),
        F.count(label).alias("total"),
        F.try_divide(F.count_if(F.col(label) == 1), F.count(label)).alias("natural_rate"),
    )


def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct non-missing values per column, exact or sketched."""
    count = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(*[count(c).alias(f"distinct_{c}") for c in columns])


def class_balance(df: DataFrame, column: str, classes: Sequence) -> DataFrame:
    """Rows and share of each listed class, absent ones with 0; ``position`` keeps the given order."""
    kind = dtype_of(df, column).simpleString()
    listed = df.sparkSession.createDataFrame(
        [(i, c) for i, c in enumerate(classes)], f"position int, class {kind}"
    )
    counted = df.groupBy(F.col(column).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total")).scalar()
    n = F.coalesce(F.col("n"), F.lit(0))
    return listed.join(counted, "class", "left").select(
        "position", "class", n.alias("n"), (n / F.nullif(total, F.lit(0))).alias("share")
    )


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """Minimum, exact median, mean and maximum."""
    median = exact_quantiles(df, column, {"median": 0.5}).scalar()
    return df.agg(
        F.min(column).alias("min"), F.avg(column).alias("mean"), F.max(column).alias("max")
    ).select("min", median.alias("median"), "mean", "max")


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share missing per column, only columns that miss any, worst first."""
    one_row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    long = one_row.unpivot([], list(columns), "feature", "share")
    return long.filter(F.col("share") > 0).orderBy(F.desc("share"), "feature")


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value; missing is a value of its own."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def prediction_balance(preds: DataFrame, hard: str = "hard") -> DataFrame:
    return preds.groupBy(F.col(hard).alias("hard")).agg(F.count(F.lit(1)).alias("n"))


def numeric_features(df: DataFrame, features: Sequence[str], min_distinct: int = 30) -> list[str]:
    """Numeric columns with more than ``min_distinct`` distinct values.

    A sketch settles columns far from the limit in one pass over the data; only
    columns whose estimate is near it are counted exactly.
    """
    candidates = [f for f in features if isinstance(dtype_of(df, f), T.NumericType)]
    if not candidates:
        return []
    rough = df.agg(*[F.approx_count_distinct(c).alias(c) for c in candidates]).first().asDict()
    near = [c for c in candidates if min_distinct / 2 <= rough[c] <= min_distinct * 2]
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in near]).first().asDict() if near else {}
    return [c for c in candidates if exact.get(c, rough[c]) > min_distinct]


def feature_typing(df: DataFrame, features: Sequence[str], min_distinct: int = 30) -> DataFrame:
    """``feature, kind``: numeric if the type is numeric and the values are many, else categorical."""
    numeric = set(numeric_features(df, features, min_distinct))
    rows = [(f, "numeric" if f in numeric else "categorical") for f in features]
    return df.sparkSession.createDataFrame(rows, "feature string, kind string")


def impute_values(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """``feature, value`` as text: the mean of numeric features, the mode of the others.

    Equal counts go to the smallest value. Modes come from counted (feature, value)
    pairs, so no task holds all values of a column.
    """
    parts = []
    if numeric:
        means = train.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in numeric])
        long = means.unpivot([], list(numeric), "feature", "_v")
        parts.append(long.select("feature", value_text("_v", T.DoubleType()).alias("value")))
    if categorical:
        texts = train.select(
            *[F.when(F.col(c).isNotNull(), unpivot_text(train, c)).alias(c) for c in categorical]
        ).unpivot([], list(categorical), "feature", "value")
        counted = texts.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        numbers = [c for c in categorical if isinstance(dtype_of(train, c), T.NumericType)]
        as_number = F.when(F.col("feature").isin(*numbers), F.col("value").try_cast("double"))
        best = F.min_by("value", F.struct((-F.col("n")).alias("n"), as_number.alias("number"), "value"))
        parts.append(counted.groupBy("feature").agg(best.alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
