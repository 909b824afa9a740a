"""Readers with stated schemas. Nothing is inferred from the big log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.wording import STREAMER_FEATURES, USER_FEATURES
from ..session import broadcast_if_small
from . import csv
from .sinks import CSV_OWN, CSV_TEXT

KEY_ROWS = 1_000_000

INTERACTION = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("user_id", "live_id", "streamer_id", "timestamp")]
)
GIFT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("user_id", "live_id", "streamer_id")]
    + [T.StructField("gift_price", T.DoubleType()), T.StructField("timestamp", T.LongType())]
)
ROOM = T.StructType(
    [
        T.StructField("live_id", T.LongType()),
        T.StructField("live_type", T.StringType()),
        T.StructField("live_content_category", T.StringType()),
        T.StructField("start_timestamp", T.LongType()),
        T.StructField("end_timestamp", T.LongType()),
    ]
)
# Attributes come as bands or counts; text keeps either form unchanged in prompts.
USER = T.StructType(
    [T.StructField("user_id", T.LongType())] + [T.StructField(c[2:], T.StringType()) for c in USER_FEATURES]
)
STREAMER = T.StructType(
    [T.StructField("streamer_id", T.LongType())] + [T.StructField(c[2:], T.StringType()) for c in STREAMER_FEATURES]
)
RATIONALE = T.StructType(
    [
        T.StructField("row_id", T.StringType()),
        T.StructField("rationale", T.StringType()),
        T.StructField("label", T.IntegerType()),
    ]
)


def missing_for_nan(df: DataFrame) -> DataFrame:
    """Floating NaN becomes NULL, the only form of missing the operators know."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def parsed(name: str, kind: T.DataType, strict: bool = True) -> Column:
    """A CSV column as ``kind``. Whole numbers may come as ``12.0`` or ``1.7e12``; blank and ``nan`` are missing.

    Any other text that is no such number stops the job, or with ``strict=False`` is missing.
    """
    text = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return text
    plain = F.trim(text)
    if isinstance(kind, T.IntegralType):
        exact = plain.try_cast(T.DecimalType(28, 9))  # room for every bigint, and for a part to be refused
        whole = exact.try_cast(T.DecimalType(19, 0))
        value = F.when(exact == whole, whole.try_cast(kind))
    else:
        value = plain.try_cast(kind)
    blank = text.isNull() | F.lower(plain).isin("", "nan", "null", "none")
    if not strict:
        return F.when(~blank, value)
    problem = F.raise_error(F.concat(F.lit(f"column {name} is not {kind.simpleString()}: "), text))
    return F.when(blank, F.lit(None)).when(value.isNull(), problem.cast(kind)).otherwise(value)


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "csv",
    columns: Sequence[str] | None = None,
    strict: bool = True,
    partial: bool = False,
    stray_quotes: bool = False,
) -> DataFrame:
    """Read by name: a CSV with more columns, or in another order, still fits the schema.

    A column that a CSV lacks is an error, or, with ``partial``, left out. Texts may hold doubled quotes and line breaks;
    files are split among tasks all the same. ``stray_quotes``: unquoted fields hold quotes, so that only a reader that
    starts at the top of a file can tell where texts end; such a file is one task's.
    """
    if fmt == "csv":
        names = csv.header(spark, path)
        absent = [f.name for f in schema.fields if f.name not in names]
        if absent and not partial:
            raise ValueError(f"{path} has no column {', '.join(absent)}")
        quoted = any(isinstance(f.dataType, T.StringType) for f in schema.fields)
        if quoted and not stray_quotes:
            raw = csv.parsed_records(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in names]), CSV_TEXT)
        else:
            raw = spark.read.options(**CSV_TEXT, multiLine=quoted).csv(path)
        # types apply per column, so the file's own column order does not matter
        df = raw.select(*[parsed(f.name, f.dataType, strict).alias(f.name) for f in schema.fields if f.name not in absent])
    else:
        df = spark.read.schema(schema).format(fmt).load(path)
    if columns is not None:
        df = df.select(*columns)
    return missing_for_nan(df)


def numeric_where_possible(df: DataFrame) -> DataFrame:
    """Text columns that hold only numbers become numbers: bigint if all are whole and none is missing, else double.

    One pass over an attribute table decides for all columns; meant for tables of
    attributes, never for the log.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    checks = []
    for c in texts:
        number = F.col(c).try_cast("double")
        checks += [
            F.count(c).alias(f"present_{c}"),
            F.count_if(F.col(c).isNotNull() & number.isNull()).alias(f"words_{c}"),
            F.count_if(F.col(c).isNull() | F.col(c).try_cast("bigint").isNull() | F.col(c).contains(".")).alias(f"parts_{c}"),
        ]
    found = df.agg(*checks).first()
    kinds = {c: "double" if found[f"parts_{c}"] else "bigint" for c in texts if found[f"present_{c}"] and not found[f"words_{c}"]}
    return df.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()}) if kinds else df


def read_dim(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "csv",
    columns: Sequence[str] | None = None,
    numbers: bool = False,
    partial: bool = False,
) -> DataFrame:
    """A user, streamer, room or gift table; ``numbers`` turns purely numeric text columns into numbers."""
    table = read_table(spark, path, schema, fmt, columns, partial=partial)
    return missing_for_nan(numeric_where_possible(table)) if numbers else table


def exposures(pos: DataFrame, neg: DataFrame, label: str = "clicked") -> DataFrame:
    """Clicked and not-clicked exposures as one labelled log; only the four key columns."""
    keys = INTERACTION.names
    return pos.select(*keys, F.lit(1).alias(label)).unionByName(neg.select(*keys, F.lit(0).alias(label)))


def key_list(rows: DataFrame, on: str) -> DataFrame:
    """The distinct keys of ``rows``, written once; a hot key is one row.

    Up to KEY_ROWS of them (long integers, a few megabytes) are marked for broadcast.
    """
    return broadcast_if_small(rows.select(on).filter(F.col(on).isNotNull()).distinct(), "keys", KEY_ROWS)


def restrict_to_keys(table: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``table`` whose key occurs in ``keys``: a filter on the scan while the keys are few."""
    return keep_keys(table, key_list(keys, on), on)


def keep_keys(table: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """``restrict_to_keys`` with a ``key_list`` that several tables share."""
    return table.join(keys, on, "left_semi")


def read_modeling(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """A modelling table written by ``write_table``; CSV needs the schema it was written with."""
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV modelling table needs its schema")
        names = csv.header(spark, path)
        if [c.lower() for c in names] != [c.lower() for c in schema.names]:
            raise ValueError(f"{path} has columns {', '.join(names)}, not {', '.join(schema.names)}")
        return missing_for_nan(csv.parsed_records(spark, path, schema, {**CSV_OWN, "mode": "FAILFAST"}))
    reader = spark.read if schema is None else spark.read.schema(schema)
    return missing_for_nan(reader.parquet(path))


def cached_rationales(spark: SparkSession, path: str, train: DataFrame, row_id: str = "row_id") -> DataFrame | None:
    """Stored rationales of exactly the training rows, or None when any row lacks one.

    Of several texts stored for a row the first by code point counts.
    """
    stored = spark.read.schema(RATIONALE).json(path).withColumnRenamed("row_id", row_id)
    first = stored.groupBy(row_id).agg(F.min(F.struct("rationale", "label")).alias("_r")).select(row_id, "_r.*")
    wanted = train.select(row_id).distinct()
    kept = first.join(wanted, row_id, "left_semi")
    return kept if kept.count() >= wanted.count() else None
