"""Queries by name, each over a folder of the given tables, with SQL of equal meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Comparable columns: whole numbers and flags as bigint, fractions to 6 digits."""

    def column(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegralType, T.BooleanType)):
            return c.cast("bigint").alias(field.name)
        if isinstance(field.dataType, T.FractionalType):
            return F.round(c.cast("double"), 6).alias(field.name)
        return c

    return df.select(*[column(f) for f in df.schema.fields])


def query(name: str, views: str = "", sql: str | None = None):
    """Register a function of ``Views`` under ``name``."""

    def register(build: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plain(build(Views(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return build

    return register
