"""One-hot and numeric encoding of modelling tables.

Levels are a table (feature, level, place), never a list on the driver: rows find their
levels by joins, so there may be any number of them. What the driver holds is one range
of vector positions per feature.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import BROADCAST_ROWS, cut_lineage
from .profile import numeric_features, unpivot_text


class Slots(Sequence):
    """The feature behind every vector position, as ranges: ``(feature, width)`` one after the other."""

    def __init__(self, widths: Sequence[tuple[str, int]]):
        self.names = [f for f, _ in widths]
        self.starts, end = [], 0
        for _, width in widths:
            self.starts.append(end)
            end += width
        self.end = end

    def __len__(self) -> int:
        return self.end

    def __getitem__(self, position: int) -> str:
        if not 0 <= position < self.end:
            raise IndexError(position)
        return self.names[bisect_right(self.starts, position) - 1]  # the last of those that start there has a width

    def __iter__(self) -> Iterator[str]:
        return (self[i] for i in range(self.end))

    def count(self, feature: str) -> int:
        return sum(b - a for f, a, b in zip(self.names, self.starts, [*self.starts[1:], self.end]) if f == feature)


@dataclass(frozen=True)
class Encoder:
    """A fitted encoding. ``levels``: f (index of the categorical feature), level, place; written once."""

    features: tuple[str, ...]
    numeric: tuple[str, ...]
    flagged: tuple[str, ...]
    means: dict[str, float]
    levels: DataFrame | None
    sizes: dict[str, int]
    slots: Slots
    output: str = "features"

    @property
    def categorical(self) -> list[str]:
        return [f for f in self.features if f not in self.numeric]

    def coded(self, df: DataFrame) -> DataFrame:
        """Adds ``<f>__index`` (null for an unseen level), ``<f>__num`` and ``<f>__gap``; one join per categorical feature."""
        out = level_columns(df, self.categorical)
        for i, f in enumerate(self.categorical):
            mine = self.levels.filter(F.col("f") == i).select(F.col("level").alias(f"{f}__level"), F.col("place").alias(f"{f}__index"))
            out = out.join(F.broadcast(mine) if self.sizes[f] <= BROADCAST_ROWS else mine, f"{f}__level", "left").drop(f"{f}__level")
        out = out.withColumns({f"{f}__num": F.coalesce(F.col(f).cast("double"), F.lit(self.means[f])) for f in self.numeric})
        return out.withColumns({f"{f}__gap": F.col(f).isNull().cast("double") for f in self.flagged})

    def entries(self, df: DataFrame, row_id: str = "row_id") -> DataFrame:
        """Non-zero vector entries ``row_id, position, value``, straight from the joins: no vector is built."""
        coded = self.coded(df.select(row_id, *self.features))
        parts: list[tuple[Column, Column, Column]] = []
        starts = iter(self.slots.starts)
        for f in self.categorical:
            index = F.col(f"{f}__index")
            parts.append((index.isNotNull(), index + next(starts), F.lit(1.0)))
        for name in [*(f"{f}__num" for f in self.numeric), *(f"{f}__gap" for f in self.flagged)]:
            parts.append((F.col(name) != 0, F.lit(next(starts)).cast("long"), F.col(name)))
        found = F.array_compact(
            F.array(*[F.when(there, F.struct(at.cast("long").alias("position"), value.alias("value"))) for there, at, value in parts])
        )
        return coded.select(row_id, F.explode(found).alias("e")).select(row_id, "e.position", "e.value")

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds the sparse feature vector and keeps the columns of ``df``. An unseen level is all zeros."""
        return self.assembled(self.coded(df), df.columns)

    def assembled(self, ready: DataFrame, kept: Sequence[str]) -> DataFrame:
        """The vector of rows that are ``coded`` already, beside their ``kept`` columns."""
        unseen = {f"{f}__index": F.coalesce(F.col(f"{f}__index"), F.lit(self.sizes[f])).cast("double") for f in self.categorical}
        originals = {f"{f}__code": F.col(f"{f}__index") for f in self.categorical}
        renamed = [F.col(f"{c.removesuffix('__index')}__code" if c in unseen else c).alias(c) for c in kept]
        with_codes = ready.withColumns(originals).withColumns(unseen) if unseen else ready
        return _assembly(self).transform(with_codes).select(*renamed, self.output)


def _assembly(encoder: Encoder) -> PipelineModel:
    """Spark ML's one-hot and assembler for these sizes, from one row that holds every feature's largest index.

    The largest index stands for unseen levels; its slot is the last and is dropped.
    """
    spark, stages, inputs = encoder.levels.sparkSession if encoder.levels is not None else None, [], []
    if encoder.categorical:
        names = [f"{f}__index" for f in encoder.categorical]
        largest = spark.range(1).select(*[F.lit(float(encoder.sizes[f])).alias(n) for f, n in zip(encoder.categorical, names)])
        hot = [f"{f}__hot" for f in encoder.categorical]
        stages.append(OneHotEncoder(inputCols=names, outputCols=hot, dropLast=True).fit(largest))
        inputs += hot
    inputs += [f"{f}__num" for f in encoder.numeric] + [f"{f}__gap" for f in encoder.flagged]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=encoder.output))
    return PipelineModel(stages)


def level_columns(df: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Text levels; a missing value is the level ``nan``."""
    return df.withColumns({f"{f}__level": unpivot_text(df, f) for f in categorical}) if categorical else df


def level_table(source: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Distinct levels by feature with their place in text order, counted from 0 per feature.

    A range sort numbers them: the number inside a task, and before it the levels of the
    tasks ahead.
    """
    texts = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"{f}__level").alias("level")) for i, f in enumerate(categorical)])
    distinct = level_columns(source, categorical).select(F.explode(texts).alias("l")).select("l.*").distinct()
    number = F.monotonically_increasing_id()
    ordered = distinct.repartitionByRange("f", "level").sortWithinPartitions("f", "level")
    ordered = cut_lineage(ordered.select("f", "level", F.shiftright(number, 33).alias("part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), "levels")
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("f"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row per task
    placed = ordered.join(F.broadcast(before), "part").select("f", "level", (F.col("before") + F.col("i")).alias("at"))
    first = placed.groupBy("f").agg(F.min("at").alias("first"))  # one row per feature
    return cut_lineage(placed.join(F.broadcast(first), "f").select("f", "level", (F.col("at") - F.col("first")).alias("place")), "level-places")


def fit_encoder(
    train: DataFrame, features: Sequence[str], numeric: Sequence[str], levels_from: DataFrame | None = None
) -> Encoder:
    """Levels from ``train`` (or from ``levels_from``, e.g. train and test together).

    An unseen level encodes to all zeros. Missing numbers take the train mean, plus a 0/1
    slot where train misses any.
    """
    categorical = [f for f in features if f not in numeric]
    means, flagged = {}, []
    if numeric:
        stats = train.agg(
            *[F.avg(F.col(f).cast("double")).alias(f"m_{f}") for f in numeric],
            *[F.count_if(F.col(f).isNull()).alias(f"g_{f}") for f in numeric],
        ).first()
        means = {f: float(stats[f"m_{f}"] or 0.0) for f in numeric}
        flagged = [f for f in numeric if stats[f"g_{f}"]]
    levels, sizes = None, {f: 0 for f in categorical}
    if categorical:
        levels = level_table(train if levels_from is None else levels_from, categorical)
        for row in levels.groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per feature
            sizes[categorical[row["f"]]] = row["n"]
    slots = Slots([*((f, sizes[f]) for f in categorical), *((f, 1) for f in numeric), *((f, 1) for f in flagged)])
    return Encoder(tuple(features), tuple(numeric), tuple(flagged), means, levels, sizes, slots)


def encode_train_fit(train: DataFrame, features: Sequence[str], min_distinct: int = 30) -> Encoder:
    return fit_encoder(train, features, numeric_features(train, features, min_distinct))


def encode_union_fit(train: DataFrame, test: DataFrame, features: Sequence[str], min_distinct: int = 30) -> Encoder:
    """Kinds and levels from train and test together."""
    both = train.select(*features).unionByName(test.select(*features))
    return fit_encoder(train, features, numeric_features(both, features, min_distinct), both)


def encode_all_string(train: DataFrame, test: DataFrame, features: Sequence[str]) -> Encoder:
    """Every feature one-hot by its text."""
    both = train.select(*features).unionByName(test.select(*features))
    return fit_encoder(train, features, [], both)


def encode_object_only(train: DataFrame, test: DataFrame, features: Sequence[str]) -> Encoder:
    """One-hot for text columns only; every numeric column stays a number."""
    numeric = [f for f in features if isinstance(train.schema[f].dataType, T.NumericType)]
    both = train.select(*features).unionByName(test.select(*features))
    return fit_encoder(train, features, numeric, both)
