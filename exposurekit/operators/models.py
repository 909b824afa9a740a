"""Three Spark ML learners behind one scorer, and fits per feature group."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import round_to, threshold
from ..session import cut_lineage
from .encode import Encoder, encode_train_fit
from .metrics import accuracy, ap_aggregate, auc_aggregate, confusion, f1_macro, ranked_scores


@dataclass(frozen=True)
class Scorer:
    """A fitted model with its encoder: raw rows in, ``prob`` and ``hard`` out."""

    encoder: Encoder
    model: object

    def score_encoded(self, df: DataFrame) -> DataFrame:
        """Adds ``prob`` and ``hard`` to rows that carry the feature vector."""
        kept = [c for c in df.columns if c != self.encoder.output]
        scored = self.model.transform(df.select(*kept, self.encoder.output))
        prob = vector_to_array(F.col("probability"))[1]
        return scored.select(*kept, prob.alias("prob")).withColumn("hard", threshold(F.col("prob")))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.score_encoded(self.encoder.transform(df))


def tree_value(node, slot: Callable[[int], Column], leaf: Callable) -> Column:
    """A fitted tree as an expression over slot values; ``leaf`` gives the value of an end node."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(leaf(node)))
    split = node.split()
    left, right = (tree_value(child, slot, leaf) for child in (node.leftChild(), node.rightChild()))
    value = slot(split.featureIndex())
    if split.getClass().getSimpleName() == "CategoricalSplit":  # a 0/1 column
        goes_left = value.isin(*[float(x) for x in split.leftCategories()])
    else:
        goes_left = value <= F.lit(split.threshold())
    return F.when(goes_left, left).otherwise(right)


def _share_of_ones(node) -> float:
    counts = list(node.impurityStats().stats())
    return counts[1] / sum(counts)


def swapped_probability(model, slot: Callable[[int], Column], margin: Column, change: Column) -> Column:
    """Probability after one slot changed: ``slot`` gives slot values after it, ``margin`` the old log-odds, ``change`` their change."""
    if isinstance(model, LogisticRegressionModel):
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(margin + change)))
    if isinstance(model, DecisionTreeClassificationModel):
        return tree_value(model._java_obj.rootNode(), slot, _share_of_ones)
    if isinstance(model, GBTClassificationModel):
        trees = zip(model.trees, model.treeWeights)
        total = [F.lit(w) * tree_value(t._java_obj.rootNode(), slot, lambda node: node.prediction()) for t, w in trees]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * reduce(lambda a, b: a + b, total)))
    raise TypeError(f"no expression for {type(model).__name__}")


@dataclass(frozen=True)
class StatedInputs:
    """What a scorer without a fitted encoder looks at."""

    features: tuple[str, ...]
    numeric: tuple[str, ...]


@dataclass(frozen=True)
class StatedScorer:
    """A stated linear rule behind the same interface: weights of numbers and of levels, cut off to 0..1.

    A missing number counts as 0. Probabilities have 6 digits.
    """

    encoder: StatedInputs
    base: float
    numbers: Mapping[str, float]
    levels: Mapping[tuple[str, str], float]

    def probability(self, df: DataFrame, neutral: Mapping[str, Column] | None = None) -> Column:
        """Of class 1; ``neutral``: texts that stand for the values of some features."""
        value = lambda f: (neutral or {}).get(f, F.col(f))
        total = F.lit(float(self.base))
        for f, weight in self.numbers.items():
            total = total + F.lit(float(weight)) * F.coalesce(value(f).cast("double"), F.lit(0.0))
        for (f, level), weight in self.levels.items():
            total = total + F.when(value(f).cast("string") == level, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 6)

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prob", self.probability(df)).withColumn("hard", threshold(F.col("prob")))


def training_set(encoder: Encoder, train: DataFrame, label: str) -> DataFrame:
    """Encoded rows on disk in the shared folder: every pass of a fit reads them from there."""
    encoded = encoder.transform(train).select(encoder.output, F.col(label).cast("double").alias("label"))
    return cut_lineage(encoded, "encoded")


def fit_logreg(encoder: Encoder, encoded: DataFrame, max_iter: int = 2000, tol: float = 1e-4) -> Scorer:
    """L2-penalised logistic regression with unit total penalty, on unscaled columns."""
    n = max(encoded.count(), 1)
    learner = LogisticRegression(
        maxIter=max_iter, tol=tol, regParam=1.0 / n, elasticNetParam=0.0, standardization=False
    )
    return Scorer(encoder, learner.fit(encoded))


EARLY_STOP_ROWS = 10_000


def fit_gbt(
    encoder: Encoder,
    encoded: DataFrame,
    seed: int = 42,
    rounds: int = 100,
    bins: int = 255,
    early_stop_rows: int = EARLY_STOP_ROWS,
    validation_share: float = 0.1,
    tol: float = 1e-3,
) -> Scorer:
    """Boosted trees. From ``early_stop_rows`` rows on a seeded share of them validates and stops the rounds."""
    learner = GBTClassifier(maxIter=rounds, stepSize=0.1, seed=seed, maxBins=bins, validationTol=tol)
    if encoded.count() >= early_stop_rows:
        share = F.pmod(F.xxhash64(F.lit(seed), encoder.output, "label"), F.lit(10_000))
        encoded = encoded.withColumn("_held", share < F.lit(int(10_000 * validation_share)))
        learner = learner.setValidationIndicatorCol("_held")
    return Scorer(encoder, learner.fit(encoded))


def fit_sparse_tree(encoder: Encoder, encoded: DataFrame, depth: int = 6, seed: int = 42) -> Scorer:
    return Scorer(encoder, DecisionTreeClassifier(maxDepth=depth, seed=seed).fit(encoded))


LEARNERS: dict[str, Callable[[Encoder, DataFrame], Scorer]] = {"GBT": fit_gbt, "LogReg": fit_logreg}


def evaluate(scored: DataFrame, y: str) -> DataFrame:
    """``metric, value`` rows: acc, f1, auc, ap, to 4 digits."""
    cells = confusion(scored, y).select(accuracy().alias("acc"), f1_macro().alias("f1"))
    ranks = ranked_scores(scored, y, "prob", []).agg(auc_aggregate().alias("auc"), ap_aggregate().alias("ap"))

    def long(df: DataFrame) -> DataFrame:
        return df.unpivot([], df.columns, "metric", "value")

    both = long(cells).unionByName(long(ranks))
    return both.select("metric", round_to(F.col("value"), 4).alias("value"))


def by_train(train: DataFrame, test: DataFrame, features: Sequence[str]) -> Encoder:
    """The encoding whose kinds and levels come from ``train`` alone."""
    return encode_train_fit(train, features)


def in_turn(spark: SparkSession, work: Callable, jobs: Sequence, parallelism: int = 1) -> list:
    """``work`` of every job, in order; up to ``parallelism`` of them at a time, in threads with the caller's Spark properties."""
    if parallelism <= 1:
        return [work(job) for job in jobs]
    wrap = inheritable_thread_target(spark)
    # where threads are not pinned (PYSPARK_PIN_THREAD=false) there is nothing to inherit, and the session itself comes back
    target = work if wrap is spark else wrap(work)
    with ThreadPool(parallelism) as pool:
        return pool.map(target, jobs, chunksize=1)


def group_ablation(
    train: DataFrame,
    test: DataFrame,
    groups: Mapping[str, Sequence[str]],
    label: str = "clicked",
    learners: Mapping[str, Callable[[Encoder, DataFrame], Scorer]] = LEARNERS,
    parallelism: int = 1,
    encoding: Callable[[DataFrame, DataFrame, Sequence[str]], Encoder] = by_train,
) -> DataFrame:
    """``group, model, metric, value`` for every feature group and learner.

    ``encoding`` makes an encoder of (train, test, features), for example ``encode_union_fit``.
    All groups' features are encoded once, train and test written once each; a group is
    a choice of vector positions of these tables, the ranges of its features.

    Fits run one after the other: each of their passes is a job over all rows, and only one
    fit's rows are cached. Up to ``parallelism`` of them run at a time where that is more;
    the results are the same. The scores of a fit are written when it ends, so the table
    that is returned reads a few rows and the driver keeps no plan per fit.
    """
    every = list(dict.fromkeys(f for features in groups.values() for f in features))
    encoder = encoding(train, test, every)
    rows = [
        cut_lineage(encoder.transform(df).select(F.col(encoder.output).alias("_all"), F.col(label).cast(kind).alias(name)), stage)
        for df, kind, name, stage in ((train, "double", "label", "encoded"), (test, test.schema[label].dataType, "y", "encoded-test"))
    ]

    def chosen(group: str) -> list[DataFrame]:
        wanted = set(groups[group])
        slicer = VectorSlicer(inputCol="_all", outputCol=encoder.output, indices=[i for i, f in enumerate(encoder.slots) if f in wanted])
        return [slicer.transform(df).drop("_all") for df in rows]

    def score(job: tuple[str, str]) -> DataFrame:
        group, name = job
        encoded, tested = chosen(group)
        scorer = learners[name](encoder, encoded)
        # predictions are written once; each metric reads two columns of them
        scored = cut_lineage(scorer.score_encoded(tested).select("y", "prob", "hard"), "scored")
        found = evaluate(scored, "y").select(F.lit(group).alias("group"), F.lit(name).alias("model"), "metric", "value")
        return cut_lineage(found, "fit-scores")

    jobs = [(group, name) for group in groups for name in learners]
    return reduce(DataFrame.unionByName, in_turn(train.sparkSession, score, jobs, parallelism))
