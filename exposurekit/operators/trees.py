"""A classification tree as a table, fitted level by level with exact splits.

Rows are counted into cells (node, feature, value); from the cells' running sums come
all candidate splits of all nodes of a level at once. A level pass reads the training
rows once and shuffles counted cells only. A split is ``level`` (rows with that level of
a text feature go left) or ``limit`` (numbers up to the middle between two neighbouring
values go left; rows without a number go where the split is better, and may be split
from all numbers). The best split has the largest sum over both children of
(positives^2 + negatives^2) / rows, as Gini impurity asks; ties go to the first
feature, ``level`` before ``limit``, gaps right before gaps left, the smaller value.

The tree itself has at most 2^(depth + 1) rows and is the only thing the driver holds.
A missing text is the level ``nan``; an unseen level goes right.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import threshold
from ..session import cut_lineage
from .models import StatedInputs
from .ordinal import ValueBuckets, prefix_sums, with_ordinal
from .profile import unpivot_text


@dataclass(frozen=True)
class Node:
    """``feature`` and what follows are None in a leaf. Children of node i are 2i (left) and 2i + 1."""

    node: int
    n: int
    positives: int
    feature: str | None = None
    level: str | None = None
    limit: float | None = None
    gaps_left: bool | None = None
    gain: float | None = None

    @property
    def share(self) -> float:
        return self.positives / self.n if self.n else 0.5

    @property
    def column(self) -> str | None:
        """The encoded column the node tests: a level of a text feature, or a number."""
        return self.feature if self.feature is None or self.level is None else f"{self.feature}={self.level}"


TABLE = "node long, n long, positives long, feature string, level string, limit double, gaps_left boolean, gain double, share double"


def goes_left(df: DataFrame, node: Node, instead: Column | None = None) -> Column:
    """``instead``: a text that stands for the row's own value of the feature."""
    if node.level is not None:
        return (unpivot_text(df, node.feature) if instead is None else F.coalesce(instead, F.lit("nan"))) == node.level
    value = (F.col(node.feature) if instead is None else instead).cast("double")
    return F.when(value.isNull(), F.lit(node.gaps_left)).otherwise(value <= F.lit(node.limit))


def routed(nodes: dict[int, Node], end: Callable[[Node], Column], left: Callable[[Node], Column], at: int = 1) -> Column:
    """What ``end`` gives for the leaf a row comes to, as one expression."""
    node = nodes[at]
    if node.feature is None:
        return end(node)
    return F.when(left(node), routed(nodes, end, left, 2 * at)).otherwise(routed(nodes, end, left, 2 * at + 1))


@dataclass(frozen=True)
class TreeScorer:
    """A fitted tree: raw rows in, ``prob`` and ``hard`` out."""

    encoder: StatedInputs
    nodes: dict[int, Node]

    def probability(self, df: DataFrame, neutral: Mapping[str, Column] | None = None) -> Column:
        """Of class 1; ``neutral``: texts that stand for the values of some features."""
        neutral = neutral or {}
        return routed(self.nodes, lambda leaf: F.lit(leaf.share), lambda node: goes_left(df, node, neutral.get(node.feature)))

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prob", self.probability(df)).withColumn("hard", threshold(F.col("prob")))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(x.node, x.n, x.positives, x.feature, x.level, x.limit, x.gaps_left, x.gain, x.share) for _, x in sorted(self.nodes.items())]
        return spark.createDataFrame(rows, TABLE)

    def importances(self) -> dict[str, float]:
        """Impurity that a feature's splits take away, as a share of all; empty for a tree without splits."""
        gains: dict[str, float] = {}
        for _, x in sorted(self.nodes.items()):
            if x.feature is not None:
                gains[x.feature] = gains.get(x.feature, 0.0) + x.gain
        total = sum(gains.values())
        return {f: g / total for f, g in gains.items()} if total else {}

    def paths(self) -> Iterator[tuple[int, list[str]]]:
        """Each leaf and the encoded columns tested on the way to it: only these can change where its rows end."""
        for i, leaf in self.nodes.items():
            if leaf.feature is None:
                above = [self.nodes[i >> k] for k in range(1, i.bit_length())]
                yield i, sorted({x.column for x in above})


def cells_of(train: DataFrame, at: Column, features: Sequence[str], numeric: Sequence[str], label: str) -> DataFrame:
    """(node, f, level, value, n, pos): counted values of every feature in every node; ``f`` is the feature's index."""
    each = []
    for i, f in enumerate(features):
        level = F.lit(None).cast("string") if f in numeric else unpivot_text(train, f)
        value = F.col(f).cast("double") if f in numeric else F.lit(None).cast("double")
        each.append(F.struct(F.lit(i).alias("f"), level.alias("level"), value.alias("value")))
    long = train.select(at.alias("node"), F.col(label).alias("y"), F.explode(F.array(*each)).alias("c")).filter(F.col("node").isNotNull())
    return long.groupBy("node", "c.f", "c.level", "c.value").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("pos"))


def purity(n: Column, pos: Column) -> Column:
    """(positives^2 + negatives^2) / rows, in doubles."""
    n, pos = n.cast("double"), pos.cast("double")
    return (pos * pos + (n - pos) * (n - pos)) / n


def best_splits(cells: DataFrame, totals: DataFrame, numeric: Sequence[int], rows: int) -> DataFrame:
    """(node, f, level, value, gaps_left, left_n, left_pos, score, whole): one row per node that a split makes purer.

    ``totals``: (node, all_n, all_pos), a row per node. ``value`` is the largest number
    on the left; null where all numbers go left. ``rows``: how many cells there are.
    """
    whole = cells.join(F.broadcast(totals), "node")

    def scored(df: DataFrame, n: Column, pos: Column) -> DataFrame:
        there = df.withColumns({"left_n": n, "left_pos": pos}).filter((F.col("left_n") > 0) & (F.col("left_n") < F.col("all_n")))
        sides = purity(F.col("left_n"), F.col("left_pos")) + purity(F.col("all_n") - F.col("left_n"), F.col("all_pos") - F.col("left_pos"))
        there = there.withColumns({"score": sides, "whole": purity(F.col("all_n"), F.col("all_pos"))}).filter(F.col("score") > F.col("whole"))
        return there.select("node", "f", "level", "value", "gaps_left", "left_n", "left_pos", "score", "whole")

    found = scored(whole.filter(F.col("level").isNotNull()).withColumn("gaps_left", F.lit(None).cast("boolean")), F.col("n"), F.col("pos"))
    if numeric:
        numbers = cells.filter(F.col("value").isNotNull()).select("node", "f", "value", "n", "pos")
        running = prefix_sums(numbers, "value", ["n", "pos"], ["node", "f"], limits=ValueBuckets([], rows))
        gaps = cells.filter(F.col("f").isin(*numeric) & F.col("value").isNull()).select("node", "f", F.col("n").alias("gap_n"), F.col("pos").alias("gap_pos"))
        running = running.join(F.broadcast(gaps), ["node", "f"], "left").fillna(0, ["gap_n", "gap_pos"])  # at most a row per node and feature
        running = running.join(F.broadcast(totals), "node").withColumn("level", F.lit(None).cast("string"))
        last = F.col("n_cum") == F.col("n_all")
        right = running.withColumn("gaps_left", F.lit(False)).withColumn("value", F.when(~last, F.col("value")))
        left = running.filter((F.col("gap_n") > 0) & ~last).withColumn("gaps_left", F.lit(True))
        found = found.unionByName(scored(right, F.col("n_cum"), F.col("pos_cum")))
        found = found.unionByName(scored(left, F.col("n_cum") + F.col("gap_n"), F.col("pos_cum") + F.col("gap_pos")))
    gap_order, every = F.coalesce(F.col("gaps_left").cast("int"), F.lit(-1)), F.col("value").isNull()
    order = F.struct((-F.col("score")).alias("worse"), "f", gap_order.alias("g"), every.alias("every"), "value", "level")
    rest = F.struct("f", "level", "value", "gaps_left", "left_n", "left_pos", "score", "whole")
    return found.groupBy("node").agg(F.min_by(rest, order).alias("s")).select("node", "s.*")


def next_numbers(cells: DataFrame, limits: DataFrame) -> DataFrame:
    """(node, next): the smallest number above each node's limit (node, f, limit)."""
    above = cells.select("node", "f", "value").join(F.broadcast(limits), ["node", "f"]).filter(F.col("value") > F.col("limit"))
    return above.groupBy("node").agg(F.min("value").alias("next"))


def fit_tree(train: DataFrame, features: Sequence[str], numeric: Sequence[str], label: str = "clicked", depth: int = 6) -> TreeScorer:
    """``train`` should be stored: each of the ``depth`` levels reads it once."""
    features, kinds = list(features), [i for i, f in enumerate(features) if f in numeric]
    inputs, spark = StatedInputs(tuple(features), tuple(numeric)), train.sparkSession
    root = train.agg(F.count(label).alias("n"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("pos")).first()
    nodes = {1: Node(1, root["n"], root["pos"])}
    train = train.filter(F.col(label).isNotNull())
    for level in range(depth):
        open_ = {i for i, x in nodes.items() if i.bit_length() == level + 1 and 0 < x.positives < x.n}
        if not open_:
            break
        at = routed(nodes, lambda x: F.lit(x.node if x.node in open_ else None).cast("long"), lambda x: goes_left(train, x))
        cells = cut_lineage(cells_of(train, at, features, numeric, label), "tree-cells")
        totals = [(i, nodes[i].n, nodes[i].positives) for i in sorted(open_)]
        totals = spark.createDataFrame(totals, "node long, all_n long, all_pos long")
        best = best_splits(cells, totals, kinds, cells.count()).collect()  # at most a row per node
        limits = [(s["node"], s["f"], s["value"]) for s in best if s["value"] is not None]
        above = {}
        if limits:
            above = {r["node"]: r["next"] for r in next_numbers(cells, spark.createDataFrame(limits, "node long, f int, limit double")).collect()}
        for s in best:
            x, limit = nodes[s["node"]], None
            if s["level"] is None:
                limit = float("inf") if s["value"] is None else (s["value"] + above[x.node]) / 2
            nodes[x.node] = Node(x.node, x.n, x.positives, features[s["f"]], s["level"], limit, s["gaps_left"], s["score"] - s["whole"])
            nodes[2 * x.node] = Node(2 * x.node, s["left_n"], s["left_pos"])
            nodes[2 * x.node + 1] = Node(2 * x.node + 1, x.n - s["left_n"], x.positives - s["left_pos"])
    return TreeScorer(inputs, nodes)


def permutation_losses(
    scorer: TreeScorer, test: DataFrame, label: str = "clicked", row_id: str = "row_id", repeats: int = 5, seed: int = 42
) -> DataFrame:
    """``feature, column, lost, loss``: right answers, and share of them, lost when one encoded column is permuted.

    Only for the columns the tree tests; ``lost`` is summed over the repeats. Every repeat matches the rows' seeded order with another one. A row is scored again
    only for the columns on the path to its leaf, and only where it differs from its
    donor there: for any other column it ends in the same leaf. Rows move as their leaf
    and the few columns the tree tests.
    """
    tests = {x.column: x for _, x in sorted(scorer.nodes.items()) if x.feature is not None}
    place = {c: i for i, c in enumerate(tests)}

    def own(df: DataFrame) -> Column:
        """The row's value in each tested column: 0/1 for a level, the number for a number."""
        values = [(unpivot_text(df, x.feature) == x.level).cast("double") if x.level is not None else F.col(x.feature).cast("double") for x in tests.values()]
        return F.array(*values) if values else F.array().cast("array<double>")

    leaf = routed(scorer.nodes, lambda x: F.lit(x.node).cast("long"), lambda x: goes_left(test, x))
    base = cut_lineage(test.select(row_id, F.col(label).alias("_y"), leaf.alias("_leaf"), own(test).alias("_own")), "base")
    n = base.count()
    takers = with_ordinal(base, row_id, f"{seed}:rows", rows=n)
    donors = base.select(row_id, F.col("_own").alias("_donor"), F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    donors = donors.withColumn("_seed", F.concat_ws(":", F.lit(str(seed)), "repeat"))
    donors = with_ordinal(donors, row_id, F.col("_seed"), by=["repeat"], rows=n).select("ordinal", "_donor")
    hard = {i: F.lit(int(x.share >= 0.5)) for i, x in scorer.nodes.items() if x.feature is None}

    def by_leaf(give: Callable[[int], Column]) -> Column:
        out = F.lit(None)
        for i in hard:
            out = F.when(F.col("_leaf") == i, give(i)).otherwise(out)
        return out

    on_path = dict(scorer.paths())
    columns = by_leaf(lambda i: F.array(*[F.lit(place[c]) for c in on_path[i]]) if on_path[i] else F.array().cast("array<int>"))
    pairs = takers.join(donors, "ordinal").withColumn("_path", columns)
    differ = F.filter("_path", lambda c: ~F.get("_own", c).eqNullSafe(F.get("_donor", c)))
    changed = pairs.withColumn("_c", F.explode(differ))

    def left(x: Node) -> Column:
        i = place[x.column]
        value = F.when(F.col("_c") == i, F.get("_donor", F.lit(i))).otherwise(F.get("_own", F.lit(i)))
        if x.level is not None:
            return value == 1
        return F.when(value.isNull(), F.lit(x.gaps_left)).otherwise(value <= F.lit(x.limit))

    after = routed(scorer.nodes, lambda x: hard[x.node], left)
    lost = (by_leaf(lambda i: hard[i]) == F.col("_y")).cast("int") - (after == F.col("_y")).cast("int")
    sums = changed.groupBy("_c").agg(F.sum(lost).alias("_lost"))
    names = test.sparkSession.createDataFrame([(i, tests[c].feature, c) for c, i in place.items()], "_c int, feature string, column string")
    lost = F.coalesce(F.col("_lost"), F.lit(0)).cast("long")
    return names.join(sums, "_c", "left").select("feature", "column", lost.alias("lost"), (lost / F.lit(float(max(n, 1) * repeats))).alias("loss"))
