"""Trees as tables against a plain exact fit, and permutation losses against permuting whole columns."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from exposurekit.operators import ranking, trees

SCHEMA = "row_id long, a string, b string, x double, z double, clicked int"
FEATURES, NUMERIC = ["a", "b", "x", "z"], ["x", "z"]


def data(n=400, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b = str(rng.choice(list("pqr"))), None if rng.random() < 0.2 else str(rng.choice(["u", "v"]))
        x = None if rng.random() < 0.15 else float(np.round(rng.normal(), 1))
        z = float(rng.integers(0, 4))
        p = 0.1 + 0.5 * (a == "q") + 0.3 * (x is None) + 0.3 * (z > 2 and b is None)
        rows.append((i, a, b, x, z, int(rng.random() < p)))
    return rows


def plain_fit(rows, depth):
    """{node: (feature, level, limit, gaps_left) or share} with every split tried."""

    def purity(part):
        p = float(sum(r[5] for r in part))
        n = float(len(part))
        return (p * p + (n - p) * (n - p)) / n

    def splits(part):
        for f, name in enumerate(FEATURES):
            values = [r[1 + f] for r in part]
            if name not in NUMERIC:
                for level in sorted({"nan" if v is None else v for v in values}):
                    yield (f, -1, False, 0.0, level), [(("nan" if v is None else v) == level) for v in values]
                continue
            there = sorted({v for v in values if v is not None})
            for gaps in (0, 1):
                for v in there[:-1]:
                    yield (f, gaps, False, v, ""), [gaps == 1 if w is None else w <= v for w in values]
            yield (f, 0, True, math.inf, ""), [w is not None for w in values]

    tree = {}

    def grow(node, part):
        best = None
        if node.bit_length() <= depth and 0 < sum(r[5] for r in part) < len(part):
            for key, left in splits(part):
                a, b = [r for r, side in zip(part, left) if side], [r for r, side in zip(part, left) if not side]
                if a and b and (best is None or (-(purity(a) + purity(b)), key) < best[:2]):
                    best = (-(purity(a) + purity(b)), key, a, b)
        if best is None or -best[0] <= purity(part):
            tree[node] = sum(r[5] for r in part) / len(part)
            return
        f, gaps, all_, v, level = best[1]
        if FEATURES[f] in NUMERIC:
            above = [r[1 + f] for r in part if r[1 + f] is not None and r[1 + f] > v]
            tree[node] = (FEATURES[f], None, math.inf if all_ else (v + min(above)) / 2, gaps == 1)
        else:
            tree[node] = (FEATURES[f], level, None, None)
        grow(2 * node, best[2])
        grow(2 * node + 1, best[3])

    grow(1, rows)
    return tree


def left_of(split, row, swapped=None):
    f, level, limit, gaps = split
    value = row[1 + FEATURES.index(f)]
    if level is not None:
        own = ("nan" if value is None else value) == level
        return swapped[(f, level)] if swapped and (f, level) in swapped else own
    value = swapped[(f, None)] if swapped and (f, None) in swapped else value
    return gaps if value is None else value <= limit


def walk(tree, row, swapped=None):
    at = 1
    while isinstance(tree[at], tuple):
        at = 2 * at + (0 if left_of(tree[at], row, swapped) else 1)
    return tree[at]


@pytest.fixture(scope="module")
def rows():
    return data()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def scorer(frame):
    return trees.fit_tree(frame, FEATURES, NUMERIC, depth=4)


def test_tree_equals_a_plain_exact_fit(spark, rows, scorer):
    want = plain_fit(rows, 4)
    got = {r.node: r for r in scorer.table(spark).collect()}
    assert set(got) == set(want) and len(want) > 15
    for node, x in want.items():
        if isinstance(x, tuple):
            assert (got[node].feature, got[node].level, got[node].limit, got[node].gaps_left) == x
        else:
            assert got[node].feature is None and got[node].share == pytest.approx(x)


def test_predictions_follow_the_table(spark, rows, frame, scorer):
    want = plain_fit(rows, 4)
    other = [(1000, "new level", None, None, 7.5, 0), (1001, None, "v", 99.0, None, 1)]
    df = frame.unionByName(spark.createDataFrame(other, SCHEMA))
    got = {r.row_id: (r.prob, r.hard) for r in scorer.predict(df).collect()}
    for r in rows + other:
        p = walk(want, r)
        assert got[r[0]] == (pytest.approx(p), int(p >= 0.5))


def test_only_missing_separates(spark):
    rows = [(i, "p", "u", None if i % 3 == 0 else float(i % 7), 1.0, int(i % 3 == 0)) for i in range(90)]
    tree = trees.fit_tree(spark.createDataFrame(rows, SCHEMA), FEATURES, NUMERIC)
    assert (tree.nodes[1].feature, tree.nodes[1].limit, tree.nodes[1].gaps_left) == ("x", math.inf, False)
    assert set(tree.nodes) == {1, 2, 3} and (tree.nodes[2].share, tree.nodes[3].share) == (0.0, 1.0)


def test_importances_are_shares_of_impurity(scorer):
    found = scorer.importances()
    assert sum(found.values()) == pytest.approx(1.0) and max(found, key=found.get) == "a"
    inner = [x for x in scorer.nodes.values() if x.feature]
    gini = lambda x: x.n - (x.positives**2 + (x.n - x.positives) ** 2) / x.n
    for x in inner:
        children = [scorer.nodes[2 * x.node], scorer.nodes[2 * x.node + 1]]
        assert x.gain == pytest.approx(gini(x) - sum(map(gini, children)))


def test_permutation_losses_equal_permuting_whole_columns(rows, frame, scorer):
    want_tree, repeats, seed = plain_fit(rows, 4), 3, 9
    order = lambda s: sorted(rows, key=lambda r: hashlib.md5(f"{s}:{r[0]}".encode()).hexdigest())
    columns = sorted({x[:2] for x in want_tree.values() if isinstance(x, tuple)}, key=str)
    want = dict.fromkeys(columns, 0)
    for k in range(1, repeats + 1):
        for row, donor in zip(order(f"{seed}:rows"), order(f"{seed}:{k}")):
            before = int(walk(want_tree, row) >= 0.5) == row[5]
            for f, level in columns:
                value = donor[1 + FEATURES.index(f)]
                value = ("nan" if value is None else value) == level if level is not None else value
                want[f, level] += before - (int(walk(want_tree, row, {(f, level): value}) >= 0.5) == row[5])
    got = {r["column"]: r.loss for r in trees.permutation_losses(scorer, frame, repeats=repeats, seed=seed).collect()}
    assert got == {f if level is None else f"{f}={level}": pytest.approx(v / len(rows) / repeats) for (f, level), v in want.items()}


def test_rankings_of_a_tree(spark, frame, scorer):
    own = ranking.tree_importance_ranking(spark, scorer).collect()
    assert [r.feature for r in own][0] == "a" and {r.feature for r in own} == set(FEATURES)
    swapped = ranking.permutation_ranking(scorer, frame, repeats=2).collect()
    assert {r.feature for r in swapped} == set(FEATURES) and swapped[0].importance > 0


def test_trees_of_nothing_and_of_one_class(spark):
    empty = spark.createDataFrame([], SCHEMA)
    tree = trees.fit_tree(empty, FEATURES, NUMERIC)
    assert [x.share for x in tree.nodes.values()] == [0.5] and tree.importances() == {}
    same = spark.createDataFrame([(i, "p", None, None, 1.0, 1) for i in range(5)], SCHEMA)
    tree = trees.fit_tree(same, FEATURES, NUMERIC)
    assert len(tree.nodes) == 1 and tree.predict(same).agg(F.min("prob")).first()[0] == 1.0
    assert trees.permutation_losses(tree, same).collect() == []
