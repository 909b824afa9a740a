import hashlib
import math

import numpy as np
import pytest

import oracle
from exposurekit.llm import centroids
from exposurekit.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>, cluster string, block int"


def plain(rows, clusters, rounds, width, scale, seed=2):
    """Lloyd's rounds over all vectors in Python's own integers."""
    kept = [r for r in rows if r[1] is not None and len(r[1]) == width and all(x is not None and math.isfinite(x) for x in r[1])]
    xs = [[math.floor(scale * float(np.float32(x))) for x in r[1]] for r in kept]
    sha = lambda i: hashlib.sha256(f"{seed}:{'' if kept[i][0] is None else kept[i][0]}".encode()).hexdigest()
    c = [xs[i] for i in sorted(range(len(xs)), key=lambda i: (sha(i), xs[i]))[:clusters]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for turn in range(rounds + 1):
        own = [min(range(len(c)), key=lambda j: (far(x, c[j]), j)) for x in xs]
        if turn < rounds:
            members = [[x for x, o in zip(xs, own) if o == j] for j in range(len(c))]
            c = [[sum(v) // len(m) for v in zip(*m)] if m else old for m, old in zip(members, c)]
    d = [far(x, c[o]) for x, o in zip(xs, own)]
    names = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    inertia = [sum(y for y, o in zip(d, own) if o == j) for j in range(len(c))]
    return [(r[0], o, y, inertia[o], sum(d), names[o]) for r, o, y in zip(kept, own, d)]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, *map(str, r)))


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "c", 0) for r in rows], SCHEMA).repartition(parts)


def crowd(rng, n, width, spread):
    at = rng.normal(size=(6, width))
    return [(i, [float(x) for x in at[i % 6] * 3 + rng.normal(size=width) * spread]) for i in range(n)]


@pytest.mark.parametrize("block, clusters, rounds", [(7, 9, 5), (4096, 1, 1), (64, 500, 2)])
def test_rounds_equal_plain_ones(spark, block, clusters, rounds):
    rng = np.random.default_rng(5)
    rows = crowd(rng, 150, 5, 0.4)
    rows += [(200, rows[0][1]), (201, rows[0][1]), (201, rows[0][1]), (None, rows[3][1]), (None, rows[4][1])]
    rows += [(300, None), (301, []), (302, [1.0] * 4), (303, [float("nan")] + [0.0] * 4), (304, [None] + [0.0] * 4), (305, [float("inf")] * 5)]
    rows += [(400 + i, [0.0] * 5) for i in range(30)]  # one group of equal vectors
    got = centroids.cluster(frame(spark, rows), clusters, rounds, width=5, block=block).collect()
    assert order(got) == order(plain(rows, clusters, rounds, 5, 256))


def test_few_gaps_expire_when_centroids_hardly_move(spark):
    rows = crowd(np.random.default_rng(6), 600, 8, 0.02)
    looked = []
    got = centroids.cluster(frame(spark, rows), 6, 4, width=8, looked=looked).collect()
    assert order(got) == order(plain(rows, 6, 4, 8, 256))
    assert looked[0] == 600 and looked[-1] < 200


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [x, 0.0]) for i, x in enumerate([0.0, 2.0, 1.0, 1.0, 3.0, 1.0, 2.0, 0.0])]
    for clusters in (2, 3, 5):
        got = centroids.cluster(frame(spark, rows, 1), clusters, 3, width=2, scale=1).collect()
        assert order(got) == order(plain(rows, clusters, 3, 2, 1))


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 2e5]) for i in range(60)]
    got = centroids.cluster(frame(spark, rows), 5, 3, width=4).collect()
    assert order(got) == order(plain(rows, 5, 3, 4, 256))
    with pytest.raises(Exception, match="2\\^27"):
        centroids.cluster(frame(spark, [(1, [1e30] * 4)]), 2, 1, width=4).collect()


def test_no_vectors(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        got = centroids.cluster(frame(spark, rows), 3, 2, width=4)
        assert got.collect() == [] and got.columns[-1] == "centroid_sha256"


def test_heaps_hold_their_order_when_packed():
    state = centroids.State([[], [(0.5, 3), (1.0, 1), (0.7, 2)], [(2.0, 0)]])
    again = centroids.State.of(*state.packed())
    assert again.heaps == state.heaps
    rows, old = again.expired(np.array([9.0, 0.7, 1.0]))
    assert sorted(rows.tolist()) == [2, 3] and old.tolist() == [1, 1]
    assert again.heaps == [[], [(1.0, 1)], [(2.0, 0)]]


def test_registered_clusters_equal_sql(spark, small):
    name = "op11_centroid_clusters"
    assert oracle.compare(QUERIES[name](spark, small), oracle.connect(small), ORACLES[name]) == []
