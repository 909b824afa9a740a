"""Centroid clustering with heap-ordered bounds: only vectors whose gap has expired are looked at again.

Vectors are integers, so distances, sums and centroids are exact. They lie in blocks
of ``BLOCK`` vectors, written once. A block's state holds one heap per cluster of the
gaps between each member's lower bound (to the second nearest centroid) and upper bound
(to its own). When centroids move, the gaps of a cluster shrink by at most its own move
plus the largest move of another one; that is added to the cluster's drift instead of
being taken from every gap, and a gap that enters later is offset by the drift so far.
A round pops the heads of the heaps that are not above the drift, compares just these
vectors with all centroids, and pushes them where they belong now. Sums of clusters
change by the vectors that moved. Vectors and states are bucketed by block, so a round
reads them side by side and shuffles only sums.

Kept are vectors of ``width`` components, none null or non-finite; others have no row.
Repeated rows are vectors of their own. A missing vec_id hashes as the empty text; rows
with equal hashes start in the order of their components. With fewer vectors than
clusters, each is a centroid. No kept vectors: no rows. A scaled component beyond
2^27 is an error, as distances would not fit a long. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bucketed, few_rows, stored

CLUSTERS = 40
ROUNDS = 5
WIDTH = 64
SCALE = 256
SEED = 2
LIMIT = 1 << 27  # of a scaled component: a squared distance over 64 of them stays below 2^63
EXACT = 1 << 22  # components up to this size give exact products in double precision
BLOCK = 4096
BLOCKS = 16  # a task looks at at once
BUCKET = 1 << 18  # vectors a bucket holds on average
SLACK = 1e-9  # share of a distance that rounding of its root is allowed

OUT = "vec_id long, cluster int, distance long"


def scaled(rows: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the kept rows; x: floor(scale * component), exact."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.filter(F.col("embedding").isNotNull() & (F.size("embedding") == width) & fine)

    def whole(x: Column) -> Column:
        value = F.floor(x.cast("double") * scale)
        return F.when(F.abs(value) <= LIMIT, value).otherwise(F.raise_error(F.lit("a scaled component is beyond 2^27")).cast("long"))

    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("x"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the smallest hashes of their ids, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [r.x for r in vectors.select(key.alias("key"), "x").orderBy("key", "x").limit(clusters).collect()]


def blocks(vectors: DataFrame, most: int = BLOCK) -> DataFrame:
    """(block, ids, x): up to ``most`` vectors a row, x as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low in range(0, batch.num_rows, most):
                part = batch.slice(low, most)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype("<i4")
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("vec_id"))
                yield pa.RecordBatch.from_arrays([pa.array([block]), ids, pa.array([x.tobytes()], pa.binary())], names=["block", "ids", "x"])
                block += 1

    return vectors.mapInArrow(run, "block long, ids array<long>, x binary")


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` and ``c``."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - y) ** 2).sum(1) for y in c], axis=1)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row (the smaller number of equals), and a safe gap between second nearest and nearest."""
    d = distances(x, c)
    best = d.argmin(1)
    if len(c) == 1:
        return best, np.full(len(x), np.inf)
    two = np.sqrt(np.partition(d, 1, axis=1)[:, :2])
    return best, two[:, 1] - two[:, 0] - SLACK * two.sum(1)


class State:
    """The heaps of one block: for each cluster (gap offset by drift, row), smallest first."""

    def __init__(self, heaps: list[list[tuple[float, int]]]):
        self.heaps = heaps

    @staticmethod
    def of(sizes: bytes, gaps: bytes, rows: bytes) -> State:
        pairs = list(zip(np.frombuffer(gaps, "<f8").tolist(), np.frombuffer(rows, "<i4").tolist()))
        ends = np.cumsum(np.frombuffer(sizes, "<i4")).tolist()
        return State([pairs[low:high] for low, high in zip([0, *ends], ends)])

    def packed(self) -> tuple[bytes, bytes, bytes]:
        pairs = [p for heap in self.heaps for p in heap]
        sizes = np.array([len(heap) for heap in self.heaps], "<i4")
        return sizes.tobytes(), np.array([g for g, _ in pairs], "<f8").tobytes(), np.array([r for _, r in pairs], "<i4").tobytes()

    def expired(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows popped from the heaps because their gap may have closed, and their clusters."""
        rows, old = [], []
        for j, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= drift[j]:
                rows.append(heappop(heap)[1])
                old.append(j)
        return np.array(rows, np.int64), np.array(old, np.int64)

    def push(self, rows: np.ndarray, clusters: np.ndarray, gaps: np.ndarray) -> None:
        for row, j, gap in zip(rows.tolist(), clusters.tolist(), gaps.tolist()):
            heappush(self.heaps[j], (gap, row))


def _sums(x: np.ndarray, clusters: np.ndarray, k: int) -> np.ndarray:
    """Per cluster the sums of components and, last, the number of rows."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    np.add.at(out, clusters, np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1))
    return out


STATE = "block long, sizes binary, gaps binary, rows binary, looked long, moved array<long>"


def _row(block: int, state: State, looked: int, moved: np.ndarray) -> pa.RecordBatch:
    sizes, gaps, rows = state.packed()
    columns = [pa.array([block]), *[pa.array([v], pa.binary()) for v in (sizes, gaps, rows)], pa.array([looked]), pa.array([moved.ravel().tolist()], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["block", "sizes", "gaps", "rows", "looked", "moved"])


def _each(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[dict, np.ndarray]]:
    for batch in batches:
        for row in batch.to_pylist():
            yield row, np.frombuffer(row["x"], "<i4").reshape(-1, width).astype(np.int64)


def _started(table: DataFrame, c: np.ndarray) -> DataFrame:
    """States after every vector has been compared with all centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, x in _each(batches, c.shape[1]):
            best, gaps = nearest(x, c)
            state = State([[] for _ in c])
            for i, (j, gap) in enumerate(zip(best.tolist(), gaps.tolist())):
                state.heaps[j].append((gap, i))
            for heap in state.heaps:
                heapify(heap)
            yield _row(row["block"], state, len(x), _sums(x, best, len(c)))

    return table.select("block", "x").mapInArrow(run, STATE)


def _again(joined: DataFrame, c: np.ndarray, drift: np.ndarray) -> DataFrame:
    """States after the expired vectors have been compared with all centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, x in _each(batches, c.shape[1]):
            state = State.of(row["sizes"], row["gaps"], row["rows"])
            rows, old = state.expired(drift)
            moved = np.zeros((len(c), c.shape[1] + 1), np.int64)
            if len(rows):
                best, gaps = nearest(x[rows], c)
                state.push(rows, best, gaps + drift[best])
                went = best != old
                moved = _sums(x[rows[went]], best[went], len(c)) - _sums(x[rows[went]], old[went], len(c))
            yield _row(row["block"], state, len(rows), moved)

    return joined.select("block", "x", "sizes", "gaps", "rows").mapInArrow(run, STATE)


def _told(joined: DataFrame, c: np.ndarray) -> DataFrame:
    """Every vector with its cluster and the exact distance to its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, x in _each(batches, c.shape[1]):
            cluster = np.zeros(len(x), np.int64)
            cluster[np.frombuffer(row["rows"], "<i4")] = np.repeat(np.arange(len(c)), np.frombuffer(row["sizes"], "<i4"))
            apart = x - c[cluster]
            columns = [pa.array(row["ids"], pa.int64()), pa.array(cluster, pa.int32()), pa.array((apart * apart).sum(1))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return joined.select("x", "ids", "sizes", "rows").mapInArrow(run, OUT)


def _moved(state: DataFrame, k: int, width: int) -> list[list[int]]:
    """Sums over all blocks of what changed in each cluster, exact; k * (width + 1) numbers."""
    cells = state.select(F.posexplode("moved").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v"))
    found = {r["at"]: int(r.v) for r in cells.collect()}
    return [[found.get(j * (width + 1) + i, 0) for i in range(width + 1)] for j in range(k)]


def cluster(
    rows: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    scale: int = SCALE,
    seed: int = SEED,
    block: int = BLOCK,
    looked: list | None = None,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    ``looked`` gets, for each assignment, how many vectors were compared with all centroids.
    """
    spark = rows.sparkSession
    vectors = scaled(rows, width, scale)
    start = first_centroids(vectors, clusters, seed)
    if not start:
        return spark.createDataFrame([], f"{OUT}, cluster_inertia long, inertia long, centroid_sha256 string")
    c = np.array(start, np.int64)
    k, packed = len(c), stored(blocks(vectors, block), "cluster-vectors")
    n = packed.agg(F.sum(F.size("ids"))).first()[0]
    with Bucketed(spark, "block", max(spark.sparkContext.defaultParallelism, -(-n // BUCKET))) as tables:
        table = tables.put(packed, "cluster-blocks")
        drift, sums = np.zeros(k), np.zeros((k, width + 1), object)
        state = tables.put(_started(table, c), "cluster-state", there=True, rows=BLOCKS)
        for turn in range(rounds + 1):
            if looked is not None:
                looked.append(state.agg(F.sum("looked")).first()[0])
            if turn == rounds:
                break
            sums = sums + np.array(_moved(state, k, width), object)
            new = np.array([[s // count for s in total] if count else old for (*total, count), old in zip(sums.tolist(), c.tolist())], np.int64)
            way = np.sqrt(((new - c).astype(float) ** 2).sum(1)) * (1 + SLACK)
            largest = np.sort(way)[::-1]
            others = np.where(np.arange(k) == way.argmax(), largest[min(1, k - 1)], largest[0]) if k > 1 else np.zeros(1)
            drift, c = drift + way + others, new
            state = tables.put(_again(table.join(state, "block"), c, drift), "cluster-state", there=True, rows=BLOCKS)
        with few_rows(spark, BLOCKS):
            told = stored(_told(table.join(state, "block"), c), "cluster-rows")
    inertia = told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()
    shas = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]
    facts = [(r.cluster, int(r.s), int(sum(x.s for x in inertia)), shas[r.cluster]) for r in inertia]  # one row per cluster
    return told.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> str:
    """The same in SQL: all vectors against all centroids in every round."""
    near = """SELECT v.row, arg_min(c.cluster, {dist} * {many} + c.cluster) AS cluster, min({dist}) AS distance
        FROM v CROSS JOIN c{i} AS c GROUP BY v.row"""
    dist = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"""v AS MATERIALIZED (
      SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
      FROM embeddings
      WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {width})""",
        f"""c0 AS MATERIALIZED (
      SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS cluster, x
      FROM (SELECT x, sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM v ORDER BY h, x LIMIT {clusters}))""",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(dist=dist, many=clusters, i=i)})")
        if i < rounds:
            steps.append(
                f"""m{i} AS (
      SELECT cluster, list(CAST(floor_of AS BIGINT) ORDER BY place) AS x
      FROM (SELECT cluster, place, (sum(value) - ((sum(value) % count(*)) + count(*)) % count(*)) / count(*) AS floor_of
            FROM (SELECT a.cluster, unnest(v.x) AS value, generate_subscripts(v.x, 1) AS place FROM v JOIN a{i} AS a USING (row))
            GROUP BY cluster, place)
      GROUP BY cluster),
    c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{i} AS c LEFT JOIN m{i} AS m USING (cluster))"""
            )
    return f"""
    WITH {", ".join(steps)}
    SELECT v.vec_id, a.cluster, CAST(a.distance AS BIGINT) AS distance,
           CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
           CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
           sha256(array_to_string(c.x, ',')) AS centroid_sha256
    FROM v JOIN a{rounds} AS a USING (row) JOIN c{rounds} AS c USING (cluster)
    """
