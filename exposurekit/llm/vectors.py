"""Near-duplicate embeddings by NN-descent: cosine at least ``threshold`` among vectors with equal labels.

Equal vectors with equal labels are one node with a count. A first neighbour graph
comes from blocks of nodes on the same side of random planes. Each round joins
neighbours of neighbours: all nodes near a node are compared with each other, and
every node keeps its nearest ``NEAR``. Rounds stop when few lists change. An audit
compares a bounded set of nodes with all others; while too many of their links are
missing, more planes and rounds follow.

A list whose last entry still reaches the threshold is saturated: there may be more
links than it holds, and a link that no list holds has two saturated ends. So nodes
with saturated lists are searched again for nodes of other components only, which
joins components, until no link between such nodes is found. Lists of all members of
such a node's component are then enlarged to the component itself, compared in pairs
of blocks, of which only the numbers of links are kept; so no link inside it is
missed and no pair is written.

Vectors that are null, zero, or hold null or non-finite components link with nothing,
nor do vectors without a label or of other lengths. Repeated rows are rows of their
own, linked to their copies. A missing vec_id counts as no id. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .components import components

THRESHOLD = 0.98
NEAR = 12
TREES = 8
BLOCK = 128
ROUNDS = 4  # of NN-descent at most, after each set of planes
SETS = 3  # sets of planes at most
SETTLED = 0.002  # share of list entries that change in a round that is the last
AUDITED = 400  # nodes compared with all others
RECALL = 0.995
EDGE = "u long, v long, sim double"


def nodes_of(rows: DataFrame) -> DataFrame:
    """(node, kind, vec, least, n): distinct usable vectors, unit length as float64 bytes."""
    values = F.col("embedding").cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine & F.exists(values, lambda x: x != 0))
    grouped = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            out = []
            for v in vectors:
                x = np.array(v, float)
                x /= np.abs(x).max()  # neither overflow nor underflow in the norm
                out.append((x / np.linalg.norm(x)).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "vec"])

    schema = ", ".join(f"{c} {t}" for c, t in grouped.dtypes) + ", vec binary"
    kind = F.struct("label", F.size("embedding").alias("width"))
    return grouped.mapInArrow(unit, schema).withColumn("kind", kind).withColumn("node", F.monotonically_increasing_id())


def _matrix(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors)).reshape(len(vectors), -1)


def _best(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """For each list of members (node, root, vec, floor): every node's ``keep`` nearest of other roots above its floor."""
    for batch in batches:
        us, vs, sims = [], [], []
        for members in batch.column("members").to_pylist():
            if len(members) < 2:
                continue
            node, root = (np.array([m[c] for m in members]) for c in ("node", "root"))
            floor = np.array([m["floor"] for m in members])
            x = _matrix([m["vec"] for m in members])
            sim = x @ x.T
            sim[root[:, None] == root] = -2
            near = np.argpartition(-sim, min(keep, len(node) - 1) - 1, axis=1)[:, :keep]
            found = np.take_along_axis(sim, near, 1)
            row, column = np.nonzero(found > floor[:, None])
            us.append(node[row])
            vs.append(node[near[row, column]])
            sims.append(found[row, column])
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, sims)], names=["u", "v", "sim"])


def _by_planes(nodes: DataFrame, total: int, seed: int) -> DataFrame:
    """Candidate edges from blocks of nodes of one kind on the same side of random planes, for ``TREES`` sets of planes."""
    sizes = nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("size"))
    planes = max(1, int(np.ceil(np.log2(max(2, total / BLOCK)))))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vec").to_pylist()
            sides = np.zeros((len(vectors), TREES), np.int64)
            width = np.array([len(v) for v in vectors])
            for w in np.unique(width):
                mine = np.flatnonzero(width == w)
                normals = np.random.default_rng([seed, int(w)]).normal(size=(w // 8, TREES * planes))
                bits = (_matrix([vectors[i] for i in mine]) @ normals > 0).reshape(len(mine), TREES, planes)
                sides[mine] = bits @ (1 << np.arange(planes))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(list(sides))], names=["node", "sides"])

    sides = nodes.select("node", "vec").mapInArrow(signed, "node long, sides array<long>")
    # as many planes as make blocks of about half the limit on average
    wanted = F.greatest(F.lit(0), F.least(F.lit(planes), F.ceil(F.log2(F.col("size") * F.lit(2.0 / BLOCK))))).cast("int")
    keyed = (
        sides.join(nodes.select("node", "kind"), "node")
        .join(sizes, "kind")
        .select("node", "kind", wanted.alias("wanted"), F.posexplode("sides").alias("tree", "side"))
        .withColumn("side", F.pmod("side", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("wanted"))))
        .select("node", F.struct("kind", "tree", "side").alias("cell"))
    )
    keyed = stored(keyed, "vector-cells")
    crowd = keyed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    part = F.pmod(F.xxhash64(F.lit(seed), "cell.tree", "node"), F.col("blocks"))
    placed = keyed.join(crowd, "cell").select("node", "cell", part.alias("part")).join(nodes.select("node", "root", "vec"), "node")
    members = placed.groupBy("cell", "part").agg(F.collect_list(F.struct("node", "root", "vec", F.lit(-2.0).alias("floor"))).alias("members"))
    return members.select("members").mapInArrow(lambda it: _best(it, NEAR), EDGE)


def _nearest(edges: DataFrame) -> DataFrame:
    """Every node's ``NEAR`` nearest."""
    best = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= NEAR).drop("place")


def _descend(graph: DataFrame, nodes: DataFrame, seed: int, inner: DataFrame | None = None) -> DataFrame:
    """Candidate edges between nodes near the same node, above what their lists reach already.

    Neighbours in both directions, also on the lists of ``inner``; those of a node that
    many have on their lists are dealt to blocks at random, anew in every round.
    """
    lists = graph.select("u", "v") if inner is None else graph.select("u", "v").unionByName(inner.select("u", "v"))
    around = lists.select(F.col("u").alias("w"), F.col("v").alias("node")).unionByName(lists.select(F.col("v").alias("w"), F.col("u").alias("node")))
    around = stored(around.distinct(), "vector-around")
    crowd = around.groupBy("w").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    floors = graph.groupBy("u").agg(F.when(F.count(F.lit(1)) >= NEAR, F.min("sim")).otherwise(F.lit(-2.0)).alias("floor"))
    known = nodes.select("node", "root", "vec").join(floors.withColumnRenamed("u", "node"), "node", "left").fillna(-2.0, ["floor"])
    placed = around.join(crowd, "w").withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "w", "node"), F.col("blocks"))).join(known, "node")
    members = placed.groupBy("w", "part").agg(F.collect_list(F.struct("node", "root", "vec", "floor")).alias("members"))
    return members.select("members").mapInArrow(lambda it: _best(it, NEAR), EDGE)


def audit(graph: DataFrame, nodes: DataFrame, threshold: float, whole: DataFrame | None = None) -> float:
    """Share of all links of ``AUDITED`` nodes that the graph has, or that are inside a component of ``whole`` (node, root)."""
    inside = F.lit(None).cast("long").alias("root")
    known = nodes.select("node", "kind", "vec", inside) if whole is None else nodes.select("node", "kind", "vec").join(whole, "node", "left")
    asked = known.orderBy(F.xxhash64("node")).limit(AUDITED).collect()  # bounded
    if not asked:
        return 1.0
    of_kind = {k: [r for r in asked if r.kind == k] for k in {r.kind for r in asked}}
    shared = nodes.sparkSession.sparkContext.broadcast(
        {tuple(k): ([r.node for r in rs], [-1 if r.root is None else r.root for r in rs], _matrix([r.vec for r in rs])) for k, rs in of_kind.items()}
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = [(k["label"], k["width"]) for k in batch.column("kind").to_pylist()]
            node, vec = batch.column("node").to_numpy(), batch.column("vec").to_pylist()
            root = batch.column("root").fill_null(-2).to_numpy()
            for k in set(kind) & set(shared.value):
                mine = np.array([i for i, x in enumerate(kind) if x == k])
                ids, roots, x = shared.value[k]
                row, column = np.nonzero(x @ _matrix([vec[i] for i in mine]).T >= threshold)
                u, v = np.array(ids)[row], node[mine[column]]
                counted = np.array(roots)[row] == root[mine[column]]
                # links that are counted already are told by their number only
                at, n = np.unique(u[counted & (u != v)], return_counts=True)
                open_u, open_v = (z[~counted & (u != v)] for z in (u, v))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([at, open_u]), pa.int64()),
                        pa.array([None] * len(at) + open_v.tolist(), pa.int64()),
                        pa.array(np.concatenate([n, np.ones(len(open_u))]), pa.int64()),
                    ],
                    names=["u", "v", "n"],
                )

    true = known.mapInArrow(compare, "u long, v long, n long")
    found = graph.filter(F.col("sim") >= threshold).select("u", "v").distinct().withColumn("found", F.lit(True))
    hit = F.col("v").isNull() | F.col("found")
    row = true.join(found, ["u", "v"], "left").agg(F.sum("n").alias("true"), F.sum(F.when(hit, F.col("n"))).alias("found")).first()
    return 1.0 if not row["true"] else (row["found"] or 0) / row["true"]


def _links_in_blocks(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links) of all nodes of components, counting copies, by pairs of blocks. ``members``: root, node, n, vec."""
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)).alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    placed = members.join(sizes, "root").withColumn("mine", block)
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    groups = paired.groupBy("root", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high")).agg(
        F.collect_list(F.struct("node", "n", "vec", "mine")).alias("members")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_node, out_links = [], []
            for low, high, group in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "members"))):
                sides = [[m for m in group if m["mine"] == b] for b in (low, high)]
                if not sides[0] or not sides[1]:
                    continue
                node, n, x = zip(*[([m["node"] for m in s], np.array([m["n"] for m in s]), _matrix([m["vec"] for m in s])) for s in sides])
                linked = x[0] @ x[1].T >= threshold
                if low == high:
                    np.fill_diagonal(linked, False)
                out_node += node[0]
                out_links += (linked @ n[1]).tolist()
                if low != high:
                    out_node += node[1]
                    out_links += (n[0] @ linked).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out_node, pa.int64()), pa.array(out_links, pa.int64())], names=["node", "links"])

    counted = groups.select("low", "high", "members").mapInArrow(count, "node long, links long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def _search(nodes: DataFrame, total: int, seed: int, graph: DataFrame | None = None, inner: DataFrame | None = None) -> DataFrame:
    """Lists of nearest nodes of other roots (u, v, sim) after one set of planes more, and its rounds."""
    fresh = _by_planes(nodes, total, seed)
    graph = stored(_nearest(fresh if graph is None else graph.unionByName(fresh)), "vector-graph")
    for step in range(ROUNDS):
        found = stored(_descend(graph, nodes, 100 * seed + step, inner), "vector-found")
        changes = found.count()
        graph = stored(_nearest(graph.unionByName(found)), "vector-graph")
        if changes <= SETTLED * total * NEAR:
            break
    return graph


def _joined(graph: DataFrame, near: DataFrame, nodes: DataFrame, threshold: float, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links with those between components of nodes with full lists, (node, root) of linked nodes, and the roots of such components."""
    full = graph.filter(F.col("sim") >= threshold).groupBy("u").agg(F.count(F.lit(1)).alias("c"))
    full = stored(full.filter(F.col("c") >= NEAR).select(F.col("u").alias("node")), "vector-full")
    while True:
        found = components(near.select(F.col("u").alias("a"), F.col("v").alias("b")))
        placed = stored(found.withColumnRenamed("id", "node"), "vector-components")
        crowd = nodes.drop("root").join(full, "node").join(placed, "node")
        several = crowd.groupBy("kind").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("kind")
        crowd = stored(crowd.join(several, "kind"), "vector-crowd")
        total = crowd.count()
        across = _search(crowd, total, seed, inner=graph).filter(F.col("sim") >= threshold) if total else None
        if across is None or across.isEmpty():
            return near, placed, stored(placed.join(full, "node").select("root").distinct(), "vector-full")
        near = stored(near.unionByName(across).distinct(), "vector-links")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, seed: int = 42) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) of every row of ``rows`` (vec_id, embedding, label)."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    nodes = stored(nodes_of(rows).withColumn("root", F.col("node")), "vector-nodes")
    total, graph, near = nodes.count(), None, None
    for turn in range(SETS):
        graph = _search(nodes, total, seed + turn, graph)
        known = graph.filter(F.col("sim") >= threshold)
        near = stored(known if near is None else near.unionByName(known).distinct(), "vector-links")
        near, found, full = _joined(graph, near, nodes, threshold, seed + turn)
        recall = audit(near, nodes, threshold, found.join(full, "root").select("node", "root"))
        if recall >= RECALL:
            break
    placed = nodes.drop("root").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = stored(placed.select("node", "root", "least", "n"), "vector-components")
    first = placed.groupBy("root").agg(F.min("least").alias("component_id"))

    dense = placed.join(full, "root").select("root", "node", "n").join(nodes.select("node", "vec"), "node")
    sparse = near.select("u", "v").unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    sparse = sparse.join(placed.select(F.col("node").alias("v"), "n", "root"), "v").join(full, "root", "left_anti")
    links = _links_in_blocks(dense, threshold).unionByName(
        sparse.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    )
    per = placed.join(first, "root").join(links, "node", "left")
    per = per.select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    keyed = nodes.select("node", "label", "embedding").join(per, "node").drop("node")
    out = rows.join(keyed, ["label", "embedding"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
        F.lit(recall).alias("recall"),
    )
