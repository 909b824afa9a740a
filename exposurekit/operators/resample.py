"""Bootstrap errors from counts of joint outcomes.

Accuracy, F1, deletion drop and stability see a resample only through how many rows
fall into each joint outcome cell. Resampling n rows is therefore one multinomial draw
over the cells: the cluster counts cells once, and each replicate draws over them.

Cells are dealt to chunks. A replicate first draws how many rows fall into each chunk,
alike in every task, and then, chunk by chunk, into its cells; what a statistic needs of
them are sums, which add up over chunks. So there may be any number of outcome columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .metrics import accuracy, f1_macro

CELLS_PER_CHUNK = 20_000


def joint_cells(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per combination of the 0/1 ``columns``; a column ``n`` says how many a row stands for."""
    n = F.sum("n") if "n" in rows.columns and "n" not in columns else F.count(F.lit(1))
    return rows.groupBy(*[F.col(c).cast("int").alias(c) for c in columns]).agg(n.alias("n"))


def replicates(cells: DataFrame, columns: Sequence[str], draws: int, tasks: int | None, per_chunk: int = CELLS_PER_CHUNK) -> DataFrame:
    """One row per chunk of cells and range of replicates: the chunk's ordered cells and the rows in every chunk."""
    spark = cells.sparkSession
    cells = cut_lineage(cells, "cells")
    chunks = max(1, -(-cells.count() // per_chunk))
    ranges = min(draws, max(1, -(-(tasks or spark.sparkContext.defaultParallelism) // chunks)))
    chunk = F.pmod(F.xxhash64(*columns), F.lit(chunks)).cast("int").alias("chunk")
    grouped = cells.groupBy(chunk).agg(F.array_sort(F.collect_list(F.struct(*columns, "n"))).alias("cells"), F.sum("n").alias("total"))
    grouped = cut_lineage(grouped, "cell-chunks")
    totals = grouped.agg(F.array_sort(F.collect_list(F.struct("chunk", "total"))).alias("totals")).scalar()  # a pair per chunk
    part = F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)))
    spread = grouped.select("chunk", "cells", part.alias("part")).repartition(chunks * ranges, "chunk", "part")
    first = F.floor(F.col("part") * draws / ranges)
    last = F.floor((F.col("part") + 1) * draws / ranges)
    return spread.select("chunk", "cells", first.alias("first"), last.alias("last"), totals.alias("totals"))


SUMS = "draw long, name string, key string, value double"


def resampling_task(columns: Sequence[str], seed: int, statistics: Callable) -> Callable:
    """The step that runs on executors: draw each replicate's cell counts, emit the sums of its statistics.

    Everything it calls is nested in it, so it travels as a whole and executors need
    only numpy and pandas. Each replicate and chunk has its own seed sequence.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for chunk, cells, first, last, totals in zip(*(batch[c] for c in ("chunk", "cells", "first", "last", "totals"))):
                matrix = np.array([[c[k] for k in columns] for c in cells], dtype=np.int64).reshape(-1, len(columns))
                counts = np.array([c["n"] for c in cells], dtype=np.int64)
                every = np.array([t["total"] for t in totals], dtype=np.int64)
                place = [t["chunk"] for t in totals].index(chunk)
                for b in range(first, last):
                    share = int(every[0])
                    if len(every) > 1:
                        share = int(np.random.default_rng([seed, b]).multinomial(every.sum(), every / every.sum())[place])
                    drawn = np.random.default_rng([seed, b, int(chunk)]).multinomial(share, counts / counts.sum())
                    out += [(b, *row) for row in statistics(matrix, drawn)]
            yield pd.DataFrame(out, columns=["draw", "name", "key", "value"])

    return task


def summarize(
    rows: DataFrame,
    columns: Sequence[str],
    draws: int,
    tasks: int | None,
    task: Callable,
    name: str,
    keys: Sequence[str],
    metrics: Mapping[str, Column],
    per_chunk: int,
) -> DataFrame:
    """Mean and population deviation over the replicates of ``metrics``, expressions over the summed ``keys``."""
    drawn = replicates(joint_cells(rows, columns), columns, draws, tasks, per_chunk).mapInPandas(task, SUMS)
    sums = drawn.groupBy("draw", F.col("name").alias(name)).agg(*[F.sum(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])
    each = sums.select("draw", name, *[c.alias(m) for m, c in metrics.items()]).unpivot(["draw", name], list(metrics), "metric", "value")
    return each.groupBy(name, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


def bootstrap_scores(
    preds: DataFrame,
    scorers: Sequence[str],
    draws: int = 2000,
    seed: int = 42,
    y: str = "y",
    tasks: int | None = None,
    per_chunk: int = CELLS_PER_CHUNK,
) -> DataFrame:
    """``scorer, metric, mean, sd`` of accuracy and macro-F1; all scorers share every draw.

    ``scorers`` are 0/1 columns beside the label.
    """
    columns = [y, *scorers]

    def statistics(m: np.ndarray, w: np.ndarray) -> list[tuple]:
        out = []
        for j, scorer in enumerate(columns[1:], start=1):
            for key, truth, hard in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0)):
                out.append((scorer, key, float(w[(m[:, 0] == truth) & (m[:, j] == hard)].sum())))
        return out

    found = {"acc": accuracy(), "f1_macro": f1_macro()}
    task = resampling_task(columns, seed, statistics)
    return summarize(preds, columns, draws, tasks, task, "scorer", ("tp", "tn", "fp", "fn"), found, per_chunk)


def bootstrap_explanations(
    vectors: DataFrame,
    base: str,
    methods: Mapping[str, tuple[str, str]],
    draws: int = 2000,
    seed: int = 42,
    tasks: int | None = None,
    per_chunk: int = CELLS_PER_CHUNK,
) -> DataFrame:
    """``method, metric, mean, sd`` of deletion drop and stability on shared draws.

    ``base`` is the 0/1 column "base prediction correct"; ``methods`` maps a name to its
    0/1 columns (correct after deletion, prediction unchanged after perturbation).
    """
    columns = [base, *[c for pair in methods.values() for c in pair]]
    names = list(methods)

    def statistics(m: np.ndarray, w: np.ndarray) -> list[tuple]:
        sums, n = (w[:, None] * m).sum(axis=0), float(w.sum())
        out = []
        for i, name in enumerate(names):
            out.append((name, "lost", float(sums[0] - sums[1 + 2 * i])))
            out.append((name, "same", float(sums[2 + 2 * i])))
            out.append((name, "n", n))
        return out

    found = {"drop": F.col("lost") / F.col("n"), "stability": F.col("same") / F.col("n")}
    task = resampling_task(columns, seed, statistics)
    return summarize(vectors, columns, draws, tasks, task, "method", ("lost", "same", "n"), found, per_chunk)
