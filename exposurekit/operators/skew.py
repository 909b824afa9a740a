"""Joins and numbering that survive one key, or one group of copies, holding a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordinal import with_group


ROWS_PER_TASK = 1_000_000
HOT_SHARE = 1e-6  # bounds the list of hot keys; at 10^12 rows still one task's rows


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK, share: float = HOT_SHARE) -> DataFrame:
    """Keys too frequent for one task, with the number of tasks to spread each over.

    Hot means more than ``rows_per_task`` rows and more than ``share`` of all rows, so
    there are fewer than 1/share hot keys. Missing keys count as a key.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("n")).scalar()  # reads the same shuffle again, not the rows
    hot = (F.col("_n") > rows_per_task) & (F.col("_n") > total * F.lit(share))
    return counts.filter(hot).select(*keys, F.ceil(F.col("_n") / F.lit(rows_per_task)).cast("int").alias("_tasks"))


def any_hot(df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK, share: float = HOT_SHARE) -> dict[str, bool]:
    """Whether each of the single ``keys`` columns has a hot value: one pass over ``df`` for all of them."""
    pairs = F.array(*[F.struct(F.lit(i).alias("k"), F.xxhash64(c).alias("h")) for i, c in enumerate(keys)])
    counts = df.select(F.explode(pairs).alias("p")).groupBy("p.k", "p.h").agg(F.count(F.lit(1)).alias("n"))
    # values of one hash count together, so none that is hot is missed
    found = {r["k"]: (r["most"], r["n"]) for r in counts.groupBy("k").agg(F.max("n").alias("most"), F.sum("n").alias("n")).collect()}
    most = {c: found.get(i, (0, 0)) for i, c in enumerate(keys)}
    return {c: top > rows_per_task and top > n * share for c, (top, n) in most.items()}


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    hot_from: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    share: float = HOT_SHARE,
    rows: int | None = None,
) -> DataFrame:
    """Left join to a lookup table with unique ``on`` keys; rows of hot keys are spread.

    A hot key is split into as many sub-keys as its rows need tasks, by a hash of the
    ``spread`` columns (the row's identity, so a recomputed task places a row where it
    was). Only the lookup rows of hot keys are repeated, once per sub-key. All other
    keys join as usual, and Spark still broadcasts a lookup it measures as small.
    ``hot_from`` is a cheaper frame with the same keys as ``left`` (before earlier
    lookups), so that finding hot keys does not repeat those joins. ``rows``, where it is
    known: no key of a left side that one task can hold is hot, so nothing is looked for.
    """
    on = list(on)
    if rows is not None and rows <= rows_per_task:
        return left.join(right, on, "left")
    hot = hot_keys(left if hot_from is None else hot_from, on, rows_per_task, share)
    hot = hot.select(F.struct(*on).alias("_g"), "_tasks")
    tasks = F.coalesce(F.col("_tasks"), F.lit(1))
    sub_key = F.when(tasks > 1, F.pmod(F.xxhash64(*spread), tasks).cast("int")).otherwise(F.lit(0))

    def marked(df: DataFrame) -> DataFrame:
        return with_group(df, on)[0].join(F.broadcast(hot), "_g", "left").drop("_g")  # fewer than 1/share rows

    rows = marked(left).withColumn("_sub", sub_key).drop("_tasks")
    repeated = marked(right).withColumn("_sub", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("_tasks")
    return rows.join(repeated, [*on, "_sub"], "left").drop("_sub")


CHUNK = 65_536


def repeat_rows(df: DataFrame, times: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """Every row as often as its ``times`` column says, numbered from 0 in ``name``; ``times`` is dropped.

    Rows to repeat more than ``chunk`` times are split into chunks first, which are
    spread over the cluster.
    """
    zero, step = F.lit(0).cast("long"), F.lit(chunk).cast("long")
    n = F.col(times).cast("long")
    few = df.filter((n > 0) & (n <= chunk)).withColumn(name, F.explode(F.sequence(zero, n - 1)))
    many = (
        df.filter(n > chunk)
        .withColumn("_first", F.explode(F.sequence(zero, n - 1, step)))
        .repartition("_first", *[c for c in df.columns if c != times])
        .withColumn(name, F.explode(F.sequence(F.col("_first"), F.least(F.col("_first") + step, n) - 1)))
        .drop("_first")
    )
    return few.unionByName(many).drop(times)


def number_copies(df: DataFrame, name: str = "copy", chunk: int = CHUNK) -> DataFrame:
    """Number identical rows 0, 1, 2, ... without sorting a group of copies in one task.

    Copies are counted (partial counts combine map-side) and written out again from
    the count.
    """
    return repeat_rows(df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")), "_n", name, chunk)
