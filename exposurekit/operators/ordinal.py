"""Exact positions, cut points, running sums and quantiles without a one-task sort.

A global ``row_number()`` or running sum pulls every row into one task. Here rows
fall into many buckets that follow the sort order; bucket totals are a small table
whose own running sum gives each bucket its offset, and only rows of the same bucket
are sorted together. Hash buckets are even by construction, and as many as the number
of rows asks for. Value buckets take their limits from a quantile sketch, so mass in a
narrow range spreads out, and equal values are counted into one row before any sort.
Where that many rows are there that a bucket may hold more than a task should sort,
buckets are a tree: one that holds too many is cut again by its own quantiles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small, cut_lineage

ROWS_PER_HASH_BUCKET = 100_000
MAX_VALUE_BUCKETS = 4_096  # of one level
ROWS_PER_VALUE_BUCKET = 1_000  # until the maximum is reached
ROWS_PER_WINDOW = 1_000_000  # a value bucket with more rows is cut again
OFFSETS_AT_ONCE = 65_536  # running offsets of more buckets are summed in two steps, and join by shuffle


def text_key(columns: Sequence[str]) -> Column:
    """One text made of several columns, different for different rows.

    Every part says how long it is, so no text can pass for another split of the same
    characters; a missing value is ``~``, which is no length.
    """

    def part(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))

    return F.concat_ws("-", *[part(c) for c in columns])


def seeded_key(identity: Column, seed: int | str | Column) -> Column:
    """Portable pseudo-random sort key of a row: md5 of ``seed:identity``."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), F.coalesce(identity.cast("string"), F.lit("~"))))


def hash_digits(rows: int, rows_per_bucket: int = ROWS_PER_HASH_BUCKET) -> int:
    """Leading hex digits by which ``rows`` keys fall into buckets of about ``rows_per_bucket`` or fewer; at least one."""
    digits = 1
    while rows > rows_per_bucket * 16**digits:
        digits += 1
    return digits


def hash_bucket(key: Column, digits: int) -> Column:
    """Leading hex digits, which sort like the whole key.

    Never null, so a join on it adds no null check that would evaluate it again.
    """
    return F.coalesce(F.substring(key, 1, digits), F.lit("0" * digits))


def with_group(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Adds the ``by`` columns as one struct ``_g``, which is never null itself.

    Two missing groups are the same group, and equality on ``_g`` stays a plain one, so a
    join after a window or grouping on it needs no further shuffle.
    """
    return (df.withColumn("_g", F.struct(*by)), ["_g"]) if by else (df, [])


def running_offsets(totals: DataFrame, group: Sequence[str], values: Sequence[str], top: Column | None = None, descending: bool = False) -> DataFrame:
    """``totals`` (group, _bucket, values) with the sums ``_o_<v>`` of the buckets before each.

    ``top``, a prefix of the bucket, is given where buckets are many: sums run inside
    each prefix and over the prefixes, so that no window holds all buckets.
    """
    order = F.desc("_bucket") if descending else F.asc("_bucket")
    before = lambda v, w: F.sum(v).over(w) - F.col(v)
    if top is None:
        window = Window.partitionBy(*group).orderBy(order)
        return totals.withColumns({f"_o_{v}": before(v, window) for v in values})
    placed = totals.withColumn("_top", top)
    window = Window.partitionBy(*group, "_top").orderBy(order)
    tops = placed.groupBy(*group, "_top").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    above = Window.partitionBy(*group).orderBy(F.desc("_top") if descending else F.asc("_top"))
    tops = tops.select(*group, "_top", *[before(f"_s_{v}", above).alias(f"_u_{v}") for v in values])
    inside = placed.withColumns({f"_o_{v}": before(v, window) for v in values}).join(tops, [*group, "_top"])
    return inside.withColumns({f"_o_{v}": F.col(f"_o_{v}") + F.col(f"_u_{v}") for v in values}).drop("_top", *[f"_u_{v}" for v in values])


def bucket_spans(keyed: DataFrame, group: Sequence[str], digits: int) -> DataFrame:
    """Per group and bucket: positions [_start, _end). Partial counts combine map-side."""
    counts = keyed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    top = F.substring("_bucket", 1, (digits + 1) // 2) if 16**digits > OFFSETS_AT_ONCE else None
    placed = running_offsets(counts, group, ["_n"], top).withColumnRenamed("_o__n", "_start")
    return placed.withColumn("_end", F.col("_start") + F.col("_n")).drop("_n")


def with_ordinal(
    df: DataFrame,
    row_id: str,
    seed: int | str | Column,
    by: Sequence[str] = (),
    name: str = "ordinal",
    digits: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Zero-based position of each row in the seeded order, per ``by`` group.

    ``row_id`` must be unique within a group. The number of buckets follows the number
    of ``rows``, which are counted unless it is known. Offsets join on the partitioning
    and order the ranking already has; a few are broadcast.
    """
    if digits is None:
        digits = hash_digits(df.count() if rows is None else rows)
    keyed, group = with_group(df, by)
    keyed = keyed.withColumn("_key", seeded_key(F.col(row_id), seed)).withColumn("_bucket", hash_bucket(F.col("_key"), digits))
    spans = bucket_spans(keyed, group, digits).drop("_end")
    inside = Window.partitionBy(*group, "_bucket").orderBy("_key", row_id)
    ranked = keyed.withColumn("_rank", F.row_number().over(inside))
    few = not by and 16**digits <= OFFSETS_AT_ONCE
    placed = ranked.join(F.broadcast(spans) if few else spans, [*group, "_bucket"])
    return placed.select(*df.columns, (F.col("_start") + F.col("_rank") - 1).alias(name))


def cut_points(
    df: DataFrame,
    identity: Column,
    seed: int | str,
    positions: Sequence[int | Column],
    by: Sequence[str] = (),
    digits: int | None = None,
) -> DataFrame:
    """Sort keys found at given zero-based positions of the seeded order.

    Columns: ``by``, ``cut`` (index into ``positions``), ``position``, ``cut_key``
    and ``before`` (rows with a smaller key). A position past the end has no row.
    Only rows of the buckets that hold a position are sorted, copies of one row as a
    single counted row. Positions may be expressions over ``by``.
    """
    keyed, group = with_group(df.select(*by, seeded_key(identity, seed).alias("_key")), by)
    digits = hash_digits(df.count()) if digits is None else digits
    keyed = keyed.drop(*by).withColumn("_bucket", hash_bucket(F.col("_key"), digits))
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("cut"), (p if isinstance(p, Column) else F.lit(p)).cast("long").alias("position"))
            for i, p in enumerate(positions)
        ]
    )
    spans = bucket_spans(keyed, group, digits)
    hits = (
        (spans.select("*", "_g.*") if by else spans)
        .withColumn("_w", F.explode(wanted))
        .select(*group, "_bucket", "_start", "_end", "_w.cut", "_w.position")
        .filter((F.col("position") >= F.col("_start")) & (F.col("position") < F.col("_end")))
    )
    # one row per wanted position; many groups are counted before they may be broadcast
    hits = broadcast_if_small(hits.drop("_end"), "cuts") if by else F.broadcast(hits.drop("_end"))
    rows = keyed.join(hits, [*group, "_bucket"])
    counted = rows.groupBy(*group, "cut", "position", "_start", "_key").agg(F.count(F.lit(1)).alias("_n"))
    running = F.sum("_n").over(Window.partitionBy(*group, "cut").orderBy("_key"))
    return (
        counted.withColumn("_after", F.col("_start") + running)
        .withColumn("before", F.col("_after") - F.col("_n"))
        .filter((F.col("position") >= F.col("before")) & (F.col("position") < F.col("_after")))
        .select(*[F.col(f"_g.{c}").alias(c) for c in by], "cut", "position", F.col("_key").alias("cut_key"), "before")
    )


def constant_array(values: Sequence[float], kind: T.DataType) -> Column:
    """Numbers as one constant column; a thousand single literals would be slow to build."""
    suffix = "L" if isinstance(kind, T.IntegralType) else "D"
    return F.expr(f"array({', '.join(f'{x}{suffix}' for x in values)})").cast(T.ArrayType(kind))


@dataclass(frozen=True)
class ValueBuckets:
    """Ascending limits of the first level of buckets, and how many rows they were taken from."""

    limits: Sequence
    rows: int

    def may_hold(self) -> int:
        """More rows than a bucket holds, but for copies of one value: twice the even share covers the sketches' error."""
        return 2 * self.rows // (len(self.limits) + 1) + 1


def _shares(width: int) -> Column:
    return constant_array([i / width for i in range(1, width)], T.DoubleType())


def value_buckets(df: DataFrame, value: str, rows_per_bucket: int = ROWS_PER_VALUE_BUCKET, width: int = MAX_VALUE_BUCKETS) -> ValueBuckets:
    """Ascending values that split the rows of ``df`` about evenly into ``width`` buckets at most.

    Limits are found first and then fixed, so that every later pass puts a value into
    the same bucket. They only balance the work: results do not depend on them.
    Sketches are merged in two steps, the second over a bounded list of values.
    """
    shares, accuracy = _shares(width), 4 * width
    present = df.select(F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    parts = present.groupBy(F.pmod(F.spark_partition_id(), F.lit(64)).alias("_part")).agg(
        F.percentile_approx("_v", shares, accuracy).alias("_q"), F.count(F.lit(1)).alias("_n")
    )
    found = (
        parts.select("_n", F.posexplode("_q").alias("_i", "_v"))
        .agg(F.percentile_approx("_v", shares, accuracy).alias("q"), F.sum(F.when(F.col("_i") == 0, F.col("_n"))).alias("n"))
        .first()
    )
    if not found["n"]:
        return ValueBuckets([], 0)
    buckets = min(width, max(2, found["n"] // rows_per_bucket))
    limits = {found["q"][i * width // buckets - 1] for i in range(1, buckets)}
    return ValueBuckets(sorted(x for x in limits if isfinite(x)), found["n"])


def value_limits(df: DataFrame, value: str, rows_per_bucket: int = ROWS_PER_VALUE_BUCKET) -> list:
    return list(value_buckets(df, value, rows_per_bucket).limits)


def _bisected(value: Column, ladder: Column, steps: int) -> Column:
    """How many entries of an ascending array shorter than 2**steps are at most ``value``. Never null, as ``hash_bucket``."""
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(steps))])
    found = F.aggregate(
        halves,
        F.lit(0),
        lambda low, half: F.when(value >= F.try_element_at(ladder, low + half), low + half).otherwise(low),
    )
    return F.coalesce(found, F.lit(0))


def value_bucket(value: Column, limits: Sequence, kind: T.DataType) -> Column:
    """How many limits are at most ``value``, by bisection."""
    return _bisected(value, constant_array(limits, kind), len(limits).bit_length()) if limits else F.lit(0)


def _ladders(crowded: DataFrame, keys: Sequence[str], value: str, width: int) -> DataFrame:
    """(keys, _ladder): for rows (keys, value, _lo) of crowded buckets, ascending values that cut each bucket.

    All lie above the bucket's least value, and the next larger one is among them, so
    every bucket with two values comes apart, however many rows hold the least.
    """
    part = F.pmod(F.spark_partition_id(), F.lit(64)).alias("_part")
    sketches = crowded.groupBy(*keys, "_lo", part).agg(
        F.percentile_approx(value, _shares(width), 4 * width).alias("_q"), F.min(F.when(F.col(value) > F.col("_lo"), F.col(value))).alias("_next")
    )
    points = sketches.select(*keys, "_lo", F.explode("_q").alias("_v")).groupBy(*keys, "_lo").agg(F.percentile_approx("_v", _shares(width), 4 * width).alias("_q"))
    following = sketches.groupBy(*keys).agg(F.min("_next").alias("_next"))
    above = F.filter("_q", lambda x: x > F.col("_next"))
    ladder = F.array_sort(F.array_distinct(F.concat(F.array("_next"), above)))
    return points.join(following, list(keys)).select(*keys, F.slice(ladder, 1, width - 1).alias("_ladder"))


def _cut_again(rows: DataFrame, keys: Sequence[str], groups: Sequence[str], value: str, limit: int, width: int) -> DataFrame | None:
    """(keys, _ladder) for the buckets ``keys`` that hold over ``limit`` rows of a group and not just one value; None if there are none."""
    sizes = rows.groupBy(*dict.fromkeys([*groups, *keys])).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    by_key = sizes.groupBy(*keys).agg(F.max("_n").alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    big = cut_lineage(by_key.filter((F.col("_n") > limit) & (F.col("_lo") < F.col("_hi"))).select(*keys, "_lo"), "crowded")
    if big.first() is None:
        return None
    return broadcast_if_small(_ladders(rows.join(broadcast_if_small(big, "crowded"), list(keys)), keys, value, width), "ladders")


def deepened(rows: DataFrame, value: str, group: Sequence[str] = (), limit: int = ROWS_PER_WINDOW, width: int = MAX_VALUE_BUCKETS) -> DataFrame:
    """``rows`` with ``_bucket``, a number, as the path of numbers that leads to its leaf in the tree of buckets.

    No leaf holds more than ``limit`` rows of a group, but for rows with one value.
    Paths sort as the values do. ``rows`` should be stored: every level passes them.
    """
    out = rows.withColumn("_bucket", F.array("_bucket"))
    while (ladders := _cut_again(out, ["_bucket"], group, value, limit, width)) is not None:
        down = _bisected(F.col(value), F.col("_ladder"), width.bit_length())
        path = F.when(F.col("_ladder").isNotNull(), F.concat("_bucket", F.array(down))).otherwise(F.col("_bucket"))
        out = cut_lineage(out.join(ladders, ["_bucket"], "left").withColumn("_bucket", path).drop("_ladder"), "tree")
    return out


def prefix_sums(
    cells: DataFrame,
    order: str,
    values: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    limits: ValueBuckets | Sequence | None = None,
    limit: int = ROWS_PER_WINDOW,
    width: int = MAX_VALUE_BUCKETS,
) -> DataFrame:
    """Inclusive running sums ``<v>_cum`` and group totals ``<v>_all`` along ``order``.

    ``order`` must be unique and not missing within a group. ``limits`` saves a pass
    over ``cells`` where they are known from cheaper rows. No window holds more than
    ``limit`` rows: where buckets of one level may, they become a tree.
    """
    if limits is None:
        limits = value_buckets(cells, order, width=width)
    known = limits if isinstance(limits, ValueBuckets) else ValueBuckets(limits, 0)
    grouped, group = with_group(cells, by)
    bucketed = grouped.withColumn("_bucket", value_bucket(F.col(order), known.limits, cells.schema[order].dataType))
    deep = known.may_hold() > limit
    if deep:
        bucketed = deepened(cut_lineage(bucketed, "cells"), order, group, limit, width)
    elif by and not known.limits:  # one bucket a group, and no more rows than a window may hold
        frame = Window.partitionBy(*group).orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = {f"{v}_cum": F.sum(v).over(frame) for v in values} | {f"{v}_all": F.sum(v).over(Window.partitionBy(*group)) for v in values}
        return grouped.withColumns(sums).select(*cells.columns, *sums)
    whole = Window.partitionBy(*group)
    totals = bucketed.groupBy(*group, "_bucket").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    if deep:
        sums = totals.groupBy(*group).agg(*[F.sum(f"_t_{v}").alias(f"{v}_all") for v in values])
        totals = totals.join(sums, list(group)) if by else totals.crossJoin(F.broadcast(sums))  # one row
    else:
        totals = totals.withColumns({f"{v}_all": F.sum(f"_t_{v}").over(whole) for v in values})
    totals = running_offsets(totals, group, [f"_t_{v}" for v in values], F.element_at("_bucket", 1) if deep else None, descending)
    totals = totals.select(*group, "_bucket", *[f"_o__t_{v}" for v in values], *[f"{v}_all" for v in values])
    inside = (
        Window.partitionBy(*group, "_bucket")
        .orderBy(F.desc(order) if descending else F.asc(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = bucketed.withColumns({f"_p_{v}": F.sum(v).over(inside) for v in values})
    placed = running.join(totals if by or deep else F.broadcast(totals), [*group, "_bucket"])
    return placed.select(
        *cells.columns,
        *[(F.col(f"_o__t_{v}") + F.col(f"_p_{v}")).alias(f"{v}_cum") for v in values],
        *[f"{v}_all" for v in values],
    )


def _narrowed(found: DataFrame, keys: Sequence[str], limit: int, width: int) -> DataFrame:
    """Rows (keys, _start, _v, _w) of buckets that hold a wanted position, down to the part of each bucket that holds it."""
    columns = [*keys, "_start", "_v", "_w"]
    found = cut_lineage(found.select(*columns), "found")
    while (ladders := _cut_again(found, keys, (), "_v", limit, width)) is not None:
        down = F.when(F.col("_ladder").isNotNull(), _bisected(F.col("_v"), F.col("_ladder"), width.bit_length())).otherwise(F.lit(0))
        parts = found.join(ladders, list(keys), "left").withColumn("_bucket", F.coalesce(down, F.lit(0))).drop("_ladder")
        counts = parts.groupBy(*keys, "_start", "_bucket").agg(F.sum("_w").alias("_n"))
        spans = running_offsets(counts, [*keys, "_start"], ["_n"]).withColumn("_from", F.col("_start") + F.col("_o__n"))
        hit = spans.filter((F.col("position") >= F.col("_from")) & (F.col("position") < F.col("_from") + F.col("_n")))
        narrower = parts.join(broadcast_if_small(hit.select(*keys, "_bucket", "_from"), "positions"), [*keys, "_bucket"])
        found = cut_lineage(narrower.withColumn("_start", F.col("_from")).select(*columns), "found")
    return found


def exact_quantiles(
    df: DataFrame,
    value: str,
    shares: Mapping[str, float | Column],
    by: Sequence[str] = (),
    weight: str | None = None,
    limit: int = ROWS_PER_WINDOW,
    width: int = MAX_VALUE_BUCKETS,
) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per entry of ``shares``.

    Rows are counted per value bucket; only buckets that hold a wanted position are
    looked into, so nothing but their values is sorted. One that may hold more than
    ``limit`` values is cut again, and the part with the position is looked into.
    ``weight`` counts a row several times.
    """
    rows, group = with_group(df.filter(F.col(value).isNotNull()), by)
    known = value_buckets(df, value, width=width)
    rows = rows.select(
        *group,
        F.col(value).alias("_v"),
        (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("_w"),
        value_bucket(F.col(value), known.limits, df.schema[value].dataType).alias("_bucket"),
    )
    end = F.sum("_n").over(Window.partitionBy(*group).orderBy("_bucket"))
    spans = (
        rows.groupBy(*group, "_bucket")
        .agg(F.sum("_w").alias("_n"))
        .withColumns({"_end": end, "_all": F.sum("_n").over(Window.partitionBy(*group))})
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )
    wanted = []
    for name, share in shares.items():
        exact = (share if isinstance(share, Column) else F.lit(float(share))) * (F.col("_all") - 1)
        for side in (F.floor(exact), F.ceil(exact)):
            wanted.append(F.struct(F.lit(name).alias("name"), exact.alias("exact"), side.cast("long").alias("position")))
    hits = (
        spans.select(*group, "_bucket", "_start", "_end", F.explode(F.array(*wanted)).alias("_p"))
        .select("*", "_p.*")
        .filter((F.col("position") >= F.col("_start")) & (F.col("position") < F.col("_end")))
        .select(*group, "_bucket", "_start", "name", "exact", "position")
        .distinct()
    )
    hits = broadcast_if_small(hits, "positions") if by else F.broadcast(hits)
    found = rows.join(hits, [*group, "_bucket"])
    if known.may_hold() > limit:
        found = _narrowed(found, [*group, "name", "exact", "position"], limit, width)
    counted = found.groupBy(*group, "name", "exact", "position", "_start", "_v").agg(F.sum("_w").alias("_n"))
    running = F.sum("_n").over(Window.partitionBy(*group, "name", "position").orderBy("_v"))
    at = (
        counted.withColumn("_after", F.col("_start") + running)
        .filter((F.col("position") >= F.col("_after") - F.col("_n")) & (F.col("position") < F.col("_after")))
    )

    def side(name: str, position: Column) -> Column:
        return F.max(F.when((F.col("name") == name) & (F.col("position") == position), F.col("_v")))

    sides = []
    for name in shares:
        sides += [
            side(name, F.floor("exact")).alias(f"_lo_{name}"),
            side(name, F.ceil("exact")).alias(f"_hi_{name}"),
            F.max(F.when(F.col("name") == name, F.col("exact") - F.floor("exact"))).alias(f"_t_{name}"),
        ]
    return at.groupBy(*group).agg(*sides).select(
        *[F.col(f"_g.{c}").alias(c) for c in by],
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_t_{n}")).alias(n)
            for n in shares
        ],
    )
