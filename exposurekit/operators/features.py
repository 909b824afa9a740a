"""Modelling-table building: projections, time split, smoothed rates and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import fill_defaults, tier
from ..functions.wording import GIFT_TIERS
from .skew import ROWS_PER_TASK, any_hot, lookup_join


# --- projections ----------------------------------------------------------------------


def drop_by_prefix(df: DataFrame, prefix: str, also: Sequence[str] = ()) -> DataFrame:
    """Drop columns by name prefix and, where present, by name."""
    return df.drop(*[c for c in df.columns if c.startswith(prefix) or c in also])


def prefix_columns(df: DataFrame, prefix: str, except_: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in except_ else F.col(c).alias(prefix + c) for c in df.columns])


def order_columns(
    df: DataFrame, keys: Sequence[str], label: Sequence[str], prefixes: Sequence[str], context: Sequence[str]
) -> DataFrame:
    """Keys, label, then columns of each prefix in turn, then context."""
    chosen = [c for p in prefixes for c in df.columns if c.startswith(p)]
    return df.select(*keys, *label, *chosen, *context)


def clean_dim(df: DataFrame, key: str, prefix: str, drop: Sequence[str]) -> DataFrame:
    """A lookup table ready to join: no anonymous columns, prefixed names, no missing key."""
    kept = drop_by_prefix(df, "onehot_feat", drop)
    return prefix_columns(kept.filter(F.col(key).isNotNull()), prefix, [key])


# --- time split and rates -------------------------------------------------------------


def time_cutoff(df: DataFrame, ts: str, share: float = 0.6) -> Column:
    """tmin + share * (tmax - tmin), as a scalar subquery the scan can filter with.

    For whole-number times the cutoff is rounded up: the same rows lie before it, and
    the comparison stays on the stored type, which file statistics can answer.
    """
    cutoff = F.min(ts) + F.lit(share) * (F.max(ts) - F.min(ts))
    if isinstance(df.schema[ts].dataType, T.IntegralType):
        cutoff = F.ceil(cutoff).cast(df.schema[ts].dataType)
    return df.agg(cutoff.alias("cutoff")).scalar()


def time_window_split(df: DataFrame, ts: str, share: float = 0.6, settled: bool = False) -> tuple[DataFrame, DataFrame]:
    """(history, label window): strictly before the cutoff, and from it on.

    ``settled`` reads the cutoff now, one number, for plans that use the parts in several jobs.
    """
    cutoff = time_cutoff(df, ts, share)
    if settled:
        cutoff = F.lit(df.sparkSession.range(1).select(cutoff.alias("c")).first()["c"]).cast(df.schema[ts].dataType)
    return df.filter(F.col(ts) < cutoff), df.filter(F.col(ts) >= cutoff)


def global_rate(hist: DataFrame, label: str = "clicked") -> DataFrame:
    return hist.agg(F.avg(label).alias("g"))


def smoothed_rate(
    hist: DataFrame, key: str, prefix: str, alpha: float = 20.0, label: str = "clicked", g: Column | None = None
) -> DataFrame:
    """Per key: (clicks + alpha * g) / (n + alpha), and n. Missing keys form no group."""
    g = global_rate(hist, label).scalar() if g is None else g
    counted = hist.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.sum(label).alias("_s"), F.count(label).alias(f"{prefix}_n")
    )
    n = F.col(f"{prefix}_n")
    rate = (F.coalesce(F.col("_s"), F.lit(0)) + F.lit(alpha) * g) / (n + F.lit(alpha))
    return counted.select(key, rate.alias(f"{prefix}_ctr"), n)


def category_rate(hist: DataFrame, key: str, label: str = "clicked", name: str = "cat_ctr") -> DataFrame:
    """Plain mean label per category."""
    return hist.filter(F.col(key).isNotNull()).groupBy(key).agg(F.avg(label).alias(name))


def category_rate_by_room(
    hist: DataFrame, room: DataFrame, category: str, live: str = "live_id", label: str = "clicked"
) -> DataFrame:
    """``category_rate`` of a log whose category sits in a room table unique by ``live``.

    Clicks are summed per room before the join, so the log itself is never joined and
    a hot room is one row.
    """
    per_room = hist.filter(F.col(live).isNotNull()).groupBy(live).agg(
        F.sum(label).alias("_s"), F.count(label).alias("_n")
    )
    joined = per_room.join(room.select(live, category).filter(F.col(category).isNotNull()), live)
    return joined.groupBy(category).agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias("cat_ctr"))


def dedupe_first(df: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order_by``. Partial minima combine before the shuffle."""
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order_by)).alias("_first")
    return df.groupBy(key).agg(first).select(key, *[F.col(f"_first.{c}").alias(c) for c in rest])


# --- joins ----------------------------------------------------------------------------


def join_dims(
    sample: DataFrame,
    user: DataFrame,
    streamer: DataFrame,
    room: DataFrame,
    spread: Sequence[str],
    hot_from: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Left join of user, streamer and room attributes.

    ``spread`` identifies a row of ``sample``; ``hot_from`` is a cheaper frame with the
    same keys, where ``sample`` itself carries earlier joins.
    """
    keys = sample if hot_from is None else hot_from
    dims = {"live_id": room, "user_id": user, "streamer_id": streamer}
    hot = any_hot(keys.select(*dims), list(dims)) if rows is None or rows > ROWS_PER_TASK else dict.fromkeys(dims, False)
    out = sample
    # rooms first: a log that is dealt out by room already meets them where it is
    for key, dim in dims.items():
        out = lookup_join(out, dim, [key], spread, hot_from=keys.select(key)) if hot[key] else out.join(dim, key, "left")
    added = [c for key in ("user_id", "streamer_id", "live_id") for c in dims[key].columns if c != key]
    return out.select(*sample.columns, *added)


def join_history(
    sample: DataFrame, user_rate: DataFrame, streamer_rate: DataFrame, g: Column, spread: Sequence[str], rows: int | None = None
) -> DataFrame:
    """Attach user and streamer rates; an unseen key has rate g and count 0."""
    out = lookup_join(sample, user_rate, ["user_id"], spread, hot_from=sample.select("user_id"), rows=rows)
    out = lookup_join(out, streamer_rate, ["streamer_id"], spread, hot_from=sample.select("streamer_id"), rows=rows)
    return fill_defaults(out, {"user_ctr": g, "user_n": 0, "streamer_ctr": g, "streamer_n": 0})


def join_category_rate(
    df: DataFrame, rates: DataFrame, category: str, g: Column, spread: Sequence[str], hot_from: DataFrame | None = None, rows: int | None = None
) -> DataFrame:
    """Attach the category's rate; an unseen or missing category has rate g."""
    return fill_defaults(lookup_join(df, rates, [category], spread, hot_from=hot_from, rows=rows), {"cat_ctr": g})


# --- gifts ----------------------------------------------------------------------------


def gift_sessions(
    gift: DataFrame,
    keys: Sequence[str] = ("user_id", "live_id", "streamer_id"),
    price: str = "gift_price",
    ts: str = "timestamp",
) -> DataFrame:
    """Per session: total price (0 when all prices are missing), priced gifts, first time."""
    present = gift
    for key in keys:
        present = present.filter(F.col(key).isNotNull())
    return present.groupBy(*keys).agg(
        F.coalesce(F.sum(price), F.lit(0.0)).alias("total_gift_price"),
        F.count(price).alias("gift_count"),
        F.min(ts).alias("first_gift_ts"),
    )


def with_gift_tier(sessions: DataFrame, limits: Sequence[float] = (5, 99)) -> DataFrame:
    return sessions.withColumn("gift_tier", tier(F.col("total_gift_price"), limits, GIFT_TIERS))
