"""The three modelling tables, from raw logs to the final columns.

Each builder writes its base rows (the sample, or the gift sessions) once to the shared
folder: every later step looks at them several times, to find hot keys, to restrict the
rooms and to join, and must not repeat the pass over the raw log. The rest is one lazy
plan over them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.columns import context_time, duration_minutes
from ..functions.wording import CONTEXT_FEATURES, HISTORY_FEATURES
from ..operators.features import (
    category_rate_by_room,
    clean_dim,
    dedupe_first,
    gift_sessions,
    global_rate,
    join_category_rate,
    join_dims,
    join_history,
    order_columns,
    smoothed_rate,
    time_window_split,
    with_gift_tier,
)
from ..operators.ordinal import text_key
from ..operators.sampling import balanced_sample
from ..operators.skew import number_copies
from ..session import cut_lineage
from ..sources.tables import keep_keys, key_list, restrict_to_keys

KEYS = ("user_id", "live_id", "streamer_id")
USER_DROP = ("reg_timestamp", "first_watch_live_timestamp")
STREAMER_DROP = ("first_live_timestamp", "reg_timestamp")


def identified(log: DataFrame, name: str = "row_id") -> DataFrame:
    """Give every row an identity: its own values and a copy number. Copies are kept."""
    columns = log.columns
    return number_copies(log).withColumn(name, text_key([*columns, "copy"])).drop("copy")


TIMES = ("start_timestamp", "end_timestamp")


def first_rooms(room: DataFrame, order_by: Sequence[str], duration: bool = False) -> DataFrame:
    """The first row of each room; only the columns that are looked at are sorted and shuffled."""
    used = ["live_id", "live_type", "live_content_category", *(TIMES if duration else ())]
    narrow = room.filter(F.col("live_id").isNotNull()).select(*dict.fromkeys([*used, *order_by]))
    return dedupe_first(narrow, "live_id", order_by).select(*used)


def room_features(room: DataFrame, keys: DataFrame, order_by: Sequence[str] | None, duration: bool = False) -> DataFrame:
    """Type and category (and length) of the rooms that occur in ``keys``, one row per room.

    Without ``order_by`` the table has one row per room already.
    """
    wanted = restrict_to_keys(room.filter(F.col("live_id").isNotNull()), keys, "live_id")
    first = wanted if order_by is None else first_rooms(wanted, order_by, duration)
    if duration:
        first = duration_minutes(first, "start_timestamp", "end_timestamp")
    return first.select(
        "live_id",
        F.col("live_type").alias("r_live_type"),
        F.col("live_content_category").alias("r_content_category"),
        *(["live_duration_min"] if duration else []),
    )


def sampled_dims(
    keys: Mapping[str, DataFrame], user: DataFrame, streamer: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """User and streamer attributes of the keys a sample holds. The large tables are filtered, not shuffled."""
    return (
        clean_dim(keep_keys(user, keys["user_id"], "user_id"), "user_id", "u_", USER_DROP),
        clean_dim(keep_keys(streamer, keys["streamer_id"], "streamer_id"), "streamer_id", "s_", STREAMER_DROP),
    )


def static_table(
    log: DataFrame,
    user: DataFrame,
    streamer: DataFrame,
    room: DataFrame,
    room_order: Sequence[str],
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Balanced sample of all exposures with user, streamer, room and time features."""
    sample = balanced_sample(log, "clicked", settings.static_per_class, log.columns, settings.seed)
    sample = cut_lineage(identified(sample), "sample")
    rows = sample.count()
    keys = {k: key_list(sample, k) for k in ("user_id", "streamer_id")}
    joined = join_dims(sample, *sampled_dims(keys, user, streamer), room_features(room, sample, room_order), ["row_id"], rows=rows)
    timed = context_time(joined, "timestamp", settings.time_zone)
    return order_columns(timed, ["row_id", *KEYS], ["clicked"], ["u_", "s_"], CONTEXT_FEATURES)


def history_table(
    log: DataFrame,
    user: DataFrame,
    streamer: DataFrame,
    room: DataFrame,
    room_order: Sequence[str],
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """The static table over the later part of the log, plus rates from the earlier part only."""
    # two numbers, read once: as subqueries every later job would pass the log again for them
    hist, later = time_window_split(log, "timestamp", settings.history_share, settled=True)
    g = F.lit(global_rate(hist).first()[0]).cast("double")
    sample = balanced_sample(later, "clicked", settings.history_per_class, log.columns, settings.seed, equal=False)
    sample = cut_lineage(identified(sample), "sample")
    rows = sample.count()
    # rates are needed for sampled users and streamers only; g is of the whole history
    keys = {k: key_list(sample, k) for k in ("user_id", "streamer_id")}
    rates = [
        smoothed_rate(keep_keys(hist, keys[f"{p}_id"], f"{p}_id"), f"{p}_id", p, settings.smoothing, g=g)
        for p in ("user", "streamer")
    ]
    with_rates = join_history(sample, *rates, g, ["row_id"], rows=rows)
    # the first rows of all rooms are found once, for the category rates and for the sample
    every_room = cut_lineage(first_rooms(room, room_order), "every-room")
    # at most one room per sampled row
    rooms = cut_lineage(room_features(every_room, sample, None), "rooms")
    joined = join_dims(with_rates, *sampled_dims(keys, user, streamer), rooms, ["row_id"], hot_from=sample, rows=rows)
    categories = sample.select("live_id").join(rooms, "live_id", "left").select("r_content_category")
    by_category = category_rate_by_room(hist, every_room.withColumnRenamed("live_content_category", "r_content_category"), "r_content_category")
    rated = join_category_rate(joined, by_category, "r_content_category", g, ["row_id"], hot_from=categories, rows=rows)
    timed = context_time(rated, "timestamp", settings.time_zone)
    return order_columns(timed, ["row_id", *KEYS], ["clicked", *HISTORY_FEATURES], ["u_", "s_"], CONTEXT_FEATURES)


def gift_table(
    gift: DataFrame,
    user: DataFrame,
    streamer: DataFrame,
    room: DataFrame,
    room_order: Sequence[str],
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """One row per gifting session with its tier."""
    sessions = with_gift_tier(gift_sessions(gift), (settings.low_max, settings.mid_max))
    sessions = cut_lineage(sessions, "sessions")
    joined = join_dims(
        sessions,
        clean_dim(user, "user_id", "u_", USER_DROP),
        clean_dim(streamer, "streamer_id", "s_", STREAMER_DROP),
        room_features(room, sessions, room_order, duration=True),
        KEYS,
        rows=sessions.count(),
    )
    timed = context_time(joined, "first_gift_ts", settings.time_zone)
    context = ("r_content_category", "r_live_type", "live_duration_min", "ctx_hour", "ctx_dayofweek")
    return order_columns(timed, KEYS, ["gift_tier", "total_gift_price", "gift_count"], ["u_", "s_"], context)


def feature_names(table: DataFrame, label: str = "clicked") -> list[str]:
    """All columns but keys and label."""
    return [c for c in table.columns if c not in ("row_id", *KEYS, label)]
