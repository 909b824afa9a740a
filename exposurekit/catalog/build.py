"""Sources, projections, joins, rates, profiling and sampling."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS
from ..functions import columns as C
from ..functions.wording import CARD_FEATURES, COARSE_AGE, FAILED_RATIONALE, GIFT_TIERS, REGIME_TITLES
from ..operators import cost, features, profile, sampling
from ..operators.ordinal import with_ordinal
from ..operators.skew import lookup_join
from ..plans import tables as plans
from ..session import cut_lineage, fresh_path
from ..sources import answers, sinks, tables
from .registry import query
from .views import Views, uniform, uniform_sql



def key_sql(*columns: str) -> str:
    """The text that stands for a row: every value with its length before it."""
    return "concat_ws('-', " + ", ".join(f"coalesce(length({c}::varchar) || ':' || {c}::varchar, '~')" for c in columns) + ")"


LOG_COLUMNS = ("user_id", "live_id", "streamer_id", "timestamp", "clicked")

# ------------------------------------------------------------------ sources and sinks


@query(
    "scan_exposures",
    "v_log",
    f"""select user_id, live_id, streamer_id, timestamp, clicked::bigint clicked,
       {key_sql(*LOG_COLUMNS, 'copy')} as row_id
       from (select *, row_number() over (partition by user_id, live_id, streamer_id, timestamp, clicked) - 1 as copy from v_log)""",
)
def scan_exposures(v: Views):
    log = v.log()
    return plans.identified(tables.exposures(log.filter("clicked = 1"), log.filter("clicked = 0")))


@query(
    "scan_dims",
    "",
    """select c_custkey, c_name, c_nationkey::bigint c_nationkey, round(c_acctbal, 6) c_acctbal, c_mktsegment, text as note
       from customer left join documents on c_custkey = doc_id""",
)
def scan_dims(v: Views):
    schema = T.StructType(
        [
            T.StructField("c_custkey", T.LongType()),
            T.StructField("c_name", T.StringType()),
            T.StructField("c_nationkey", T.IntegerType()),
            T.StructField("c_acctbal", T.DoubleType()),
            T.StructField("c_mktsegment", T.StringType()),
            T.StructField("note", T.StringType()),
        ]
    )
    # a raw file as other tools write it: whole numbers with a point, free text, columns in another order
    raw = v.table("customer").join(v.table("documents"), F.col("c_custkey") == F.col("doc_id"), "left").selectExpr(
        "text as note", "c_name", "c_acctbal", "concat(c_custkey, '.0') as c_custkey", "c_mktsegment", "cast(c_nationkey as double) as c_nationkey"
    )
    path = fresh_path(v.spark, "raw-dims")
    raw.write.options(**sinks.CSV_TEXT).csv(path)
    return tables.read_dim(v.spark, path, schema)


@query(
    "scan_room_filtered",
    "v_room v_exposures",
    "select * from v_room where live_id in (select live_id from v_exposures where clicked = 1)",
)
def scan_room_filtered(v: Views):
    return tables.restrict_to_keys(v.room(), v.exposures().filter("clicked = 1"), "live_id")


MODELING_SQL = """select row_id, user_id, streamer_id, clicked::bigint clicked, event_type, u_age, u_gender,
    round(u_device_price, 6) u_device_price, s_country, round(s_device_price, 6) s_device_price,
    round(r_value, 6) r_value, timestamp from v_modeling"""


@query("scan_modeling_table", "v_modeling", MODELING_SQL)
def scan_modeling_table(v: Views):
    path = fresh_path(v.spark, "modeling")
    sinks.write_table(v.modeling(), path)
    return tables.read_modeling(v.spark, path)


@query(
    "sink_table",
    "v_modeling",
    MODELING_SQL.replace("timestamp from v_modeling", "timestamp, text, nullif(lang, 'en') lang from v_modeling left join documents on row_id = doc_id"),
)
def sink_table(v: Views):
    notes = v.table("documents").selectExpr("doc_id as row_id", "text", "nullif(lang, 'en') as lang")
    path, table = fresh_path(v.spark, "modeling-csv"), v.modeling().join(notes, "row_id", "left")
    sinks.write_table(table, path, fmt="csv")
    return tables.read_modeling(v.spark, path, table.schema, fmt="csv")


@query("scan_rationales", "v_rationales", "select row_id, rationale, label::bigint as label from v_rationales")
def scan_rationales(v: Views):
    path, train = fresh_path(v.spark, "rationales"), v.rationales()
    sinks.write_jsonl(train, path)
    return tables.cached_rationales(v.spark, path, train)


# two stored batches: seven rows in eight, a fifth of them failed calls; then a second try of half of them
STATUS_SQL = f"""picked as (select *, {uniform_sql('first', 'row_id')} a, {uniform_sql('fail', 'row_id')} b, {uniform_sql('again', 'row_id')} c from v_rationales),
    found as (select row_id, label, case when a >= 0.875e0 then 'missing' when b < 0.2e0 and c >= 0.5e0 then 'failed' else 'answered' end status,
      case when a >= 0.875e0 then null when c < 0.5e0 then 'again: ' || rationale when b >= 0.2e0 then rationale end rationale,
      case when a >= 0.875e0 then null when c < 0.5e0 then 1 else 0 end::bigint version from picked)"""


def partly_answered(v: Views) -> DataFrame:
    """Status of every row against a store with failed calls, second tries and rows nobody asked for."""
    path, rows = fresh_path(v.spark, "answers"), v.rationales()
    first = rows.filter(uniform("first", "row_id") < 0.875)
    failed = F.when(uniform("fail", "row_id") >= 0.2, F.col("rationale"))
    answers.add_answers(path, first.withColumn("rationale", failed), 0)
    again = first.filter(uniform("again", "row_id") < 0.5)
    answers.add_answers(path, again.withColumn("rationale", F.concat(F.lit("again: "), "rationale")), 1)
    return answers.completeness(answers.read_store(v.spark, path), rows)


@query(
    "scan_rationales_partial",
    "v_rationales",
    f""", {STATUS_SQL} select row_id, status, coalesce(rationale, case when status = 'failed' then '{FAILED_RATIONALE}' end) rationale,
       case when status <> 'missing' then label end::bigint as label, (status = 'failed')::bigint defaulted,
       case status when 'failed' then coalesce(version, -1) + 1 when 'missing' then 0 end::bigint attempt from found""",
)
def scan_rationales_partial(v: Views):
    """What is there, what stands in for failed calls, and what is still to be asked for."""
    found = cut_lineage(partly_answered(v), "answers-found")
    told, work = answers.with_default(found), answers.work_list(found)
    joined = found.select("row_id", "status").join(told, "row_id", "left").join(work, "row_id", "left")
    return joined.select("row_id", "status", "rationale", "label", F.coalesce("defaulted", F.lit(False)).alias("defaulted"), "attempt")


@query(
    "rationale_completeness",
    "v_rationales",
    f""", {STATUS_SQL} select count(*) wanted, count(*) filter (status = 'answered') answered, count(*) filter (status = 'failed') failed,
       count(*) filter (status = 'missing') missing, (count(*) filter (status = 'missing') = 0)::bigint complete from found""",
)
def rationale_completeness(v: Views):
    return answers.summary(partly_answered(v))


@query("sink_jsonl", "v_rationales", "select row_id, rationale, label::bigint as label from v_rationales")
def sink_jsonl(v: Views):
    path = fresh_path(v.spark, "examples")
    sinks.write_jsonl(v.rationales(), path)
    return v.spark.read.schema(tables.RATIONALE).json(path)


@query(
    "sink_records",
    "v_modeling",
    "select u_age, count(*) n, round(avg(clicked::double), 6) rate from v_modeling group by u_age",
)
def sink_records(v: Views):
    path = fresh_path(v.spark, "records")
    records = v.modeling().groupBy("u_age").agg(F.count(F.lit(1)).alias("n"), F.avg("clicked").alias("rate"))
    sinks.write_records(records, path)
    return v.spark.read.schema(records.schema).json(path)


# ------------------------------------------------------------------------ projections


@query(
    "drop_by_prefix",
    "v_user",
    "select user_id, age, gender, country, device_brand, round(device_price, 6) device_price from v_user",
)
def drop_by_prefix(v: Views):
    return features.drop_by_prefix(v.user(), "onehot_feat", plans.USER_DROP)


@query(
    "prefix_columns",
    "v_streamer",
    """select streamer_id, country s_country, round(device_price, 6) s_device_price,
       live_operation_tag s_live_operation_tag from v_streamer""",
)
def prefix_columns(v: Views):
    return features.clean_dim(v.streamer(), "streamer_id", "s_", plans.STREAMER_DROP)


@query(
    "order_columns",
    "v_modeling",
    """select row_id, user_id, streamer_id, clicked::bigint clicked, u_age, u_gender, round(u_device_price, 6) u_device_price,
       s_country, round(s_device_price, 6) s_device_price, round(r_value, 6) r_value from v_modeling""",
)
def order_columns(v: Views):
    return features.order_columns(v.modeling(), ["row_id", "user_id", "streamer_id"], ["clicked"], ["u_", "s_"], ["r_value"])


@query(
    "time_window_split",
    "v_exposures v_cut",
    """select row_id, timestamp, case when timestamp < cutoff then 'history' else 'label' end as part
       from v_exposures, v_cut where timestamp is not null""",
)
def time_window_split(v: Views):
    hist, later = features.time_window_split(v.exposures().select("row_id", "timestamp"), "timestamp")
    return hist.withColumn("part", F.lit("history")).unionByName(later.withColumn("part", F.lit("label")))


@query(
    "context_time",
    "v_events",
    """select row_id, hour(epoch_ms(timestamp) + interval 8 hour)::bigint ctx_hour,
       (isodow(epoch_ms(timestamp) + interval 8 hour) - 1)::bigint ctx_dayofweek from v_events""",
)
def context_time(v: Views):
    return C.context_time(v.events(), "timestamp").select("row_id", "ctx_hour", "ctx_dayofweek")


@query(
    "duration_minutes",
    "v_room",
    """select live_id, linenumber, partkey, suppkey, cents, round(case when end_timestamp >= start_timestamp
       then round_even((end_timestamp - start_timestamp) / 60000e0 * 10, 0) / 10 end, 6) as live_duration_min from v_room""",
)
def duration_minutes(v: Views):
    timed = C.duration_minutes(v.room(), "start_timestamp", "end_timestamp")
    return timed.select("live_id", *Views.room_order, "live_duration_min")


LIMITS = (50_000.0, 100_000.0)
TIER_SQL = "case when total_gift_price <= 50000 then 'Low' when total_gift_price <= 100000 then 'Mid' else 'High' end"


@query(
    "gift_tier",
    "v_sessions",
    f"select user_id, live_id, streamer_id, round(total_gift_price, 6) total_gift_price, {TIER_SQL} as gift_tier from v_sessions",
)
def gift_tier(v: Views):
    tiers = features.with_gift_tier(features.gift_sessions(v.gift()), LIMITS)
    return tiers.select(*plans.KEYS, "total_gift_price", "gift_tier")


@query(
    "recode_passthrough",
    "v_modeling",
    """select row_id, case when u_age in ('12-17', '18-23') then '<24' when u_age in ('24-30', '31-40') then '24-40'
       when u_age in ('41-49', '50+') then '40+' else u_age end as coarse,
       case event_type when 'click' then 'act' when 'purchase' then 'act' else event_type end as kind from v_modeling""",
)
def recode_passthrough(v: Views):
    kind = C.recode(F.col("event_type"), {"click": "act", "purchase": "act"})
    return v.modeling().select("row_id", C.recode(F.col("u_age"), COARSE_AGE).alias("coarse"), kind.alias("kind"))


@query(
    "fill_defaults",
    "v_modeling",
    """select row_id, round(coalesce(s_device_price, (select avg(device_price) from v_streamer)), 6) s_device_price,
       coalesce(s_country, 0) s_country from v_modeling""",
)
def fill_defaults(v: Views):
    mean = v.streamer().agg(F.avg("device_price").alias("m")).scalar()
    filled = C.fill_defaults(v.modeling(), {"s_device_price": mean, "s_country": 0})
    return filled.select("row_id", "s_device_price", "s_country")


# ------------------------------------------------------------------------------ joins

DIM_COLUMNS_SQL = """u.age u_age, u.gender u_gender, u.country u_country, u.device_brand u_device_brand,
    round(u.device_price, 6) u_device_price, s.country s_country, round(s.device_price, 6) s_device_price,
    s.live_operation_tag s_live_operation_tag"""
DIM_JOINS_SQL = """left join v_user u on e.user_id = u.user_id left join v_streamer s on e.streamer_id = s.streamer_id
    left join v_rooms r on e.live_id = r.live_id"""
CONTEXT_SQL = """hour(epoch_ms(e.timestamp) + interval 8 hour)::bigint ctx_hour,
    (isodow(epoch_ms(e.timestamp) + interval 8 hour) - 1)::bigint ctx_dayofweek"""


@query(
    "join_dims",
    "v_exposures v_user v_streamer v_rooms",
    f"""select e.row_id, e.user_id, e.streamer_id, e.live_id, {DIM_COLUMNS_SQL}, r.live_type r_live_type,
       r.live_content_category r_content_category from v_exposures e {DIM_JOINS_SQL}""",
)
def join_dims(v: Views):
    log = v.exposures().select("row_id", "user_id", "streamer_id", "live_id")
    return features.join_dims(
        log,
        features.clean_dim(v.user(), "user_id", "u_", plans.USER_DROP),
        features.clean_dim(v.streamer(), "streamer_id", "s_", plans.STREAMER_DROP),
        plans.room_features(v.room(), log, Views.room_order),
        ["row_id"],
    )


@query(
    "join_history",
    "v_later v_user_rate v_streamer_rate v_g",
    """select l.row_id, l.user_id, l.streamer_id, round(coalesce(user_ctr, g), 6) user_ctr, coalesce(user_n, 0)::bigint user_n,
       round(coalesce(streamer_ctr, g), 6) streamer_ctr, coalesce(streamer_n, 0)::bigint streamer_n
       from v_later l cross join v_g left join v_user_rate u on l.user_id = u.user_id
       left join v_streamer_rate s on l.streamer_id = s.streamer_id""",
)
def join_history(v: Views):
    hist, later = features.time_window_split(v.exposures(), "timestamp")
    g = features.global_rate(hist).scalar()
    rates = [features.smoothed_rate(hist, f"{p}_id", p, g=g) for p in ("user", "streamer")]
    return features.join_history(later.select("row_id", "user_id", "streamer_id"), *rates, g, ["row_id"])


@query(
    "join_category_ctr",
    "v_later v_rooms v_cat_rate v_g",
    """select l.row_id, r.live_content_category, round(coalesce(c.cat_ctr, g), 6) cat_ctr
       from v_later l cross join v_g left join v_rooms r on l.live_id = r.live_id
       left join v_cat_rate c on r.live_content_category = c.live_content_category""",
)
def join_category_ctr(v: Views):
    hist, later = features.time_window_split(v.exposures(), "timestamp")
    rooms = features.dedupe_first(v.room(), "live_id", Views.room_order).select("live_id", "live_content_category")
    g = features.global_rate(hist).scalar()
    rates = features.category_rate_by_room(hist, rooms, "live_content_category")
    sample = lookup_join(later.select("row_id", "live_id"), rooms, ["live_id"], ["row_id"]).drop("live_id")
    return features.join_category_rate(sample, rates, "live_content_category", g, ["row_id"])


# ------------------------------------------------------------------------------ rates


@query("global_rate", "v_g", "select round(g, 6) g from v_g")
def global_rate(v: Views):
    return features.global_rate(features.time_window_split(v.exposures(), "timestamp")[0])


@query(
    "smoothed_rate",
    "v_user_rate v_streamer_rate",
    """select 'user' kind, user_id key, round(user_ctr, 6) ctr, user_n n from v_user_rate
       union all select 'streamer', streamer_id, round(streamer_ctr, 6), streamer_n from v_streamer_rate""",
)
def smoothed_rate(v: Views):
    hist, _ = features.time_window_split(v.exposures(), "timestamp")
    g = features.global_rate(hist).scalar()
    parts = [
        features.smoothed_rate(hist, f"{p}_id", p, g=g).select(
            F.lit(p).alias("kind"), F.col(f"{p}_id").alias("key"), F.col(f"{p}_ctr").alias("ctr"), F.col(f"{p}_n").alias("n")
        )
        for p in ("user", "streamer")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "category_rate",
    "v_hist",
    "select category, round(avg(clicked::double), 6) cat_ctr from v_hist where category is not null group by category",
)
def category_rate(v: Views):
    return features.category_rate(features.time_window_split(v.exposures(), "timestamp")[0], "category")


@query(
    "gift_sessions",
    "v_sessions",
    "select user_id, live_id, streamer_id, round(total_gift_price, 6) total_gift_price, gift_count, first_gift_ts from v_sessions",
)
def gift_sessions(v: Views):
    return features.gift_sessions(v.gift())


@query(
    "history_ctr",
    "v_later v_user_rate v_g",
    """select l.row_id, l.user_id, l.clicked::bigint clicked, round(coalesce(user_ctr, g), 6) user_ctr,
       coalesce(user_n, 0)::bigint user_n from v_later l cross join v_g left join v_user_rate u on l.user_id = u.user_id""",
)
def history_ctr(v: Views):
    hist, later = features.time_window_split(v.exposures(), "timestamp")
    g = features.global_rate(hist).scalar()
    rate = features.smoothed_rate(hist, "user_id", "user", g=g)
    joined = lookup_join(later.select("row_id", "user_id", "clicked"), rate, ["user_id"], ["row_id"])
    return C.fill_defaults(joined, {"user_ctr": g, "user_n": 0})


# ------------------------------------------------------------------ whole tables

LOG_KEY_SQL = f"md5('42:' || {key_sql(*LOG_COLUMNS)})"


def sample_sql(source: str, quota: str) -> str:
    """The seeded sample of a log: first ``quota`` rows of each class."""
    return f"""(select *, {key_sql(*LOG_COLUMNS, 'copy')} row_id from (
        select user_id, live_id, streamer_id, timestamp, clicked,
        row_number() over (partition by user_id, live_id, streamer_id, timestamp, clicked) - 1 copy,
        row_number() over (partition by clicked order by {LOG_KEY_SQL}) pos from {source}) where pos <= {quota})"""


@query(
    "static_table",
    "v_log v_user v_streamer v_rooms",
    f"""select e.row_id, e.user_id, e.live_id, e.streamer_id, e.clicked::bigint clicked, {DIM_COLUMNS_SQL},
       r.live_content_category r_content_category, r.live_type r_live_type, {CONTEXT_SQL}
       from {sample_sql('v_log', '(select least(250000, count(*) filter (clicked = 1), count(*) filter (clicked = 0)) from v_log)')} e
       {DIM_JOINS_SQL}""",
)
def static_table(v: Views):
    return plans.static_table(v.log(), v.user(), v.streamer(), v.room(), Views.room_order)


@query(
    "history_table",
    "v_later v_user v_streamer v_rooms v_user_rate v_streamer_rate v_cat_rate v_g",
    f"""select e.row_id, e.user_id, e.live_id, e.streamer_id, e.clicked::bigint clicked,
       round(coalesce(ur.user_ctr, g), 6) user_ctr, coalesce(ur.user_n, 0)::bigint user_n,
       round(coalesce(sr.streamer_ctr, g), 6) streamer_ctr, coalesce(sr.streamer_n, 0)::bigint streamer_n,
       round(coalesce(c.cat_ctr, g), 6) cat_ctr, {DIM_COLUMNS_SQL},
       r.live_content_category r_content_category, r.live_type r_live_type, {CONTEXT_SQL}
       from {sample_sql('v_later', '30000')} e cross join v_g {DIM_JOINS_SQL}
       left join v_user_rate ur on e.user_id = ur.user_id left join v_streamer_rate sr on e.streamer_id = sr.streamer_id
       left join v_cat_rate c on r.live_content_category = c.live_content_category""",
)
def history_table(v: Views):
    # lines meet their orders once, every pass over the log reads the stored result
    return plans.history_table(cut_lineage(v.log(), "log"), v.user(), v.streamer(), v.room(), Views.room_order)


@query(
    "gift_table",
    "v_sessions v_user v_streamer v_rooms",
    f"""select e.user_id, e.live_id, e.streamer_id, {TIER_SQL} gift_tier, round(total_gift_price, 6) total_gift_price,
       gift_count, {DIM_COLUMNS_SQL}, r.live_content_category r_content_category, r.live_type r_live_type,
       round(case when end_timestamp >= start_timestamp
         then round_even((end_timestamp - start_timestamp) / 60000e0 * 10, 0) / 10 end, 6) live_duration_min,
       {CONTEXT_SQL.replace('e.timestamp', 'e.first_gift_ts')}
       from v_sessions e {DIM_JOINS_SQL}""",
)
def gift_table(v: Views):
    settings = replace(DEFAULTS, low_max=LIMITS[0], mid_max=LIMITS[1])
    return plans.gift_table(v.gift(), v.user(), v.streamer(), v.room(), Views.room_order, settings)


# -------------------------------------------------------------------------- profiling


@query(
    "log_summary",
    "v_exposures",
    """select count(*) filter (clicked = 1) positives, count(*) filter (clicked = 0) negatives, count(clicked) total,
       round(count(*) filter (clicked = 1) / count(clicked), 6) natural_rate from v_exposures""",
)
def log_summary(v: Views):
    return profile.log_summary(v.exposures())


@query(
    "distinct_counts",
    "v_exposures",
    """select count(distinct user_id) distinct_user_id, count(distinct streamer_id) distinct_streamer_id,
       count(distinct live_id) distinct_live_id from v_exposures""",
)
def distinct_counts(v: Views):
    return profile.distinct_counts(v.exposures(), ["user_id", "streamer_id", "live_id"])


@query(
    "class_balance",
    "v_exposures",
    """select position::bigint position, class::bigint class, count(clicked) n, round(count(clicked) / (select count(*) from v_exposures), 6) share
       from (values (0, 1), (1, 0)) c(position, class) left join v_exposures on clicked = class group by all""",
)
def class_balance(v: Views):
    return profile.class_balance(v.exposures(), "clicked", [1, 0])


@query(
    "tier_distribution",
    "v_sessions",
    f"""select position::bigint position, class, count(gift_tier) n, round(count(gift_tier) / (select count(*) from v_sessions), 6) share
       from (values (0, 'Low'), (1, 'Mid'), (2, 'High')) c(position, class)
       left join (select {TIER_SQL} gift_tier from v_sessions) on gift_tier = class group by all""",
)
def tier_distribution(v: Views):
    return profile.class_balance(features.with_gift_tier(features.gift_sessions(v.gift()), LIMITS), "gift_tier", GIFT_TIERS)


@query(
    "price_summary",
    "v_sessions",
    """select round(min(total_gift_price), 6) "min", round(quantile_cont(total_gift_price, 0.5), 6) median,
       round(avg(total_gift_price), 6) mean, round(max(total_gift_price), 6) "max" from v_sessions""",
)
def price_summary(v: Views):
    # a profile looks at a stored table several times
    sessions = cut_lineage(features.gift_sessions(v.gift()), "sessions")
    return profile.numeric_summary(sessions, "total_gift_price")


@query(
    "missingness",
    "v_modeling",
    """select feature, round(share, 6) share from (unpivot (select avg((u_gender is null)::int) u_gender, avg((s_country is null)::int) s_country,
         avg((s_device_price is null)::int) s_device_price, avg((u_age is null)::int) u_age, avg((r_value is null)::int) r_value
       from v_modeling) on columns(*) into name feature value share) where share > 0""",
)
def missingness(v: Views):
    return profile.missingness(v.modeling(), ["u_age", "u_gender", "s_country", "s_device_price", "r_value"])


@query("value_distribution", "v_modeling", "select u_gender as value, count(*) n from v_modeling group by 1")
def value_distribution(v: Views):
    return profile.value_distribution(v.modeling(), "u_gender")


@query("prediction_balance", "v_predictions", "select h_a::bigint hard, count(*) n from v_predictions group by 1")
def prediction_balance(v: Views):
    return profile.prediction_balance(v.predictions(), "h_a")


@query(
    "feature_typing",
    "v_modeling",
    """select 'u_age' feature, 'categorical' kind union all select 'u_gender', 'categorical'
       union all select 'u_device_price', case when count(distinct u_device_price) > 30 then 'numeric' else 'categorical' end from v_modeling
       union all select 's_country', case when count(distinct s_country) > 30 then 'numeric' else 'categorical' end from v_modeling
       union all select 's_device_price', case when count(distinct s_device_price) > 30 then 'numeric' else 'categorical' end from v_modeling
       union all select 'r_value', case when count(distinct r_value) > 30 then 'numeric' else 'categorical' end from v_modeling""",
)
def feature_typing(v: Views):
    return profile.feature_typing(v.modeling(), Views.features)


NUMERIC = ("u_device_price", "r_value")
CATEGORICAL = ("u_age", "u_gender", "s_country")


def mode_sql(column: str) -> str:
    return f"""select '{column}' feature, (select {column}::varchar from v_modeling where {column} is not null
        group by {column} order by count(*) desc, {column} limit 1) as value"""


@query(
    "impute_values",
    "v_modeling",
    """select feature, round(value::double, 4)::varchar as value from (
         select 'u_device_price' feature, avg(u_device_price) as value from v_modeling
         union all select 'r_value', avg(r_value) from v_modeling)
       union all """
    + " union all ".join(mode_sql(c) for c in CATEGORICAL),
)
def impute_values(v: Views):
    values = profile.impute_values(v.modeling(), NUMERIC, CATEGORICAL)
    shown = F.round(F.col("value").try_cast("double"), 4).cast("string")
    return values.select("feature", F.when(F.col("feature").isin(*NUMERIC), shown).otherwise(F.col("value")).alias("value"))


PRICE_SQL = {
    d: f"case model when 'gpt-4o' then {a}e0 when 'gpt-4o-mini' then {b}e0 else case when provider = 'credit' then 0e0 else {a}e0 end end"
    for d, a, b in (("in", "2.5", "0.15"), ("out", "10.0", "0.60"))
}


@query(
    "usage_cost",
    "v_usage",
    f"""select run, sum(calls)::bigint calls, sum(tin)::bigint tin, sum(tout)::bigint tout, round(sum(usd) * 1000, 6) as milli_usd from (
       select run, count(*) calls, sum(tokens_in) tin, sum(tokens_out) tout,
       sum(tokens_in)::double / 1e6 * {PRICE_SQL['in']} + sum(tokens_out)::double / 1e6 * {PRICE_SQL['out']} usd
       from v_usage group by run, model, provider) group by run""",
)
def usage_cost(v: Views):
    spent = cost.usage_cost(v.usage())
    return spent.withColumn("milli_usd", F.col("usd") * 1000).drop("usd")


@query(
    "budget_cut",
    "v_usage",
    """, priced as (select *,
         case when model = 'gpt-4o' then 2.5 when model = 'gpt-4o-mini' then 0.15 when provider = 'credit' then 0 else 2.5 end::decimal(9, 3) as p_in,
         case when model = 'gpt-4o' then 10 when model = 'gpt-4o-mini' then 0.6 when provider = 'credit' then 0 else 10 end::decimal(9, 3) as p_out
         from v_usage)
       select a.run, a.call, (coalesce(sum(b.tokens_in::decimal(18, 0) * b.p_in + b.tokens_out::decimal(18, 0) * b.p_out), 0) > 1000000)::bigint as "over"
       from priced a left join priced b on a.run = b.run and b.call < a.call group by a.run, a.call""",
)
def budget_cut(v: Views):
    return cost.budget_cut(v.usage(), cap=1.0)


# --------------------------------------------------------------------------- sampling

KEY_SQL = "md5('42:' || row_id::varchar)"
SAMPLE_KEY_SQL = f"md5('42:' || {key_sql('row_id')})"


@query(
    "balanced_sample",
    "v_events",
    f"""select row_id, clicked::bigint clicked from (select *, row_number() over (partition by clicked order by {SAMPLE_KEY_SQL}) pos
       from v_events) where pos <= (select least(2000, count(*) filter (clicked = 1), count(*) filter (clicked = 0)) from v_events)""",
)
def balanced_sample(v: Views):
    rows = v.events().select("row_id", "clicked")
    return sampling.balanced_sample(rows, "clicked", 2000, ["row_id"], unique=True)


@query(
    "balanced_sample_per_class",
    "v_exposures",
    f"""select row_id, clicked::bigint clicked from (select *, row_number() over (partition by clicked order by {SAMPLE_KEY_SQL}) pos
       from v_exposures) where pos <= 30000""",
)
def balanced_sample_per_class(v: Views):
    rows = v.exposures().select("row_id", "clicked")
    return sampling.balanced_sample(rows, "clicked", DEFAULTS.history_per_class, ["row_id"], equal=False, unique=True)


@query("shuffle_order", "v_exposures", f"select row_id, row_number() over (order by {KEY_SQL}) - 1 as ordinal from v_exposures")
def shuffle_order(v: Views):
    return with_ordinal(v.exposures().select("row_id"), "row_id", DEFAULTS.seed)


@query(
    "ordinal_split",
    "v_events",
    f"""select row_id, case when pos <= 1000 then 'learn' when pos <= 1500 then 'valid' when pos <= 3500 then 'test' end as split
       from (select row_id, row_number() over (order by {KEY_SQL}) pos from v_events)""",
)
def ordinal_split(v: Views):
    sizes = {"learn": DEFAULTS.learn_rows, "valid": DEFAULTS.valid_rows, "test": DEFAULTS.test_rows}
    return sampling.ordinal_split(v.events().select("row_id"), sizes, "row_id")


@query(
    "tail_split",
    "v_events",
    f"""select row_id, case when pos > (select count(*) from v_events) - 5000 then 'test' else 'train' end as split
       from (select row_id, row_number() over (order by {KEY_SQL}) pos from v_events)""",
)
def tail_split(v: Views):
    return sampling.tail_split(v.events().select("row_id"), DEFAULTS.tail_rows, "row_id")


@query("dedupe_first", "v_rooms", "select * from v_rooms")
def dedupe_first(v: Views):
    return features.dedupe_first(v.room(), "live_id", Views.room_order)


@query(
    "prior_shift_resample",
    "v_events",
    f"""select row_id, clicked::bigint clicked from (select *, row_number() over (partition by clicked order by {SAMPLE_KEY_SQL}) pos
       from v_events) where pos <= case when clicked = 1 then 558 else 1442 end""",
)
def prior_shift_resample(v: Views):
    pool = v.events().select("row_id", "clicked")
    return sampling.prior_shift_resample(
        pool, "clicked", DEFAULTS.natural_rate, DEFAULTS.natural_rows, ["row_id"], unique=True
    )


@query(
    "error_sample",
    "v_predictions",
    f"""select row_id, y::bigint y, h_a::bigint hard, pos - 1 ordinal from (select *, row_number() over (order by {KEY_SQL}) pos
       from v_predictions where y <> h_a) where pos <= 60""",
)
def error_sample(v: Views):
    rows = v.predictions().select("row_id", "y", F.col("h_a").alias("hard"))
    return sampling.error_sample(rows, "y", "hard", DEFAULTS.shown_errors, "row_id")


HISTORY_ROWS_SQL = """(select l.row_id, l.clicked, coalesce(user_ctr, g) user_ctr, coalesce(user_n, 0) user_n,
    coalesce(streamer_ctr, g) streamer_ctr, coalesce(streamer_n, 0) streamer_n, coalesce(cat_ctr, g) cat_ctr, r.live_content_category r_content_category
    from v_later l cross join v_g left join v_user_rate u on l.user_id = u.user_id
    left join v_streamer_rate s on l.streamer_id = s.streamer_id left join v_rooms r on l.live_id = r.live_id
    left join v_cat_rate c on r.live_content_category = c.live_content_category)"""
HISTORY_VIEWS = "v_later v_user_rate v_streamer_rate v_rooms v_cat_rate v_g"

REGIME_SQL = f"""h as {HISTORY_ROWS_SQL},
    q as (select quantile_cont(user_ctr, 0.25) ulo, quantile_cont(user_ctr, 0.75) uhi, quantile_cont(streamer_ctr, 0.25) slo,
      quantile_cont(streamer_ctr, 0.75) shi, quantile_cont(user_n, 0.75) nhi, quantile_cont(cat_ctr, 0.8) chi from h),
    titles("case") as (values {', '.join(f"('{t}')" for t in REGIME_TITLES)}),
    hits as (select h.*, unnest([
      case when user_ctr >= uhi and streamer_ctr >= shi and clicked = 1 then '{REGIME_TITLES[0]}' end,
      case when user_ctr <= ulo and streamer_ctr <= slo and clicked = 0 then '{REGIME_TITLES[1]}' end,
      case when user_ctr <= ulo and streamer_ctr >= shi and clicked = 1 then '{REGIME_TITLES[2]}' end,
      case when user_n >= nhi and streamer_ctr <= slo and clicked = 0 then '{REGIME_TITLES[3]}' end,
      case when cat_ctr >= chi and clicked = 1 then '{REGIME_TITLES[4]}' end]) "case" from h, q),
    firsts as (select * from (select *, row_number() over (partition by "case" order by {KEY_SQL}, row_id) pos from hits
      where "case" is not null) where pos = 1)"""


def history_rows(v: Views):
    """The whole label window with its history features."""
    # lines meet their orders twice, for the log and for the rooms; every pass reads the stored results
    log = cut_lineage(v.exposures().drop("category"), "log")
    hist, later = features.time_window_split(log, "timestamp", settled=True)
    g = F.lit(features.global_rate(hist).first()[0]).cast("double")
    rooms = cut_lineage(plans.first_rooms(v.room(), Views.room_order).select("live_id", F.col("live_content_category").alias("r_content_category")), "rooms")
    rates = [features.smoothed_rate(hist, f"{p}_id", p, g=g) for p in ("user", "streamer")]
    base = later.select("row_id", "user_id", "streamer_id", "live_id", "clicked")
    rated = features.join_history(base, *rates, g, ["row_id"])
    placed = lookup_join(rated, rooms, ["live_id"], ["row_id"], hot_from=base.select("live_id"))
    by_category = features.category_rate_by_room(hist, rooms, "r_content_category")
    categories = base.select("live_id").join(rooms, "live_id", "left").select("r_content_category")
    full = features.join_category_rate(placed, by_category, "r_content_category", g, ["row_id"], hot_from=categories)
    # a modelling table is a stored table; examples look at it once per quantile
    return cut_lineage(full.drop("user_id", "streamer_id", "live_id"), "history-rows")


@query(
    "regime_examples",
    HISTORY_VIEWS,
    f""", {REGIME_SQL}
       select t."case", row_id, clicked::bigint clicked, round(user_ctr, 6) user_ctr, user_n::bigint user_n,
       round(streamer_ctr, 6) streamer_ctr, streamer_n::bigint streamer_n, round(cat_ctr, 6) cat_ctr, r_content_category
       from titles t left join firsts f on t."case" = f."case" """,
)
def regime_examples(v: Views):
    rows = history_rows(v)
    return sampling.regime_examples(rows, sampling.click_regimes(rows, REGIME_TITLES), "row_id")


@query(
    "example_card",
    HISTORY_VIEWS,
    f""", {REGIME_SQL}
       select "case", row_id, clicked::bigint truth, (user_ctr >= 0.4e0)::bigint pred, ((user_ctr >= 0.4e0)::int = clicked)::bigint correct,
       unnest(['user_ctr', 'user_n', 'streamer_ctr', 'streamer_n', 'cat_ctr', 'r_content_category']) feature,
       unnest([round_even(user_ctr * 1e4, 0) / 1e4, user_n, round_even(streamer_ctr * 1e4, 0) / 1e4, streamer_n, round_even(cat_ctr * 1e4, 0) / 1e4, null]::double[]) number,
       unnest([null, null, null, null, null, coalesce(r_content_category, 'nan')]) as text from firsts""",
)
def example_card(v: Views):
    rows = history_rows(v)
    examples = sampling.regime_examples(rows, sampling.click_regimes(rows, REGIME_TITLES), "row_id")
    preds = rows.select("row_id", C.threshold(F.col("user_ctr"), 0.4).alias("hard"))
    cards = sampling.example_card(examples, preds, CARD_FEATURES)
    number = F.col("value").try_cast("double")
    return cards.select(
        "case", "row_id", "truth", "pred", "correct", F.explode("key_features").alias("feature", "value")
    ).select(
        "case", "row_id", "truth", "pred", "correct", "feature",
        F.when(F.col("feature") != "r_content_category", number).alias("number"),
        F.when(F.col("feature") == "r_content_category", F.col("value")).alias("text"),
    )


@query(
    "batch_plan",
    "v_events",
    """select epoch, epoch * per + b as step, b as batch, row_id,
       round(1e2 * greatest(0e0, 1e0 - (epoch * per + b) / (per * 2)), 6) as rate
       from (select epoch, row_id, (select count(*) // 128 from v_events) per,
         (row_number() over (partition by epoch order by md5((42 + epoch)::varchar || ':' || row_id::varchar)) - 1) // 128 b
         from v_events, (select unnest(range(2)) epoch)) where b < per""",
)
def batch_plan(v: Views):
    plan = sampling.batch_plan(
        v.events().select("row_id"), "row_id", DEFAULTS.plain_batch, DEFAULTS.epochs, DEFAULTS.learning_rate
    )
    # a rate of 1e-4 would vanish in 6 digits
    return plan.withColumn("rate", F.col("lr") * 1e6).drop("lr")


@query(
    "placebo_shuffle",
    "v_rationales",
    """select a.row_id, a.label::bigint as label, b.rationale
       from (select *, row_number() over (order by md5('0:row:' || row_id)) pos from v_rationales) a
       join (select *, row_number() over (order by md5('0:text:' || row_id)) pos from v_rationales) b using (pos)""",
)
def placebo_shuffle(v: Views):
    return sampling.placebo_shuffle(v.rationales(), "row_id", "rationale", DEFAULTS.placebo_seed)


RANKING_SQL = """ranked as (select o_orderpriority as method, l_quantity::bigint::varchar as feature,
    row_number() over (partition by o_orderpriority order by count(*) desc, l_quantity::bigint) "rank" from lines
    group by o_orderpriority, l_quantity::bigint)"""


@query(
    "top_k_features",
    "lines",
    f""", {RANKING_SQL}
       select 'top' part, method, feature, "rank" from ranked where "rank" <= 5
       union all select 'bottom', method, feature, "rank" from ranked r
       where "rank" > (select count(*) from ranked s where s.method = r.method) - 10""",
)
def top_k_features(v: Views):
    quantity = F.col("l_quantity").cast("bigint").alias("quantity")  # 50 values at every table size
    counts = v.lines().groupBy(F.col("o_orderpriority").alias("method"), quantity).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("method").orderBy(F.desc("n"), "quantity")
    ranked = counts.select("method", F.col("quantity").cast("string").alias("feature"), F.row_number().over(order).alias("rank"))
    top = sampling.top_k(ranked, 5).withColumn("part", F.lit("top"))
    return top.unionByName(sampling.top_k(ranked, 10, tail=True).withColumn("part", F.lit("bottom")))
