"""The given tables in the roles the operators expect, in Spark and in SQL.

Every view reads whole tables. Missing keys, missing values and repeated rooms come
from how columns are derived, not from leaving rows out: supplier ids are spread out so
that some streamers have no attributes, and some categories and prices are blank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AGE_SQL = (
    "case when c_acctbal < 0 then '12-17' when c_acctbal < 2000 then '18-23' when c_acctbal < 4000 then '24-30' "
    "when c_acctbal < 6000 then '31-40' when c_acctbal < 8000 then '41-49' else '50+' end"
)
GENDER_SQL = (
    "case when c_mktsegment in ('AUTOMOBILE', 'BUILDING') then 'M' "
    "when c_mktsegment in ('FURNITURE', 'HOUSEHOLD') then 'F' end"
)

FEW_LINES = 5_000_000  # up to it partitions may be as large as Spark's own settings make them
LINES_PER_TASK = 500_000


def uniform(tag: str, key: str) -> Column:
    """Portable uniform number in [0, 1) of a key."""
    digest = F.md5(F.concat(F.lit(f"{tag}:"), F.col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_sql(tag: str, key: str) -> str:
    return f"(('0x' || substr(md5('{tag}:' || {key}::varchar), 1, 8))::bigint / 4294967296.0e0)"


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        # the test tables carry zone-free times; epoch milliseconds mean UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def lines(self) -> DataFrame:
        """Order lines with their orders. Many lines are dealt out by order, so that a task's share of them stays the same."""
        line, order = self.table("lineitem"), self.table("orders")
        rows = line.count()  # from the files' footers
        if rows > FEW_LINES:
            tasks = max(-(-rows // LINES_PER_TASK), self.spark.sparkContext.defaultParallelism)
            line, order = line.repartition(tasks, "l_orderkey"), order.repartition(tasks, "o_orderkey")
        return line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))

    def exposures(self) -> DataFrame:
        return self.lines().selectExpr(
            "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint), "
            "cast(round(l_extendedprice * 100) as bigint)) as row_id",
            "o_custkey as user_id",
            "l_orderkey as live_id",
            "l_suppkey as streamer_id",
            "unix_millis(cast(l_shipdate as timestamp)) as timestamp",
            "case when l_returnflag = 'R' then 1 else 0 end as clicked",
            "o_orderpriority as category",
        )

    def log(self) -> DataFrame:
        return self.exposures().select("user_id", "live_id", "streamer_id", "timestamp", "clicked")

    def user(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey as user_id",
            f"{AGE_SQL} as age",
            f"{GENDER_SQL} as gender",
            "cast(c_nationkey as bigint) as country",
            "c_mktsegment as device_brand",
            "c_acctbal as device_price",
            "c_nationkey as onehot_feat0",
            "c_custkey as reg_timestamp",
        )

    def streamer(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "s_suppkey + s_suppkey div 6 as streamer_id",
            "cast(s_nationkey as bigint) as country",
            "s_acctbal as device_price",
            "s_name as live_operation_tag",
            "s_nationkey as onehot_feat1",
            "s_suppkey as first_live_timestamp",
        )

    def room(self) -> DataFrame:
        return self.lines().selectExpr(
            "l_orderkey as live_id",
            "l_linestatus as live_type",
            "case when l_discount < 0.09 then o_orderpriority end as live_content_category",
            "unix_millis(cast(o_orderdate as timestamp)) as start_timestamp",
            "unix_millis(cast(l_shipdate as timestamp)) as end_timestamp",
            "cast(l_linenumber as bigint) as linenumber",
            "l_partkey as partkey",
            "l_suppkey as suppkey",
            "cast(round(l_extendedprice * 100) as bigint) as cents",
        )

    room_order = ("linenumber", "partkey", "suppkey", "cents")

    def gift(self) -> DataFrame:
        return self.lines().selectExpr(
            "o_custkey as user_id",
            "l_orderkey as live_id",
            "l_suppkey as streamer_id",
            "case when l_tax < 0.07 then l_extendedprice end as gift_price",
            "unix_millis(cast(l_shipdate as timestamp)) as timestamp",
        )

    def events(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id as row_id",
            "user_id",
            "cast(get_json_object(props, '$.k') as bigint) as streamer_id",
            "unix_millis(cast(ts as timestamp)) as timestamp",
            "value",
            "event_type",
            "case when event_type in ('click', 'purchase') then 1 else 0 end as clicked",
        )

    def modeling(self) -> DataFrame:
        """Event rows with user and streamer attributes; some attributes are missing."""
        user = self.user().selectExpr("user_id", "age u_age", "gender u_gender", "device_price u_device_price")
        streamer = self.streamer().selectExpr("streamer_id", "country s_country", "device_price s_device_price")
        joined = self.events().join(user, "user_id", "left").join(streamer, "streamer_id", "left")
        return joined.selectExpr(
            "row_id", "user_id", "streamer_id", "clicked", "event_type", "u_age", "u_gender", "u_device_price",
            "s_country", "s_device_price", "value as r_value", "timestamp",
        )

    features = ("u_age", "u_gender", "u_device_price", "s_country", "s_device_price", "r_value")

    def predictions(self) -> DataFrame:
        y = F.col("clicked")
        p_a = F.round(0.7 * uniform("a", "row_id") + 0.3 * y, 4)
        p_b = F.round(0.8 * uniform("b", "row_id") + 0.2 * y, 4)
        return (
            self.modeling()
            .select("row_id", "u_age", "u_gender", "event_type", y.alias("y"), p_a.alias("p_a"), p_b.alias("p_b"))
            .withColumns(
                {
                    "h_a": F.when(F.col("p_a") >= 0.5, 1).otherwise(0),
                    "h_b": F.when(F.col("p_b") >= 0.5, 1).otherwise(0),
                }
            )
        )

    def scored(self) -> DataFrame:
        """Both scorers in long form: row_id, scorer, y, prob, hard."""
        each = [F.struct(F.lit(s).alias("scorer"), F.col(f"p_{s}").alias("prob"), F.col(f"h_{s}").alias("hard")) for s in ("a", "b")]
        both = self.predictions().select("row_id", "y", F.explode(F.array(*each)).alias("s"))
        return both.select("row_id", "s.scorer", "y", "s.prob", "s.hard")

    def iterations(self) -> DataFrame:
        step = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("iteration")
        wide = self.predictions().select("row_id", "y", "p_a", step)
        pushed = F.col("p_a") + F.lit(0.02) * F.col("iteration") * (2 * F.col("y") - 1)
        return wide.select("row_id", "iteration", "y", F.when(pushed >= 0.5, 1).otherwise(0).alias("hard"))

    def responses(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id as row_id",
            "case event_id % 6 when 0 then concat('Answer: 1', char(10), 'Because: user_n=0') when 1 then 'Answer:0' "
            "when 2 then '1' when 3 then 'I would say 0, not 1' when 4 then 'no idea' end as text",
            "case event_id % 4 when 0 then '1' when 1 then ' 0' when 2 then 'yes' end as token",
            "round(-value / 100, 6) as logprob",
        )

    def rationales(self) -> DataFrame:
        return self.table("events").selectExpr(
            "cast(event_id as string) as row_id",
            "concat(event_type, ' event worth ', cast(value as string), ' by user ', cast(user_id as string)) as rationale",
            "case when event_type in ('click', 'purchase') then 1 else 0 end as label",
        )

    def usage(self) -> DataFrame:
        return self.table("events").selectExpr(
            "user_id as run",
            "event_id as call",
            "case event_id % 3 when 0 then 'gpt-4o' when 1 then 'gpt-4o-mini' else 'other' end as model",
            "case event_id % 2 when 0 then 'paid' else 'credit' end as provider",
            "cast(round(value * 1000) as bigint) as tokens_in",
            "cast(round(value * 100) as bigint) as tokens_out",
        )


CTES: dict[str, tuple[Sequence[str], str]] = {
    "lines": ((), "select * from lineitem join orders on l_orderkey = o_orderkey"),
    "v_exposures": (
        ("lines",),
        """select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint),
             cast(round(l_extendedprice * 100) as bigint)) as row_id,
           o_custkey as user_id, l_orderkey as live_id, l_suppkey as streamer_id, epoch_ms(l_shipdate) as timestamp,
           case when l_returnflag = 'R' then 1 else 0 end as clicked, o_orderpriority as category from lines""",
    ),
    "v_log": (("v_exposures",), "select user_id, live_id, streamer_id, timestamp, clicked from v_exposures"),
    "v_user": (
        (),
        f"""select c_custkey as user_id, {AGE_SQL} as age, {GENDER_SQL} as gender, c_nationkey::bigint as country,
           c_mktsegment as device_brand, c_acctbal as device_price from customer""",
    ),
    "v_streamer": (
        (),
        """select s_suppkey + s_suppkey // 6 as streamer_id, s_nationkey::bigint as country,
           s_acctbal as device_price, s_name as live_operation_tag from supplier""",
    ),
    "v_room": (
        ("lines",),
        """select l_orderkey as live_id, l_linestatus as live_type,
           case when l_discount < 0.09e0 then o_orderpriority end as live_content_category,
           epoch_ms(o_orderdate) as start_timestamp, epoch_ms(l_shipdate) as end_timestamp,
           l_linenumber::bigint as linenumber, l_partkey as partkey, l_suppkey as suppkey,
           cast(round(l_extendedprice * 100) as bigint) as cents from lines""",
    ),
    "v_rooms": (
        ("v_room",),
        """select * exclude (rn) from (select *, row_number() over (partition by live_id
           order by linenumber, partkey, suppkey, cents) rn from v_room) where rn = 1""",
    ),
    "v_gift": (
        ("lines",),
        """select o_custkey as user_id, l_orderkey as live_id, l_suppkey as streamer_id,
           case when l_tax < 0.07e0 then l_extendedprice end as gift_price, epoch_ms(l_shipdate) as timestamp from lines""",
    ),
    "v_sessions": (
        ("v_gift",),
        """select user_id, live_id, streamer_id, coalesce(sum(gift_price), 0e0) as total_gift_price,
           count(gift_price) as gift_count, min(timestamp) as first_gift_ts from v_gift group by all""",
    ),
    "v_events": (
        (),
        """select event_id as row_id, user_id, (props ->> '$.k')::bigint as streamer_id, epoch_us(ts) // 1000 as timestamp,
           value, event_type, case when event_type in ('click', 'purchase') then 1 else 0 end as clicked from events""",
    ),
    "v_modeling": (
        ("v_events", "v_user", "v_streamer"),
        """select row_id, e.user_id, e.streamer_id, clicked, event_type, u.age u_age, u.gender u_gender,
           u.device_price u_device_price, s.country s_country, s.device_price s_device_price, value r_value, timestamp
           from v_events e left join v_user u on e.user_id = u.user_id left join v_streamer s on e.streamer_id = s.streamer_id""",
    ),
    "v_line": (
        ("v_modeling",),
        """select *, 'user.age=' || coalesce(u_age, 'nan') || ' | user.gender=' || coalesce(u_gender, 'nan')
           || ' | user.device_price=' || coalesce(u_device_price::varchar, 'nan')
           || ' | streamer.country=' || coalesce(s_country::varchar, 'nan')
           || ' | streamer.device_price=' || coalesce(s_device_price::varchar, 'nan')
           || ' | room.value=' || coalesce(r_value::varchar, 'nan') as line from v_modeling""",
    ),
    "v_predictions": (
        ("v_modeling",),
        f"""select *, case when p_a >= 0.5e0 then 1 else 0 end h_a, case when p_b >= 0.5e0 then 1 else 0 end h_b from (
           select row_id, u_age, u_gender, event_type, clicked y,
           round(0.7e0 * {uniform_sql('a', 'row_id')} + 0.3e0 * clicked, 4) p_a,
           round(0.8e0 * {uniform_sql('b', 'row_id')} + 0.2e0 * clicked, 4) p_b from v_modeling)""",
    ),
    "v_scored": (
        ("v_predictions",),
        """select row_id, 'a' scorer, y, p_a prob, h_a hard from v_predictions
           union all select row_id, 'b', y, p_b, h_b from v_predictions""",
    ),
    "v_iterations": (
        ("v_predictions",),
        """select row_id, iteration, y, case when p_a + 0.02e0 * iteration * (2 * y - 1) >= 0.5e0 then 1 else 0 end hard
           from v_predictions, (select unnest(range(4)) iteration)""",
    ),
    "v_responses": (
        (),
        """select event_id row_id, case event_id % 6 when 0 then 'Answer: 1' || chr(10) || 'Because: user_n=0'
           when 1 then 'Answer:0' when 2 then '1' when 3 then 'I would say 0, not 1' when 4 then 'no idea' end as text,
           case event_id % 4 when 0 then '1' when 1 then ' 0' when 2 then 'yes' end as token,
           round(-value / 100, 6) as logprob from events""",
    ),
    "v_rationales": (
        (),
        """select event_id::varchar row_id, event_type || ' event worth ' || value::varchar || ' by user ' || user_id::varchar rationale,
           case when event_type in ('click', 'purchase') then 1 else 0 end label from events""",
    ),
    "v_usage": (
        (),
        """select user_id run, event_id call, case event_id % 3 when 0 then 'gpt-4o' when 1 then 'gpt-4o-mini' else 'other' end model,
           case event_id % 2 when 0 then 'paid' else 'credit' end provider, cast(round(value * 1000) as bigint) tokens_in,
           cast(round(value * 100) as bigint) tokens_out from events""",
    ),
    "v_cut": (
        ("v_exposures",),
        "select min(timestamp) + 0.6e0 * (max(timestamp) - min(timestamp)) cutoff from v_exposures",
    ),
    "v_hist": (("v_exposures", "v_cut"), "select e.* from v_exposures e, v_cut where timestamp < cutoff"),
    "v_later": (("v_exposures", "v_cut"), "select e.* from v_exposures e, v_cut where timestamp >= cutoff"),
    "v_g": (("v_hist",), "select avg(clicked::double) g from v_hist"),
    "v_user_rate": (
        ("v_hist", "v_g"),
        """select user_id, (sum(clicked) + 20e0 * any_value(g)) / (count(*) + 20e0) user_ctr, count(*) user_n
           from v_hist, v_g where user_id is not null group by user_id""",
    ),
    "v_streamer_rate": (
        ("v_hist", "v_g"),
        """select streamer_id, (sum(clicked) + 20e0 * any_value(g)) / (count(*) + 20e0) streamer_ctr, count(*) streamer_n
           from v_hist, v_g where streamer_id is not null group by streamer_id""",
    ),
    "v_cat_rate": (
        ("v_hist", "v_rooms"),
        """select live_content_category, avg(clicked::double) cat_ctr from v_hist join v_rooms using (live_id)
           where live_content_category is not null group by 1""",
    ),
}


def with_views(views: str, body: str) -> str:
    """``body`` headed by the named views and everything they need."""
    wanted: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in wanted:
            wanted.append(name)

    for name in views.split():
        visit(name)
    heads = ",\n".join(f"{name} as ({CTES[name][1]})" for name in wanted)
    return f"with {heads}\n{body}" if heads else body
