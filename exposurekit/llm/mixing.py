"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a seeded order, passed up to ``repeats``
times. A document's virtual finish time is the words its source has sent up to and
including it, over the source's target. Documents of all sources are put in the order
of their finish times and cut off at the total budget, so at any point the sources
have sent their shares of it; the last document may be taken in part.

Null text has size 0; documents of size 0 are not taken. A missing source is a source
of its own, after all others. Rows that agree in doc_id are told apart by their place
in the queue. Equal finish times go by doc_id. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
SEED = 42
QUEUE_DIGITS = 3  # hex digits of the order key that make a bucket: 4,096 in every source
TIME_BUCKETS = 4_096  # per unit of virtual time, in which every source sends its target


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words between white space."""
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words.cast("long").alias("size"))


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target): ``share`` of all words by weight, at most ``repeats`` times the source's own.

    What sources at their limit cannot take goes to the others by weight. Sources are
    put in the order in which they reach their limits as the level rises; the level is
    the first at which the next source stays below its own. One row per source.
    """
    table = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    table = table.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))
    table = table.withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    rising = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.asc_nulls_last("source"))
    ahead, onward = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    table = table.withColumn(
        "level", (budget - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))) / F.sum("weight").over(onward)
    ).withColumn("turn", F.row_number().over(rising))
    fits = F.col("weight") * F.col("level") <= F.col("cap")
    level = F.min(F.when(fits, F.struct("turn", "level"))).over(Window.partitionBy())["level"]
    table = table.withColumn("given", F.col("weight") * level)
    target = F.when(F.col("given").isNull() | (F.col("given") >= F.col("cap")), F.col("cap")).otherwise(F.col("given"))
    return table.select("source", "source_size", target.alias("target"))


def running(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Inclusive running sum ``name`` of ``value`` per ``by``, along buckets and inside them along ``order``.

    Buckets follow the order. Only their totals are summed over a whole group, so no
    group's rows meet in one task.
    """
    group = F.struct(*[F.col(c) for c in by], bucket.alias("_bucket"))
    keyed = df.withColumn("_g", group)
    totals = keyed.groupBy("_g").agg(F.sum(value).alias("_all"))
    along = Window.partitionBy(*[F.col(f"_g.{c}") for c in by]).orderBy("_g._bucket")
    totals = totals.withColumn("_before", F.sum("_all").over(along) - F.col("_all")).drop("_all")
    inside = Window.partitionBy("_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = keyed.withColumn("_here", F.sum(value).over(inside))
    return summed.join(totals, "_g").withColumn(name, F.col("_before") + F.col("_here")).drop("_g", "_before", "_here")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document of ``docs`` (doc_id, source, text)."""
    sized = stored(sizes(docs), "mixing-sizes")
    table = stored(targets(sized, weights, share, repeats), "mixing-targets")
    budget = table.agg(F.floor(F.sum("source_size") * F.lit(share)).alias("budget")).first()["budget"] or 0
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("~"))))
    queued = sized.filter("size > 0").withColumn("key", key)
    queued = running(queued, ["source"], F.substring("key", 1, QUEUE_DIGITS), ["key", "doc_id", "size"], "size", "sent")
    same = queued["source"].eqNullSafe(table["source"])
    queued = stored(queued.join(table, same).drop(table["source"]).drop("key"), "mixing-queues")
    passes = queued.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    finish = (F.col("pass") * F.col("source_size") + F.col("sent")) / F.col("target")
    raced = running(
        passes.withColumn("finish", finish),
        [],
        F.floor(F.col("finish") * TIME_BUCKETS),
        ["finish", "doc_id", "source", "pass", "sent"],
        "size",
        "spent",
    )
    taken = F.greatest(F.lit(0), F.least("size", F.lit(budget) - F.col("spent") + F.col("size")))
    # place in the queue of its source tells a document from every other
    sums = raced.groupBy("source", "sent").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("size").alias("size"),
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.sum(taken).cast("long").alias("taken"),
    )
    empty = sized.filter("size = 0")
    empty = empty.join(table, empty["source"].eqNullSafe(table["source"])).select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return sums.select(*empty.columns).unionByName(empty)


ORACLE = """
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
per as (select source, sum(size)::bigint as source_size from sized group by source),
weighted as (
  select *, ([3.0, 1.0, 2.0])[1 + (row_number() over (order by source asc nulls last) - 1) % 3]::double as weight,
    2.0::double * source_size as cap from per),
leveled as (
  select *, ((select sum(source_size) from per)::double * 1.5::double
      - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
      / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level,
    row_number() over (order by cap / weight, source nulls last) as turn from weighted),
chosen as (select arg_min(level, turn) as level from leveled where weight * level <= cap),
targets as (
  select source, source_size, case when c.level is null or weight * c.level >= cap then cap else weight * c.level end as target
  from leveled cross join chosen c),
queued as (
  select s.*, t.source_size, t.target,
    sum(size) over (partition by s.source order by md5('42:' || coalesce(doc_id::varchar, '~')), doc_id rows unbounded preceding)::bigint as sent
  from sized s join targets t on s.source is not distinct from t.source where size > 0),
raced as (
  select *, sum(size) over (order by (pass * source_size + sent) / target, doc_id, source, pass, sent rows unbounded preceding) as spent
  from queued cross join (select unnest([0, 1]) as pass)),
budget as (select floor(sum(source_size)::double * 1.5::double)::bigint as budget from per)
select doc_id, any_value(size) as size, any_value(source_size) as source_size, any_value(target) as target,
  sum(greatest(0, least(size, budget - spent + size)))::bigint as taken
from raced cross join budget group by source, sent, doc_id
union all
select doc_id, size, source_size, target, 0::bigint from sized s join targets t on s.source is not distinct from t.source where size = 0
"""
