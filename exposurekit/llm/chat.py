"""Chat formatting by perspective rotation, with built-in functions only.

A dialogue is rendered once for every participant: that speaker's turns as
``assistant``, the others' as ``user`` with their names, context roles (``system``) as
they are. The mask holds the spans of code points to learn from: the assistant's
texts with their end marks.

Turns go by number, then by a digest of role and text. Rows that agree in all of
these are one turn. A missing role is the name ``unknown``, null text is empty, a
missing conv_id is a conversation of its own, a missing turn number comes first. A
conversation of more than ``max_turns`` turns is rendered in parts of that many, every
part for every participant of the conversation: a perspective's parts, one after the
other, are the whole dialogue, and masks count code points from its start. A
conversation that only has context roles has no perspective and no row. No rows: no
rows. Very long texts are whole; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordinal import value_bucket, value_limits
from .common import stored
from .mixing import running

MAX_TURNS = 256
CONTEXT_ROLES = ("system",)
START, END = "<|im_start|>", "<|im_end|>"
UNNAMED = "unknown"


def _placed(rows: DataFrame, max_turns: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``part``, of conversations of one part and of several. Only turns of longer conversations need their position; it is a running count in buckets."""
    sizes = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_turns).drop("_n")
    sizes = stored(sizes, "long-conversations")
    short = rows.join(sizes, "conv", "left_anti").withColumn("part", F.lit(0).cast("long"))
    long = stored(rows.join(sizes, "conv", "left_semi"), "long-turns")
    limits = value_limits(long, "turn")
    at = [value_bucket(F.col("turn") + shift, limits, T.LongType()) for shift in (-1, 0, 1)]
    # a bucket that is one turn number is cut further by the digest, which is the order inside it
    digit = F.when((at[0] != at[1]) & (at[1] != at[2]), F.substring("tie", 1, 2)).otherwise(F.lit("00"))
    bucket = F.format_string("%05d%s", at[1], digit)
    counted = running(long.withColumn("_one", F.lit(1)), ["conv"], bucket, ["turn", "tie"], "_one", "_at")
    part = F.floor((F.col("_at") - 1) / max_turns).cast("long")
    return short, counted.withColumn("part", part).select(*short.columns)


def _turn_points(context: Column, perspective: Column) -> Column:
    """Code points of a rendered turn as ``perspective`` sees it."""
    named = F.length(F.col("role")) + len("user name=")
    speaker = F.when(F.col("role") == perspective, F.lit(len("assistant"))).when(F.array_contains(context, F.col("role")), F.length("role")).otherwise(named)
    return (len(START) + speaker + 1 + F.length("text") + len(END) + 1).cast("long")


def rotate(turns: DataFrame, max_turns: int = MAX_TURNS, context_roles: Sequence[str] = CONTEXT_ROLES) -> DataFrame:
    """(conv_id, part, perspective, n_turns, own_turns, rendered, masks) of ``turns`` (conv_id, turn, role, text).

    ``masks``: array of (start, end) in code points of ``rendered``.
    """
    name = F.coalesce(F.col("role"), F.lit(UNNAMED)).alias("role")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), name, F.coalesce("text", F.lit("")).alias("text")).distinct()
    rows = rows.withColumn("conv", F.struct("conv_id")).withColumn("tie", F.md5(F.concat("role", F.lit(":"), "text")))
    context = F.array(*[F.lit(r) for r in context_roles]).cast("array<string>")
    short, long = _placed(rows, max_turns)

    def parts(of: DataFrame) -> DataFrame:
        return of.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "tie", "role", "text"))).alias("turns"))

    speakers = F.array_except(F.array_distinct(F.transform("turns", lambda t: t["role"])), context)
    participants = long.filter(~F.array_contains(context, F.col("role"))).select("conv", F.col("role").alias("perspective")).distinct()
    views = parts(short).withColumn("perspective", F.explode(speakers)).unionByName(parts(long).join(participants, "conv"))

    def piece(t: Column) -> Column:
        own = t["role"] == F.col("perspective")
        speaker = F.when(own, F.lit("assistant")).when(F.array_contains(context, t["role"]), t["role"]).otherwise(F.concat(F.lit("user name="), t["role"]))
        return F.struct(F.concat(F.lit(START), speaker, F.lit("\n")).alias("head"), t["text"].alias("text"), own.alias("own"))

    views = views.withColumn("pieces", F.transform("turns", piece))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        low = acc["at"] + F.length(p["head"])
        high = low + F.length(p["text"]) + len(END)
        spans = F.when(p["own"], F.concat(acc["spans"], F.array(F.struct(low.alias("start"), high.alias("end"))))).otherwise(acc["spans"])
        return F.struct((high + 1).alias("at"), spans.alias("spans"))

    rendered = views.select(
        "conv",
        "part",
        "perspective",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("own_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], F.lit(END + "\n"))), "").alias("rendered"),
        F.aggregate("pieces", start, step)["spans"].alias("masks"),
    )
    key = ["conv", "perspective", "part"]
    # where parts begin: only conversations of several parts have any behind the first
    before = F.sum("chars").over(Window.partitionBy("conv", "perspective").orderBy("part")) - F.col("chars")
    sizes = long.select("conv", "part", "role", _turn_points(context, F.lit("")).alias("n"), _turn_points(context, F.col("role")).alias("own"))
    in_part = sizes.groupBy("conv", "part").agg(F.sum("n").alias("n"))
    own = sizes.groupBy("conv", "part", F.col("role").alias("perspective")).agg(F.sum(F.col("own") - F.col("n")).alias("more"))
    spans = in_part.join(participants, "conv").join(own, ["conv", "part", "perspective"], "left")
    spans = spans.withColumn("chars", F.col("n") + F.coalesce("more", F.lit(0))).select(*key, before.alias("_from")).filter("part > 0")
    placed = rendered.join(spans, key, "left")
    low = F.coalesce("_from", F.lit(0))
    moved = F.transform("masks", lambda m: F.struct((m["start"] + low).alias("start"), (m["end"] + low).alias("end")))
    return placed.select("conv.conv_id", *[c for c in rendered.columns if c not in ("conv", "masks")], moved.alias("masks"))


def digest(rotated: DataFrame) -> DataFrame:
    """Masks as text ``start:end,...`` and the number of code points in them."""
    text = F.array_join(F.transform("masks", lambda m: F.concat(m["start"].cast("string"), F.lit(":"), m["end"].cast("string"))), ",")
    chars = F.aggregate("masks", F.lit(0).cast("long"), lambda acc, m: acc + m["end"] - m["start"])
    return rotated.withColumn("trained_chars", chars).withColumn("masks", text)


ORACLE = f"""
with turns as (
  select distinct conv_id, turn, coalesce(role, '{UNNAMED}') as role, coalesce(text, '') as text from conversations),
placed as (
  select *, md5(role || ':' || text) as tie,
    (row_number() over (partition by conv_id order by turn nulls first, md5(role || ':' || text)) - 1) // {MAX_TURNS} as part from turns),
speakers as (select distinct conv_id, role as perspective from placed where role <> 'system'),
pieces as (
  select p.conv_id, p.part, perspective, turn, tie, role = perspective as own,
    '{START}' || case when role = perspective then 'assistant' when role = 'system' then role else 'user name=' || role end || chr(10) as head, text
  from placed p join speakers s on p.conv_id is not distinct from s.conv_id),
measured as (
  select *, sum(length(head) + length(text) + {len(END) + 1}) over (
      partition by conv_id, perspective order by turn nulls first, tie rows unbounded preceding)
    - length(text) - {len(END) + 1} as low from pieces)
select conv_id, part::bigint as part, perspective, count(*)::bigint as n_turns, count(*) filter (own)::bigint as own_turns,
  string_agg(head || text || '{END}' || chr(10), '' order by turn nulls first, tie) as rendered,
  coalesce(string_agg(low::bigint || ':' || (low + length(text) + {len(END)})::bigint, ',' order by turn nulls first, tie) filter (own), '') as masks,
  coalesce(sum(length(text) + {len(END)}) filter (own), 0)::bigint as trained_chars
from measured group by conv_id, part, perspective
"""
