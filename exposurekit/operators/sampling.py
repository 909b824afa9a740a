"""Seeded samples and splits of exact size, and orders derived from them.

The order of a table is the md5 order of its row identity, so the same rows are
chosen on any cluster size. Choosing rows needs only cut points in that order: two
narrow counting passes, then a filter on the scan; the chosen rows are never sorted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordinal import cut_points, exact_quantiles, seeded_key, text_key, with_ordinal
from .profile import unpivot_text
from .skew import repeat_rows

TASK_ROWS = 1_000  # beyond it Spark no longer ranks inside tasks before a shuffle


def first_per_class(
    df: DataFrame,
    label: str,
    quotas: Mapping[int, int | Column],
    identity: Sequence[str],
    seed: int | str,
    unique: bool = False,
) -> DataFrame:
    """The first ``quotas[c]`` rows of each class in the seeded order, copies of a row included.

    ``identity`` may repeat: rows that agree on it are interchangeable copies, and as
    many of them are kept as the quota has room for. ``unique`` says it never repeats.
    """
    key = text_key(identity)
    wanted = F.lit(None)
    for cls, quota in quotas.items():
        wanted = F.when(F.col(label) == cls, quota).otherwise(wanted)
    pool = df.filter(F.col(label).isin(*quotas))
    # one cut per listed class: the first row that is no longer wanted
    cuts = cut_points(pool, key, seed, [wanted], by=[label]).select(
        F.col(label).alias("cls"), "cut_key", (F.col("position") - F.col("before")).alias("room")
    )
    found = {r["cls"]: r for r in cuts.collect()}
    order = seeded_key(key, seed)
    kept = F.lit(False)
    for cls in quotas:
        mine = F.col(label) == cls
        kept = kept | (mine & (order < found[cls]["cut_key"]) if cls in found else mine)
    sample = pool.filter(kept)
    if unique:
        return sample
    # the groups of copies at the cuts, in one pass: one row of each, written as often as there is room
    room = F.lit(None)
    for cls, cut in found.items():
        if cut["room"]:
            room = F.when((F.col(label) == cls) & (order == cut["cut_key"]), F.lit(cut["room"])).otherwise(room)
    if not any(cut["room"] for cut in found.values()):
        return sample
    others = [c for c in df.columns if c not in identity]
    edge = pool.withColumn("_room", room).filter(F.col("_room").isNotNull()).groupBy(*identity, "_room")
    edge = edge.agg(F.min(F.struct(*others)).alias("_rest")).select(*identity, "_room", "_rest.*") if others else edge.agg(F.lit(1)).select(*identity, "_room")
    copies = repeat_rows(edge.select(*df.columns, "_room"), "_room", "_copy")
    return sample.unionByName(copies.drop("_copy"))


def balanced_sample(
    df: DataFrame,
    label: str,
    n: int,
    identity: Sequence[str],
    seed: int = 42,
    equal: bool = True,
    unique: bool = False,
) -> DataFrame:
    """Exactly min(n, class size) rows per class; with ``equal`` the smaller class bounds both."""
    if not equal:
        return first_per_class(df, label, {1: n, 0: n}, identity, seed, unique)
    smaller = df.agg(
        F.least(
            F.lit(n).cast("long"), F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
        ).alias("n")
    ).scalar()
    return first_per_class(df, label, {1: smaller, 0: smaller}, identity, seed, unique)


def prior_shift_resample(
    pool: DataFrame,
    label: str,
    rate: float,
    n: int,
    identity: Sequence[str],
    seed: int = 42,
    unique: bool = False,
) -> DataFrame:
    """First round(rate * n) positives and n minus that many negatives of the pool."""
    positives = round(rate * n)
    return first_per_class(pool, label, {1: positives, 0: n - positives}, identity, seed, unique)


def ordinal_split(
    df: DataFrame, sizes: Mapping[str, int], row_id: str, seed: int = 42, name: str = "split"
) -> DataFrame:
    """Label rows by position in the seeded order; rows past the last size get no label.

    ``sizes`` are consecutive runs, for example learn, valid, test. Rows are compared
    with the keys at the run ends; nothing is sorted or shuffled but one bucket per end.
    """
    ends, total = [], 0
    for size in sizes.values():
        total += size
        ends.append(total)
    cuts = cut_points(df, F.col(row_id), seed, ends)
    limits = cuts.agg(*[F.max(F.when(F.col("cut") == i, F.col("cut_key"))).alias(f"k{i}") for i in range(len(ends))])
    packed = limits.select(F.array(*[F.col(f"k{i}") for i in range(len(ends))])).scalar()
    keyed = df.withColumn("_key", seeded_key(F.col(row_id), seed)).withColumn("_ends", packed)
    choice = F
    for i, split in enumerate(sizes):
        end = F.col("_ends")[i]
        choice = choice.when(end.isNull() | (F.col("_key") < end), F.lit(split))
    return keyed.withColumn(name, choice.otherwise(F.lit(None).cast("string"))).drop("_key", "_ends")


def tail_split(df: DataFrame, k: int, row_id: str, seed: int = 42, name: str = "split") -> DataFrame:
    """The last ``k`` rows of the seeded order are ``test``, the rest ``train``."""
    start = df.agg((F.count(F.lit(1)) - F.lit(k)).alias("n")).scalar()
    cut = cut_points(df, F.col(row_id), seed, [F.greatest(start, F.lit(0))]).select("cut_key").scalar()
    key = seeded_key(F.col(row_id), seed)
    return df.withColumn(name, F.when(key >= cut, F.lit("test")).otherwise(F.lit("train")))


def error_sample(
    rows: DataFrame, label: str, hard: str, k: int, row_id: str, seed: int = 42, by: Sequence[str] = ()
) -> DataFrame:
    """The first ``k`` mispredicted rows in the seeded order, per group, with their ``ordinal``."""
    return first_rows(rows.filter(F.col(label) != F.col(hard)), k, row_id, seed, by)


def first_rows(df: DataFrame, k: int, row_id: str, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """First ``k`` rows per group with their position among the group's rows.

    Up to ``TASK_ROWS`` rows, each task keeps its own first k per group before the
    shuffle, and these merge in two steps, so the last one sees at most 64 * k rows of a
    group. More rows are cut off by key first, so only they are ranked.
    """
    keyed = df.withColumn("_key", seeded_key(F.col(row_id), seed))
    if k > TASK_ROWS:
        cuts = cut_points(df, F.col(row_id), seed, [k], by)
        if by:
            cuts = cuts.select(F.struct(*by).alias("_g"), F.col("cut_key").alias("_cut"))
            keyed = keyed.withColumn("_g", F.struct(*by)).join(cuts, "_g", "left").drop("_g")
        else:
            keyed = keyed.withColumn("_cut", cuts.agg(F.min("cut_key").alias("c")).scalar())
        keyed = keyed.filter(F.col("_cut").isNull() | (F.col("_key") < F.col("_cut"))).drop("_cut")
        steps = [list(by)]
    else:
        keyed = keyed.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(64)))
        steps = [[*by, "_part"], list(by)]
    for keys in steps:
        order = Window.partitionBy(*keys).orderBy("_key", row_id)
        keyed = keyed.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)
    return keyed.withColumn("ordinal", F.col("_rank") - 1).drop("_rank", "_key", "_part")


def regime_examples(
    df: DataFrame,
    regimes: Mapping[str, Column],
    row_id: str,
    seed: int = 42,
) -> DataFrame:
    """The first row (seeded order) that meets each regime; regimes without a row stay, with nulls.

    ``regimes`` maps a title to a condition over ``df``. A row may serve several. One pass
    keeps the best row of each regime; no row is sorted, and one row a task is shuffled.
    """
    key = F.struct(seeded_key(F.col(row_id), seed), F.col(row_id))
    row = F.struct(*df.columns)
    found = df.agg(*[F.min_by(row, F.when(cond, key)).alias(f"_{i}") for i, cond in enumerate(regimes.values())])
    cases = [F.struct(F.lit(title).alias("case"), F.col(f"_{i}").alias("row")) for i, title in enumerate(regimes)]
    return found.select(F.explode(F.array(*cases)).alias("c")).select("c.case", "c.row.*")


def click_regimes(df: DataFrame, titles: Sequence[str], label: str = "clicked") -> dict[str, Column]:
    """The five standing regimes: quartiles of user and streamer rates, of activity, and of category rate."""

    long = df.unpivot([], ["user_ctr", "streamer_ctr", "user_n", "cat_ctr"], "column", "value")
    # rates and counts repeat: equal values are counted in one pass, and the quantiles' passes read the counts
    counted = cut_lineage(long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), "counted")
    found = exact_quantiles(counted, "value", {"lo": 0.25, "hi": 0.75, "top": 0.80}, by=["column"], weight="n")

    def at(column: str, share: str) -> Column:
        return F.max(F.when(F.col("column") == column, F.col(share)))

    # all limits in one pass over the four columns, as one scalar
    limits = found.agg(
        F.struct(
            at("user_ctr", "lo").alias("user_lo"),
            at("user_ctr", "hi").alias("user_hi"),
            at("streamer_ctr", "lo").alias("streamer_lo"),
            at("streamer_ctr", "hi").alias("streamer_hi"),
            at("user_n", "hi").alias("active"),
            at("cat_ctr", "top").alias("category"),
        ).alias("limits")
    ).scalar()
    u, s, n, c = (F.col(x) for x in ("user_ctr", "streamer_ctr", "user_n", "cat_ctr"))
    clicked, passed = F.col(label) == 1, F.col(label) == 0
    conditions = (
        (u >= limits["user_hi"]) & (s >= limits["streamer_hi"]) & clicked,
        (u <= limits["user_lo"]) & (s <= limits["streamer_lo"]) & passed,
        (u <= limits["user_lo"]) & (s >= limits["streamer_hi"]) & clicked,
        (n >= limits["active"]) & (s <= limits["streamer_lo"]) & passed,
        (c >= limits["category"]) & clicked,
    )
    return dict(zip(titles, conditions))


def batch_plan(
    rows: DataFrame, row_id: str, batch: int, epochs: int, learning_rate: float, seed: int = 42
) -> DataFrame:
    """Training order: one permutation per epoch, full batches only, rate falling linearly to 0."""
    total = rows.agg(F.floor(F.count(F.lit(1)) / F.lit(batch)).alias("n")).scalar()
    spread = rows.select(row_id).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    placed = with_ordinal(spread, row_id, F.col("epoch") + F.lit(seed), by=["epoch"])
    placed = placed.withColumn("per_epoch", total).withColumn("batch", F.floor(F.col("ordinal") / F.lit(batch)))
    step = F.col("epoch") * F.col("per_epoch") + F.col("batch")
    return placed.filter(F.col("batch") < F.col("per_epoch")).select(
        "epoch",
        step.alias("step"),
        "batch",
        row_id,
        (F.lit(learning_rate) * F.greatest(F.lit(0.0), F.lit(1.0) - step / (F.col("per_epoch") * epochs))).alias("lr"),
    )


def placebo_shuffle(rationales: DataFrame, row_id: str, text: str, seed: int = 0) -> DataFrame:
    """Permute texts over rows; the multiset of texts is unchanged. Two seeded orders are matched up."""
    targets = with_ordinal(rationales.drop(text), row_id, f"{seed}:row")
    texts = with_ordinal(rationales.select(row_id, text), row_id, f"{seed}:text").drop(row_id)
    return targets.join(texts, "ordinal").drop("ordinal")


def top_k(rankings: DataFrame, k: int, tail: bool = False, by: str = "method") -> DataFrame:
    """The best (or with ``tail`` the worst) ``k`` features of each ranking; ranks start at 1."""
    if not tail:
        return rankings.filter(F.col("rank") <= k)
    sizes = rankings.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    return rankings.join(sizes, by).filter(F.col("rank") > F.col("_n") - k).drop("_n")


def example_card(
    examples: DataFrame,
    preds: DataFrame,
    features: Sequence[str],
    row_id: str = "row_id",
    label: str = "clicked",
    hard: str = "hard",
) -> DataFrame:
    """Title, truth, prediction, correctness and key features (numbers to 4 digits) as a map."""
    present = [f for f in features if f in examples.columns]
    pairs = [x for f in present for x in (F.lit(f), unpivot_text(examples, f, digits=4))]
    cards = examples.filter(F.col(row_id).isNotNull()).select(
        "case", row_id, F.col(label).alias("truth"), F.create_map(*pairs).alias("key_features")
    )
    # five examples at most; the prediction table is only filtered
    joined = cards.join(preds.select(row_id, hard), row_id, "left")
    return joined.select(
        "case", row_id, "truth", F.col(hard).alias("pred"), (F.col("truth") == F.col(hard)).alias("correct"), "key_features"
    )
