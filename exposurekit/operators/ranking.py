"""Feature rankings and how well they explain a model: deletion and stability."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import threshold
from ..session import cut_lineage
from .models import Scorer, StatedScorer, swapped_probability
from .ordinal import with_ordinal
from .trees import TreeScorer, permutation_losses


def as_ranking(spark, method: str, features: Sequence[str], importance: Mapping[str, float]) -> DataFrame:
    """``method, feature, rank, importance``; equal importances keep list order."""
    order = sorted(features, key=lambda f: -importance.get(f, 0.0))
    rows = [(method, f, i, float(importance.get(f, 0.0))) for i, f in enumerate(order, start=1)]
    return spark.createDataFrame(rows, "method string, feature string, rank int, importance double")


def random_ranking(spark, features: Sequence[str], seed: int = 42, method: str = "Random") -> DataFrame:
    """A control: features in the md5 order of ``seed:feature``."""
    order = sorted(features, key=lambda f: hashlib.md5(f"{seed}:{f}".encode()).hexdigest())
    return as_ranking(spark, method, order, {})


def per_feature(slots: Sequence[str], values: Mapping[int, float]) -> dict[str, float]:
    """Sum of slot values by the feature behind each slot."""
    out: dict[str, float] = {}
    for slot, value in values.items():
        out[slots[slot]] = out.get(slots[slot], 0.0) + value
    return out


def used_slots(model) -> dict[int, float]:
    """Vector positions a model looks at. Permuting any other position changes nothing."""
    vector = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    return {i: float(v) for i, v in enumerate(vector.toArray()) if v != 0}


def tree_importance_ranking(spark, scorer: Scorer | TreeScorer, method: str = "SparseTree") -> DataFrame:
    if isinstance(scorer, TreeScorer):
        return as_ranking(spark, method, scorer.encoder.features, scorer.importances())
    importance = per_feature(scorer.encoder.slots, used_slots(scorer.model))
    return as_ranking(spark, method, scorer.encoder.features, importance)


def permutation_importance(
    scorer: Scorer, test: DataFrame, label: str = "clicked", row_id: str = "row_id", repeats: int = 5, seed: int = 42
) -> DataFrame:
    """``slot, loss``: mean accuracy lost when one encoded column is permuted, over ``repeats`` permutations.

    A permutation matches the rows' seeded order with a second one; every repeat has its
    own, used for each column in turn. Rows move as codes of the features the model looks
    at (a level's index, a number, a gap), never as vectors. Between a row and its donor a
    one-hot feature differs in two columns at most, a number in one; only these are swapped
    and scored again, as an expression of the model. All columns and repeats are one job.
    """
    encoder, model = scorer.encoder, scorer.model
    weights = used_slots(model)
    starts = dict(zip([*encoder.categorical, *(f"{f}__num" for f in encoder.numeric), *(f"{f}__gap" for f in encoder.flagged)], encoder.slots.starts))
    widths = {f: encoder.sizes.get(f, 1) for f in starts}
    seen = [c for c in starts if any(starts[c] <= s < starts[c] + widths[c] for s in weights)]
    column = {c: f"{c}__index" if c in encoder.sizes else c for c in seen}
    codes = F.struct(*[F.col(column[c]).cast("double").alias(f"c{i}") for i, c in enumerate(seen)]) if seen else F.struct(F.lit(0.0).alias("c"))
    coded = encoder.coded(test.select(row_id, F.col(label).alias("_y"), *encoder.features)).withColumn("_codes", codes)
    scored = model.transform(encoder.assembled(coded, [row_id, "_y", "_codes"]))
    margin = vector_to_array(F.col("rawPrediction"))[1]  # of the two classes: their log-odds in a logistic model
    prob = vector_to_array(F.col("probability"))[1]
    base = cut_lineage(scored.select(row_id, "_y", "_codes", margin.alias("_margin"), threshold(prob).alias("_before")), "base")
    takers = with_ordinal(base, row_id, f"{seed}:rows")
    donors = base.select(row_id, F.col("_codes").alias("_donor"), F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    donors = donors.withColumn("_seed", F.concat_ws(":", F.lit(str(seed)), "repeat"))
    donors = with_ordinal(donors, row_id, F.col("_seed"), by=["repeat"]).select("ordinal", "_donor")

    def swap(slot: Column, old: Column, new: Column) -> Column:
        return F.struct(slot.cast("int").alias("slot"), old.alias("old"), new.alias("new"))

    swaps = []
    for i, c in enumerate(seen):
        mine, other = F.col(f"_codes.c{i}"), F.col(f"_donor.c{i}")
        differ = ~mine.eqNullSafe(other)
        if c in encoder.sizes:  # an unseen level has no column of its own
            swaps.append(F.when(differ & mine.isNotNull(), swap(mine + starts[c], F.lit(1.0), F.lit(0.0))))
            swaps.append(F.when(differ & other.isNotNull(), swap(other + starts[c], F.lit(0.0), F.lit(1.0))))
        else:
            swaps.append(F.when(differ, swap(F.lit(starts[c]), mine, other)))
    none = F.array().cast("array<struct<slot:int,old:double,new:double>>")
    changed = takers.join(donors, "ordinal").withColumn("_s", F.explode(F.array_compact(F.array(*swaps)) if swaps else none))
    used = test.sparkSession.createDataFrame([(int(s), w) for s, w in weights.items()], "slot int, weight double")  # the model's own size
    changed = changed.select("_y", "_before", "_margin", "_codes", "_s.*").join(F.broadcast(used), "slot")

    def value(s: int) -> Column:
        i, c = next((i, c) for i, c in enumerate(seen) if starts[c] <= s < starts[c] + widths[c])
        own = F.col(f"_codes.c{i}")
        if c in encoder.sizes:
            own = F.when(own == s - starts[c], F.lit(1.0)).otherwise(F.lit(0.0))
        return F.when(F.col("slot") == s, F.col("new")).otherwise(own)

    after = threshold(swapped_probability(model, value, F.col("_margin"), F.col("weight") * (F.col("new") - F.col("old"))))
    lost = (F.col("_before") == F.col("_y")).cast("int") - (after == F.col("_y")).cast("int")
    n = base.agg(F.count(F.lit(1)).alias("n")).scalar()
    return changed.groupBy("slot").agg(F.sum(lost).alias("_lost")).select("slot", (F.col("_lost") / (n * F.lit(repeats))).alias("loss"))


def permutation_ranking(
    scorer: Scorer | TreeScorer,
    test: DataFrame,
    label: str = "clicked",
    row_id: str = "row_id",
    repeats: int = 5,
    seed: int = 42,
    method: str = "Permutation",
) -> DataFrame:
    if isinstance(scorer, TreeScorer):
        per_column = permutation_losses(scorer, test, label, row_id, repeats, seed)
        found = per_column.groupBy("feature").agg(F.sum("lost").alias("lost")).collect()  # features the tree tests
        n = max(test.count(), 1) * repeats
        importance = {r["feature"]: r["lost"] / n for r in found}
        return as_ranking(test.sparkSession, method, scorer.encoder.features, importance)
    # one row per encoded column
    losses = {r["slot"]: r["loss"] for r in permutation_importance(scorer, test, label, row_id, repeats, seed).collect()}
    return as_ranking(test.sparkSession, method, scorer.encoder.features, per_feature(scorer.encoder.slots, losses))


# --- ablation -------------------------------------------------------------------------


def impute_map(impute: DataFrame) -> Column:
    """``feature, value`` rows (one per feature) as one map, a scalar subquery."""
    return impute.agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m")).scalar()


def neutral_type(df: DataFrame, feature: str, numeric: Sequence[str]) -> T.DataType:
    """A numeric feature becomes double, its mean need not be whole."""
    return T.DoubleType() if feature in numeric else df.schema[feature].dataType


def ablate(df: DataFrame, features: Sequence[str], impute: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Replace the listed features by their train mean or mode."""
    values = df.withColumn("_impute", impute_map(impute))
    return values.withColumns(
        {f: F.try_element_at("_impute", F.lit(f)).cast(neutral_type(df, f, numeric)) for f in features}
    ).drop("_impute")


def ablated_variants(
    df: DataFrame, variants: Mapping[str, Sequence[str]], features: Sequence[str], impute: DataFrame, numeric: Sequence[str]
) -> DataFrame:
    """Every row once per variant, with that variant's features neutralised. One scan for all."""
    listed = F.array(
        *[
            F.struct(
                F.lit(name).alias("variant"),
                (F.array(*[F.lit(f) for f in killed]) if killed else F.array().cast("array<string>")).alias("killed"),
            )
            for name, killed in variants.items()
        ]
    )
    spread = df.withColumn("_impute", impute_map(impute)).withColumn("_v", F.explode(listed))
    spread = spread.select("*", "_v.variant", "_v.killed").drop("_v")

    def neutral(f: str) -> Column:
        kind = neutral_type(df, f, numeric)
        value = F.try_element_at("_impute", F.lit(f)).cast(kind)
        return F.when(F.array_contains("killed", f), value).otherwise(F.col(f).cast(kind))

    touched = {f for killed in variants.values() for f in killed}
    return spread.withColumns({f: neutral(f) for f in features if f in touched}).drop("_impute", "killed")


def ranking_lists(rankings: DataFrame) -> dict[str, list[str]]:
    """method -> features best first (methods times features rows)."""
    out: dict[str, list[str]] = {}
    for row in rankings.select("method", "feature", "rank").orderBy("method", "rank").collect():
        out.setdefault(row["method"], []).append(row["feature"])
    return out


def variant_outcomes(
    scorer: Scorer | TreeScorer | StatedScorer,
    test: DataFrame,
    rankings: DataFrame,
    impute: DataFrame,
    ks: Sequence[int] = (1, 3, 5),
    bottom: int = 10,
    label: str = "clicked",
    row_id: str = "row_id",
) -> DataFrame:
    """``row_id, method, kind, k, correct, same, base_correct, n`` of every deletion and perturbation.

    ``same`` compares with the row's prediction on the untouched features, which each
    row carries along: one scan of the test rows, no join. The result is written once,
    since each metric reads it again. ``n``: how many rows have these outcomes. For a
    scorer that is an expression, all variants of a row are scored side by side and
    counted at once, so ``row_id`` numbers joint cells of outcomes, not rows.
    """
    variants: dict[str, Sequence[str]] = {}
    for method, order in ranking_lists(rankings).items():
        variants |= {f"deletion:{k}:{method}": order[:k] for k in ks}
        variants[f"stability:{bottom}:{method}"] = order[-bottom:]
    if hasattr(scorer, "probability"):
        return _side_by_side(scorer, test, variants, impute, label, row_id)
    features = scorer.encoder.features
    base = scorer.predict(test.select(row_id, label, *features)).drop("prob").withColumnRenamed("hard", "_base")
    rows = ablated_variants(base, variants, features, impute, scorer.encoder.numeric)
    scored = scorer.predict(rows)
    y = F.col(label)
    outcomes = scored.select(
        row_id,
        *_variant_columns(),
        (F.col("hard") == y).cast("int").alias("correct"),
        (F.col("hard") == F.col("_base")).cast("int").alias("same"),
        (F.col("_base") == y).cast("int").alias("base_correct"),
        F.lit(1).cast("long").alias("n"),
    )
    return cut_lineage(outcomes, "outcomes")


def _variant_columns() -> list[Column]:
    parts = F.split("variant", ":", 3)
    return [parts[2].alias("method"), parts[0].alias("kind"), parts[1].cast("int").alias("k")]


def _side_by_side(
    scorer: TreeScorer | StatedScorer, test: DataFrame, variants: Mapping[str, Sequence[str]], impute: DataFrame, label: str, row_id: str
) -> DataFrame:
    """Rows counted by their label, their prediction and those of all variants: no row is repeated or shuffled."""
    neutral = {r["feature"]: F.lit(r["value"]).cast("string") for r in impute.collect()}  # a row per feature
    none = F.lit(None).cast("string")
    hard = [threshold(scorer.probability(test, {f: neutral.get(f, none) for f in killed})) for killed in variants.values()]
    flags = test.select(F.col(label).alias("_y"), threshold(scorer.probability(test)).alias("_base"), F.array(*hard).alias("_hard"))
    cells = cut_lineage(flags.groupBy("_y", "_base", "_hard").agg(F.count(F.lit(1)).alias("n")), "outcome-cells")
    names = F.array(*[F.lit(v) for v in variants])
    long = cells.withColumn(row_id, F.monotonically_increasing_id()).select(row_id, "_y", "_base", "n", F.explode(F.arrays_zip("_hard", names.alias("variant"))).alias("v"))
    long = long.select(row_id, "_y", "_base", "n", F.col("v._hard").alias("hard"), F.col("v.variant").alias("variant"))
    return long.select(
        row_id,
        *_variant_columns(),
        (F.col("hard") == F.col("_y")).cast("int").alias("correct"),
        (F.col("hard") == F.col("_base")).cast("int").alias("same"),
        (F.col("_base") == F.col("_y")).cast("int").alias("base_correct"),
        "n",
    )


def weighted(value: str) -> Column:
    """Mean of a 0/1 column over ``n`` rows each."""
    return F.sum(F.col(value) * F.col("n")) / F.sum("n")


def single_deletion(outcomes: DataFrame) -> DataFrame:
    """``method, k, acc, drop``: accuracy without the top k features, and the loss against the base."""
    return outcomes.filter(F.col("kind") == "deletion").groupBy("method", "k").agg(
        weighted("correct").alias("acc"), (weighted("base_correct") - weighted("correct")).alias("drop")
    )


def stability(outcomes: DataFrame) -> DataFrame:
    """``method, share``: predictions unchanged without the least important features."""
    return outcomes.filter(F.col("kind") == "stability").groupBy("method").agg(weighted("same").alias("share"))


def explanation_quality(outcomes: DataFrame, rankings: DataFrame, ks: Sequence[int] = (1, 3, 5), shown: int = 8) -> DataFrame:
    """One row per method: top feature, accuracy after each deletion, largest drop, stability, top list."""
    deletions = single_deletion(outcomes)
    wide = deletions.groupBy("method").agg(
        *[F.max(F.when(F.col("k") == k, F.col("acc"))).alias(f"del{k}") for k in ks],
        F.max(F.when(F.col("k") == max(ks), F.col("drop"))).alias(f"drop_at_{max(ks)}"),
    )
    named = rankings.filter(F.col("rank") <= shown).groupBy("method").agg(
        F.min_by("feature", "rank").alias("top1"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda x: x["feature"]), ",").alias("top"),
    )
    return named.join(wide, "method").join(stability(outcomes).withColumnRenamed("share", "stability"), "method")


def outcome_vectors(outcomes: DataFrame, methods: Sequence[str], deleted: int = 5, row_id: str = "row_id") -> DataFrame:
    """One row per test row, or joint cell of ``n`` of them, with the 0/1 columns the explanation bootstrap resamples."""
    aggs = [F.max("base_correct").alias("base_correct")]
    for i, method in enumerate(methods):
        mine = F.col("method") == method
        aggs.append(F.max(F.when(mine & (F.col("kind") == "deletion") & (F.col("k") == deleted), F.col("correct"))).alias(f"del_{i}"))
        aggs.append(F.max(F.when(mine & (F.col("kind") == "stability"), F.col("same"))).alias(f"same_{i}"))
    return outcomes.groupBy(row_id, "n").agg(*aggs).drop(row_id)
