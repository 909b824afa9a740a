"""Scores of predictions, each from one grouped pass over the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import round_to
from .ordinal import prefix_sums, value_buckets
from .responses import pair_runs


def cell_counts(label: Column, hard: Column, weight: Column | None = None) -> dict[str, Column]:
    """Aggregates for the four outcome cells, optionally weighted."""
    weight = F.lit(1) if weight is None else weight

    def cell(y: int, p: int) -> Column:
        return F.coalesce(F.sum(F.when((label == y) & (hard == p), weight)), F.lit(0))

    return {"tp": cell(1, 1), "fp": cell(0, 1), "fn": cell(1, 0), "tn": cell(0, 0)}


def confusion(preds: DataFrame, y: str = "y", hard: str = "hard", by: Sequence[str] = ()) -> DataFrame:
    cells = cell_counts(F.col(y), F.col(hard))
    return preds.groupBy(*by).agg(*[c.alias(n) for n, c in cells.items()])


def ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top, bottom)


def accuracy() -> Column:
    return ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))


def f1_positive() -> Column:
    return F.coalesce(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))


def f1_macro() -> Column:
    """Mean F1 over the classes that occur in truth or prediction."""
    missed = F.col("fp") + F.col("fn")
    scores = F.array_compact(
        F.array(ratio(2 * F.col("tp"), 2 * F.col("tp") + missed), ratio(2 * F.col("tn"), 2 * F.col("tn") + missed))
    )
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return ratio(total, F.size(scores))


def classification_report(
    preds: DataFrame, y: str = "y", hard: str = "hard", by: Sequence[str] = (), digits: int = 4
) -> DataFrame:
    return confusion(preds, y, hard, by).select(
        *by,
        round_to(accuracy(), digits).alias("acc"),
        round_to(f1_macro(), digits).alias("f1_macro"),
        round_to(f1_positive(), digits).alias("f1_pos"),
    )


def balanced_accuracy(preds: DataFrame, y: str = "y", hard: str = "hard", by: Sequence[str] = ()) -> DataFrame:
    """Mean recall over the classes that occur in truth."""
    recalls = F.array_compact(
        F.array(
            ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            ratio(F.col("tn"), F.col("tn") + F.col("fp")),
        )
    )
    total = F.aggregate(recalls, F.lit(0.0), lambda a, x: a + x)
    return confusion(preds, y, hard, by).select(*by, ratio(total, F.size(recalls)).alias("bal_acc"))


def ranked_scores(preds: DataFrame, y: str, prob: str, by: Sequence[str]) -> DataFrame:
    """Per distinct score, highest first: ``pos``, ``neg``, their running sums and totals."""
    limits = value_buckets(preds, prob)
    cells = (
        preds.filter(F.col(prob).isNotNull())
        .groupBy(*by, F.col(prob).alias("_score"))
        .agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    )
    return prefix_sums(cells, "_score", ["pos", "neg"], by, descending=True, limits=limits)


def auc_aggregate() -> Column:
    """Pairs ranked correctly, ties half; null when a class is missing."""
    above = F.col("pos_cum") - F.col("pos")
    pairs = F.sum(F.col("neg") * (above + F.col("pos") / 2))
    return ratio(pairs, F.max(F.col("pos_all").cast("double") * F.col("neg_all")))


def ap_aggregate() -> Column:
    """Sum over thresholds of recall gained times precision."""
    gained = ratio(F.col("pos").cast("double"), F.col("pos_all"))
    return F.sum(gained * ratio(F.col("pos_cum"), F.col("pos_cum") + F.col("neg_cum")))


def roc_auc(preds: DataFrame, y: str = "y", prob: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    return ranked_scores(preds, y, prob, by).groupBy(*by).agg(auc_aggregate().alias("auc"))


def average_precision(preds: DataFrame, y: str = "y", prob: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    return ranked_scores(preds, y, prob, by).groupBy(*by).agg(ap_aggregate().alias("ap"))


def discrimination_table(
    preds: DataFrame, y: str = "y", prob: str = "prob", hard: str = "hard", by: Sequence[str] = ("scorer",)
) -> DataFrame:
    """auc, ap and acc per scorer; auc and ap come from the same ranking pass."""
    ranked = ranked_scores(preds, y, prob, by).groupBy(*by).agg(auc_aggregate().alias("auc"), ap_aggregate().alias("ap"))
    acc = confusion(preds, y, hard, by).select(*by, accuracy().alias("acc"))
    return ranked.join(acc, list(by))


def agreement(a: DataFrame, b: DataFrame, on: str = "row_id") -> DataFrame:
    """Share of equal decisions of two runs, and how many changed."""
    same = F.col("hard_a") == F.col("hard_b")
    return pair_runs(a, b, on).agg(
        F.avg(same.cast("double")).alias("share"),
        F.count_if(~same).alias("changed"),
        F.count(F.lit(1)).alias("n"),
    )


def correction_effect(base: DataFrame, corrected: DataFrame, y: str = "y", on: str = "row_id") -> DataFrame:
    """Scores with and without correction notes, and how many predictions changed."""
    pairs = pair_runs(base, corrected, on, (y, "hard"))
    label = F.col(f"{y}_a")
    before, after = (cell_counts(label, F.col(f"hard_{side}")) for side in ("a", "b"))
    counted = pairs.agg(
        *[c.alias(f"{n}_before") for n, c in before.items()],
        *[c.alias(f"{n}_after") for n, c in after.items()],
        F.count_if(F.col("hard_a") != F.col("hard_b")).alias("changed"),
        F.count(F.lit(1)).alias("n"),
    )
    out = counted
    for side in ("before", "after"):
        out = out.withColumns({c: F.col(f"{c}_{side}") for c in ("tp", "fp", "fn", "tn")}).withColumns(
            {f"acc_{side}": round_to(accuracy(), 4), f"f1_{side}": round_to(f1_macro(), 4)}
        )
    return out.select("acc_before", "f1_before", "acc_after", "f1_after", "changed", "n")


def iteration_trajectory(preds: DataFrame, y: str = "y", hard: str = "hard", by: Sequence[str] = ()) -> DataFrame:
    """Scores of every refinement step and the accuracy lift from first to last."""
    steps = classification_report(preds, y, hard, [*by, "iteration"])
    first_last = steps.groupBy(*by).agg(
        (F.max_by("acc", "iteration") - F.min_by("acc", "iteration")).alias("_lift")
    )
    lifted = steps.join(first_last, list(by)) if by else steps.withColumn("_lift", first_last.scalar())
    return lifted.select(*by, "iteration", "acc", "f1_macro", "f1_pos", round_to(F.col("_lift"), 4).alias("lift"))
