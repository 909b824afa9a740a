"""Error rates per subgroup, their spread, and equal-opportunity thresholds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .metrics import cell_counts
from .ordinal import exact_quantiles
from .skew import lookup_join

OVERALL = "overall"


def dimension_pairs(dims: Sequence[str], overall: bool) -> Column:
    """(dimension, group) pairs of a row, missing groups named ``nan``."""
    pairs = [
        F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit("nan")).alias("group")) for d in dims
    ]
    if overall:
        pairs.append(F.struct(F.lit(OVERALL).alias("dim"), F.lit(None).cast("string").alias("group")))
    return F.array(*pairs)


def rates_of(cells: DataFrame) -> DataFrame:
    """n, accuracy, FPR, FNR from outcome cells; rate denominators are at least 1, empty groups have none."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    filled = n > 0
    return cells.withColumns(
        {
            "n": n,
            "acc": F.when(filled, (tp + tn) / n),
            "fpr": F.when(filled, fp / F.greatest(fp + tn, F.lit(1))),
            "fnr": F.when(filled, fn / F.greatest(fn + tp, F.lit(1))),
        }
    ).drop("tp", "fp", "fn", "tn")


def with_listed_levels(cells: DataFrame, levels: Mapping[str, Sequence[str]] | None) -> DataFrame:
    """Dimensions with listed levels report exactly those, absent ones as empty groups."""
    if not levels:
        return cells
    spark = cells.sparkSession
    listed = spark.createDataFrame([(d, g) for d, gs in levels.items() for g in gs], "dim string, group string")
    free = cells.filter(~F.col("dim").isin(*levels))
    fixed = cells.filter(F.col("dim").isin(*levels))
    fixed = listed.join(fixed, ["dim", "group"], "left").fillna(0, ["tp", "fp", "fn", "tn"])
    return free.unionByName(fixed, allowMissingColumns=True)


def group_rates(
    preds: DataFrame,
    dims: Sequence[str],
    y: str = "y",
    hard: str = "hard",
    levels: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """``dim, group, n, acc, fpr, fnr`` for every subgroup, and overall with no group.

    Rows are first counted by all dimensions at once; only those counts are repeated
    per dimension.
    """
    joint = preds.groupBy(*dims, F.col(y).alias("_y"), F.col(hard).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    cells = cell_counts(F.col("_y"), F.col("_p"), F.col("_n"))
    per_group = (
        joint.withColumn("_g", F.explode(dimension_pairs(dims, overall=True)))
        .groupBy("_g.dim", "_g.group")
        .agg(*[c.alias(n) for n, c in cells.items()])
    )
    return rates_of(with_listed_levels(per_group, levels)).select("dim", "group", "n", "acc", "fpr", "fnr")


def rate_spread(rates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest minus smallest FPR and FNR over the groups of each dimension that have rows."""
    groups = rates.filter(F.col("group").isNotNull() & (F.col("n") > 0))
    return groups.groupBy(*by, "dim").agg(
        (F.max("fpr") - F.min("fpr")).alias("fpr_spread"), (F.max("fnr") - F.min("fnr")).alias("fnr_spread")
    )


def score_cells(preds: DataFrame, dims: Sequence[str], y: str, prob: str) -> DataFrame:
    """Rows counted by all dimensions, label and probability; written once, read by several passes."""
    counted = preds.groupBy(*dims, F.col(y).alias("_y"), F.col(prob).alias("_prob")).agg(F.count(F.lit(1)).alias("_n"))
    return cut_lineage(counted, "score-cells")


def per_dimension(cells: DataFrame, dims: Sequence[str]) -> DataFrame:
    return cells.select("_y", "_prob", "_n", F.explode(dimension_pairs(dims, overall=False)).alias("_g")).select(
        "_y", "_prob", "_n", "_g.dim", "_g.group"
    )


def thresholds(cells: DataFrame, dims: Sequence[str], levels: Mapping[str, Sequence[str]] | None) -> DataFrame:
    decided = F.when(F.col("_prob") >= 0.5, 1).otherwise(0)
    counts = cell_counts(F.col("_y"), decided, F.col("_n"))
    tp, fn = counts["tp"], counts["fn"]
    # 1 - TPR is the overall FNR
    target = F.lit(1.0) - (F.lit(1.0) - fn / F.greatest(tp + fn, F.lit(1)))
    share = cells.agg(target.alias("q")).scalar()
    long = per_dimension(cells, dims)
    found = exact_quantiles(long.filter(F.col("_y") == 1), "_prob", {"tau": share}, ["dim", "group"], weight="_n")
    groups = long.select("dim", "group").distinct()
    if levels:
        listed = cells.sparkSession.createDataFrame(
            [(d, g) for d, gs in levels.items() for g in gs], "dim string, group string"
        )
        groups = groups.filter(~F.col("dim").isin(*levels)).unionByName(listed)
    return groups.join(found, ["dim", "group"], "left").select(
        "dim", "group", F.coalesce("tau", F.lit(0.5)).alias("tau")
    )


def equal_opportunity(
    preds: DataFrame,
    dims: Sequence[str],
    y: str = "y",
    prob: str = "prob",
    levels: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """``dim, group, tau``: the threshold that gives each group the overall true-positive rate.

    The target is the TPR at 0.5 over all rows; tau is the (1 - target) quantile of
    the group's positive scores, 0.5 for a group without positives.
    """
    return thresholds(score_cells(preds, dims, y, prob), dims, levels)


def recalibrated_audit(
    preds: DataFrame,
    dims: Sequence[str],
    y: str = "y",
    prob: str = "prob",
    levels: Mapping[str, Sequence[str]] | None = None,
    calibration: DataFrame | None = None,
) -> DataFrame:
    """Rates per dimension and group before and after per-group thresholds, with spreads.

    Every dimension also has a row without a group: the whole table under that dimension's
    thresholds. Thresholds come from the audited rows, or from ``calibration`` rows.
    Rows whose group has no threshold keep the 0.5 decision.
    """
    audited = score_cells(preds, dims, y, prob)
    taus = thresholds(audited if calibration is None else score_cells(calibration, dims, y, prob), dims, levels)
    joined = lookup_join(per_dimension(audited, dims), taus, ["dim", "group"], ["_y", "_prob"])
    base = F.when(F.col("_prob") >= 0.5, 1).otherwise(0)
    moved = F.when(F.col("_prob") >= F.coalesce("tau", F.lit(0.5)), 1).otherwise(0)
    before = cell_counts(F.col("_y"), base, F.col("_n"))
    after = cell_counts(F.col("_y"), moved, F.col("_n"))
    names = ("tp", "fp", "fn", "tn")
    wide = joined.groupBy("dim", "group").agg(
        F.max("tau").alias("tau"),
        F.struct(*[before[n].alias(n) for n in names]).alias("before"),
        F.struct(*[after[n].alias(n) for n in names]).alias("after"),
    )
    stages = F.array(
        F.struct(F.lit("before").alias("stage"), F.lit(None).cast("double").alias("tau"), F.col("before").alias("c")),
        F.struct(F.lit("after").alias("stage"), F.col("tau").alias("tau"), F.col("after").alias("c")),
    )
    cells = wide.select("dim", "group", F.explode(stages).alias("_s")).select(
        "_s.stage", "dim", "group", "_s.tau", *[F.col(f"_s.c.{n}").alias(n) for n in names]
    )
    whole = cells.groupBy("stage", "dim").agg(
        F.lit(None).cast("string").alias("group"), F.lit(None).cast("double").alias("tau"), *[F.sum(n).alias(n) for n in names]
    )
    if levels:
        spark = preds.sparkSession
        listed = spark.createDataFrame(
            [(s, d, g) for s in ("before", "after") for d, gs in levels.items() for g in gs],
            "stage string, dim string, group string",
        )
        free = cells.filter(~F.col("dim").isin(*levels))
        fixed = listed.join(cells, ["stage", "dim", "group"], "left").fillna(0, list(names))
        cells = free.unionByName(fixed)
    rates = rates_of(cells.unionByName(whole))
    spread = rate_spread(rates, ["stage"])
    return rates.join(spread, ["stage", "dim"], "left").select(
        "stage", "dim", "group", "n", "acc", "fpr", "fnr", "tau", "fpr_spread", "fnr_spread"
    )
