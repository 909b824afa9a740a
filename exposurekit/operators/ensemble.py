"""Blending two probability columns, and how their errors overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import round_to
from ..functions.wording import BLEND_WEIGHTS
from .metrics import accuracy, confusion, f1_macro


def blend_grid(
    preds: DataFrame, p1: str, p2: str, y: str = "y", weights: Sequence[float] = BLEND_WEIGHTS
) -> DataFrame:
    """``w, acc, f1, best`` of w * p1 + (1 - w) * p2 at 0.5; best accuracy, smallest weight on ties."""
    w = F.col("w")
    mixed = preds.select(
        F.col(y).alias("_y"), F.col(p1).alias("_a"), F.col(p2).alias("_b"), F.explode(F.array(*[F.lit(float(x)) for x in weights])).alias("w")
    )
    decided = mixed.withColumn(
        "_hard", F.when(w * F.col("_a") + (F.lit(1.0) - w) * F.col("_b") >= 0.5, 1).otherwise(0)
    )
    table = confusion(decided, "_y", "_hard", ["w"]).select(
        "w", round_to(accuracy(), 4).alias("acc"), round_to(f1_macro(), 4).alias("f1")
    )
    # one row per weight; packed so that the best is found without a second pass
    packed = table.agg(
        F.collect_list(F.struct("w", "acc", "f1")).alias("rows"),
        F.max_by("w", F.struct("acc", -w)).alias("best_w"),
    )
    return packed.select(F.explode("rows").alias("r"), "best_w").select(
        "r.w", "r.acc", "r.f1", (F.col("r.w") == F.col("best_w")).alias("best")
    )


def error_overlap(preds: DataFrame, h1: str, h2: str, y: str = "y") -> DataFrame:
    """Shares wrong by each and by both scorers, and the correlation of their errors.

    A scorer that is always or never wrong has no correlation (null).
    """
    e1 = (F.col(h1) != F.col(y)).cast("double")
    e2 = (F.col(h2) != F.col(y)).cast("double")
    return preds.agg(
        F.avg(e1).alias("wrong_1"),
        F.avg(e2).alias("wrong_2"),
        F.avg(e1 * e2).alias("both_wrong"),
        F.when((F.var_pop(e1) > 0) & (F.var_pop(e2) > 0), F.try_divide(F.covar_pop(e1, e2), F.stddev_pop(e1) * F.stddev_pop(e2))).alias("error_corr"),
    )
