"""Answers of outside models, read from tables, back into predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1), F.lit(""))


def parse_digit(text: Column, default: int = 0) -> Column:
    """The first 0 or 1 anywhere in the text."""
    return F.coalesce(first_match(text, "([01])").cast("int"), F.lit(default))


def parse_answer_first(text: Column, default: int = 0) -> Column:
    """The first ``Answer: d``; without one, the first digit."""
    found = F.coalesce(first_match(text, "Answer:\\s*([01])"), first_match(text, "([01])"))
    return F.coalesce(found.cast("int"), F.lit(default))


def prob_from_logprob(token: Column, logprob: Column) -> Column:
    """P(1) from the chosen token's log-probability; 0.5 when the token is neither digit."""
    token = F.regexp_replace(token, "^\\s+|\\s+$", "")
    prob = F.when(token == "1", F.exp(logprob)).when(token == "0", F.lit(1.0) - F.exp(logprob))
    return F.coalesce(prob, F.lit(0.5))


def parse_batch(
    responses: DataFrame,
    rows: DataFrame,
    by: Sequence[str] = ("batch",),
    row_id: str = "row_id",
    text: str = "text",
    default: int = 0,
) -> DataFrame:
    """``i=0`` / ``i=1`` pairs of each batch answer, put back on the batch's rows.

    ``rows`` holds ``by``, ``local`` (0..n-1) and ``row_id``. The last pair for an
    index wins, an index outside the batch meets no row, and a row without a pair gets
    the default with ``parsed`` false. Pairs are shuffled by batch and index, the last one
    of an index kept before the shuffle where an answer is one row.
    """
    pattern = F.lit("(\\d+)\\s*=\\s*([01])")
    answer = F.coalesce(F.col(text), F.lit(""))
    pairs = F.arrays_zip(
        F.regexp_extract_all(answer, pattern, F.lit(1)).alias("index"),
        F.regexp_extract_all(answer, pattern, F.lit(2)).alias("value"),
    )
    found = (
        responses.select(*by, F.posexplode(pairs).alias("_pos", "_pair"))
        .select(
            *by,
            "_pos",
            F.col("_pair.index").try_cast("bigint").alias("local"),
            F.col("_pair.value").cast("int").alias("_value"),
        )
        .filter(F.col("local").isNotNull())
        .groupBy(*by, "local")
        .agg(F.max_by("_value", "_pos").alias("_value"))
    )
    local = rows.select(*by, F.col("local").cast("bigint").alias("local"), row_id)
    return local.join(found, [*by, "local"], "left").select(
        row_id,
        F.coalesce("_value", F.lit(default)).alias("hard"),
        F.col("_value").isNotNull().alias("parsed"),
    )


def unparsed_count(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count_if(~F.col("parsed")).alias("n"))


def parse_ranking(
    texts: DataFrame,
    features: Sequence[str],
    text_id: str = "text_id",
    text: str = "text",
    whole_word: bool = False,
) -> DataFrame:
    """Features of every ranking text in order of first mention; unmentioned ones last, in list order.

    By default a name is found inside longer names too; ``whole_word`` prevents that.
    The order is made inside the text's own row, without a shuffle.
    """
    from re import escape

    body = F.coalesce(F.col(text), F.lit(""))
    never = F.lit(1_000_000_000)

    def place(feature: str) -> Column:
        if whole_word:
            found = F.regexp_instr(body, F.lit(f"\\b{escape(feature)}\\b"))
        else:
            found = F.instr(body, feature)
        return F.when(found > 0, found).otherwise(never)

    mentions = F.array(
        *[
            F.struct(place(f).alias("place"), F.lit(i).alias("listed"), F.lit(f).alias("feature"))
            for i, f in enumerate(features)
        ]
    )
    return texts.select(text_id, F.posexplode(F.array_sort(mentions)).alias("_pos", "_m")).select(
        text_id, F.col("_m.feature").alias("feature"), (F.col("_pos") + 1).alias("rank")
    )


def attach_predictions(
    rows: DataFrame, preds: DataFrame, policy: str = "hard0", row_id: str = "row_id"
) -> DataFrame:
    """Each row with a scorer's ``hard`` and ``prob``; a row without an answer follows the policy.

    ``hard0``: no answer means 0, its probability stays missing. ``prob_half``: no
    answer means probability 0.5, and hard decisions are prob >= 0.5.
    """
    has_prob = "prob" in preds.columns
    prob = F.col("prob") if has_prob else F.lit(None).cast("double")
    wanted = preds.select(row_id, *[c for c in ("hard", "prob") if c in preds.columns])
    joined = rows.join(wanted, row_id, "left")
    if policy == "hard0":
        filled = {"hard": F.coalesce(F.col("hard"), F.lit(0)), "prob": prob}
    elif policy == "prob_half":
        half = F.coalesce(prob, F.lit(0.5))
        filled = {"prob": half, "hard": F.when(half >= 0.5, 1).otherwise(0)}
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return joined.withColumns(filled)


def pair_runs(a: DataFrame, b: DataFrame, on: str = "row_id", columns: Sequence[str] = ("hard",)) -> DataFrame:
    """Two runs over the same rows side by side, suffixes ``_a`` and ``_b``."""
    left = a.select(on, *[F.col(c).alias(f"{c}_a") for c in columns])
    right = b.select(on, *[F.col(c).alias(f"{c}_b") for c in columns])
    return left.join(right, on)
