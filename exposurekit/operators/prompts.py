"""Rows to text: serialised features, single-row prompts and prompt blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wording as W
from ..functions.columns import value_text
from .sampling import first_rows


def feature_line(df: DataFrame, features: Sequence[str]) -> Column:
    """``user.age=.. | streamer.gender=..`` in the given order."""
    parts = [F.concat(F.lit(f"{W.display_name(f)}="), value_text(f, df.schema[f].dataType)) for f in features]
    return F.concat_ws(" | ", *parts)


def serialize(df: DataFrame, features: Sequence[str], idx: str | None = None, name: str = "text") -> DataFrame:
    line = feature_line(df, features)
    if idx is not None:
        line = F.concat(F.lit("["), F.col(idx).cast("string"), F.lit("] "), line)
    return df.withColumn(name, line)


def shuffled(features: Sequence[str], seed: int = 42) -> list[str]:
    """Feature names in a seeded order, the same rule rows are ordered by."""
    from hashlib import md5

    return sorted(features, key=lambda f: (md5(f"{seed}:{f}".encode()).hexdigest(), f))


# --- one prompt per row ---------------------------------------------------------------


def predict_text(df: DataFrame, features: Sequence[str], notes: Column | None = None) -> Column:
    asked = F.concat(F.lit(W.PREDICT_PREFIX), feature_line(df, features), F.lit(W.PREDICT_QUESTION))
    if notes is None:
        return asked
    head = F.when(F.coalesce(notes, F.lit("")) != "", F.concat(F.lit(W.NOTES_HEAD), notes, F.lit("\n\n")))
    return F.concat(F.coalesce(head, F.lit("")), asked)


def predict_prompt(
    df: DataFrame, features: Sequence[str], notes: Column | None = None, name: str = "prompt"
) -> DataFrame:
    """Digit question about one row, optionally headed by correction notes."""
    return df.withColumn(name, predict_text(df, features, notes))


def answer_first_text(df: DataFrame, features: Sequence[str]) -> Column:
    return F.concat(F.lit(W.FEATURES_HEAD), feature_line(df, features), F.lit(W.ANSWER_FIRST_QUESTION))


def answer_first_prompt(df: DataFrame, features: Sequence[str], name: str = "prompt") -> DataFrame:
    return df.withColumn(name, answer_first_text(df, features))


def teacher_prompt(df: DataFrame, features: Sequence[str], name: str = "prompt") -> DataFrame:
    """Asks for one sentence on the signal in the features, outcome untold."""
    return df.withColumn(name, F.concat(F.lit(W.FEATURES_HEAD), feature_line(df, features), F.lit(W.TEACHER_QUESTION)))


def explain_prompt(df: DataFrame, features: Sequence[str], pred: str, name: str = "prompt") -> DataFrame:
    """States the prediction and asks for the reason."""
    decision = F.when(F.col(pred) == 1, "click (1)").otherwise("no click (0)")
    asked = F.concat(
        F.lit(W.FEATURES_HEAD),
        feature_line(df, features),
        F.lit("\n\nThe model predicts: "),
        decision,
        F.lit(". Explain in one sentence starting with 'Because'."),
    )
    return df.withColumn(name, asked)


# --- training examples ----------------------------------------------------------------


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(df: DataFrame, prompt: str = "prompt", system: str | None = None, name: str = "messages") -> DataFrame:
    """A prompt column as the message list a chat endpoint takes."""
    turns = [message("system", F.lit(system))] if system else []
    return df.withColumn(name, F.array(*turns, message("user", F.col(prompt))))


def answer_with_reason(label: Column, rationale: Column) -> Column:
    return F.concat(F.lit("Answer: "), label.cast("string"), F.lit("\nBecause: "), rationale)


def sft_messages(
    df: DataFrame, features: Sequence[str], label: str = "clicked", rationale: str | None = None, name: str = "messages"
) -> DataFrame:
    """User and assistant turns; the answer is the label, with a reason where one is given."""
    answer = F.col(label).cast("int")
    if rationale is None:
        asked, told = predict_text(df, features), answer.cast("string")
    else:
        asked, told = answer_first_text(df, features), answer_with_reason(answer, F.col(rationale))
    return df.withColumn(name, F.array(message("user", asked), message("assistant", told)))


def segment_weights(
    df: DataFrame, rationale_weight: float = 0.05, label: str = "clicked", rationale: str = "rationale", name: str = "segments"
) -> DataFrame:
    """The assistant text in two segments: the answer at full weight, the reason at a small one."""

    def segment(text: Column, weight: float) -> Column:
        return F.struct(text.alias("segment"), F.lit(float(weight)).alias("weight"))

    answer = F.concat(F.lit("Answer: "), F.col(label).cast("int").cast("string"), F.lit("\n"))
    reason = F.concat(F.lit("Because: "), F.col(rationale))
    return df.withColumn(name, F.array(segment(answer, 1.0), segment(reason, rationale_weight)))


# --- several rows per prompt ----------------------------------------------------------


def joined_lines(position: str, line: str) -> Column:
    """Lines of a group in position order. Every caller bounds its groups first."""
    ordered = F.array_sort(F.collect_list(F.struct(position, line)))
    return F.array_join(F.transform(ordered, lambda x: x[line]), "\n")


def labeled_examples_block(
    df: DataFrame,
    features: Sequence[str],
    k: int,
    row_id: str,
    by: Sequence[str] = (),
    label: str = "clicked",
    seed: int = 42,
) -> DataFrame:
    """One prompt per group listing its first ``k`` labelled rows."""
    # only the chosen rows are turned into text
    wanted = dict.fromkeys([*by, row_id, label, *features])
    shown = first_rows(df.select(*wanted), k, row_id, seed, by)
    line = F.concat(F.lit(f"[{label}="), F.col(label).cast("string"), F.lit("] "), feature_line(shown, features))
    blocks = shown.withColumn("line", line).groupBy(*by).agg(joined_lines("ordinal", "line").alias("block"), F.count(F.lit(1)).alias("n"))
    return blocks.select(*by, F.concat(F.lit(W.EXAMPLES_HEAD), "block").alias("prompt"), "n")


def batched_prompts(
    df: DataFrame,
    features: Sequence[str],
    size: int,
    description: Column,
    ordinal: str = "ordinal",
    by: Sequence[str] = (),
) -> DataFrame:
    """Prompts over runs of ``size`` rows, numbered 0.. inside each; ``description`` may vary by group."""
    local = F.col(ordinal) % size
    line = F.concat(F.lit("["), local.cast("string"), F.lit("] "), feature_line(df, features))
    rows = df.select(
        *by,
        F.floor(F.col(ordinal) / F.lit(size)).alias("batch"),
        local.alias("local"),
        line.alias("line"),
        description.alias("description"),
    )
    # at most ``size`` rows per batch
    grouped = rows.groupBy(*by, "batch").agg(
        joined_lines("local", "line").alias("block"),
        F.count(F.lit(1)).alias("n"),
        F.min("description").alias("description"),
    )
    n = F.col("n").cast("string")
    prompt = F.concat(
        F.lit(W.PATTERNS_HEAD),
        F.col("description"),
        F.lit("\n\nPredict clicked (0 or 1) for each of the "),
        n,
        F.lit(" rows below. Output EXACTLY "),
        n,
        F.lit(" lines, each `i=0` or `i=1` where i is the bracket number. No other text.\n\n"),
        F.col("block"),
    )
    return grouped.select(*by, "batch", prompt.alias("prompt"), "n")


def error_block(
    errors: DataFrame,
    features: Sequence[str],
    by: Sequence[str] = (),
    description: str | None = None,
    label: str = "clicked",
    hard: str = "hard",
) -> DataFrame:
    """One prompt per group over an ``error_sample``; a group without errors has no prompt.

    With a ``description`` column the prompt asks for its rewrite; without one it
    asks for correction notes.
    """
    head = f"[true {label}=" if description else "[true="
    line = F.concat(
        F.lit(head),
        F.col(label).cast("string"),
        F.lit(", predicted="),
        F.col(hard).cast("string"),
        F.lit("] "),
        feature_line(errors, features),
    )
    rows = errors.select(
        *by, "ordinal", line.alias("line"), (F.col(description) if description else F.lit("")).alias("description")
    )
    # the sample bounds every group
    grouped = rows.groupBy(*by).agg(
        joined_lines("ordinal", "line").alias("block"),
        F.count(F.lit(1)).alias("n"),
        F.min("description").alias("description"),
    )
    intro = (
        F.concat(F.lit("CURRENT DESCRIPTION:\n"), F.col("description"), F.lit("\n\n" + W.ERRORS_HEAD))
        if description
        else F.lit(W.GUIDE_ERRORS_HEAD)
    )
    # a global aggregate of no rows is one row with n = 0
    return grouped.filter(F.col("n") > 0).select(*by, F.concat(intro, F.col("block")).alias("prompt"), "n")
