"""Whole evaluations as tables: rows and answer tables in, score tables out.

Answers of outside models come as tables keyed by ``row_id``; nothing here calls a
model service. Each study returns lazy tables by name; what several of them share is
written once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.wording import AGE_BANDS, BLEND_WEIGHTS, COARSE_AGE, COARSE_AGE_BANDS, HISTORY_FEATURES
from ..functions.columns import normalize_text, recode, round_to, threshold
from ..operators import ensemble, fairness, metrics, models, profile, prompts, ranking, resample, sampling
from ..operators.encode import encode_train_fit
from ..session import cut_lineage


def split_table(table: DataFrame, train: int, test: int, seed: int = 42) -> dict[str, DataFrame]:
    """``train``, ``test`` and ``pool`` (all other rows) of a modelling table."""
    parts = sampling.ordinal_split(table, {"train": train, "test": test}, "row_id", seed)
    return {
        "train": parts.filter("split = 'train'").drop("split"),
        "test": parts.filter("split = 'test'").drop("split"),
        "pool": parts.filter("split is null").drop("split"),
    }


def score_summary(scored: DataFrame, by: Sequence[str] = ("scorer",)) -> DataFrame:
    """acc, macro-F1, balanced accuracy, auc and ap side by side, per ``by`` group."""
    report = metrics.classification_report(scored, by=by).drop("f1_pos")
    balanced = metrics.balanced_accuracy(scored, by=by)
    ranks = metrics.discrimination_table(scored, by=by).drop("acc")
    return report.join(balanced, list(by)).join(ranks, list(by))


def refinement_step(
    valid: DataFrame, answers: DataFrame, description: Column, features: Sequence[str], settings: Settings = DEFAULTS
) -> dict[str, DataFrame]:
    """One turn of the loop: scores of the current description, and the prompt that asks for the next."""
    scored = valid.join(answers.select("row_id", "hard"), "row_id")
    errors = sampling.error_sample(
        scored.withColumn("description", description), "clicked", "hard", settings.shown_errors, "row_id", settings.seed
    )
    return {
        "scores": metrics.classification_report(scored, y="clicked"),
        "next_prompt": prompts.error_block(errors, features, description="description"),
    }


def training_tables(
    train: DataFrame, features: Sequence[str], rationale: str | None = None, settings: Settings = DEFAULTS
) -> dict[str, DataFrame]:
    """Training examples and the order a trainer reads them in."""
    batch = settings.plain_batch if rationale is None else settings.rationale_batch
    examples = prompts.sft_messages(train, features, rationale=rationale)
    if rationale is not None:
        examples = prompts.segment_weights(examples, settings.rationale_weight, rationale=rationale)
    kept = ["row_id", "messages", *(["segments"] if rationale is not None else [])]
    plan = sampling.batch_plan(train, "row_id", batch, settings.epochs, settings.learning_rate, settings.seed)
    return {"examples": examples.select(*kept), "plan": plan}


def error_study(
    train: DataFrame,
    test: DataFrame,
    answers: DataFrame,
    stated: DataFrame,
    features: Sequence[str],
    settings: Settings = DEFAULTS,
    label: str = "clicked",
    rounds: int = 100,
) -> dict[str, DataFrame]:
    """Bootstrap errors of predictions and of explanations.

    ``answers`` holds the outside model's ``hard`` per row, ``stated`` its feature
    ranking (method, feature, rank). Baselines are fitted here; explanations are judged
    on the boosted trees.
    """
    encoder = encode_train_fit(train, features)
    encoded = models.training_set(encoder, train, label)
    trees = models.fit_gbt(encoder, encoded, settings.seed, rounds)
    linear = models.fit_logreg(encoder, encoded)
    sparse = models.fit_sparse_tree(encoder, encoded, seed=settings.seed)
    wide = (
        trees.predict(test)
        .select("row_id", F.col(label).alias("y"), F.col("hard").alias("trees"))
        .join(linear.predict(test).select("row_id", F.col("hard").alias("linear")), "row_id")
        .join(answers.select("row_id", F.col("hard").alias("answers")), "row_id", "left")
        .fillna(0, ["answers"])
    )
    spark = test.sparkSession
    rankings = (
        ranking.permutation_ranking(trees, test, label, seed=settings.seed)
        .unionByName(ranking.tree_importance_ranking(spark, sparse))
        .unionByName(stated.select("method", "feature", "rank", F.lit(0.0).alias("importance")))
    )
    categorical = [f for f in features if f not in encoder.numeric]
    impute = profile.impute_values(train, encoder.numeric, categorical)
    bottom = min(settings.stability_k, len(features))
    outcomes = ranking.variant_outcomes(trees, test, rankings, impute, settings.deletion_ks, bottom, label)
    methods = list(ranking.ranking_lists(rankings))
    vectors = ranking.outcome_vectors(outcomes, methods, max(settings.deletion_ks))
    columns = {m: (f"del_{i}", f"same_{i}") for i, m in enumerate(methods)}
    draws, seed = settings.bootstrap_draws, settings.seed
    return {
        "predictions": resample.bootstrap_scores(wide, ["answers", "linear", "trees"], draws, seed),
        "explanations": resample.bootstrap_explanations(vectors, "base_correct", columns, draws, seed),
        "quality": ranking.explanation_quality(outcomes, rankings, settings.deletion_ks),
    }


def validity_study(
    train: DataFrame,
    test: DataFrame,
    runs: Mapping[str, DataFrame],
    features: Sequence[str],
    label: str = "clicked",
    learners=models.LEARNERS,
    encoding=models.by_train,
) -> dict[str, DataFrame]:
    """Feature-group ablation (``encoding`` as there), and scores and agreement of repeated answer runs.

    ``runs`` maps a run's name to its ``row_id, prob, hard``; the first is the one the
    others are compared with. A run over a resampled test set has its own rows: its
    table also carries the label as ``y``.
    """
    static = [f for f in features if f not in HISTORY_FEATURES]
    rates = [f for f in ("user_ctr", "streamer_ctr") if f in features]
    groups = {"static_only": static, "static_and_rates": [*static, *rates], "full": list(features)}
    truth = test.select("row_id", F.col(label).alias("y"))
    parts = []
    for name, run in runs.items():
        rows = run if "y" in run.columns else run.join(truth, "row_id")
        parts.append(rows.select(F.lit(name).alias("scorer"), "row_id", "y", "prob", "hard"))
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    scored = cut_lineage(scored, "runs")
    first = next(iter(runs))
    base = scored.filter(F.col("scorer") == first).select("row_id", F.col("hard").alias("_base"))
    same = scored.filter(F.col("scorer") != first).join(base, "row_id")
    return {
        "ablation": models.group_ablation(train, test, groups, label, learners, encoding=encoding),
        "scores": score_summary(scored),
        "agreement": same.groupBy("scorer").agg(F.avg((F.col("hard") == F.col("_base")).cast("double")).alias("share")),
    }


def audit_study(preds: DataFrame, gender: str = "u_gender", age: str = "u_age") -> dict[str, DataFrame]:
    """Subgroup rates at 0.5, and before and after per-group thresholds, for gender, age and coarse age."""
    rows = preds.withColumn("coarse_age", recode(F.col(age), COARSE_AGE))
    levels = {age: AGE_BANDS, "coarse_age": COARSE_AGE_BANDS}
    return {
        "rates": fairness.group_rates(rows, [gender, age], levels={age: AGE_BANDS}),
        "recalibrated": fairness.recalibrated_audit(rows, [gender, age, "coarse_age"], levels=levels),
    }


def ensemble_study(
    preds: DataFrame, probs: Mapping[str, str], first: str, second: str, y: str = "y", weights: Sequence[float] = BLEND_WEIGHTS
) -> dict[str, DataFrame]:
    """Two scorers blended, beside all scorers alone.

    ``probs`` maps a scorer's name to its probability column of ``preds``. ``record``:
    ``name, w, acc, f1_macro``, one row per scorer and one for the best blend of
    ``first`` and ``second``; ``blend``: every weight; ``overlap``: how their errors meet.
    """
    blend = cut_lineage(ensemble.blend_grid(preds, probs[first], probs[second], y, weights), "blend")
    hard = {name: threshold(F.col(c)) for name, c in probs.items()}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), h.alias("hard")) for n, h in hard.items()]))
    alone = preds.select(F.col(y).alias("y"), each.alias("s")).select("y", "s.*")
    report = metrics.classification_report(alone, by=["name"]).select("name", F.lit(None).cast("double").alias("w"), "acc", "f1_macro")
    best = blend.filter("best").select(F.lit("best blend").alias("name"), "w", "acc", F.col("f1").alias("f1_macro"))
    decided = preds.select(F.col(y).alias("y"), hard[first].alias("_first"), hard[second].alias("_second"))
    return {"record": report.unionByName(best), "blend": blend, "overlap": ensemble.error_overlap(decided, "_first", "_second")}


def correction_study(base: DataFrame, corrected: DataFrame, y: str = "y", on: str = "row_id") -> dict[str, DataFrame]:
    """Runs without and with correction notes: scores and changes, and which answers turned.

    ``turned``: ``was_right, is_right, n`` for all four cases, also those that do not occur.
    """
    pairs = base.select(on, F.col(y).alias("_y"), F.col("hard").alias("_a")).join(corrected.select(on, F.col("hard").alias("_b")), on)
    counted = pairs.agg(
        *[F.count_if(((F.col("_a") == F.col("_y")) == F.lit(a)) & ((F.col("_b") == F.col("_y")) == F.lit(b))).alias(f"n{int(a)}{int(b)}") for a in (False, True) for b in (False, True)]
    )
    cases = F.array(*[F.struct(F.lit(a).alias("was_right"), F.lit(b).alias("is_right"), F.col(f"n{a}{b}").alias("n")) for a in (0, 1) for b in (0, 1)])
    return {"effect": metrics.correction_effect(base, corrected, y, on), "turned": counted.select(F.explode(cases).alias("c")).select("c.*")}


def progression_study(valid: DataFrame, test: DataFrame, descriptions: DataFrame, limit: int = 220) -> dict[str, DataFrame]:
    """Refinement step by step, and what it gained on the test rows.

    ``valid`` and ``test`` are ``iteration, y, hard``; ``descriptions`` are ``iteration,
    text``. ``steps``: scores of every iteration that has validation answers, with a
    label and an excerpt of its description; ``lift``: test accuracy of the first and the
    last iteration.
    """
    report = metrics.classification_report(valid, by=["iteration"])
    ends = report.agg(F.min("iteration").alias("first"), F.max("iteration").alias("last"))  # one row
    step, turns = F.col("iteration").cast("string"), F.col("iteration") - F.col("first")
    label = (
        F.when(turns == 0, F.concat(F.lit("Iteration "), step, F.lit(" (initial explanation)")))
        .when(F.col("iteration") == F.col("last"), F.concat(F.lit("Iteration "), step, F.lit(" (refined explanation)")))
        .otherwise(F.concat(F.lit("Iteration "), step, F.lit(" (after "), turns.cast("string"), F.when(turns == 1, " reflection step)").otherwise(" reflection steps)")))
    )
    texts = descriptions.groupBy("iteration").agg(F.min("text").alias("text"))
    steps = report.crossJoin(F.broadcast(ends)).join(texts, "iteration", "left")
    scored = metrics.classification_report(test, by=["iteration"])
    first, last = F.min_by("acc", "iteration"), F.max_by("acc", "iteration")
    lift = scored.agg(first.alias("oneshot"), last.alias("refined"), round_to(last - first, 4).alias("lift"))
    return {
        "steps": steps.select("iteration", label.alias("label"), "acc", "f1_macro", "f1_pos", normalize_text(F.col("text"), limit).alias("excerpt")),
        "lift": lift,
    }
