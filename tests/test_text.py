import math
import random

import pytest
from pyspark.sql import functions as F

from exposurekit.functions import columns as C
from exposurekit.operators import prompts as T
from exposurekit.operators import responses as R

NUMBERS = [
    0.0, 1.0, -3.0, 0.25, 1234567.0, 1e7, 12345678.9, 123456789.125, 1e15, 1e16, 1.5e17, 0.001, 0.0001, 0.00012,
    0.00001, 1.5e-7, -2.5e-5, -1e7, 0.1 + 0.2, 1 / 3, 99.99, float("nan"), None,
]


def test_numbers_print_as_in_python(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(NUMBERS)], "i int, x double")
    got = [r["t"] for r in df.select("i", C.value_text("x", df.schema["x"].dataType).alias("t")).orderBy("i").collect()]
    want = ["nan" if x is None or math.isnan(x) else repr(x) for x in NUMBERS]
    assert got == want


def test_random_numbers_print_as_in_python(spark):
    rng = random.Random(1)
    numbers = [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 15) for _ in range(3000)]
    numbers += [round(rng.uniform(0, 1e9), 2) for _ in range(1000)] + [float(rng.randint(0, 10**15)) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(numbers)), "i int, x double")
    got = df.select("i", C.decimal_text(F.col("x")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == [repr(x) for x in numbers]


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_id int, text string")


def parsed(df, column):
    return [r["p"] for r in df.select("row_id", column.alias("p")).orderBy("row_id").collect()]


def test_digit_parsing(spark):
    df = texts(spark, ["1", " 0", "no 1, rather 0", "yes", "", None, "23"])
    assert parsed(df, R.parse_digit(F.col("text"))) == [1, 0, 1, 0, 0, 0, 0]
    assert parsed(df, R.parse_digit(F.col("text"), default=1)) == [1, 0, 1, 1, 1, 1, 1]


def test_answer_first_parsing(spark):
    df = texts(spark, ["0 maybe\nAnswer: 1", "Answer:0\nAnswer: 1", "it is 1", "Answer: 7 or 0", "none", None])
    assert parsed(df, R.parse_answer_first(F.col("text"))) == [1, 0, 1, 0, 0, 0]


def test_batch_parsing(spark):
    rows = spark.createDataFrame([(b, i, 10 * b + i) for b in (0, 1) for i in range(4)], "batch int, local int, row_id int")
    # last match wins, out of range is ignored, 3=10 reads as 3 -> 1, huge indexes do not fail
    answers = spark.createDataFrame([(0, "0=0\n0 = 1\n99=1\n3=10\n99999999999999999999=1"), (1, None)], "batch int, text string")
    got = {r["row_id"]: (r["hard"], r["parsed"]) for r in R.parse_batch(answers, rows).collect()}
    assert got == {
        0: (1, True), 1: (0, False), 2: (0, False), 3: (1, True),
        10: (0, False), 11: (0, False), 12: (0, False), 13: (0, False),
    }
    assert R.unparsed_count(R.parse_batch(answers, rows)).first()["n"] == 6


def test_probability_of_a_token(spark):
    df = spark.createDataFrame([("1", -0.1), (" 0\n", -0.1), ("yes", -0.1), (None, None)], "t string, lp double")
    got = [r["p"] for r in df.select(R.prob_from_logprob(F.col("t"), F.col("lp")).alias("p")).collect()]
    assert got == [pytest.approx(math.exp(-0.1)), pytest.approx(1 - math.exp(-0.1)), 0.5, 0.5]


def test_ranking_text(spark):
    df = spark.createDataFrame([("t", "s_fans_user_num, then cat_ctr and user_n")], "text_id string, text string")
    features = ["user_n", "cat_ctr", "s_fans_user_num", "gone", "away"]

    def order(**options):
        return [r["feature"] for r in R.parse_ranking(df, features, **options).orderBy("rank").collect()]

    assert order() == ["s_fans_user_num", "user_n", "cat_ctr", "gone", "away"]
    assert order(whole_word=True) == ["s_fans_user_num", "cat_ctr", "user_n", "gone", "away"]


def test_normalized_text(spark):
    df = texts(spark, ["  a\nb  c \n", "x" * 30, "y  " * 20, None])
    assert parsed(df, C.normalize_text(F.col("text"))) == ["a b  c", "x" * 30, ("y  " * 20).strip(), None]
    assert parsed(df, C.normalize_text(F.col("text"), limit=10)) == ["a b c", "x" * 10 + " ...", "y y y y y  ...", None]


def modelling(spark):
    return spark.createDataFrame(
        [(1, 1, "18-23", 3.0, 7), (2, 0, None, None, 7)],
        "row_id int, clicked int, u_age string, s_price double, ctx_hour int",
    )


FEATURES = ["u_age", "s_price", "ctx_hour"]
LINES = ["user.age=18-23 | streamer.price=3.0 | ctx.hour=7", "user.age=nan | streamer.price=nan | ctx.hour=7"]


def test_serialised_rows(spark):
    got = T.serialize(modelling(spark), FEATURES).orderBy("row_id").collect()
    assert [r["text"] for r in got] == LINES
    other = T.serialize(modelling(spark), T.shuffled(FEATURES, 5), idx="row_id").orderBy("row_id").first()["text"]
    assert other.startswith("[1] ") and sorted(other[4:].split(" | ")) == sorted(LINES[0].split(" | "))


def test_prompt_forms(spark):
    df = modelling(spark).withColumn("pred", F.lit(1)).withColumn("why", F.lit("young user"))
    row = T.predict_prompt(df, FEATURES).orderBy("row_id").first()["prompt"]
    assert row.startswith("You are predicting user engagement") and LINES[0] in row and row.endswith("0 = no click.")
    noted = T.predict_prompt(df, FEATURES, F.lit("be brief")).orderBy("row_id").first()["prompt"]
    assert noted == f"CORRECTION NOTES (from analyzing prediction errors):\nbe brief\n\n{row}"
    assert T.predict_prompt(df, FEATURES, F.lit("")).orderBy("row_id").first()["prompt"] == row
    explained = T.explain_prompt(df, FEATURES, "pred").orderBy("row_id").first()["prompt"]
    assert "The model predicts: click (1)." in explained
    plain = T.sft_messages(df, FEATURES).orderBy("row_id").first()["messages"]
    assert [m["role"] for m in plain] == ["user", "assistant"] and plain[0]["content"] == row and plain[1]["content"] == "1"
    told = T.sft_messages(df, FEATURES, rationale="why").orderBy("row_id").first()["messages"]
    assert told[1]["content"] == "Answer: 1\nBecause: young user"
    segments = T.segment_weights(df, 0.05, rationale="why").orderBy("row_id").first()["segments"]
    assert "".join(s["segment"] for s in segments) == told[1]["content"]
    assert [s["weight"] for s in segments] == [1.0, 0.05]


def test_prompt_blocks(spark):
    df = modelling(spark).withColumn("ordinal", F.col("row_id") - 1)
    block = T.labeled_examples_block(df, FEATURES, 300, "row_id").collect()
    assert len(block) == 1 and block[0]["n"] == 2
    assert {f"[clicked=1] {LINES[0]}", f"[clicked=0] {LINES[1]}"} <= set(block[0]["prompt"].split("\n"))
    batch = T.batched_prompts(df, FEATURES, 50, F.lit("RULES")).collect()
    assert len(batch) == 1 and batch[0]["prompt"].startswith("LEARNED CLICK PATTERNS:\nRULES\n\n")
    assert batch[0]["prompt"].endswith(f"[0] {LINES[0]}\n[1] {LINES[1]}")
    assert len(T.batched_prompts(df, FEATURES, 1, F.lit("RULES")).collect()) == 2
    wrong = df.withColumn("hard", F.lit(0)).filter("clicked <> hard")
    notes = T.error_block(wrong, FEATURES).collect()
    assert notes[0]["prompt"] == f"Mispredicted exposures (true vs predicted):\n[true=1, predicted=0] {LINES[0]}"
    rewrite = T.error_block(wrong.withColumn("d", F.lit("OLD")), FEATURES, description="d").collect()
    assert rewrite[0]["prompt"].startswith("CURRENT DESCRIPTION:\nOLD\n\n")
    assert T.error_block(wrong.filter("false"), FEATURES).collect() == []


def test_missing_answer_policies(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "row_id int")
    preds = spark.createDataFrame([(1, 1, 0.9), (2, 0, None)], "row_id int, hard int, prob double")
    hard0 = {r["row_id"]: (r["hard"], r["prob"]) for r in R.attach_predictions(rows, preds).collect()}
    assert hard0 == {1: (1, 0.9), 2: (0, None), 3: (0, None)}
    half = {r["row_id"]: (r["hard"], r["prob"]) for r in R.attach_predictions(rows, preds, "prob_half").collect()}
    assert half == {1: (1, 0.9), 2: (1, 0.5), 3: (1, 0.5)}
    texts_only = preds.select("row_id", "hard")
    assert {r["hard"] for r in R.attach_predictions(rows, texts_only).collect()} == {0, 1}
    with pytest.raises(ValueError):
        R.attach_predictions(rows, preds, "other")


def test_chat_messages(spark):
    df = T.teacher_prompt(modelling(spark), FEATURES)
    told = T.chat_messages(df, system="SYS").orderBy("row_id").first()
    assert [(m["role"], m["content"]) for m in told["messages"]] == [("system", "SYS"), ("user", told["prompt"])]
    assert [m["role"] for m in T.chat_messages(df).first()["messages"]] == ["user"]
