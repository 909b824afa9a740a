"""The operators over their whole tables, with the parameters of production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, collocations, langid, lm, mixing, packing, simhash, suffix, syncmers, token_files, toxicity, vectors
from .common import fold
from .registry import ORACLES, QUERIES, query, table  # noqa: F401  (the full tables, once this module is read)


@query("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(spark, table(spark, sf_dir, "documents"), end_id=2)


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), end_id=0, capacity=2048)


@query("op7_simhash_near_duplicates")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.predict(docs, model, ["doc_id", "held_out"])


@query("op4_weighted_fair_mixing", mixing.ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op10_closed_syncmers")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


@query("op6_perspective_rotation", chat.ORACLE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.rotate(table(spark, sf_dir, "conversations")))


@query("op1_log_bilinear_lm")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 7) == 2)
    model = lm.fit(docs.filter(~F.col("held_out")))
    return lm.score(docs, model, ["doc_id", "held_out"])


@query("op8_nn_descent")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


@query("op3_suffix_array_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(table(spark, sf_dir, "documents"), length=100)


@query("op11_centroid_clusters", centroids.oracle())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), clusters=40, rounds=5)


@query("op12_ftrl_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    model = toxicity.fit(docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, ["doc_id", "held_out"])


@query("op13_setm_collocations", collocations.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), longest=3, least=10, inside=50, top=2000)
