"""The operators as stages of a pipeline: documents in, documents out.

Every stage takes (spark, docs, sf_dir) and looks at all of ``docs``. Columns of
``docs`` are carried as one struct, so their names cannot clash with an operator's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, mixing, packing, simhash, suffix
from .common import fold, stored

LEAST_SCORE = 0.5


def _packed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*docs.columns).alias("doc"), *[F.col(c) for c in ("doc_id", "text", "lang", "source") if c in docs.columns])


def _numbered(docs: DataFrame) -> DataFrame:
    """``_packed`` with ``doc_id`` unique: as it is, or, if missing or repeated ones are among them, a number written once."""
    packed = _packed(docs)
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("distinct")).first()
    if row["n"] == row["distinct"]:
        return packed
    return stored(packed.withColumn("doc_id", F.monotonically_increasing_id()), "stage-rows")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of at least ``LEAST_SCORE``; ``und`` goes."""
    rows = _packed(docs)
    model = langid.fit(rows.filter(fold(F.col("doc_id"), 3) != 1))
    clear = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    if model.whole:  # one pass
        return langid.predict(rows, model, ["doc"]).filter(clear).select("doc.*")
    rows = _numbered(docs)  # what is written and joined holds numbers, not documents
    told = langid.predict(rows, model, ["doc_id"]).filter(clear).select("doc_id")
    return rows.join(told, "doc_id", "left_semi").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: the one with the smallest doc_id."""
    rows = _numbered(docs)
    groups = simhash.near_duplicates(rows, shingle=3, max_bits=2)
    first = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id")
    return rows.join(first, "doc_id", "left_semi").select("doc.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occurred before; a document that was all repeats goes.

    Bytes of a character that was cut through are dropped; n_chars follows the text.
    """
    cut = suffix.without_repeats(_packed(docs), length=100, with_kept=True, carry=["doc"])
    left = cut.filter((F.col("n_removed") == 0) | (F.octet_length("kept") > 0))
    text = F.when(F.col("n_removed") == 0, F.col("doc.text")).otherwise(F.col("kept_text"))
    replaced = {"text": text.alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return left.select(*[replaced.get(c, F.col(f"doc.`{c}`")) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one that it takes in part stays whole."""
    rows = _numbered(docs)
    taken = mixing.mix(rows).filter("taken > 0").select("doc_id", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("times"))
    again = rows.select("doc_id", "doc").join(taken, "doc_id")
    return again.withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, end_id=0, capacity=2048)
