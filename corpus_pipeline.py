"""Documents from raw to packed: language, exact copies, near copies, mixture, bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candex.llm.exact import DigestIndex, digest, drop_copies
from candex.llm.language import bucket, fit_languages, predict_language
from candex.llm.minhash import drop_near_duplicates
from candex.llm.mixing import mixed, word_count
from candex.llm.packing import pack
from candex.plans.limits import pin


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents stay whose language is told with a probability of at least one half.

    Texts without a letter go, and those between whose likeliest languages the model cannot decide. A text in a language that no
    label names counts as the nearest known one. Learns from two thirds of the labels; without any, everything stays.
    """
    model = fit_languages(docs, bucket("doc_id", 3) != 1)
    if not model.languages:
        return docs
    # The whole row as one column: its names cannot clash with those that are added.
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    told = predict_language(rows, model, ["row"])
    return told.where("lang_pred <> 'und' AND score >= 0.5").select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of documents with one text the longest stays."""
    index = DigestIndex.open(spark)
    kept = pin(drop_copies(docs, index))
    index.close()
    return kept


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of documents linked by 80 % of their five-word runs the first stays."""
    return drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: sources mixed by weight along a curriculum; a document can come up to three times, or not at all."""
    return mixed(docs)


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: bins of 2048 words, with equal texts apart and at most two documents of a source together."""
    return pack(docs.select("doc_id", "source", word_count("text").alias("size"), digest("text").alias("cluster")))


STAGES = [
    ("language", languages), ("exact dedup", exact_copies), ("near dedup", near_copies), ("mixture", mixture), ("packing", bins),
]

#: Language models and MinHash cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of a folder, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir))
    return docs
