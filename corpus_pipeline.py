"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes every stage's rows to the shared folder, reads them back for the next one and removes
what the stage itself wrote there.

Edge cases: null and empty texts are documents of low worth that the classifier scores like others; texts are
read whole, whatever their length; of equal texts the smallest id stays, of repeated rows one; an empty table
gives an empty result. Other columns of documents pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import exact, jaccard, mixing, packing, quality
from tidewheel.llm.queries import MIX_SEED, MIX_WEIGHTS, mix_levels
from tidewheel.llm.shared import materialise, release, table, written

#: The share of all tokens that the mix takes.
TOKENS_KEPT = 0.6


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; all of them if it had no labelled rows of both classes."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    if not model.learnt:
        return docs
    rows = docs.select(F.struct("*").alias("row"), "text", "n_chars")
    return quality.classify(rows, model).where("predicted = 1").select("row.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of equal texts."""
    return exact.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of near copies: five-word shingles, Jaccard 0.8 or more."""
    return jaccard.keep_one(docs, width=5, num=8, den=10)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages and sources near their weights, each document once at most."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "lang", "source", "text")
    return mixing.mix(rows, mix_levels(), MIX_WEIGHTS, TOKENS_KEPT, epochs=1, seed=MIX_SEED).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of power-of-two lengths, none across documents."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality", good_quality), ("exact", without_copies), ("near", without_near_copies), ("mix", mixed), ("pack", packed)]

#: Hashed orders, a fitted model and a tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        mark = written()
        out = stage(spark, docs, sf_dir)
        inner = written()
        docs = materialise(out)
        release(mark, inner)
    return STAGES[-1][1](spark, docs, sf_dir)
