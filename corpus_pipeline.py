"""A corpus pipeline of the operators in ``orograph.llm``: each stage works on all rows
its predecessor kept, and each but the last returns the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orograph.llm import decontaminate, packing, secrets, simhash, toxicity
from orograph.llm.common import cut, read
from orograph.shared import drop, tables


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model, learned from the labels, finds toxic go."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document of the smallest id stays."""
    return simhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words in benchmark windows go."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a placeholder; all documents stay."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]
#: The tokenizer and the models are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again. What a
    stage wrote on its way, and the table before it, go once its own table is written."""
    docs = read(spark, sf_dir, "documents")
    with tables() as written:
        for _, stage in STAGES[:-1]:
            docs = cut(stage(spark, docs, sf_dir))
            drop(spark, written[:-1])
            del written[:-1]
    return STAGES[-1][1](spark, docs, sf_dir)
