"""A corpus from documents to packed sequences, in five stages.

Every stage reads all that its predecessor kept, written as Parquet: toxic documents go, exact
copies go, one document of each near-duplicate class stays, sources are mixed to their target
weights, and what the mix takes is packed. Stages 1 to 4 return the columns of documents. A
document that the mix takes more than once appears once per pass, with the words taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regraph.llm.common import table, written
from regraph.llm.exact_dedup import drop_copies
from regraph.llm.mixing import mixed_documents
from regraph.llm.near_dedup import keep_one
from regraph.llm.packing import pack, tokenizer_path
from regraph.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixing", mixing), ("packing", packing)]

#: A learned score, sketches, random draws and a tokenizer: SQL does not express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
