"""The corpus pipeline: documents to packed sequences in five stages.

1. language ID: documents without a letter go, and a null label is filled with the network's;
2. exact dedup: of equal texts the row with the largest id stays;
3. near dedup: of each group of near copies the document with the smallest id stays;
4. mixing: each document is repeated as often as the mix takes it (not at all, once or twice);
5. packing: power-of-two pieces of at most 2048 token ids.

A stage reads its predecessor's rows in full.  All but the last return the columns they got, and
extra columns go through whatever their names.

Defined results: documents with a null or letterless text go in stage 1; null and repeated ids are
rows like others; of repeated rows one is left by stage 2; a null source is a source of its own, the
last; a null label is filled; the pieces of each copy that the mix takes share a ``row``; an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm import exact_dedup, langid, mixing, near_dedup, packing
from echofold.llm.columns import unused
from echofold.runtime import shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a letter; a null label is filled with the prediction, which is
    ``und`` where no label could be learned."""
    found = unused(docs.columns, "lang_pred", "score")
    seen = langid.identify(docs, langid.train(docs), into=tuple(found)).where(langid.has_letter())
    return seen.withColumn("lang", F.coalesce("lang", found[0])).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of equal texts."""
    return exact_dedup.deduplicate(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return near_dedup.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it."""
    return mixing.repeat(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids."""
    return packing.pack(docs)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]

#: Stages 1, 3 and 5 can't be told in SQL; the tests hold all five, and their chain, against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{root}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
