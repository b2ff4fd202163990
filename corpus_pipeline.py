"""From raw documents to packed training sequences: five stages, each written before the next reads it.

1. language ID: documents without a letter, or like no known language, go.
2. quality classifier: documents that score below 0.3 go.
3. n-gram Jaccard join: of each group of near copies the document with the smallest id stays.
4. mixing sources to target weights: copies are dealt along the curriculum; the row order is the order of training.
5. best-fit packing: pieces of documents get their places in sequences of 1024 tokens.

Each stage works on all rows that the one before kept. All but the last return the columns of ``documents``. Null or empty
texts go in stage 1; equal rows go in stage 3, except that stage 4 deals copies on purpose. Of ties (near copies of equal id) one
row stays. Further columns of ``documents`` are carried through to stage 4, whatever their names; rows whose id is null are
documents like others. Texts are never cut, except that a source's last copy ends at its target. An empty table passes through as
an empty table. A stage's intermediate tables, and the stage before it, are removed when its result is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rarebucket.llm import jaccard_join, langid, mixing, nbsvm, packing
from rarebucket.llm.common import kept_tables, removed, shared_folder, table, tidy


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.with_language(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nbsvm.of_quality(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, added=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality", quality),
    ("near_copies", near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: The classifiers and the packing are not SQL; a test holds all stages against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what is between them lies in the shared checkpoint folder."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, last, already = table(spark, sf_dir, "documents"), None, kept_tables()
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        tidy(spark, already)
        if last:
            removed(spark, f"{folder}/{last}")
        last = name
    return docs
