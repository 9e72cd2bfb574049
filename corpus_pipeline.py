"""A corpus from raw documents to packed sequences: good text, once, without secrets, in the wanted mix.

All stages take nulls in any column, repeated rows and other columns of any name, and give an empty table for an empty one.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigilspark.llm import mixing, near_dup, packing, quality, secret_scan
from vigilspark.llm.common import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go, null, empty and blank texts with them; it learns from those that are labelled good. Repeated rows stay or go together."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words a shingle, a similarity of 0.8 or more. Texts without words stay; of equal ids in a group the least text hash."""
    return near_dup.keep_one(docs, words=5, percent=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kinds; all documents stay, null texts as they are."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, cut or left out so that their sources come near their targets; texts without words go, a null source is a source."""
    return mixing.repeat_by_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024: a row for each piece of a document; null and empty texts are one token."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("good", good), ("once", once), ("clean", clean), ("mixed", mixed), ("packed", packed)]

#: Models, near duplicates and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again for the next; the last one's rows are returned as they come.

    The files go below the folder that spark.checkpoint.dir names; only where it is unset (tests) below one of our own.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="pipeline")
    folder = f"{shared.rstrip('/')}/pipeline-{os.getpid()}-{spark.sparkContext.startTime}-{len(STAGES)}-{os.urandom(4).hex()}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
