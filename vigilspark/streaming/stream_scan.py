"""Scans of files as they arrive: the same projection over a stream, counts by event time behind a watermark."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..operators import scan
from ..sources.files import takes_secrets, with_names


def findings(stream: DataFrame, kind: str = "all") -> DataFrame:
    """A stream of files (path, name, suffix, size, content) -> a stream of findings; no state."""
    return scan.run_scan(stream, kind)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as a stream of text files."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*")
    rows = raw.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.octet_length("text").cast("long").alias("size"), F.col("text").alias("content"))
    return with_names(rows)


def counts(stream: DataFrame, rules: tuple[R.Rule, ...] = R.SECRET_RULES, time: str = "arrived", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """A stream of files with an event time -> matches by rule and window of it; the watermark bounds what is held."""
    found = scan.find(stream.where(takes_secrets()).withWatermark(time, late), rules, along=(time,))
    return found.groupBy(F.window(time, window), "rule").agg(F.count("*").alias("matches"))


def once_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is there now, through the stream: all findings, read back from where the stream wrote them."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="stream")
    folder = f"{shared.rstrip('/')}/stream-{os.urandom(6).hex()}"
    out = findings(read_documents(spark, sf_dir)).select("path", "scanner", "rule", "match")
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
