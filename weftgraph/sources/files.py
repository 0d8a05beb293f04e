"""Text folders and literal texts as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text as X


def text_folder(spark: SparkSession, path: str, processed: DataFrame | None = None) -> DataFrame:
    """``id, content, file_path`` of the non-blank ``*.txt`` files that are not processed yet."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    named = files.select(F.col("value").alias("content"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_path")).where(F.length(X.strip(F.col("content"))) > 0)
    named = named.withColumn("file_path", F.url_decode("file_path"))
    if processed is not None:
        named = named.join(processed.select("file_path"), "file_path", "left_anti")
    return named.select(X.record_id("doc-", F.col("content")).alias("id"), "content", "file_path")


def literal_texts(texts: DataFrame, text: str = "text", place: str = "ord", processed: DataFrame | None = None) -> DataFrame:
    """``id, content, ord`` of non-blank texts that are passed as such and not processed yet (``processed``: ``id``)."""
    rows = texts.where(F.length(F.trim(text)) > 0).select(X.literal_id(F.col(place), F.col(text)).alias("id"), F.col(text).alias("content"), F.col(place).alias("ord"))
    return rows if processed is None else rows.join(processed.select("id"), "id", "left_anti")


def json_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A key-value store kept as JSON lines."""
    return spark.read.schema(schema).json(path)


def jdbc_store(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], parts: int = 32, **options: str) -> DataFrame:
    """A relational store, read in ranges of a numeric key so that executors share the work."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.options(**options).load()
