"""New text files as a stream: each micro-batch is enqueued and processed.

The file source remembers what it has read in the checkpoint; the status table
makes a repeated batch harmless, since known documents are left out.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from weftgraph.engine import Engine


def stream_folder(engine: Engine, path: str, checkpoint: str, once: bool = True):
    """A running query over ``*.txt`` files; ``once`` stops when all present files are in."""
    files = engine.spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.txt").load(path)
    docs = files.select(F.col("value").alias("content"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_path"), F.col("_metadata.file_modification_time").alias("created_at"))

    def batch(rows: DataFrame, number: int) -> None:
        engine.insert(rows.withColumn("ord", F.col("file_path")), f"stream-{number}")

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
