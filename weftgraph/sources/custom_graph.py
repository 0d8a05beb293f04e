"""Ready-made chunks, entities and relations as a source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text as X

UNKNOWN = "UNKNOWN"


def chunk_rows(chunks: DataFrame, doc: str) -> DataFrame:
    """Chunk rows of ``content, source_id, file_path, chunk_order_index`` with content ids."""
    body = X.sanitize(F.col("content"))
    return chunks.withColumn("content", body).select(
        X.record_id("chunk-", F.col("content")).alias("id"), "content", X.n_words(F.col("content")).alias("tokens"), F.coalesce("chunk_order_index", F.lit(0)).alias("chunk_order_index"),
        F.lit(doc).alias("full_doc_id"), F.coalesce("file_path", F.lit("custom_kg")).alias("file_path"), "source_id",
    )


def load(chunks: DataFrame, entities: DataFrame, relations: DataFrame, doc: str = "custom") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(chunks, nodes, edges)``; sources map to chunk ids, a miss becomes UNKNOWN.

    Endpoints without an entity become nodes of unknown type.
    """
    rows = chunk_rows(chunks, doc)
    to = rows.groupBy("source_id").agg(F.min("id").alias("chunk"))
    known = lambda d: d.join(to, "source_id", "left").withColumn("source_id", F.coalesce("chunk", F.lit(UNKNOWN))).drop("chunk")
    nodes = known(entities).select("entity_name", F.coalesce("entity_type", F.lit(UNKNOWN)).alias("entity_type"), F.coalesce("description", F.lit("No description provided")).alias("description"), "source_id")
    edges = known(relations).select(F.least("src_id", "tgt_id").alias("src"), F.greatest("src_id", "tgt_id").alias("tgt"), F.coalesce("weight", F.lit(1.0)).alias("weight"), "keywords", "description", "source_id")
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("entity_name"), "source_id").groupBy("entity_name").agg(F.min("source_id").alias("source_id"))
    lost = ends.join(nodes.select("entity_name"), "entity_name", "left_anti").select("entity_name", F.lit(UNKNOWN).alias("entity_type"), F.lit(UNKNOWN).alias("description"), "source_id")
    return rows, nodes.unionByName(lost), edges


def new_chunks(chunks: DataFrame, docs: DataFrame, store: DataFrame) -> DataFrame:
    """Chunks whose document and whose content are both new."""
    return chunks.join(docs.select(F.col("id").alias("full_doc_id")).distinct(), "full_doc_id", "left_anti").join(store.select("id").distinct(), "id", "left_anti")
