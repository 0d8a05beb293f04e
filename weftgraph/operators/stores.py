"""Key-value, document-status and enqueue operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import text as X


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row a key: the first by ``order``."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def get_by_ids(store: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """``ids (pos, id)`` with the stored columns; misses stay as nulls, order is ``pos``."""
    return ids.join(store, key, "left")


def get_by_id(store: DataFrame, ident, key: str = "id") -> DataFrame:
    """The row of one id, if any."""
    return store.where(F.col(key) == F.lit(ident))


def get_all(store: DataFrame) -> DataFrame:
    """All rows; missing write times are 0."""
    return store.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("create_time", "update_time") if c in store.columns})


def by_value(status: DataFrame, column: str, value) -> DataFrame:
    """Documents of a status or a track."""
    return status.where(F.col(column) == F.lit(value))


def by_ids(status: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Documents of the asked ids; misses are left out."""
    return status.join(ids.select(key).distinct(), key, "left_semi")


def missing_keys(keys: DataFrame, store: DataFrame, key: str = "id") -> DataFrame:
    return keys.select(key).distinct().join(store, key, "left_anti")


def upsert(store: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The store after replacing the rows of the new keys as wholes."""
    return store.join(new.select(key), key, "left_anti").unionByName(new.select(store.columns))


def delete(store: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return store.join(ids.select(key), key, "left_anti")


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def all_status_counts(status: DataFrame) -> DataFrame:
    """Counts by status and a grand total row ``all``."""
    by = status.rollup("status").agg(F.count(F.lit(1)).alias("n"), F.grouping("status").alias("g"))
    return by.select(F.when(F.col("g") == 1, "all").otherwise(F.col("status")).alias("status"), "n")


SORT_FIELDS = ("created_at", "updated_at", "id", "file_path")


def page(status: DataFrame, of: str | None = None, number: int = 1, size: int = 50, field: str = "updated_at", direction: str = "desc") -> DataFrame:
    """One page with ``total_count``; bad arguments fall back to the defaults.

    The total is one aggregated row joined to the page, so no window ever
    gathers the table in one task.
    """
    number, size = max(1, number), min(200, max(10, size))
    field = field if field in SORT_FIELDS else "updated_at"
    down = direction.lower() != "asc"
    rows = status if of is None else status.where(F.col("status") == of)
    key = F.lower(field) if field == "file_path" else F.col(field)
    order = key.desc_nulls_last() if down else key.asc_nulls_first()
    total = rows.agg(F.count(F.lit(1)).alias("total_count"))
    tie = [F.col(c) for c in ("id", "created_at", "updated_at") if c in status.columns]
    top = rows.orderBy(order, *tie).limit(number * size).withColumn("_p", F.monotonically_increasing_id())
    return top.orderBy(order, *tie).offset((number - 1) * size).limit(size).drop("_p").crossJoin(F.broadcast(total))  # a single row


def enqueue(docs: DataFrame, known: DataFrame, track: str) -> tuple[DataFrame, DataFrame]:
    """``(full_docs, doc_status)`` of new documents.

    ``docs``: ``ord, content, file_path, created_at, id?``.  Contents are sanitized,
    the first of equal ones is kept, ids are the md5 of the content where the
    caller gives none, and ids that ``known`` has are left out.  Given ids must
    differ.
    """
    own = F.col("id") if "id" in docs.columns else F.lit(None).cast("string")
    clean = docs.withColumn("_own", F.when(F.length(own) > 0, own)).withColumn("content", X.sanitize(F.col("content"))).where(F.length("content") > 0)
    if "id" in docs.columns and clean.where("_own IS NOT NULL").groupBy("_own").count().where("count > 1").limit(1).count():
        raise ValueError("ids must be unique")
    first = latest(clean.withColumn("_c", F.md5("content")), "_c", F.col("ord")).drop("_c")
    ident = first.withColumn("id", F.coalesce("_own", X.record_id("doc-", F.col("content")))).drop("_own")
    fresh = latest(ident, "id", F.col("ord")).join(known.select("id"), "id", "left_anti")
    status = fresh.select(
        "id", X.summary(F.col("content")).alias("content_summary"), F.length("content").alias("content_length"),
        F.coalesce("file_path", F.lit(X.UNKNOWN_SOURCE)).alias("file_path"), F.lit("pending").alias("status"),
        F.col("created_at"), F.col("created_at").alias("updated_at"), F.lit(track).alias("track_id"),
    )
    return fresh.select("id", "content"), status


def error_documents(errors: DataFrame, track: str) -> DataFrame:
    """Failed status rows of ``file_path, description, created_at``."""
    return errors.select(
        X.record_id("error-", F.col("file_path"), F.lit("-"), F.col("description")).alias("id"), F.col("description").alias("content_summary"),
        F.lit("failed").alias("status"), "file_path", F.lit(track).alias("track_id"), F.col("description").alias("error_msg"),
    )


def regroup_chunks(chunks: DataFrame) -> DataFrame:
    """Document texts from their chunks in order, joined by blank lines."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_order_index", "id", "content")))
    return chunks.groupBy("full_doc_id").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n\n").alias("content"), F.count(F.lit(1)).alias("n_chunks"))


def consistency(status: DataFrame, full_docs: DataFrame) -> DataFrame:
    """Action for each unfinished document: delete, keep or retry."""
    both = status.join(full_docs.select("id", F.lit(True).alias("has")), "id", "left")
    act = F.when(F.col("has").isNull() & (F.col("status") != "failed"), "delete").when(F.col("has").isNull(), "keep").when(F.col("status").isin("processing", "failed"), "retry").otherwise("none")
    return both.where(F.col("status") != "processed").select("id", "status", act.alias("action"))
