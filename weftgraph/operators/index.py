"""A partitioned vector index for single-query search: inverted lists around centroids.

Centroids are fitted on a bounded sample; every row is assigned to its nearest
one and lies in that list's folder, so a search reads only the folders of the
lists nearest to the query and ranks their rows by the exact cosine.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftgraph.operators import vectors as V

#: Rows on which the centroids are fitted, and how many lists there are at most (their broadcast is bounded).
FIT_ROWS, MOST_LISTS = 20_000, 4096
ROUNDS, PROBES = 8, 16


def centroids(sample, lists: int, seed: int = 7):
    """Unit centroids by spherical k-means."""
    import numpy as np

    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), size=min(lists, len(sample)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([(sample[a : a + 4096] @ c.T).argmax(axis=1) for a in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)  # an empty list keeps its centroid
    return c.astype(np.float32)


def _lists(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        c = shared.value
        for batch in batches:
            n = batch.num_rows
            if n:
                x = batch.columns[-1].flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((x @ c.T).argmax(axis=1).astype(np.int32))], names=[*batch.schema.names, "_list"])

    return run


def build(rows: DataFrame, path: str, dim: int, vector: str = "vector", lists: int | None = None) -> int:
    """Write the index of all usable rows (right length, finite, not zero) with their other columns; the number of lists."""
    import numpy as np

    spark = rows.sparkSession
    v = F.col(vector)
    rest = [c for c in rows.columns if c != vector]
    norm = F.sqrt(V.dot(v, v))
    fine = rows.where((F.size(v) == dim) & (norm > 0) & (norm < float("inf"))).select(*rest, v.cast("array<float>").alias(vector))
    n = fine.count()
    lists = min(MOST_LISTS, lists or max(1, round(n**0.5)))
    share = min(1.0, 2 * FIT_ROWS / max(1, n))
    h = F.xxhash64(vector)
    sample = fine.where(h / F.lit(2.0**63) <= -1 + 2 * share).orderBy(h).limit(FIT_ROWS).select(vector).toPandas()
    x = np.stack(sample[vector].to_numpy()).astype(np.float32) if len(sample) else np.ones((1, dim), np.float32)
    c = centroids(x / np.linalg.norm(x, axis=1, keepdims=True), lists)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fine.schema.fields)
    placed = fine.mapInArrow(_lists(spark.sparkContext.broadcast(c)), f"{kinds}, _list int")
    placed.hint("rebalance", "_list").write.mode("overwrite").partitionBy("_list").parquet(f"{path}/lists")
    spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(c)], "list int, centroid array<float>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    spark.createDataFrame([(placed.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")  # an empty index has no file that tells it
    return len(c)


def search(spark: SparkSession, path: str, query: list[float], k: int, key: str = "id", vector: str = "vector", threshold: float = V.THRESHOLD, probes: int = PROBES) -> DataFrame:
    """The ``k`` most similar rows of the ``probes`` lists nearest to the query, by exact cosine; as ``top_k``."""
    near = V.top_k(spark.read.parquet(f"{path}/centroids"), query, probes, "list", "centroid", threshold=-2.0)
    wanted = [r["list"] for r in near.select("list").collect()]  # as many as probes
    schema = StructType.fromJson(json.loads(spark.read.text(f"{path}/schema").first()["value"]))
    rows = spark.read.schema(schema).parquet(f"{path}/lists").where(F.col("_list").isin(wanted)).drop("_list")
    return V.top_k(rows, query, k, key, vector, threshold)
