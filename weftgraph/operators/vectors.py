"""Vector search: cosine top-k, look-ups and pairwise similarity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.2
BLOCK_ROWS = 4000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is null, of another length, zero or not finite."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0) & (norm < float("inf")), dot(a, b) / norm)


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def scored(rows: DataFrame, query: list[float], vector: str = "vector", out: str = "score") -> DataFrame:
    """Rows with their similarity to a query; the query's norm is a constant."""
    size = sum(float(x) ** 2 for x in query) ** 0.5
    v, q = F.col(vector), literal(query)
    norm = F.sqrt(dot(v, v))
    ok = v.isNotNull() & (F.size(v) == len(query)) & (norm > 0) & (norm < float("inf"))  # NaN is the largest number here
    return rows.withColumn(out, F.when(ok, dot(v, q) / (norm * F.lit(size or None).cast("double"))))


def top_k(rows: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "vector", threshold: float = THRESHOLD, strict: bool = False) -> DataFrame:
    """The ``k`` most similar rows at (``strict``: above) the threshold; equal scores by key.

    Planned as one scan with a top-k in each task and a merge of those.
    """
    s = scored(rows, query, vector).drop(vector)
    good = F.col("score") > threshold if strict else F.col("score") >= threshold
    return s.where(good & ~F.isnan("score")).orderBy(F.desc("score"), key).limit(k)


def top_k_then_threshold(rows: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "vector", threshold: float = THRESHOLD) -> DataFrame:
    """The other order: first ``k``, then the threshold."""
    s = scored(rows, query, vector).drop(vector).where("score IS NOT NULL AND NOT isnan(score)")
    return s.orderBy(F.desc("score"), key).limit(k).where(F.col("score") >= threshold)


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def delete_entity(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(~F.col("entity_name").eqNullSafe(name))


def delete_relations_of(rows: DataFrame, name: str) -> DataFrame:
    """Relation rows without those that start or end at a name."""
    return rows.where(~(F.col("src").eqNullSafe(name) | F.col("tgt").eqNullSafe(name)))


def embed(rows: DataFrame, model, text: str, out: str = "vector") -> DataFrame:
    """Vectors of a text column; a batch with a wrong count fails loudly."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            got = model(s.tolist())
            if len(got) != len(s):
                raise ValueError(f"{len(got)} vectors for {len(s)} texts")
            yield pd.Series(list(got))

    return rows.withColumn(out, F.pandas_udf(run, "array<float>")(F.col(text)))


def _block(threshold: float):
    def run(key, left, right):
        import numpy as np

        none = pd.DataFrame({"a": [], "b": [], "score": []}).astype({"a": "int64", "b": "int64", "score": "float64"})
        if not len(left) or not len(right):
            return none
        x, y = (np.stack(d.to_numpy()).astype(np.float64) for d in (left["v"], right["v2"]))
        x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
        a, b = left["id"].to_numpy(), right["id2"].to_numpy()
        i, j = np.nonzero(x @ y.T >= threshold - 1e-9)
        s = np.einsum("ij,ij->i", x[i], y[j])
        keep = (s >= threshold) & ((a[i] < b[j]) if key[0] == key[1] else True)
        lo, hi = np.minimum(a[i], b[j])[keep], np.maximum(a[i], b[j])[keep]
        return pd.DataFrame({"a": lo, "b": hi, "score": s[keep]})

    return run


def similar_pairs(rows: DataFrame, key: str, vector: str, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``a, b, score`` of all pairs at or above the threshold, exactly.

    Blocks of rows meet as matrices, each pair of blocks once, so no row-wise
    cross product is made.  The work is quadratic by definition; it suits
    collections up to some hundred thousand vectors.
    """
    v = F.col(vector)
    fine = rows.where(v.isNotNull() & (dot(v, v) > 0)).select(F.col(key).cast("bigint").alias("id"), v.alias("v"))
    blocks = max(1, -(-fine.count() // block_rows))
    put = fine.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left = put.withColumn("q", F.explode(F.sequence(F.col("p"), F.lit(blocks - 1))))
    # Fresh columns: both sides come from one table.
    right = put.select(F.col("id").alias("id2"), F.col("v").alias("v2"), F.col("p").alias("q2")).withColumn("p2", F.explode(F.sequence(F.lit(0), F.col("q2"))))
    return left.groupBy("p", "q").cogroup(right.groupBy("p2", "q2")).applyInPandas(_block(threshold), "a bigint, b bigint, score double")


def _bands(width: int, bands: int, dim: int, seed: int):
    """For every row and band the sign pattern of ``width`` random projections."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        planes = np.random.default_rng(seed).normal(size=(dim, width * bands)).astype(np.float32)
        weights = (1 << np.arange(width)).astype(np.int64)
        for b in batches:
            if len(b):
                bits = (np.stack(b["v"].to_numpy()).astype(np.float32) @ planes >= 0).reshape(len(b), bands, width)
                key = (bits * weights).sum(axis=2) * bands + np.arange(bands)
                yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), bands), "key": key.reshape(-1)})

    return run


def near_pairs(rows: DataFrame, key: str, vector: str, threshold: float, dim: int, recall: float = 0.98, seed: int = 3) -> DataFrame:
    """``a, b, score`` of pairs at or above the threshold that share a band of random projections.

    The scalable candidate search: bands of about log2(rows) signs, as many as
    the wanted recall at the threshold needs, so that a cell holds few unrelated
    rows.  Scores are exact; ``similar_pairs`` finds every pair instead.
    """
    import math

    from weftgraph.plans import Scratch

    scratch = Scratch(rows.sparkSession, "bands")
    v = F.col(vector)
    fine = scratch.save(rows.where((F.size(v) == dim) & (dot(v, v) > 0) & ~F.isnan(dot(v, v))).select(F.col(key).cast("bigint").alias("id"), v.cast("array<float>").alias("v")))
    width = max(6, math.ceil(math.log2(max(2, fine.count()))) - 2)
    same = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** width
    bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(same, 0.999))))
    keyed = scratch.save(fine.mapInPandas(_bands(width, bands, dim, seed), "id bigint, key bigint"))
    met = keyed.toDF("a", "key").join(keyed.toDF("b", "key"), "key").where("a < b").select("a", "b").distinct()
    scored = met.join(fine.toDF("a", "va"), "a").join(fine.toDF("b", "vb"), "b").select("a", "b", cosine(F.col("va"), F.col("vb")).alias("score"))
    return scored.where(F.col("score") >= threshold)
