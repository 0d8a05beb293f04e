"""Vector similarity against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import vectors as V


def clusters(seed=1, groups=40, each=6, dim=64):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    x = np.repeat(centre, each, axis=0) + rng.normal(size=(groups * each, dim)) * rng.choice([0.05, 0.3, 0.5], size=(groups * each, 1))
    return x.astype(np.float32) * rng.choice([0.5, 1, 3], size=(len(x), 1)).astype(np.float32)


def brute(ids, x, threshold, k):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    out = set()
    for i in range(len(ids)):
        j = [m for m in range(len(ids)) if m != i and s[i, m] >= threshold]
        j.sort(key=lambda m: (-round(s[i, m], 9), ids[m]))
        out |= {(min(ids[i], ids[m]), max(ids[i], ids[m])) for m in j[:k]}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, vector array<float>").selectExpr("*", "1 AS id", "'x' AS v", "2 AS cls", "3 AS rep")


def test_pairs_equal_brute_force(spark):
    x = clusters()
    ids = list(range(100, 100 + len(x)))
    odd = [(1, None), (2, []), (3, [0.0] * 64), (4, [1.0] * 63), (5, [float("nan")] + [1.0] * 63), (6, [float("inf")] + [1.0] * 63), (None, [1.0] * 64)]
    df = frame(spark, [*zip(ids, x.tolist()), *odd])
    got = {(min(r.id, r.other), max(r.id, r.other)) for r in V.similar_pairs(df, "vec_id", "vector", 0.85, 10, recall=0.999).collect()}
    want = brute(ids, x, 0.85, 10)
    assert not got - want and len(got & want) >= 0.995 * len(want)


def test_copies_name_the_smallest_ids(spark):
    one = [1.0, 2.0] + [0.5] * 62
    rows = [(i, [c * (1 + i % 3) for c in one]) for i in range(40)] + [(100, [2.0, -1.0] + [0.1] * 62)]
    got = {}
    for r in V.similar_pairs(frame(spark, rows), "vec_id", "vector", 0.85, 10).collect():
        got.setdefault(r.id, set()).add(r.other)
    assert set(got) == set(range(40))
    assert all(got[i] == set([j for j in range(11) if j != i][:10]) for i in got)


def test_empty_and_unusable_tables(spark):
    none = frame(spark, [])
    assert V.similar_pairs(none, "vec_id", "vector", 0.85).collect() == []
    assert V.similar_pairs(frame(spark, [(1, None), (2, [0.0] * 64)]), "vec_id", "vector", 0.85).collect() == []
    assert V.nearest(none, "vec_id", "vector", F.col("id") % 2 == 0).collect() == []


def test_nearest_recall(spark):
    x = clusters(seed=4, groups=60, each=5)
    ids = np.arange(len(x))
    df = frame(spark, [(int(i), v) for i, v in zip(ids, x.tolist())])
    got = {}
    for r in V.nearest(df, "vec_id", "vector", F.col("id") % 10 == 0).collect():
        got.setdefault(r.id, set()).add(r.other)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {int(i): set(np.argsort(-s[i])[:10].tolist()) for i in ids if i % 10 == 0}
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(got[i] & want[i]) / 10 for i in want]) >= 0.9


def test_probing_is_complete_within_the_radius():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 12, size=500).astype(np.uint32)
    found = {(min(a, b), max(a, b)) for i, j in V.probe_join(values.astype(np.uint64), V.masks(12)) for a, b in zip(i.tolist(), j.tolist())}
    want = {(a, b) for a in range(500) for b in range(a + 1, 500) if bin(int(values[a] ^ values[b])).count("1") <= 2}
    assert found == want


def test_chunks_are_complete_within_the_radius():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 14, size=400).astype(np.uint64)
    found = set()
    for start, n in V.chunk_spans(14):
        place = (values >> np.uint64(start)) & np.uint64((1 << n) - 1)
        keyed = (place << np.uint64(32)) | values
        found |= {(min(a, b), max(a, b)) for i, j in V.probe_join(keyed, V.masks(14, V.PROBE_BITS, (start, n))) for a, b in zip(i.tolist(), j.tolist())}
    assert found == {(a, b) for a in range(400) for b in range(a + 1, 400) if bin(int(values[a] ^ values[b])).count("1") <= V.PROBE_BITS}


def routed(rows, parts, blocks=None, width=12, m=6):
    """Rows that each of ``parts`` partitions meets."""
    rng = np.random.default_rng(5)
    import pyarrow as pa

    words = V.packed(rng.random((rows, width * m)) < 0.5)
    ids = np.arange(rows)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array([w.tobytes() for w in words], pa.binary())], names=["id", "cls", "code"])
    got = next(V._route(V.Shape(width, m, blocks), list(range(parts)))(iter([batch])))
    size = 16 + 8 * words.shape[1]
    return {p: len(r) // size for p, r in zip(got.column("p").to_pylist(), got.column("rows").to_pylist())}


def test_every_partition_is_used_and_none_meets_all():
    held = routed(4000, 64)
    assert len(held) == 64 and max(held.values()) < 4000 * 0.6


def test_split_cells_give_the_same_pairs(spark, monkeypatch):
    x = clusters(seed=9, groups=12, each=25)
    df = frame(spark, [(i, v) for i, v in enumerate(x.tolist())])
    pairs = lambda **k: {(min(r.id, r.other), max(r.id, r.other)) for r in V.similar_pairs(df, "vec_id", "vector", 0.85, 10, recall=0.999, **k).collect()}
    assert pairs(block_rows=20) == pairs()


@pytest.mark.parametrize("rows", [2, 1000, 10**6, 10**9])
def test_index_shape_reaches_the_recall(rows):
    width, m = V.index_shape(rows, 0.85, 0.99)
    p = math.acos(0.85) / math.pi
    near = sum(math.comb(width, i) * p**i * (1 - p) ** (width - i) for i in range(3))
    assert 1 - (1 - near) ** m >= 0.99
