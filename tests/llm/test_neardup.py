"""Near-duplicate records against brute force."""

import random

import numpy as np
import pytest

from weftgraph.llm import neardup


def brute(rows, t, size):
    sets = {}
    for k, text in rows:
        w = neardup.WORD.findall(text.lower()) if text else []
        s = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        if k is not None and s:
            sets[k] = s
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + list("漢字檢索") + ["é1"]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 8, 30, 200]))] for _ in range(n // 4)]
    rows = []
    for k in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((k, " ".join(w) + rng.choice(["", ".", "  "])))
    return [*rows, (1000, None), (1001, ""), (1002, "one two"), (1003, "\x00\n"), (None, rows[0][1])]


@pytest.mark.parametrize("t,size,block", [(0.5, 3, 50_000), (0.8, 5, 50_000), (0.5, 3, 4)])
def test_pairs_equal_brute_force(spark, t, size, block):
    rows = corpus(int(t * 10) + size)
    df = spark.createDataFrame(rows, "chunk_row bigint, content string").selectExpr("*", "1 AS id", "'x' AS t", "2 AS n")
    pairs, members = neardup.near_pairs(df, "chunk_row", "content", t, size, block_rows=block)
    got = {tuple(r) for r in neardup.all_record_pairs(pairs, members).collect()}
    assert got == brute(rows, t, size)


def test_empty_table(spark):
    df = spark.createDataFrame([], "chunk_row bigint, content string")
    pairs, members = neardup.near_pairs(df, "chunk_row", "content")
    assert pairs.collect() == [] and members.collect() == []


def test_large_class_gives_every_pair(spark, tmp_path):
    from weftgraph.llm import queries

    text = "alpha beta gamma delta epsilon zeta"
    forms = [text, text.upper(), text.replace(" ", ", "), text + ".", text + " " + text.replace("alpha", "Alpha")]
    rows = [(i, forms[i % 4]) for i in range(150)] + [(200 + i, text + " eta" + "." * (i % 3)) for i in range(70)] + [(300, text + " theta"), (301, forms[4]), (302, "one two three four"), (303, "one two three four")]
    spark.createDataFrame(rows, "chunk_row bigint, content string").write.parquet(str(tmp_path / "text_chunks.parquet"))
    got = [tuple(r) for r in queries.p3_found(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.5, 3)


def test_traversal_loses_no_pair():
    rng = np.random.default_rng(1)
    n = 400
    sets = [np.unique(rng.integers(0, 60, size=rng.integers(1, 30))).astype(np.uint64) for _ in range(n)]
    h = np.concatenate(sets)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    size = np.array([len(s) for s in sets])
    raw, start = neardup.bitmaps(h, doc, size)
    bits = np.stack([raw[start[i] : start[i + 1]].view(np.uint64) for i in range(n)])
    order = np.argsort(size, kind="stable")
    forest = neardup.Forest(np.zeros(n, np.uint32), bits[order], size[order])
    got = {(min(order[a], order[b]), max(order[a], order[b])) for i, j in neardup.dual_traversal(forest, forest, 0.6, True) for a, b in zip(i, j)}
    for a in range(n):
        for b in range(a + 1, n):
            k = len(np.intersect1d(sets[a], sets[b]))
            if k >= 0.6 * (len(sets[a]) + len(sets[b]) - k):
                assert (a, b) in got


def test_sketch_and_filter_sizes_are_bounded():
    assert neardup.sketch_bits(0) == neardup.LEAST_SKETCH and neardup.sketch_bits(10**12) == neardup.MOST_SKETCH
    assert neardup.filter_bits(0) == neardup.LEAST_FILTER and neardup.filter_bits(10**12) == neardup.MOST_FILTER


def test_filter_lets_every_candidate_pass():
    import numpy as np
    import pyarrow as pa

    ids = np.arange(0, 40_000, 7)
    bits = neardup.filter_bits(len(ids))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids + 1)], names=["a", "b"])
    parts = {}
    for b in neardup._or_bits(neardup._filter_bits(bits)(iter([batch]))):
        parts |= dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))

    class Shared:
        value = parts

    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(40_002)), pa.array(["a b c d"] * 40_002)], names=["id", "t"])
    got = {i for b in neardup._sets(3, Shared, bits)(iter([rows])) for i in b.column(0).to_pylist()}
    assert set(ids.tolist()) | set((ids + 1).tolist()) <= got and len(got) < 20_000


def test_rounds_send_every_record_once_a_partition(spark, monkeypatch):
    """The disk holds one round's copies of the records; all rounds together are the whole join."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 40))) for _ in range(150)]
    texts += [" ".join(w if rng.random() > 0.1 else "z" for w in t.split()) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_row bigint, content string")
    low: list[int] = []
    spread = neardup._spread
    monkeypatch.setattr(neardup, "PARTITION_SHINGLES", 700)
    monkeypatch.setattr(neardup, "LEAST_ROUND", 1)
    monkeypatch.setattr(neardup, "ROUND_BYTES", 2)
    monkeypatch.setattr(neardup, "_spread", lambda parts, at, keys: low.append((parts, at, len(keys))) or spread(parts, at, keys))
    pairs, members = neardup.near_pairs(df, "chunk_row", "content", 0.5, 1)
    got = {tuple(r) for r in neardup.all_record_pairs(pairs, members).collect()}
    assert len(low) > 2 and [x for _, at, n in low for x in range(at, at + n)] == list(range(low[0][0]))
    sets = [set(t.split()) for t in texts]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 2 * len(sets[i] & sets[j]) >= len(sets[i] | sets[j])}
    assert len(want) > 50 and got == want


def test_a_written_table_leaves_no_shuffle_files(spark):
    import time
    from pathlib import Path

    from weftgraph.plans import Scratch

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f for d in manager.localDirsString() for f in Path(d).rglob("shuffle_*.data")}
    before = held()
    Scratch(spark, "t").save(spark.range(10_000).selectExpr("id % 977 AS k").distinct())
    for _ in range(20):
        if held() <= before:
            break
        time.sleep(0.5)
    assert held() <= before
