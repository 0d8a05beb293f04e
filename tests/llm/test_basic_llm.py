"""Encoding, splitting, grouping and packing."""

import base64
import random

import pytest
from pyspark.sql import Row

from weftgraph.llm import bpe, components, packing, splitting

RANKS = f"{bpe.VOCABULARIES}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def public():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", None, " ", "\n\n", "a" * 5000, "<|endoftext|> x", "it's  we'll\t x", "12½²٣ 漢字かな 👨‍👩‍👧 é", "\x00\x1c\x1f\x85", "  lead", "trail  \n "]


def test_encode_equals_public_library_and_handles_odd_texts(spark, public):
    rows = [Row(doc_id=i, text=t, ids="clash", k=1, t=2) for i, t in enumerate([*ODD, *ODD])]
    got = {r.doc_id: r.ids for r in bpe.encode(spark.createDataFrame(rows)).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id] == (public.encode_ordinary(r.text) if r.text else []), r.text
    counts = {r.doc_id: r.n_tokens for r in bpe.count_tokens(spark.createDataFrame(rows)).collect()}
    assert counts == {k: len(v) for k, v in got.items()}


def test_encode_random_texts(public):
    rng = random.Random(7)
    alphabet = "abcde  \n\t.,'1234éßж漢🙂ÀſK​ "
    with open(RANKS, "rb") as f:
        enc = bpe.Encoder(bpe.parse_ranks(f.read()))
    for _ in range(300):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200)))
        assert [i for w in enc.encode([t])[0] for i in w] == (public.encode_ordinary(t) if t else [])


def test_encode_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.encode(df).collect() == []


@pytest.mark.parametrize("limit,overlap", [(10, 3), (7, 0), (600, 100), (2, 1)])
def test_split_covers_everything_within_the_limit(limit, overlap):
    rng = random.Random(limit)
    for _ in range(60):
        n = rng.randint(0, 60)
        text = "".join(rng.choice([f"word{i}", f"end{i}.", chr(0x4E00 + i), chr(0x5000 + i) + "。", f"x{i}</tr>", f"y{i}!"]) + rng.choice([" ", "\n", "\n\n", "\t", ""]) for i in range(n))
        tokens = splitting.TOKEN.findall(text)
        pieces = splitting.split_text(text, limit, overlap)
        at = 0  # tokens covered so far
        for i, (piece, many) in enumerate(pieces):
            own = splitting.TOKEN.findall(piece)
            assert piece in text and len(own) == many <= limit
            start = next(s for s in range(at, max(at - overlap, 0) - 1, -1) if tokens[s : s + many] == own)
            assert start == 0 if i == 0 else at - overlap <= start <= at
            assert start + many > at
            at = max(at, start + many)
        assert at == len(tokens)


def test_split_prefers_boundaries_and_cuts_hard_without():
    text = " ".join(["w"] * 7 + ["stop."] + ["w"] * 7)
    assert splitting.split_text(text, 10, 2)[0][1] == 8
    assert [n for _, n in splitting.split_text(" ".join("w" * 25), 10, 2)] == [10, 10, 9]
    assert splitting.split_text("漢" * 25, 10, 0)[0] == ("漢" * 10, 10)


def test_split_rows(spark):
    long = "word " * 700
    rows = [(1, None), (2, ""), (3, " " * 900), (4, long), (4, long), (5, "x" * 9000)]
    df = spark.createDataFrame(rows, "chunk_row bigint, content string").selectExpr("*", "1 AS tokens", "'c' AS k", "2 AS chunk_order_index")
    got = splitting.split_long(df).collect()
    assert sorted((r.chunk_row, r.chunk_order_index, r.tokens) for r in got) == [(4, 0, 600), (4, 0, 600), (4, 1, 200), (4, 1, 200)]
    assert splitting.split_long(df.limit(0)).collect() == []


def _union_find(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_groups_equal_union_find(spark):
    rng = random.Random(3)
    ids = [f"n{i}" for i in range(60)] + ["É", "z", "Z", " a", "漢"]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(45)] + [(None, "n1"), ("n1", None), ("q", "q")]
    pairs += [(f"c{i}", f"c{i + 1}") for i in range(30)] + [("hub", f"s{i}") for i in range(40)] + [("s1", "hub")]
    got = {r.id: r.group_id for r in components.groups(spark.createDataFrame(pairs, "a string, b string")).collect()}
    want = _union_find(pairs)
    byte_min = {}
    for x, g in want.items():
        byte_min[g] = min(byte_min.get(g, x), x, key=lambda s: s.encode())
    assert got == {x: byte_min[g] for x, g in want.items()}


def test_groups_of_nothing(spark):
    assert components.groups(spark.createDataFrame([("a", "a"), (None, "b")], "a string, b string")).collect() == []


def test_merged_decisions(spark):
    log = spark.createDataFrame([("a", "b", " Merged"), ("b", "c", "unmerged"), ("c", "d", None), ("d", "e", "MERGED\t"), ("x", "x", "merged")], "entity_a_id string, entity_b_id string, decision string")
    assert sorted(tuple(r) for r in components.merged_pairs(log).collect()) == [("a", "b"), ("d", "e")]


def test_plan_fills_every_rank_once_within_capacity():
    rng = random.Random(5)
    for capacity in (1, 7, 50, 2048):
        histogram = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(30)}
        load, seen = {}, {s: 0 for s in histogram}
        for size, lo, hi, first, each in packing.plan(histogram, capacity):
            assert lo == seen[size]
            seen[size] = hi + 1
            for r in range(lo, hi + 1):
                c = first + (r - lo) // each
                load[c] = load.get(c, 0) + size
        assert seen == histogram and max(load.values()) <= capacity
        free = []  # best fit, item by item
        for s in sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True):
            i = min((i for i, f in enumerate(free) if f >= s), key=lambda i: free[i], default=None)
            if i is None:
                free.append(capacity - s)
            else:
                free[i] -= s
        assert len(load) <= 1.02 * len(free) + 1


def test_pack_rows(spark):
    rows = [(1, 5000), (2, 2048), (3, None), (4, 0), (5, 10), (5, 10), (6, 2038), (None, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int").selectExpr("*", "'x' AS size", "1 AS piece", "0 AS container")
    got = packing.pack(df).collect()
    assert sorted((r.doc_id or 0, r.piece, r["size"]) for r in got) == [(0, 0, 7), (1, 0, 2048), (1, 1, 2048), (1, 2, 904), (2, 0, 2048), (5, 0, 10), (5, 0, 10), (6, 0, 2038)]
    load = {}
    for r in got:
        load[r.container] = load.get(r.container, 0) + r["size"]
    assert max(load.values()) <= 2048 and len(load) == 5
    assert packing.pack(df.limit(0)).collect() == []


def test_fill(spark):
    packed = spark.createDataFrame([(1, 2048, 0), (2, 1000, 1), (3, 500, 1)], "doc_id bigint, size int, container bigint")
    r = packing.fill(packed).first()
    assert (r.containers, r.tokens, r.least, r.fullest, r.emptiest) == (2, 3548, 2, 2048, 1500) and abs(r.unused - (1 - 3548 / 4096)) < 1e-6
    none = packing.fill(packed.limit(0)).first()
    assert none.containers == none.tokens == 0 and none.unused is None


def test_overlap_is_not_tiny():
    import numpy as np

    spans = splitting.cuts(2000, np.array([550, 599, 1100, 2000]), 600, 100)
    assert all(a[1] - b[0] >= splitting.LEAST_OVERLAP for a, b in zip(spans, spans[1:])) and spans[-1][1] == 2000
    assert splitting.cuts(1000, np.array([1000]), 600, 0) == [(0, 600), (600, 1000)]
