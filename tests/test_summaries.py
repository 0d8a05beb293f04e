"""Summaries of every source against brute force."""

import hashlib
import os

import pytest

from weftgraph.functions import text as X
from weftgraph.operators import discovery as D

DIR = "/root/testdata/sf0.001"


def told(part, most):
    at = X.default_spans(part)
    return hashlib.md5((part[at[0][0] : at[most - 1][1]] if len(at) > most else part).encode()).hexdigest()


def brute(texts, most):
    while True:
        sizes = [len(X.default_spans(t)) for t in texts]
        if len(texts) == 1:
            return texts[0]
        if sum(sizes) <= most or len(texts) <= 2:
            return "\n\n".join(texts) if len(texts) < 8 and sum(sizes) < 1200 else told("\n\n".join(texts), most)
        groups, size = [[]], 0
        for t, n in zip(texts, sizes):
            if len(groups[-1]) >= 2 and size + n > most:
                groups, size = [*groups, []], 0
            groups[-1].append(t)
            size += n
        texts = [g[0] if len(g) == 1 else told("\n\n".join(g), most) for g in groups]


def test_rounds_equal_brute_force(spark):
    lists = {"one": ["a  b"], "few": ["a", "b c"], "long": ["w " * 700, "v " * 700], "many": [f"w{i}" for i in range(9)], "rounds": [f"x{i} y z" for i in range(301)], "oversize": ["a b"] + ["u " * 90] * 3 + ["c"]}
    rows = [(k, i, t) for k, ts in lists.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "k string, o bigint, t string")
    got = {r.k: r.summary for r in D.summarize(df, "k", "o", "t", lambda parts: [hashlib.md5(p.encode()).hexdigest() for p in parts], most=20).collect()}
    assert got == {k: brute(ts, 20) for k, ts in lists.items()}


def test_query_returns_every_source(spark):
    if not os.path.isdir(DIR):
        pytest.skip("no test tables here")
    import __spark_entry__ as entry

    rows = spark.read.parquet(f"{DIR}/documents.parquet").where("text IS NOT NULL AND source IS NOT NULL").orderBy("doc_id").collect()
    lists = {}
    for r in rows:
        lists.setdefault(r.source, []).append(r.text)
    got = {r.source: r.digest for r in entry.queries()["ag6_summarize_all"](spark, DIR).collect()}
    assert set(got) == set(lists)
    space = " \t\n\x0b\f\r"  # of the default tokenizer
    plain = {k: ts for k, ts in lists.items() if all(c in space or not c.isspace() for t in ts for c in t)}
    assert plain and all(got[k] == hashlib.md5(brute(ts, 12_000).encode()).hexdigest() for k, ts in plain.items())
