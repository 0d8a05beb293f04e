"""The abuse scorer: disguises, gradients, held-out accuracy, odd rows."""

import os

import numpy as np
import pytest

from weftgraph.llm import abuse as A

EXAMPLES = "/root/testdata/sf0.001/abuse_examples.parquet"


@pytest.fixture(scope="module")
def examples():
    if not os.path.exists(EXAMPLES):
        pytest.skip("no labelled examples here")
    import pyarrow.parquet as pq

    t = pq.read_table(EXAMPLES).to_pylist()
    return [(r["item_id"], r["text"], int(r["abusive"])) for r in t]


@pytest.fixture(scope="module")
def half(examples):
    return A.train([(t, y) for i, t, y in examples if i % 2])


def test_held_out_accuracy(examples, half):
    rest = [(t, y) for i, t, y in examples if i % 2 == 0]
    s = A.Scorer(half).score([t for t, _ in rest])
    right = [(v >= A.THRESHOLD) == bool(y) for v, (_, y) in zip(s, rest)]
    assert np.mean(right) >= 0.93


def test_passages_between_two_steps_are_scored(half):
    scorer = A.Scorer(half)
    filler = "the quarterly margin of the plant rose and the board approved it in march before the audit".split()
    scores = [float(scorer.score([" ".join([*filler[:k], "i will kill you", *filler])])[0]) for k in range(12)]
    assert min(scores) >= A.THRESHOLD


def test_a_group_nobody_knows_is_made_of_syllables():
    import random

    rng = random.Random(3)
    made = {A.G.group(rng) for _ in range(400)}
    assert len(made - set(A.G.GROUPS)) > 100


def test_scores_do_not_depend_on_the_company(half):
    texts = ["you stupid idiot", None, "", " \n", "quarterly margin rose", "word " * 3000 + "you are a filthy liar and a moron", "\x00\x07", "漢字"]
    one = A.Scorer(half)
    alone = [float(one.score([t])[0]) for t in texts]
    together = A.Scorer(half).score(texts)
    assert np.allclose(alone, together, atol=1e-4)
    assert together[1] == together[2] == together[3] == 0
    assert together[0] > 0.5 and together[5] > 0.5 and together[4] < 0.5


def test_disguises_read_alike():
    assert A.words_of("1d10t") == ["idiot"]
    assert A.words_of("i d i o t") == ["idiot"]
    assert A.words_of("Ｉｄｉｏｔ") == ["idiot"]
    assert A.words_of("id​iot") == ["idiot"]
    assert A.words_of("idiooooot") == ["idiot"]
    assert A.words_of("4,957 Q3 2024")[0] == "0"


def test_gradients(half):
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in half.weights.items()}
    words = rng.integers(1, 50, size=(4, A.WINDOW))
    words[0, 7:] = A.PAD
    tri = rng.integers(0, A.TRIGRAMS, size=(4, A.WINDOW, 3))
    n = np.full((4, A.WINDOW), 3.0)
    y, wt = np.array([1.0, 0, 1, 0]), np.ones(4)

    def loss(weights):
        emb = weights["E"][words] + weights["C"][tri].sum(axis=2) / n[..., None]
        z, _ = A._forward(weights, emb, np.where(words == A.PAD, -30.0, 0.0))
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g, _ = A._step(w, words, tri, n, y, wt)
    for k in ("Uf", "Wb", "bf", "A", "v", "o", "q"):
        at = tuple(rng.integers(0, s) for s in w[k].shape)
        up, down = ({**w, k: w[k].copy()} for _ in range(2))
        up[k][at] += 1e-3
        down[k][at] -= 1e-3
        slope = (loss(up) - loss(down)) / 2e-3
        assert abs(slope - g[k][at]) <= 2e-3 * max(1.0, abs(slope)), k


def test_networks_are_averaged_where_the_first_is_not_sure(half):
    one, three = A.Scorer(half), A.Scorer(half, half, half)
    texts = ["you stupid idiot", "quarterly margin rose", "", None, "a b c", "the board met and you are a filthy liar and a moron they said"]
    assert np.allclose(one.score(texts), three.score(texts), atol=1e-5)  # equal networks change nothing


def test_rows_and_rates(spark, examples, monkeypatch):
    monkeypatch.setattr(A, "NETWORKS", 2)
    rows = [(1, "you stupid idiot", "a"), (2, None, "a"), (3, "", None), (3, "", None), (4, "the margin rose", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS score", "2 AS k", "3 AS s")
    labels = spark.createDataFrame(examples, "item_id bigint, text string, abusive int")
    scores = A.score(docs, labels)
    got = sorted((r.doc_id, r.score) for r in scores.collect())
    assert [k for k, _ in got] == [1, 2, 3, 3, 4] and all(s == 0 for k, s in got if k in (2, 3))
    assert A.score(docs.limit(0), labels).collect() == []
    by = {r.source: r.documents for r in A.rates(docs.dropDuplicates(["doc_id"]), scores.dropDuplicates(["doc_id"])).collect()}
    assert by == {"a": 2, "b": 1, None: 1}


def test_scored_rows_take_no_part_in_the_fit(spark, examples, monkeypatch):
    fits = []
    monkeypatch.setattr(A, "_fitted", {})
    monkeypatch.setattr(A, "_fit_all", lambda spark, known, public, seeds: fits.append(known) or [A.Model({"": 0, "0": 1, "?": 2}, {}, {})])
    labels = spark.createDataFrame(examples, "item_id bigint, text string, abusive int")
    for text in ("unlisted wording of an insult", "another text"):
        A.score(spark.createDataFrame([(i, text) for i in range(50)], "doc_id bigint, text string"), labels)
    assert len(fits) == 1 and "unlisted wording of an insult" not in {t for t, _ in fits[0]}  # once, for both
