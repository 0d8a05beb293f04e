"""Literal cases of text functions, extraction, chunking and retrieval operators."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.operators import chunking as C
from weftgraph.operators import conversation as T
from weftgraph.operators import extraction as E
from weftgraph.operators import maintenance as M
from weftgraph.operators import reduce as R
from weftgraph.operators import retrieval as Q
from weftgraph.operators import stores as S
from weftgraph.operators import vectors as V
from weftgraph.sources import custom_graph, files


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "raw,want",
    [("<p>Acme</p>", "Acme"), ("ＡＢ１２", "AB12"), ("苹 果 公司", "苹果公司"), ("苹果 Inc", "苹果Inc"), ('"Acme"', "Acme"), ("'a' b 'c'", "'a' b 'c'"), ("“x”", "x"), ("12", ""), ("123", "123"), ("1.2", ""), ("1.2345", "1.2345"), (".", ""), ("  A B  ", "A B"), ("苹果'x", "苹果x"), ("A B", "A B"), ("", ""), (None, None)],
)
def test_normalize(spark, raw, want):
    assert one(spark, lambda c: X.normalize(c, True), raw) == want


@pytest.mark.parametrize("raw,want", [(" a&amp;b\n", "a&b"), ("x\x00y\tz\nw", "xyzw"), ("&lt;p&gt;", "<p>"), ("￾a", "a"), (None, None), ("   ", "")])
def test_sanitize(spark, raw, want):
    assert one(spark, X.sanitize, raw) == want


def test_small_text_functions(spark):
    assert one(spark, X.title_case, "a-b new york's") == "A-B New York'S"
    assert one(spark, X.without_thinking, "<think>x</think> y") == "y"
    assert one(spark, lambda c: X.with_time(c, F.lit("2024")), "2024 x") == "2024 x"
    assert one(spark, lambda c: X.with_time(c, F.lit(" ")), "x") == "x"
    assert one(spark, X.first_json, 'so {"a": 1} x') == '{"a": 1}' and one(spark, X.first_json, "none") is None
    assert one(spark, lambda c: X.split_markers(c, ["##", "<|COMPLETE|>"]), "a## b<|COMPLETE|>") == ["a", "b"]
    assert one(spark, lambda c: X.joined_paths(F.array(c), F.array(F.lit("b"), F.lit("a"), F.lit("b"))), "a") == "a<SEP>b"
    long = one(spark, lambda c: X.joined_paths(F.array(c), F.array(F.lit("x" * 40), F.lit("y")), 50), "a" * 20)
    assert long == "a" * 20 + "<SEP>y"  # what does not fit is skipped, not the rest


RECORDS = "(entity<|>Acme<|>organization<|>maker)##（entity<|Beta<|>person<|>head）##(relationship<|>Acme<||>Beta<|>led，by<|>x<|>2.5)##(entity<|>Bad/Type<|>a/b<|>d)##(entity<|>few)##(relationship<|>A1x<|>A1x<|>k<|>self)<|COMPLETE|>"


def test_extraction(spark):
    df = spark.createDataFrame([(1, RECORDS, "2024-Q1"), (2, None, None), (3, "", "")], "id int, content string, label string")
    recs = E.records(df)
    ents = {(r.entity_name, r.entity_type, r.description) for r in E.entities(recs, "label").collect()}
    assert ents == {("Acme", "Organization", "[Time: 2024-Q1] maker"), ("Beta", "Person", "[Time: 2024-Q1] head")}
    rels = [(r.src_id, r.tgt_id, r.keywords, r.weight) for r in E.relations(recs).collect()]
    assert rels == [("Acme", "Beta", "led,by", 2.5)]
    assert [r.fields[1] for r in E.malformed(recs).collect()] == ["few"]


def test_nodes_and_edges(spark):
    m = spark.createDataFrame([("A", "x", "d1", "c1", "f1", 1), ("A", "y", "d2", "c2", "f1", 2), ("A", "y", "d1", "c1", "f2", 3), ("B", "t1", "e", "c1", None, 4), ("B", "t2", "", "c3", "", 5)], "entity_name string, entity_type string, description string, source_id string, file_path string, ord int")
    got = {r.entity_name: (r.entity_type, r.description, r.source_id, r.file_path) for r in R.merge_nodes(m).collect()}
    assert got["A"] == ("y", "d1<SEP>d2", "c1<SEP>c2", "f1<SEP>f2")
    assert got["B"][0] == "t1"  # a tie goes to the first seen
    e = spark.createDataFrame([("B", "A", 1.0, "k2, k1", "x", "c1", 1), ("A", "B", 2.0, "k1", "x", "c2", 2)], "src_id string, tgt_id string, weight double, keywords string, description string, source_id string, ord int")
    r = R.merge_edges(e).collect()
    assert [(x.src, x.tgt, x.weight, x.keywords, x.description) for x in r] == [("A", "B", 3.0, "k1,k2", "x")]


def test_fragments_pack_two_at_least(spark):
    f = spark.createDataFrame([("k", i, "w " * n) for i, n in enumerate([5, 5, 5, 1, 9, 9])], "k string, o int, t string")
    got = {r.o: r.grp for r in R.pack_fragments(f, "k", "o", "t", 10).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2}


def test_windows_keep_pure_overlap(spark):
    df = spark.createDataFrame([(1, " ".join("abcdefgh")), (2, ""), (3, None)], "k int, t string")
    got = [(r.chunk_order_index, r.tokens, r.content) for r in C.fixed_windows(df, "k", "t", 4, 2).orderBy("chunk_order_index").collect()]
    assert got == [(0, 4, "a b c d"), (1, 4, "c d e f"), (2, 4, "e f g h"), (3, 2, "g h")]
    with pytest.raises(ValueError):
        C.fixed_windows(df, "k", "t", 4, 4)


def test_tables_stay_whole():
    t = "<table><tr>1</tr></table>"
    got = C.cut_tables(f"a b {t} c d{t}e", 3, 1, 0)
    assert [x[1] for x in got if x[2]] == [t, t] and all(x[3] for x in got if x[2])
    assert [x[1] for x in got if not x[2]] == ["a b", "c d", "e"]
    assert C.cut_tables("<table> never closed", 5, 1, 1) == [(3, "<table> never closed", False, False)]
    near = C.cut_tables(f"{t}{t}", 5, 1, 100)
    assert [x[1] for x in near] == [t, t]


def test_polling_gives_each_chunk_once(spark):
    rng = random.Random(1)
    for n in (1, 2, 5):
        items = [(i, [f"{i}-{j}" for j in range(rng.randint(0, 6))]) for i in range(n)]
        got = [r.chunk for r in Q.weighted_polling(spark.createDataFrame(items, "item int, chunks array<string>"), 4, 1).collect()]
        want = _polling(items, 4, 1)
        assert sorted(got) == sorted(want)


def _polling(items, most, least):
    n = len(items)
    if n == 1:
        return items[0][1][:most]
    quota = [round(most - i / (n - 1) * (most - least)) for i in range(n)]
    used = [min(q, len(c)) for q, (_, c) in zip(quota, items)]
    spare = sum(q - u for q, u in zip(quota, used))
    for i, (_, c) in enumerate(items):
        more = min(spare, len(c) - used[i])
        used[i] += more
        spare -= more
    return [x for u, (_, c) in zip(used, items) for x in c[:u]]


def test_pagerank_sums_to_one(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("d", "e", 1.0)], "src string, tgt string, weight double")
    seeds = spark.createDataFrame([("a",), ("lonely",)], "entity_name string")
    start = Q.softmax_seeds(seeds, spark.createDataFrame([("a", 0.3)], "entity_name string, sim double"))
    ranks = {r.entity_name: r["rank"] for r in Q.pagerank(edges, start, 30, tolerance=None).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["d"] < 1e-2 < ranks["a"]
    none = spark.createDataFrame([], "src string, tgt string, weight double")
    assert Q.pagerank(none, start.limit(0)).collect() == []


def test_round_robin_and_budget(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "k string, rank int")
    b = spark.createDataFrame([("y", 1), ("w", 2)], "k string, rank int")
    got = [r.k for r in Q.round_robin(["k"], a, b).orderBy("rank", "source").collect()]
    assert got == ["x", "y", "w", "z"]
    t = spark.createDataFrame([(1, 5), (2, 5), (3, 1), (4, 0)], "o int, n int")
    assert [r.o for r in Q.within_budget(t, "n", 10, F.col("o")).collect()] == [1, 2]
    assert Q.within_budget(t, "n", 0, F.col("o")).count() == 0


def test_matching_equals_one_by_one(spark):
    rng = random.Random(9)
    pairs = {(a, b): round(rng.random(), 1) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.3}
    rows = [(a, b, s) for (a, b), s in pairs.items()]
    got = {(r.a, r.b) for r in M.greedy_matching(spark.createDataFrame(rows, "a int, b int, score double")).collect()}
    used, want = set(), set()
    for a, b, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if not {a, b} & used:
            used |= {a, b}
            want.add((a, b))
    assert got == want


def test_mutations_raise(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "entity_name string")
    edges = spark.createDataFrame([("a", "b", 1.0)], "src string, tgt string, weight double")
    with pytest.raises(ValueError):
        M.rename_entity(nodes, edges, "a", "b")
    with pytest.raises(KeyError):
        M.rename_entity(nodes, edges, "q", "z")
    with pytest.raises(ValueError):
        M.create_entity(nodes, nodes)
    with pytest.raises(KeyError):
        M.create_relation(nodes, edges, spark.createDataFrame([("a", "q", 1.0)], edges.schema))


def test_turns(spark):
    m = [(1, 1, "assistant", "hi"), (1, 2, "user", "q1"), (1, 3, "user", "q2"), (1, 4, "assistant", "a2"), (1, 5, "assistant", '{ "high_level_keywords": []}'), (1, 6, "user", "q3"), (2, 1, "system", "s")]
    got = {r.conv_id: r.history for r in T.turns(spark.createDataFrame(m, "conv_id int, turn int, role string, text string"), 2).collect()}
    assert got == {1: "user: q1\nassistant: hi\nuser: q2\nassistant: a2", 2: ""}


def test_similar_pairs_in_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    whole = {(r.a, r.b) for r in V.similar_pairs(df, "id", "v", 0.7).collect()}
    assert whole and whole == {(r.a, r.b) for r in V.similar_pairs(df, "id", "v", 0.7, block_rows=9).collect()}


def test_custom_graph_and_folder(spark, tmp_path):
    chunks = spark.createDataFrame([("text", "s1", None, None)], "content string, source_id string, file_path string, chunk_order_index int")
    ents = spark.createDataFrame([("A", None, None, "s1")], "entity_name string, entity_type string, description string, source_id string")
    rels = spark.createDataFrame([("B", "A", None, "k", "d", "miss")], "src_id string, tgt_id string, weight double, keywords string, description string, source_id string")
    _, nodes, edges = custom_graph.load(chunks, ents, rels)
    assert {(r.entity_name, r.entity_type) for r in nodes.collect()} == {("A", "UNKNOWN"), ("B", "UNKNOWN")}
    e = edges.first()
    assert (e.src, e.tgt, e.weight, e.source_id) == ("A", "B", 1.0, "UNKNOWN")
    (tmp_path / "a b.txt").write_text("hello")
    (tmp_path / "blank.txt").write_text(" \n")
    (tmp_path / "x.md").write_text("no")
    assert [r.file_path for r in files.text_folder(spark, str(tmp_path)).collect()] == ["a b.txt"]
    done = spark.createDataFrame([("a b.txt",)], "file_path string")
    assert files.text_folder(spark, str(tmp_path), done).count() == 0


def test_page_falls_back(spark):
    d = spark.createDataFrame([(f"d{i:02}", "pending", "f", None, None) for i in range(15)], "id string, status string, file_path string, created_at timestamp, updated_at timestamp")
    got = S.page(d, "pending", 2, 1, "nonsense", "sideways").collect()
    assert len(got) == 5 and {r.total_count for r in got} == {15}


def test_scratch_tables_are_removed_and_need_a_shared_folder(spark, tmp_path):
    import os

    import pytest

    from weftgraph.plans import scratch

    table = scratch.Scratch(spark, "t")
    kept = table.save(spark.range(3).toDF("x"))
    assert kept.count() == 3
    root = table.root
    assert os.path.isdir(root)
    scratch.clear(spark)
    assert not os.path.isdir(root)

    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        scratch.shared_dir(Cluster)


def test_numbered_places_follow_the_order(spark):
    from weftgraph.plans import numbered

    df = spark.createDataFrame([(i * 37 % 101, str(i)) for i in range(101)], "x int, t string").repartition(7)
    got = [(r.ord, r.x) for r in numbered(df, "x", start=1).orderBy("ord").collect()]
    assert got == [(i + 1, i) for i in range(101)]
    assert numbered(df.limit(0), "x").collect() == []


def test_near_pairs_find_similar_vectors(spark):
    import numpy as np

    from weftgraph.operators import vectors as V

    rng = np.random.default_rng(2)
    centre = rng.normal(size=(60, 16))
    x = np.repeat(centre, 3, axis=0) + 0.15 * rng.normal(size=(180, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16)], "n bigint, vector array<float>")
    got = {(r.a, r.b) for r in V.near_pairs(df, "n", "vector", 0.8, 16).collect()}
    want = {(r.a, r.b) for r in V.similar_pairs(df.where("n < 900"), "n", "vector", 0.8).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_merging_until_stable_equals_going_one_by_one(spark):
    from weftgraph.operators import maintenance as M

    pairs = {("a", "b"): 0.9, ("b", "c"): 0.95, ("c", "d"): 0.8, ("e", "f"): 0.7, ("a", "d"): 0.6}
    nodes = spark.createDataFrame([(n, f"text {n}") for n in "abcdefg"], "entity_name string, description string")
    edges = spark.createDataFrame([("a", "e", 1.0, "k1"), ("d", "f", 2.0, "k2"), ("b", "e", 3.0, "k1")], "src string, tgt string, weight double, keywords string")
    sims = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "a string, b string, score double")
    find = lambda n: sims.join(n.select(n["entity_name"].alias("a")), "a").join(n.select(n["entity_name"].alias("b")), "b")
    got, links, rounds = M.merge_until_stable(nodes, edges, find, rounds=5)
    left, want = set("abcdefg"), {n: n for n in "abcdefg"}
    while True:
        free, taken = set(left), []
        for (a, b), _ in sorted(((p, s) for p, s in pairs.items() if p[0] in left and p[1] in left), key=lambda x: (-x[1], x[0])):
            if a in free and b in free:
                free -= {a, b}
                taken.append((a, b))
        if not taken:
            break
        for a, b in taken:
            left.discard(b)
            want = {k: a if v == b else v for k, v in want.items()}
    assert {r.entity_name for r in got.collect()} == left and rounds >= 2
    assert {(r.src, r.tgt) for r in links.collect()} == {tuple(sorted((want[a], want[b]))) for a, b in (("a", "e"), ("d", "f"), ("b", "e")) if want[a] != want[b]}


def test_pagerank_stops_when_the_change_is_small(spark):
    import numpy as np

    from weftgraph.operators import retrieval as Q

    links = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 1.0), ("a", "d", 0.5)]
    edges = spark.createDataFrame(links, "src string, tgt string, weight double")
    seeds = spark.createDataFrame([("a", 0.7), ("z", 0.3)], "entity_name string, p double")  # z has no edge
    names = ["a", "b", "c", "d", "z"]
    w = np.zeros((5, 5))
    for a, b, x in links:
        w[names.index(a), names.index(b)] = w[names.index(b), names.index(a)] = x
    share = np.divide(w, w.sum(axis=1, keepdims=True), out=np.zeros_like(w), where=w.sum(axis=1, keepdims=True) > 0)
    p, rank, steps = np.array([0.7, 0, 0, 0, 0.3]), np.full(5, 0.2), 0
    while True:
        new = 0.85 * (rank @ share + rank[4] * p) + 0.15 * p
        change, rank, steps = np.abs(new - rank).sum(), new, steps + 1
        if change < 5 * 1e-3:
            break
    got = {r.entity_name: r.rank for r in Q.pagerank(edges, seeds, 1000, tolerance=1e-3).collect()}
    assert steps < 60 and set(got) == set(names) and all(abs(got[n] - r) < 1e-9 for n, r in zip(names, rank))


def test_given_ids_are_kept_and_must_differ(spark):
    from weftgraph.operators import stores as S

    known = spark.createDataFrame([("mine-2",)], "id string")
    rows = [(1, "one", "mine-1"), (2, "two", "mine-2"), (3, "one", "mine-3"), (4, "three", None), (5, "four", "")]
    df = spark.createDataFrame(rows, "ord int, content string, id string").selectExpr("*", "'f' AS file_path", "current_timestamp() AS created_at")
    full, status = S.enqueue(df, known, "t")
    got = {r.content: r.id for r in full.collect()}
    assert set(got) == {"one", "three", "four"} and got["one"] == "mine-1" and got["three"].startswith("doc-") and got["four"].startswith("doc-")
    with pytest.raises(ValueError):
        S.enqueue(df.withColumn("id", F.lit("same")), known, "t")


def test_communities_of_two_cliques(spark):
    from weftgraph.operators import graph as G

    cliques = [(a, b, 2.0) for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1 :]] + [("d", "w", 0.5)]
    got = {r.entity_name: r.community for r in G.communities(spark.createDataFrame(cliques, "src string, tgt string, weight double")).collect()}
    assert got == {**dict.fromkeys("abcd", "a"), **dict.fromkeys("wxyz", "w")}


def test_index_finds_most_of_the_nearest(spark, tmp_path):
    import numpy as np

    from weftgraph.operators import index as I
    from weftgraph.operators import vectors as V

    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(80, 24)), 10, axis=0) + 0.4 * rng.normal(size=(800, 24))
    odd = [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [1.0] * 23)]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + odd, "id bigint, vector array<float>").withColumn("name", F.concat(F.lit("n"), "id"))
    made = I.build(df, str(tmp_path / "i"), 24)
    assert 20 <= made <= 40 and spark.read.parquet(str(tmp_path / "i" / "lists")).count() == 800
    hits = total = 0
    for q in range(0, 800, 160):
        want = {r.id for r in V.top_k(df, x[q].tolist(), 10, threshold=-1.0).collect()}
        got = I.search(spark, str(tmp_path / "i"), x[q].tolist(), 10, threshold=-1.0, probes=6)
        assert set(got.columns) == {"id", "name", "score"}
        hits, total = hits + len(want & {r.id for r in got.collect()}), total + len(want)
    assert hits >= 0.9 * total
    assert I.build(df.limit(0), str(tmp_path / "e"), 24) == 1 and I.search(spark, str(tmp_path / "e"), x[0].tolist(), 5).collect() == []
