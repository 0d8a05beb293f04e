"""The engine end to end with deterministic model stubs."""

import pytest
from pyspark.sql import functions as F

from weftgraph.engine import Engine
from weftgraph.models import Config, QueryParam, hashed_vectors, record_extractor
from weftgraph.streaming import stream_folder

TEXTS = ["Alice met Robert near the Harbour of Lisbon.", "Robert sold the Harbour to Carla.", "Lisbon grew while Carla travelled."]


def engine(spark, path):
    def answer(prompts):  # nested, so that workers get it by value
        return [p if p.startswith("echo") else r for p, r in zip(prompts, record_extractor(prompts))]

    return Engine(spark, str(path), Config(generate=answer, embed=hashed_vectors, buckets=2, cosine_threshold=-1.0, pagerank_iterations=3, chunk_tokens=50, chunk_overlap=5))


def docs(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, f"f{i + start}.txt") for i, t in enumerate(texts)], "ord int, content string, file_path string")


def state(e):
    n = {(r.entity_name, r.entity_type, r.description, r.source_id) for r in e.store.read("nodes").collect()}
    g = {(r.src, r.tgt, r.weight, r.keywords, r.description) for r in e.store.read("edges").collect()}
    return n, g


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    e = engine(spark, tmp_path_factory.mktemp("whole"))
    e.insert(docs(spark, [*TEXTS, TEXTS[0], "  "]))
    return e


def test_insert_builds_graph_and_indexes(whole):
    nodes, edges = state(whole)
    assert {n[0] for n in nodes} == {"Alice", "Robert", "Harbour", "Lisbon", "Carla"}
    assert ("Alice", "Robert") in {(a, b) for a, b, *_ in edges}
    assert {r.status for r in whole.store.read("doc_status").collect()} == {"processed"}
    assert whole.store.read("doc_status").count() == 3  # equal contents once, blank ones never
    assert whole.store.read("vdb_entities").count() == len(nodes)


def test_delete_after_insert_is_no_change(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.insert(docs(spark, TEXTS[:2]))
    before = state(e)
    e.insert(docs(spark, TEXTS[2:], 2))
    assert state(e) != before
    last = e.store.read("doc_status").where("file_path = 'f2.txt'").first().id
    assert e.delete_document(last) and not e.delete_document("doc-none")
    assert state(e) == before


@pytest.mark.parametrize("mode", ["local", "global", "mix", "naive"])
def test_query_modes(whole, mode):
    got = whole.query("Who met Robert?", QueryParam(mode=mode, only_need_context=True, top_ppr_nodes=2))
    assert ("Robert" in got.context) and got.text == ""


def test_answers_are_cached(whole):
    p = QueryParam(mode="naive")
    first = whole.query("Who sold it?", p)
    assert whole.store.read("llm_response_cache").count() == 1
    assert whole.query("Who sold it?", p) == first
    whole.clear_cache()
    assert whole.store.read("llm_response_cache").count() == 0
    assert whole.query("echo this", QueryParam(mode="bypass")).text == "echo this"


def test_merge_and_export(spark, tmp_path):
    e = engine(spark, tmp_path / "w")
    e.insert(docs(spark, TEXTS))
    e.merge(["Robert"], "Alice")
    names = {r.entity_name for r in e.store.read("nodes").collect()}
    assert "Robert" not in names and "Alice" in names
    assert all(r.src < r.tgt for r in e.store.read("edges").collect())
    e.export(str(tmp_path / "out"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert rows.where("kind = 'relation'").count() == 2 * e.store.read("edges").count()
    nodes, edges, cut = e.subgraph("Alice", 1, 10)
    assert nodes.where(F.col("depth") == 0).first().entity_name == "Alice" and not cut.first()[0]


def test_stream_equals_batch(spark, tmp_path, whole):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, t in enumerate(TEXTS):
        (folder / f"f{i}.txt").write_text(t)
    e = engine(spark, tmp_path / "s")
    stream_folder(e, str(folder), str(tmp_path / "cp")).awaitTermination()
    assert state(e) == state(whole)


def test_malformed_records_are_asked_again(spark, tmp_path):
    def answer(prompts):
        first = "(entity<|>Acme<|>organization<|>Acme sells)##(entity<|>Zeta<|>organization)##(relationship<|>Acme<|>Zeta)<|COMPLETE|>"
        whole = "(entity<|>Acme<|>organization<|>another)##(entity<|>Zeta<|>organization<|>Zeta buys)##(relationship<|>Acme<|>Zeta<|>trade<|>Acme sells to Zeta<|>2)<|COMPLETE|>"
        return [whole if "too few fields" in p else first for p in prompts]

    e = Engine(spark, str(tmp_path), Config(generate=answer, embed=hashed_vectors, buckets=2))
    e.insert(spark.createDataFrame([(1, "acme sells to zeta", "a.txt")], "ord int, content string, file_path string"))
    assert {r.entity_name.lower(): r.description for r in e.store.read("nodes").collect()} == {"acme": "Acme sells", "zeta": "Zeta buys"}
    assert [(r.description, r.weight) for r in e.store.read("edges").collect()] == [("Acme sells to Zeta", 2.0)]
    chunk = e.store.read("text_chunks").first()["id"]
    assert {r.source_id for r in e.store.read("entity_mentions").collect()} == {chunk}


def test_inserting_one_document_leaves_other_buckets_alone(spark, tmp_path):
    e = Engine(spark, str(tmp_path), Config(generate=record_extractor, embed=hashed_vectors, buckets=32))
    e.insert(docs(spark, [f"Alice met Number{'abcdefghijklmnopqrst'[i]} today." for i in range(12)]))
    before = e.store._manifest("text_chunks")[1]["folders"]
    e.insert(docs(spark, ["Wholly Unrelated text."], 50))
    after = e.store._manifest("text_chunks")[1]["folders"]
    assert sum(before[b] != after.get(b) for b in before) <= 1


def test_gleaning_adds_only_what_was_missed(spark, tmp_path):
    def answer(prompts):
        first = "(entity<|>Acme<|>organization<|>Acme sells)<|COMPLETE|>"
        more = "(entity<|>Acme<|>organization<|>twice)##(entity<|>Zeta<|>organization<|>Zeta buys)<|COMPLETE|>"
        return [(more if "acme" in p.lower().split("were missed")[1] else "") if "were missed" in p else first for p in prompts]

    e = Engine(spark, str(tmp_path), Config(generate=answer, embed=hashed_vectors, buckets=2, glean_rounds=2))
    e.insert(docs(spark, ["acme sells to zeta"]))
    assert {r.entity_name: r.description for r in e.store.read("nodes").collect()} == {"Acme": "Acme sells", "Zeta": "Zeta buys"}


def test_long_descriptions_are_summarized_and_orphans_described(spark, tmp_path):
    def answer(prompts):
        return [f"(entity<|>Acme<|>organization<|>fact {p})##(relationship<|>Acme<|>Ghost<|>near<|>Acme stands near Ghost {p})<|COMPLETE|>" for p in prompts]

    cfg = Config(generate=answer, embed=hashed_vectors, buckets=2, summarize=lambda parts: [f"told {len(p.split('fact')) - 1}" for p in parts], describe=lambda prompts: [f"(person)<SEP>(about {p.splitlines()[0]})" for p in prompts])
    e = Engine(spark, str(tmp_path), cfg)
    e.insert(docs(spark, [f"text {i}" for i in range(9)]))
    nodes = {r.entity_name: (r.entity_type, r.description) for r in e.store.read("nodes").collect()}
    assert nodes["Acme"][1] == "told 9" and nodes["Ghost"] == ("Person", "about Ghost")
    assert e.store.read("edges").first().description.startswith("told")


def test_caller_tokenizer_and_chunker(spark, tmp_path):
    letters = lambda t: [(i, i + 1) for i in range(len(t))]

    def chunks(text, **settings):
        e = Engine(spark, str(tmp_path), Config(**settings))
        return sorted((r.tokens, r.content) for r in e._chunks(spark.createDataFrame([("d", text)], "id string, content string")).collect())

    assert chunks("abcdefghijklmnopqrstuvwxy", tokenize=letters, chunk_tokens=10, chunk_overlap=0) == [(5, "uvwxy"), (10, "abcdefghij"), (10, "klmnopqrst")]
    assert chunks("one two|three", chunker=lambda t: t.split("|")) == [(1, "three"), (2, "one two")]
    assert max(n for n, _ in chunks("漢" * 450, chunk_tokens=100, chunk_overlap=10)) == 100
    assert chunks("a\nb  c", chunk_tokens=100, chunk_overlap=10) == [(3, "a\nb  c")]


def test_keywords_history_and_recognition(spark, tmp_path):
    seen = []

    def answer(prompts):
        return [p if "Question:" in p else r for p, r in zip(prompts, record_extractor(prompts))]

    cfg = Config(
        generate=answer, embed=hashed_vectors, buckets=2, cosine_threshold=-1.0, pagerank_iterations=3, keywords=lambda qs: seen.append(qs) or ['x {"high_level_keywords": ["trade"], "low_level_keywords": ["Robert"]} y'],
        recognize=lambda prompts: ['{"irrelevant_relation_ids": [' + ", ".join(l.split(":")[0] for l in p.splitlines()[1:] if "Carla" in l) + "]}" for p in prompts],
    )
    e = Engine(spark, str(tmp_path), cfg)
    e.insert(docs(spark, TEXTS))
    p = e.keywords("Who met Robert?", QueryParam())
    assert (p.hl_keywords, p.ll_keywords) == (("trade",), ("Robert",)) and seen
    assert e.keywords("q", QueryParam(ll_keywords=("mine",))).ll_keywords == ("mine",)
    _, rel, _ = e.retrieve("Who met Robert?", QueryParam(mode="local", enable_recognition=True, recognition_batch_size=1, top_ppr_nodes=0))
    got = {(r.src, r.tgt) for r in rel.collect()}
    assert got and not any("Carla" in x for x in got)
    talk = (("user", "hello"), ("assistant", "good day"), ("user", "and now"), ("assistant", "well"))
    told = e.query("Who sold it?", QueryParam(mode="naive", conversation=talk, history_turns=1)).text
    assert "user: and now" in told and "hello" not in told


def test_expanded_entities_follow_the_querys_in_rank(whole):
    ent, rel, _ = whole.retrieve("Alice", QueryParam(mode="local", top_k=1, max_hop=2, top_ppr_nodes=3))
    rows = ent.orderBy("pos").collect()
    assert rows[0].method == "query" and {r.method for r in rows[1:]} <= {"multihop", "ppr", "multihop+ppr"} and len(rows) > 1
    assert len({r.pos for r in rows}) == len(rows) and rel.count() >= 1


def test_an_index_serves_until_the_table_changes(spark, tmp_path, whole):
    scan = [tuple(r) for r in whole.search("vdb_chunks", whole._vector("Robert"), 3).select("id", "score").collect()]
    assert whole.build_index("vdb_chunks") >= 1 and "vdb_chunks" in whole._indexes
    assert [tuple(r) for r in whole.search("vdb_chunks", whole._vector("Robert"), 3).select("id", "score").collect()] == scan
    whole.store.append("vdb_chunks", spark.createDataFrame([("new", "d", whole._vector("Robert"))], "id string, full_doc_id string, vector array<float>"))
    assert "new" in {r.id for r in whole.search("vdb_chunks", whole._vector("Robert"), 3).collect()}
    whole.store.replace("vdb_chunks", spark.createDataFrame([("new",)], "id string"), ["id"])


def test_budget_of_chunks_is_what_the_rest_leaves(whole):
    _, _, many = whole.retrieve("Robert", QueryParam(mode="mix", top_ppr_nodes=0, max_hop=0))
    _, _, none = whole.retrieve("Robert", QueryParam(mode="mix", top_ppr_nodes=0, max_hop=0, max_total_tokens=100))
    assert many.count() > 0 and none.count() == 0


def test_duplicates_merge_until_stable(spark, tmp_path):
    def answer(prompts):
        return ["##".join(f"(entity<|>{n}<|>company<|>{d})" for n, d in (("Acme", "sells nails and tools"), ("Acmee", "sells nails and tools"), ("Zeta", "flies to the moon"))) + "##(relationship<|>Acmee<|>Zeta<|>trade<|>they trade)<|COMPLETE|>" for _ in prompts]

    def same(texts):
        return [[1.0, 0.0, 0.1] if "nails" in t else [0.0, 1.0, 0.0] for t in texts]

    asked = spark.sparkContext.accumulator(0)

    def decide(prompts):
        asked.add(len(prompts))
        return ["Yes, they are"] * len(prompts)

    e = Engine(spark, str(tmp_path), Config(generate=answer, embed=same, buckets=2, decide=decide, merge_threshold=0.8))
    e.insert(docs(spark, ["any"]))
    assert e.merge_duplicates() == 1 and asked.value == 1
    assert {r.entity_name for r in e.store.read("nodes").collect()} == {"Acme", "Zeta"}
    assert {(r.src, r.tgt) for r in e.store.read("edges").collect()} == {("Acme", "Zeta")}
    assert {r.entity_name for r in e.store.read("vdb_entities").collect()} == {"Acme", "Zeta"}
    assert [r.decision for r in e.store.read("merge_log").collect()] == ["merged"]


def test_edits_and_custom_graph(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.insert(docs(spark, TEXTS))
    e.create_entity("Dora", "Person", "Dora paints")
    e.create_relation("Dora", "Alice", "friends", "friendship", 2.0)
    with pytest.raises(ValueError):
        e.create_relation("Alice", "Dora", "again")
    with pytest.raises(KeyError):
        e.create_relation("Alice", "Nobody", "x")
    e.edit_entity("Dora", {"description": "Dora sings"})
    e.edit_relation("Dora", "Alice", {"weight": 5.0})
    assert e.entity_info(["Dora"]).first().description == "Dora sings" and e.relation_info("Dora", "Alice").first().weight == 5.0
    assert e.store.read("vdb_entities").where("entity_name = 'Dora'").first().content == "Dora\nDora sings"
    e.rename_entity("Dora", "Doris")
    assert e.relation_info("Alice", "Doris").count() == 1 and e.entity_info(["Dora"]).count() == 0
    assert e.delete_relation("Doris", "Alice") and not e.delete_relation("Doris", "Alice")
    assert e.delete_entity("Doris") and not e.delete_entity("Doris")
    assert e.statuses("processed").count() == 3
    chunks = spark.createDataFrame([("Custom text", "S1", None, None)], "content string, source_id string, file_path string, chunk_order_index int")
    ents = spark.createDataFrame([("Custom", "thing", "made", "S1")], "entity_name string, entity_type string, description string, source_id string")
    rels = spark.createDataFrame([("Custom", "Alice", 1.0, "k", "linked", "S1")], "src_id string, tgt_id string, weight double, keywords string, description string, source_id string")
    e.insert_custom_graph(chunks, ents, rels)
    assert e.relation_info("Alice", "Custom").count() == 1 and e.entity_info(["Custom"]).first().has_vector
    e.insert_custom_chunks(spark.createDataFrame([("Gregor met Custom", 0)], "content string, chunk_order_index int"), "doc-c")
    assert e.entity_info(["Gregor"]).count() == 1
    e.export(str(tmp_path / "v"), vectors=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "v")).where("vector IS NULL").count() == 0
