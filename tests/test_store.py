"""The versioned store: appends, replacements, two writers, removal of old versions."""

import os
import threading

from weftgraph.tables import KEEP, Store

CACHE, NODES = "llm_response_cache", "nodes"


def cache(spark, rows):
    return spark.createDataFrame([(d, a, "") for d, a in rows], "digest string, answer string, context string")


def nodes(spark, names, text="d"):
    return spark.createDataFrame([(n, "t", "s", 1, text, "f") for n in names], "entity_name string, entity_type string, source_id string, mentions bigint, description string, file_path string")


def files(root):
    return {os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_append_touches_no_written_file(spark, tmp_path):
    s = Store(spark, str(tmp_path), buckets=4)
    s.append(CACHE, cache(spark, [(str(i), "a") for i in range(40)]))
    before = files(s.root)
    s.append(CACHE, cache(spark, [("new", "b")]))
    assert before <= files(s.root) and len(files(s.root)) == len(before) + 1
    assert s.read(CACHE).count() == 41


def test_replace_touches_only_its_buckets(spark, tmp_path):
    s = Store(spark, str(tmp_path), buckets=8)
    s.write(NODES, nodes(spark, [f"n{i}" for i in range(200)]))
    before = s._manifest(NODES)[1]["folders"]
    s.upsert(NODES, nodes(spark, ["n7"], "changed"))
    after = s._manifest(NODES)[1]["folders"]
    assert sum(before[b] != after[b] for b in before) == 1 and set(before) == set(after)
    got = {r.entity_name: r.description for r in s.read(NODES).collect()}
    assert len(got) == 200 and got["n7"] == "changed" and got["n8"] == "d"
    s.replace(NODES, nodes(spark, ["n1", "n2", "none"]), ["entity_name"])
    assert s.read(NODES).count() == 198
    s.replace(NODES, nodes(spark, [], "d").select("description"), ["description"])  # nothing to remove
    assert s.read(NODES).count() == 198
    s.replace(NODES, nodes(spark, ["x"], "changed").select("description"), ["description"])  # not the buckets' key
    assert "n7" not in {r.entity_name for r in s.read(NODES).collect()}


def test_two_writers_lose_nothing(spark, tmp_path):
    a, b = (Store(spark, str(tmp_path), buckets=2) for _ in range(2))
    failed = []

    def work(store, tag):
        try:
            for i in range(4):
                store.append(CACHE, cache(spark, [(f"{tag}{i}", tag)]))
        except Exception as e:  # shown by the main thread
            failed.append(e)

    threads = [threading.Thread(target=work, args=x) for x in ((a, "a"), (b, "b"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert {r.digest for r in a.read(CACHE).collect()} == {f"{t}{i}" for t in "ab" for i in range(4)}


def test_a_taken_number_is_not_taken_again(spark, tmp_path):
    s = Store(spark, str(tmp_path), buckets=2)
    s.append(CACHE, cache(spark, [("x", "1")]))
    n, manifest = s._manifest(CACHE)
    assert not s._commit(CACHE, n, manifest)
    s._put(f"{s.root}/{CACHE}/commits/{n + 1:010d}", "", True)  # a writer that died
    assert s.read(CACHE).count() == 1
    s.append(CACHE, cache(spark, [("y", "1")]))
    assert s.read(CACHE).count() == 2


def test_old_versions_go(spark, tmp_path):
    s = Store(spark, str(tmp_path), buckets=1)
    for i in range(KEEP + 4):
        s.write(NODES, nodes(spark, [f"n{i}"]))
    assert len(s._commits(NODES)) == KEEP and len(files(s.root)) == KEEP
    assert [r.entity_name for r in s.read(NODES).collect()] == [f"n{KEEP + 3}"]
    s.drop(NODES)
    assert s.read(NODES).count() == 0 and s.read(NODES).columns == s.columns(NODES)


def test_an_append_to_many_folders_writes_the_bucket_as_one(spark, tmp_path, monkeypatch):
    import weftgraph.tables as T

    monkeypatch.setattr(T, "MOST_FOLDERS", 2)
    s = Store(spark, str(tmp_path), buckets=1)
    for i in range(4):
        s.append(CACHE, cache(spark, [(str(i), "a")]))
    assert len(s._manifest(CACHE)[1]["folders"]["0"]) <= 2 and s.read(CACHE).count() == 4
