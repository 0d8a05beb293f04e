"""Files of local stores and the provider registry."""

import base64
import json

import numpy as np
import pytest

from weftgraph.sources import files, imports

GRAPH = """<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="node" attr.name="entity_type" attr.type="string"/><key id="d1" for="edge" attr.name="weight" attr.type="double"/>
<graph edgedefault="undirected"><node id="B &amp; C"><data key="d0">org</data></node><node id="A"/><edge source="B &amp; C" target="A"><data key="d1">2.5</data></edge></graph></graphml>"""


def test_id_keyed_json(spark, tmp_path):
    (tmp_path / "kv.json").write_text(json.dumps({"doc-1": {"content": "漢 a", "n": 3}, "doc-2": {"content": None}}, ensure_ascii=False))
    got = {r.id: (r.content, r.n) for r in imports.json_kv(spark, str(tmp_path / "kv.json"), "content string, n int").collect()}
    assert got == {"doc-1": ("漢 a", 3), "doc-2": (None, None)}
    (tmp_path / "empty.json").write_text("{}")
    assert imports.json_kv(spark, str(tmp_path / "empty.json"), "content string").collect() == []


def test_vector_json(spark, tmp_path):
    x = np.arange(6, dtype="<f4").reshape(2, 3)
    (tmp_path / "v.json").write_text(json.dumps({"embedding_dim": 3, "data": [{"__id__": "a", "entity_name": "A"}, {"__id__": "b"}], "matrix": base64.b64encode(x.tobytes()).decode()}))
    got = {r.id: (list(r.vector), r.entity_name) for r in imports.vector_json(spark, str(tmp_path / "v.json"), "entity_name string").collect()}
    assert got == {"a": ([0.0, 1.0, 2.0], "A"), "b": ([3.0, 4.0, 5.0], None)}


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(GRAPH)
    nodes, edges = imports.graphml(spark, str(tmp_path / "g.graphml"))
    assert {r.entity_name: r.entity_type for r in imports.attributes(nodes, "entity_type string").collect()} == {"A": None, "B & C": "org"}
    assert [tuple(r) for r in imports.attributes(edges, "weight double").collect()] == [("A", "B & C", 2.5)]


def test_providers():
    assert imports.provider("json_kv") is imports.json_kv
    with pytest.raises(KeyError):
        imports.provider("none")
    with pytest.raises(ValueError):
        imports.register("json_kv", imports.json_kv)


def test_literal_texts_leave_out_processed_and_blank_ones(spark):
    df = spark.createDataFrame([(0, "one"), (1, "  "), (2, None), (3, "two")], "ord int, text string")
    first = files.literal_texts(df)
    assert [r.content for r in first.orderBy("ord").collect()] == ["one", "two"]
    assert [r.content for r in files.literal_texts(df, processed=first.where("ord = 0")).collect()] == ["two"]
