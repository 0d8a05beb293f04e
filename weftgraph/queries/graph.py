"""Graph access and vector search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import graph as G
from weftgraph.operators import vectors as V
from weftgraph.plans import numbered
from weftgraph.queries.base import Registry, table
from weftgraph.queries.ingest import LINES, light_edges, line_mentions

q = Registry()
E = "e AS (SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS tgt, count(*)::DOUBLE AS weight FROM lineitem GROUP BY ALL)"
DEG = "deg AS (SELECT id, count(*) AS c FROM (SELECT src AS id FROM e UNION ALL SELECT tgt FROM e) GROUP BY id)"


def part_nodes(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.concat(F.lit("P"), "p_partkey").alias("entity_name"), F.col("p_type").alias("entity_type"), F.col("p_name").alias("description"))


def big_parts(spark, sf):
    """Seeds: the parts of the largest size."""
    return table(spark, sf, "part").where("p_size >= 45").select(F.concat(F.lit("P"), "p_partkey").alias("entity_name"))


SEEDS = "seeds AS (SELECT 'P' || p_partkey AS id FROM part WHERE p_size >= 45)"


@q("jn1_get_nodes", f"WITH {SEEDS} SELECT 'P' || p_partkey AS entity_name, p_type AS entity_type FROM part WHERE 'P' || p_partkey IN (SELECT id FROM seeds)")
def jn1(spark, sf):
    return G.get_nodes(part_nodes(spark, sf), big_parts(spark, sf)).select("entity_name", "entity_type")


@q("jn2_get_edges", f"WITH {E} SELECT 'S' || l_suppkey AS a, 'P' || l_partkey AS b, l_orderkey AS o, weight FROM lineitem JOIN e ON src = 'P' || l_partkey AND tgt = 'S' || l_suppkey WHERE l_quantity >= 40")
def jn2(spark, sf):
    asked = table(spark, sf, "lineitem").where("l_quantity >= 40").select(F.concat(F.lit("S"), "l_suppkey").alias("a"), F.concat(F.lit("P"), "l_partkey").alias("b"), F.col("l_orderkey").alias("o"))
    return G.get_edges(light_edges(spark, sf), asked)


@q("jn3_adjacency", f"WITH {E}, {SEEDS} SELECT src, tgt FROM e WHERE src IN (SELECT id FROM seeds) UNION ALL SELECT tgt, src FROM e WHERE tgt IN (SELECT id FROM seeds)")
def jn3(spark, sf):
    return G.adjacency(light_edges(spark, sf), big_parts(spark, sf))


@q("jn4_nodes_by_chunks", "SELECT DISTINCT vec_id FROM (SELECT vec_id, unnest(string_split(source_id, '<SEP>')) AS id FROM vdb_entities) e WHERE id IN (SELECT id FROM text_chunks WHERE tokens > 300)")
def jn4(spark, sf):
    return G.by_chunks(table(spark, sf, "vdb_entities"), table(spark, sf, "text_chunks").where("tokens > 300").select("id"), ["vec_id"])


@q("jn5_edges_by_chunks", f"WITH {LINES} SELECT DISTINCT tgt_id AS src, src_id AS tgt FROM m WHERE o IN (SELECT 'O' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def jn5(spark, sf):
    m = line_mentions(spark, sf).select(F.col("tgt_id").alias("src"), F.col("src_id").alias("tgt"), "source_id")
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("O"), "o_orderkey").alias("id"))
    return G.by_chunks(m, urgent, ["src", "tgt"])


def similar_graph(spark, sf, threshold=0.3):
    """Nodes and edges of similar embeddings."""
    rows = table(spark, sf, "embeddings")
    pairs = V.similar_pairs(rows, "vec_id", "embedding", threshold)
    name = lambda c: F.concat(F.lit("V"), F.lpad(F.col(c).cast("string"), 8, "0"))
    edges = pairs.select(name("a").alias("src"), name("b").alias("tgt"), F.col("score").alias("weight"))
    return rows.select(name("vec_id").alias("entity_name"), "vec_id", "embedding", "label"), edges


def _name(c: str) -> str:
    return f"'V' || lpad({c}::VARCHAR, 8, '0')"


PAIRS = f"""u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
   pr AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.v, y.v) AS c FROM u x JOIN u y ON x.vec_id < y.vec_id),
   ve AS (SELECT {_name('a')} AS src, {_name('b')} AS tgt, c AS weight FROM pr WHERE c >= 0.3),
   vd AS (SELECT id, count(*) AS c FROM (SELECT src AS id FROM ve UNION ALL SELECT tgt FROM ve) GROUP BY id)"""


@q("jn6_induced_edges", f"WITH {PAIRS}, s AS (SELECT {_name('vec_id')} AS id FROM embeddings WHERE label <= 3) SELECT src, tgt, round(weight, 6) AS weight, x.c + y.c AS rank FROM ve JOIN vd x ON x.id = src JOIN vd y ON y.id = tgt WHERE src IN (SELECT id FROM s) AND tgt IN (SELECT id FROM s)")
def jn6(spark, sf):
    nodes, edges = similar_graph(spark, sf)
    return G.induced(edges, nodes.where("label <= 3")).withColumn("weight", F.round("weight", 6))


@q("jn7_endpoints_in_order", f"WITH {E} SELECT id AS entity_name, min([o, side]) AS first FROM (SELECT src AS id, weight, src, tgt, 0 AS side FROM e UNION ALL SELECT tgt, weight, src, tgt, 1 FROM e) JOIN (SELECT src AS s2, tgt AS t2, row_number() OVER (ORDER BY src, tgt) AS o FROM e) ON s2 = src AND t2 = tgt GROUP BY id".replace("min([o, side]) AS first", "min(o * 2 + side) AS first"))
def jn7(spark, sf):
    placed = numbered(light_edges(spark, sf).select("src", "tgt"), "src", "tgt", start=1)
    return G.endpoints_in_order(placed).select("entity_name", (F.col("first.o") * 2 + F.col("first.side")).cast("bigint").alias("first"))


@q("jn8_entity_chunks", """SELECT id, min([vec_id, place]) AS first, count(*) AS occurrences FROM (SELECT vec_id, unnest(string_split(source_id, '<SEP>')) AS id, generate_subscripts(string_split(source_id, '<SEP>'), 1) - 1 AS place FROM vdb_entities) WHERE id <> '' GROUP BY id""")
def jn8(spark, sf):
    c = G.related_chunks(table(spark, sf, "vdb_entities"), "vec_id")
    return c.select("id", F.array(F.col("first.o"), F.col("first.place").cast("bigint")).alias("first"), "occurrences")


@q("jn9_relation_chunks", f"WITH {LINES}, ent AS (SELECT DISTINCT o FROM m WHERE f = 'R') SELECT o AS id, count(*) AS occurrences FROM (SELECT DISTINCT src_id, tgt_id, o FROM m) WHERE o NOT IN (SELECT o FROM ent) GROUP BY o")
def jn9(spark, sf):
    m = line_mentions(spark, sf)
    rel = m.groupBy("src_id", "tgt_id").agg(F.array_join(F.collect_set("source_id"), "<SEP>").alias("source_id")).withColumn("ord", F.concat("src_id", "tgt_id"))
    seen = m.where("entity_type = 'R'").select(F.col("source_id").alias("id")).distinct()
    return G.related_chunks(rel).join(seen, "id", "left_anti").select("id", "occurrences")


@q("jn10_relations_for_entities", f"WITH {E}, {DEG}, {SEEDS}, s AS (SELECT id FROM seeds UNION SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal > 5000) SELECT src, tgt, weight, x.c + y.c AS rank FROM e JOIN deg x ON x.id = src JOIN deg y ON y.id = tgt WHERE src IN (SELECT id FROM s) AND tgt IN (SELECT id FROM s)")
def jn10(spark, sf):
    rich = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_name"))
    return G.induced(light_edges(spark, sf), big_parts(spark, sf).union(rich))


@q("jn11_similar_pairs", f"WITH {PAIRS} SELECT a, b, round(c, 6) AS score FROM pr WHERE c >= 0.3")
def jn11(spark, sf):
    return V.similar_pairs(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.3).withColumn("score", F.round("score", 6))


@q("jn13_node_edges", f"WITH {E}, one AS (SELECT min(src) AS id FROM e) SELECT src, tgt, weight FROM e JOIN one ON src = id OR tgt = id")
def jn13(spark, sf):
    e = light_edges(spark, sf)
    one = F.broadcast(e.agg(F.min("src").alias("id")))
    return e.join(one, (e.src == one.id) | (e.tgt == one.id)).select("src", "tgt", "weight")


def query_vector(spark, sf):
    return table(spark, sf, "embeddings").orderBy("vec_id").select("embedding").first()[0]


Q = "q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings ORDER BY vec_id LIMIT 1), sc AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], qv) AS score FROM embeddings, q)"


@q("vs1_top_k", f"WITH {Q} SELECT vec_id, round(score, 6) AS score FROM sc WHERE score >= 0.2 ORDER BY score DESC, vec_id LIMIT 40")
def vs1(spark, sf):
    best = V.top_k(table(spark, sf, "embeddings"), query_vector(spark, sf), 40, "vec_id", "embedding")
    return best.select("vec_id", F.round("score", 6).alias("score"))


@q("vs2_top_k_strict", f"WITH {Q} SELECT vec_id, round(score, 6) AS score FROM sc WHERE 1 - score < 0.75 ORDER BY score DESC, vec_id LIMIT 40")
def vs2(spark, sf):
    best = V.top_k(table(spark, sf, "embeddings"), query_vector(spark, sf), 40, "vec_id", "embedding", 0.25, strict=True)
    return best.select("vec_id", F.round("score", 6).alias("score"))


@q("vs3_top_k_then_threshold", f"WITH {Q}, t AS (SELECT * FROM sc ORDER BY score DESC, vec_id LIMIT 40) SELECT vec_id, round(score, 6) AS score FROM t WHERE score >= 0.25")
def vs3(spark, sf):
    best = V.top_k_then_threshold(table(spark, sf, "embeddings"), query_vector(spark, sf), 40, "vec_id", "embedding", 0.25)
    return best.select("vec_id", F.round("score", 6).alias("score"))


@q("vs5_embed", "SELECT doc_id, [length(text)::FLOAT, 1.0::FLOAT] AS vector FROM documents WHERE text IS NOT NULL")
def vs5(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    return V.embed(d, lambda texts: [[float(len(t)), 1.0] for t in texts], "text").select("doc_id", "vector")


@q("vs6_vectors_by_ids", "SELECT id, vec_id, len(vector)::INT AS dim FROM vdb_entities WHERE id IN (SELECT 'ent-' || md5(entity_name) FROM vdb_entities WHERE entity_type = 'person')")
def vs6(spark, sf):
    v = table(spark, sf, "vdb_entities")
    ids = v.where("entity_type = 'person'").select(F.concat(F.lit("ent-"), F.md5("entity_name")).alias("id"))
    return V.by_ids(v, ids).select("id", "vec_id", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("dim"))


@q("vs7_delete_relations_of", f"WITH {E}, one AS (SELECT min(tgt) AS id FROM e) SELECT src, tgt FROM e, one WHERE src <> id AND tgt <> id")
def vs7(spark, sf):
    e = light_edges(spark, sf)
    return V.delete_relations_of(e, e.agg(F.min("tgt")).first()[0]).select("src", "tgt")


@q("vs8_cosine", """SELECT o.vec_id, round(CASE WHEN len(o.vector) = 64 AND NOT coalesce(list_bool_or(list_transform(o.vector, lambda x: isnan(x))), false) AND list_dot_product(o.vector::DOUBLE[], o.vector::DOUBLE[]) > 0 THEN list_cosine_similarity(o.vector::DOUBLE[], q.embedding::DOUBLE[]) END, 6) AS score
   FROM vdb_entities o, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q""")
def vs8(spark, sf):
    v = table(spark, sf, "vdb_entities")
    return V.scored(v, query_vector(spark, sf)).select("vec_id", F.round("score", 6).alias("score"))


@q("vs9_get_by_id", "SELECT vec_id, entity_name FROM vdb_entities WHERE id = (SELECT min(id) FROM vdb_entities)")
def vs9(spark, sf):
    v = table(spark, sf, "vdb_entities")
    return v.join(F.broadcast(v.agg(F.min("id").alias("id"))), "id").select("vec_id", "entity_name")


_COMMUNITIES = f"{E}, lk AS (SELECT src, tgt, weight AS w FROM e UNION ALL SELECT tgt, src, weight FROM e), g0 AS (SELECT DISTINCT src AS id, src AS c FROM lk)"
for _i in (1, 2, 3):
    _COMMUNITIES += f""", v{_i} AS (SELECT id, c, sum(w) AS w FROM (SELECT lk.src AS id, c, w FROM lk JOIN g{_i - 1} g ON g.id = lk.tgt UNION ALL SELECT id, c, 0.0 FROM g{_i - 1}) GROUP BY id, c),
   g{_i} AS (SELECT id, c FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, c) AS r FROM v{_i}) WHERE r = 1)"""


@q("snk4_communities", f"WITH {_COMMUNITIES} SELECT id AS entity_name, c AS community FROM g3")
def snk4(spark, sf):
    return G.communities(light_edges(spark, sf), 3)


@q("rt18_labels", f"WITH {E} SELECT src AS entity_name FROM e UNION SELECT tgt FROM e")
def rt18(spark, sf):
    return G.degrees(light_edges(spark, sf)).select("entity_name").orderBy("entity_name")


