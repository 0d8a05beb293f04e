"""Mutation, source, sink and conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.operators import conversation as T
from weftgraph.operators import maintenance as M
from weftgraph.operators import vectors as V
from weftgraph.queries.base import Registry, table
from weftgraph.queries.graph import SEEDS, E, big_parts, part_nodes, similar_graph
from weftgraph.queries.ingest import LINES, light_edges, line_mentions
from weftgraph.plans import Scratch
from weftgraph.sources import custom_graph as K
from weftgraph.tables import Store

q = Registry()
SUP = "'S' || s_suppkey"


@q("mu1_upsert_nodes", "SELECT coalesce(a.id, b.id) AS entity_name, coalesce(b.t, a.t) AS entity_type, a.d AS description FROM (SELECT 'P' || p_partkey AS id, p_type AS t, p_name AS d FROM part) a FULL JOIN (SELECT 'P' || l_partkey AS id, max(l_returnflag) AS t FROM lineitem WHERE l_quantity > 48 GROUP BY 1 UNION ALL SELECT 'S' || s_suppkey, s_name FROM supplier) b ON a.id = b.id")
def mu1(spark, sf):
    li = table(spark, sf, "lineitem").where("l_quantity > 48").groupBy(F.concat(F.lit("P"), "l_partkey").alias("entity_name")).agg(F.max("l_returnflag").alias("entity_type"))
    new = li.union(table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey"), "s_name"))
    return M.upsert_rows(part_nodes(spark, sf), new, ["entity_name"])


@q("mu2_remove_nodes", f"WITH {E}, {SEEDS} SELECT src, tgt, weight FROM e WHERE src NOT IN (SELECT id FROM seeds) AND tgt NOT IN (SELECT id FROM seeds)")
def mu2(spark, sf):
    return M.remove_nodes(part_nodes(spark, sf), light_edges(spark, sf), big_parts(spark, sf))[1]


@q("mu2_remove_edges", f"WITH {E} SELECT src, tgt, weight FROM e WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_quantity >= 25 AND src = 'P' || l_partkey AND tgt = 'S' || l_suppkey)")
def mu2b(spark, sf):
    pairs = table(spark, sf, "lineitem").where("l_quantity >= 25").select(F.concat(F.lit("S"), "l_suppkey").alias("a"), F.concat(F.lit("P"), "l_partkey").alias("b"))
    return M.remove_edges(light_edges(spark, sf), pairs)


@q("mu3_delete_by_entity", f"WITH {E}, one AS (SELECT min(src) AS id FROM e) SELECT 'P' || p_partkey AS entity_name FROM part, one WHERE 'P' || p_partkey <> id")
def mu3(spark, sf):
    e = light_edges(spark, sf)
    return M.remove_nodes(part_nodes(spark, sf), e, e.agg(F.min("src").alias("entity_name")))[0].select("entity_name")


@q("mu4_rename_entity", f"WITH {E}, one AS (SELECT min(src) AS id FROM e), r AS (SELECT CASE WHEN src = id THEN 'Renamed' ELSE src END AS a, tgt AS b, weight FROM e, one) SELECT least(a, b) AS src, greatest(a, b) AS tgt, weight FROM r")
def mu4(spark, sf):
    e = light_edges(spark, sf)
    return M.rename_entity(part_nodes(spark, sf), e, e.agg(F.min("src")).first()[0], "Renamed")[1]


@q("mu5_create", f"WITH {E} SELECT src, tgt, weight FROM e UNION ALL SELECT least('P' || min(p_partkey), 'P' || max(p_partkey)), greatest('P' || min(p_partkey), 'P' || max(p_partkey)), 9.0 FROM part")
def mu5(spark, sf):
    p = table(spark, sf, "part").agg(F.concat(F.lit("P"), F.min("p_partkey")).alias("src"), F.concat(F.lit("P"), F.max("p_partkey")).alias("tgt"), F.lit(9.0).alias("weight"))
    return M.create_relation(part_nodes(spark, sf), light_edges(spark, sf), p).select("src", "tgt", "weight")


MERGED = f"""{LINES}, e AS (SELECT tgt_id AS a, src_id AS b, count(*)::DOUBLE AS w, array_to_string(list_sort(list_distinct(list(f))), '<SEP>') AS k FROM m GROUP BY ALL), mp AS (SELECT {SUP} AS old, 'N' || s_nationkey AS new FROM supplier)"""


def merge_edges_source(spark, sf):
    m = line_mentions(spark, sf)
    return m.groupBy(F.col("tgt_id").alias("src"), F.col("src_id").alias("tgt")).agg(F.count(F.lit(1)).cast("double").alias("weight"), F.array_join(F.array_sort(F.collect_set("entity_type")), X.SEP).alias("keywords"))


@q("mu6_merge_edges", f"{'WITH ' + MERGED} SELECT least(a, new) AS src, greatest(a, new) AS tgt, max(w) AS weight, array_to_string(list_sort(list_distinct(flatten(list(string_split(k, '<SEP>'))))), '<SEP>') AS keywords FROM e JOIN mp ON old = b GROUP BY 1, 2")
def mu6(spark, sf):
    """Suppliers of one nation become one entity."""
    s = table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("old"), F.concat(F.lit("N"), "s_nationkey").alias("new"))
    return M.merge_entities(part_nodes(spark, sf), merge_edges_source(spark, sf), s)[1]


@q("mu6_merge_nodes", f"WITH s AS (SELECT 'N' || s_nationkey AS entity_name, {SUP} AS o, s_name AS d FROM supplier) SELECT entity_name, string_agg(d, chr(10) || chr(10) ORDER BY o) AS description FROM s GROUP BY entity_name")
def mu6b(spark, sf):
    s = table(spark, sf, "supplier")
    nodes = s.select(F.concat(F.lit("S"), "s_suppkey").alias("entity_name"), F.col("s_name").alias("description"))
    to = s.select(F.concat(F.lit("S"), "s_suppkey").alias("old"), F.concat(F.lit("N"), "s_nationkey").alias("new"))
    return M.merge_entities(nodes, light_edges(spark, sf), to)[0]


@q("ag10_merge_attributes", """SELECT full_doc_id, arg_min(file_path, chunk_row) FILTER (WHERE coalesce(file_path, '') <> '') AS file_path, max(tokens)::DOUBLE AS tokens, arg_max(time_label, chunk_row) FILTER (WHERE coalesce(time_label, '') <> '') AS time_label FROM text_chunks GROUP BY full_doc_id""")
def ag10(spark, sf):
    c = table(spark, sf, "text_chunks").select("full_doc_id", "chunk_row", "file_path", "tokens", "time_label")
    return M.merged_attributes(c, ["full_doc_id"], "chunk_row", {"tokens": M.MAX, "time_label": M.KEEP_LAST})


DECISIONS = """pr AS (SELECT DISTINCT entity_a_id AS a, entity_b_id AS b FROM entity_merge_cache WHERE entity_a_id IS NOT NULL AND entity_b_id IS NOT NULL),
   lg AS (SELECT entity_a_id AS a, entity_b_id AS b, arg_max(lower(trim(decision)), [epoch_us(decided_at), pair_row]) AS decision FROM entity_merge_cache WHERE decision IS NOT NULL AND decided_at IS NOT NULL GROUP BY 1, 2)"""


@q("mu7_merge_decisions", f"WITH {DECISIONS} SELECT pr.a, pr.b, CASE WHEN decision = 'merged' THEN 'merge' WHEN decision = 'skipped' THEN 'skip' ELSE 'ask' END AS act FROM pr LEFT JOIN lg ON lg.a = pr.a AND lg.b = pr.b")
def mu7(spark, sf):
    log = table(spark, sf, "entity_merge_cache")
    pairs = log.where("entity_a_id IS NOT NULL AND entity_b_id IS NOT NULL").select(F.col("entity_a_id").alias("a"), F.col("entity_b_id").alias("b")).distinct().withColumns({"hash_a": F.lit("h"), "hash_b": F.lit("h")})
    said = log.where("decision IS NOT NULL AND decided_at IS NOT NULL").select(
        F.col("entity_a_id").alias("a"), F.col("entity_b_id").alias("b"), F.lower(F.trim("decision")).alias("decision"), F.lit("h").alias("hash_a"), F.lit("h").alias("hash_b"), F.struct("decided_at", "pair_row").alias("decided_at")
    )
    merge, skip, ask = M.merge_decisions(pairs, said)
    return merge.select("a", "b", F.lit("merge").alias("act")).union(skip.select("a", "b", F.lit("skip"))).union(ask.select("a", "b", F.lit("ask")))


@q("mu7_greedy_matching")
def mu7b(spark, sf):
    """Pairs to merge, best first, every name once; tested against going one by one."""
    pairs = V.similar_pairs(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.4)
    return M.greedy_matching(pairs).withColumn("score", F.round("score", 6))


@q("mu8_merge_until_stable")
def mu8(spark, sf):
    """Passes of merging similar embeddings into the smaller name until none is left."""
    nodes, edges = similar_graph(spark, sf, 0.4)
    find = lambda n: edges.select(F.col("src").alias("a"), F.col("tgt").alias("b"), F.col("weight").alias("score")).join(n.select(F.col("entity_name").alias("a")), "a").join(n.select(F.col("entity_name").alias("b")), "b")
    plain = nodes.select("entity_name", F.col("label").cast("string").alias("description"))
    return M.merge_until_stable(plain, edges, find)[0]


@q("mu9_after_deletion", """WITH ec AS (SELECT vec_id, unnest(string_split(source_id, '<SEP>')) AS id FROM vdb_entities WHERE source_id IS NOT NULL), gone AS (SELECT DISTINCT id FROM text_chunks WHERE full_doc_id = (SELECT full_doc_id FROM text_chunks WHERE full_doc_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)),
   b AS (SELECT vec_id, count(*) FILTER (WHERE id IN (SELECT id FROM gone)) AS lost, coalesce(list_sort(list_distinct(list(id) FILTER (WHERE id NOT IN (SELECT id FROM gone)))), []) AS rest FROM ec GROUP BY vec_id)
   SELECT vec_id, CASE WHEN len(rest) = 0 THEN 'delete' ELSE 'rebuild' END AS action, array_to_string(rest, '<SEP>') AS remaining FROM b WHERE lost > 0""")
def mu9(spark, sf):
    """The document with the most chunks is deleted."""
    c = table(spark, sf, "text_chunks").where("full_doc_id IS NOT NULL")
    big = c.groupBy("full_doc_id").count().orderBy(F.desc("count"), "full_doc_id").limit(1)
    gone = c.join(F.broadcast(big.select("full_doc_id")), "full_doc_id").select("id")
    return M.after_deletion(table(spark, sf, "vdb_entities").where("source_id IS NOT NULL"), gone, ["vec_id"])


GONE = "gone AS (SELECT 'O' || o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT')"


def urgent(spark, sf):
    return table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("O"), "o_orderkey").alias("id"))


@q("mu10_rebuild_nodes", f"""WITH {LINES}, {GONE}, af AS (SELECT DISTINCT tgt_id FROM m WHERE o IN (SELECT id FROM gone)), r AS (SELECT * FROM m WHERE o NOT IN (SELECT id FROM gone) AND tgt_id IN (SELECT tgt_id FROM af)), ty AS (SELECT tgt_id, f, count(*) AS n, min(ord) AS mo FROM r GROUP BY ALL)
   SELECT tgt_id AS entity_name, entity_type, mentions FROM (SELECT tgt_id, f AS entity_type, sum(n) OVER (PARTITION BY tgt_id)::BIGINT AS mentions, row_number() OVER (PARTITION BY tgt_id ORDER BY n DESC, mo, f) AS rn FROM ty) WHERE rn = 1""")
def mu10(spark, sf):
    return M.rebuild_nodes(line_mentions(spark, sf), urgent(spark, sf)).select("entity_name", "entity_type", "mentions")


@q("mu11_rebuild_edges", f"WITH {LINES}, {GONE}, af AS (SELECT DISTINCT src_id, tgt_id FROM m WHERE o IN (SELECT id FROM gone)) SELECT m.tgt_id AS src, m.src_id AS tgt, count(*)::DOUBLE AS weight FROM m JOIN af ON af.src_id = m.src_id AND af.tgt_id = m.tgt_id WHERE o NOT IN (SELECT id FROM gone) GROUP BY ALL")
def mu11(spark, sf):
    return M.rebuild_edges(line_mentions(spark, sf), urgent(spark, sf)).select("src", "tgt", "weight")


@q("mu12_entity_info", f"WITH {SEEDS} SELECT 'P' || p_partkey AS entity_name, p_type AS entity_type, p_partkey % 2 = 0 AS has_vector FROM part WHERE 'P' || p_partkey IN (SELECT id FROM seeds)")
def mu12(spark, sf):
    nodes = part_nodes(spark, sf)
    have = table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("P"), "p_partkey").alias("entity_name"))  # the parts that got a vector
    return M.info(nodes, have, big_parts(spark, sf)).select("entity_name", "entity_type", "has_vector")


@q("mu13_clear_cache", "SELECT count(*) AS before, 0::BIGINT AS after, 1::BIGINT AS again FROM documents")
def mu13(spark, sf):
    """A cache of the store with an answer to every document, emptied, and written to again."""
    store = Store(spark, Scratch(spark, "cache").root)
    rows = table(spark, sf, "documents").select(F.md5(F.col("doc_id").cast("string")).alias("digest"), F.col("text").alias("answer"), F.lit("").alias("context"))
    name = "llm_response_cache"
    store.append(name, rows)
    before = store.read(name).count()
    store.drop(name)
    after = store.read(name).count()
    store.append(name, spark.createDataFrame([("d", "a", "c")], rows.schema))
    return spark.createDataFrame([(before, after, store.read(name).count())], "before bigint, after bigint, again bigint")


@q("snk1_export", f"WITH {E} SELECT 'entity' AS kind, 'P' || p_partkey AS a, NULL AS b, p_name AS description FROM part UNION ALL SELECT 'relation', src, tgt, 'w' || weight::INT FROM e UNION ALL SELECT 'relation', tgt, src, 'w' || weight::INT FROM e")
def snk1(spark, sf):
    e = light_edges(spark, sf).withColumn("description", F.concat(F.lit("w"), F.col("weight").cast("int")))
    return M.export_rows(part_nodes(spark, sf), e)


@q("src6_custom_chunks", "SELECT DISTINCT 'chunk-' || md5(text) AS id FROM documents WHERE text IS NOT NULL AND 'chunk-' || md5(text) NOT IN (SELECT id FROM text_chunks WHERE id IS NOT NULL) AND 'doc-' || md5(text) NOT IN (SELECT id FROM doc_status WHERE id IS NOT NULL)")
def src6(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL").select(X.record_id("chunk-", F.col("text")).alias("id"), X.record_id("doc-", F.col("text")).alias("full_doc_id"))
    return K.new_chunks(d, table(spark, sf, "doc_status"), table(spark, sf, "text_chunks")).select("id").distinct()


@q("src7_custom_graph", f"WITH {LINES}, ch AS (SELECT 'O' || o_orderkey AS s, 'chunk-' || md5(o_orderpriority || ' ' || o_orderkey) AS id FROM orders WHERE o_orderstatus = 'F') SELECT tgt_id AS src, src_id AS tgt, f AS keywords, d AS description, coalesce(ch.id, 'UNKNOWN') AS source_id, 1.0::DOUBLE AS weight FROM m LEFT JOIN ch ON ch.s = m.o")
def src7(spark, sf):
    chunks, entities, relations = custom(spark, sf)
    return K.load(chunks, entities, relations)[2]


@q("src7_custom_nodes", f"WITH {LINES}, ch AS (SELECT 'O' || o_orderkey AS s, 'chunk-' || md5(o_orderpriority || ' ' || o_orderkey) AS id FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT src_id, coalesce(ch.id, 'UNKNOWN') AS c FROM m LEFT JOIN ch ON ch.s = m.o) SELECT 'P' || p_partkey AS entity_name, p_type AS entity_type, p_name AS description, 'UNKNOWN' AS source_id FROM part UNION ALL SELECT src_id, 'UNKNOWN', 'UNKNOWN', min(c) FROM r GROUP BY src_id")
def src7b(spark, sf):
    chunks, entities, relations = custom(spark, sf)
    return K.load(chunks, entities, relations)[1]


def custom(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    chunks = o.select(F.concat("o_orderpriority", F.lit(" "), "o_orderkey").alias("content"), F.concat(F.lit("O"), "o_orderkey").alias("source_id"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("chunk_order_index"))
    m = line_mentions(spark, sf).select("src_id", "tgt_id", "source_id", "weight", F.col("entity_type").alias("keywords"), "description")
    return chunks, part_nodes(spark, sf).withColumn("source_id", F.lit("none")), m


MESSAGES = "ms AS (SELECT user_id AS conv_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, CASE WHEN event_id % 5 = 0 THEN 'system' WHEN event_id % 2 = 0 THEN 'assistant' ELSE 'user' END AS role, event_type AS text FROM events)"


@q("tx12_conversation_turns", f"""WITH {MESSAGES}, p AS (SELECT conv_id, (turn - 1) // 2 AS p, max(text) FILTER (WHERE role = 'user') AS u, max(text) FILTER (WHERE role = 'assistant') AS a, count(*) AS m FROM ms GROUP BY 1, 2),
   k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p DESC) AS r FROM p WHERE m = 2 AND u IS NOT NULL AND a IS NOT NULL), h AS (SELECT conv_id, string_agg('user: ' || u || chr(10) || 'assistant: ' || a, chr(10) ORDER BY p) AS history FROM k WHERE r <= 3 GROUP BY conv_id)
   SELECT c.conv_id, coalesce(history, '') AS history FROM (SELECT DISTINCT conv_id FROM ms) c LEFT JOIN h ON h.conv_id = c.conv_id""")
def tx12(spark, sf):
    role = F.when(F.col("event_id") % 5 == 0, "system").when(F.col("event_id") % 2 == 0, "assistant").otherwise("user")
    m = table(spark, sf, "events").select(F.col("user_id").alias("conv_id"), F.struct("ts", "event_id").alias("turn"), role.alias("role"), F.col("event_type").alias("text"))
    return T.turns(m, 3)


@q("tx13_current_quarter", "SELECT event_id, year(ts)::INT AS year, quarter(ts)::INT AS quarter FROM events")
def tx13(spark, sf):
    q = X.year_and_quarter(F.col("ts"))
    return table(spark, sf, "events").select("event_id", q["year"].alias("year"), q["quarter"].alias("quarter"))


