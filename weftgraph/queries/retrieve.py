"""Retrieval queries: local, global, expansion, fusion, selection and budgets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.models import Config, QueryParam
from weftgraph.operators import graph as G
from weftgraph.operators import retrieval as R
from weftgraph.operators import vectors as V
from weftgraph.plans import numbered
from weftgraph.queries.base import Registry, table
from weftgraph.queries.graph import PAIRS, Q, _name, query_vector, similar_graph
from weftgraph.queries.ingest import tok

q = Registry()
# The engine's own settings.
HOPS_TOP, HOPS_THRESHOLD = QueryParam.top_neighbors, QueryParam.multi_hop_relevance_threshold


def hits(nodes, query, k=20, threshold=0.2):
    best = V.top_k(nodes.select("entity_name", "vec_id", "label", F.col("embedding").alias("vector")), query, k, "vec_id", "vector", threshold)
    return best


HITS = f"hits AS (SELECT {_name('vec_id')} AS id, vec_id, label, score, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS pos FROM (SELECT * FROM sc WHERE score >= 0.2 ORDER BY score DESC, vec_id LIMIT 20))"
LOCAL = f"""{Q}, {PAIRS}, {HITS}, nd AS (SELECT hits.*, coalesce(vd.c, 0) AS rank FROM hits LEFT JOIN vd ON vd.id = hits.id)"""


def local(spark, sf):
    nodes, edges = similar_graph(spark, sf)
    h = hits(nodes, query_vector(spark, sf))
    return R.node_data(h.select("entity_name", "score"), nodes.select("entity_name", "vec_id", "label"), edges), nodes, edges


@q("rt01_local_nodes", f"WITH {LOCAL} SELECT id AS entity_name, vec_id, label, round(score, 6) AS score, rank FROM nd")
def rt1(spark, sf):
    rows, _, _ = local(spark, sf)
    return rows.withColumn("score", F.round("score", 6))


@q("rt01_local_edges", f"WITH {LOCAL} SELECT src, tgt, round(weight, 6) AS weight, x.c + y.c AS rank FROM ve JOIN vd x ON x.id = src JOIN vd y ON y.id = tgt WHERE src IN (SELECT id FROM nd) AND tgt IN (SELECT id FROM nd)")
def rt1b(spark, sf):
    rows, _, edges = local(spark, sf)
    return G.induced(edges, rows).withColumn("weight", F.round("weight", 6))


@q("rt01_local_context", f"""WITH {LOCAL}, b AS (SELECT *, sum(label + 1) OVER (ORDER BY score DESC, vec_id) AS s FROM nd)
   SELECT '| entity_name | label | rank |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || id || ' | ' || label || ' | ' || rank || ' |', chr(10) ORDER BY -score, vec_id) AS context FROM b WHERE s <= 60""".replace("|| '| --- | --- | --- |'", "|| '| --- | --- | --- |'"))
def rt1c(spark, sf):
    """The minimum slice: search, rank, budget, markdown."""
    rows, _, _ = local(spark, sf)
    kept = R.within_budget(rows.withColumn("n", F.col("label") + 1), "n", 60, F.desc("score"), F.col("vec_id"))
    return R.render(kept, ["entity_name", "label", "rank"], -F.col("score"), F.col("vec_id"), form="markdown")


GLOBAL = f"{Q}, {PAIRS}, rs AS (SELECT src, tgt, weight, row_number() OVER (ORDER BY weight DESC, src, tgt) - 1 AS pos FROM ve ORDER BY weight DESC, src, tgt LIMIT 40), gd AS (SELECT rs.*, x.c + y.c AS rank FROM rs JOIN vd x ON x.id = src JOIN vd y ON y.id = tgt)"


def relation_hits(edges, k=40):
    return edges.select("src", "tgt", F.col("weight").alias("score")).orderBy(F.desc("score"), "src", "tgt").limit(k)


def with_pos(rows, *order):
    """Places of a bounded hit list."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1)


@q("rt02_global_edges", f"WITH {GLOBAL} SELECT src, tgt, round(weight, 6) AS score, rank FROM gd")
def rt2(spark, sf):
    _, edges = similar_graph(spark, sf)
    return R.edge_data(relation_hits(edges), edges).select("src", "tgt", F.round("score", 6).alias("score"), "rank")


@q("rt02_global_entities", f"WITH {GLOBAL}, en AS (SELECT src AS id, pos * 2 AS o FROM gd UNION ALL SELECT tgt, pos * 2 + 1 FROM gd) SELECT id AS entity_name, min(o) AS first FROM en GROUP BY id")
def rt2b(spark, sf):
    _, edges = similar_graph(spark, sf)
    rel = with_pos(relation_hits(edges), F.desc("score"), "src", "tgt").withColumnRenamed("pos", "ord")
    return G.endpoints_in_order(rel).select("entity_name", (F.col("first.o") * 2 + F.col("first.side")).cast("bigint").alias("first"))


@q("rt03_vector_context", """WITH qv AS (SELECT vector::DOUBLE[] AS q FROM vdb_entities WHERE len(vector) = 64 AND NOT list_bool_or(list_transform(vector, lambda x: isnan(x))) AND list_dot_product(vector::DOUBLE[], vector::DOUBLE[]) > 0 ORDER BY vec_id LIMIT 1)
   SELECT vec_id, entity_name, round(list_cosine_similarity(vector::DOUBLE[], q), 6) AS score FROM vdb_entities, qv WHERE len(vector) = 64 AND NOT list_bool_or(list_transform(vector, lambda x: isnan(x))) AND list_dot_product(vector::DOUBLE[], vector::DOUBLE[]) > 0 AND list_cosine_similarity(vector::DOUBLE[], q) >= 0.2 ORDER BY list_cosine_similarity(vector::DOUBLE[], q) DESC, vec_id LIMIT 20""")
def rt3(spark, sf):
    v = table(spark, sf, "vdb_entities")
    usable = v.where((F.size("vector") == 64) & V.cosine(F.col("vector"), F.col("vector")).isNotNull())
    first = usable.orderBy("vec_id").select("vector").first()[0]
    return V.top_k(v, first, 20, "vec_id").select("vec_id", "entity_name", F.round("score", 6).alias("score"))


@q("rt04_round_robin", f"WITH {GLOBAL}, {HITS}, l AS (SELECT id, pos, 0 AS s FROM hits UNION ALL SELECT src, pos * 2, 1 FROM gd UNION ALL SELECT tgt, pos * 2 + 1, 1 FROM gd), f AS (SELECT id, min([pos, s]) AS p FROM l GROUP BY id) SELECT id AS entity_name, p[1]::BIGINT AS rank, p[2]::INT AS source FROM f")
def rt4(spark, sf):
    nodes, edges = similar_graph(spark, sf)
    one = with_pos(hits(nodes, query_vector(spark, sf)), F.desc("score"), "vec_id").select("entity_name", F.col("pos").cast("bigint").alias("rank"))
    rel = with_pos(relation_hits(edges), F.desc("score"), "src", "tgt").withColumnRenamed("pos", "ord")
    two = G.endpoints_in_order(rel).select("entity_name", (F.col("first.o") * 2 + F.col("first.side")).cast("bigint").alias("rank"))
    return R.round_robin(["entity_name"], one, two)


@q("rt05_three_lists", """WITH c AS (SELECT id, full_doc_id, tokens, chunk_row FROM text_chunks WHERE tokens IS NOT NULL), l AS (
     SELECT id, row_number() OVER (ORDER BY tokens DESC, chunk_row) AS r, 0 AS s FROM c UNION ALL SELECT id, row_number() OVER (ORDER BY tokens, chunk_row), 1 FROM c UNION ALL SELECT id, row_number() OVER (ORDER BY chunk_row), 2 FROM c), f AS (SELECT id, min([r, s]) AS p FROM l GROUP BY id)
   SELECT id, p[1]::INT AS rank, p[2]::INT AS source FROM f""")
def rt5(spark, sf):
    c = table(spark, sf, "text_chunks").where("tokens IS NOT NULL").select("id", "tokens", "chunk_row")
    rank = lambda *o: numbered(c, *o, out="rank", start=1)
    return R.round_robin(["id"], rank(F.desc("tokens"), "chunk_row"), rank("tokens", "chunk_row"), rank("chunk_row")).withColumn("rank", F.col("rank").cast("int"))


def sims(spark, sf):
    """Graph, seeds (local hits, five best), entity and relation similarities to the query."""
    nodes, edges = similar_graph(spark, sf)
    s = V.scored(nodes.select("entity_name", "vec_id", "embedding"), query_vector(spark, sf), "embedding").select("entity_name", "vec_id", F.col("score").alias("sim"))
    seeds = with_pos(s.orderBy(F.desc("sim"), "vec_id").limit(5), F.desc("sim"), "vec_id").select("entity_name", "pos")
    return edges, seeds, s.select("entity_name", "sim"), edges.select("src", "tgt", F.col("weight").alias("sim"))


SIMS = f"""{Q}, {PAIRS}, es AS (SELECT {_name('vec_id')} AS id, vec_id, score AS sim FROM sc), seeds AS (SELECT id, row_number() OVER (ORDER BY sim DESC, vec_id) - 1 AS pos FROM es ORDER BY sim DESC, vec_id LIMIT 5),
   lk AS (SELECT src, tgt, weight FROM ve UNION ALL SELECT tgt, src, weight FROM ve)"""


def _hop_sql(h: int, frontier: str, visited: str) -> str:
    return f"""c{h} AS (SELECT lk.src, lk.tgt, f.pos, 0.4 * greatest(0.0, e.sim) + 0.5 * greatest(0.0, lk.weight) + 0.1 * pow(0.8, {h - 1}) AS score FROM lk JOIN {frontier} f ON f.id = lk.src JOIN es e ON e.id = lk.tgt WHERE lk.tgt NOT IN ({visited})),
   k{h} AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY score DESC, tgt) AS r FROM c{h} WHERE score >= 0.2),
   n{h} AS (SELECT tgt AS id, src AS via, score, pos AS p, r FROM (SELECT *, row_number() OVER (PARTITION BY tgt ORDER BY pos, r) AS z FROM k{h} WHERE r <= {HOPS_TOP}) WHERE z = 1),
   f{h} AS (SELECT id, p * {HOPS_TOP + 1} + r AS pos FROM n{h})"""


HOPS = f"{SIMS}, {_hop_sql(1, 'seeds', 'SELECT id FROM seeds')}, {_hop_sql(2, 'f1', 'SELECT id FROM seeds UNION SELECT id FROM n1')}"


def expanded(spark, sf, top=HOPS_TOP):
    edges, seeds, ent, rel = sims(spark, sf)
    return R.multi_hop(edges, seeds, ent, rel, 2, top, HOPS_THRESHOLD), edges, seeds, ent, rel


@q("rt06_multi_hop", f"WITH {HOPS} SELECT id AS entity_name, via, round(score, 6) AS score, 1 AS hop FROM n1 UNION ALL SELECT id, via, round(score, 6), 2 FROM n2")
def rt6(spark, sf):
    return expanded(spark, sf)[0].withColumn("score", F.round("score", 6))


@q("rt07_relevance", f"WITH {SIMS} SELECT src, tgt, round(0.4 * greatest(0.0, e.sim) + 0.5 * greatest(0.0, weight) + 0.1, 6) AS score FROM ve JOIN es e ON e.id = tgt")
def rt7(spark, sf):
    edges, _, ent, rel = sims(spark, sf)
    j = edges.join(ent.select(F.col("entity_name").alias("tgt"), "sim"), "tgt")
    return j.select("src", "tgt", F.round(R.relevance(F.col("sim"), F.col("weight"), 1), 6).alias("score"))


ITERATIONS = 8
_PR = f"""{SIMS}, sm AS (SELECT id, exp(sim / 0.1) / (SELECT sum(exp(sim / 0.1)) FROM es WHERE id IN (SELECT id FROM seeds)) AS p FROM es WHERE id IN (SELECT id FROM seeds)),
   tot AS (SELECT src, sum(weight) AS t FROM lk GROUP BY src), sh AS (SELECT lk.src, lk.tgt, weight / t AS w FROM lk JOIN tot ON tot.src = lk.src),
   nd AS (SELECT id, coalesce(max(p), 0.0) AS p FROM (SELECT src AS id, NULL::DOUBLE AS p FROM sh UNION ALL SELECT id, p FROM sm) GROUP BY id), r0 AS (SELECT id, p, 1.0 / (SELECT count(*) FROM nd) AS rank FROM nd)"""
for _i in range(1, ITERATIONS + 1):
    _PR += f""", g{_i} AS (SELECT tgt, sum(rank * w) AS got FROM r{_i - 1} JOIN sh ON src = id GROUP BY tgt), l{_i} AS (SELECT coalesce(sum(rank), 0.0) AS lost FROM r{_i - 1} WHERE id NOT IN (SELECT src FROM sh)),
   r{_i} AS (SELECT id, p, 0.85 * (coalesce(got, 0.0) + lost * p) + 0.15 * p AS rank FROM nd LEFT JOIN g{_i} ON tgt = id, l{_i})"""


@q("rt08_pagerank", f"WITH {_PR} SELECT id AS entity_name, round(rank, 6) AS rank FROM r{ITERATIONS}")
def rt8(spark, sf):
    edges, seeds, ent, _ = sims(spark, sf)
    ranks = R.pagerank(edges, R.softmax_seeds(seeds, ent), ITERATIONS, tolerance=None)
    return ranks.select("entity_name", F.round("rank", 6).alias("rank"))


@q("rt09_pagerank_top", f"WITH {_PR} SELECT id AS entity_name, round(rank, 6) AS rank FROM r{ITERATIONS} WHERE id NOT IN (SELECT id FROM seeds) ORDER BY rank DESC, id LIMIT 50")
def rt9(spark, sf):
    edges, seeds, ent, rel = sims(spark, sf)
    best = R.query_aware_pagerank(edges, seeds, ent, rel, 50, ITERATIONS, tolerance=None)
    return best.select("entity_name", F.round("rank", 6).alias("rank"))


DIM = Config.fastrp_dim
_FRP = f"""{SIMS}, lo AS (SELECT src, tgt, weight AS w FROM lk UNION ALL SELECT DISTINCT src, src, 1.0 FROM lk), dg AS (SELECT src, sum(w) AS deg FROM lo GROUP BY src), wk AS (SELECT lo.src, lo.tgt, w / sqrt(a.deg * b.deg) AS w FROM lo JOIN dg a ON a.src = lo.src JOIN dg b ON b.src = lo.tgt),
   x0 AS (SELECT src, d, CASE WHEN ('0x' || substr(md5(src || '|' || d), 1, 2))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END / sqrt({DIM}::DOUBLE) AS x FROM dg, range(0, {DIM}) t(d))"""
for _i in (1, 2, 3):
    _FRP += f", x{_i} AS (SELECT wk.src, d, sum(w * x) AS x FROM wk JOIN x{_i - 1} z ON z.src = wk.tgt GROUP BY wk.src, d)"
_FRP += """, al AS (SELECT src, d, x * 1.0 AS x FROM x0 UNION ALL SELECT src, d, x * 1.0 FROM x1 UNION ALL SELECT src, d, x * 0.5 FROM x2 UNION ALL SELECT src, d, x * 0.25 FROM x3),
   rw AS (SELECT al.src, d, sum(x) * pow(max(deg), -0.1) AS x FROM al JOIN dg ON dg.src = al.src GROUP BY al.src, d), nm AS (SELECT src, sqrt(sum(x * x)) AS n FROM rw GROUP BY src), em AS (SELECT rw.src, d, x / n AS x FROM rw JOIN nm ON nm.src = rw.src)"""


@q("rt10_fastrp", f"WITH {_FRP} SELECT src AS entity_name, d::INT AS d, round(x, 6) AS x FROM em")
def rt10(spark, sf):
    edges, *_ = sims(spark, sf)
    return R.fastrp(edges, DIM).select("entity_name", F.posexplode("x").alias("d", "x")).withColumn("x", F.round("x", 6))


_ST = f"{_FRP}, mn AS (SELECT d, sum(x) AS m FROM em WHERE src IN (SELECT id FROM seeds) GROUP BY d), ss AS (SELECT src, sum(x * m) / (SELECT count(DISTINCT src) FROM em WHERE src IN (SELECT id FROM seeds)) AS score FROM em JOIN mn ON mn.d = em.d WHERE src NOT IN (SELECT id FROM seeds) GROUP BY src)"


@q("rt11_structural_scores", f"WITH {_ST} SELECT src AS entity_name, round(score, 6) AS score FROM ss")
def rt11(spark, sf):
    edges, seeds, *_ = sims(spark, sf)
    return R.structural_scores(R.fastrp(edges, DIM), seeds).select("entity_name", F.round("score", 6).alias("score"))


@q("rt12_structural_top", f"WITH {_ST} SELECT src AS entity_name, round(score, 6) AS score FROM ss ORDER BY score DESC, src LIMIT 20")
def rt12(spark, sf):
    edges, seeds, *_ = sims(spark, sf)
    best = R.structural_scores(R.fastrp(edges, DIM), seeds).orderBy(F.desc("score"), "entity_name").limit(20)
    return best.select("entity_name", F.round("score", 6).alias("score"))


_THREE = f"""{HOPS}, {_PR[len(SIMS) + 2:]}, mh AS (SELECT id FROM n1 UNION SELECT id FROM n2), pp AS (SELECT id FROM r{ITERATIONS} WHERE id NOT IN (SELECT id FROM seeds) ORDER BY rank DESC, id LIMIT 50)"""


@q("rt13_merge_entities", f"""WITH {_THREE}, a AS (SELECT id, 0 AS o, 'multihop' AS m FROM mh UNION ALL SELECT id, 1, 'ppr' FROM pp) SELECT id AS entity_name, arg_min(m, o) AS first_method, array_to_string(list_sort(list(m)), '+') AS discovery_method FROM a GROUP BY id""")
def rt13(spark, sf):
    hop, edges, seeds, ent, rel = expanded(spark, sf)
    return R.merge_entities(("multihop", hop), ("ppr", R.query_aware_pagerank(edges, seeds, ent, rel, 50, ITERATIONS, tolerance=None)))


@q("rt14_merge_relations", f"WITH {HOPS}, r AS (SELECT least(id, via) AS src, greatest(id, via) AS tgt, 0 AS o FROM (SELECT id, via FROM n1 UNION ALL SELECT id, via FROM n2) UNION ALL SELECT src, tgt, 1 FROM ve) SELECT src, tgt, min(o)::INT AS source FROM r GROUP BY ALL")
def rt14(spark, sf):
    hop, edges, *_ = expanded(spark, sf)
    return R.merge_relations(hop.select(F.col("via").alias("src"), F.col("entity_name").alias("tgt")), edges)


@q("rt15_three_perspectives", f"WITH {_THREE}, a AS (SELECT id FROM mh UNION SELECT id FROM pp UNION SELECT id FROM seeds) SELECT src, tgt, x.c + y.c AS rank FROM ve JOIN vd x ON x.id = src JOIN vd y ON y.id = tgt WHERE src IN (SELECT id FROM a) AND tgt IN (SELECT id FROM a)")
def rt15(spark, sf):
    """Seeds with both expansions, and the relations among them."""
    hop, edges, seeds, ent, rel = expanded(spark, sf)
    more = R.query_aware_pagerank(edges, seeds, ent, rel, 50, ITERATIONS, tolerance=None)
    every = seeds.select("entity_name").union(hop.select("entity_name")).union(more.select("entity_name"))
    return G.induced(edges, every).select("src", "tgt", "rank")


_ENDS = f"{PAIRS}, lk AS (SELECT src, tgt FROM ve UNION ALL SELECT tgt, src FROM ve), tp AS (SELECT id, row_number() OVER (ORDER BY c DESC, id) AS r FROM vd), s0 AS (SELECT id AS a FROM tp WHERE r = 1), s1 AS (SELECT id AS b FROM tp WHERE r = 2)"


@q("rt16_paths", f"""WITH {_ENDS}, p1 AS (SELECT [src, tgt] AS path FROM lk, s0 WHERE src = a), p2 AS (SELECT list_append(path, tgt) AS path FROM p1 JOIN lk ON src = path[-1], s1 WHERE path[-1] <> b AND NOT list_contains(path, tgt)),
   p3 AS (SELECT list_append(path, tgt) AS path FROM p2 JOIN lk ON src = path[-1], s1 WHERE path[-1] <> b AND NOT list_contains(path, tgt)) SELECT path, (len(path) - 1)::INT AS hops FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3), s1 WHERE path[-1] = b ORDER BY hops, path LIMIT 10""")
def rt16(spark, sf):
    _, edges = similar_graph(spark, sf)
    a, b = (r[0] for r in G.degrees(edges).orderBy(F.desc("degree"), "entity_name").limit(2).collect())
    return R.simple_paths(edges, a, b, 3, 10)


@q("rt17_subgraph", f"""WITH {PAIRS}, lk AS (SELECT src, tgt FROM ve UNION ALL SELECT tgt, src FROM ve), d0 AS (SELECT min(src) AS id FROM ve), d1 AS (SELECT DISTINCT tgt AS id FROM lk WHERE src IN (SELECT id FROM d0) AND tgt NOT IN (SELECT id FROM d0)),
   d2 AS (SELECT DISTINCT tgt AS id FROM lk WHERE src IN (SELECT id FROM d1) AND tgt NOT IN (SELECT id FROM d0 UNION SELECT id FROM d1)), r AS (SELECT id, 0 AS depth FROM d0 UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2)
   SELECT r.id AS entity_name, depth, c AS degree FROM r JOIN vd ON vd.id = r.id ORDER BY depth, c DESC, r.id LIMIT 30""")
def rt17(spark, sf):
    _, edges = similar_graph(spark, sf)
    nodes, _, _ = R.knowledge_graph(edges, edges.agg(F.min("src")).first()[0], 2, 30)
    return nodes


@q("rt17_top_degree", f"WITH {PAIRS}, n AS (SELECT id, c FROM vd ORDER BY c DESC, id LIMIT 30) SELECT src, tgt, round(weight, 6) AS weight FROM ve WHERE src IN (SELECT id FROM n) AND tgt IN (SELECT id FROM n)")
def rt17b(spark, sf):
    _, edges = similar_graph(spark, sf)
    return R.knowledge_graph(edges, "*", most=30)[1].select("src", "tgt", F.round("weight", 6).alias("weight"))


def items(spark, sf):
    """Entity types ranked by name, with their chunk ids in order."""
    v = table(spark, sf, "vdb_entities").where("source_id IS NOT NULL").select(F.lower("entity_type").alias("t"), F.explode(F.split("source_id", "<SEP>")).alias("c"))
    by = v.where("t IS NOT NULL").groupBy("t").agg(F.array_sort(F.collect_set("c")).alias("chunks"))
    return by.withColumn("item", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("t")) - 1)


ITEMS = """it AS (SELECT t, list_sort(list_distinct(list(c))) AS chunks, row_number() OVER (ORDER BY t) - 1 AS item FROM (SELECT lower(entity_type) AS t, unnest(string_split(source_id, '<SEP>')) AS c FROM vdb_entities WHERE source_id IS NOT NULL AND entity_type IS NOT NULL) GROUP BY t)"""


@q("rt19_weighted_polling", f"""WITH {ITEMS}, k AS (SELECT *, round_even(50.0 - item / ((SELECT count(*) FROM it) - 1) * 30, 0)::INT AS quota FROM it), e AS (SELECT item, quota, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) - 1 AS place FROM k),
   sp AS (SELECT sum(greatest(quota - len(chunks), 0)) AS spare FROM k), f AS (SELECT item, coalesce(sum(greatest(len(chunks) - quota, 0)) OVER (ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM k)
   SELECT chunk, 1 AS pass, item::INT AS item, place::INT AS place FROM e WHERE place < quota UNION ALL SELECT chunk, 2, e.item::INT, place::INT FROM e JOIN f ON f.item = e.item, sp WHERE place >= quota AND off + place - quota < spare""")
def rt19(spark, sf):
    return R.weighted_polling(items(spark, sf), 50, 20)


@q("rt20_by_similarity", f"WITH {Q} SELECT vec_id, round(score, 6) AS score FROM sc ORDER BY score DESC, vec_id LIMIT 25")
def rt20(spark, sf):
    s = V.scored(table(spark, sf, "embeddings"), query_vector(spark, sf), "embedding").select("vec_id", "score")
    return R.by_similarity(s, 25, "vec_id").withColumn("score", F.round("score", 6))


@q("rt21_unified_chunks", """WITH c AS (SELECT unnest(string_split(source_id, '<SEP>')) AS id, vec_id FROM vdb_entities), f AS (SELECT id, count(*) AS occurrences, min(vec_id) AS first FROM c WHERE id <> '' GROUP BY id) SELECT id, occurrences FROM f ORDER BY occurrences DESC, first, id LIMIT 50""")
def rt21(spark, sf):
    c = G.related_chunks(table(spark, sf, "vdb_entities"), "vec_id")
    return c.orderBy(F.desc("occurrences"), F.col("first.o"), "id").limit(50).select("id", "occurrences")


@q("rt22_cap_per_entity", f"WITH {PAIRS}, l AS (SELECT src, tgt, weight FROM ve UNION ALL SELECT tgt, src, weight FROM ve) SELECT src, tgt FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, tgt) AS r FROM l) WHERE r <= 5")
def rt22(spark, sf):
    _, edges = similar_graph(spark, sf)
    return R.cap_per_group(G.both_ways(edges), "src", 5, F.desc("weight"), F.col("tgt")).select("src", "tgt")


@q("rt23_within_budget", f"WITH t AS (SELECT doc_id, source, sum(len({tok('text')})) OVER (PARTITION BY source ORDER BY doc_id) AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, source FROM t WHERE s <= 5000")
def rt23(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "source", X.n_words(F.col("text")).alias("n"))
    return R.within_budget(d, "n", 5000, F.col("doc_id"), group="source").select("doc_id", "source")


@q("rt24_process_chunks", """WITH c AS (SELECT chunk_row, similarity AS score, tokens FROM (SELECT chunk_row, tokens FROM text_chunks WHERE tokens >= 0) JOIN entity_merge_cache ON pair_row = chunk_row), k AS (SELECT * FROM c WHERE coalesce(score, 1.0) >= 0.5 ORDER BY score DESC NULLS LAST, chunk_row LIMIT 20)
   SELECT chunk_row FROM (SELECT *, sum(tokens) OVER (ORDER BY score DESC NULLS LAST, chunk_row) AS s FROM k) WHERE s <= 3000""")
def rt24(spark, sf):
    c = table(spark, sf, "text_chunks").where("tokens >= 0").select(F.col("chunk_row").alias("pos"), "tokens")
    m = table(spark, sf, "entity_merge_cache").select(F.col("pair_row").alias("pos"), F.col("similarity").alias("score"))
    return R.process_chunks(c.join(m, "pos"), 0.5, 20, 3000).select(F.col("pos").alias("chunk_row"))


@q("rt25_rerank", "SELECT doc_id, length(text)::DOUBLE AS score FROM documents WHERE text IS NOT NULL ORDER BY score DESC, doc_id LIMIT 20")
def rt25(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    return R.rerank(d, lambda texts: [float(len(t)) for t in texts], "text").orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", "score")


@q("rt26_recognition", f"WITH {PAIRS}, n AS (SELECT src, tgt, row_number() OVER (ORDER BY src, tgt) - 1 AS pos, weight FROM ve) SELECT src, tgt, pos // 10 AS batch FROM n WHERE weight >= 0.35")
def rt26(spark, sf):
    _, edges = similar_graph(spark, sf)
    rel, _ = R.recognition_filter(numbered(edges, "src", "tgt", out="pos"), F.col("weight") < 0.35)
    return rel.select("src", "tgt", "batch")


@q("rt27_token_allocation", f"WITH u AS (SELECT source, sum(len({tok('text')}))::BIGINT AS used FROM documents WHERE text IS NOT NULL GROUP BY source) SELECT source, greatest(0, 30000 - used - 100)::BIGINT AS budget FROM u")
def rt27(spark, sf):
    u = table(spark, sf, "documents").where("text IS NOT NULL").groupBy("source").agg(F.sum(X.n_words(F.col("text")).cast("bigint")).alias("used"))
    return u.select("source", F.greatest(F.lit(0), F.lit(R.chunk_budget(30000)) - F.col("used")).alias("budget"))


@q("rt28_render_json", f"WITH {LOCAL} SELECT string_agg('{{\"entity_name\":\"' || id || '\",\"rank\":' || rank || '}}', chr(10) ORDER BY -score, vec_id) AS context FROM nd")
def rt28(spark, sf):
    rows, _, _ = local(spark, sf)
    return R.render(rows, ["entity_name", "rank"], -F.col("score"), F.col("vec_id"))


@q("rt31_cache", "SELECT d.doc_id, count(DISTINCT c.id) > 0 AS hit FROM documents d LEFT JOIN text_chunks c ON 'chunk-' || md5(d.text) = c.id WHERE d.text IS NOT NULL GROUP BY d.doc_id")
def rt31(spark, sf):
    requests = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", X.record_id("chunk-", F.col("text")).alias("digest"))
    have, miss = R.cached(requests, table(spark, sf, "text_chunks").select(F.col("id").alias("digest")).distinct())
    return have.select("doc_id", F.lit(True).alias("hit")).union(miss.select("doc_id", F.lit(False)))
