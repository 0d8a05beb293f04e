"""Chunking, extraction and reduce queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.operators import chunking as C
from weftgraph.operators import extraction as E
from weftgraph.operators import reduce as R
from weftgraph.queries.base import Registry, table
from weftgraph.queries.stores import WS, normalize_sql, sanitize_sql, strip_sql

q = Registry()
_TOK = r"[\x{4E00}-\x{9FFF}]|[^\x{4E00}-\x{9FFF}\s\x{0b}]+"


def tok(x: str) -> str:
    return f"regexp_extract_all({x}, '{_TOK}')"


def spans(x: str) -> str:
    """Tokens with the white space behind them."""
    return f"regexp_extract_all({x}, '(?:{_TOK})[\\s\\x{{0b}}]*')"


def stretch(w: str, most: int) -> str:
    """The text from span s on, ``most`` spans long."""
    return f"regexp_replace(array_to_string({w}[s + 1 : s + {most}], ''), '[\\s\\x{{0b}}]+$', '')"


def docs(spark, sf):
    return table(spark, sf, "documents")


@q("ch1_windows", f"""WITH t AS (SELECT doc_id, {spans('text')} AS w FROM documents WHERE text IS NOT NULL),
   s AS (SELECT doc_id, w, unnest(range(0, len(w), 48)) AS s FROM t)
   SELECT doc_id, (s // 48)::INT AS chunk_order_index, least(64, len(w) - s)::INT AS tokens, md5({stretch('w', 64)}) AS digest FROM s""")
def ch1(spark, sf):
    c = C.fixed_windows(docs(spark, sf), "doc_id", "text", 64, 16)
    return c.select("doc_id", "chunk_order_index", "tokens", F.md5("content").alias("digest"))


@q("ch2_split_then_windows", f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
   t AS (SELECT doc_id, i, p, {spans('p')} AS w FROM p),
   c AS (SELECT doc_id, i, 0 AS s, len(w) AS tokens, {strip_sql('p')} AS content FROM t WHERE len(w) <= 64
         UNION ALL SELECT doc_id, i, s, least(64, len(w) - s), {stretch('w', 64)} FROM (SELECT *, unnest(range(0, len(w), 48)) AS s FROM t WHERE len(w) > 64))
   SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, s) - 1)::INT AS chunk_order_index, tokens::INT AS tokens, md5(content) AS digest FROM c""")
def ch2(spark, sf):
    c = C.by_character(docs(spark, sf), "doc_id", "text", "\n", 64, 16)
    return c.select("doc_id", "chunk_order_index", "tokens", F.md5("content").alias("digest"))


@q("ch3_split_only", f"""SELECT doc_id, (i - 1)::INT AS chunk_order_index, len({tok('p')})::INT AS tokens, md5({strip_sql('p')}) AS digest FROM
   (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)""")
def ch3(spark, sf):
    c = C.by_character(docs(spark, sf), "doc_id", "text", "\n", only=True)
    return c.select("doc_id", "chunk_order_index", "tokens", F.md5("content").alias("digest"))


@q("ch4_tables")
def ch4(spark, sf):
    """Whole tables with context before the text between them; tested against literals."""
    return C.with_tables(table(spark, sf, "text_chunks"), "chunk_row", "content", 64, 16)


@q("ch6_materialize", f"""WITH t AS (SELECT doc_id, {spans('text')} AS w FROM documents WHERE text IS NOT NULL),
   s AS (SELECT doc_id, w, unnest(range(0, len(w), 48)) AS s FROM t),
   c AS (SELECT doc_id, (s // 48)::INT AS o, {stretch('w', 64)} AS content FROM s)
   SELECT 'chunk-' || md5(content) AS id, doc_id AS full_doc_id, o AS chunk_order_index FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id DESC, o DESC) AS rn FROM c) WHERE rn = 1""")
def ch6(spark, sf):
    d = docs(spark, sf)
    c = C.fixed_windows(d, "doc_id", "text", 64, 16).withColumn("file_path", F.lit("f"))
    return C.materialize(c, "doc_id", "file_path").select("id", "full_doc_id", "chunk_order_index")


@q("ch8_prechunk", f"""WITH t AS (SELECT doc_id, {tok('text')} AS w FROM documents WHERE text IS NOT NULL)
   SELECT doc_id, (s // 400)::INT AS chunk_order_index, least(500, len(w) - s)::INT AS tokens FROM (SELECT *, unnest(range(0, len(w), 400)) AS s FROM t WHERE len(w) > 1000)""")
def ch8(spark, sf):
    long = docs(spark, sf).where(X.n_words(F.col("text")) > 1000)
    return C.fixed_windows(long, "doc_id", "text", 500, 100).select("doc_id", "chunk_order_index", "tokens")


# --- extraction: the answers stored as chunks ---


def recs(spark, sf):
    c = table(spark, sf, "text_chunks").where("content IS NOT NULL")
    return E.records(c.select("chunk_row", "content", "time_label", "id", "file_path", "full_doc_id")).drop("content")


def split_sql(x: str, pattern: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '{pattern}'), lambda x: {strip_sql('x')}), lambda x: x <> '')"


def _fields_sql() -> str:
    r = strip_sql("regexp_replace(regexp_replace(r, '^[(（]', ''), '[)）]$', '')")
    r = f"regexp_replace({r}, '^(entity|relationship)<\\|([^>]|$)', '\\1<|>\\2')"
    for wrong in ("<||>", "< | >", "<<|>>", "<|>>", "<<|>"):
        r = f"replace({r}, '{wrong}', '<|>')"
    return split_sql(r, "<\\|>")


RECORDS = f"""raw AS (SELECT chunk_row, time_label, id, file_path, full_doc_id, {split_sql("regexp_replace(content, '[）)](\\s*##\\s*)[（(]', ')\\1(', 'g')", "##|<\\|COMPLETE\\|>")} AS rs FROM text_chunks WHERE content IS NOT NULL),
   rec AS (SELECT * EXCLUDE (rs), unnest(rs) AS r, generate_subscripts(rs, 1) - 1 AS ord FROM raw),
   fld AS (SELECT * EXCLUDE (r), {_fields_sql()} AS f FROM rec)"""


@q("ex2_records", f"WITH {RECORDS} SELECT chunk_row, ord::INT AS ord, f AS fields FROM fld")
def ex2(spark, sf):
    return recs(spark, sf).select("chunk_row", "ord", "fields")


def _clean_sql(i: str, inner: bool) -> str:
    return f"(SELECT {normalize_sql('c', inner)} FROM (SELECT {sanitize_sql(i)} AS c))"


TIMED = "CASE WHEN regexp_replace(coalesce(time_label, ''), '^" + WS + "+', '') <> '' AND NOT starts_with(d, time_label) THEN '[Time: ' || time_label || '] ' || d ELSE d END"
ENTITIES = f"""ent AS (SELECT chunk_row, ord, id, file_path, full_doc_id, name AS entity_name, array_to_string(list_transform(regexp_extract_all(t, '\\p{{L}}+|[^\\p{{L}}]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS entity_type, {TIMED} AS description FROM
   (SELECT *, {normalize_sql('a', True)} AS name, {normalize_sql('b', True)} AS t, {normalize_sql('e', False)} AS d FROM
   (SELECT chunk_row, ord, id, file_path, full_doc_id, time_label, {sanitize_sql('f[2]')} AS a, {sanitize_sql('f[3]')} AS b, {sanitize_sql('f[4]')} AS e FROM fld WHERE len(f) >= 4 AND contains(f[1], 'entity')))
   WHERE name <> '' AND t <> '' AND NOT regexp_matches(t, '[''()<>|/\\\\]') AND d <> '')"""
RELATIONS = f"""rel AS (SELECT chunk_row, ord, id, file_path, full_doc_id, src_id, tgt_id, replace(k, '，', ',') AS keywords, {TIMED} AS description, CASE WHEN regexp_full_match(w, '[-+]?[0-9]*\\.?[0-9]+') THEN try_cast(w AS DOUBLE) ELSE 1.0 END AS weight FROM
   (SELECT *, {normalize_sql('a', True)} AS src_id, {normalize_sql('b', True)} AS tgt_id, {normalize_sql('c', True)} AS k, {normalize_sql('e', False)} AS d FROM
   (SELECT chunk_row, ord, id, file_path, full_doc_id, time_label, trim(trim(f[-1], '"'), '''') AS w, {sanitize_sql('f[2]')} AS a, {sanitize_sql('f[3]')} AS b, {sanitize_sql('f[4]')} AS c, {sanitize_sql('f[5]')} AS e
    FROM fld WHERE len(f) >= 5 AND contains(f[1], 'relationship') AND NOT contains(f[1], 'entity')))
   WHERE src_id <> '' AND tgt_id <> '' AND src_id <> tgt_id)"""


@q("ex3_entities", f"WITH {RECORDS}, {ENTITIES} SELECT chunk_row, ord::INT AS ord, entity_name, entity_type, description FROM ent")
def ex3(spark, sf):
    return E.entities(recs(spark, sf), "time_label").select("chunk_row", "ord", "entity_name", "entity_type", "description")


@q("ex4_relations", f"WITH {RECORDS}, {RELATIONS} SELECT chunk_row, ord::INT AS ord, src_id, tgt_id, keywords, description, weight FROM rel")
def ex4(spark, sf):
    return E.relations(recs(spark, sf), "time_label").select("chunk_row", "ord", "src_id", "tgt_id", "keywords", "description", "weight")


@q("ex5_malformed", f"WITH {RECORDS} SELECT chunk_row, ord::INT AS ord FROM fld WHERE len(f) > 1 AND ((contains(f[1], 'entity') AND len(f) < 4) OR (NOT contains(f[1], 'entity') AND contains(f[1], 'relationship') AND len(f) < 5))")
def ex5(spark, sf):
    return E.malformed(recs(spark, sf)).select("chunk_row", "ord")


@q("ex1_extract_and_glean", f"""WITH {RECORDS}, {ENTITIES}, one AS (SELECT DISTINCT chunk_row, entity_name FROM ent WHERE ord % 2 = 0), two AS (SELECT DISTINCT chunk_row, entity_name FROM ent)
   SELECT * FROM two""")
def ex1(spark, sf):
    """Two rounds of a stub model that answers with stored records: the second adds only new names."""
    e = E.entities(recs(spark, sf), "time_label").select("chunk_row", "entity_name", "ord")
    first = e.where("ord % 2 = 0").select("chunk_row", "entity_name").distinct()
    return E.gleaned(first, e.select("chunk_row", "entity_name").distinct(), ["chunk_row", "entity_name"])


@q("ex9_cache_list", """SELECT chunk_row, list_sort(list_distinct(list_concat(coalesce(llm_cache_list, []), ['default:extract:' || md5(content)]))) AS ids FROM text_chunks WHERE content IS NOT NULL""")
def ex9(spark, sf):
    c = table(spark, sf, "text_chunks").where("content IS NOT NULL").select(F.col("chunk_row").alias("id"), "llm_cache_list", "content")
    new = c.select("id", F.concat(F.lit("default:extract:"), F.md5("content")).alias("cache_id"))
    return E.add_cache_ids(c, new).select(F.col("id").alias("chunk_row"), F.array_sort("llm_cache_list").alias("ids"))


# --- reduce ---


def line_mentions(spark, sf):
    """Relation mentions supplier-part, and entity mentions of parts, from the line items."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat(F.lit("S"), "l_suppkey").alias("src_id"), F.concat(F.lit("P"), "l_partkey").alias("tgt_id"), F.lit(1.0).alias("weight"), F.concat("l_returnflag", F.lit(", "), "l_linestatus").alias("keywords"),
        F.concat(F.lit("qty "), F.col("l_quantity").cast("int")).alias("description"), F.concat(F.lit("O"), "l_orderkey").alias("source_id"), F.col("l_linestatus").alias("file_path"),
        F.concat(F.lit("P"), "l_partkey").alias("entity_name"), F.col("l_returnflag").alias("entity_type"), F.array(F.col("l_orderkey"), F.col("l_linenumber").cast("bigint"), F.col("l_partkey"), F.col("l_suppkey")).alias("ord"),
    )


LINES = """m AS (SELECT 'S' || l_suppkey AS src_id, 'P' || l_partkey AS tgt_id, l_returnflag AS f, l_linestatus AS s, 'qty ' || l_quantity::INT AS d, 'O' || l_orderkey AS o, [l_orderkey, l_linenumber, l_partkey, l_suppkey] AS ord FROM lineitem)"""
NODES = f"""{LINES}, ty AS (SELECT tgt_id, f, count(*) AS n, min(ord) AS mo FROM m GROUP BY ALL), kind AS (SELECT tgt_id, f FROM (SELECT *, row_number() OVER (PARTITION BY tgt_id ORDER BY n DESC, mo, f) AS rn FROM ty) WHERE rn = 1),
   de AS (SELECT tgt_id, d, min(ord) AS mo FROM m GROUP BY ALL), des AS (SELECT tgt_id, string_agg(d, '<SEP>' ORDER BY mo, d) AS description FROM de GROUP BY tgt_id),
   pa AS (SELECT tgt_id, s, min(ord) AS mo FROM m GROUP BY ALL), pas AS (SELECT tgt_id, string_agg(s, '<SEP>' ORDER BY mo, s) AS file_path FROM pa GROUP BY tgt_id),
   so AS (SELECT tgt_id, array_to_string(list_sort(list_distinct(list(o))), '<SEP>') AS source_id, count(*) AS mentions FROM m GROUP BY tgt_id),
   nodes AS (SELECT kind.tgt_id AS entity_name, kind.f AS entity_type, source_id, mentions, description, file_path FROM kind JOIN so USING (tgt_id) JOIN des USING (tgt_id) JOIN pas USING (tgt_id))"""
EDGES = f"""{LINES}, ed AS (SELECT least(src_id, tgt_id) AS src, greatest(src_id, tgt_id) AS tgt, * FROM m), dd AS (SELECT src, tgt, d, min(ord) AS mo FROM ed GROUP BY ALL), ds AS (SELECT src, tgt, string_agg(d, '<SEP>' ORDER BY mo, d) AS description FROM dd GROUP BY ALL),
   kw AS (SELECT src, tgt, array_to_string(list_sort(list_distinct(list(f) || list(s))), ',') AS keywords, sum(1.0)::DOUBLE AS weight, array_to_string(list_sort(list_distinct(list(o))), '<SEP>') AS source_id, count(*) AS mentions FROM ed GROUP BY src, tgt),
   edges AS (SELECT src, tgt, weight, source_id, mentions, keywords, description FROM kw JOIN ds USING (src, tgt))"""


def nodes(spark, sf):
    return R.merge_nodes(line_mentions(spark, sf))


def edges(spark, sf):
    return R.merge_edges(line_mentions(spark, sf))


@q("ag1_merge_nodes", f"WITH {NODES} SELECT * FROM nodes")
def ag1(spark, sf):
    return nodes(spark, sf)


@q("ag2_merge_edges", f"WITH {EDGES} SELECT * FROM edges")
def ag2(spark, sf):
    return edges(spark, sf)


@q("ag3_missing_endpoints", f"""WITH {EDGES}, lost AS (SELECT src AS e, src, tgt, description, source_id FROM edges WHERE src LIKE 'S%' UNION ALL SELECT tgt, src, tgt, description, source_id FROM edges WHERE tgt LIKE 'S%')
   SELECT e AS entity_name, 'UNKNOWN' AS entity_type, arg_min(description, [src, tgt]) AS description, arg_min(source_id, [src, tgt]) AS source_id FROM lost GROUP BY e""")
def ag3(spark, sf):
    return R.missing_endpoints(edges(spark, sf), line_mentions(spark, sf).select("entity_name").distinct())


@q("ag4_doc_entities", f"WITH {RECORDS}, {ENTITIES} SELECT full_doc_id, list_sort(list_distinct(list(entity_name))) AS entity_names, count(DISTINCT entity_name)::INT AS count FROM ent GROUP BY full_doc_id")
def ag4a(spark, sf):
    return R.doc_entities(E.entities(recs(spark, sf)), "full_doc_id")


@q("ag4_doc_relations", f"WITH {RECORDS}, {RELATIONS} SELECT full_doc_id, list_sort(list_distinct(list([least(src_id, tgt_id), greatest(src_id, tgt_id)]))) AS relation_pairs, count(DISTINCT [least(src_id, tgt_id), greatest(src_id, tgt_id)])::INT AS count FROM rel GROUP BY full_doc_id")
def ag4b(spark, sf):
    return R.doc_relations(E.relations(recs(spark, sf)), "full_doc_id")


@q("ag4_extracted_nodes", f"""WITH {RECORDS}, {ENTITIES}, ty AS (SELECT entity_name, entity_type, count(*) AS n, min([chunk_row, ord]) AS mo FROM ent GROUP BY ALL)
   SELECT entity_name, arg_min(entity_type, [-n, mo[1], mo[2]]) AS entity_type, sum(n)::BIGINT AS mentions FROM ty GROUP BY entity_name""")
def ag4c(spark, sf):
    e = E.entities(recs(spark, sf), "time_label").withColumn("ord", F.array(F.col("chunk_row"), F.col("ord").cast("bigint"))).withColumnRenamed("id", "source_id")
    return R.merge_nodes(e).select("entity_name", "entity_type", "mentions")


@q("ag5_summary_decision", f"""WITH g AS (SELECT source, count(*) AS fragments, sum(len({tok('text')}))::BIGINT AS tokens FROM documents WHERE text IS NOT NULL GROUP BY source)
   SELECT *, CASE WHEN fragments = 1 THEN 'single' WHEN (tokens <= 12000 OR fragments <= 2) AND fragments < 8 AND tokens < 1200 THEN 'join' WHEN tokens <= 12000 OR fragments <= 2 THEN 'summarize' ELSE 'split' END AS decision FROM g""")
def ag5(spark, sf):
    return R.summary_decision(docs(spark, sf).where("text IS NOT NULL"), "source", "text")


@q("ag5_pack_fragments")
def ag5b(spark, sf):
    return R.pack_fragments(docs(spark, sf).where("text IS NOT NULL"), "source", "doc_id", "text")


@q("ag7_node_degree", f"WITH {LINES}, e AS (SELECT DISTINCT src_id, tgt_id FROM m), n AS (SELECT src_id AS id FROM e UNION ALL SELECT tgt_id FROM e), a AS (SELECT 'P' || p_partkey AS id FROM part UNION SELECT 'S' || s_suppkey FROM supplier) SELECT a.id AS entity_name, count(n.id) AS degree FROM a LEFT JOIN n USING (id) GROUP BY a.id")
def ag7(spark, sf):
    from weftgraph.operators import graph as G

    names = table(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("entity_name")).union(table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey")))
    return G.node_degree(light_edges(spark, sf), names)


def light_edges(spark, sf):
    """Distinct unordered supplier-part pairs with summed weights."""
    li = table(spark, sf, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("tgt"))
    return li.groupBy("src", "tgt").agg(F.count(F.lit(1)).cast("double").alias("weight"))


@q("ag8_edge_degree", f"WITH {LINES}, e AS (SELECT DISTINCT src_id, tgt_id FROM m), n AS (SELECT id, count(*) AS c FROM (SELECT src_id AS id FROM e UNION ALL SELECT tgt_id FROM e) GROUP BY id) SELECT e.tgt_id AS src, e.src_id AS tgt, x.c + y.c AS degree FROM e JOIN n x ON x.id = e.src_id JOIN n y ON y.id = e.tgt_id")
def ag8(spark, sf):
    from weftgraph.operators import graph as G

    return G.edge_degree(light_edges(spark, sf)).select("src", "tgt", "degree")


@q("ag9_occurrences", "SELECT id, count(*) AS occurrences, min(chunk_row) AS chunk_row FROM text_chunks GROUP BY id")
def ag9(spark, sf):
    return C.occurrences(table(spark, sf, "text_chunks").select("id", "chunk_row"), "id", F.col("chunk_row"))


@q("ag11_backfill", """SELECT c.full_doc_id, list_sort(list_distinct(list(e.entity_name))) AS entity_names FROM (SELECT entity_name, unnest(string_split(source_id, '<SEP>')) AS chunk FROM vdb_entities WHERE entity_name IS NOT NULL) e
   JOIN (SELECT DISTINCT id, full_doc_id FROM text_chunks WHERE full_doc_id IS NOT NULL) c ON c.id = e.chunk GROUP BY c.full_doc_id""")
def ag11(spark, sf):
    e = table(spark, sf, "vdb_entities").where("entity_name IS NOT NULL").select("entity_name", F.explode(F.split("source_id", "<SEP>")).alias("id"))
    c = table(spark, sf, "text_chunks").where("full_doc_id IS NOT NULL").select("id", "full_doc_id").distinct()
    return R.doc_entities(e.join(c, "id"), "full_doc_id").select("full_doc_id", "entity_names")


@q("ag12_token_usage", "SELECT event_type, count(*) AS calls, sum(user_id)::BIGINT AS prompt_tokens, sum(event_id)::BIGINT AS completion_tokens FROM events GROUP BY event_type")
def ag12(spark, sf):
    calls = table(spark, sf, "events").select("event_type", F.col("user_id").alias("prompt_tokens"), F.col("event_id").alias("completion_tokens"))
    return R.token_usage(calls, "event_type")
