"""Key-value, status, source and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.operators import stores as S
from weftgraph.queries.base import Registry, table
from weftgraph.sources.files import literal_texts

q = Registry()
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def store(spark, sf):
    """The chunk store: the last write of each id."""
    rows = table(spark, sf, "text_chunks")
    return S.latest(rows, "id", F.col("update_time").desc_nulls_last(), F.col("chunk_row").desc())


STORE = """store AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY update_time DESC NULLS LAST, chunk_row DESC) AS rn FROM text_chunks) WHERE rn = 1)"""


@q("kv1_get_by_id", f"WITH {STORE}, one AS (SELECT min(id) AS id FROM store) SELECT store.id, chunk_row, tokens FROM store JOIN one ON store.id = one.id")
def kv1(spark, sf):
    s = store(spark, sf)
    return S.get_by_id(s, s.agg(F.min("id")).first()[0]).select("id", "chunk_row", "tokens")


@q("kv2_get_by_ids", f"WITH {STORE}, ids AS (SELECT doc_id AS pos, 'chunk-' || md5(text) AS id FROM documents WHERE text IS NOT NULL UNION ALL SELECT chunk_row + 1000000, id FROM text_chunks) SELECT pos, ids.id, s.chunk_row FROM ids LEFT JOIN store s ON s.id = ids.id")
def kv2(spark, sf):
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("pos"), X.record_id("chunk-", F.col("text")).alias("id"))
    ids = docs.union(table(spark, sf, "text_chunks").select(F.col("chunk_row") + 1000000, "id"))
    return S.get_by_ids(store(spark, sf), ids).select("pos", "id", "chunk_row")


@q("kv3_filter_keys", "SELECT DISTINCT 'chunk-' || md5(text) AS id FROM documents WHERE text IS NOT NULL AND 'chunk-' || md5(text) NOT IN (SELECT id FROM text_chunks WHERE id IS NOT NULL)")
def kv3(spark, sf):
    keys = table(spark, sf, "documents").where("text IS NOT NULL").select(X.record_id("chunk-", F.col("text")).alias("id"))
    return S.missing_keys(keys, table(spark, sf, "text_chunks").select("id"))


@q("kv4_get_all", "SELECT chunk_row, id, tokens, chunk_order_index, full_doc_id, coalesce(create_time, 0) AS create_time, coalesce(update_time, 0) AS update_time FROM text_chunks")
def kv4(spark, sf):
    return S.get_all(table(spark, sf, "text_chunks")).select("chunk_row", "id", "tokens", "chunk_order_index", "full_doc_id", "create_time", "update_time")


@q("kv5_upsert", f"WITH {STORE} SELECT id, chunk_row, update_time FROM store")
def kv5(spark, sf):
    """Replaying the log as a first load and a later batch gives the latest rows."""
    rows = table(spark, sf, "text_chunks").select("id", "chunk_row", "update_time")
    order = (F.col("update_time").desc_nulls_last(), F.col("chunk_row").desc())
    ranked = S.latest(rows, "id", *order)
    first = S.latest(rows, "id", F.col("update_time").asc_nulls_first(), F.col("chunk_row"))
    return S.upsert(first, ranked)


@q("kv6_delete", f"WITH {STORE} SELECT id, chunk_row FROM store WHERE id NOT IN (SELECT id FROM text_chunks WHERE full_doc_id IS NULL AND id IS NOT NULL)")
def kv6(spark, sf):
    rows = table(spark, sf, "text_chunks")
    return S.delete(store(spark, sf), rows.where("full_doc_id IS NULL").select("id").distinct()).select("id", "chunk_row")


@q("st1_status_counts", "SELECT status, count(*) AS n FROM doc_status GROUP BY status")
def st1(spark, sf):
    return S.status_counts(table(spark, sf, "doc_status"))


@q("st2_all_status_counts", "SELECT CASE WHEN grouping(status) = 1 THEN 'all' ELSE status END AS status, count(*) AS n FROM doc_status GROUP BY ROLLUP (status)")
def st2(spark, sf):
    return S.all_status_counts(table(spark, sf, "doc_status"))


@q("st3_docs_by_status", "SELECT id, file_path, content_length FROM doc_status WHERE status = 'failed'")
def st3(spark, sf):
    return S.by_value(table(spark, sf, "doc_status"), "status", "failed").select("id", "file_path", "content_length")


@q("st4_docs_by_track", "SELECT d.id, d.status, d.track_id FROM doc_status d WHERE track_id = (SELECT min(track_id) FROM doc_status)")
def st4(spark, sf):
    d = table(spark, sf, "doc_status")
    return S.by_value(d, "track_id", d.agg(F.min("track_id")).first()[0]).select("id", "status", "track_id")


@q("st5_page", """SELECT id, status, file_path, (SELECT count(*) FROM doc_status WHERE status = 'processed') AS total_count FROM doc_status
   WHERE status = 'processed' ORDER BY updated_at DESC NULLS LAST, id, created_at LIMIT 20 OFFSET 20""")
def st5(spark, sf):
    return S.page(table(spark, sf, "doc_status"), "processed", 2, 20).select("id", "status", "file_path", "total_count")


@q("st6_docs_by_ids", "SELECT DISTINCT d.id, d.status FROM doc_status d WHERE d.id IN (SELECT full_doc_id FROM text_chunks)")
def st6(spark, sf):
    asked = table(spark, sf, "text_chunks").select(F.col("full_doc_id").alias("id"))
    return S.by_ids(table(spark, sf, "doc_status"), asked).select("id", "status").distinct()


@q("st7_path_sort_key", "SELECT id, lower(file_path) AS sort_key FROM doc_status")
def st7(spark, sf):
    return table(spark, sf, "doc_status").select("id", F.lower("file_path").alias("sort_key"))


def sanitize_sql(x: str) -> str:
    inner = f"regexp_replace({strip_sql(x)}, '[\\x{{FFFE}}\\x{{FFFF}}]|[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')"
    for e, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        inner = f"replace({inner}, '{e}', '{c}')"
    return strip_sql(f"regexp_replace({inner}, '[\\x00-\\x1f\\x7f-\\x{{9f}}]', '', 'g')")


CLEAN = f"clean AS (SELECT doc_id, {sanitize_sql('text')} AS content, file_path, ingested_at FROM documents WHERE text IS NOT NULL)"


def inbox(spark, sf):
    d = table(spark, sf, "documents")
    return d.where("text IS NOT NULL").select(F.col("doc_id").alias("ord"), F.col("text").alias("content"), "file_path", F.col("ingested_at").alias("created_at"))


@q("src1_enqueue", f"""WITH {CLEAN}, first AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id) AS rn FROM clean WHERE content <> '')
   SELECT 'doc-' || md5(content) AS id, md5(content) AS digest, 'pending' AS status, CASE WHEN length(content) > 250 THEN substr(content, 1, 250) || '...' ELSE content END AS content_summary,
   length(content)::INT AS content_length, coalesce(file_path, 'unknown_source') AS file_path FROM first
   WHERE rn = 1 AND 'doc-' || md5(content) NOT IN (SELECT id FROM doc_status WHERE id IS NOT NULL)""")
def src1(spark, sf):
    full, status = S.enqueue(inbox(spark, sf), table(spark, sf, "doc_status"), "t1")
    return full.join(status, "id").select("id", F.md5("content").alias("digest"), "status", "content_summary", "content_length", "file_path")


@q("src2_error_documents", "SELECT 'error-' || md5(file_path || '-' || error_msg) AS id, error_msg AS content_summary, 'failed' AS status, file_path, error_msg FROM doc_status WHERE error_msg IS NOT NULL AND file_path IS NOT NULL")
def src2(spark, sf):
    bad = table(spark, sf, "doc_status").where("error_msg IS NOT NULL AND file_path IS NOT NULL").select("file_path", F.col("error_msg").alias("description"), "created_at")
    return S.error_documents(bad, "t").select("id", "content_summary", "status", "file_path", "error_msg")


@q("src4_literal_texts", "SELECT 'text_' || (doc_id - 1) || '_' || substr(md5(text), 1, 16) AS id, doc_id FROM documents WHERE trim(text) <> ''")
def src4(spark, sf):
    d = table(spark, sf, "documents")
    return literal_texts(d.withColumn("ord", F.col("doc_id") - 1)).select("id", (F.col("ord") + 1).alias("doc_id"))


@q("src5_regroup_chunks", f"""WITH {STORE} SELECT full_doc_id, count(*) AS n_chunks, md5(string_agg(content, chr(10) || chr(10) ORDER BY chunk_order_index NULLS FIRST, id)) AS digest
   FROM store WHERE content IS NOT NULL GROUP BY full_doc_id""")
def src5(spark, sf):
    docs = S.regroup_chunks(store(spark, sf).where("content IS NOT NULL"))
    return docs.select("full_doc_id", "n_chunks", F.md5("content").alias("digest"))


@q("jn12_consistency", """SELECT d.id, d.status, CASE WHEN c.id IS NULL AND d.status <> 'failed' THEN 'delete' WHEN c.id IS NULL THEN 'keep' WHEN d.status IN ('processing', 'failed') THEN 'retry' ELSE 'none' END AS action
   FROM doc_status d LEFT JOIN (SELECT DISTINCT full_doc_id AS id FROM text_chunks) c ON c.id = d.id WHERE d.status <> 'processed'""")
def jn12(spark, sf):
    return S.consistency(table(spark, sf, "doc_status"), table(spark, sf, "text_chunks").select(F.col("full_doc_id").alias("id")).distinct())


# --- text functions over whole tables ---


@q("tx1_sanitize", f"WITH {CLEAN} SELECT doc_id, md5(content) AS digest, length(content) AS n FROM clean")
def tx1(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL").withColumn("c", X.sanitize(F.col("text")))
    return d.select("doc_id", F.md5("c").alias("digest"), F.length("c").cast("bigint").alias("n"))


def normalize_sql(x: str, inner: bool) -> str:
    x = f"regexp_replace({x}, '</p\\s*>|<p\\s*>|<p/>|</br\\s*>|<br\\s*>|<br/>', '', 'gi')"
    x = f"translate({x}, '{X.FULL_WIDTH}', '{X.HALF_WIDTH}')"
    cjk, mark = r"[\x{4e00}-\x{9fa5}]", r"[a-zA-Z0-9()\[\]@#$%!&*\-=+_]"
    for a, b in ((cjk, cjk), (cjk, mark), (mark, cjk)):
        for _ in range(2):  # neighbouring matches share a character
            x = f"regexp_replace({x}, '({a}){WS}+({b})', '\\1\\2', 'g')"
    for left, right in (('"', '"'), ("''", "''"), ("“", "”"), ("‘", "’")):
        x = f"regexp_replace({x}, '^{left}([^{left}{right}]*){right}$', '\\1')"
    if inner:
        x = f"""regexp_replace({x}, '[“”‘’]', '', 'g')"""
        x = f"""regexp_replace(regexp_replace({x}, '[''"]+({cjk})', '\\1', 'g'), '({cjk})[''"]+', '\\1', 'g')"""
        x = f"""regexp_replace(replace({x}, ' ', ' '), '([^0-9]) ', '\\1 ', 'g')"""
    x = strip_sql(x)
    return f"CASE WHEN regexp_full_match({x}, '[0-9]{{1,2}}') OR (regexp_full_match({x}, '[0-9.]{{1,5}}') AND {x} LIKE '%.%') THEN '' ELSE {x} END"


@q("tx2_normalize", f"SELECT vec_id, {normalize_sql('entity_name', True)} AS name FROM vdb_entities WHERE entity_name IS NOT NULL")
def tx2(spark, sf):
    return table(spark, sf, "vdb_entities").where("entity_name IS NOT NULL").select("vec_id", X.normalize(F.col("entity_name"), True).alias("name"))


@q("tx3_clean", f"SELECT vec_id, {normalize_sql('c', False)} AS content FROM (SELECT vec_id, {sanitize_sql('content')} AS c FROM vdb_entities WHERE content IS NOT NULL)")
def tx3(spark, sf):
    return table(spark, sf, "vdb_entities").where("content IS NOT NULL").select("vec_id", X.clean(F.col("content")).alias("content"))


@q("tx4_split_markers", f"""SELECT vec_id, list_filter(list_transform(regexp_split_to_array(source_id, '<SEP>|##'), lambda x: {strip_sql('x')}), lambda x: x <> '') AS parts FROM vdb_entities WHERE source_id IS NOT NULL
   UNION ALL SELECT vec_id, [''] FROM vdb_entities WHERE source_id IS NULL""")
def tx4(spark, sf):
    return table(spark, sf, "vdb_entities").select("vec_id", X.split_markers(F.col("source_id"), ["<SEP>", "##"]).alias("parts"))


@q("tx5_is_float", r"SELECT word, regexp_full_match(word, '[-+]?[0-9]*\.?[0-9]+') AS is_float FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '[\s\x{0b}]+')) AS word FROM documents)")
def tx5(spark, sf):
    w = table(spark, sf, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).distinct()
    return w.select("word", X.is_float(F.col("word")).alias("is_float"))


@q("tx6_summary", f"SELECT doc_id, CASE WHEN length(t) > 250 THEN substr(t, 1, 250) || '...' ELSE t END AS summary FROM (SELECT doc_id, {strip_sql('text')} AS t FROM documents)")
def tx6(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.summary(F.col("text")).alias("summary"))


@q("tx7_think_tags", f"""SELECT doc_id, md5({strip_sql("regexp_replace('<think>' || lang || '</think>' || text, '^(<think>.*?</think>|.*</think>)', '', 's')")}) AS digest FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL""")
def tx7(spark, sf):
    d = table(spark, sf, "documents").where("lang IS NOT NULL AND text IS NOT NULL")
    return d.select("doc_id", F.md5(X.without_thinking(F.concat(F.lit("<think>"), "lang", F.lit("</think>"), "text"))).alias("digest"))


@q("tx8_tables", """SELECT chunk_row, len(t)::INT AS n_tables, md5(array_to_string(t, '|')) AS digest FROM (SELECT chunk_row, regexp_extract_all(content, '(?is)<table[^>]*>.*?</table>') AS t FROM text_chunks WHERE content IS NOT NULL)""")
def tx8(spark, sf):
    t = table(spark, sf, "text_chunks").where("content IS NOT NULL").select("chunk_row", X.tables(F.col("content")).alias("t"))
    return t.select("chunk_row", F.size("t").alias("n_tables"), F.md5(F.array_join("t", "|")).alias("digest"))


@q("tx9_decode_unicode", "SELECT vec_id, entity_name AS name FROM vdb_entities")
def tx9(spark, sf):
    escaped = F.regexp_replace(F.col("entity_name"), "a", r"\\u0061")
    return table(spark, sf, "vdb_entities").select("vec_id", X.decode_unicode(escaped).alias("name"))


@q("tx10_time_prefix", f"SELECT chunk_row, md5(CASE WHEN {strip_sql('time_label')} <> '' AND NOT starts_with(content, time_label) THEN '[Time: ' || time_label || '] ' || content ELSE content END) AS digest FROM text_chunks")
def tx10(spark, sf):
    return table(spark, sf, "text_chunks").select("chunk_row", F.md5(X.with_time(F.col("content"), F.col("time_label"))).alias("digest"))


@q("tx11_entity_type", r"""SELECT DISTINCT entity_type, array_to_string(list_transform(regexp_extract_all(entity_type, '\p{L}+|[^\p{L}]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS title, length(entity_type) > 0 AND NOT regexp_matches(entity_type, '[''()<>|/\\]') AS valid
   FROM (SELECT entity_type FROM vdb_entities UNION ALL SELECT time_label FROM text_chunks UNION ALL SELECT file_path FROM text_chunks) WHERE entity_type IS NOT NULL""")
def tx11(spark, sf):
    chunks = table(spark, sf, "text_chunks")
    t = table(spark, sf, "vdb_entities").select("entity_type").union(chunks.select("time_label")).union(chunks.select("file_path")).where("entity_type IS NOT NULL").distinct()
    return t.select("entity_type", X.title_case(F.col("entity_type")).alias("title"), X.valid_type(F.col("entity_type")).alias("valid"))


@q("tx14_extract_json", "SELECT event_id, regexp_extract('answer: ' || props || ' end', '(?s)\\{.*\\}') AS found FROM events WHERE props LIKE '%{%'")
def tx14(spark, sf):
    e = table(spark, sf, "events").where("props LIKE '%{%'")
    return e.select("event_id", X.first_json(F.concat(F.lit("answer: "), "props", F.lit(" end"))).alias("found"))


@q("tx15_keyword_json", "SELECT doc_id, [source] AS high, [lang, source] AS low FROM documents")
def tx15(spark, sf):
    d = table(spark, sf, "documents")
    answer = F.concat(F.lit("ok "), F.to_json(F.struct(F.array("source").alias("high_level_keywords"), F.array("lang", "source").alias("low_level_keywords"))), F.lit(" done"))
    k = d.withColumn("k", X.keywords(answer))
    return k.select("doc_id", F.col("k.high_level_keywords").alias("high"), F.col("k.low_level_keywords").alias("low"))


@q("tx16_file_paths", """WITH p AS (SELECT full_doc_id, file_path, min(chunk_row) AS o FROM text_chunks WHERE coalesce(file_path, '') <> '' GROUP BY ALL)
   SELECT full_doc_id, string_agg(file_path, '<SEP>' ORDER BY o) AS paths FROM p GROUP BY full_doc_id""")
def tx16(spark, sf):
    p = table(spark, sf, "text_chunks").where("coalesce(file_path, '') <> ''").groupBy("full_doc_id", "file_path").agg(F.min("chunk_row").alias("o"))
    by = p.groupBy("full_doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "file_path"))), lambda x: x["file_path"]).alias("new"))
    return by.select("full_doc_id", X.joined_paths(F.array().cast("array<string>"), F.col("new")).alias("paths"))


@q("tx17_cache_keys", "SELECT chunk_row, 'default:extract:' || md5(content) AS key, 'default' AS mode, 'extract' AS cache_type, md5(content) AS digest FROM text_chunks WHERE content IS NOT NULL")
def tx17(spark, sf):
    c = table(spark, sf, "text_chunks").where("content IS NOT NULL").select("chunk_row", X.cache_key(F.lit("default"), F.lit("extract"), F.md5("content")).alias("key"))
    return c.select("chunk_row", "key", X.parse_cache_key(F.col("key")).alias("p")).select("chunk_row", "key", "p.*")


@q("tx18_tokens", r"SELECT doc_id, len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}]|[^\x{4E00}-\x{9FFF}\s\x{0b}]+'))::INT AS n_tokens FROM documents WHERE text IS NOT NULL")
def tx18(spark, sf):
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", X.n_words(F.col("text")).alias("n_tokens"))
