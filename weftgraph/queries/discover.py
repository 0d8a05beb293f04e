"""Model-dependent operators with deterministic stubs."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.operators import chunking as C
from weftgraph.operators import discovery as D
from weftgraph.plans import Scratch
from weftgraph.queries.base import Registry, table
from weftgraph.queries.stores import strip_sql
from weftgraph.sources.files import text_folder

q = Registry()


@q("ch7_pluggable_chunking", "SELECT doc_id, (i - 1)::INT AS chunk_order_index, md5(p) AS digest FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS p, generate_subscripts(string_split(text, '. '), 1) AS i FROM documents WHERE text IS NOT NULL AND text <> '')")
def ch7(spark, sf):
    c = C.chunked(table(spark, sf, "documents"), "doc_id", "text", lambda t: t.split(". "))
    return c.select("doc_id", "chunk_order_index", F.md5("content").alias("digest"))


@q("ex6_orphan_descriptions", f"SELECT vec_id, CASE WHEN entity_type = 'person' THEN 'Person' ELSE 'Other' END AS entity_type, {strip_sql("'about ' || entity_name")} AS description FROM vdb_entities WHERE entity_name IS NOT NULL")
def ex6(spark, sf):
    v = table(spark, sf, "vdb_entities").where("entity_name IS NOT NULL")
    asked = v.select("vec_id", F.concat(F.lit("("), F.when(F.col("entity_type") == "person", "PERSON").otherwise("thing"), F.lit(")<SEP>(about "), "entity_name", F.lit(")")).alias("entity_name"))
    return D.describe_orphans(asked, ["Person", "Organization"], lambda prompts: prompts).select("vec_id", "entity_type", "description")


@q("ex7_query_keywords", "SELECT doc_id, [source] AS high, CASE WHEN lang IS NULL THEN ['x'] ELSE [lang] END AS low FROM documents")
def ex7(spark, sf):
    answer = F.to_json(F.struct(F.array("source").alias("high_level_keywords"), F.array(F.lit("x")).alias("low_level_keywords")))
    d = table(spark, sf, "documents").select("doc_id", answer.alias("query"), F.lit(None).cast("array<string>").alias("hl"), F.when(F.col("lang").isNotNull(), F.array("lang")).alias("ll"))
    return D.query_keywords(d, lambda queries: queries).select("doc_id", "high", "low")


@q("ex8_discover_types", "SELECT lower(trim(entity_type)) AS entity_type, count(*) AS chunks FROM vdb_entities WHERE trim(entity_type) <> '' GROUP BY 1")
def ex8(spark, sf):
    types = table(spark, sf, "vdb_entities").select(F.coalesce("entity_type", F.lit("")).alias("content"))
    return D.discover_types(types, lambda texts: [t + "\n " + t.upper() for t in texts])


@q("ag6_summarize_all")
def ag6b(spark, sf):
    """Every source: also those packed in groups and told in rounds; the stub answers with the digest of what it reads."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("source", "doc_id", "text")
    s = D.summarize(d, "source", "doc_id", "text", digests)
    return s.select("source", F.md5("summary").alias("digest"))


def digests(parts):
    import hashlib

    return [hashlib.md5(p.encode("utf-8", "surrogatepass")).hexdigest() for p in parts]


@q("src3_text_folder", "SELECT md5(n_name || chr(10)) AS digest, 'doc-' || md5(n_name || chr(10)) AS id FROM nation WHERE n_regionkey <> 1")
def src3(spark, sf):
    """Every nation's name in a text file of its own, read back but for those that are processed."""
    root = Scratch(spark, "folder").root
    n = table(spark, sf, "nation")
    n.select(F.col("n_name").alias("value"), F.col("n_nationkey").alias("k")).repartition(25, "k").write.partitionBy("k").text(root)
    found = text_folder(spark, f"{root}/*")
    blank = n.where("n_regionkey = 1").select(X.record_id("doc-", F.concat("n_name", F.lit("\n"))).alias("id"))
    return found.join(blank, "id", "left_anti").select(F.md5("content").alias("digest"), "id")
