"""Registered queries of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import abuse, bpe, components, names, neardup, packing, splitting, vectors


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    best = vectors.similar_pairs(table(spark, sf, "vdb_entities"), "vec_id", "vector", threshold=0.85, k=10, recall=0.995)
    return best.select(F.least("id", "other").alias("vec_id_a"), F.greatest("id", "other").alias("vec_id_b")).distinct()


def p1_top10(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 most similar rows of every row whose id is divisible by 100, with names."""
    rows = table(spark, sf, "vdb_entities")
    best = vectors.nearest(rows, "vec_id", "vector", F.col("id") % 100 == 0)
    names = rows.select(F.col("vec_id").alias("other"), "entity_name")
    return best.join(names, "other").select(F.col("id").alias("query_id"), F.col("other").alias("vec_id"), "entity_name", F.round("cos", 6).alias("cosine"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    members, _ = names.same_entities(table(spark, sf, "vdb_entities"), table(spark, sf, "name_aliases"))
    return names.found_pairs(members).toDF("vec_id_a", "vec_id_b")


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row a spelling's row with its class, the class's rows and distinct names."""
    members, _ = names.same_entities(table(spark, sf, "vdb_entities"), table(spark, sf, "name_aliases"))
    return names.classes(members).withColumnRenamed("row", "vec_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs, members = neardup.near_pairs(table(spark, sf, "text_chunks"), "chunk_row", "content", threshold=0.5, size=3)
    return neardup.all_record_pairs(pairs, members).toDF("chunk_row_a", "chunk_row_b")


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row a record with its class of copies and that class's number of links, at five words and 0.8."""
    pairs, members = neardup.near_pairs(table(spark, sf, "text_chunks"), "chunk_row", "content")
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    out = members.join(links, "rep", "left")
    return out.select(F.col("id").alias("chunk_row"), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    pieces = splitting.split_long(table(spark, sf, "text_chunks"))
    return pieces.where("chunk_order_index = 1").select("chunk_row")  # a second piece: it was cut


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_long(table(spark, sf, "text_chunks"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = components.merged_pairs(table(spark, sf, "entity_merge_cache"))
    return components.groups(pairs).select(F.col("id").alias("entity_id"), "group_id")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(table(spark, sf, "documents"))


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(bpe.count_tokens(table(spark, sf, "documents"))).withColumnRenamed("size", "n_tokens")


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers are: their number, the least possible number and the unused share."""
    return packing.fill(packing.pack(bpe.count_tokens(table(spark, sf, "documents"))))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    scores = abuse.score(table(spark, sf, "documents"), table(spark, sf, "abuse_examples"))
    return scores.where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return abuse.rates(docs, abuse.score(docs, table(spark, sf, "abuse_examples")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


_TOKENS = r"""len(regexp_extract_all(content, '[\x{4E00}-\x{9FFF}]|[^\x{4E00}-\x{9FFF} \t\r\n]+'))"""


def _shingle_sql(size: int) -> str:
    joined = " || ' ' || ".join(f"w[i + {k}]" for k in range(size))
    return rf"""
        w AS (SELECT chunk_row, regexp_extract_all(lower(content), '[\x{{4E00}}-\x{{9FFF}}]|[a-z0-9\x{{00C0}}-\x{{024F}}]+') AS w
              FROM text_chunks WHERE content IS NOT NULL),
        s AS (SELECT DISTINCT chunk_row, unnest(list_transform(range(1, len(w) - {size - 2}), lambda i: {joined})) AS g FROM w WHERE len(w) >= {size}),
        n AS (SELECT chunk_row, count(*) AS n FROM s GROUP BY chunk_row),
        c AS (SELECT x.chunk_row AS a, y.chunk_row AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.chunk_row < y.chunk_row GROUP BY ALL)"""


_SQL = {
    "p1_found": """WITH u AS (SELECT vec_id, list_transform(vector, lambda x: x::DOUBLE) AS v FROM vdb_entities
          WHERE len(vector) = 64 AND NOT list_bool_or(list_transform(vector, lambda x: isnan(x) OR isinf(x)))),
        w AS (SELECT vec_id, v FROM u WHERE list_dot_product(v, v) > 0),
        p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.v, y.v) AS c FROM w x JOIN w y ON x.vec_id < y.vec_id),
        l AS (SELECT a, b, c FROM p WHERE c >= 0.85 UNION ALL SELECT b, a, c FROM p WHERE c >= 0.85),
        r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM l)
        SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM r WHERE k <= 10""",
    "p3_found": f"""WITH {_shingle_sql(3)}
        SELECT c.a AS chunk_row_a, c.b AS chunk_row_b FROM c JOIN n na ON na.chunk_row = c.a JOIN n nb ON nb.chunk_row = c.b
        WHERE 2 * c.k >= na.n + nb.n - c.k""",
    "p4_found": f"SELECT chunk_row FROM text_chunks WHERE {_TOKENS} > 600",
    "p5_found": """
        WITH RECURSIVE e AS (
            SELECT entity_a_id AS a, entity_b_id AS b FROM entity_merge_cache
            WHERE lower(trim(decision)) = 'merged' AND entity_a_id <> entity_b_id),
        l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r AS (SELECT a AS id, a AS other FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a)
        SELECT id AS entity_id, min(other) AS group_id FROM r GROUP BY id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
