"""The ingest reduce: mentions to nodes, edges and per-document indexes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text as X

UNKNOWN = "UNKNOWN"


def _in_order(df: DataFrame, keys: list[str], value: str, order: str, out: str) -> DataFrame:
    """Distinct values of a group by first appearance."""
    first = df.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).agg(F.min(order).alias("_o"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda x: x[value]).alias(out))


def merge_nodes(mentions: DataFrame, order: str = "ord") -> DataFrame:
    """One node a name from ``entity_name, entity_type, description, source_id, file_path``.

    The commonest type wins, the first seen on a tie; descriptions and paths
    are distinct in order, sources distinct and sorted.
    """
    key = ["entity_name"]
    types = mentions.groupBy("entity_name", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"))
    kind = types.groupBy("entity_name").agg(F.min_by("entity_type", F.struct(-F.col("n"), F.col("o"), F.col("entity_type"))).alias("entity_type"))
    text = _in_order(mentions, key, "description", order, "d").select("entity_name", F.array_join("d", X.SEP).alias("description"))
    paths = _in_order(mentions, key, "file_path", order, "p").select("entity_name", X.joined_paths(F.array().cast("array<string>"), F.col("p")).alias("file_path"))
    sources = mentions.groupBy("entity_name").agg(F.array_join(F.array_sort(F.collect_set("source_id")), X.SEP).alias("source_id"), F.count(F.lit(1)).alias("mentions"))
    return kind.join(sources, key).join(text, key, "left").join(paths, key, "left")


def merge_edges(mentions: DataFrame, order: str = "ord") -> DataFrame:
    """One edge an unordered pair: weights summed, keywords distinct and sorted."""
    m = mentions.withColumn("src", F.least("src_id", "tgt_id")).withColumn("tgt", F.greatest("src_id", "tgt_id"))
    key = ["src", "tgt"]
    sums = m.groupBy(*key).agg(F.sum("weight").alias("weight"), F.array_join(F.array_sort(F.collect_set("source_id")), X.SEP).alias("source_id"), F.count(F.lit(1)).alias("mentions"))
    terms = m.select(*key, F.explode(F.split("keywords", ",")).alias("k")).select(*key, F.trim("k").alias("k")).where("k <> ''")
    words = terms.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("keywords"))
    text = _in_order(m, key, "description", order, "d").select(*key, F.array_join("d", X.SEP).alias("description"))
    return sums.join(words, key, "left").join(text, key, "left")


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of unknown type for endpoints without a node, described by their first edge."""
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("entity_name"), "src", "tgt", "description", "source_id")
    lost = ends.join(nodes.select("entity_name"), "entity_name", "left_anti")
    first = F.struct("src", "tgt")
    return lost.groupBy("entity_name").agg(F.min_by("description", first).alias("description"), F.min_by("source_id", first).alias("source_id")).withColumn("entity_type", F.lit(UNKNOWN))


def doc_entities(mentions: DataFrame, doc: str) -> DataFrame:
    """Names of each document, sorted, with their count."""
    return mentions.groupBy(doc).agg(F.array_sort(F.collect_set("entity_name")).alias("entity_names")).withColumn("count", F.size("entity_names"))


def doc_relations(mentions: DataFrame, doc: str) -> DataFrame:
    """Unordered pairs of each document, sorted, with their count."""
    pair = F.array(F.least("src_id", "tgt_id"), F.greatest("src_id", "tgt_id"))
    return mentions.groupBy(doc).agg(F.array_sort(F.collect_set(pair)).alias("relation_pairs")).withColumn("count", F.size("relation_pairs"))


# Bounds of the summary decision.
CONTEXT_TOKENS, SUMMARY_TOKENS, FORCE_FRAGMENTS = 12_000, 1200, 8


def summary_decision(fragments: DataFrame, key: str, text: str, most: int = CONTEXT_TOKENS) -> DataFrame:
    """What becomes of a name's descriptions: none, single, join, summarize or split."""
    by = fragments.groupBy(key).agg(F.count(F.lit(1)).alias("fragments"), F.sum(X.n_words(F.col(text)).cast("bigint")).alias("tokens"))
    n, t = F.col("fragments"), F.col("tokens")
    fits = (t <= most) | (n <= 2)
    small = (n < FORCE_FRAGMENTS) & (t < SUMMARY_TOKENS)
    return by.withColumn("decision", F.when(n == 1, "single").when(fits & small, "join").when(fits, "summarize").otherwise("split"))


def pack_fragments(fragments: DataFrame, key: str, order: str, text: str, most: int = CONTEXT_TOKENS) -> DataFrame:
    """``key, order, grp``: consecutive fragments in groups within the context, two at least in each.

    A fold in order: a key's fragments, as sizes only, stream through one task in
    batches, and nothing but the open group's sums is held.
    """
    rows = fragments.select(F.col(key).alias("k"), F.col(order).alias("o"), F.coalesce(X.n_words(F.col(text)), F.lit(0)).cast("bigint").alias("n"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group, total, held, begun = None, 0, 0, 0, False
        for batch in batches:
            out = []
            for k, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if not begun or k != last:
                    last, group, total, held, begun = k, 0, 0, 0, True
                if total + n > most and held >= 2:
                    group, total, held = group + 1, 0, 0
                total, held = total + n, held + 1
                out.append(group)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], names=["k", "o", "grp"])

    by = rows.repartition("k").sortWithinPartitions("k", "o")
    return by.mapInArrow(run, f"k {kinds['k']}, o {kinds['o']}, grp int").toDF(key, order, "grp")


def token_usage(calls: DataFrame, by: str) -> DataFrame:
    return calls.groupBy(by).agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
