"""Graph access over ``nodes`` and undirected ``edges`` (src < tgt)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.plans.scratch import Scratch


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from each of its ends."""
    return edges.unionByName(edges.withColumnsRenamed({"src": "_t", "tgt": "src"}).withColumnRenamed("_t", "tgt"))


def degrees(edges: DataFrame) -> DataFrame:
    """``entity_name, degree`` of every node that has an edge."""
    ends = edges.select("src").union(edges.select("tgt")).toDF("entity_name")
    return ends.groupBy("entity_name").agg(F.count(F.lit(1)).alias("degree"))


def get_nodes(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """The asked nodes, once each; misses are left out."""
    return nodes.join(names.select("entity_name").distinct(), "entity_name", "left_semi")


def node_degree(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Degree of the asked names; 0 for those without an edge."""
    return names.select("entity_name").distinct().join(degrees(edges), "entity_name", "left").select("entity_name", F.coalesce("degree", F.lit(0)).alias("degree"))


def edge_degree(edges: DataFrame) -> DataFrame:
    """Edges with the sum of their ends' degrees."""
    d = degrees(edges)
    a, b = d.toDF("src", "_a"), d.toDF("tgt", "_b")
    return edges.join(a, "src").join(b, "tgt").withColumn("degree", F.col("_a") + F.col("_b")).drop("_a", "_b")


def get_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges of the asked ``a, b`` pairs in either order, as asked."""
    asked = pairs.withColumn("src", F.least("a", "b")).withColumn("tgt", F.greatest("a", "b"))
    return asked.join(edges, ["src", "tgt"]).drop("src", "tgt")


def adjacency(edges: DataFrame, names: DataFrame) -> DataFrame:
    """``src, tgt`` pairs oriented from the asked names."""
    return both_ways(edges.select("src", "tgt")).join(names.select(F.col("entity_name").alias("src")).distinct(), "src", "left_semi")


def by_chunks(rows: DataFrame, chunks: DataFrame, key: list[str], source: str = "source_id") -> DataFrame:
    """Rows whose joined sources hold one of the chunk ids."""
    held = rows.select(*key, F.explode(F.split(source, X.SEP)).alias("id"))
    return held.join(chunks.select("id"), "id", "left_semi").select(*key).distinct()


def induced(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges with both ends among the seeds, with rank (edge degree), best first."""
    s = seeds.select("entity_name").distinct()
    inner = edges.join(s.toDF("src"), "src", "left_semi").join(s.toDF("tgt"), "tgt", "left_semi")
    d = degrees(edges)
    ranked = inner.join(d.toDF("src", "_a"), "src").join(d.toDF("tgt", "_b"), "tgt").withColumn("rank", F.col("_a") + F.col("_b")).drop("_a", "_b")
    return ranked.select("src", "tgt", "weight", "rank")


def endpoints_in_order(relations: DataFrame, order: str = "ord") -> DataFrame:
    """``entity_name, pos``: ends by first appearance, the source before the target."""
    ends = relations.select(F.col(order).alias("o"), F.posexplode(F.array("src", "tgt")).alias("side", "entity_name"))
    return ends.groupBy("entity_name").agg(F.min(F.struct("o", "side")).alias("first"))


def related_chunks(items: DataFrame, order: str = "ord", key: str = "entity_name", source: str = "source_id") -> DataFrame:
    """Chunks of ranked items: first occurrence (item order, place), and how many items hold each."""
    each = items.select(F.col(order).alias("o"), F.posexplode(F.split(source, X.SEP)).alias("place", "id")).where("id <> ''")
    return each.groupBy("id").agg(F.min(F.struct("o", "place")).alias("first"), F.count(F.lit(1)).alias("occurrences"))


def best(edges: DataFrame, k: int) -> DataFrame:
    return edges.orderBy(F.desc("rank"), F.desc("weight"), "src", "tgt").limit(k)


def neighbours_top(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """The ``k`` heaviest neighbours of each seed."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "tgt")
    return both_ways(edges.select("src", "tgt", "weight")).join(seeds.select(F.col("entity_name").alias("src")), "src", "left_semi").withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """``entity_name, community``: label propagation over undirected weighted edges.

    In each round a node takes the label with the greatest weight among itself
    (weight 0) and its neighbours, the smallest on a tie, so the outcome is
    deterministic; it ends early when no label changes.  Weights are summed on
    the map side, so a hub is no task's group.
    """
    scratch = Scratch(edges.sparkSession, "communities")
    links = scratch.save(both_ways(edges.select("src", "tgt", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("w"))))
    labels = scratch.save(links.select(F.col("src").alias("entity_name")).distinct().withColumn("community", F.col("entity_name")))
    for _ in range(rounds):
        told = links.join(labels.toDF("tgt", "l"), "tgt").select(F.col("src").alias("entity_name"), "l", "w")
        votes = told.union(labels.select("entity_name", "community", F.lit(0.0))).groupBy("entity_name", "l").agg(F.sum("w").alias("w"))
        best = votes.groupBy("entity_name").agg(F.min(F.struct((-F.col("w")).alias("w"), "l"))["l"].alias("community"))
        new = scratch.save(best)
        moved = new.join(labels.withColumnRenamed("community", "old"), "entity_name").where("community <> old").limit(1).count()
        scratch.drop(labels)
        labels = new
        if not moved:
            break
    return labels
