"""Consolidating pairwise matches into groups (problem 5).

Method: deterministic Boruvka hooking.  Edges are ordered by (smaller end,
larger end).  Every component selects its smallest outgoing edge, which is the
one to its smallest neighbour; of two components that selected each other the
smaller is the root.  Trees collapse by pointer doubling, edges are relabelled
and deduplicated, and the rounds end when no edge is left.  The number of
components at least halves a round, and every group takes its smallest id.

Ids are replaced by numbers in byte order for the rounds.  All selections are
map-side combined aggregates and all look-ups salt hot keys, so a star that
holds a third of all rows is no task's group.  Each round is a written table.

Results: one row an id.  Null ids, an id paired with itself, repeated pairs and
pairs in either order are no links or one link; an empty table gives an empty
result; ids are compared as stored (byte order, case and blanks count).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans import Scratch, lookup

MERGED = "merged"


def merged_pairs(log: DataFrame, a: str = "entity_a_id", b: str = "entity_b_id", decision: str = "decision") -> DataFrame:
    """``a, b`` of the logged pairs that were merged."""
    said = F.lower(F.regexp_replace(F.col(decision), r"^\s+|\s+$", ""))
    return log.where(said == MERGED).select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).where("a <> b")


def _collapse(best: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """``u, root`` from each component's selected neighbour ``u, p``."""
    of = best.select(F.col("u").alias("p"), F.col("p").alias("pp"))
    hooked = lookup(best, of, "p", n)
    mutual_root = (F.col("pp") == F.col("u")) & (F.col("u") < F.col("p"))
    tree = scratch.save(hooked.select("u", F.when(mutual_root, F.col("u")).otherwise(F.col("p")).alias("p"), F.lit(True).alias("moved")))
    while True:  # pointer doubling: the depth halves each time
        up = tree.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        doubled = scratch.save(lookup(tree.select("u", "p"), up, "p", n).select("u", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")))
        scratch.drop(tree)
        tree = doubled
        if doubled.where("moved").limit(1).count() == 0:
            return doubled.select("u", F.col("p").alias("root"))


def groups(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, group_id`` for every id of ``pairs``; any comparable id type."""
    scratch = Scratch(pairs.sparkSession, "components")
    ends = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = scratch.save(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    n_edges = edges.count()
    # Numbers that keep the ids' order: partitions of the sort follow each other.
    ids = scratch.save(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().orderBy("id").select("id", F.monotonically_increasing_id().alias("u")))
    n = ids.count()
    half = scratch.save(lookup(edges, ids.select(F.col("id").alias("a"), F.col("u").alias("ua")), "a", n_edges).select("ua", "b"))
    work = lookup(half, ids.select(F.col("id").alias("b"), F.col("u").alias("ub")), "b", n_edges)
    work = scratch.save(work.select("ua", "ub"))
    scratch.drop(edges, half)
    rounds: list[tuple[DataFrame, int]] = []
    while n_edges:
        both = work.union(work.select("ub", "ua")).toDF("u", "v")
        best = scratch.save(both.groupBy("u").agg(F.min("v").alias("p")))
        size = best.count()
        tree = _collapse(best, size, scratch)
        rounds.append((tree, size))
        half = scratch.save(lookup(work, tree.toDF("ua", "ra"), "ua", n_edges).select("ra", "ub"))
        nxt = lookup(half, tree.toDF("ub", "rb"), "ub", n_edges).select("ra", "rb").where("ra <> rb")
        nxt = scratch.save(nxt.select(F.least("ra", "rb").alias("ua"), F.greatest("ra", "rb").alias("ub")).distinct())
        scratch.drop(work, best, half)
        work, n_edges = nxt, nxt.count()
    # Later rounds hold ever fewer components: compose from the last one back.
    final: DataFrame | None = None
    for tree, size in reversed(rounds):
        if final is None:
            final = tree
        else:
            later = final.toDF("root", "last")
            final = lookup(tree, later, "root", size, "left").select("u", F.coalesce("last", "root").alias("root"))
    if final is None:
        return ids.select("id", F.col("id").alias("group_id"))
    named = scratch.save(ids.join(final, "u").select("id", "root"))
    smallest = named.groupBy("root").agg(F.min("id").alias("group_id"))
    return lookup(named, smallest, "root", n).select("id", "group_id")
