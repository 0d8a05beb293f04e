"""Ranking, expansion, fusion and budgets of retrieved rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.operators import extraction as E
from weftgraph.operators import graph as G
from weftgraph.plans import Scratch

# Weights of the relevance score, and what a hop costs.
ENTITY_WEIGHT, RELATION_WEIGHT, HOP_WEIGHT, HOP_DECAY = 0.4, 0.5, 0.1, 0.8
TEMPERATURE, DAMPING, UNKNOWN_EDGE = 0.1, 0.85, 0.1


def node_data(hits: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of similarity hits ``entity_name, score`` with their degree as rank; missing nodes drop out."""
    found = hits.select("entity_name", "score").join(nodes, "entity_name")
    deg = G.node_degree(edges, hits.select("entity_name")).withColumnRenamed("degree", "rank")
    return found.join(deg, "entity_name")


def edge_data(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of relation hits ``src, tgt, score`` with the sum of degrees as rank."""
    return hits.select("src", "tgt", "score").join(G.edge_degree(edges).withColumnRenamed("degree", "rank"), ["src", "tgt"])


def round_robin(key: list[str], *lists: DataFrame, rank: str = "rank") -> DataFrame:
    """Ranked lists taken in turn; of equal keys the first place stays. ``pos`` orders the result.

    Each list has the key columns and a unique ``rank``.
    """
    parts = [d.select(*key, F.col(rank).alias("_r"), F.lit(i).alias("source")) for i, d in enumerate(lists)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    first = whole.groupBy(*key).agg(F.min(F.struct("_r", "source")).alias("pos"))
    return first.select(*key, F.col("pos._r").alias("rank"), F.col("pos.source").alias("source"))


def relevance(entity: Column, relation: Column, hop: Column | int) -> Column:
    hop = hop if isinstance(hop, Column) else F.lit(hop)
    zero = lambda c: F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0)))
    return ENTITY_WEIGHT * zero(entity) + RELATION_WEIGHT * zero(relation) + HOP_WEIGHT * F.pow(F.lit(HOP_DECAY), hop - 1)


def multi_hop(edges: DataFrame, seeds: DataFrame, entity_sims: DataFrame, relation_sims: DataFrame, hops: int = 1, top: int = 10, threshold: float = 0.2) -> DataFrame:
    """New nodes within ``hops`` of the seeds ``entity_name, pos``, each with the edge that brought it.

    Every hop keeps, of each frontier node, the ``top`` unvisited neighbours at
    or above the threshold; a node met twice belongs to the first of the
    frontier.  The frontier is a written table, so lineage stays short.
    """
    scratch = Scratch(edges.sparkSession, "hops")
    links = G.both_ways(edges.select("src", "tgt"))
    sims = G.both_ways(relation_sims.select("src", "tgt", F.col("sim").alias("rel_sim")))
    frontier = scratch.save(seeds.select("entity_name", F.col("pos").cast("bigint").alias("pos")))
    visited = frontier.select("entity_name")
    found: DataFrame | None = None
    order = Window.partitionBy("pos").orderBy(F.desc("score"), "tgt")
    for hop in range(1, hops + 1):
        step = links.join(frontier.withColumnRenamed("entity_name", "src"), "src").join(visited.withColumnRenamed("entity_name", "tgt"), "tgt", "left_anti")
        step = step.join(sims, ["src", "tgt"], "left").join(entity_sims.select(F.col("entity_name").alias("tgt"), F.col("sim").alias("ent_sim")), "tgt", "left")
        step = step.withColumn("score", relevance(F.col("ent_sim"), F.col("rel_sim"), hop)).where(F.col("score") >= threshold)
        kept = step.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
        new = kept.groupBy("tgt").agg(F.min_by(F.struct("src", "score", "pos", "r"), F.struct("pos", "r")).alias("f"))
        new = scratch.save(new.select(F.col("tgt").alias("entity_name"), F.col("f.src").alias("via"), F.col("f.score").alias("score"), F.lit(hop).alias("hop"), F.col("f.pos").alias("p"), F.col("f.r").alias("r")))
        found = new if found is None else found.unionByName(new)
        if hop < hops:
            if new.limit(1).count() == 0:
                break
            # The next frontier's order: (place of the parent, rank below it), as one number.
            frontier = new.select("entity_name", (F.col("p") * (top + 1) + F.col("r")).alias("pos"))
            visited = visited.unionByName(new.select("entity_name"))
    return found.select("entity_name", "via", "score", "hop")


def softmax_seeds(seeds: DataFrame, sims: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """``entity_name, p``: restart weights of the seeds; a seed without similarity counts as 0."""
    s = seeds.select("entity_name").distinct().join(sims.select("entity_name", "sim"), "entity_name", "left").withColumn("e", F.exp(F.coalesce("sim", F.lit(0.0)) / temperature))
    return s.crossJoin(F.broadcast(s.agg(F.sum("e").alias("t")))).select("entity_name", (F.col("e") / F.col("t")).alias("p"))  # one row


def pagerank(edges: DataFrame, restart: DataFrame, iterations: int = 50, damping: float = DAMPING, tolerance: float | None = 1e-3) -> DataFrame:
    """``entity_name, rank``: personalized PageRank over weighted undirected edges.

    Mass of nodes without edges goes to the restart weights; it stops when the
    change falls below nodes times ``tolerance`` (None: after all iterations).
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "pagerank")
    links = G.both_ways(edges.select("src", "tgt", F.col("weight").cast("double").alias("w")))
    out = links.groupBy("src").agg(F.sum("w").alias("total"))
    share = scratch.save(links.join(out, "src").where("total > 0").select("src", "tgt", (F.col("w") / F.col("total")).alias("w")))
    names = share.select(F.col("src").alias("entity_name")).distinct().withColumn("linked", F.lit(True))
    # A node without links is told once, not in every step.
    every = names.join(restart, "entity_name", "full_outer")
    nodes = scratch.save(every.select("entity_name", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("linked", F.lit(False)).alias("linked")))
    n = nodes.count()
    if n == 0:
        return nodes.select("entity_name", F.col("p").alias("rank"))
    ranks = nodes.select("entity_name", "p", "linked", F.lit(1.0 / n).alias("rank"))
    for i in range(iterations):
        sent = ranks.join(share.withColumnRenamed("src", "entity_name"), "entity_name").groupBy("tgt").agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        lost = ranks.where("NOT linked").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        nxt = nodes.join(sent.withColumnRenamed("tgt", "entity_name"), "entity_name", "left").crossJoin(F.broadcast(lost))  # one row
        moved = nxt.select("entity_name", "p", "linked", (damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("p")) + (1 - damping) * F.col("p")).alias("rank"))
        moved = scratch.save(moved)
        if tolerance is not None:
            change = moved.join(ranks.select("entity_name", F.col("rank").alias("old")), "entity_name").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if change < n * tolerance:
                return moved.select("entity_name", "rank")
        if i:
            scratch.drop(ranks)
        ranks = moved
    return ranks.select("entity_name", "rank")


def query_aware_pagerank(edges: DataFrame, seeds: DataFrame, entity_sims: DataFrame, relation_sims: DataFrame, top: int = 50, iterations: int = 50, tolerance: float | None = 1e-3) -> DataFrame:
    """The best ranked nodes that are no seeds; edge weights are relation similarities."""
    sims = relation_sims.select("src", "tgt", F.greatest(F.col("sim"), F.lit(0.0)).alias("s"))
    weighted = edges.select("src", "tgt").join(sims, ["src", "tgt"], "left").select("src", "tgt", F.coalesce("s", F.lit(UNKNOWN_EDGE)).alias("weight"))
    ranks = pagerank(weighted, softmax_seeds(seeds, entity_sims), iterations, tolerance=tolerance)
    return ranks.join(seeds.select("entity_name"), "entity_name", "left_anti").orderBy(F.desc("rank"), "entity_name").limit(top)


def _sums(dim: int):
    """Weighted sums of the vectors of each ``src``, of batches sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def out(names: list, rows) -> pa.RecordBatch:
            ends = pa.array((np.arange(len(names) + 1) * dim).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([1.0] * len(names)), pa.ListArray.from_arrays(ends, pa.array(rows.reshape(-1)))], names=["src", "w", "x"])

        last, held = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            src = batch.column(0).to_pylist()
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, dim) * batch.column(1).to_numpy()[:, None]
            at = np.flatnonzero([i == 0 or src[i] != src[i - 1] for i in range(n)])
            sums, names = np.add.reduceat(x, at, axis=0), [src[i] for i in at]
            if held is not None and names[0] == last:
                sums[0] += held
            elif held is not None:
                yield out([last], held)
            if len(names) > 1:
                yield out(names[:-1], sums[:-1])
            last, held = names[-1], sums[-1].copy()
        if held is not None:
            yield out([last], held)

    return run


def _spread(walk: DataFrame, x: DataFrame, dim: int) -> DataFrame:
    """One product with the walk matrix: sums in the join's tasks first, so that a hub sends one row a task."""
    kinds = "src string, w double, x array<double>"
    met = walk.join(x.withColumnRenamed("src", "tgt"), "tgt").select("src", "w", "x")
    part = met.sortWithinPartitions("src").mapInArrow(_sums(dim), kinds)
    return part.repartition("src").sortWithinPartitions("src").mapInArrow(_sums(dim), kinds).select("src", "x")


def fastrp(edges: DataFrame, dim: int = 256, weights: tuple = (1.0, 1.0, 0.5, 0.25), power: float = -0.1) -> DataFrame:
    """``entity_name, x array<double>``: random-projection embeddings, a row a node, of length one.

    Signs come from a hash of node and dimension; a product with the normalized
    adjacency (with self loops) is a join and a sum of arrays.
    """
    scratch = Scratch(edges.sparkSession, "fastrp")
    links = G.both_ways(edges.select("src", "tgt", F.col("weight").cast("double").alias("w")))
    names = links.select("src").distinct()
    loops = links.unionByName(names.select("src", F.col("src").alias("tgt"), F.lit(1.0).alias("w")))
    degree = loops.groupBy("src").agg(F.sum("w").alias("deg"))
    walk = loops.join(degree, "src").join(degree.toDF("tgt", "deg2"), "tgt")
    walk = scratch.save(walk.select("src", "tgt", (F.col("w") / F.sqrt(F.col("deg") * F.col("deg2"))).alias("w")))
    deg = scratch.save(degree)
    one = 1.0 / float(dim) ** 0.5
    sign = lambda d: F.when(F.conv(F.substring(F.md5(F.concat("src", F.lit("|"), d.cast("string"))), 1, 2), 16, 10).cast("int") % 2 == 0, one).otherwise(-one)
    x = scratch.save(deg.select("src", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), sign).alias("x")))
    total = x.select("src", F.lit(weights[0]).alias("w"), "x")
    for w in weights[1:]:
        x = scratch.save(_spread(walk, x, dim))
        total = total.unionByName(x.select("src", F.lit(w).alias("w"), "x"))
    raw = total.repartition("src").sortWithinPartitions("src").mapInArrow(_sums(dim), "src string, w double, x array<double>").join(deg, "src")
    scaled = raw.select("src", F.transform("x", lambda v: v * F.pow("deg", F.lit(power))).alias("x")).withColumn("n", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)))
    return scaled.select(F.col("src").alias("entity_name"), F.transform("x", lambda v: F.when(F.col("n") > 0, v / F.col("n")).otherwise(F.lit(0.0))).alias("x"))


def structural_scores(vectors: DataFrame, seeds: DataFrame) -> DataFrame:
    """Mean cosine of every other node to the seeds: one dot with the mean of the seeds."""
    names = seeds.select("entity_name").distinct()
    each = vectors.join(names, "entity_name", "left_semi").select(F.posexplode("x").alias("d", "v"))
    mean = each.groupBy("d").agg(F.avg("v").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("m"))  # one row, of all dimensions
    rest = vectors.join(names, "entity_name", "left_anti").crossJoin(F.broadcast(mean)).where(F.size("m") > 0)
    dot = F.aggregate(F.zip_with("x", "m", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rest.select("entity_name", dot.alias("score"))


def merge_entities(*found: tuple[str, DataFrame]) -> DataFrame:
    """Entities of several methods: the first method's copy, and all methods sorted and joined by "+"."""
    whole = None
    for i, (method, d) in enumerate(found):
        part = d.select("entity_name", F.lit(i).alias("o"), F.lit(method).alias("m"))
        whole = part if whole is None else whole.unionByName(part)
    return whole.groupBy("entity_name").agg(F.min_by("m", "o").alias("first_method"), F.array_join(F.array_sort(F.collect_set("m")), "+").alias("discovery_method"))


def merge_relations(*lists: DataFrame, ordered: bool = False) -> DataFrame:
    """Relations of several lists, the first list's copy; ``ordered`` tells the two directions apart."""
    whole = None
    for i, d in enumerate(lists):
        part = d.select("src", "tgt", F.lit(i).alias("source"))
        whole = part if whole is None else whole.unionByName(part)
    if not ordered:
        whole = whole.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), "source")
    return whole.groupBy("src", "tgt").agg(F.min("source").alias("source"))


def simple_paths(edges: DataFrame, start: str, end: str, cutoff: int = 3, most: int = 10) -> DataFrame:
    """``path, hops``: paths without a repeated node, shortest first."""
    links = G.both_ways(edges.select("src", "tgt"))
    paths = links.where(F.col("src") == start).select(F.array("src", "tgt").alias("path"))
    done = paths.where(F.element_at("path", -1) == end)
    for _ in range(cutoff - 1):
        grow = paths.where(F.element_at("path", -1) != end).withColumn("src", F.element_at("path", -1))
        paths = grow.join(links, "src").where(~F.array_contains("path", F.col("tgt"))).select(F.concat("path", F.array("tgt")).alias("path"))
        done = done.unionByName(paths.where(F.element_at("path", -1) == end))
    return done.withColumn("hops", F.size("path") - 1).orderBy("hops", "path").limit(most)


def knowledge_graph(edges: DataFrame, label: str = "*", depth: int = 3, most: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes, edges, truncated)``: a breadth-first subgraph, or for ``*`` the nodes of highest degree."""
    deg = G.degrees(edges)
    if label == "*":
        reached = deg.select("entity_name", F.lit(0).alias("depth"), "degree")
    else:
        scratch = Scratch(edges.sparkSession, "subgraph")
        links = G.both_ways(edges.select("src", "tgt"))
        level = scratch.save(links.where(F.col("src") == label).select(F.col("src").alias("entity_name"), F.lit(0).alias("depth")).distinct())
        reached = level
        for d in range(1, depth + 1):
            nxt = links.join(level.select(F.col("entity_name").alias("src")), "src", "left_semi").select(F.col("tgt").alias("entity_name")).distinct()
            level = scratch.save(nxt.join(reached.select("entity_name"), "entity_name", "left_anti").withColumn("depth", F.lit(d)))
            reached = reached.unionByName(level)
        reached = reached.join(deg, "entity_name")
    nodes = reached.orderBy("depth", F.desc("degree"), "entity_name").limit(most)
    inner = G.induced(edges, nodes)
    return nodes, inner, reached.agg((F.count(F.lit(1)) > most).alias("is_truncated"))


def weighted_polling(items: DataFrame, most: int, least: int = 1) -> DataFrame:
    """``chunk, pass, item, place``: chunks of ranked items by linearly falling quotas.

    ``items``: ``item`` (0 best), ``chunks array``.  Quotas nobody used go to the
    first items that still have chunks.  A single item gives its first chunks.
    """
    n = items.agg(F.count(F.lit(1)).alias("n"))
    quota = F.bround(F.lit(float(most)) - F.col("item") / (F.col("n") - 1) * (most - least)).cast("int")
    q = items.crossJoin(F.broadcast(n)).withColumn("quota", F.when(F.col("n") == 1, F.lit(most)).otherwise(quota))  # one row
    spare = q.agg(F.sum(F.when(F.col("n") > 1, F.greatest(F.col("quota") - F.size("chunks"), F.lit(0))).otherwise(0)).alias("spare"))
    each = q.select("item", "quota", F.posexplode("chunks").alias("place", "chunk"))
    first = each.where("place < quota").select("chunk", F.lit(1).alias("pass"), "item", "place")
    # Leftovers in order: those of an item, and how many the items before it have.
    left = q.select("item", F.greatest(F.size("chunks") - F.col("quota"), F.lit(0)).alias("more"))
    before = left.withColumn("off", F.coalesce(F.sum("more").over(Window.orderBy("item").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row an item of a query
    rest = each.where("place >= quota").join(before.select("item", "off"), "item").crossJoin(F.broadcast(spare))  # one row
    second = rest.where(F.col("off") + F.col("place") - F.col("quota") < F.col("spare")).select("chunk", F.lit(2).alias("pass"), "item", "place")
    return first.unionByName(second)


def by_similarity(scored: DataFrame, k: int, key: str = "id") -> DataFrame:
    """The ``k`` most similar; nothing at all when a score is missing."""
    gaps = scored.agg(F.sum(F.col("score").isNull().cast("int")).alias("gaps"))
    return scored.crossJoin(F.broadcast(gaps)).where("gaps = 0").drop("gaps").orderBy(F.desc("score"), key).limit(k)  # one row


def cap_per_group(rows: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each group; tasks keep only ``k`` before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def within_budget(rows: DataFrame, tokens: str, most: int, *order: Column, group: str | None = None) -> DataFrame:
    """The longest prefix, by ``order``, whose tokens sum to at most ``most``; per ``group`` if given."""
    if most <= 0:
        return rows.limit(0)
    w = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_s", F.sum(tokens).over(w)).where(F.col("_s") <= most).drop("_s")


def process_chunks(chunks: DataFrame, min_score: float, k: int, budget: int, tokens: str = "tokens") -> DataFrame:
    """Reranked chunks ``id, score, pos``: score filter, top ``k``, budget. A missing score is 1."""
    s = F.coalesce("score", F.lit(1.0))
    kept = chunks.where(s >= min_score) if min_score > 0 else chunks
    order = (F.desc_nulls_last("score"), F.col("pos"))
    return within_budget(kept.orderBy(*order).limit(k), tokens, budget, *order)


def rerank(rows: DataFrame, model: Callable[[list[str]], list[float]], text: str) -> DataFrame:
    """Rows with a model's score."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series(model(s.tolist()), dtype="float64")

    return rows.withColumn("score", F.pandas_udf(run, "double")(F.col(text)))


def recognition_filter(relations: DataFrame, irrelevant: Column, batch: int = 10, order: str = "pos") -> tuple[DataFrame, DataFrame]:
    """``(relations, entities)`` after dropping what a predicate calls irrelevant, batch by batch.

    An entity that some batch keeps stays; if everything were dropped, all stay.
    """
    numbered = relations.withColumn("batch", F.floor(F.col(order) / batch)).withColumn("drop", irrelevant)
    kept = numbered.where(~F.col("drop"))
    none = kept.agg((F.count(F.lit(1)) == 0).alias("none"))
    rel = numbered.crossJoin(F.broadcast(none)).where(F.col("none") | ~F.col("drop")).drop("drop", "none")  # one row
    return rel, rel.select(F.explode(F.array("src", "tgt")).alias("entity_name")).distinct()


def chunk_budget(total: int, *used: int, reserve: int = 100) -> int:
    return max(0, total - sum(used) - reserve)


def render(rows: DataFrame, columns: list[str], *order: Column, form: str = "json") -> DataFrame:
    """One row with all rows rendered in order: JSON lines or a markdown table."""
    if form == "json":
        line, head = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), ""
    else:
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
        head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n"
    lines = F.array_sort(F.collect_list(F.struct(F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)]).alias("o"), line.alias("l"))))
    return rows.agg(F.concat(F.lit(head), F.array_join(F.transform(lines, lambda x: x["l"]), "\n")).alias("context"))


def cached(requests: DataFrame, cache: DataFrame, digest: str = "digest") -> tuple[DataFrame, DataFrame]:
    """``(hits, misses)`` of requests by the hash of all their arguments."""
    return requests.join(cache, digest), requests.join(cache.select(digest), digest, "left_anti")


def mentions_budget(rows: DataFrame, text: str, most: int, *order: Column, tokenizer: X.Tokenizer | None = None) -> DataFrame:
    return within_budget(rows.withColumn("_n", F.coalesce(X.n_tokens(F.col(text), tokenizer), F.lit(0))), "_n", most, *order).drop("_n")


IRRELEVANT = "irrelevant_relation_ids"


def recognize(relations: DataFrame, query: str, model: Callable[[list[str]], list[str]], batch: int = 10, order: str = "pos") -> DataFrame:
    """Relations that a model does not call irrelevant to the query; it reads one batch of numbered relations at a time.

    ``order`` counts from 0 without gaps, so that a batch is bounded.  The model
    answers with JSON that lists numbers under ``irrelevant_relation_ids``;
    without readable JSON a batch stays.  If all were dropped, all stay.
    """
    line = F.concat(F.col(order).cast("string"), F.lit(": "), F.concat_ws(" | ", "src", "tgt", F.coalesce("description", F.lit(""))))
    each = relations.withColumn("batch", F.floor(F.col(order) / batch))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n")
    asked = each.groupBy("batch").agg(F.concat(F.lit(f"{query}\n"), lines).alias("prompt"))
    said = Scratch(relations.sparkSession, "recognize").save(E.ask(asked, model, "prompt", "said").select(X.first_json(F.col("said")).alias("j")))
    gone = said.select(F.explode(F.from_json("j", f"{IRRELEVANT} array<bigint>")[IRRELEVANT]).alias(order)).distinct()
    rel, _ = recognition_filter(relations.join(gone.withColumn("_g", F.lit(True)), order, "left"), F.coalesce("_g", F.lit(False)), batch, order)
    return rel.drop("_g", "batch")
