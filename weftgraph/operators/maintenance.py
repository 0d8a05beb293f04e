"""Mutations: upserts, deletions, edits, merges and delete-and-rebuild."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.operators import reduce as R
from weftgraph.plans import Scratch

CONCATENATE, KEEP_FIRST, KEEP_LAST, JOIN_UNIQUE, MAX = "concatenate", "keep_first", "keep_last", "join_unique", "max"


def upsert_rows(store: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Attribute merge: new non-null attributes replace the old ones, others stay."""
    rest = [c for c in store.columns if c not in key]
    n = new.select(*key, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c not in key])
    both = store.join(n, key, "full_outer")
    return both.select(*key, *[F.coalesce(f"_new_{c}", c).alias(c) if c in new.columns else F.col(c) for c in rest])


def remove_nodes(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the named nodes and every edge at them."""
    gone = names.select("entity_name").distinct()
    kept = edges.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("tgt"), "tgt", "left_anti")
    return nodes.join(gone, "entity_name", "left_anti"), kept.select(edges.columns)


def remove_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Without the ``a, b`` pairs, in either order."""
    gone = pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("tgt"))
    return edges.join(gone, ["src", "tgt"], "left_anti").select(edges.columns)


def exists(rows: DataFrame, condition) -> bool:
    return rows.where(condition).limit(1).count() > 0


def rename_entity(nodes: DataFrame, edges: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """The node and its edges under a new name; an error when that name is taken."""
    if not exists(nodes, F.col("entity_name") == old):
        raise KeyError(old)
    if exists(nodes, F.col("entity_name") == new):
        raise ValueError(f"{new} exists")
    put = lambda c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c))
    a, b = put("src"), put("tgt")
    out = edges.withColumns({"src": F.least(a, b), "tgt": F.greatest(a, b)})
    return nodes.withColumn("entity_name", put("entity_name")), out


def create_entity(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes with new ones; an error when one exists."""
    if nodes.join(new.select("entity_name"), "entity_name", "left_semi").limit(1).count():
        raise ValueError("entity exists")
    return nodes.unionByName(new, allowMissingColumns=True)


def create_relation(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with new ones; an error when one exists or an end is missing."""
    n = new.withColumns({"src": F.least("src", "tgt"), "tgt": F.greatest("src", "tgt")})
    ends = n.select(F.explode(F.array("src", "tgt")).alias("entity_name")).distinct()
    if ends.join(nodes.select("entity_name"), "entity_name", "left_anti").limit(1).count():
        raise KeyError("endpoint missing")
    if n.join(edges, ["src", "tgt"], "left_semi").limit(1).count():
        raise ValueError("relation exists")
    return edges.unionByName(n, allowMissingColumns=True)


def merged_attributes(rows: DataFrame, key: list[str], order: str, strategy: dict[str, str], falsy: bool = True) -> DataFrame:
    """One row a key, each column by its strategy (``keep_first`` where none is given).

    ``falsy``: empty strings are ignored like nulls, as for entities; relations
    ignore only nulls.
    """
    out = []
    for c in rows.columns:
        if c in key or c == order:
            continue
        value = F.when(F.col(c).cast("string") != "", F.col(c)) if falsy else F.col(c)
        how = strategy.get(c, KEEP_FIRST)
        pair = F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.alias("v")))
        if how == CONCATENATE:
            out.append(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["v"].cast("string")), "\n\n").alias(c))
        elif how == KEEP_LAST:
            out.append(F.max(pair)["v"].alias(c))
        elif how == JOIN_UNIQUE:
            out.append(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split(value, X.SEP))))), X.SEP).alias(c))
        elif how == MAX:
            out.append(F.max(F.col(c).cast("double")).alias(c))
        else:
            out.append(F.min(pair)["v"].alias(c))
    return rows.groupBy(*key).agg(*out)


def merge_entities(nodes: DataFrame, edges: DataFrame, mapping: DataFrame, strategy: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after replacing ``old`` names by ``new`` ones.

    Attributes of one name merge by strategy, self-loops go, and edges that fall
    together keep the greatest weight and join their distinct keywords.
    """
    to = F.broadcast(mapping.select("old", "new")) if mapping.count() <= 10_000 else mapping.select("old", "new")
    m = nodes.join(to, nodes["entity_name"] == to["old"], "left").withColumn("_ord", F.concat(F.when(F.col("old").isNull(), "0").otherwise("1"), "entity_name"))
    m = m.withColumn("entity_name", F.coalesce("new", "entity_name")).drop("old", "new")
    plan = strategy or {"description": CONCATENATE, "source_id": JOIN_UNIQUE, "file_path": JOIN_UNIQUE}
    new_nodes = merged_attributes(m, ["entity_name"], "_ord", plan)
    a = to.toDF("src", "_a")
    b = to.toDF("tgt", "_b")
    e = edges.join(a, "src", "left").join(b, "tgt", "left").withColumn("_ord", F.concat_ws("|", "src", "tgt"))
    s, t = F.coalesce("_a", "src"), F.coalesce("_b", "tgt")
    e = e.withColumns({"src": F.least(s, t), "tgt": F.greatest(s, t)}).drop("_a", "_b").where("src <> tgt")
    keep = {"weight": MAX, "keywords": JOIN_UNIQUE, "description": CONCATENATE, "source_id": JOIN_UNIQUE, "file_path": JOIN_UNIQUE}
    return new_nodes, merged_attributes(e, ["src", "tgt"], "_ord", keep, falsy=False)


def merge_decisions(pairs: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(merge, skip, ask)`` of candidate pairs ``a, b, hash_a, hash_b`` by the decision log.

    A logged merge holds whenever both names stand again; a logged skip holds
    while both texts are unchanged; all others are asked.
    """
    said = log.groupBy("a", "b").agg(F.max_by(F.struct("decision", F.col("hash_a").alias("ha"), F.col("hash_b").alias("hb")), "decided_at").alias("l"))
    j = pairs.join(said, ["a", "b"], "left")
    merge = F.col("l.decision").eqNullSafe("merged")
    skip = F.col("l.decision").eqNullSafe("skipped") & F.col("l.ha").eqNullSafe(F.col("hash_a")) & F.col("l.hb").eqNullSafe(F.col("hash_b"))
    return j.where(merge).drop("l"), j.where(skip).drop("l"), j.where(~merge & ~skip).drop("l")


def greedy_matching(pairs: DataFrame) -> DataFrame:
    """Pairs taken by falling score while both names are free, in rounds without a driver loop over rows.

    A pair is taken when it is the best of both its ends (ties by the pair);
    its ends leave and the next round decides the rest: the same pairs as going
    through them one by one.
    """
    scratch = Scratch(pairs.sparkSession, "matching")
    left = scratch.save(pairs.select("a", "b", "score"))
    taken = left.limit(0)
    while left.limit(1).count():
        rank = F.struct(-F.col("score"), F.col("a"), F.col("b"))
        ends = left.select("a", "b", "score", F.explode(F.array("a", "b")).alias("end"))
        best = ends.groupBy("end").agg(F.min(rank).alias("best"))
        won = best.select(F.col("best.a").alias("a"), F.col("best.b").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        now = scratch.save(left.join(won.select("a", "b"), ["a", "b"]).select("a", "b", "score"))
        gone = now.select(F.explode(F.array("a", "b")).alias("g"))
        nxt = left.join(gone.toDF("a"), "a", "left_anti").join(gone.toDF("b"), "b", "left_anti").select("a", "b", "score")
        taken = taken.unionByName(now)
        left = scratch.save(nxt)
    return taken


def merge_until_stable(nodes: DataFrame, edges: DataFrame, find: Callable[[DataFrame], DataFrame], rounds: int = 3) -> tuple[DataFrame, DataFrame, int]:
    """Merging passes until one finds nothing: b goes into a for each pair ``find`` returns."""
    scratch = Scratch(nodes.sparkSession, "merging")
    done = 0
    for _ in range(rounds):
        pairs = scratch.save(greedy_matching(find(nodes)))
        if pairs.limit(1).count() == 0:
            break
        nodes, edges = (scratch.save(x) for x in merge_entities(nodes, edges, pairs.select(F.col("b").alias("old"), F.col("a").alias("new"))))
        done += 1
    return nodes, edges, done


def after_deletion(rows: DataFrame, chunks: DataFrame, key: list[str], source: str = "source_id") -> DataFrame:
    """``key, action, remaining``: delete or rebuild for rows that lose chunks, by what sources remain."""
    each = rows.select(*key, F.explode(F.split(source, X.SEP)).alias("id"))
    gone = chunks.select("id", F.lit(1).alias("g")).distinct()
    by = each.join(gone, "id", "left").groupBy(*key).agg(F.sum(F.coalesce("g", F.lit(0))).alias("lost"), F.array_sort(F.collect_set(F.when(F.col("g").isNull(), F.col("id")))).alias("remaining"))
    hit = by.where("lost > 0")
    return hit.select(*key, F.when(F.size("remaining") == 0, "delete").otherwise("rebuild").alias("action"), F.array_join("remaining", X.SEP).alias("remaining"))


def rebuild_nodes(mentions: DataFrame, deleted: DataFrame, order: str = "ord") -> DataFrame:
    """Nodes that lost mentions, merged again from the mentions of the other chunks only."""
    gone = deleted.select(F.col("id").alias("source_id")).distinct()
    affected = mentions.join(gone, "source_id", "left_semi").select("entity_name").distinct()
    rest = mentions.join(gone, "source_id", "left_anti").join(affected, "entity_name", "left_semi")
    return R.merge_nodes(rest, order)


def rebuild_edges(mentions: DataFrame, deleted: DataFrame, order: str = "ord") -> DataFrame:
    """Edges that lost mentions, merged again from the rest."""
    gone = deleted.select(F.col("id").alias("source_id")).distinct()
    pair = {"src": F.least("src_id", "tgt_id"), "tgt": F.greatest("src_id", "tgt_id")}
    m = mentions.withColumns(pair)
    affected = m.join(gone, "source_id", "left_semi").select("src", "tgt").distinct()
    rest = m.join(gone, "source_id", "left_anti").join(affected, ["src", "tgt"], "left_semi")
    return R.merge_edges(rest.drop("src", "tgt"), order)


def export_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``kind, a, b, text`` of the export: entities, and every edge in both orders."""
    ent = nodes.select(F.lit("entity").alias("kind"), F.col("entity_name").alias("a"), F.lit(None).cast("string").alias("b"), "description")
    one = edges.select(F.lit("relation").alias("kind"), F.col("src").alias("a"), F.col("tgt").alias("b"), "description")
    return ent.unionByName(one).unionByName(one.select("kind", F.col("b").alias("a"), F.col("a").alias("b"), "description"))


def info(nodes: DataFrame, vectors: DataFrame, names: DataFrame) -> DataFrame:
    """Nodes of the asked names with whether they have a vector."""
    return names.select("entity_name").distinct().join(nodes, "entity_name").join(vectors.select("entity_name", F.lit(True).alias("has_vector")).distinct(), "entity_name", "left").withColumn("has_vector", F.coalesce("has_vector", F.lit(False)))
