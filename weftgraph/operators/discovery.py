"""Operators around injected models: keywords, orphans, entity types, summaries, chunkers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.operators import extraction as E
from weftgraph.operators import reduce as R
from weftgraph.plans.scratch import Scratch

Model = Callable[[list[str]], list[str]]


def query_keywords(queries: DataFrame, model: Model, text: str = "query") -> DataFrame:
    """``high`` and ``low`` keywords of queries; those given by the user are kept as they are."""
    asked = E.ask(queries, model, text, "_a")
    k = X.keywords(F.col("_a"))
    none = F.array().cast("array<string>")
    given = lambda c: F.when(F.size(F.coalesce(F.col(c), none)) > 0, F.col(c))
    high, low = F.coalesce(given("hl"), k["high_level_keywords"], none), F.coalesce(given("ll"), k["low_level_keywords"], none)
    # A short query without any keyword is its own low-level keyword.
    return asked.select("*", high.alias("high"), low.alias("_l")).withColumn("low", F.when((F.size("high") == 0) & (F.size("_l") == 0) & (F.length(text) < 50), F.array(text)).otherwise(F.col("_l"))).drop("_a", "_l")


def describe_orphans(orphans: DataFrame, types: list[str], model: Model, prompt: str = "entity_name") -> DataFrame:
    """Type and description of nodes without a mention, from answers ``(TYPE)<SEP>(DESCRIPTION)``.

    Types match without case; an unknown one becomes Other.
    """
    a = E.ask(orphans, model, prompt, "_a")
    kind = F.trim(F.regexp_extract("_a", r"(?s)^\s*\(?(.*?)\)?\s*<SEP>", 1))
    known = F.coalesce(*[F.when(F.lower(kind) == t.lower(), F.lit(t)) for t in types], F.lit("Other"))
    return a.withColumn("entity_type", known).withColumn("description", X.strip(F.regexp_extract("_a", r"(?s)<SEP>\s*\(?(.*?)\)?\s*$", 1))).drop("_a")


def discover_types(chunks: DataFrame, model: Model, text: str = "content", least: int = 1) -> DataFrame:
    """Entity types that a model suggests for chunks (one a line), with how many chunks name each.

    Counting replaces refining batch after batch, so chunks need no order.
    """
    a = E.ask(chunks.select(text), model, text, "_a")
    names = a.select(F.explode(F.array_distinct(F.transform(F.split("_a", "\n"), lambda x: F.lower(F.trim(x))))).alias("entity_type")).where("entity_type <> ''")
    return names.groupBy("entity_type").agg(F.count(F.lit(1)).alias("chunks")).where(F.col("chunks") >= least)


def summarize(fragments: DataFrame, key: str, order: str, text: str, model: Model, joiner: str = "\n\n", most: int = R.CONTEXT_TOKENS) -> DataFrame:
    """``key, summary``: single and small lists are joined, others go to the model group by group.

    Summaries of groups are fragments again, until a list is joined or told at
    once.  A group of one stays as it is.  Groups hold at most ``most`` tokens,
    or two fragments; what the model reads is cut to ``most``.
    """
    scratch = Scratch(fragments.sparkSession, "summaries")
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda x: x[c]), joiner)
    read = F.when(X.n_words(F.col("part")) > most, X.joined(F.slice(X.spans(F.col("part")), 1, most))).otherwise(F.col("part"))
    told = lambda parts: E.ask(parts.withColumn("part", read), model, "part", "told")
    done, left = [], fragments.select(key, order, text)
    while True:
        decided = R.summary_decision(left, key, text, most)
        rows = scratch.save(left.join(decided.select(key, "decision"), key))
        done.append(rows.where("decision IN ('single', 'join')").groupBy(key).agg(in_order(text).alias("summary")))
        whole = rows.where("decision = 'summarize'").groupBy(key).agg(in_order(text).alias("part"))
        done.append(told(whole).select(key, F.col("told").alias("summary")))
        split = rows.where("decision = 'split'").select(key, order, text)
        if split.limit(1).count() == 0:
            return reduce(DataFrame.unionByName, done)
        groups = R.pack_fragments(split, key, order, text, most)
        parts = scratch.save(split.join(groups, [key, order]).groupBy(key, "grp").agg(in_order(text).alias("part"), F.count(F.lit(1)).alias("n")))
        alone = parts.where("n = 1").select(key, F.col("grp").alias(order), F.col("part").alias(text))
        many = told(parts.where("n > 1").select(key, "grp", "part")).select(key, F.col("grp").alias(order), F.col("told").alias(text))
        left = scratch.save(alone.union(many))  # the model is asked once
