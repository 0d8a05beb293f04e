"""Parsing model output into entity and relation mentions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import text as X

# The grammar of extraction answers.
FIELD, RECORD, DONE = "<|>", "##", "<|COMPLETE|>"


def records(df: DataFrame, text: str = "content") -> DataFrame:
    """One row a record: the input with ``ord`` and ``fields array<string>``."""
    joined = F.regexp_replace(F.col(text), r"[）)](\s*##\s*)[（(]", r")$1(")
    each = df.select("*", F.posexplode(X.split_markers(joined, [RECORD, DONE])).alias("ord", "_r"))
    r = F.regexp_replace(F.regexp_replace(X.strip(F.col("_r")), "^[(（]", ""), "[)）]$", "")
    r = F.regexp_replace(X.strip(r), r"^(entity|relationship)<\|(?!>)", "$1<|>")
    for wrong in ("<||>", "< | >", "<<|>>", "<|>>", "<<|>"):
        r = F.replace(r, F.lit(wrong), F.lit("<|>"))
    return each.withColumn("fields", X.split_markers(r, [FIELD])).drop("_r")


def _field(i: int):
    return F.try_element_at(F.col("fields"), F.lit(i))


def entity_records(recs: DataFrame) -> DataFrame:
    """``fields`` with at least four parts whose first names an entity, cleaned."""
    ok = recs.where((F.size("fields") >= 4) & _field(1).contains("entity"))
    out = ok.withColumn("entity_name", X.clean(_field(2), True)).withColumn("_t", X.clean(_field(3), True)).withColumn("_d", X.clean(_field(4)))
    out = out.where((F.length("entity_name") > 0) & X.valid_type(F.col("_t")) & (F.length("_d") > 0))
    return out.withColumn("entity_type", X.title_case(F.col("_t")))


def entities(recs: DataFrame, label: str | None = None) -> DataFrame:
    """Entity mentions: name, type, description (with its time label)."""
    found = entity_records(recs)
    description = F.col("_d") if label is None else X.with_time(F.col("_d"), F.col(label))
    return found.withColumn("description", description).drop("_t", "_d", "fields")


def relations(recs: DataFrame, label: str | None = None) -> DataFrame:
    """Relation mentions: src, tgt, keywords, description, weight; self-loops are left out."""
    entity = (F.size("fields") >= 4) & _field(1).contains("entity")
    ok = recs.where((F.size("fields") >= 5) & _field(1).contains("relationship") & ~entity)
    out = ok.withColumn("src_id", X.clean(_field(2), True)).withColumn("tgt_id", X.clean(_field(3), True))
    out = out.where((F.length("src_id") > 0) & (F.length("tgt_id") > 0) & (F.col("src_id") != F.col("tgt_id")))
    last = F.regexp_replace(F.regexp_replace(_field(-1), '^"+|"+$', ""), "^'+|'+$", "")
    out = out.withColumn("keywords", F.regexp_replace(X.clean(_field(4), True), "，", ",")).withColumn("_d", X.clean(_field(5)))
    description = F.col("_d") if label is None else X.with_time(F.col("_d"), F.col(label))
    weight = F.when(X.is_float(last), F.expr("try_cast(_w AS double)")).otherwise(F.lit(1.0))
    return out.withColumn("_w", last).withColumn("weight", weight).withColumn("description", description).drop("_d", "_w", "fields")


def malformed(recs: DataFrame) -> DataFrame:
    """Records that name a kind but have too few fields; they are asked again."""
    short = (_field(1).contains("entity") & (F.size("fields") < 4)) | (~_field(1).contains("entity") & _field(1).contains("relationship") & (F.size("fields") < 5))
    return recs.where((F.size("fields") > 1) & short)


def ask(df: DataFrame, model: Callable[[list[str]], list[str]], prompt: str, out: str = "answer") -> DataFrame:
    """A model's answer to each prompt; the model is called once a batch."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: model(b[prompt].tolist())})

    return df.mapInPandas(run, f"{kinds}, `{out}` string")


def gleaned(first: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """First-round mentions and, of a second round, only names a chunk did not have."""
    return first.unionByName(more.join(first.select(*key).distinct(), key, "left_anti"))


def add_cache_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """``llm_cache_list`` with the new distinct ids of ``id, cache_id`` appended."""
    new = ids.groupBy("id").agg(F.array_sort(F.collect_set("cache_id")).alias("_new"))
    empty = F.array().cast("array<string>")
    merged = F.array_union(F.coalesce("llm_cache_list", empty), F.coalesce("_new", empty))
    return chunks.join(new, "id", "left").withColumn("llm_cache_list", merged).drop("_new")
