"""Files of local stores: id-keyed JSON, vector JSON and GraphML, read and written.

Such a file is one object, so one task parses it and its rows are spread again;
stores that outgrow a file are kept in Parquet tables (``weftgraph.tables``).
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _parsed(spark: SparkSession, path: str, parse: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text in b["value"]:
                rows = parse(text)
                for at in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[at : at + 10_000], columns=[c.split()[0] for c in schema.split(", ")])

    return spark.read.text(path, wholetext=True).mapInPandas(run, schema)


def json_kv(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """Rows of an object ``{id: {column: value}}``: the id and the columns of ``schema``."""
    rows = _parsed(spark, path, lambda t: [(k, json.dumps(v, ensure_ascii=False)) for k, v in json.loads(t).items()], f"{key} string, value string")
    return rows.select(key, F.from_json("value", schema).alias("v")).select(key, "v.*")


def vector_json(spark: SparkSession, path: str, schema: str = "") -> DataFrame:
    """``id, vector`` and the columns of ``schema`` of a vector store's file.

    The file holds ``embedding_dim``, ``data`` (a list of objects with ``__id__``)
    and ``matrix``, the vectors as base64 of little-endian float32 rows.
    """

    def parse(text: str) -> list[tuple]:
        import numpy as np

        whole = json.loads(text)
        x = np.frombuffer(base64.b64decode(whole["matrix"]), dtype="<f4").reshape(-1, int(whole["embedding_dim"]))
        return [(d["__id__"], v.tolist(), json.dumps(d, ensure_ascii=False)) for d, v in zip(whole["data"], x)]

    rows = _parsed(spark, path, parse, "id string, vector array<float>, value string")
    return rows.select("id", "vector", F.from_json("value", schema).alias("v")).select("id", "vector", "v.*") if schema else rows.drop("value")


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of a GraphML file: ``entity_name`` or ``src, tgt`` (src < tgt) and a map of attributes."""

    def parse(text: str) -> list[tuple]:
        from xml.etree import ElementTree

        root = ElementTree.fromstring(text)
        local = lambda e: e.tag.rsplit("}", 1)[-1]
        names = {k.get("id"): k.get("attr.name") for k in root if local(k) == "key"}
        out = []
        for e in (x for g in root if local(g) == "graph" for x in g):
            held = {names.get(d.get("key"), d.get("key")): d.text or "" for d in e if local(d) == "data"}
            if local(e) == "node":
                out.append((e.get("id"), None, held))
            elif local(e) == "edge":
                a, b = sorted((e.get("source"), e.get("target")))
                out.append((a, b, held))
        return out

    rows = _parsed(spark, path, parse, "a string, b string, attributes map<string,string>")
    nodes = rows.where("b IS NULL").select(F.col("a").alias("entity_name"), "attributes")
    return nodes, rows.where("b IS NOT NULL").select(F.col("a").alias("src"), F.col("b").alias("tgt"), "attributes")


def attributes(rows: DataFrame, schema: str) -> DataFrame:
    """Typed columns of the map ``attributes``; what cannot be read as its type is null."""
    cols = [c.split(None, 1) for c in schema.split(", ")]
    return rows.select(*[c for c in rows.columns if c != "attributes"], *[F.col("attributes")[n].try_cast(t).alias(n) for n, t in cols])


def jdbc_write(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 10_000, vector: str | None = None, **options: str) -> None:
    """Rows to a relational store, a connection a task; ``vector`` is written as text ``[x, y, ...]``."""
    if vector:
        df = df.withColumn(vector, F.concat(F.lit("["), F.array_join(vector, ","), F.lit("]")))
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).mode(mode).save()


#: Providers of stores by name: functions (spark, where, ...) -> DataFrame.  Callers add their own.
PROVIDERS: dict[str, Callable[..., DataFrame]] = {"json_kv": json_kv, "vector_json": vector_json}


def register(name: str, read: Callable[..., DataFrame]) -> None:
    """Add a provider; a name is taken once."""
    if name in PROVIDERS:
        raise ValueError(f"{name} is registered")
    PROVIDERS[name] = read


def provider(name: str) -> Callable[..., DataFrame]:
    """The provider of a name; unknown names list those that are known."""
    if name not in PROVIDERS:
        raise KeyError(f"{name}: known are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name]
