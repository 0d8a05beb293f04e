"""Chunking: token windows, splits by a character, complete tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import text as X
from weftgraph.operators.stores import latest

WINDOW, OVERLAP, TABLE_CONTEXT = 1200, 100, 100
#: Characters of context a table gets for each token of context.
CHARS_A_TOKEN = 4


def windows(tokens: Column, most: int, overlap: int) -> Column:
    """Array of ``(tokens, content)`` structs of ``spans``; windows that only repeat the overlap are kept."""
    step = most - overlap
    n = F.size(tokens)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(F.least(F.lit(most), n - s).alias("tokens"), X.joined(F.slice(tokens, s + 1, most)).alias("content")))


def fixed_windows(df: DataFrame, key: str, text: str, most: int = WINDOW, overlap: int = OVERLAP, tokenizer: X.Tokenizer | None = None) -> DataFrame:
    """``key, chunk_order_index, tokens, content``: overlapping windows, each an unbroken stretch of the text.

    Tokens are the default ones, found in the JVM, or a caller's.
    """
    if not 0 <= overlap < most:
        raise ValueError("overlap must be at least 0 and below the window")
    if tokenizer is not None:
        return _pieces_of(df, key, text, lambda t: [(n, c) for n, c in token_windows(t, most, overlap, tokenizer)])
    # Tokens are found once a text and sliced after the windows are exploded.
    t = df.select(F.col(key), X.spans(F.col(text)).alias("_t")).where(F.size("_t") > 0)
    s = t.select(key, "_t", F.posexplode(F.sequence(F.lit(0), F.size("_t") - 1, F.lit(most - overlap))).alias("chunk_order_index", "_s"))
    content = X.joined(F.slice("_t", F.col("_s") + 1, F.lit(most)))
    return s.select(key, "chunk_order_index", F.least(F.lit(most), F.size("_t") - F.col("_s")).alias("tokens"), content.alias("content"))


def token_windows(text: str, most: int, overlap: int, tokenizer: X.Tokenizer = X.default_spans) -> list[tuple[int, str]]:
    """``(tokens, content)`` of the windows of one text."""
    at = tokenizer(text)
    cut = [at[i : i + most] for i in range(0, len(at), most - overlap)]
    return [(len(w), text[w[0][0] : w[-1][1]]) for w in cut]


def _pieces_of(df: DataFrame, key: str, text: str, cut: Callable[[str], list[tuple[int, str]]]) -> DataFrame:
    """``key, chunk_order_index, tokens, content`` of a function over texts; null and empty texts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, j, n, c) for i, t in enumerate(batch.column(1).to_pylist()) if t for j, (n, c) in enumerate(cut(t))]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names=["k", "o", "n", "c"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, o int, n int, c string").toDF(key, "chunk_order_index", "tokens", "content")


def chunked(df: DataFrame, key: str, text: str, chunker: Callable[[str], list[str]], tokenizer: X.Tokenizer | None = None) -> DataFrame:
    """``key, chunk_order_index, tokens, content`` by a caller's chunking function."""
    count = tokenizer or X.default_spans
    return _pieces_of(df, key, text, lambda t: [(len(count(c)), c) for c in chunker(t)])


def by_character(df: DataFrame, key: str, text: str, mark: str, most: int = WINDOW, overlap: int = OVERLAP, only: bool = False) -> DataFrame:
    """Parts between a mark; oversized parts are windowed unless ``only``; empty parts stay."""
    parts = F.split(F.col(text), "\\Q" + mark + "\\E", -1)
    whole = lambda p: F.array(F.struct(X.n_words(p).alias("tokens"), X.strip(p).alias("content")))
    cut = whole if only else lambda p: F.when(X.n_words(p) > most, windows(X.spans(p), most, overlap)).otherwise(whole(p))
    chunks = df.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(F.flatten(F.transform(parts, cut))).alias("chunk_order_index", "c"))
    return chunks.select(key, "chunk_order_index", "c.tokens", "c.content")


_TABLE = re.compile(r"<table[^>]*>.*?</table>", re.I | re.S)


def cut_tables(text: str, most: int, overlap: int, context: int, tokenizer: X.Tokenizer = X.default_spans) -> list[tuple[int, str, bool, bool]]:
    """``(tokens, content, is table, complete)`` with the tables before the text around them."""
    spans = [m.span() for m in _TABLE.finditer(text)]

    def pieces(part: str) -> list[tuple[int, str, bool, bool]]:
        return [(n, c, False, False) for n, c in token_windows(part, most, overlap, tokenizer)]

    if not spans:
        return pieces(text)
    reach = context * CHARS_A_TOKEN
    held: list[tuple[int, int]] = []
    for i, (a, b) in enumerate(spans):
        left, right = max(0, a - reach), min(len(text), b + reach)
        if i and left < spans[i - 1][1]:
            left = spans[i - 1][1] + 1
        if i + 1 < len(spans) and right > spans[i + 1][0]:
            right = spans[i + 1][0] - 1
        held.append((min(left, a), max(right, b)))
    out = []
    for a, b in held:
        body = text[a:b]
        out.append((len(tokenizer(body)), body.strip(), True, body.count("<table") == 1 == body.count("</table>")))
    at = 0
    for a, b in sorted(held):
        out += pieces(text[at:a]) if at < a else []
        at = b
    return out + pieces(text[at:])


def with_tables(df: DataFrame, key: str, text: str, most: int = WINDOW, overlap: int = OVERLAP, context: int = TABLE_CONTEXT, tokenizer: X.Tokenizer | None = None) -> DataFrame:
    """Table-aware chunks: every table whole with its context, then the text between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, j, *c) for i, t in enumerate(batch.column(1).to_pylist()) if t for j, c in enumerate(cut_tables(t, most, overlap, context, tokenizer or X.default_spans))]
            cols = list(zip(*rows)) if rows else [[]] * 6
            arrays = [pa.array(c, k) for c, k in zip(cols[1:], (pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *arrays], names=["k", "o", "n", "c", "t", "w"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, o int, n int, c string, t boolean, w boolean")
    return out.toDF(key, "chunk_order_index", "tokens", "content", "contains_table", "table_complete")


def materialize(chunks: DataFrame, doc: str, path: str) -> DataFrame:
    """Chunk rows keyed by content: of equal chunks the last in (document, order) stays."""
    keyed = chunks.select(X.record_id("chunk-", F.col("content")).alias("id"), "content", "tokens", "chunk_order_index", F.col(doc).alias("full_doc_id"), F.col(path).alias("file_path"))
    return latest(keyed, "id", F.desc("full_doc_id"), F.desc("chunk_order_index"))


def occurrences(df: DataFrame, chunk: str, order: Column) -> DataFrame:
    """First occurrence of each chunk with its number of occurrences."""
    w = Window.partitionBy(chunk).orderBy(order)
    counts = df.groupBy(chunk).agg(F.count(F.lit(1)).alias("occurrences"))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn").join(counts, chunk)
