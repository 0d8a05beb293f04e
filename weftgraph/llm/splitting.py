"""Splitting oversized items at natural boundaries (problem 4).

Method: token offset prefix sums with a sorted boundary array; the last boundary
under the limit is found by binary search, the next piece steps back by the
overlap, and a hard cut is the fallback.

A token is one character of U+4E00-U+9FFF or a maximal run of other characters
without space, tab, CR and LF.  A boundary lies after a token that ends a
paragraph, a line, a table row or a sentence.

Results: one row a piece, pieces numbered from 0 within their row.  A piece is
an unbroken substring of the content that starts and ends with a token, so its
``tokens`` is exact; consecutive pieces share at most ``overlap`` tokens (fewer
where a boundary lies closer), together they hold every token, and a text
within the limit is one piece.  A text without any boundary is cut hard at the
limit.  Null, empty and blank texts give no piece.  Repeated rows are each
split.  The stored token count is never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 600, 100
#: Tokens shared at least where an overlap is asked for.
LEAST_OVERLAP = 20
TOKEN = re.compile("[一-鿿]|[^一-鿿 \t\r\n]+")
_FULL_STOP = re.compile("[。！？；]")


def boundaries(text: str, starts, ends):
    """Sorted counts of tokens before each natural boundary (without 0)."""
    import numpy as np

    n = len(starts)
    hit = np.zeros(n, dtype=bool)
    find = text.find
    # A line end anywhere between a token and the next one.
    for mark in "\n\r":
        at = find(mark)
        if at >= 0:
            places = []
            while at >= 0:
                places.append(at)
                at = find(mark, at + 1)
            i = np.searchsorted(starts, np.asarray(places), side="left") - 1
            hit[i[i >= 0]] = True
    for m in re.finditer(r"[.!?…][\"')\]”’»]*(?=[ \t])|</tr>(?=[ \t\r\n])|\)##", text, re.I):
        i = int(np.searchsorted(ends, m.end(), side="left"))
        if i < n and ends[i] == m.end():
            hit[i] = True
    for m in _FULL_STOP.finditer(text):
        i = int(np.searchsorted(ends, m.end(), side="left"))
        if i < n and ends[i] == m.end():
            hit[i] = True
    hit[n - 1] = True
    return np.flatnonzero(hit) + 1


def cuts(n: int, bounds, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Token spans [a, b) of the pieces of n tokens.

    A piece begins at the first boundary within the overlap, unless fewer than
    ``LEAST_OVERLAP`` tokens would then be shared (or all of a smaller overlap).
    """
    import numpy as np

    out: list[tuple[int, int]] = []
    start = done = 0
    while done < n:
        if n - start <= limit:
            out.append((start, n))
            break
        i = int(np.searchsorted(bounds, start + limit, side="right")) - 1
        end = int(bounds[i]) if i >= 0 and bounds[i] > done else start + limit
        out.append((start, end))
        done = end
        back = max(end - overlap, start + 1)
        j = int(np.searchsorted(bounds, back, side="left"))
        start = int(bounds[j]) if j < len(bounds) and bounds[j] <= end - min(LEAST_OVERLAP, end - back) and bounds[j] < end else back
    return out


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[str, int]]:
    """(piece, tokens) of one text."""
    import numpy as np

    spans = [m.span() for m in TOKEN.finditer(text)]
    if not spans:
        return []
    if len(spans) <= limit:
        return [(text[spans[0][0] : spans[-1][1]], len(spans))]
    arr = np.asarray(spans)
    bounds = boundaries(text, arr[:, 0], arr[:, 1])
    return [(text[spans[a][0] : spans[b - 1][1]], b - a) for a, b in cuts(len(spans), bounds, limit, overlap)]


def split_long(df: DataFrame, key: str = "chunk_row", content: str = "content", limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """``key, chunk_order_index int, tokens int, content string`` for every row of more than ``limit`` tokens.

    A text of at most ``limit`` characters cannot hold more tokens, so those rows
    never leave the JVM.  ``with_text=False`` returns null contents.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TOKEN.findall
        for batch in batches:
            which, order, tokens, texts = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if len(count(text)) <= limit:
                    continue
                for k, (piece, n) in enumerate(split_text(text, limit, overlap)):
                    which.append(i)
                    order.append(k)
                    tokens.append(n)
                    texts.append(piece if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which, pa.int64())), pa.array(order, pa.int32()), pa.array(tokens, pa.int32()), pa.array(texts, pa.string())],
                names=["k", "o", "n", "t"],
            )

    kind = df.schema[key].dataType.simpleString()
    long = df.select(F.col(key).alias("k"), F.col(content).cast("string").alias("t")).where(F.length("t") > limit)
    out = long.mapInArrow(run, f"k {kind}, o int, n int, t string")
    return out.select(F.col("k").alias(key), F.col("o").alias("chunk_order_index"), F.col("n").alias("tokens"), F.col("t").alias("content"))
