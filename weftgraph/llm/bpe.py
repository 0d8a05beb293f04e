"""Byte-level BPE encoding of a whole corpus (problem 6).

Method: pair occurrence index.  The distinct pre-tokens of a batch are laid out
as linked symbol arrays; every adjacent pair that the vocabulary can merge is
mapped to all its positions; active ranks are applied in ascending order and
only the lists of the neighbouring pairs are updated.

Results: one list of ids a row.  Null and empty texts give an empty list; the
strings of special tokens are ordinary text; long unbroken runs, control and
unassigned characters are encoded like any other bytes; lone surrogates, which
UTF-8 cannot hold, are encoded as U+FFFD.  Repeated rows are each encoded.
Columns of the input besides the key and the text are ignored.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabulary files; a parameter of every function here.
VOCABULARIES = os.environ.get("WEFT_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the public pre-tokenization pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern for ASCII texts, in classes that the faster standard module knows.
_SPACE = r" \t\n\r\x0b\x0c"
ASCII_PATTERN = rf"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^{_SPACE}A-Za-z0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Characters encoded together; bounds a worker's memory, not the result.
BATCH_CHARS = 4_000_000
#: Distinct pre-tokens remembered by a worker before it starts afresh.
CACHE_WORDS = 400_000
_loaded: dict[str, "Encoder"] = {}


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Encoder:
    """Encodes distinct pre-tokens in batches and remembers their ids."""

    def __init__(self, ranks: dict[bytes, int]):
        import re

        import regex

        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.byte_id = [ranks[bytes([i])] for i in range(256)]
        self.split_any = regex.compile(PATTERN).findall
        self.split_ascii = re.compile(ASCII_PATTERN).findall
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.known: dict[str, list[int]] = {}

    def _rank(self, a: int, b: int) -> int:
        """Rank of merging symbols a and b; -1 where they never merge."""
        r = self.pair_rank.get((a, b))
        if r is None:
            r = self.pair_rank[a, b] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return r

    def learn(self, words: list[str]) -> None:
        """Encode pre-tokens not known yet, all of them at once."""
        known, ranks, byte_id = self.known, self.ranks, self.byte_id
        sym: list[int] = [-1]
        spans: list[tuple[str, int, int]] = []
        for w in words:
            raw = w.encode("utf-8", "replace")
            whole = ranks.get(raw)
            if whole is not None:
                known[w] = [whole]
                continue
            at = len(sym)
            sym.extend([byte_id[c] for c in raw])
            spans.append((w, at, len(sym)))
            sym.append(-1)  # no pair reaches over a word's end
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, pair_rank = self._rank, self.pair_rank
        places: dict[int, list[int]] = {}
        for i in range(n - 1):
            a, b = sym[i], sym[i + 1]
            if a >= 0 and b >= 0:
                r = pair_rank.get((a, b))
                if r is None:
                    r = rank(a, b)
                if r >= 0:
                    if r in places:
                        places[r].append(i)
                    else:
                        places[r] = [i]
        active = list(places)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            for i in sorted(places.pop(r)):
                a = sym[i]
                if a < 0:
                    continue
                j = nxt[i]
                b = sym[j]
                if b < 0 or pair_rank.get((a, b)) != r:
                    continue  # one of the two has been merged since
                k = nxt[j]
                sym[i], sym[j] = r, -2
                nxt[i], prv[k] = k, i
                h = prv[i]
                for x, p, q in ((h, sym[h], r), (i, r, sym[k])):
                    if p >= 0 and q >= 0:
                        s = pair_rank.get((p, q))
                        if s is None:
                            s = rank(p, q)
                        if s >= 0:
                            if s in places:
                                places[s].append(x)
                            else:
                                places[s] = [x]
                                heapq.heappush(active, s)
        for w, at, end in spans:
            known[w] = [s for s in sym[at:end] if s >= 0]

    def encode(self, texts: list[str | None]) -> list[list[list[int]]]:
        """For each text the id lists of its pre-tokens."""
        words = [(self.split_ascii(t) if t.isascii() else self.split_any(t)) if t else [] for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        fresh = set().union(*words).difference(self.known)
        if fresh:
            self.learn(list(fresh))
        get = self.known.__getitem__
        return [list(map(get, w)) for w in words]


def encoder(data: bytes, key: str) -> Encoder:
    """The worker's encoder of a vocabulary, made once a process."""
    if key not in _loaded:
        _loaded[key] = Encoder(parse_ranks(data))
    return _loaded[key]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= BATCH_CHARS:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _vocabulary(df: DataFrame, name: str, folder: str):
    """The file's bytes, a broadcast of fixed size (under 1 MB)."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``key``, ``ids array<int>``: the token ids of every row's text."""
    from itertools import chain

    shared = _vocabulary(df, vocabulary, folder)
    name = f"{folder}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc = encoder(shared.value, name)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                per_text = enc.encode(texts[a:b])
                flat = np.fromiter(chain.from_iterable(chain.from_iterable(per_text)), dtype=np.int32)
                offsets = np.zeros(b - a + 1, dtype=np.int32)
                np.cumsum([sum(map(len, x)) for x in per_text], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], names=["k", "ids"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, ids array<int>")
    return out.select(F.col("k").alias(key), "ids")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``key``, ``n_tokens int``: as :func:`encode`, without shipping the ids."""
    shared = _vocabulary(df, vocabulary, folder)
    name = f"{folder}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value, name)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n: list[int] = []
            for a, b in _slices(texts):
                n += [sum(map(len, x)) for x in enc.encode(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], names=["k", "n"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, n int")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_tokens"))
