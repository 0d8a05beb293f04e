"""Injected model functions, query parameters and engine configuration.

The engine never calls a provider itself: generation, embedding and reranking
are plain callables over lists, so that a batch is one call.  The stubs are
deterministic and serve tests and dry runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

Generate = Callable[[list[str]], list[str]]
Embed = Callable[[list[str]], list[list[float]]]
Rerank = Callable[[str, list[str]], list[float]]
Tokenize = Callable[[str], list[tuple[int, int]]]
Chunk = Callable[[str], list[str]]


@dataclass(frozen=True)
class QueryParam:
    """One query's settings."""

    mode: str = "mix"  # local, global, hybrid, mix, naive or bypass
    only_need_context: bool = False
    only_need_prompt: bool = False
    response_type: str = "Multiple Paragraphs"
    top_k: int = 40
    chunk_top_k: int = 20
    max_entity_tokens: int = 30_000
    max_relation_tokens: int = 30_000
    max_total_tokens: int = 120_000
    hl_keywords: tuple[str, ...] = ()
    ll_keywords: tuple[str, ...] = ()
    #: Earlier messages, (role, text) in order, and how many pairs of them the prompt tells.
    conversation: tuple[tuple[str, str], ...] = ()
    history_turns: int = 0
    user_prompt: str = ""
    enable_rerank: bool = True
    max_hop: int = 1
    top_neighbors: int = 10
    multi_hop_relevance_threshold: float = 0.2
    top_ppr_nodes: int = 50
    top_fastrp_nodes: int = 0
    enable_recognition: bool = False
    recognition_batch_size: int = 10
    context_format: str = "markdown"
    related_chunk_number: int = 5

    def digest(self, query: str) -> str:
        """Cache key over the query and every setting."""
        return hashlib.md5((query + repr(self)).encode()).hexdigest()


@dataclass(frozen=True)
class Config:
    """The engine's settings; not Spark configuration."""

    workspace: str = "default"
    chunk_tokens: int = 1200
    chunk_overlap: int = 100
    cosine_threshold: float = 0.2
    fastrp_dim: int = 256
    pagerank_iterations: int = 50
    merge_threshold: float = 0.8
    merge_rounds: int = 3
    #: Further rounds in which the extraction model is asked for what it missed.
    glean_rounds: int = 0
    entity_types: tuple[str, ...] = ("Person", "Organization", "Location", "Event", "Concept")
    #: Buckets of the store's tables; fixed when a table is first written.
    buckets: int = 16
    generate: Generate = field(default=lambda prompts: [""] * len(prompts))
    embed: Embed = field(default=lambda texts: hashed_vectors(texts))
    rerank: Rerank | None = None
    #: Without these the step is left out: summaries of long descriptions, keywords of a query,
    #: descriptions of names that no record describes, filtering of retrieved relations, and
    #: judging whether two similar names are one.
    summarize: Generate | None = None
    keywords: Generate | None = None
    describe: Generate | None = None
    recognize: Generate | None = None
    decide: Generate | None = None
    #: Places of the tokens of a text, and a chunking function, instead of the default ones.
    tokenize: Tokenize | None = None
    chunker: Chunk | None = None


def hashed_vectors(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Bag-of-words vectors by hashing: equal words give similar texts."""
    out = []
    for t in texts:
        v = [0.0] * dim
        for w in (t or "").lower().split():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
            v[h % dim] += 1.0 if h >> 63 else -1.0
        out.append(v)
    return out


def record_extractor(prompts: list[str]) -> list[str]:
    """A stub of the extraction model: capitalised words are entities, neighbours are related."""
    import re

    out = []
    for p in prompts:
        names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]{3,}\b", p or "")))
        lines = [f"(entity<|>{n}<|>concept<|>{n} is mentioned)" for n in names]
        lines += [f"(relationship<|>{a}<|>{b}<|>near<|>{a} stands near {b})" for a, b in zip(names, names[1:])]
        out.append("##".join(lines) + "<|COMPLETE|>")
    return out
