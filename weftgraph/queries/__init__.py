"""Registered queries of the core operators and their SQL."""

from types import SimpleNamespace


def modules() -> list:
    from weftgraph.queries import discover, graph, ingest, maintain, retrieve, stores

    found = [stores, ingest, graph, retrieve, maintain, discover]
    return [SimpleNamespace(queries=lambda q=m.q: dict(q.fns), oracle_sql=lambda q=m.q: dict(q.sql)) for m in found]
