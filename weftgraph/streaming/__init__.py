"""Incremental ingest as a stream."""

from weftgraph.streaming.ingest import stream_folder

__all__ = ["stream_folder"]
