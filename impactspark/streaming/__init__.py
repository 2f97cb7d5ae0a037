"""Indexing of a stream of documents."""

from impactspark.streaming.ingest import current, ingest

__all__ = ["current", "ingest"]
