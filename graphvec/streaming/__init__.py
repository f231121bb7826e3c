"""Streaming ingest into a mutable graph: each micro-batch is one commit."""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.store import GraphStore


def ingest_nodes(store: GraphStore, stream: DataFrame, checkpoint: str, shape: Callable[[DataFrame], DataFrame] | None = None) -> DataStreamWriter:
    """A writer that appends the stream's rows (label, props, after ``shape``) as nodes."""
    return _ingest("nodes", store, stream, checkpoint, shape)


def ingest_edges(store: GraphStore, stream: DataFrame, checkpoint: str, shape: Callable[[DataFrame], DataFrame] | None = None) -> DataStreamWriter:
    """A writer that appends the stream's rows (src, dst, label, props, after ``shape``) as edges of nodes that exist."""
    return _ingest("edges", store, stream, checkpoint, shape)


def _ingest(kind: str, store: GraphStore, stream: DataFrame, checkpoint: str, shape: Callable[[DataFrame], DataFrame] | None) -> DataStreamWriter:
    """Each commit names its stream and batch, so that a batch that is run again after a failure adds nothing."""

    def commit(batch: DataFrame, number: int) -> None:
        rows = shape(batch) if shape else batch
        if not rows.isEmpty():
            store.refresh().bulk_load(**{kind: rows}, batch=(checkpoint, number))

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
