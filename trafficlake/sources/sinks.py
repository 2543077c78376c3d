"""Sinks: audit JSON lines, and a stream export that stays silent when there is nothing to report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

# Key order of an audit line; ``stats`` follows only when there are any.
AUDIT_KEYS = [
    "timestamp", "outcome", "fail_open", "route", "backend", "tool", "pii_context", "input_chars", "output_chars", "elapsed",
]


def audit_lines(audit: DataFrame) -> DataFrame:
    """One JSON text per audit event in stable key order."""
    fields = [F.col(k) for k in AUDIT_KEYS]
    stats = F.when(F.size("stats") > 0, F.col("stats")).alias("stats")
    return audit.select(F.to_json(F.struct(*fields, stats), {"ignoreNullFields": "true"}).alias("value"))


def write_audit_events(audit: DataFrame, path: str, mode: str = "append") -> None:
    audit_lines(audit).write.mode(mode).text(path)


def export_nonempty(stream: DataFrame, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A stream writer that calls ``sink`` only for micro-batches holding rows; the batch is computed once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write)
