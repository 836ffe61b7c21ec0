"""Digests of whole sets of rows that no task has to hold."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of lines a piece.
PIECE = 1 << 20


def lines_sha256(df: DataFrame, line: Column, order: Column | None = None) -> str:
    """SHA-256 of the lines joined by line feeds, sorted by themselves or by ``order``; null lines are left out, and no lines give the empty text's.

    Ranges of the order join their lines by many tasks; what one task runs the digest over, from first to last, are long pieces in their order."""
    rows = df.select((line if order is None else order).alias("key"), line.cast("string").alias("line")).filter("line IS NOT NULL")
    rows = rows.repartitionByRange("key", "line").sortWithinPartitions("key", "line").select(F.spark_partition_id().alias("part"), "line")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number, part = [], 0, 0, 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array(["\n".join(held)])], ["part", "number", "text"])

        for b in batches:
            for p, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = p
                held.append(text)
                size += len(text)
                if size > PIECE:
                    yield piece()
                    held, size, number = [], 0, number + 1
        if held:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, first = hashlib.sha256(), True
        for b in batches:
            for text in b.column(0):
                running.update(text.as_buffer() if first else b"\n" + text.as_buffer().to_pybytes())
                first = False
        yield pa.RecordBatch.from_arrays([pa.array([running.hexdigest()])], ["sha256"])

    whole = rows.mapInArrow(pieces, "part int, number int, text string").repartition(1).sortWithinPartitions("part", "number").select("text")
    found = whole.mapInArrow(digest, "sha256 string").first()
    return found["sha256"] if found else hashlib.sha256().hexdigest()
