"""Shards: rows packed by the megabyte into one value, the unit that distributed passes address by name.

A pass that needs corpus-wide facts about its own text sends questions, combined within the shard, to buckets and
gets the answers back by shard name. A key that a third of all rows hold is then asked about once per shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .core import U64, column_bytes, tidy


def pack(documents: DataFrame, text: str, shard_bytes: int, sort_by: str | None = None) -> DataFrame:
    """(shard, size, batch): all columns of the rows, sorted within the shard, as one compressed Arrow stream. To be
    written before use: names follow the rows' place in the input, which another read may deal otherwise."""
    at_text, at_sort = documents.columns.index(text), documents.columns.index(sort_by) if sort_by else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        held, size, made = [], 0, 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            if at_sort is not None:
                table = table.take(pa.compute.sort_indices(table.column(at_sort), null_placement="at_end"))
            table, sink = table.combine_chunks(), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table)
            name = TaskContext.get().partitionId() << 32 | made
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["shard", "size", "batch"])

        for batch in batches:
            _, offsets = column_bytes(batch.column(at_text))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + shard_bytes - size, "right")) - 1)
                j = min(j, batch.num_rows)
                held.append(batch.slice(i, j - i))
                size += int(offsets[j] - offsets[i])
                i = j
                if size >= shard_bytes or i < batch.num_rows:
                    yield out()
                    held, size, made = [], 0, made + 1
        if held:
            yield out()

    return documents.mapInArrow(run, "shard long, size long, batch binary")


def unpack(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all().combine_chunks()


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets rise with the hash, so that answers joined in bucket order follow the sorted hashes."""
    return ((h >> U64(40)) * U64(buckets) >> U64(24)).astype(np.int64)


def bucket_cuts(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, first, end) of each bucket's part of sorted hashes."""
    b = bucket_of(h, buckets)
    first = np.flatnonzero(np.diff(b, prepend=-1))
    return b[first], first, np.append(first[1:], len(h))[: len(first)]  # no hashes, no buckets
