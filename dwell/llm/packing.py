"""Arrays of fixed-size records as binary rows, dealt into buckets.

A record of a few integers as a Spark row costs several times its size; tasks therefore hand over
arrays of records, one binary row for each bucket and flush. Buckets, not keys, are shuffled: their
number follows the input's size, so a bucket fits a task. What many records have in common is
reduced before the shuffle, in each task, so a hot key sends a record or two per flush.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLUSH = 1_000_000          # records a task gathers before it hands them over
BUCKET_BYTES = 24_000_000  # of input text for each bucket
NULL_ID = -(1 << 63)       # stands for a null id: before every other


def row_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NULL_ID))


def text_tag(text: Column) -> Column:
    """Tells rows of the same id apart by their texts (null: empty)."""
    return F.xxhash64(F.coalesce(text.cast("binary"), F.lit(b"")))


def n_buckets(docs: DataFrame, text_col: str) -> int:
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    return max(1, -(-size // BUCKET_BYTES))


def grouped(records: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, its records) in order of the key; records keep their order."""
    order = np.argsort(key, kind="stable")
    key, records = key[order], records[order]
    for part in np.split(np.arange(len(key)), np.flatnonzero(key[1:] != key[:-1]) + 1):
        if len(part):
            yield key[part[0]], records[part[0]:part[-1] + 1]


def runs_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[object, list[pa.RecordBatch]]]:
    """Consecutive rows of a sorted partition with the same value, over batch borders."""
    now, held = None, []
    for batch in batches:
        values = np.asarray(batch.column(column))
        starts = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)])) if len(values) else [0]
        for a, b in zip(starts, starts[1:]):
            if held and values[a] != now:
                yield now, held
                held = []
            now = values[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held


def blobs(batches: list[pa.RecordBatch], column: str, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(v for b in batches for v in b.column(column).to_pylist()), dtype=kind)
