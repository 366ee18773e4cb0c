"""Finding keys that occur more than once among very many fixed-width records.

Tasks hand over sorted numpy records in binary blocks, one row per bucket of the key space, which takes a fraction of the
bytes and time of one row per record. Before that, a task combines its own records: of a key that it has seen twice, one
record goes to the key's bucket, marked, and the others, marked too, are spread over all buckets. So a bucket gets a few
records of a key from each task at most, however often the key occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Every record type has these fields; ``many`` says that the key is known to occur more than once.
KEY, MANY = ("key", "<u8"), ("many", "u1")
FLUSH = 300_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bucket_count(df: DataFrame) -> int:
    """Buckets for a shuffle: one for each shuffle partition of the session, which is to be set by the size of the data."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def runs_of(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every run of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(sorted_keys)))


def blocks(bucket: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """One row (bucket, block) for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    starts, lengths = runs_of(bucket)
    cut = [records[a : a + n].tobytes() for a, n in zip(starts.tolist(), lengths.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array(cut, pa.binary())], names=["bucket", "block"])


def mark_many(records: np.ndarray) -> np.ndarray:
    """Per record of the sorted array: whether its key occurs more than once here, or is marked."""
    starts, lengths = runs_of(records["key"])
    many = (lengths > 1) | (np.maximum.reduceat(records["many"], starts) > 0)
    return np.repeat(many, lengths)


def find_many(
    rows: DataFrame,
    make: Callable[[pa.RecordBatch], Iterator[np.ndarray]],
    dtype: np.dtype,
    give: Callable[[np.ndarray], pa.Table],
    schema: str,
    buckets: int,
    mark: Callable[[np.ndarray], np.ndarray] = mark_many,
    unique: tuple[str, ...] = (),
) -> DataFrame:
    """``give`` of all records whose key occurs more than once, in bucket-sized groups.

    ``make`` yields record arrays for an input batch. ``mark`` tells for records sorted by key which of them count as many;
    it is asked within a task first and within a bucket then. Of records equal in key and the fields ``unique``
    (if any) one stays.
    """

    def in_order(parts: list[np.ndarray]) -> np.ndarray:
        r = np.concatenate(parts)
        if not unique:
            return r[np.argsort(r["key"], kind="stable")]
        r = r[np.lexsort((r["many"], *(r[n] for n in unique), r["key"]))]
        same = np.logical_and.reduce([r[n][1:] == r[n][:-1] for n in ("key", *unique)])
        return r[np.append(~same, True)]  # the last of equals has the mark if any has

    def combine(waiting: list[np.ndarray]) -> pa.RecordBatch:
        r = in_order(waiting)
        many = mark(r)
        r["many"] |= many
        again = np.concatenate([[False], r["key"][1:] == r["key"][:-1]]) & many
        spread = mix(r["key"] + np.arange(len(r), dtype=np.uint64))
        return blocks(bucket_of(np.where(again, spread, r["key"]), buckets), r)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for b in batches:
            for r in make(b):
                waiting.append(r)
                n += len(r)
                if n >= FLUSH:
                    yield combine(waiting)
                    waiting, n = [], 0
        if n:
            yield combine(waiting)

    def receive(group: pa.Table) -> pa.Table:
        r = in_order([np.frombuffer(x.as_buffer(), dtype) for x in group.column("block")])
        return give(r[mark(r)])

    return rows.mapInArrow(send, "bucket int, block binary").groupBy("bucket").applyInArrow(receive, schema)
