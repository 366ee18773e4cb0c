"""Bytes under a string of ``length`` bytes that also starts elsewhere, by ranks of sampled positions.

Prefix doubling over all positions sorts a rank pair for every byte of text in every round, more than the disk that the text
may cost (figures in the README). So this is the anchor method of ``linewatch.llm.repeats`` with a round of doubling in front: the
positions are a winnowed sample of the suffixes. A position starts with the rank of its first 128 bytes, and those with
a unique rank are dropped; a round pairs the rank with that of the 128 bytes behind, sorts the pairs, gives equal pairs
one rank and drops the positions whose pair is unique, so that the ranks tell 256 bytes. Positions that are still not unique
lie in a shared string of 256 bytes; where their shared strings pass the threshold is settled to the byte by whole reaches
and, at their ends, window by window. Ranks are names: they need not keep the order of the strings, as only equality counts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewatch.llm.common import drop_stored, stored
from linewatch.llm.repeats import covered_spans, identified, shared_anchors, with_spans

FIRST = 128
LEAST = 320


def rerank(positions: DataFrame, block: Column) -> tuple[DataFrame, str]:
    """One doubling round: rank pairs (``key``, ``block``) that occur once go; the others' pairs become the new ``key``."""
    paired = positions.withColumn("block", block)
    # written first, so that both sides of the join are plain shuffles and Spark can split a pair that very many positions have
    shared, path = stored(paired.groupBy("key", "block").agg(F.sum("n").alias("times")).where("times > 1").select("key", "block"), "suffix-pairs")
    kept = paired.join(shared, ["key", "block"])
    out = stored(kept.withColumn("key", F.xxhash64("key", "block")).drop("block"), "suffix-ranks")
    drop_stored(positions.sparkSession, path)
    return out


def repeated_byte_spans(docs: DataFrame, length: int = 400, gram: int = 16) -> tuple[DataFrame, DataFrame]:
    """The identified rows, and for rows with repeats: row, spans (start, end in UTF-8 bytes; disjoint, in order).

    A span is covered by strings of ``length`` bytes (320 at least) that start at another place too, in any row, the same
    included. Null and empty texts and those shorter than ``length`` bytes have no spans.
    """
    if length < LEAST:
        raise ValueError(f"length must be {LEAST} bytes at least")
    spark, rows = docs.sparkSession, identified(docs)
    first, one = stored(shared_anchors(rows, "bytes", length, 2 * FIRST, gram, FIRST), "suffix-ranks")
    second, _ = rerank(first, F.col("more"))
    drop_stored(spark, one)
    return rows, covered_spans(rows, second, "bytes", length)


def remove_repeated_bytes(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (byte spans of maximal removed runs), for every row."""

    def cut(text: str, spans: list[tuple[int, int]]) -> tuple:
        raw, digest, at = text.encode(), hashlib.sha256(), 0
        for a, b in spans:
            digest.update(raw[at:a])
            at = b
        digest.update(raw[at:])
        return len(raw), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), [{"start": a, "end": b} for a, b in spans]

    rows, spans = repeated_byte_spans(docs, length)
    return with_spans(rows, spans, cut, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:int,end:int>>")
