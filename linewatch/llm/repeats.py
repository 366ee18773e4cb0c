"""Exact repeated windows of texts: which places are covered by a window of ``length`` units that starts elsewhere too.

Units are words or bytes. All windows of a corpus are too many to compare, so

1. every window names an anchor: the place with the least k-gram hash among its first ``length - core`` + 1 places
   (winnowing). Equal windows name the same place, and all windows that name an anchor hold the ``core`` units after it.
2. an anchor whose core occurs once in the corpus has no repeated window; it is dropped.
3. an anchor's reach is the text under all windows that name it. Anchors with equal cores are grouped by reach: where a
   reach occurs twice, all its windows are repeats, and their text is covered at once.
4. only at the ends of a shared passage do reaches differ. There one anchor of each different reach of a core gives its
   windows one by one, and those that occur twice are covered.

Every step is a count of equal keys, so a passage with n copies costs n records and never n * n pairs. Keys are 64-bit
hashes of the units; places are identified by the row's content hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from linewatch.llm.common import row_id, schema_of, slices, stored, text_and, texts_of, whole_row
from linewatch.llm.exchange import KEY, MANY, blocks, bucket_count, bucket_of, find_many, mix, runs_of

#: Texts are taken in stretches of so many windows; a window's anchor depends on the window alone, so cuts change nothing.
STRETCH = 1_000_000
ANCHOR = np.dtype([KEY, ("row", "<i8"), ("span", "<u8"), ("more", "<u4"), ("place", "<u4"), ("high", "<u2"), ("low", "<u2"), MANY])
SPAN = np.dtype([KEY, ("row", "<i8"), ("start", "<u4"), ("end", "<u4"), MANY])
REACH = np.dtype([("row", "<i8"), ("place", "<u4"), ("high", "<u2"), ("low", "<u2")])
WINDOW = np.dtype([KEY, ("row", "<i8"), ("start", "<u4"), MANY])
FOUND = np.dtype([("row", "<i8"), ("start", "<u4"), ("end", "<u4")])
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def bytes_of(text: str | None) -> np.ndarray:
    """A 64-bit code for every byte of the text."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return table[np.frombuffer((text or "").encode(), np.uint8)]


class WordCodes(dict):
    """word -> 64-bit hash, found once a word."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def words_of(codes: WordCodes, text: str | None) -> np.ndarray:
    """A 64-bit code for every word: bytes.split() cuts at space and 0x09 to 0x0D and nowhere else."""
    found = (text or "").encode().split()
    return np.fromiter(map(codes.__getitem__, found), np.uint64, len(found))


class Rolling:
    """Hashes of any stretch of a code array in constant time."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        if len(Rolling.powers) < n + 1:
            size = max(n + 1, 2 * len(Rolling.powers))
            Rolling.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _BASE)]), dtype=np.uint64)
            Rolling.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _INVERSE)]), dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * Rolling.powers[:n], out=self.sums[1:])

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * Rolling.inverses[start])


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view("<u8")


def least_places(value: np.ndarray, reach: int) -> np.ndarray:
    """For each place p, the place of the least value in [p, p + reach], the leftmost among equals."""
    v = (value >> np.uint64(32) << np.uint64(32)) | np.arange(len(value), dtype=np.uint64)
    wide = 1
    while 2 * wide <= reach + 1:
        v = np.minimum(v[:-wide], v[wide:])
        wide *= 2
    rest = reach + 1 - wide
    if rest:
        v = np.minimum(v[:-rest], v[rest:])
    return (v & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchors(codes: np.ndarray, row: int, length: int, core: int, gram: int, first: int) -> Iterator[np.ndarray]:
    """Anchor records of one text. ``key`` is the hash of the first ``first`` units of the core; ``more`` is a 32-bit
    hash of the rest of the core, where ``first`` is shorter than it."""
    reach = length - core
    for low in range(0, len(codes) - length + 1, STRETCH):
        part = codes[low : low + STRETCH + length - 1]
        windows = len(part) - length + 1
        rolling = Rolling(part)
        chosen = least_places(rolling.at(np.arange(windows + reach), gram), reach)
        starts, counts = runs_of(chosen)
        place = chosen[starts]
        out = np.zeros(len(starts), ANCHOR)
        high, least = place - starts, place - (starts + counts - 1)
        out["key"], out["row"], out["place"], out["high"], out["low"] = rolling.at(place, first), row, low + place, high, least
        span = rolling.at(starts, counts - 1 + length)
        out["span"] = mix(span + high.astype(np.uint64) * _BASE + least.astype(np.uint64))
        if first < core:
            out["more"] = rolling.at(place + first, core - first) >> np.uint64(32)
        yield out


def anchor_table(r: np.ndarray) -> pa.Table:
    """Anchors with equal core and reach as one row: how many, the least of them, and where their reaches lie."""
    r = r[np.lexsort((r["place"], r["row"], r["span"], r["key"]))]
    new = np.append(True, (r["key"][1:] != r["key"][:-1]) | (r["span"][1:] != r["span"][:-1]))[: len(r)]
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(r)))
    reach = np.empty(len(r), REACH)
    reach["row"], reach["place"], reach["high"], reach["low"] = r["row"], r["place"], r["high"], r["low"]
    head = r[starts]
    columns = {n: pa.array(np.ascontiguousarray(head[n]).view("<i8")) for n in ("key", "span")}
    columns["more"] = pa.array(head["more"].astype(np.int64))
    columns["n"] = pa.array(counts, pa.int64())
    columns |= {"row": pa.array(np.ascontiguousarray(head["row"]))}
    columns |= {n: pa.array(head[n].astype(np.int32)) for n in ("place", "high", "low")}
    columns["members"] = pa.array([reach[a : a + k].tobytes() for a, k in zip(starts.tolist(), counts.tolist())], pa.binary())
    return pa.table(columns)


ANCHOR_SCHEMA = "key long, span long, more long, n long, row long, place int, high int, low int, members binary"


def identified(docs: DataFrame, with_document: bool = False) -> DataFrame:
    """doc_id, text and row: the content hash that names a row in all steps; with the struct of all columns if asked."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[whole_row(docs)] * with_document)
    return rows.withColumn("row", row_id())


def shared_anchors(rows: DataFrame, unit: str, length: int, core: int, gram: int, first: int) -> DataFrame:
    """The anchors of all texts whose first ``first`` units occur at more than one anchor; those of a bucket with equal reach in one row."""

    def make(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        codes = WordCodes()
        for text, row in zip(batch.column("text"), batch.column("row").to_pylist()):
            t = text.as_py()
            yield from anchors(words_of(codes, t) if unit == "words" else bytes_of(t), row, length, core, gram, first)

    return find_many(rows.select("text", "row"), make, ANCHOR, anchor_table, ANCHOR_SCHEMA, bucket_count(rows))


def covered_spans(rows: DataFrame, seeds: DataFrame, unit: str, length: int) -> DataFrame:
    """row, spans (disjoint, in order, in units): what repeated windows cover, from seeds with equal cores in ``key``."""
    classes, _ = stored(
        seeds.groupBy("key", "span").agg(F.sum("n").alias("n"), F.min(F.struct("row", "place", "high", "low")).alias("one")), "repeats-classes"
    )
    differing = classes.groupBy("key").agg(F.count("*").alias("spans"), F.min("n").alias("least")).where("spans > 1 and least = 1").select("key")
    asked = classes.join(differing, "key").select("one.*").groupBy("row").agg(F.collect_list(F.struct("place", "high", "low")).alias("asked"))
    buckets = bucket_count(rows)

    def reaches(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        """The whole reach of every seed."""
        for part in slices([batch], 20_000):
            members = [np.frombuffer(x.as_buffer(), REACH) for x in part.column("members")]
            if members:
                m = np.concatenate(members)
                counts = [len(x) for x in members]
                out = np.zeros(len(m), SPAN)
                out["key"] = np.repeat(mix(unsigned(part.column("span").to_numpy()) + mix(unsigned(part.column("key").to_numpy()))), counts)
                out["row"], out["start"] = m["row"], m["place"] - m["high"]
                out["end"] = m["place"] - m["low"] + np.uint32(length)
                yield out

    def windows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        """Single windows of the seeds that are asked for."""
        codes = WordCodes()
        for text, row, wanted in zip(batch.column("text"), batch.column("row").to_pylist(), batch.column("asked").to_pylist()):
            t = text.as_py()
            part = words_of(codes, t) if unit == "words" else bytes_of(t)
            starts = np.unique(np.concatenate([np.arange(a["place"] - a["high"], a["place"] - a["low"] + 1) for a in wanted]))
            out = np.zeros(len(starts), WINDOW)
            at = 0
            for low in range(0, len(part), STRETCH):
                mine = starts[(starts >= low) & (starts < low + STRETCH)]
                if len(mine):
                    out["key"][at : at + len(mine)] = Rolling(part[low : low + STRETCH + length]).at(mine - low, length)
                    at += len(mine)
            out["row"], out["start"] = row, starts
            yield out

    def by_row(r: np.ndarray) -> pa.Table:
        """Spans that occur more than once, on their way to their rows; equal rows' spans once."""
        out = np.empty(len(r), FOUND)
        out["row"], out["start"] = r["row"], r["start"]
        out["end"] = r["end"] if "end" in r.dtype.names else r["start"] + np.uint32(length)
        out = out[np.lexsort((out["end"], out["start"], out["row"]))]
        out = out[np.append(True, out[1:] != out[:-1])[: len(out)]]
        return pa.Table.from_batches([blocks(bucket_of(mix(unsigned(out["row"])), buckets), out)])

    def joined_up(group: pa.Table) -> pa.Table:
        r = np.concatenate([np.frombuffer(x.as_buffer(), FOUND) for x in group.column("block")])
        r = r[np.lexsort((r["start"], r["row"]))]
        starts, counts = runs_of(r["row"])
        names, spans = [], []
        for a, n in zip(starts.tolist(), counts.tolist()):
            begin, end = r["start"][a : a + n].astype(np.int64), np.maximum.accumulate(r["end"][a : a + n].astype(np.int64))
            first = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
            last = np.append(first[1:], n) - 1
            names.append(int(r["row"][a]))
            spans.append([{"start": x, "end": y} for x, y in zip(begin[first].tolist(), end[last].tolist())])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table({"row": pa.array(names, pa.int64()), "spans": pa.array(spans, kind)})

    found = [
        find_many(source, make, kind, by_row, "bucket int, block binary", buckets)
        for source, make, kind in (
            (seeds.select("key", "span", "members"), reaches, SPAN),
            (rows.select("row", "text").join(asked, "row"), windows, WINDOW),
        )
    ]
    return found[0].unionByName(found[1]).groupBy("bucket").applyInArrow(joined_up, "row long, spans array<struct<start:int,end:int>>")


def with_spans(rows: DataFrame, spans: DataFrame, make: Callable[[str, list[tuple[int, int]]], tuple], schema: str, key: str = "doc_id") -> DataFrame:
    """``key`` and what ``make`` says of each row's text and spans; ``schema`` names the columns of ``make``."""
    names = [f.name for f in StructType.fromDDL(schema)]
    kinds = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [make(t or "", [(x["start"], x["end"]) for x in s or ()]) for t, s in zip(texts_of(b), b.column("spans").to_pylist())]
            columns = [pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(key), *columns], names=[key, *names])

    return rows.join(spans, "row", "left").select(*text_and([key]), "spans").mapInArrow(run, schema_of(rows, [key], schema))
