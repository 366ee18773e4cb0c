"""Mixture-controlled packing of token streams into fixed windows by deficit round-robin over source queues.

Every source is a queue of its documents' tokens. A turn serves one quantum of a queue; the next turn belongs to the queue
that lags most behind its target share, so deficits carry over from window to window. The turn order has a closed form: turn
j of a queue with weight w falls at time (2j + 1) / w, so any task can place any quantum by counting the turns before it,
and deficits carry across partitions without a pass over the schedule.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewatch.llm.common import stored
from linewatch.llm.pretokens import UnitCache, encode_each

#: Rows of the offsets table that may be broadcast (about 40 bytes a row).
MOST_BROADCAST_ROWS = 1_000_000
#: Sources that a mixture can have: the driver holds a number for each, and the schedule's work grows with their square.
MOST_SOURCES = 10_000


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file -> the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenizerFile:
    """Encodes by a byte-level BPE ``tokenizer.json`` whose ids are merge ranks; added tokens in a text keep their own ids.

    The result equals ``tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        chars = byte_characters()
        vocab = spec["model"]["vocab"]
        # merged in the order of the ids, which is only right if the file's merges come in that order
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError(f"{path}: the order of its merges is not that of its ids")
        ranks = {bytes(chars[c] for c in t): i for t, i in vocab.items() if t not in added}
        self.code = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        self.added = list(added)
        self.kind = "H" if max([*ranks.values(), *added.values()]) < 1 << 16 else "I"
        self.first, self.rest = UnitCache(self._units, "", 50_000), UnitCache(self._units, " ", 600_000)

    def _units(self, wanted: list[str]) -> list[bytes]:
        return [array(self.kind, self.code.encode_ordinary(x)).tobytes() for x in wanted]

    def encode(self, texts: list[str]) -> list[bytes]:
        special = {i for i, t in enumerate(texts) if any(a in t for a in self.added)}
        return [
            array(self.kind, self.code.encode(t, allowed_special="all")).tobytes() if i in special else encode_each(t, self.first, self.rest)
            for i, t in enumerate(texts)
        ]


def token_queues(docs: DataFrame, path: str, pattern: str, end_id: int) -> DataFrame:
    """doc_id, queue, part, start, n, ids: each document's ids, ``end_id`` added, and its start among its partition's tokens of its source.

    Written once to the scratch folder, so all later steps see the same partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = TokenizerFile(path, pattern)
        end = array(tokenizer.kind, [end_id]).tobytes()
        size, used = len(end), {}
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                c = b.slice(at, 1000)
                ids = [x + end for x in tokenizer.encode([t or "" for t in c.column("text").to_pylist()])]
                counts, starts = [len(x) // size for x in ids], []
                for queue, n in zip(c.column("queue").to_pylist(), counts):
                    starts.append(used.get(queue, 0))
                    used[queue] = starts[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [c.column("doc_id"), c.column("queue"), c.column("part"), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "queue", "part", "start", "n", "ids"],
                )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("queue"),
        F.spark_partition_id().alias("part"),
        F.col("text").cast("string").alias("text"),
    )
    return stored(rows.mapInArrow(run, "doc_id long, queue string, part int, start long, n long, ids binary"), "packing-tokens")[0]


class Schedule:
    """Where each token of each queue goes: queue lengths and weights, the quantum and the window."""

    def __init__(self, lengths: dict[str, int], weights: dict[str, int], quantum: int, window: int):
        if window % quantum:
            raise ValueError("the quantum must divide the window")
        self.names = sorted(lengths)
        self.quantum, self.window = quantum, window
        self.turns = [lengths[s] // quantum for s in self.names]
        self.weights = [max(1, int(weights[s])) for s in self.names]
        rest = [lengths[s] % quantum for s in self.names]  # what is left of each queue follows after all whole turns
        served = quantum * sum(self.turns)
        self.rest_at = [served + sum(rest[:i]) for i in range(len(rest))]
        total = sum(lengths.values())
        self.whole = total // window * window
        self.cuts = [self.whole]  # the last window is cut at powers of two, so that nothing is padded
        for bit in range(window.bit_length(), -1, -1):
            if (total - self.whole) >> bit & 1:
                self.cuts.append(self.cuts[-1] + (1 << bit))

    def turn_place(self, s: int, j: np.ndarray) -> np.ndarray:
        """How many turns of all queues come before turn ``j`` of queue ``s``."""
        exact = object if 2 * max(self.turns) * max(self.weights) >= 1 << 62 else np.int64
        k = 2 * j.astype(exact) + 1
        before = np.zeros(len(j), dtype=exact)
        for t, (turns, w) in enumerate(zip(self.turns, self.weights)):
            if t == s:
                before += j.astype(exact)
                continue
            x = k * w
            earlier = ((x if t < s else x - 1) // self.weights[s] + 1) // 2  # turns i with (2i + 1) / w before (2j + 1) / w_s
            before += np.minimum(earlier, turns)
        return before.astype(np.int64)

    def pieces(self, queue: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cuts the documents at queue places [at, at + n): row, start in the document, length, sequence, offset."""
        q = self.quantum
        first, last = at // q, (at + n - 1) // q
        row = np.repeat(np.arange(len(at)), last - first + 1)
        turn = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
        begin = np.maximum(at[row], turn * q)
        length = np.minimum((at + n)[row], (turn + 1) * q) - begin
        place = np.empty(len(row), np.int64)
        for s in np.unique(queue).tolist():
            mine = queue[row] == s
            whole = mine & (turn < self.turns[s])
            place[whole] = self.turn_place(s, turn[whole]) * q + begin[whole] - turn[whole] * q
            rest = mine & (turn >= self.turns[s])
            place[rest] = self.rest_at[s] + begin[rest] - self.turns[s] * q
        start, cuts = begin - at[row], np.array([*self.cuts, 1 << 62])
        done = []
        while len(row):
            part = np.searchsorted(cuts, place, side="right") - 1
            inside = place < self.whole
            left = np.where(inside, place // self.window * self.window, cuts[np.maximum(part, 0)])
            right = np.where(inside, left + self.window, cuts[part + 1])
            sequence = np.where(inside, place // self.window, self.whole // self.window + part)
            now = np.minimum(length, right - place)
            done.append((row, start, now, sequence, place - left))
            more = length > now
            row, start, place, length = row[more], (start + now)[more], (place + now)[more], (length - now)[more]
        return tuple(np.concatenate(x) for x in zip(*done)) if done else (np.empty(0, np.int64),) * 5


def pack(
    docs: DataFrame,
    path: str,
    pattern: str,
    window: int = 1024,
    quantum: int = 128,
    mixture: dict[str, float] | None = None,
    end_id: int = 0,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids.

    ``docs`` has doc_id, text and source. ``mixture`` gives sources target weights; without it the target is each
    source's share of all tokens, so that all queues end together. With a mixture, queues that end early leave their share
    to the others; every token is still packed once. Null texts count as empty (one end token); a null source is the
    source ''. The driver holds one number per source, of which there can be ``MOST_SOURCES``, and nothing per document.
    """
    tokens = token_queues(docs, path, pattern, end_id)
    totals = tokens.groupBy("queue", "part").agg(F.sum("n").alias("tokens"))
    bases = totals.withColumn("base", F.sum("tokens").over(Window.partitionBy("queue").orderBy("part")) - F.col("tokens")).select("queue", "part", "base")
    per_source = totals.groupBy("queue").agg(F.sum("tokens").alias("tokens")).limit(MOST_SOURCES + 1).collect()
    if len(per_source) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: map them to fewer, such as sites or kinds of text, before packing")
    lengths = {r["queue"]: r["tokens"] for r in per_source}
    if mixture is None:
        weights = {s: n // quantum for s, n in lengths.items()}
    else:
        weights = {s: round(1e6 * mixture.get(s, 0.0)) for s in lengths}
    schedule = Schedule(lengths, weights, quantum, window)
    number = {s: i for i, s in enumerate(schedule.names)}
    if totals.count() <= MOST_BROADCAST_ROWS:
        bases = F.broadcast(bases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                b = whole.slice(low, 1000)
                doc, names, n = b.column("doc_id"), b.column("queue"), b.column("n").to_numpy(zero_copy_only=False)
                queue = np.array([number[x] for x in names.to_pylist()], dtype=np.int64)
                row, start, length, sequence, offset = schedule.pieces(queue, b.column("at").to_numpy(zero_copy_only=False), n)
                ids = b.column("ids").to_pylist()
                flat = [np.frombuffer(x, "<u2" if 2 * k == len(x) else "<u4").astype("<u4") for x, k in zip(ids, n.tolist())]
                cut = [flat[r][s : s + k].tobytes() for r, s, k in zip(row.tolist(), start.tolist(), length.tolist())]
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [doc.take(take), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(n[row]),
                     pa.array(sequence), pa.array(offset), names.take(take), pa.array(cut, pa.binary())],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"],
                )

    placed = tokens.join(bases, ["queue", "part"]).select("doc_id", "queue", "n", "ids", (F.col("base") + F.col("start")).alias("at"))
    return placed.mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids binary"
    )
