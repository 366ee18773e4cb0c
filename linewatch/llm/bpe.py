"""Byte-level BPE by merge replay over a slice of the corpus, and decoding.

The words of a slice (matches of the pre-tokenization pattern, each distinct word once) lie behind one another in one
array of token ids. An inverted index leads from the rank of a token pair to the places where the pair stands. Ranks are
applied in rising order to all their places; a merge looks only at its two neighbours and files the new pairs.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewatch.llm.common import kept_in_worker, slices
from linewatch.llm.pretokens import UnitCache, encode_texts


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from lines of base64 and number."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class MergeReplay:
    """Encodes many words at once by the ranks; ``encode`` returns the ids of each word."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        #: left id << 32 | right id -> id of the join, for every way to cut a token in two tokens
        self.joins = {
            ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        }

    def finish(self, ids: list[int]) -> list[int]:
        """Plain lowest-rank-first merging of one word."""
        joins = self.joins
        while found := [(r, i) for i in range(len(ids) - 1) if (r := joins.get(ids[i] << 32 | ids[i + 1])) is not None]:
            r, i = min(found)
            ids[i : i + 2] = [r]
        return ids

    def encode(self, words: list[bytes]) -> list[bytes]:
        ranks, join, byte = self.ranks, self.joins.get, self.byte
        out = [ranks[w].to_bytes(4, "little") if w in ranks else b"" for w in words]
        todo = [i for i, w in enumerate(words) if w not in ranks and w]
        # the words one behind another: the token at a place (-1: merged into the one before), the next and previous place (-1: none)
        starts = np.cumsum([0] + [len(words[i]) for i in todo])
        ids = np.array(byte)[np.frombuffer(b"".join(words[i] for i in todo), np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        for s in starts[:-1].tolist():
            after[s - 1] = before[s] = -1
        if ids:
            after[-1] = -1
        places: dict[int, list[int]] = {}
        flat = np.array(ids, dtype=np.int64)
        keys = (flat[:-1] << 32 | flat[1:]) if len(ids) else flat
        keys[starts[1:-1] - 1] = -1  # no pair across two words
        for p, r in enumerate(map(join, keys.tolist())):
            if r is not None:
                if r in places:
                    places[r].append(p)
                else:
                    places[r] = [p]
        heap = list(places)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            todo_places = places.pop(r)
            todo_places.sort()
            for p in todo_places:
                q = after[p]
                if q < 0 or join(ids[p] << 32 | ids[q]) != r:
                    continue  # merged or changed since
                n, left = after[q], before[p]
                ids[p] = r
                ids[q] = after[q] = -1
                after[p] = n
                lower = False
                if n >= 0:
                    before[n] = p
                    x = join(r << 32 | ids[n])
                    if x is not None:
                        lower = x < r
                        if x in places:
                            places[x].append(p)
                        else:
                            places[x] = [p]
                            heapq.heappush(heap, x)
                if left >= 0:
                    x = join(ids[left] << 32 | r)
                    if x is not None:
                        lower |= x < r
                        if x in places:
                            places[x].append(left)
                        else:
                            places[x] = [left]
                            heapq.heappush(heap, x)
                if lower:
                    self._settle(p, ids, after, before)
        flat = np.array(ids, dtype=np.int64)
        live = flat >= 0
        ends = (4 * np.concatenate([[0], np.cumsum(live)])[starts]).tolist()
        tokens = flat[live].astype("<u4").tobytes()
        for k, i in enumerate(todo):
            out[i] = tokens[ends[k] : ends[k + 1]]
        return out

    def _settle(self, p: int, ids: list[int], after: list[int], before: list[int]) -> None:
        """A pair of a rank already passed has come up: merge its word to the end by itself."""
        while before[p] >= 0:
            p = before[p]
        chain = [p]
        while after[chain[-1]] >= 0:
            chain.append(after[chain[-1]])
        done = self.finish([ids[k] for k in chain])
        kept = chain[: len(done)]
        for k in chain:
            ids[k] = after[k] = -1
        for k, token, nxt, prev in zip(kept, done, [*kept[1:], -1], [-1, *kept[:-1]]):
            ids[k], after[k], before[k] = token, nxt, prev


class Codec:
    """Texts to little-endian 32-bit ids and back."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.replay = MergeReplay(read_ranks(path))
        self.split = regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}
        self.first = UnitCache(self._units, "", 100_000)
        self.rest = UnitCache(self._units, " ", 1_000_000)

    def _units(self, wanted: list[str]) -> list[bytes]:
        parts = [self.split(x) for x in wanted]
        if len(self.words) > 800_000:
            self.words.clear()
        new = list({w for p in parts for w in p if w not in self.words})
        self.words.update(zip(new, self.replay.encode([w.encode() for w in new])))
        return [b"".join(map(self.words.__getitem__, p)) for p in parts]

    def encode(self, texts: list[str]) -> list[bytes]:
        return encode_texts(texts, self.first, self.rest)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.replay.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every row's text, without special tokens; a null text is empty.

    Each task replays the merges over the words of its own rows, slice by slice, so nothing is shuffled and memory is
    bound by the slice and the word cache. ``path`` must be readable on the executors.
    """
    return _mapped(docs, path, pattern, "ids binary", lambda codec, ids: [pa.array(ids, pa.binary())])


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of every row of ``encoded`` (doc_id, ids); null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_in_worker(("bpe", path, pattern), lambda: Codec(path, pattern))
        for b in batches:
            got = [codec.decode(x or b"") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded binary")


def bpe_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 (hex) of the ids and of the bytes that they decode to, for every row."""

    def digests(codec: Codec, ids: list[bytes]) -> list[pa.Array]:
        return [
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string()),
        ]

    return _mapped(docs, path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _mapped(docs: DataFrame, path: str, pattern: str, columns: str, make) -> DataFrame:
    names = ["doc_id", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_in_worker(("bpe", path, pattern), lambda: Codec(path, pattern))
        for b in slices(batches, 2000):
            ids = codec.encode([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *make(codec, ids)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {columns}")
