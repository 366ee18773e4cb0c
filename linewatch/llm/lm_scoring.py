"""Cross-entropy difference: a target and a background word model over one vocabulary score every document.

The models hold every word and every pair of words of the corpus. Texts are dealt over chunks; a chunk counts its own n-grams
and hands them over sorted by their 64-bit names, packed, one row for each bucket of the name space. A bucket adds up what all
chunks have of its names and answers each chunk with its counts alone, in the order of the names that it was sent. A chunk's
part of a bucket has each name once, however common it is, so buckets are even.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewatch.llm.exchange import bucket_of, mix, runs_of
from linewatch.llm.repeats import WordCodes

#: UTF-8 bytes of text in a chunk; a chunk is what one task holds at a time.
CHUNK_BYTES = 16_000_000
#: Occurrences that the lower order stands for (Dirichlet prior) in every distribution of either model.
PRIOR = 8.0
EDGE, TOTAL = 2, 4


def pack_names(names: np.ndarray) -> bytes:
    """Rising 64-bit names: the width of a step, the first name, and the steps in so many bytes."""
    if not len(names):
        return b""
    steps = np.diff(names)
    width = 6 if not len(steps) or steps.max() < 1 << 48 else 8
    return bytes([width]) + names[:1].tobytes() + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_names(packed: bytes) -> np.ndarray:
    if not packed:
        return np.empty(0, np.uint64)
    width = packed[0]
    steps = np.frombuffer(packed, np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(steps) + 1, 8), np.uint8)
    wide[0] = np.frombuffer(packed, np.uint8, 8, 1)
    wide[1:, :width] = steps
    return np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(*counts: np.ndarray) -> bytes:
    """Counts byte by byte, all lowest bytes first: what is small takes no space once it is compressed for the way."""
    return b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in counts)


def unpack_counts(packed: bytes) -> np.ndarray:
    """(2, n) counts."""
    planes = np.frombuffer(packed, np.uint8).reshape(2, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u8")[:, :, 0].astype(np.int64)


class ChunkGrams:
    """The word unigrams and bigrams of a chunk's texts, and their counts in both models, at first within the chunk.

    The token that follows the last word and precedes the first one is the edge. ``keys``: 64-bit names, of unigrams (even)
    and bigrams (odd), each sorted, and of the token total.
    """

    def __init__(self, texts: pa.ChunkedArray, marks: np.ndarray, codes: WordCodes):
        found = ((t.as_py() or "").encode().split() for t in texts)
        words = [np.fromiter(map(codes.__getitem__, w), np.uint64, len(w)) for w in found]
        self.lengths = np.array([len(w) for w in words], np.int64)
        used = self.lengths > 0
        sizes = self.lengths[used] + 1
        self.used, self.starts = used, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.empty(0, np.int64)
        tokens = np.empty(int(sizes.sum()), np.uint64)
        ends = self.starts + sizes - 1
        inner = np.ones(len(tokens), bool)
        inner[ends] = False
        if len(tokens):
            tokens[inner] = np.concatenate(words)
        tokens[inner] = mix(tokens[inner]) & ~np.uint64(1)
        tokens[ends] = EDGE
        before = np.roll(tokens, 1)  # each text's last token is the edge, and so what precedes its first one
        marked = np.repeat(marks[used], sizes)
        self.unigrams, self.word = np.unique(tokens, return_inverse=True)
        self.bigrams, self.pair = np.unique(mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens) | np.uint64(1), return_inverse=True)
        self.counts = {}
        for name, places, n in (("word", self.word, len(self.unigrams)), ("pair", self.pair, len(self.bigrams))):
            self.counts[name] = [np.bincount(places[marked], minlength=n), np.bincount(places, minlength=n)]
        self.total = [int(marked.sum()), len(tokens)]

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted names of all n-grams and of the token total, and which of unigrams, bigrams and total each one is."""
        every = np.concatenate([self.unigrams, self.bigrams, np.array([TOTAL], np.uint64)])
        order = np.argsort(every, kind="stable")
        return every[order], order

    def in_buckets(self, buckets: int) -> list[tuple[int, bytes, bytes]]:
        """(bucket, packed names, packed counts in target and background), in the order of the names."""
        names, order = self.names()
        counts = [np.concatenate([self.counts["word"][m], self.counts["pair"][m], [self.total[m]]])[order] for m in (0, 1)]
        number = bucket_of(names, buckets)
        starts, lengths = runs_of(number)
        spans = zip(starts.tolist(), (starts + lengths).tolist())
        return [(int(number[a]), pack_names(names[a:z]), pack_counts(*(c[a:z] for c in counts))) for a, z in spans]

    def take(self, answers: list[bytes]) -> None:
        """Replace counts by those of the whole corpus: the buckets' answers, in order."""
        _, order = self.names()
        whole = np.empty((2, len(order)), np.int64)
        whole[:, order] = np.concatenate([unpack_counts(x) for x in answers], axis=1)
        n = len(self.unigrams)
        self.counts = {"word": list(whole[:, :n]), "pair": list(whole[:, n:-1])}
        self.total = whole[:, -1].tolist()

    def losses(self, model: int) -> np.ndarray:
        """Mean nats a token of each text; 0 for a text without words."""
        out = np.zeros(len(self.lengths))
        if len(self.starts):
            one, common = self.counts["word"][model], self.counts["word"][1] / self.total[1]
            low = (one + PRIOR * common) / (self.total[model] + PRIOR)
            loss = -np.log((self.counts["pair"][model][self.pair] + PRIOR * low[self.word]) / (one[np.roll(self.word, 1)] + PRIOR))
            out[self.used] = np.add.reduceat(loss, self.starts) / (self.lengths[self.used] + 1)
        return out


def score_word_cross_entropy(docs: DataFrame, target: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_tokens (words), target_loss, background_loss (mean nats a token) and score = target_loss - background_loss.

    Word bigram models that grow with the corpus: all words (``[^\\x20\\x09-\\x0D]+``) of all texts are the vocabulary of both,
    and every bigram is counted, with 64-bit names. The background model is made of all rows of ``docs`` (doc_id, text), the
    target model of those whose doc_id is in ``target``. In both, bigrams fall back to the model's unigrams and these to the
    corpus's, by a Dirichlet prior. A text's tokens are its words and its end. Null and empty texts have n_tokens 0, losses 0
    and score 0. A lower score is closer to the target.

    Texts are dealt over chunks by doc_id (null: by text). Names go from chunks to buckets and counts back to the chunks,
    which are made again from the same texts. Nothing but the corpus's size in bytes goes to the driver.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // chunk_bytes))
    buckets = chunks  # about as many n-grams in a bucket as in a chunk
    rows = rows.withColumn("chunk", F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(chunks)).cast("int"))
    wanted = target.select(F.col("doc_id").cast("long").alias("key")).where("key is not null").distinct()
    wanted = wanted.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int"))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        packed = []
        if left.num_rows:
            ids = left.column("doc_id")
            marks = ids.is_valid().to_numpy() & np.isin(ids.fill_null(0).to_numpy(), right.column("key").to_numpy())
            packed = ChunkGrams(left.column("text"), marks, WordCodes()).in_buckets(buckets)
        number = left.column("chunk")[0].as_py() if left.num_rows else 0
        columns = [list(x) for x in zip(*packed)] or [[], [], []]
        return pa.table({
            "chunk": pa.array([number] * len(packed), pa.int32()), "bucket": pa.array(columns[0], pa.int32()),
            "names": pa.array(columns[1], pa.binary()), "counts": pa.array(columns[2], pa.binary()),
        })

    def add_up(group: pa.Table) -> pa.Table:
        parts = [unpack_names(x.as_buffer()) for x in group.column("names")]
        names, counts = np.concatenate(parts), np.concatenate([unpack_counts(x.as_buffer()) for x in group.column("counts")], axis=1)
        order = np.argsort(names, kind="stable")
        starts, lengths = runs_of(names[order])
        whole = np.empty_like(counts)
        for mine, out in zip(counts, whole):
            out[order] = np.repeat(np.add.reduceat(mine[order], starts), lengths)
        ends = np.cumsum([len(x) for x in parts]).tolist()
        answers = [pack_counts(*whole[:, a:z]) for a, z in zip([0, *ends], ends)]
        return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "answer": pa.array(answers, pa.binary())})

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found = ChunkGrams(left.column("text"), np.zeros(left.num_rows, bool), WordCodes())
        if left.num_rows:
            found.take(right.sort_by("bucket").column("answer").to_pylist())
        return pa.table({
            "doc_id": left.column("doc_id"), "n_tokens": pa.array(found.lengths),
            "target_loss": pa.array(found.losses(0)), "background_loss": pa.array(found.losses(1)),
        })

    counted = rows.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(count, "chunk int, bucket int, names binary, counts binary")
    answers = counted.groupBy("bucket").applyInArrow(add_up, "chunk int, bucket int, answer binary")
    scored = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, "doc_id long, n_tokens long, target_loss double, background_loss double")
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))
