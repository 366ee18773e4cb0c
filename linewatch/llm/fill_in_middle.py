"""Fill-in-the-middle training texts by in-place block rotation.

A text is cut into prefix, middle and suffix between white-space tokens. Its bytes, with the sentinels inserted before the
three segments, lie in one bytearray; the segments change places by rotations made of three reversals, and the inverse
rotations bring the text back. Rows are independent, so the work is one pass without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewatch.llm.common import schema_of, slices

SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes that a reversal swaps at a time: its scratch memory.
SWAP = 1 << 16


def reverse(view: np.ndarray, low: int, high: int) -> None:
    """Reverses ``view[low:high]`` in place, two blocks at a time."""
    while high - low > 1:
        n = min(SWAP, (high - low) // 2)
        left = view[low : low + n][::-1].copy()
        view[low : low + n] = view[high - n : high][::-1]
        view[high - n : high] = left
        low, high = low + n, high - n


def rotate(view: np.ndarray, low: int, middle: int, high: int) -> None:
    """Exchanges the neighbours ``view[low:middle]`` and ``view[middle:high]`` in place; the inverse rotates at the other's length."""
    reverse(view, low, middle)
    reverse(view, middle, high)
    reverse(view, low, high)


def token_ends(data: np.ndarray) -> np.ndarray:
    """The end of every token in UTF-8 bytes: white space (it is ASCII) before visible characters belongs to them, the rest is one token."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(data)) if len(data) else np.empty(0, np.int64)


def code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four 32-bit numbers of a document, the same on every run and machine."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(text: bytes, h: Sequence[int], percent: int, spm_percent: int, marks: Sequence[bytes]) -> tuple[int, str, int | None, int | None, bytes]:
    """Tokens, form, code points of prefix and middle, and output of one text."""
    data = np.frombuffer(text, np.uint8)
    ends = token_ends(data)
    n = len(ends)
    if not n or h[2] % 100 >= percent or any(m in text for m in marks):
        return n, PLAIN, None, None, text
    first, second = sorted(int(ends[k - 1]) if k else 0 for k in (h[0] % (n + 1), h[1] % (n + 1)))
    p, s, m = marks
    spm = h[3] % 100 < spm_percent
    # in text order with the sentinels, then one exchange: suffix to the front, or middle and suffix
    out = bytearray(b"".join((p, text[:first], m, text[first:second], s, text[second:])))
    at_middle, at_suffix = len(p) + first, len(p) + len(m) + second
    rotate(np.frombuffer(out, np.uint8), 0 if spm else at_middle, at_suffix, len(out))
    return n, SPM if spm else PSM, code_points(data[:first]), code_points(data[first:second]), bytes(out)


def restore(output: bytes, form: str, marks: Sequence[bytes]) -> bytes:
    """The text of an output. The text holds no sentinel and no two sentinels can overlap, so each is found where it was put."""
    if form == PLAIN:
        return output
    p, s, m = marks
    out = bytearray(output)
    low, cut = (0, out.index(p)) if form == SPM else (out.index(s), out.index(m))
    rotate(np.frombuffer(out, np.uint8), low, cut, len(out))  # text order again
    at_middle = out.index(m)
    at_suffix = out.index(s)
    return bytes(out[len(p) : at_middle] + out[at_middle + len(m) : at_suffix] + out[at_suffix + len(s) :])


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars and output of every row's text.

    ``percent`` of the documents are rearranged, ``spm_percent`` of these suffix first, by numbers drawn from ``seed`` and
    doc_id. A null or empty text, and one that holds a sentinel, stays plain with null lengths; white space alone is one
    token. Equal rows give equal results; a null doc_id draws as an empty one. Other columns are not read. ``sentinels``
    (prefix, suffix, middle) must differ, begin with the same character and hold it nowhere else, so that two can't overlap.
    """
    marks = [x.encode() for x in sentinels]
    if len({*marks}) < 3 or any(len(m) < 2 or m[:1] != marks[0][:1] or m[:1] in m[1:] for m in marks):
        raise ValueError("three different sentinels are needed that begin with one character which they hold nowhere else")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [
                transform(text or b"", draws(seed, doc), percent, spm_percent, marks)
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())
            ]
            n, form, prefix, middle, output = (list(x) for x in zip(*made)) if made else ([], [], [], [], [])
            arrays = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    made = rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(rearranged: DataFrame, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """``rearranged`` (it has ``form`` and ``output``) and the column ``text``, rebuilt from these two alone."""
    marks = [x.encode() for x in sentinels]
    names = [c for c in rearranged.columns if c not in ("text", "output")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [None if o is None else restore(o, f, marks) for f, o in zip(b.column("form").to_pylist(), b.column("output").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], names=[*b.schema.names, "text"])

    rows = rearranged.select(*names, F.col("output").cast("binary").alias("output"))
    back = rows.mapInArrow(run, schema_of(rows, [*names, "output"], "text binary"))
    return back.withColumns({c: F.col(c).cast("string") for c in ("output", "text")})


def fill_in_middle_digests(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """``fill_in_middle`` with the SHA-256 of the output and of the text rebuilt from it, in place of the texts."""
    back = restored(fill_in_middle(docs, seed, percent, spm_percent, sentinels), sentinels)
    return back.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256")
    )
