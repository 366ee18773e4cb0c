"""Substring dedup by seed and extend: words under a window of ``length`` words that also starts elsewhere.

Seeds are winnowed anchors, joined on the hash of the words after them. A seed is extended to both sides as far as the
windows that name it reach; extensions that agree with another seed's are covered whole, and the ends of maximal repeats
are found window by window (``linewatch.llm.repeats``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewatch.llm.common import stored
from linewatch.llm.repeats import covered_spans, identified, shared_anchors, with_spans


def repeated_word_spans(rows: DataFrame, length: int = 35, core: int = 16, gram: int = 6) -> DataFrame:
    """row, spans (start, end in words; disjoint, in order) of the ``identified`` rows that have repeats.

    A span is covered by windows of ``length`` words that start at another place too, in any row, the same included.
    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null and empty texts and those shorter than a window have no spans.
    """
    seeds, _ = stored(shared_anchors(rows, "words", length, core, gram, core), "substring-seeds")
    return covered_spans(rows, seeds, "words", length)


def _cut(text: str, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    words = text.encode().split()
    n, gone = len(words), sum(b - a for a, b in spans)
    for a, b in reversed(spans):
        del words[a:b]
    return n, gone, b" ".join(words).decode()


def remove_repeats(docs: DataFrame, length: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space), removed (merged word spans), for every row."""
    rows = identified(docs)

    def cut(text: str, spans: list[tuple[int, int]]) -> tuple:
        return *_cut(text, spans), [{"start": a, "end": b} for a, b in spans]

    return with_spans(rows, repeated_word_spans(rows, length), cut, "n_words long, n_removed long, kept string, removed array<struct<start:int,end:int>>")


def without_repeats(docs: DataFrame, length: int) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text`` (and ``n_chars`` counted anew, if there); other texts stay as they are."""
    rows = identified(docs, with_document=True)

    def cut(text: str, spans: list[tuple[int, int]]) -> tuple[str | None]:
        return (_cut(text, spans)[2] if spans else None,)

    got = with_spans(rows, repeated_word_spans(rows.drop("document"), length), cut, "kept string", key="document")
    now = {"text": F.coalesce("kept", "document.text")}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.when(F.col("kept").isNotNull(), F.length("kept")).otherwise(F.col("document.n_chars")).cast(docs.schema["n_chars"].dataType)
    return got.select(*(now.get(c, F.col("document")[c]).alias(c) for c in docs.columns))


def substring_digests(docs: DataFrame, length: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 (hex) of the kept words, for every row."""
    kept = remove_repeats(docs, length)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
