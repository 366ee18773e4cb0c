"""Cleaning and packing a corpus: toxicity, quality, near duplicates, shared passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. ``docs`` of
a stage is the written result of the stage before, so scratch tables of that stage are dropped when the next one begins.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from linewatch.llm.common import drop_stored, stored, written_paths
from linewatch.llm.ngram_join import one_of_each_group
from linewatch.llm.packing import pack
from linewatch.llm.quality import score_quality
from linewatch.llm.substring_dedup import without_repeats
from linewatch.llm.toxicity import score_toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Words of a passage that two documents share, from which on it is removed.
PASSAGE_WORDS = 50
_finished: list[str] = []


def _stage(make: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _finished:
            drop_stored(spark, _finished.pop())
        before = set(written_paths)
        out = make(spark, docs, sf_dir)
        _finished.extend(p for p in written_paths if p not in before)
        return out

    return run_stage


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return score_toxicity(docs, _labels(spark, sf_dir), with_document=True).where("predicted = 0").select("document.*")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return score_quality(docs, _labels(spark, sf_dir), with_document=True).where("predicted = 1").select("document.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 of their five-word shingles."""
    return one_of_each_group(docs, width=5, percent=80)


def cut_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of ``PASSAGE_WORDS`` words that occur more than once."""
    return without_repeats(docs, PASSAGE_WORDS)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 tokens, sources mixed by their shares."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).drop("ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _stage(drop_toxic)),
    ("quality", _stage(keep_good)),
    ("near_duplicates", _stage(drop_near_duplicates)),
    ("shared_passages", _stage(cut_shared_passages)),
    ("packing", pack_tokens),
]

#: Model fitting and tokenization are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the scratch folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = None
    for name, stage in STAGES[:-1]:
        before, docs = path, stage(spark, docs, sf_dir)
        docs, path = stored(docs, f"stage-{name}")
        if before:
            drop_stored(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
