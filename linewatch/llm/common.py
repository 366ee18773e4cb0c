"""Helpers shared by the operators: scratch tables, row identity, folds, training rows."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


#: Scratch tables written by this driver and not yet dropped, oldest first.
written_paths: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a fresh local folder only when it is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    root = tempfile.mkdtemp(prefix="linewatch-llm-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared scratch folder; returns it read back, and its path.

    Cuts the lineage: a lost executor re-reads the table. The folder
    ``<spark.checkpoint.dir>/linewatch-llm/<label>-<id>`` can expire by a retention rule.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/linewatch-llm/{label}-{uuid.uuid4().hex}"
    written_paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_stored(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later step reads."""
    if path in written_paths:
        written_paths.remove(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def row_id() -> Column:
    """64-bit identity of a document row by content. Equal rows share it, and all their results are equal too."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def fold(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo ``divisor``; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % divisor


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, max_rows: int) -> DataFrame:
    """At most about ``max_rows`` labelled documents (text, label) for fitting.

    ``keep`` says which documents may be learned from. The sample is taken by a hash of doc_id, so it is the same on
    every run. A document labelled more than once takes its largest label. The label side is broadcast: its size is
    bound by ``max_rows``.
    """
    spots = 1 << 30
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & keep)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    total = known.count()
    if total > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(spots)) < int(spots * max_rows / total))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], spread: Column, how: str = "inner", table_column: str | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per key and the number ``n`` of rows that share it.

    No task gets more than about a thousandth of the rows of one key: a key with more is dealt over as many parts as that
    takes, by the column ``spread``, and its row of ``table`` is copied to each. The keys to be dealt go by broadcast: as
    each holds a thousandth of all rows, there are fewer than 1000. ``n`` is dropped unless named in ``table_column``.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    most = total // 1000 + 1
    parts = F.ceil(F.col("n") / most)
    hot = table.where(F.col("n") > most).select(*keys, parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")), F.lit(0))).drop("_parts")
    copied = table.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    joined = dealt.join(copied, [*keys, "_part"], how).drop("_part")
    return joined if table_column == "n" else joined.drop("n")


def task_partitions(spark: SparkSession) -> int:
    """Partitions for a small table: one for each core."""
    return max(1, spark.sparkContext.defaultParallelism)


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row as one struct, which keeps them apart from an operator's own columns whatever their names."""
    return F.struct(*(docs[c] for c in docs.columns)).alias("document")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that a task holds few texts as Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def texts_of(batch: pa.RecordBatch) -> list[str | None]:
    """The texts of a batch that has the column ``text`` or the struct ``document``."""
    column = batch.column("text") if "text" in batch.schema.names else pc.struct_field(batch.column("document"), "text")
    return column.to_pylist()


def text_and(carry: Sequence[str]) -> list[str]:
    """The columns a task needs: ``carry``, and ``text`` if no document among them holds it."""
    return [*([] if "document" in carry else ["text"]), *carry]


def schema_of(df: DataFrame, names: list[str], more: str = "") -> StructType:
    """The fields ``names`` of ``df`` and those of the DDL string ``more``."""
    fields = [df.schema[n] for n in names] + (list(StructType.fromDDL(more)) if more else [])
    return StructType([StructField(f.name, f.dataType) for f in fields])


def kept_in_worker(name: tuple, make: Callable):
    """``make()``, kept for the later tasks of the same Python worker; for tables of fixed size and bounded caches only."""
    held = sys.modules.setdefault("_linewatch_worker", types.ModuleType("_linewatch_worker")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]
