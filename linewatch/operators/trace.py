"""Origin trace: which upstream station made the parts of failing units.

failing units (parent serials) --genealogy--> consumed child serials --child records--> origin station

The result is the number of distinct failing parents per (failing station,
origin station). A parent with three children from one origin counts once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewatch.operators.counts import COUNT
from linewatch.sources.files import estimated_bytes


#: Bits of the set of child serials that is broadcast to the origin side: at most this many / 64 rows, some 25 MB.
FILTER_BITS = 1 << 25
#: Origin sides of at least this estimated size are filtered before they are shuffled.
FILTER_FROM_BYTES = 1 << 30


def serial_bucket(serial: Column, buckets: int) -> Column:
    """Bucket of a serial, from 0; ``buckets`` is a power of two. The bucket follows from the serial's word in the runtime filter."""
    if buckets < 1 or buckets & (buckets - 1) or buckets > FILTER_BITS // 64:
        raise ValueError(f"buckets must be a power of two up to {FILTER_BITS // 64}")
    return F.shiftrightunsigned(F.xxhash64(serial), 6).bitwiseAND(F.lit(buckets - 1)).cast("int")


def _filtered(origin: DataFrame, hit: DataFrame, buckets: int | None) -> tuple[DataFrame, DataFrame]:
    """``origin`` rows whose child may be among the children of ``hit``, and ``hit`` in the form that both uses share.

    The children are set as bits of a table of 64-bit words, which is broadcast: its rows are bounded by ``FILTER_BITS`` / 64
    whatever the data. The origin scan starts when the words are known, and a row passes if its bit is set, so what is
    shuffled are the rows of the failing units' children and a few that share a bit. The children are gathered once: the
    words and the later join read the same exchange. With ``buckets`` (an origin table partitioned by ``serial_bucket``)
    the words also say which buckets to read at all.
    """
    mine, theirs = (df.schema["_child"].dataType for df in (origin, hit))
    if mine != theirs:  # equal serials of two types have two hashes
        return origin, hit
    h = F.xxhash64("_child")
    word = F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(FILTER_BITS // 64 - 1))
    bit = h.bitwiseAND(F.lit(63)).cast("int")
    # Without nulls in the key: else the join would test for them below the exchange, and the two uses of it would differ.
    dealt = hit.where(F.col("_child").isNotNull()).repartition("_child")
    # The test on the rest of the row is always true. It keeps all columns in this use of the exchange, as in the other one.
    rest = F.max(F.hash(*[c for c in hit.columns if c != "_child"]))
    words = dealt.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"), rest.alias("_rest"))
    words = words.where(F.col("_rest").isNotNull()).drop("_rest")
    keys = ["_word"]
    if buckets is not None:
        words = words.withColumn("_bucket", F.col("_word").bitwiseAND(F.lit(buckets - 1)).cast("int"))
        origin = origin.withColumnRenamed("serial_bucket", "_bucket")
        keys.append("_bucket")
    passed = origin.withColumn("_word", word).join(F.broadcast(words), keys).where(F.getbit("_bits", bit) == 1)
    return passed.drop("_word", "_bits", "_bucket"), dealt


def _pruned(children: DataFrame, origin: DataFrame, hit: DataFrame, buckets: int | None, runtime_filter: bool | None) -> tuple[DataFrame, DataFrame]:
    if runtime_filter is None:
        runtime_filter = buckets is not None or estimated_bytes(children) >= FILTER_FROM_BYTES
    return _filtered(origin, hit, buckets) if runtime_filter else (origin.drop("serial_bucket"), hit)


def trace_origin(
    children: DataFrame,
    genealogy: DataFrame,
    failures: DataFrame,
    origin_out: str = "origin_station",
    parent_col: str = "product_serial",
    child_col: str = "scanned_child_serial",
    parents_in: DataFrame | None = None,
    buckets: int | None = None,
    runtime_filter: bool | None = None,
) -> DataFrame:
    """Distinct failing parents per (failing station, origin station).

    ``failures``: already-filtered failing rows (``product_serial``, ``station_name``).
    ``children``: already-filtered records of the origin stations (``product_serial``, ``station_name``).
    ``parents_in``: optional table of parent serials a parent must appear in (semi-join).
    ``buckets``: ``children`` has ``serial_bucket`` of so many buckets as a partition column.
    ``runtime_filter``: filter ``children`` by the failing units' children before the join (None: if it is large or has buckets).

    Building the result runs no job. The failing side is deduplicated first; at
    run time Spark broadcasts a side whose measured size is below its threshold,
    so that genealogy and child records are read without a shuffle, and else
    shuffles both sides (AQE splits a skewed key).
    """
    fails = failures.select(F.col("product_serial").alias("_parent"), "station_name").distinct()
    links = genealogy.select(F.col(parent_col).alias("_parent"), F.col(child_col).alias("_child"))
    bucket = ["serial_bucket"] if buckets is not None else []
    origin = children.select(F.col("product_serial").alias("_child"), F.col("station_name").alias(origin_out), *bucket)
    hit = links.join(fails, "_parent")
    if parents_in is not None:
        hit = hit.join(parents_in.select(F.col("product_serial").alias("_parent")), "_parent", "left_semi")
    origin, hit = _pruned(children, origin, hit, buckets, runtime_filter)
    traced = hit.join(origin, "_child")
    return (
        traced.groupBy("station_name", origin_out)
        .agg(F.countDistinct("_parent").alias(COUNT))
        .select(COUNT, "station_name", origin_out)
    )


def trace_origins(
    children: DataFrame,
    genealogy: DataFrame,
    failures: DataFrame,
    variants: Sequence[tuple[str, Column, Column]],
    origin_out: str = "origin_station",
    parent_col: str = "product_serial",
    child_col: str = "scanned_child_serial",
    buckets: int | None = None,
    runtime_filter: bool | None = None,
) -> DataFrame:
    """Several traces over the same tables with one read of each.

    ``variants`` are ``(tag, failing-row test, origin-row test)``. Failing
    rows and origin rows are tagged with every variant they pass; genealogy
    is joined once, and a trace only pairs a failing parent with origins of
    its own variant (the tag is part of the child join key). Output: one row
    per (tag, failing station, origin station) with the distinct parents.
    ``buckets`` and ``runtime_filter`` as for ``trace_origin``.
    """
    fail_tags = F.array(*[F.when(p, F.lit(tag)) for tag, p, _ in variants])
    origin_tags = F.array(*[F.when(o, F.lit(tag)) for tag, _, o in variants])
    any_fail = reduce(lambda a, b: a | b, [p for _, p, _ in variants])
    any_origin = reduce(lambda a, b: a | b, [o for _, _, o in variants])
    failing = failures.where(any_fail)
    fails = (
        failing.select(F.col("product_serial").alias("_parent"), "station_name", F.explode(fail_tags).alias("_trace"))
        .where(F.col("_trace").isNotNull())
        .distinct()
    )
    links = genealogy.select(F.col(parent_col).alias("_parent"), F.col(child_col).alias("_child"))
    bucket = ["serial_bucket"] if buckets is not None else []
    origin = children.where(any_origin).select(
        F.col("product_serial").alias("_child"), F.col("station_name").alias(origin_out), *bucket, origin_tags.alias("_traces")
    )
    hit = links.join(fails, "_parent")
    origin, hit = _pruned(children, origin, hit, buckets, runtime_filter)
    tagged = origin.select("_child", origin_out, F.explode("_traces").alias("_trace")).where(F.col("_trace").isNotNull())
    traced = hit.join(tagged, ["_child", "_trace"])
    return (
        traced.groupBy("_trace", "station_name", origin_out)
        .agg(F.countDistinct("_parent").alias(COUNT))
        .select("_trace", COUNT, "station_name", origin_out)
    )


def child_origins(records: DataFrame, origin: Column, since: Column | None = None) -> DataFrame:
    """The narrow rows that a trace needs of the origin stations' records: child serial, station, parameter; distinct.

    For a table kept beside ``records``: append the rows of each run (``since``
    tests the run's time column) with ``append_origins``, and pass the table as
    ``LineTables(children=...)``. A trace then reads three columns of origin
    records and not the history of all stations.
    """
    rows = records.where(origin if since is None else origin & since)
    return rows.select("product_serial", "station_name", "parameter_name").distinct()


def append_origins(rows: DataFrame, path: str) -> None:
    """Add ``child_origins`` rows to the table at ``path``, partitioned by station, so that a trace's station test prunes partitions.

    Rows that are there already do no harm: a trace counts distinct parents.
    """
    rows.write.mode("append").partitionBy("station_name").parquet(path)


def read_origins(spark: SparkSession, path: str, serial_type: str = "string") -> DataFrame:
    """The table that ``append_origins`` keeps; station names stay text."""
    return spark.read.schema(f"product_serial {serial_type}, parameter_name string, station_name string").parquet(path)
