"""Writing reports out (files, not a chat post)."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewatch.sources.files import create_file, delete_path, list_names, path_exists, rename_path

#: The empty file that says that a run's folder is whole. It is made last.
MARKER = "_PUBLISHED"


def write_report(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Write a report DataFrame with the DataFrame writer (json, parquet, csv, ...).

    Reports are aggregated results, so the write is small; it runs on the
    executors and commits through the output committer, so a lost task is
    simply retried.
    """
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def _runs(spark: SparkSession, out_dir: str, published: bool) -> list[str]:
    """Names of the run folders under ``out_dir``, oldest first."""
    root = f"{out_dir.rstrip('/')}/runs"
    return sorted(r for r in list_names(spark, root) if path_exists(spark, f"{root}/{r}/{MARKER}") == published)


def publish(df: DataFrame, out_dir: str, by: str, parts: list[str], fmt: str = "json", keep: int = 3) -> list[str]:
    """Write the rows of ``df`` into one folder per value of its column ``by``, all visible at once or not at all.

    Everything goes to a new folder ``runs/<number>``, and an empty marker file makes it the published one. If a write ends
    midway, there is no marker: readers (``published``, ``published_report``) stay with the run before, and the next
    publication removes what it left. A published run is never changed; the last ``keep`` stay, so that readers can finish.
    ``parts`` names the values that get a folder, also when they have no rows. Returns the folders. One job writes all parts, one
    file each, in the row order of ``df``'s columns. Runs of one ``out_dir`` must not overlap.
    """
    spark, root = df.sparkSession, f"{out_dir.rstrip('/')}/runs"
    for left in _runs(spark, out_dir, published=False):
        delete_path(spark, f"{root}/{left}")
    run = f"{root}/{time.time_ns():020d}"
    order = [c for c in ("section", "position") if c in df.columns]
    dealt = df.repartition(F.col(by)).sortWithinPartitions(by, *order)
    dealt.write.partitionBy(by).format(fmt).save(f"{run}/_rows")
    out = []
    for part in parts:
        written, path = f"{run}/_rows/{by}={part}", f"{run}/{part}"
        if path_exists(spark, written):
            rename_path(spark, written, path)
        else:
            df.drop(by).limit(0).write.format(fmt).save(path)
        out.append(path)
    delete_path(spark, f"{run}/_rows")
    create_file(spark, f"{run}/{MARKER}")
    for old in _runs(spark, out_dir, published=True)[:-keep] if keep else []:
        delete_path(spark, f"{root}/{old}")
    return out


def published(spark: SparkSession, out_dir: str) -> str | None:
    """The folder of the latest published run, None before the first one."""
    runs = _runs(spark, out_dir, published=True)
    return f"{out_dir.rstrip('/')}/runs/{runs[-1]}" if runs else None


def published_report(spark: SparkSession, out_dir: str, name: str, fmt: str = "json") -> DataFrame | None:
    """Report ``name`` of the latest published run; None if that run has none."""
    run = published(spark, out_dir)
    if run is None or not path_exists(spark, f"{run}/{name}"):
        return None
    return spark.read.format(fmt).load(f"{run}/{name}")
