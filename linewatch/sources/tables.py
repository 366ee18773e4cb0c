"""Loading base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load_table(spark: SparkSession, name_or_path: str, fmt: str = "parquet", pin: bool = False) -> DataFrame:
    """A catalog table by name, or files by path (anything with a ``/`` or a file suffix). ``pin``: see ``pinned``."""
    if "/" in name_or_path or name_or_path.endswith((".parquet", ".orc", ".json", ".csv")):
        return spark.read.format(fmt).load(name_or_path)  # lists its files here, once
    df = spark.table(name_or_path)
    return pinned(df, fmt) if pin else df


def pinned(df: DataFrame, fmt: str = "parquet") -> DataFrame:
    """``df``, a loaded table of files, held to the files that it has now.

    All actions of a run then see the same rows, whatever arrives meanwhile. A table read by path lists its files when it is
    loaded and stays with them; a partitioned catalog table would list them in each action anew. Other tables are returned as
    they are. Only names are read.
    """
    jvm = df.sparkSession._jvm
    files = list(df.inputFiles())
    if not files:
        return df
    plan = df._jdf.queryExecution().analyzed()
    leaves = jvm.scala.jdk.javaapi.CollectionConverters.asJava(plan.collectLeaves())
    if len(leaves) != 1:
        raise ValueError("only a table as it was loaded can be pinned")
    roots = [str(p) for p in jvm.scala.jdk.javaapi.CollectionConverters.asJava(leaves[0].relation().location().rootPaths())]
    reader = df.sparkSession.read.schema(df.schema).format(fmt)
    if len(roots) == 1 and not roots[0].endswith(f".{fmt}"):
        reader = reader.option("basePath", roots[0])  # so that folders below it stay partitions
    return reader.load(files).select(*df.columns)


def normalize_columns(df: DataFrame, case: str = "upper") -> DataFrame:
    """Rename every column to upper or lower case."""
    change = str.upper if case == "upper" else str.lower
    return df.toDF(*[change(c) for c in df.columns])
