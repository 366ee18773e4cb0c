"""Exact copies by block naming against a dictionary of texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from linewatch.llm.common import join_counted
from linewatch.llm.exact_dedup import blocks_of, exact_copies
from linewatch.llm.queries import op12_exact_dedup

SF = "/root/testdata/sf0.001"


def _plain(rows):
    """(doc_id, keep_id, group_size, kept, sha) of every row by grouping whole texts."""
    groups = {}
    for k, (doc_id, text) in enumerate(rows):
        t = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(t, []).append((-len(text or ""), doc_id is None, doc_id or 0, k, doc_id))
    out = []
    for t, members in groups.items():
        best = min(members)
        out += [(m[4], best[4], len(members), m[3] == best[3], hashlib.sha256(t.encode()).hexdigest()) for m in members]
    return sorted(out, key=repr)


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_grouping(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert _got(op12_exact_dedup(spark, SF)) == _plain(docs)


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_many_levels(spark, block):
    """Copies of one to many blocks, odd numbers of them, texts that share all blocks but their order, and prefixes of others."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 7, 12, 13, 30, 31, 64, 100)]
    texts = base + base + ["abcabc", "cababc", "bcabca", "abcabcabc", "aaaaaa", "aaaaaaaaa", "aaa" * 21, "aaa" * 22, "é" * 9, "é" * 9, "é" * 8]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, "".join(c + rng.choice(["", "", " ", "\n\t", "\x0b"]) for c in t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _got(exact_copies(docs, block)) == _plain(rows)


def test_awkward_rows(spark, awkward):
    expected = _plain([(r.doc_id, r.text) for r in awkward.collect()])
    assert _got(exact_copies(awkward, 64)) == expected


def test_ties_and_repeated_rows(spark):
    """One row of a group stays: longest, then smallest doc_id, null last; of equal rows only one."""
    rows = [(5, "a b"), (3, "ab "), (None, " ab"), (3, "ab "), (-7, "ab"), (None, None), (None, ""), (-(1 << 63), " \n"), (9, "ab   "), (8, "ab   "), (8, "a b  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_copies(docs)
    assert _got(got.drop("kept")) == sorted([x[:3] + x[4:] for x in _plain(rows)], key=repr)
    kept = [(r.doc_id, r.group_size) for r in got.where("kept").collect()]
    assert sorted(kept) == [(-(1 << 63), 3), (8, 8)]


def test_large_group_of_copies(spark):
    """A third of all rows in one group of many-block texts, and a group that is too frequent for one task."""
    rows = [(i, "x" * 50 if i % 3 == 0 else ("yz" * 20 if i % 3 == 1 else f"text {i}")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _got(exact_copies(docs, 16)) == _plain(rows)


def test_join_counted_spreads_a_hot_key(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    joined = join_counted(rows, table, ["k"], F.col("id"))
    assert joined.columns == ["k", "id", "v"]
    assert joined.where("v = 2 * k").count() == 20_000
    left = join_counted(rows, table.where("k <> 3"), ["k"], F.col("id"), how="left", table_column="n")
    assert {(r.k, r.n) for r in left.where("k < 6").collect()} == {(1, 10_001), (3, None), (5, 1)}


def test_blocks(spark):
    got = spark.createDataFrame([("abcde",), ("",), ("abcd",)], "t string").select(blocks_of(F.col("t").cast("binary"), 2).alias("b")).collect()
    assert [[bytes(x) for x in r.b] for r in got] == [[b"ab", b"cd", b"e"], [b""], [b"ab", b"cd"]]


def test_empty_table(spark, nothing):
    assert exact_copies(nothing).collect() == []


def test_native(spark):
    plan = op12_exact_dedup(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
