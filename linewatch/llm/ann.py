"""Approximate nearest neighbours by inner product: a forest of sorted hash-string arrays.

Vectors are lifted to one length, so that the largest inner product is the smallest angle, and each tree gives a vector a
string of random-hyperplane bits. The rows are dealt over segments of bounded size; a segment keeps, for each tree, its rows
sorted by their strings. A query descends to its longest matching prefix in every tree, and all trees then ascend together, one level
at a time and tree by tree on the last one, until the prefixes hold enough different rows over the whole forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewatch.llm.common import stored


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and vec (array of doubles) of the rows that take part: no nulls, only finite components, not all zero."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda x: x != 0.0))


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class Forest:
    """The hash functions: ``trees`` strings of ``bits`` bits (32 at most), from a seed."""

    def __init__(self, dims: int, longest: float, trees: int, bits: int, seed: int):
        self.dims, self.longest, self.trees, self.bits, self.seed = dims, longest, trees, bits, seed

    def strings(self, x: np.ndarray, stored_rows: bool) -> np.ndarray:
        """trees x rows; stored rows get one more component that lifts them to the longest length, queries get zero there."""
        rng = np.random.default_rng(self.seed)
        extra = np.sqrt(np.maximum(self.longest**2 - (x**2).sum(1), 0.0)) if stored_rows else np.zeros(len(x))
        lifted, values = np.column_stack([x, extra]), (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))
        out = np.empty((self.trees, len(x)), np.uint32)
        for t in range(self.trees):
            out[t] = (lifted @ rng.normal(size=(self.dims + 1, self.bits)) > 0).astype(np.int64) @ values
        return out

    def ranges(self, sorted_strings: np.ndarray, query: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in one tree's sorted array that share the first ``level`` bits with each query's string."""
        shift = self.bits - level
        low = query.astype(np.int64) >> shift << shift
        return np.searchsorted(sorted_strings, low), np.searchsorted(sorted_strings, low + (np.int64(1) << shift))

    def shared(self, differing: np.ndarray) -> np.ndarray:
        """How many first bits two strings share, from their exclusive or."""
        return self.bits - np.frexp(differing.astype(float))[1]


class Segment:
    """A stored segment: its rows by vec_id, and for each tree their strings, and their places sorted by string."""

    SCHEMA = "segment int, ids binary, vecs binary, strings binary, places binary"

    def __init__(self, table: pa.Table, dims: int, trees: int):
        row = {c: table.column(c)[0].as_buffer() for c in ("ids", "vecs", "strings", "places")}
        self.ids, self.x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vecs"]).reshape(-1, dims)
        self.strings, self.places = (np.frombuffer(row[c], kind).reshape(trees, -1) for c, kind in (("strings", np.uint32), ("places", np.int32)))

    @staticmethod
    def packed(table: pa.Table, forest: Forest) -> pa.Table:
        order = np.argsort(table.column("vec_id").to_numpy())
        ids, x = table.column("vec_id").to_numpy()[order], matrix(table.column("vec"), forest.dims)[order]
        strings = forest.strings(x, True)
        places = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        columns = {n: pa.array([v.tobytes()], pa.binary()) for n, v in (("ids", ids), ("vecs", x), ("strings", strings), ("places", places))}
        return pa.table({"segment": table.column("segment")[:1], **columns})


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows with one vector, summed in component order: equal rows get equal numbers."""
    out = np.zeros(len(x))
    for j, c in enumerate(q):
        out += x[:, j] * c
    return out


def best_of(x: np.ndarray, ids: np.ndarray, near: np.ndarray, rough: np.ndarray, q: np.ndarray, k: int, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """The ids and products of the ``k`` best of the places ``near``, ties to the smaller id.

    ``rough`` are products of all places, summed in any order. Either sum is off by less than (components) x 2**-53 x (the sum
    of the products' sizes, at most ``longest`` times the query's length), so whatever can be among the best stays for the
    exact order.
    """
    if len(near) > k:
        off = 4 * len(q) * 2.0**-53 * longest * float(np.sqrt(q @ q))
        about = rough[near]
        near = near[about >= np.partition(about, len(near) - k)[len(near) - k] - off]
    score = products(x[near], q)
    first = np.lexsort((ids[near], -score))[:k]
    return ids[near][first], score[first]


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    trees: int = 64,
    bits: int = 32,
    candidate_share: float = 0.65,
    least_candidates: int = 10,
    segment_rows: int = 4096,
    query_rows: int = 2048,
    seed: int = 11,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found for each query row, nearest first, ties to the smaller vec_id.

    ``vectors`` and ``queries`` have the columns ``key`` and ``vector``. Vectors that are null, zero or hold null or
    non-finite components take no part, nor do those without the most frequent number of components (the smallest such
    number in a tie). A query's own row is no candidate; rows that repeat a vec_id count as one with it.

    The ascent goes level by level through all trees, and on its last level through as many of them as it takes for the prefixes to
    hold about ``candidate_share`` of all rows; it holds ``least_candidates`` * ``k`` different rows at least, or all rows where
    there are fewer. A segment's strings and sorted arrays are made once and stored; queries meet segments in blocks of
    ``query_rows`` by ``segment_rows``. Scores are sums of products in double precision, in component order.
    """
    spark = vectors.sparkSession
    rows, asked = usable(vectors, key, vector), usable(queries, key, vector)
    sizes = rows.groupBy(F.size("vec").alias("dims")).agg(F.count("*").alias("n"), F.sqrt(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).alias("longest"))
    found = sizes.orderBy(F.desc("n"), "dims").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if found is None:
        return spark.createDataFrame([], schema)
    dims, total = found["dims"], found["n"]
    rows, asked = (x.where(F.size("vec") == dims).dropDuplicates(["vec_id"]) for x in (rows, asked))
    forest = Forest(dims, found["longest"], trees, bits, seed)
    segments = max(1, -(-total // segment_rows))
    blocks = max(1, -(-asked.count() // query_rows))
    everywhere = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    dealt = rows.withColumn("segment", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(segments)).cast("int"))
    stored_segments, _ = stored(dealt.groupBy("segment").applyInArrow(lambda t: Segment.packed(t, forest), Segment.SCHEMA), "ann-segments")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = np.ascontiguousarray(forest.strings(matrix(pa.chunked_array([b.column("vec")]), dims), False).T)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in own], pa.binary())], names=[*b.schema.names, "strings"])

    placed = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int"))
    stored_queries, _ = stored(placed.mapInArrow(hashed, "vec_id long, vec array<double>, block int, strings binary"), "ann-queries")
    pair = ["segment", "block"]
    segment_side = stored_segments.select("*", everywhere(blocks, "block")).groupBy(*pair)

    def own_strings(right: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(right.column("strings").to_pylist()), np.uint32).reshape(-1, trees)

    def held(left: pa.Table, right: pa.Table) -> pa.Table:
        """For each query: how many rows of the segment share each prefix length with it in some tree; not its own row."""
        distinct = np.zeros((right.num_rows, bits + 1), np.int64)
        if left.num_rows:
            segment = Segment(left, dims, trees)
            for i, (query, own) in enumerate(zip(right.column("vec_id").to_pylist(), own_strings(right))):
                closest = (segment.strings ^ own[:, None]).min(axis=0)
                deepest = np.bincount(forest.shared(closest[segment.ids != query]), minlength=bits + 1)
                distinct[i] = deepest[::-1].cumsum()[::-1]
        return pa.table({"vec_id": right.column("vec_id"), "held": pa.array(distinct.tolist(), pa.list_(pa.int64()))})

    counted = segment_side.cogroup(stored_queries.select("vec_id", "strings", "block", everywhere(segments, "segment")).groupBy(*pair)).applyInArrow(
        held, "vec_id long, held array<long>"
    )
    sums = counted.groupBy("vec_id").agg(F.array(*(F.sum(F.col("held")[i]) for i in range(bits + 1))).alias("d"))
    deepest_with = lambda n: F.greatest(*(F.when(F.col("d")[i] >= n, i).otherwise(0) for i in range(bits + 1)))
    enough = F.ceil(F.col("d")[0] * candidate_share)
    least = F.least(F.lit(max(1, least_candidates) * k), F.col("d")[0])  # every row shares the empty prefix
    leveled = sums.withColumns({"level": deepest_with(enough), "least_level": deepest_with(least)})
    deeper = F.coalesce(F.get("d", F.col("level") + 1), F.lit(0))
    # rows that each tree adds grow fewer from tree to tree, so this many trees hold what is asked for, or somewhat more
    part = F.ceil(trees * (enough - deeper) / F.greatest(F.get("d", "level") - deeper, F.lit(1))).cast("int")
    levels, _ = stored(leveled.select("vec_id", "level", "least_level", part.alias("part")), "ann-levels")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        """The segment's ``k`` best candidates of each query."""
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            segment, q, own = Segment(left, dims, trees), matrix(right.column("vec"), dims), own_strings(right)
            level, least_level, part = (right.column(c).to_numpy().astype(np.int64) for c in ("level", "least_level", "part"))
            spans = []
            for t in range(trees):
                to = np.minimum(least_level, level + (t >= part))
                spans.append(forest.ranges(segment.strings[t][segment.places[t]], own[:, t], np.minimum(to, bits)))
            rough = q @ segment.x.T
            for i, query in enumerate(right.column("vec_id").to_pylist()):
                hit = np.zeros(len(segment.ids), bool)
                for places, (low, high) in zip(segment.places, spans):
                    hit[places[low[i] : high[i]]] = True
                near = np.flatnonzero(hit & (segment.ids != query))
                ids, score = best_of(segment.x, segment.ids, near, rough[i], q[i], k, forest.longest)
                out[0].extend([query] * len(ids))
                out[1].extend(ids.tolist())
                out[2].extend(score.tolist())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    asked_side = stored_queries.join(levels, "vec_id").select("*", everywhere(segments, "segment")).groupBy(*pair)
    hits = segment_side.cogroup(asked_side).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
