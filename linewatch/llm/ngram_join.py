"""N-gram Jaccard self-join by universe partition and pigeonhole.

Sets fall in size bands, so narrow that a set can only be similar to smaller sets of its own band and the one below. For a
band the universe of tokens is cut by hash into segments. Two similar sets differ in H tokens at most; if a probe allots its
segments levels k (-1: skipped, 0: equal, 1: equal but for one token) with sum(k + 1) > H, some allotted segment of any
similar set agrees with it within its level. So

* the index side files every segment's subset, and for the band's flexible segments all subsets with one token deleted;
* the probe side looks up its allotted segments' subsets, and their one-deletion neighbourhoods at level 1;
* how many segments are flexible is chosen for a band by cost, and a probe spends its spare levels by cost too: it skips the
  segments with the fewest tokens, whose subsets are the least telling, and buys more skips with level 1.

Candidates share a key that one files and the other probes; they are verified exactly, but groups of many similar sets are not
paired off. First every key's sets are verified against the key's hub, the set with the most shared keys, which joins most of a
group of near copies. Then the other candidates that are still in different components:

* most keys chain sets that have little in common, more so the larger the table (many sets have an empty segment, and it takes
  one probe to chain them all). Their candidates are verified pair by pair, and before that by sketches, which tell most
  chance candidates apart at a few bytes;
* keys with very many pairs are those of large groups of near copies. Groups chained by such keys alone, if still in several
  components, are cut in blocks; a task compares a block of the sets outside the group's largest component with one other block
  by matrix products, and hands over a spanning forest of the links that it finds and not the links themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewatch.llm.common import stored
from linewatch.llm.components import connected_components
from linewatch.llm.exchange import KEY, MANY, bucket_count, find_many, mix, runs_of
from linewatch.llm.repeats import WordCodes, identified

RECORD = np.dtype([KEY, ("set", "<i8"), ("size", "<u4"), ("role", "u1"), MANY])
INDEX, PROBE = 1, 2
#: Parts of the hash range that a sketch counts.
PARTS = 128
#: Sets of a block; and pairs for each row that a key's sets would be sent as in blocks, from which on they are.
BLOCK, PAIRS = 768, 16


def shingle_hashes(text: str | None, width: int, codes: WordCodes) -> np.ndarray:
    """Sorted hashes of the distinct ``width``-word shingles, A-Z lower-cased; with fewer words, the whole sequence as one."""
    words = (text or "").encode().lower().split()
    n = min(len(words), width)
    if not n:
        return np.empty(0, np.uint64)
    c = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    factors = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    last = len(c) - n + 1
    total = np.full(last, n * 0xD6E8FEB86659FD93 % (1 << 64), np.uint64)
    for i in range(n):
        total = total + c[i : i + last] * factors[i]
    return np.unique(mix(total))


def set_name(hashes: np.ndarray) -> int:
    """A 64-bit name of a set by its content; 0 for the empty set."""
    if not len(hashes):
        return 0
    import xxhash

    return (xxhash.xxh3_64_intdigest(hashes.tobytes()) | 1) - (1 << 63)


def sketch(hashes: np.ndarray) -> bytes:
    """How many hashes fall in each of ``PARTS`` equal parts of their range, 255 at most."""
    part = (hashes >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(part, minlength=PARTS), 255).astype(np.uint8).tobytes()


class Bands:
    """Size bands and, for each, its segments and flexible segments. ``percent``: two sets link at this Jaccard similarity."""

    EMPTY_COST = 50.0  # candidates that a key of an empty subset is taken to bring; each token in it divides that by e

    def __init__(self, percent: int):
        self.percent = percent
        lows = [1]
        while lows[-1] < 1 << 40:
            lows.append(lows[-1] * 100 // percent + 1)
        self.lows = np.array(lows)
        self.plans: dict[int, tuple[int, int, int]] = {}

    def differ(self, a: int, b: int) -> int:
        """The most tokens in which linked sets of these sizes differ."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def plan(self, band: int) -> tuple[int, int, int]:
        """Largest size, segments and flexible segments: the cheapest split by keys to file and chance candidates.

        Flexible segments are tried in doubling numbers up to half the need.
        """
        if band not in self.plans:
            high = int(self.lows[band + 1]) - 1
            need = self.differ(high, high * 100 // self.percent) + 1
            options = []
            for flexible in (1 << i for i in range((need // 2).bit_length())):
                segments = need + -(-need // 16) - flexible
                tokens = high / segments
                keys = 2 * segments + flexible * (2 * tokens + 2)
                options.append((keys + self.EMPTY_COST * segments * math.exp(-tokens), segments, flexible))
            self.plans[band] = (high, *min(options)[1:]) if options else (high, 1, 0)
        return self.plans[band]

    def records(self, tokens: np.ndarray, name: int) -> Iterator[np.ndarray]:
        """Key records of one set: as index and probe in its own band, as probe in the band below."""
        size = len(tokens)
        own = int(np.searchsorted(self.lows, size, side="right")) - 1
        weights = mix(tokens ^ np.uint64(0xA0761D6478BD642F))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(weights, dtype=np.uint64)])
        for band in (own, own - 1):
            if band < 0:
                continue
            high, segments, flexible = self.plan(band)
            need = self.differ(size, min(size, high)) + 1
            if not flexible or need < 2 and band != own:
                continue  # only equal sets could link, and those are one set here
            edges = np.arange(1, segments, dtype=np.uint64) * np.uint64((1 << 64) // segments)
            cuts = np.concatenate([[0], np.searchsorted(tokens, edges), [size]])
            counts = np.diff(cuts)
            subset = sums[cuts[1:]] - sums[cuts[:-1]]
            place = mix(np.arange(segments, dtype=np.uint64) + np.uint64((band + 1) << 32))
            exact = mix(subset + place)
            lessened = mix(subset + mix(place))  # where a subset meets others less one token
            level = self._allot(counts, need, flexible) if need > 1 else np.full(segments, -1, np.int8)
            keys, roles = [exact[level >= 0]], [np.full((level >= 0).sum(), PROBE, np.uint8)]
            bent = np.flatnonzero(level[:flexible] > 0)
            if len(bent):
                keys.append(lessened[bent])
                roles.append(np.full(len(bent), PROBE, np.uint8))
            for s in range(flexible) if band == own else bent.tolist():
                less = subset[s] - weights[cuts[s] : cuts[s + 1]]
                if band == own:
                    keys.append(mix(less + mix(place[s : s + 1])))
                    roles.append(np.full(len(less), INDEX, np.uint8))
                if level[s] > 0:
                    keys.append(mix(less + place[s]))
                    roles.append(np.full(len(less), PROBE, np.uint8))
            if band == own:
                roles[0] = roles[0] | np.uint8(INDEX)
                keys.append(exact[level < 0])
                roles.append(np.full((level < 0).sum(), INDEX, np.uint8))
            key = np.concatenate(keys)
            out = np.zeros(len(key), RECORD)
            out["key"], out["set"], out["size"], out["role"] = key, name, size, np.concatenate(roles)
            yield out

    def _allot(self, counts: np.ndarray, need: int, flexible: int) -> np.ndarray:
        """Levels with sum(level + 1) >= need: spare segments with the fewest tokens are skipped, and where a kept segment is
        still nearly empty, a flexible one is raised to level 1 if its neighbourhood costs less than the chance candidates."""
        level = np.zeros(len(counts), np.int8)
        spare = len(counts) - need
        bendable = np.argsort(counts[:flexible], kind="stable").tolist()
        while spare < 0:
            level[bendable.pop()] = 1
            spare += 1
        for s in np.argsort(counts, kind="stable").tolist():
            if level[s] > 0:
                continue
            if spare == 0:
                bend = next((b for b in bendable if b != s and level[b] == 0 and counts[b] > 0), None)
                if bend is None or counts[bend] + 2 >= self.EMPTY_COST * math.exp(-counts[s]):
                    break
                level[bend] = 1
                spare += 1
            level[s] = -1
            spare -= 1
        return level


def distinct_pairs(r: np.ndarray) -> np.ndarray:
    """Per record sorted by key: whether its key has an index entry and a probe of different sets, or is marked."""
    starts, lengths = runs_of(r["key"])
    differ = np.minimum.reduceat(r["set"], starts) != np.maximum.reduceat(r["set"], starts)
    both = np.bitwise_or.reduceat(r["role"], starts) == INDEX | PROBE
    return np.repeat(differ & both | (np.maximum.reduceat(r["many"], starts) > 0), lengths)


def shingled(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row, set (the name of the row's shingle set, 0 if empty), its size and sketch, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for b in batches:
            sets = [shingle_hashes(t.as_py(), width, codes) for t in b.column("text")]
            names, sizes = pa.array([set_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())
            columns = [b.column("doc_id"), b.column("row"), names, sizes, pa.array([sketch(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "set", "size", "sketch"])

    return docs.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, set long, size long, sketch binary")


def shared_keys(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """key, set, size, role: the filed and probed keys that an index entry and a probe of different sets have in common."""

    def make(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        codes, bands = WordCodes(), Bands(percent)
        for text in batch.column("text"):
            tokens = shingle_hashes(text.as_py(), width, codes)
            if len(tokens):
                yield from bands.records(tokens, set_name(tokens))

    def give(r: np.ndarray) -> pa.Table:
        return pa.table(
            {"key": np.ascontiguousarray(r["key"]).view("<i8"), "set": np.ascontiguousarray(r["set"]), "size": r["size"].astype(np.int64), "role": r["role"].astype(np.int32)}
        )

    return find_many(
        docs.select("text"), make, RECORD, give, "key long, set long, size long, role int", bucket_count(docs), mark=distinct_pairs, unique=("set", "role")
    ).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked of candidate pairs of set names, from the whole sets (``set``, ``hashes``)."""
    left = sets.select(F.col("set").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("set").alias("b"), F.col("hashes").alias("y"))
    found = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("x").alias("m"), F.size("y").alias("n"), F.size(F.array_intersect("x", "y")).alias("common"))
    union = F.col("m") + F.col("n") - F.col("common")
    return found.select("a", "b", (100 * F.col("common").cast("long") >= percent * union.cast("long")).alias("linked"))


def compatible(a: str, b: str, percent: int):
    """Sizes of sets that can be similar."""
    return 100 * F.least(F.col(a), F.col(b)) >= percent * F.greatest(F.col(a), F.col(b))


def candidates(keys: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of sets a, b to be verified one by one (``star``: one is the hub of a key of both), and the stars a, b of the keys
    that have too many pairs for that."""
    shares = keys.groupBy("set").agg(F.count("*").alias("shared"))
    ranked = keys.join(shares, "set").select("key", "set", "size", "role", F.struct("shared", -F.col("set")).alias("rank"))
    is_filed, is_probed = (F.col("role").bitwiseAND(F.lit(r)) > 0 for r in (INDEX, PROBE))
    per_key = ranked.groupBy("key").agg(
        F.max_by(F.struct("set", "size"), "rank").alias("hub"), F.count_if(is_filed).alias("filed"), F.count_if(is_probed).alias("probed")
    )
    sets = F.col("filed") + F.col("probed")
    crowded = F.col("filed") * F.col("probed") > PAIRS * sets * F.ceil(sets / BLOCK)
    held = per_key.select("key", F.col("hub.set").alias("hub"), F.col("hub.size").alias("hub_size"), crowded.alias("crowded"))
    keyed, _ = stored(keys.join(held, "key"), "join-keyed")

    star = keyed.where("set != hub").select(F.col("hub").alias("x"), F.col("hub_size").alias("m"), F.col("set").alias("y"), F.col("size").alias("n"), F.lit(True).alias("star"))
    filed = keyed.where(~F.col("crowded") & is_filed).select("key", F.col("set").alias("x"), F.col("size").alias("m"))
    probed = keyed.where(~F.col("crowded") & is_probed).select("key", F.col("set").alias("y"), F.col("size").alias("n"))
    others = filed.join(probed, "key").where("x != y").select("x", "m", "y", "n", F.lit(False).alias("star"))
    both = star.unionByName(others).where(compatible("m", "n", percent))
    pairs = both.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("star").alias("star"))
    return pairs, keyed.where("crowded and set != hub").select(F.col("hub").alias("a"), F.col("set").alias("b")).distinct()


def likely(pairs: DataFrame, names: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b, star) whose sketches allow a link. ``names`` has set, size and sketch.

    Two sets differ in as many tokens as their sketches differ by in all parts, or more; so no linked pair is lost.
    """
    left, right = (names.select(F.col("set").alias(s), F.col("size").alias(f"size_{s}"), F.col("sketch").alias(f"sketch_{s}")) for s in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(f"sketch_{s}").to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int16) for s in "ab")
            apart = np.abs(x - y).sum(axis=1, dtype=np.int64)
            size = b.column("size_a").to_numpy() + b.column("size_b").to_numpy()
            some = pa.array((100 + percent) * apart <= (100 - percent) * size)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("a", "b", "star")], names=["a", "b", "star"]).filter(some)

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long, star boolean")


def set_links(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, row, set, size), and links a, b between different sets that leave no similar sets in two components."""
    rows, _ = stored(shingled(docs, width), "join-rows")
    keys, _ = stored(shared_keys(docs, width, percent), "join-keys")
    pairs, crowds = candidates(keys, percent)
    one = rows.groupBy("set").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    names, _ = stored(keys.select("set").distinct().join(one, "set"), "join-names")
    near, _ = stored(likely(pairs, names, percent), "join-near")
    groups = connected_components(crowds).select(F.col("node").alias("set"), F.col("root").alias("group"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for b in batches:
            sets = [shingle_hashes(t.as_py(), width, codes) for t in b.column("text")]
            columns = [pa.array([set_name(s) for s in sets], pa.int64()), pa.array([s.view("<i8") for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["set", "hashes"])

    asked = near.select(F.explode(F.array("a", "b")).alias("set")).unionByName(groups.select("set")).distinct()
    wanted = docs.select("row", "text").join(names.join(asked, "set").select("row"), "row", "left_semi").select("text")
    sets, _ = stored(wanted.mapInArrow(hashes, "set long, hashes array<long>").dropDuplicates(["set"]), "join-sets")

    first, _ = stored(verified(near.where("star"), sets, percent).where("linked").select("a", "b"), "join-first")
    roots = connected_components(first).select(F.col("node").alias("set"), "root")
    left, right = (roots.select(F.col("set").alias(s), F.col("root").alias(f"root_{s}")) for s in "ab")
    apart = near.where(~F.col("star")).join(left, "a", "left").join(right, "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    second = verified(apart.select("a", "b"), sets, percent).where("linked").select("a", "b")
    third = group_links(groups.join(roots, "set", "left").withColumn("root", F.coalesce("root", "set")), sets, percent)
    links, _ = stored(first.unionByName(second).unionByName(third), "join-links")
    return rows, links


def group_links(placed: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links a, b that join the components (``root``) of every candidate ``group`` of sets as far as they have any link.

    A group whose sets are all in one component is left alone. Else the sets of its largest component and the others are cut
    in blocks of about ``block`` sets. A block of the others against one like it, itself included, or one of the largest
    component is one unit of work.
    """
    placed, _ = stored(placed.select("set", "group", "root"), "join-placed")
    sizes = placed.groupBy("group", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("group").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("settled_n"), F.sum("n").alias("total"), F.count("*").alias("roots")
    ).where("roots > 1")
    main, _ = stored(main, "join-main")  # a plain shuffle on both sides of the join lets Spark split a large group
    open_blocks = F.ceil((F.col("total") - F.col("settled_n")) / block).cast("int")
    blocks = open_blocks + F.ceil(F.col("settled_n") / block).cast("int")  # those of the largest component come last
    settled, spot = F.col("root") == F.col("main"), F.xxhash64("set")
    dealt = (
        placed.join(main, "group")
        .withColumn("own", F.when(settled, open_blocks + F.pmod(spot, blocks - open_blocks)).otherwise(F.pmod(spot, open_blocks)).cast("int"))
        .select("set", "group", "root", "own", F.explode(F.sequence(F.lit(0), F.when(settled, open_blocks).otherwise(blocks) - 1)).alias("other"))
        .select("set", "group", "root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own")
    )

    def compare(table: pa.Table) -> pa.Table:
        hashes = [np.asarray(h.values, dtype=np.int64) for h in table.column("hashes")]
        own = table.column("own").to_numpy()
        names, roots = table.column("set").to_pylist(), table.column("root").to_pylist()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        joined: dict[int, int] = {}

        def find(x: int) -> int:
            while joined.get(x, x) != x:
                joined[x] = joined.get(joined[x], joined[x])
                x = joined[x]
            return x

        out: tuple[list[int], list[int]] = ([], [])
        asked, against = np.flatnonzero(own == low), np.flatnonzero(own == high)
        sizes = np.array([len(h) for h in hashes])
        if len(asked) and len(against):
            common = intersections([hashes[i] for i in asked], [hashes[j] for j in against])
            union = sizes[asked][:, None] + sizes[against][None, :] - common
            for i, j in zip(*np.nonzero(100 * common >= percent * union)):
                a, b = int(asked[i]), int(against[j])
                x, y = find(roots[a]), find(roots[b])
                if x != y:
                    joined[x] = y
                    out[0].append(names[a])
                    out[1].append(names[b])
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return dealt.join(sets, "set").groupBy("group", "low", "high").applyInArrow(compare, "a long, b long")


def intersections(left: list[np.ndarray], right: list[np.ndarray], heavy: int = 64, width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of every left set with every right set: tokens in many sets by matrix products, others one by one."""
    out = np.zeros((len(left), len(right)))
    sides = []
    for sets in (left, right):
        token = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(token, kind="stable")
        sides.append((token[order], owner[order]))
    (ta, oa), (tb, ob) = sides
    tokens = np.intersect1d(ta, tb)
    starts = [(np.searchsorted(t, tokens), np.searchsorted(t, tokens, side="right")) for t in (ta, tb)]
    na, nb = (b - a for a, b in starts)
    many = na * nb > heavy
    light = np.flatnonzero(~many)
    if len(light):
        work = (na * nb)[light]
        which = np.repeat(light, work)
        step = np.arange(len(which)) - np.repeat(np.cumsum(work) - work, work)
        i, j = oa[starts[0][0][which] + step // nb[which]], ob[starts[1][0][which] + step % nb[which]]
        out += np.bincount(i * len(right) + j, minlength=out.size).reshape(out.shape)
    dense = np.flatnonzero(many)
    for at in range(0, len(dense), width):
        part = dense[at : at + width]
        pair = []
        for (first, last), owner, count in ((starts[0], oa, len(left)), (starts[1], ob, len(right))):
            m = np.zeros((count, len(part)), np.float32)
            n = (last - first)[part]
            column = np.repeat(np.arange(len(part)), n)
            m[owner[np.repeat(first[part], n) + np.arange(len(column)) - np.repeat(np.cumsum(n) - n, n)], column] = 1
            pair.append(m)
        out += pair[0] @ pair[1].T
    return out.astype(np.int64)


def rooted_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, row, size and root (the name of the least set of its component) of every row; ``docs`` has doc_id, text, row."""
    rows, links = set_links(docs, width, percent)
    roots = connected_components(links)
    named = rows.join(roots.withColumnRenamed("node", "set"), "set", "left").select("doc_id", "row", "size", F.coalesce("root", "set").alias("root"))
    return stored(named, "join-rooted")[0]


def similar_groups(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    Two rows link when 100 * intersection >= percent * union of their sets of ``width``-word shingles; component_id is the
    smallest doc_id reachable by links, the row's own included. Null, empty and wordless texts have empty sets and link with
    nothing. Rows that repeat a set are linked without being paired. A null doc_id counts as larger than any other.
    """
    placed = rooted_rows(identified(docs), width, percent)
    least = placed.where("size > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = placed.where("size > 0").join(least, "root").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    alone = placed.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of similar texts: that of the smallest doc_id (then of the least content hash).

    Texts without words are in no group and all stay.
    """
    rows = identified(docs, with_document=True)
    placed = rooted_rows(rows.drop("document"), width, percent)
    first = placed.where("size > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"))
    grouped = rows.join(first.select("first.row"), "row", "left_semi").dropDuplicates(["row"])
    wordless = rows.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return grouped.select("document.*").unionByName(wordless.select("document.*"))
