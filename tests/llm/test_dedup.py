"""Similarity join, substring and suffix dedup against brute force."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pytest

from linewatch.llm import ngram_join
from linewatch.llm.components import connected_components
from linewatch.llm.ngram_join import Bands, group_links, intersections, one_of_each_group, similar_groups, sketch
from linewatch.llm.repeats import Rolling, bytes_of, least_places
from linewatch.llm.substring_dedup import remove_repeats, substring_digests, without_repeats
from linewatch.llm.suffix_dedup import remove_repeated_bytes

SCHEMA = "doc_id long, text string"


def shingle_sets(docs, width):
    out = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    return out


def brute_groups(docs, width, percent):
    sets, inverted, common = shingle_sets(docs, width), collections.defaultdict(list), collections.Counter()
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    for ids in inverted.values():
        common.update(itertools.combinations(sorted(ids), 2))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def families(seed, bases=60, most=8):
    rng, docs = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(2000)]
    for _ in range(bases):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 12, 20, 40, 100, 300]))]
        for _ in range(rng.randint(1, most)):
            x = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, max(1, len(x) // 50)])):
                k = rng.randrange(len(x) + 1)
                match rng.randrange(4):
                    case 0 if x:
                        x[min(k, len(x) - 1)] = rng.choice(vocabulary)
                    case 1:
                        x.insert(k, rng.choice(vocabulary).upper())
                    case 2:
                        x = x[1:]
                    case _:
                        x = x[:-1]
            docs.append((len(docs), " ".join(x)))
    return docs + [(len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, docs[3][1])]


@pytest.mark.parametrize("seed,width,percent", [(1, 4, 85), (2, 1, 85), (3, 5, 80), (4, 1, 60)])
def test_groups_equal_brute_force(spark, seed, width, percent):
    docs = families(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(spark.createDataFrame(docs, SCHEMA), width, percent).collect()}
    assert got == brute_groups(docs, width, percent)


def test_a_large_group_around_the_threshold(spark):
    """Copies that link with their base only here and there, as in a group that no single hub joins."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for i in range(700):
        x = list(base)
        for _ in range(rng.randint(1, 6)):
            x[rng.randrange(len(x))] = f"e{rng.randrange(10**6)}"
        docs.append((i, " ".join(x)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(spark.createDataFrame(docs, SCHEMA), 4, 85).collect()}
    assert got == brute_groups(docs, 4, 85)


def test_blocks_find_the_links_of_all_components(spark):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.choice(60, 30)).astype(np.int64) for _ in range(150)]
    frame = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "set long, hashes array<long>")
    placed = spark.createDataFrame([(i, 0, i // 40) for i in range(150)], "set long, group long, root long")
    links = group_links(placed, frame, 40, block=16).collect()
    same = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 40 * len(np.union1d(a, b))
    assert all(same(sets[r.a], sets[r.b]) for r in links)

    def roots(edges):
        parent = list(range(4))
        for a, b in edges:
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
        return [next(x for x in iter(lambda v=[i]: v.__setitem__(0, parent[v[0]]) or v[0], None) if parent[x] == x) for i in range(4)]

    want = [(i // 40, j // 40) for i, j in itertools.combinations(range(150), 2) if same(sets[i], sets[j])]
    assert roots([(r.a // 40, r.b // 40) for r in links]) == roots(want)


def test_texts_chained_by_chance_are_not_sent_to_blocks(spark, monkeypatch):
    """Different texts share keys of empty segments, the more the larger the table; blocks of such a chain grow with its square."""
    rng = random.Random(12)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 140))] for _ in range(3000)]
    texts += [[*t[:50], "other", *t[51:]] for t in texts[:100]]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    largest = []

    def spy(placed, sets, percent, **more):
        groups = placed.groupBy("group").agg({"set": "count", "root": "max"}).collect()
        largest.append(max((r["count(set)"] for r in groups), default=0))
        return group_links(placed, sets, percent, **more)

    monkeypatch.setattr(ngram_join, "group_links", spy)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(spark.createDataFrame(docs, SCHEMA), 5, 80).collect()}
    assert got == brute_groups(docs, 5, 80) and got[3000][1] == 0
    assert len(largest) == 1 and largest[0] <= 4


def test_blocks_join_a_large_component_and_few_others(spark):
    rng = np.random.default_rng(8)
    base = np.arange(100)
    sets = [np.append(base, 100 + rng.choice(900, 3, replace=False)) for _ in range(390)] + [np.arange(2000 + 50 * i, 2050 + 50 * i) for i in range(9)] + [base[:90]]
    frame = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "set long, hashes array<long>")
    placed = spark.createDataFrame([(i, 0, 0 if i < 390 else i) for i in range(400)], "set long, group long, root long")
    links = group_links(placed, frame, 80, block=16).collect()
    assert links and {min(r.a, r.b) < 390 and max(r.a, r.b) for r in links} == {399}


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(6)
    for n in (1, 30, 3000, 60_000):
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        a[: n // 3] >>= np.uint64(9)  # many in one part
        b = np.union1d(a[: n - n // 10], rng.integers(0, 1 << 64, n // 7, dtype=np.uint64))
        x, y = (np.frombuffer(sketch(s), np.uint8).astype(int) for s in (a, b))
        assert len(x) == len(y) == ngram_join.PARTS and abs(x - y).sum() <= len(np.setxor1d(a, b))
    assert not np.frombuffer(sketch(np.empty(0, np.uint64)), np.uint8).any()


@pytest.mark.parametrize("heavy", [0, 4, 10**9])
def test_intersections(heavy):
    rng = np.random.default_rng(1)
    a, b = ([np.unique(rng.choice(50, n)).astype(np.int64) for n in rng.integers(1, 40, size=k)] for k in (7, 11))
    assert (intersections(a, b, heavy=heavy, width=8) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_levels_always_reach_the_need():
    rng = np.random.default_rng(2)
    for percent in (60, 80, 85, 95):
        bands = Bands(percent)
        for size in [*range(1, 60), 100, 333, 1000, 5000]:
            own = int(np.searchsorted(bands.lows, size, side="right")) - 1
            for band in {own, max(own - 1, 0)}:
                high, segments, flexible = bands.plan(band)
                need = bands.differ(size, min(size, high)) + 1
                if flexible and need > 1:
                    counts = np.bincount(rng.integers(0, segments, size), minlength=segments)
                    assert int((bands._allot(counts, need, flexible) + 1).sum()) >= need


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_handles_awkward_rows(spark, awkward, nothing):
    rows = similar_groups(awkward, 4, 85).collect()
    assert len(rows) == awkward.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.n_shingles, r.component_id))
    assert by[0] == by[1][:0] + [(0, 0)] and by[1] == [(0, 1)] and by[2] == [(0, 2)] and by[3] == [(1, 3)]
    assert {c for _, c in by[6] + by[11]} == {6} and (by[None][0][1] == 6) and len(by[6]) == 3 and len(by[7]) == 2
    assert similar_groups(nothing, 4, 85).count() == 0
    kept = one_of_each_group(awkward)
    assert kept.columns == awkward.columns and kept.dtypes == awkward.dtypes
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 7], key=str) or {0, 1, 2, 3, 4, 5, 6, 9, 10, 7} <= set(ids)
    assert ids.count(6) == 1 and 11 not in ids and None not in ids and ids.count(7) == 1
    assert one_of_each_group(nothing).count() == 0


def covered(units, length):
    """Per unit of each sequence: whether a window that starts elsewhere too covers it."""
    starts = collections.Counter(tuple(u[p : p + length]) for u in units for p in range(len(u) - length + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for p in range(len(u) - length + 1):
            if starts[tuple(u[p : p + length])] > 1:
                gone[p : p + length] = [True] * length
        out.append(gone)
    return out


def passages(seed, unit, n=60):
    """Texts of few symbols with pieces taken over from one another, repeats within a text, and edits in copies."""
    rng = random.Random(seed)
    pool = [[rng.choice(unit) for _ in range(rng.choice([5, 20, 60, 200, 500, 900]))] for _ in range(12)]
    texts = []
    for _ in range(n):
        t = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            piece = p[a : a + rng.randint(1, len(p))]
            for _ in range(rng.choice([0, 0, 1, 2])):
                piece[rng.randrange(len(piece))] = rng.choice(unit)
            t += piece + [rng.choice(unit) for _ in range(rng.randint(0, 30))]
        texts.append(t)
    return texts + [[unit[0]] * 700, [unit[0], unit[1]] * 400]


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_equals_brute_force(spark, seed):
    units = passages(seed, [f"t{i}" for i in range(30)])
    docs = spark.createDataFrame([(i, " ".join(u)) for i, u in enumerate(units)], SCHEMA)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_digests(docs, 35).collect()}
    for i, (u, gone) in enumerate(zip(units, covered(units, 35))):
        kept = " ".join(w for w, g in zip(u, gone) if not g)
        assert got[i] == (len(u), sum(gone), hashlib.sha256(kept.encode()).hexdigest()), i


@pytest.mark.parametrize("seed", [3, 4])
def test_suffix_dedup_equals_brute_force(spark, seed):
    units = passages(seed, ["a", "b", "é", "c", " ", "d"])
    texts = ["".join(u) for u in units]
    raw = [t.encode() for t in texts]
    got = {r.doc_id: r for r in remove_repeated_bytes(spark.createDataFrame(list(enumerate(texts)), SCHEMA), 400).collect()}
    for i, (u, gone) in enumerate(zip(raw, covered(raw, 400))):
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(u, gone) if not g)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(u), sum(gone), runs, hashlib.sha256(kept).hexdigest()), i
        assert sum(s.end - s.start for s in r.removed) == sum(gone)


def test_dedup_handles_awkward_rows(spark, awkward, nothing):
    rows = remove_repeats(awkward, 35).collect()
    assert len(rows) == awkward.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.n_words, r.n_removed))
    assert by[0] == by[1] == by[2] == [(0, 0)] and by[6] == [(80, 80)] * 3 and by[8] == [(82, 80)] and by[10] == [(1800, 1800)]
    assert by[None] == [(80, 80)] and by[5] == [(60_000, 0)]
    cut = without_repeats(awkward, 35)
    assert cut.columns == awkward.columns and cut.dtypes == awkward.dtypes
    texts = {(r.doc_id, r.text, r.n_chars) for r in cut.collect()}
    assert {(8, "before after", 12), (0, None, 0), (2, "  \t\n", 2), (6, "", 0)} <= texts
    byte_rows = remove_repeated_bytes(awkward).collect()
    assert len(byte_rows) == awkward.count() and {(r.n_bytes, r.n_removed) for r in byte_rows if r.doc_id == 9} == {(5000, 5000)}
    assert remove_repeats(nothing).count() == remove_repeated_bytes(nothing).count() == without_repeats(nothing, 35).count() == 0
    with pytest.raises(ValueError):
        remove_repeated_bytes(nothing, 100)


def test_least_places_and_rolling():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 5, 200).astype(np.uint64) << np.uint64(32)
    got = least_places(v, 9)
    assert got.tolist() == [p + int(np.argmin(v[p : p + 10])) for p in range(len(v) - 9)]
    codes = bytes_of("abcabcab" * 5)
    r = Rolling(codes)
    at = r.at(np.arange(30), 6)
    assert at[0] == at[8] and at[4] == at[12] and at[0] not in (at[1], at[3])


def test_stretches_do_not_change_the_result(spark, monkeypatch):
    from linewatch.llm import repeats

    units = passages(7, [f"t{i}" for i in range(30)], 20)
    docs = spark.createDataFrame([(i, " ".join(u)) for i, u in enumerate(units)], SCHEMA)
    want = sorted(map(tuple, substring_digests(docs, 35).collect()))
    monkeypatch.setattr(repeats, "STRETCH", 50)
    assert sorted(map(tuple, substring_digests(docs, 35).collect())) == want


def test_near_duplicate_defaults():
    import inspect

    names = inspect.signature(one_of_each_group).parameters
    assert (names["width"].default, names["percent"].default) == (5, 80)


def test_registered_suffix_query_equals_brute_force(spark):
    """Every row of the table, byte by byte: digests, counts and the removed spans."""
    from linewatch.llm.queries import op6_suffix_dedup

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen, twice = set(), set()
    for raw in texts.values():
        for i in range(len(raw) - 399):
            h = hash(raw[i : i + 400])
            (twice if h in seen else seen).add(h)
    rows = {r.doc_id: r for r in op6_suffix_dedup(spark, sf).collect()}
    assert rows.keys() == texts.keys()
    removed = 0
    for doc, raw in texts.items():
        gone, spans = 0, []
        for i in range(len(raw) - 399):
            if hash(raw[i : i + 400]) in twice:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 400
                else:
                    spans.append([i, i + 400])
        kept = bytearray(raw)
        for a, z in reversed(spans):
            del kept[a:z]
            gone += z - a
        r = rows[doc]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), gone, len(spans), hashlib.sha256(kept).hexdigest())
        assert [[s.start, s.end] for s in r.removed] == spans
        removed += gone
    assert removed > 0
