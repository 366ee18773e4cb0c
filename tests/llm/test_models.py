"""Classifiers on held-out rows, language models and nearest neighbours against plain versions."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewatch.llm.ann import nearest
from linewatch.llm.common import fold
from linewatch.llm.lm_scoring import pack_counts, pack_names, score_word_cross_entropy, unpack_counts, unpack_names
from linewatch.llm.quality import STATISTICS, QuadraticDiscriminant, document_statistics, fit_logistic, score_quality
from linewatch.llm.toxicity import FEATURES, PARTS, STEMS, Weights, learn_lexicons, score_toxicity, text_features

SF = "/root/testdata/sf0.01"


def test_fold_is_the_crc_of_the_id(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in (0, 7, 123456789012)], "doc_id long").select("doc_id", fold(5).alias("f"))
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in df.collect())


@pytest.mark.parametrize("score,label,least", [(score_toxicity, "toxic", 0.93), (score_quality, "quality", 0.95)])
def test_held_out_accuracy(spark, score, label, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = score(docs, labels)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    got = rows.join(labels, "doc_id").collect()
    assert rows.count() == docs.count()
    right = [r.predicted == r[label] for r in got if r.held_out]
    assert len(right) > 50 and sum(right) / len(right) >= least
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_scores_are_calibrated(spark):
    """On held-out documents, the mean score of a band is near the share of toxic ones in it."""
    sf = SF.replace("0.01", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(docs, labels).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").select("score", "toxic").toPandas()
    assert len(scored) > 300 and scored.toxic.sum() > 20
    assert abs(scored.score.mean() - scored.toxic.mean()) < 0.03
    error = sum(abs(b.score.mean() - b.toxic.mean()) * len(b) for _, b in scored.groupby((scored.score * 5).clip(upper=4).astype(int))) / len(scored)
    assert error < 0.04


@pytest.mark.parametrize("score", [score_toxicity, score_quality])
def test_classifiers_handle_awkward_rows(spark, awkward, nothing, no_labels, score):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("doc_id < 200").select("doc_id", "quality", "toxic", F.lit(1).alias("score"))
    docs = awkward.unionByName(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id between 20 and 199"), allowMissingColumns=True)
    rows = score(docs, labels, with_document=True)
    assert rows.count() == docs.count() and rows.where("score is null or predicted is null").count() == 0
    assert rows.select("document.*").columns == docs.columns
    assert score(nothing, labels).count() == 0
    bare = score(awkward, no_labels).select("score").distinct().collect()
    assert [r.score for r in bare] == [0.0 if score is score_toxicity else 1.0]


def test_features_see_obfuscated_and_addressed_insults():
    weights = Weights({"moron": 5.0, "abcd*": 3.0})
    f = dict(zip(FEATURES, text_features("You m0r0n! abcdefg is here and YOU ARE A MORON!!!", weights)))
    assert f["lexicon_count"] == 2 and f["obfuscated_count"] == 1 and f["near_count"] == 2 and f["strong_count"] == 1 and f["shouted_rate"] > 0
    assert text_features(None, weights) == text_features("", weights) == [0.0] * len(FEATURES)
    assert all(map(math.isfinite, text_features("\n", weights)))


def test_lexicon_holds_word_beginnings(spark):
    """Words that no two toxic documents share count by their beginnings, wherever they stand; one clean document has one by chance."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    toxic = [(i % PARTS, 1, f"the {'so ' * (i % 5)}grumble{letters[i]}x of it") for i in range(20)]
    clean = [(i % PARTS, 0, f"the {'so ' * (i % 5)}calm{letters[i % 26]}x of it{' grumbled' if i == 7 else ''}") for i in range(60)]
    rows = spark.createDataFrame(toxic + clean, "part int, label int, text string").repartition(3)
    for left, lexicon in learn_lexicons(rows, 0.004, 10.0).items():
        n1, n0, k0 = (20, 60, 1) if left is None else (15, 45, int(left != 7 % PARTS))
        assert set(lexicon) == {f"{'grumble'[:n]}*" for n in STEMS}
        assert all(math.isclose(w, math.log((n1 / n1) / ((k0 + 1) / n0))) for w in lexicon.values())


def test_discriminant_equals_gaussian_densities():
    rng = np.random.default_rng(0)
    d = len(STATISTICS)
    x = {c: rng.normal(size=(500, d)) @ rng.normal(size=(d, d)) + c for c in (0, 1)}
    model = QuadraticDiscriminant({c: (len(z), z.sum(0), z.T @ z) for c, z in x.items()}, 0.0, 0.0)
    z = x[0][:20]
    want = np.zeros(20)
    for c, sign in ((1, 1), (0, -1)):
        cov = np.cov(x[c].T, bias=True)
        diff = z - x[c].mean(0)
        want += sign * (-0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.difference(z), want, rtol=1e-3, atol=1e-2)
    assert all(map(math.isfinite, document_statistics(None) + document_statistics("a\n\n|")))
    slope, shift = fit_logistic(np.array([-2.0, -1, 1, 2] * 20), np.array([0.0, 0, 1, 1] * 19 + [0, 1, 0, 1]))
    assert slope > 0 and abs(shift) < 1


def plain_word_losses(texts, all_texts, text, prior=8.0):
    """Word bigram losses by counting dictionaries."""
    sides = [[t.split() for t in x if t.split()] for x in (texts, all_texts)]
    one, every = (Counter(w for t in x for w in [*t, None]) for x in sides)
    two = Counter(g for t in sides[0] for g in zip([None, *t], [*t, None]))
    words, out = text.split(), []
    for a, b in zip([None, *words], [*words, None]):
        low = (one[b] + prior * every[b] / sum(every.values())) / (sum(one.values()) + prior)
        out.append(-math.log((two[a, b] + prior * low) / (one[a] + prior)))
    return sum(out) / len(out)


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 20])
def test_word_cross_entropy_equals_plain_models(spark, nothing, chunk_bytes):
    docs = [(0, "the cat sat on the mat"), (1, "the dog sat"), (2, "zzzz qqq é"), (3, ""), (4, None), (5, " \n"), (1, "the dog sat"), (None, "no cat"), (7, "the mat sat on the cat")]
    target = spark.createDataFrame([(0,), (1,), (1,), (None,)], "doc_id long")
    rows = score_word_cross_entropy(spark.createDataFrame(docs, "doc_id long, text string"), target, chunk_bytes).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in docs)
    all_texts, good = [t or "" for _, t in docs], [t for i, t in docs if i in (0, 1)]
    for r in rows:
        text = dict(docs)[r.doc_id] or ""
        assert r.n_tokens == len(text.split())
        want = (plain_word_losses(good, all_texts, text), plain_word_losses(all_texts, all_texts, text)) if text.split() else (0.0, 0.0)
        assert (r.target_loss, r.background_loss) == (pytest.approx(want[0]), pytest.approx(want[1]))
        assert r.score == pytest.approx(r.target_loss - r.background_loss)
    assert score_word_cross_entropy(nothing, target).count() == 0


@pytest.mark.parametrize("steps", [[], [5], [5, 6], [1 << 40, (1 << 63) + 5, (1 << 64) - 1], [0, (1 << 48) - 1, 1 << 49]])
def test_packed_names_and_counts(steps):
    names = np.array(steps, np.uint64)
    assert unpack_names(pack_names(names)).tolist() == steps
    counts = np.array([[1, 300, 1 << 40][: len(steps)], [0, 1 << 33, 7][: len(steps)]], np.int64)
    assert unpack_counts(pack_counts(*counts)).tolist() == counts.tolist()


@pytest.mark.parametrize("chunk_bytes", [1 << 24, 40_000])
def test_word_cross_entropy_of_awkward_rows(spark, awkward, chunk_bytes):
    """Null columns, a very long text, repeated rows, extra columns of clashing names; a target without documents."""
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    for ids in ([], [5, 6, 7]):
        target = spark.createDataFrame([(i,) for i in ids], "doc_id long")
        rows = score_word_cross_entropy(awkward, target, chunk_bytes).collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in docs)
        texts, good = [t or "" for _, t in docs], [t or "" for i, t in docs if i in ids]
        split = lambda t: [w.decode() for w in t.encode().split()]
        got = {(r.doc_id, r.n_tokens): r for r in rows}
        for i, t in docs:
            r = got[i, len(split(t or ""))]
            if r.n_tokens and r.n_tokens < 1000:
                want = [plain_word_losses([" ".join(split(x)) for x in side], [" ".join(split(x)) for x in texts], " ".join(split(t))) for side in (good, texts)]
                assert (r.target_loss, r.background_loss) == (pytest.approx(want[0]), pytest.approx(want[1]))


def test_registered_scoring_tells_word_order(spark, tmp_path):
    """Texts of the same words and the same byte triples differ by the pairs of words."""
    from linewatch.llm.queries import op8_lm_scoring

    docs = [(i, "pabcp pdefp pabcp pdefp" if i % 2 else "pabcp pabcp pdefp pdefp") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = op8_lm_scoring(spark, str(tmp_path)).collect()
    assert max(r.score for r in rows if r.doc_id % 2) < 0 < min(r.score for r in rows if r.doc_id % 2 == 0)
    assert {r.n_tokens for r in rows} == {4}


def test_word_cross_entropy_tells_quality(spark):
    from linewatch.llm.queries import op8_lm_scoring

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = op8_lm_scoring(spark, SF).join(labels.where(fold(4) == 2), "doc_id").groupBy("quality").agg(F.avg("score").alias("s")).collect()
    mean = {r.quality: r.s for r in got}
    assert mean[1] < mean[0]


def brute_nearest(rows, queries, k):
    out = {}
    for q, x in queries:
        scored = [(-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q]
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def test_recall_on_the_table(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in v.collect()]
    got = nearest(v, v.where("vec_id % 20 = 0")).collect()
    want = brute_nearest(rows, [r for r in rows if r[0] % 20 == 0], 20)
    found = {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] for q in want}
    assert sum(len(set(found[q]) & set(want[q])) for q in want) / sum(map(len, want.values())) >= 0.9
    vectors = dict(rows)
    for r in got:
        assert r.score == pytest.approx(sum(a * b for a, b in zip(vectors[r.query_id], vectors[r.vec_id])), rel=1e-12)
    for q, ids in found.items():
        scores = [next(r.score for r in got if (r.query_id, r.vec_id) == (q, i)) for i in ids]
        assert [(-s, i) for s, i in zip(scores, ids)] == sorted((-s, i) for s, i in zip(scores, ids))


def test_nearest_handles_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [5.0, 0.1]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]),
            (7, [float("inf"), 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [-1.0, 0.0]), (1, [1.0, 0.0]), (20, [0.5, 0.5])]
    v = spark.createDataFrame([(i, x, 1, "s") for i, x in rows], "vec_id long, embedding array<double>, rank int, vec string")
    got = nearest(v, v.where("vec_id % 20 = 0"), k=20, candidate_share=1.0).collect()
    by = {q: [(r["rank"], r.vec_id) for r in sorted((x for x in got if x.query_id == q), key=lambda r: r["rank"])] for q in (0, 20)}
    assert by[0] == [(1, 3), (2, 1), (3, 2), (4, 20), (5, 10)]  # longer vectors first, ties to the smaller id, all candidates
    assert [i for _, i in by[20]] == [3, 0, 1, 2, 10]
    empty = v.where("false")
    assert nearest(empty, empty).count() == 0 and nearest(v, empty).count() == 0


def test_nearest_finds_all_candidates_of_small_tables(spark):
    """With the query's own parameters: tables with fewer candidates than asked for, and many copies of the query's vector."""
    rng = np.random.default_rng(3)
    for n, dims, copies in ((13, 8, 0), (21, 64, 0), (60, 64, 0), (150, 16, 10)):
        x = rng.normal(size=(n, dims))
        x /= np.sqrt((x**2).sum(1))[:, None]
        x[1 : 1 + copies] = x[0]
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = nearest(v, v.where("vec_id % 20 = 0")).collect()
        want = brute_nearest(rows, [r for r in rows if r[0] % 20 == 0], 20)
        assert {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] for q in want} == want


@pytest.mark.parametrize("scale", [1.0, 4096.7, 1e150])
def test_ties_of_many_copies_go_to_the_smaller_id(spark, scale):
    """Sixty copies of a vector with components of any size, in several segments: the score's rounding hides no smaller id."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 24)) * scale
    x[20:80] = x[1] * 1.5
    x[80:140] = x[20] * (1 + 2.0**-52)  # nearly equal
    order = rng.permutation(200)
    rows = [(int(i), x[i].tolist()) for i in order]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(v, v.where("vec_id in (1, 20, 90, 140)"), candidate_share=1.0, segment_rows=30).collect()

    def plain(a, b):
        out = 0.0
        for p, q in zip(a, b):
            out += p * q
        return out

    for q in (1, 20, 90, 140):
        want = sorted((-plain(x[q].tolist(), x[i].tolist()), i) for i in range(200) if i != q)[:20]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_share_of_rows_and_recall(spark):
    """What the default ascent holds: under 0.7 of the rows, and 0.9 of the nearest, on the larger table."""
    from linewatch.llm import ann

    v = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/embeddings.parquet")
    rows = v.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = {}
    for r in ann.nearest(v, v.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    forest = ann.Forest(x.shape[1], float(np.sqrt((x**2).sum(1).max())), 64, 32, 11)
    stored, recall, shares = forest.strings(x, True), [], []
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        recall.append(len(got[int(ids[q])] & set(ids[np.argsort(-score)[:20]].tolist())) / 20)
        shared = forest.shared(stored ^ forest.strings(x[q][None], False))
        held = np.array([(shared.max(0) >= level).sum() - 1 for level in range(33)])
        enough = math.ceil(0.65 * held[0])
        level = max(i for i in range(33) if held[i] >= enough)
        part = math.ceil(64 * (enough - held[level + 1]) / max(1, held[level] - held[level + 1]))
        shares.append(((shared.max(0) > level) | (shared[:part] >= level).any(0)).mean())
    assert np.mean(recall) >= 0.9 and np.mean(shares) < 0.7, (np.mean(recall), np.mean(shares))
