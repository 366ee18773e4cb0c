"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewatch.llm.common import drop_stored, fold, labelled_sample, schema_of, slices, stored, text_and, texts_of, whole_row

STATISTICS = (
    "log_words", "mean_word", "spread_word", "distinct_share", "top_share", "repeat_share", "symbol_rate", "pipe_rate",
    "digit_rate", "capital_rate", "stop_rate", "sentence_words", "line_words", "repeated_lines", "word_entropy", "odd_words",
)


def document_statistics(text: str | None) -> list[float]:
    """Transformed statistics of one whole text (``STATISTICS``); rates and shares enter as logs of (rate + a small floor)."""
    t = text or ""
    words = t.split()
    n, chars = len(words), max(1, len(t))
    counts = Counter(words)
    lengths = [len(w) for w in words] or [0]
    mean = sum(lengths) / len(lengths)
    spread = math.sqrt(sum((x - mean) ** 2 for x in lengths) / len(lengths))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    symbols = len(re.findall(r"[^\w\s.,;:!?'\"()-]", t))
    ends = len(re.findall(r"[.!?](?:\s|$)", t))
    lines = [x for x in t.split("\n") if x.strip()]
    entropy = -sum(c / n * math.log(c / n) for c in counts.values()) if n else 0.0
    odd = sum(1 for w in words if not w.strip(".,;:!?\"'()").isalpha())
    share = lambda k, of: math.log(k / of + 1e-3)
    return [
        math.log1p(n), math.log1p(mean), math.log1p(spread), share(len(counts), max(1, n)),
        share(max(counts.values(), default=0), max(1, n)), share(repeats, max(1, n)), share(symbols, chars), share(t.count("|"), chars),
        share(sum(map(str.isdigit, t)), chars), share(sum(map(str.isupper, t)), chars),
        share(sum(c for _, c in counts.most_common(5)), max(1, n)), math.log1p(n / max(1, ends)), math.log1p(n / max(1, len(lines))),
        share(len(lines) - len(set(lines)), max(1, len(lines))), entropy, share(odd, max(1, n)),
    ]


def class_moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of the statistics by label: one row a batch from the tasks, added up here."""
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            x = np.array([document_statistics(t) for t in b.column("text").to_pylist()]).reshape(-1, d)
            y = np.array(b.column("label").to_pylist(), dtype=int)
            for c in set(y.tolist()):
                z = x[y == c]
                old = total.setdefault(c, [0, np.zeros(d), np.zeros((d, d))])
                total[c] = [old[0] + len(z), old[1] + z.sum(0), old[2] + z.T @ z]
        if total:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(total), pa.int32()),
                    pa.array([v[0] for v in total.values()], pa.int64()),
                    pa.array([[*v[1], *v[2].ravel()] for v in total.values()], pa.list_(pa.float64())),
                ],
                names=["label", "n", "sums"],
            )

    out: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for r in rows.select("label", "text").mapInArrow(run, "label int, n long, sums array<double>").collect():
        s = np.array(r["sums"])
        n, first, second = out.get(r["label"], (0, np.zeros(d), np.zeros((d, d))))
        out[r["label"]] = (n + r["n"], first + s[:d], second + s[d:].reshape(d, d))
    return out


class QuadraticDiscriminant:
    """Gaussian classes with shrunk covariances; keeps each class's mean, Cholesky factor and log determinant.

    A class covariance is ``(1 - pool - ridge) * own + pool * pooled + ridge * mean variance * identity``.
    """

    def __init__(self, moments: dict[int, tuple[int, np.ndarray, np.ndarray]], pool: float, ridge: float):
        n = sum(m[0] for m in moments.values())
        means = {c: m[1] / m[0] for c, m in moments.items()}
        own = {c: m[2] / m[0] - np.outer(means[c], means[c]) for c, m in moments.items()}
        pooled = sum(moments[c][0] / n * own[c] for c in own)
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
        self.scale = scale
        self.parts = {}
        for c in own:
            a, b = own[c] / np.outer(scale, scale), pooled / np.outer(scale, scale)
            shrunk = (1 - pool - ridge) * a + pool * b + ridge * np.eye(len(scale))
            factor = np.linalg.cholesky(shrunk + 1e-9 * np.eye(len(scale)))
            self.parts[c] = (means[c] / scale, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), math.log(moments[c][0] / n))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, priors included, by Mahalanobis distances."""
        z, log = x / self.scale, {}
        for c, (mean, inverse, logdet, prior) in self.parts.items():
            log[c] = prior - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) - 0.5 * logdet
        return log[1] - log[0]


def scored_rows(rows: DataFrame, model: QuadraticDiscriminant, slope: float, shift: float, *carry: str) -> DataFrame:
    """``carry`` and ``score``: the log-density difference (compressed by a signed root) through a logistic curve."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([document_statistics(t) for t in texts_of(b)]).reshape(-1, len(STATISTICS))
            score = 1 / (1 + np.exp(-np.clip(slope * squeeze(model.difference(x)) + shift, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(score, pa.float64())], names=[*carry, "score"])

    return rows.select(*text_and(carry)).mapInArrow(run, schema_of(rows, list(carry), "score double"))


def squeeze(d: np.ndarray) -> np.ndarray:
    """Signed square root: log-density differences have long tails."""
    return np.sign(d) * np.sqrt(np.abs(d))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a one-input logistic regression, by Newton steps with a small ridge."""
    w = np.array([1.0, 0.0])
    a = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    held_out_mod: int = 4,
    held_out: int = 2,
    max_training_rows: int = 20_000,
    threshold: float = 0.7,
    pool: float = 0.1,
    ridge: float = 0.02,
    with_document: bool = False,
) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= ``threshold``) for every row of ``docs`` (doc_id, text).

    ``with_document`` adds the struct ``document`` of all columns of ``docs``.

    Learns from labelled rows whose fold is not ``held_out``, at most ``max_training_rows`` of them (a hash sample). Three
    quarters give the class moments; a quarter gives the two numbers of the logistic curve. Null texts count as empty.
    Repeated rows get a score each. Without labelled rows of both classes nothing speaks against a document, and every score is 1.
    """
    carry = ["doc_id", "held_out"] + ["document"] * with_document
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[whole_row(docs)] * with_document)
    kept = rows.withColumn("held_out", fold(held_out_mod) == held_out)
    sample, path = stored(labelled_sample(rows, labels, "quality", fold(held_out_mod) != held_out, max_training_rows), "quality-sample")
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4))
    moments = class_moments(sample.where(part != 0))
    if set(moments) == {0, 1} and min(m[0] for m in moments.values()) > 1:
        model = QuadraticDiscriminant(moments, pool, ridge)
        raw = scored_rows(sample.where(part == 0), model, 1.0, 0.0, "label").toPandas()  # a quarter of max_training_rows at most
        if raw["label"].nunique() == 2:
            p = raw["score"].clip(1e-12, 1 - 1e-12).to_numpy()
            slope, shift = fit_logistic(np.log(p / (1 - p)), raw["label"].to_numpy(dtype=float))
        else:
            slope, shift = 1.0, 0.0
        out = scored_rows(kept, model, slope, shift, *carry)
    else:
        out = kept.select(*carry, F.lit(1.0).alias("score"))
    drop_stored(docs.sparkSession, path)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
