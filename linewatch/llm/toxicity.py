"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a text are densities of a lexicon learned from the labelled rows (whole words and word beginnings), second-person
words and their nearness to lexicon words, capitals, punctuation, and obfuscated spellings.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewatch.llm.common import drop_stored, fold, labelled_sample, schema_of, slices, stored, task_partitions, text_and, texts_of, whole_row

#: Second-person words (fixed values: pronouns and possessives of four languages).
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur"
    " tu te toi ton ta tes vous votre vos"
    " du dich dir dein deine deiner deinen ihr euch euer eure"
    " tú ti usted ustedes vosotros vuestro vuestra tuyo tuya".split()
)
#: Characters written in place of letters (fixed values).
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
#: A word counts by itself and by its beginnings of these lengths.
STEMS = (3, 4, 5, 6, 7)
NEAR_WORDS = 6
STRONG = 4.5
FEATURES = (
    "log_words", "lexicon_rate", "lexicon_count", "lexicon_kinds", "weight_sum", "weight_mean", "weight_top", "strong_rate", "strong_count",
    "obfuscated_rate", "obfuscated_count", "second_person_rate", "near_rate", "near_count", "capital_rate", "shouted_rate",
    "punctuation_rate", "exclamation_rate", "digit_rate", "stretched_rate",
)


class Weights(dict):
    """Word -> the largest log odds of the word and its beginnings in the lexicon (0: none), found once a word."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) > 100_000:
            self.clear()
        found = self.lexicon.get
        self[word] = w = max(found(word, 0.0), *(found(f"{word[:n]}*", 0.0) for n in STEMS if len(word) > n), 0.0)
        return w


def text_features(text: str | None, weights: Weights) -> list[float]:
    """The numbers of ``FEATURES`` for one whole text; all zero for a null or empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    low = text.lower()
    found = re.findall(r"[^\W\d_]+", low)
    n, chars = max(1, len(found)), len(text)
    weight = [weights[w] for w in found]
    hits = [i for i, w in enumerate(weight) if w]
    masked = 0
    for w in low.split():
        plain = w.strip(".,;:!?\"'()[]|*")
        if plain.isalpha() or not any(map(str.isalpha, plain)):
            continue
        spelled = re.sub(r"[\W\d_]", "", plain.translate(LOOKALIKES))
        masked += weights[spelled] > 0 and not any(weights[x] for x in re.findall(r"[^\W\d_]+", plain))
    spots = {j for i in hits for j in range(i - NEAR_WORDS, i + NEAR_WORDS + 1)}
    second = [i for i, w in enumerate(found) if w in SECOND_PERSON]
    near = sum(i in spots for i in second)
    shouted = sum(len(w) > 2 for w in re.findall(r"\b[A-Z]+\b", text))
    strong = sum(w > STRONG for w in weight)
    return [
        math.log1p(len(found)), 100 * len(hits) / n, float(len(hits)), float(len({found[i] for i in hits})), sum(weight), 100 * sum(weight) / n,
        max(weight, default=0.0), 100 * strong / n, float(strong), 100 * masked / n, float(masked), 100 * len(second) / n, 100 * near / n,
        float(near), 100 * sum(map(str.isupper, text)) / chars, 100 * shouted / n, 100 * len(re.findall(r"[^\w\s]", text)) / chars,
        100 * text.count("!") / chars, 100 * len(re.findall(r"\d", text)) / chars, 100 * len(re.findall(r"(\w)\1\1", low)) / n,
    ]


def with_features(docs: DataFrame, lexicon: dict[str, float], *carry: str) -> DataFrame:
    """The columns ``carry`` and ``features`` (array of doubles) for each row's ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(lexicon)
        for b in slices(batches):
            rows = [text_features(t, weights) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in carry), pa.array(rows, pa.list_(pa.float64()))], names=[*carry, "features"]
            )

    return docs.select(*text_and(carry)).mapInArrow(run, schema_of(docs, list(carry), "features array<double>"))


#: Parts of the sample; part 0 calibrates, the others grow the trees.
PARTS = 4


def learn_lexicons(sample: DataFrame, least_share: float, least_odds: float) -> dict[int | None, dict[str, float]]:
    """Lexicons of the whole sample (None) and of the sample without each part (``part`` of the rows), from one pass.

    A lexicon holds words, and word beginnings (written with a star), far more frequent in documents of label 1, with their
    log odds. A term stays if a share ``least_share`` of the toxic documents has it, and its odds are ``least_odds``. As a
    document has a limited number of different words, the share bounds how many terms can stay (words a document / least_share).
    Without documents of both labels a lexicon is empty.
    """
    rows = {(r["part"], r["label"]): r["count"] for r in sample.groupBy("part", "label").count().collect()}
    words = F.array_distinct(F.expr(r"regexp_extract_all(lower(text), '(\\p{L}+)', 1)"))

    def begun(n: int) -> Column:
        # lambdas of one argument: a second one, with a default too, would be the word's place in the array
        return F.transform(F.filter("words", lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    stems = [begun(n) for n in STEMS]
    sums = [F.sum(F.when((F.col("part") == p) & (F.col("label") == v), 1).otherwise(0)).alias(f"n{p}_{v}") for p in range(PARTS) for v in (0, 1)]
    counts = (
        sample.select("part", "label", words.alias("words"))
        .select("part", "label", F.explode(F.array_distinct(F.concat("words", *stems))).alias("term"))
        .groupBy("term")
        .agg(*sums)
    )

    def without(left: int | None) -> tuple[Column, Column] | None:
        """The test and the odds of a term in the sample without a part."""
        kept = [p for p in range(PARTS) if p != left]
        n1, n0 = (sum(rows.get((p, v), 0) for p in kept) for v in (1, 0))
        if not n1 or not n0:
            return None
        k1, k0 = (reduce(lambda a, b: a + b, [F.col(f"n{p}_{v}") for p in kept]) for v in (1, 0))
        odds = (k1 / n1) / ((k0 + 1) / n0)
        return (k1 >= max(3, math.ceil(least_share * n1))) & (odds >= least_odds), odds

    wanted = {left: got for left in (None, *range(PARTS)) if (got := without(left)) is not None}
    lexicons: dict[int | None, dict[str, float]] = {left: {} for left in (None, *range(PARTS))}
    if wanted:
        names = {left: f"odds{'' if left is None else left}" for left in wanted}
        chosen = counts.select("term", *[F.when(test, odds).alias(names[left]) for left, (test, odds) in wanted.items()])
        for r in chosen.where(F.coalesce(*names.values()).isNotNull()).collect():
            for left, name in names.items():
                if r[name] is not None:
                    lexicons[left][r["term"]] = math.log(r[name])
    return lexicons


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    held_out_mod: int = 5,
    held_out: int = 0,
    max_training_rows: int = 20_000,
    trees: int = 20,
    depth: int = 3,
    least_share: float = 0.004,
    least_odds: float = 10.0,
    with_document: bool = False,
) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for every row of ``docs`` (doc_id, text).

    ``with_document`` adds the struct ``document`` of all columns of ``docs``.

    Learns from labelled rows whose fold is not ``held_out``, at most ``max_training_rows`` of them (a hash sample). Three
    quarters of the sample grow the trees and a quarter calibrates their margin; each quarter's features come from words that
    the other quarters chose, and those of the scored rows from the whole sample's words. Null and empty texts are scored from
    all-zero features. Repeated rows get a score each. Without labelled rows of both classes every score is 0.
    """
    carry = ["doc_id", "held_out"] + ["document"] * with_document
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[whole_row(docs)] * with_document)
    kept = rows.withColumn("held_out", fold(held_out_mod) == held_out)
    sample, path = stored(labelled_sample(rows, labels, "toxic", fold(held_out_mod) != held_out, max_training_rows), "toxicity-sample")
    sample = sample.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(PARTS)).cast("int"))
    lexicons = learn_lexicons(sample, least_share, least_odds)
    # A row that trees or calibration learn from is seen as a new one would be: its own part chose none of its words.
    others = [with_features(sample.where(F.col("part") == p), lexicons[p], "label", "part") for p in range(PARTS)]
    seen, feats_path = stored(reduce(DataFrame.unionByName, others).repartition(task_partitions(docs.sparkSession)), "toxicity-fit")
    seen = seen.select(F.col("label").cast("double").alias("label"), "part", array_to_vector("features").alias("features"))
    fit, check = seen.where("part != 0"), seen.where("part = 0")
    classes = [{r["label"] for r in x.select("label").distinct().collect()} for x in (fit, check)]
    scored = with_features(kept, lexicons[None], *carry).select(*carry, array_to_vector("features").alias("features"))
    if classes == [{0.0, 1.0}] * 2:
        boosted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, maxBins=32, seed=7).setRawPredictionCol("raw").fit(fit)
        margin = vector_to_array("raw")[1].alias("margin")
        calibrated = IsotonicRegression(featuresCol="margin", predictionCol="level").fit(boosted.transform(check).select("label", margin))
        scored = calibrated.transform(boosted.transform(scored).select(*carry, margin))
        # the step function is flat; a little of the margin keeps the order within a step
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.999 * F.col("level") + 0.001 / (1 + F.exp(-2 * F.col("margin")))))
    else:
        score = F.lit(0.0)
    drop_stored(docs.sparkSession, path)
    drop_stored(docs.sparkSession, feats_path)
    return scored.select(*carry, score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
