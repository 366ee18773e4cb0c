"""I-Match fingerprints: sorted distinct terms of a chosen inverse-document-frequency band, hashed over random lexicon subsets.

Only DataFrame functions are used. A term is a lower-cased run of characters without white space, held as its 64-bit hash.
The first component is the hash of all terms of the band, so a text with any term differs from an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewatch.llm.common import drop_stored, stored

#: A subset keeps about one lexicon term in so many; texts of all lengths find subsets with a few of their terms. Besides, one
#: subset keeps them all.
RATES = (4, 8, 16, 32, 64, 128, 256)
SUBSETS_PER_RATE = 8


def term_hashes(text: Column) -> Column:
    """The 64-bit hashes of the distinct terms of a text; empty for an empty text."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != ""), lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame, low: float, high: float) -> list[int]:
    """The terms that at least a share ``low`` and at most a share ``high`` of all documents have.

    Bound: the shares of all terms add up to the mean number of distinct terms of a document, so at most that number / ``low``
    terms can be in the band, whatever the number of documents.
    """
    n = docs.count()
    counts = docs.select(F.explode(term_hashes(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return [r["term"] for r in counts.where((F.col("df") >= low * n) & (F.col("df") <= high * n)).select("term").collect()]


def _band(kept: list[int]) -> str:
    """SQL over a column ``terms``: its sorted part inside the lexicon, or all of it where that part is empty."""
    if not kept:
        return "array_sort(terms)"
    inside = f"filter(terms, x -> x IN ({', '.join(f'{t}L' if t > -(1 << 63) else 'bigint(-9223372036854775808)' for t in sorted(kept))}))"
    return f"array_sort(transform(array({inside}), b -> if(size(b) > 0, b, terms))[0])"


def _subsets(column: str) -> str:
    """SQL: the array of subset hashes of the sorted term hashes in ``column``; the whole band's first, in 64 bits, the others in 32."""
    out = [f"if(size({column}) = 0, 0L, coalesce(nullif(xxhash64({column}), 0L), 1L))"]
    for rate in RATES:
        bits = rate.bit_length() - 1
        for i in range(SUBSETS_PER_RATE):
            kept = f"filter({column}, x -> (shiftright(x, {(7 * i + 3 * bits) % (63 - bits)}) & {rate - 1}) = {(5 * i + bits) % rate})"
            out.append(f"transform(array({kept}), s -> if(size(s) = 0, 0, coalesce(nullif(xxhash64(s) & 4294967295, 0), 1)))[0]")
    return f"array({', '.join(out)})"


def with_components(rows: DataFrame, text: Column, name: str, kept: list[int]) -> DataFrame:
    """``rows`` and the array ``name``: one hash per lexicon subset over the terms of ``text`` that it keeps, 0 for none."""
    band = rows.withColumn("terms", term_hashes(text)).withColumn("terms", F.expr(_band(kept)))
    return band.withColumn(name, F.expr(_subsets("terms"))).drop("terms")


def written(parts: str) -> Column:
    """A fingerprint's text: 16 hex digits of the whole band, then eight per subset."""
    digits = F.transform(F.col(parts), lambda x, i: F.lower(F.lpad(F.hex(x), F.when(i == 0, 16).otherwise(8), F.lit("0"))))
    return F.concat_ws("-", digits)


def likeness(a: str, b: str) -> Column:
    """The share of equal subset hashes among the subsets that either text has terms in; 1 for two texts without terms."""
    pairs = F.zip_with(F.col(a), F.col(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    used = F.filter(pairs, lambda p: (p["x"] != 0) | (p["y"] != 0))
    equal = F.filter(pairs, lambda p: (p["x"] == p["y"]) & (p["x"] != 0))
    return F.when(F.size(used) == 0, F.lit(1.0)).otherwise(F.size(equal) / F.size(used)).cast("double")


def fingerprint(docs: DataFrame, low: float = 0.005, high: float = 0.05) -> DataFrame:
    """All columns of ``docs`` (it has ``text``) and ``fingerprint``. Null and empty texts share the fingerprint of no terms.

    Equal texts have equal fingerprints, and so have texts with the same terms of the band.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = lexicon(docs.select(text.alias("text")), low, high)
    return with_components(docs, text, "fingerprint_parts", kept).withColumn("fingerprint", written("fingerprint_parts")).drop("fingerprint_parts")


#: What names a text in all steps: its doc_id (and whether that is null) and a 128-bit hash.
_NAME = ["unnamed", "id", "h1", "h2"]


def _named(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select(
        F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("h1"),
        F.xxhash64(F.lit(1), F.col("text")).alias("h2"), "text",
    )


def _successors(rows: DataFrame) -> tuple[DataFrame, str]:
    """A stored table: the name of every different row, ``half`` of its length, and ``next``, the name of the row after it.

    The names are sorted over the cluster, without their texts. Within a part of the sort the next row follows; after the last
    row of a part comes the first one of the next part, and after the last row of all the first one.
    """
    order = [F.desc("unnamed"), "id", "begin", "h1", "h2"]
    names = rows.groupBy(*_NAME, F.left("text", F.lit(32)).alias("begin")).agg(F.max(F.floor(F.length("text") / 2)).cast("int").alias("half"))
    dealt = names.repartitionByRange(*order).sortWithinPartitions(*order)
    placed, path = stored(dealt.withColumns({"block": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "fingerprint-order")
    name = F.struct(*_NAME)
    inside = F.lead(name).over(Window.partitionBy("block").orderBy("place"))
    firsts = placed.groupBy("block").agg(F.min_by(name, "place").alias("first"))  # one row per part of the sort
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("block", F.coalesce(F.lead("first").over(Window.orderBy("block")), F.first("first").over(every)).alias("after"))
    linked = placed.withColumn("inside", inside).join(F.broadcast(after), "block").select(*_NAME, "half", F.coalesce("inside", "after").alias("next"))
    out = stored(linked, "fingerprint-next")
    drop_stored(rows.sparkSession, path)
    return out


def edited_fingerprints(docs: DataFrame, low: float = 0.005, high: float = 0.05) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    The edited text of a row has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    row's text. Rows are ordered by doc_id (null first); rows of one doc_id by the first 32 characters of their text, then by
    its hash, so that equal rows stand together; the first follows the last. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. A null text is empty.

    The order is found on names (doc_id and hash) alone. A row's text goes once to its name, where equal rows are
    one with their number, and from there its beginning, as long as needed, to the row before it.
    """
    rows = _named(docs)
    kept = lexicon(rows.select("text"), low, high)
    following, _ = _successors(rows)
    parts = with_components(rows, F.col("text"), "parts", kept)
    # both uses read all columns, so that they share one exchange of the texts
    texts = parts.groupBy(*_NAME).agg(F.first("text").alias("text"), F.first("parts").alias("parts"), F.count(F.lit(1)).alias("copies")).where("copies > 0")
    to = following.select(*[F.col(f"next.{c}").alias(c) for c in _NAME], F.struct(*_NAME).alias("to"), "half")
    heads = texts.join(to, _NAME).select("to.*", F.struct(F.substring(F.col("text"), F.lit(1), F.col("half")).alias("head"), F.col("parts").alias("next_parts"), F.lit(1).cast("long").alias("times")).alias("one"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    own = F.struct(F.substring(F.col("text"), F.lit(1), half).alias("head"), F.col("parts").alias("next_parts"), (F.col("copies") - 1).alias("times"))
    # of equal rows, the last is followed by another row and the others by their like
    paired = texts.join(heads, _NAME).select(
        F.when(~F.col("unnamed"), F.col("id")).alias("doc_id"), n.cast("long").alias("n_chars"), "text", "parts", half.alias("half"), F.explode(F.array("one", own)).alias("next")
    ).where("next.times > 0")
    edited = paired.select(
        "doc_id", "n_chars", "parts", F.col("next.next_parts").alias("next_parts"), F.col("next.times").alias("times"),
        F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - F.col("half")), F.col("next.head")).alias("edited"),
    )
    results = with_components(edited, F.col("edited"), "edited_parts", kept).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written("parts").alias("fingerprint"),
        written("edited_parts").alias("edited_fingerprint"),
        likeness("parts", "edited_parts").alias("near_edited"),
        likeness("parts", "next_parts").alias("near_next"),
        "times",
    )
    return results.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times", "col")
