"""Exact duplicates by deterministic block naming; DataFrame functions only.

A text without its white space is cut into blocks of fixed size. All blocks that occur more than once are sorted, and their
places in the sort are their names, so equal blocks, and only these, have equal names. Then adjacent names are sorted in
pairs and named again, which halves a document's sequence, until one name is left of each: its identity. No hash decides
anything, so no two different texts can meet. A block or pair that occurs once needs no name: its document equals no other
and leaves the recursion.

A level shuffles the rows that are left: at the first the text itself, twice (once summed within tasks), later one pair of
numbers for every two blocks of the documents that may still have a copy. Names go back to their rows by a join whose
frequent keys are dealt over many tasks (``join_counted``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewatch.llm.common import drop_stored, join_counted, stored

SPACE = r"[\x20\x09-\x0D]+"


def without_space(text: Column) -> Column:
    """``text`` (null: empty) without its ASCII white space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, "")


def blocks_of(data: Column, size: int) -> Column:
    """Consecutive blocks of ``size`` bytes, the last one shorter; an empty value has one empty block."""
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length(data), F.lit(1)), F.lit(size))
    return F.transform(starts, lambda s: F.substring(data, s, F.lit(size)))


def sorted_names(rows: DataFrame, keys: list[str], label: str, ahead: list[Column] | None = None) -> tuple[DataFrame, str]:
    """A stored table (keys, n, name) of the key values that more than one row has, named by their places in a distributed sort.

    The order is that of ``keys``, after the short columns ``ahead`` if given: the sort's ranges are dealt by these, and Spark
    samples what it deals by on the driver, which long keys are not for. Written before it is used: a sort that ran again
    could deal its ranges, and with them the numbers, in another way.
    """
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = repeated.repartitionByRange(*(ahead or keys)).sortWithinPartitions(*(ahead or []), *keys)
    return stored(dealt.withColumn("name", F.monotonically_increasing_id()), label)


def sequences(named: DataFrame, level: int) -> tuple[DataFrame, str]:
    """A stored table (rid, names) of the documents whose parts all have names, in order; ``named`` has rid, pos, parts, name."""
    gathered = named.groupBy("rid").agg(F.first("parts").alias("parts"), F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("got"))
    return stored(gathered.where(F.size("got") == F.col("parts")).select("rid", F.col("got.name").alias("names")), f"copies-level{level}")


def identities(named: DataFrame) -> DataFrame:
    """(rid, level, identity) of every document that may have a copy, from its named blocks."""
    seqs, _ = sequences(named, 0)
    level, done = 0, []
    while True:
        done.append(seqs.where(F.size("names") == 1).select("rid", F.lit(level).alias("level"), F.element_at("names", 1).alias("identity")))
        rest = seqs.where(F.size("names") > 1)
        if rest.isEmpty():
            break
        level += 1
        pair = F.transform(
            F.sequence(F.lit(0), F.size("names") - 1, F.lit(2)),
            lambda i: F.struct(F.get("names", i).alias("a"), F.coalesce(F.get("names", i + 1), F.lit(-1)).alias("b")),
        )
        pairs = rest.select("rid", F.ceil(F.size("names") / 2).cast("int").alias("parts"), F.posexplode(pair).alias("pos", "pair")).select(
            "rid", "parts", "pos", "pair.a", "pair.b"
        )
        names, names_path = sorted_names(pairs, ["a", "b"], f"copies-names{level}")
        seqs, _ = sequences(join_counted(pairs, names, ["a", "b"], F.col("rid")), level)
        drop_stored(named.sparkSession, names_path)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_copies(docs: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """Which rows hold the same text but for ASCII white space, and which one of them stays.

    Columns: doc_id, keep_id (doc_id of the row that stays), group_size, kept, text_sha256 (of the text without white space).
    Of equal texts the row with the most code points stays, then the one with the smallest doc_id (a null one is last); of
    rows equal in both, one stays. A null text counts as empty, and empty and blank texts are equal. Every row gives a row;
    other columns are not read. An empty table gives an empty table.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    normal = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("n_chars"), without_space(F.col("text")).cast("binary").alias("normal"))
    blocks = normal.select(F.explode(blocks_of(F.col("normal"), block_bytes)).alias("block"))
    # ranges by the first bytes, and by a hash where many blocks begin alike; the order is total by the block itself
    names, names_path = sorted_names(blocks, ["block"], "copies-names0", [F.substring("block", 1, 16), F.xxhash64("block")])
    parts = F.greatest(F.ceil(F.octet_length("normal") / block_bytes), F.lit(1)).cast("int")
    rows = (
        normal.withColumns({"rid": F.monotonically_increasing_id(), "parts": parts, "text_sha256": F.sha2("normal", 256)})
        .select("rid", "doc_id", "n_chars", "parts", "text_sha256", F.posexplode(blocks_of(F.col("normal"), block_bytes)).alias("pos", "block"))
        .withColumn("text_sha256", F.when(F.col("pos") == 0, F.col("text_sha256")))
    )
    # rid is drawn once and written with all that later steps read
    named, _ = stored(join_counted(rows, names, ["block"], F.col("rid"), how="left").drop("block"), "copies-blocks")
    drop_stored(docs.sparkSession, names_path)
    found = identities(named.where("name IS NOT NULL"))
    documents = named.where("pos = 0").select("rid", "doc_id", "n_chars", "text_sha256")
    members, _ = stored(documents.join(found, "rid", "left"), "copies-members")
    # the largest is the one that stays: ~x falls as x rises, and does not overflow
    rank = F.struct("n_chars", F.col("doc_id").isNotNull().alias("has"), F.bitwise_not("doc_id").alias("id"), F.bitwise_not("rid").alias("row"))
    groups = members.where("identity IS NOT NULL").groupBy("level", "identity").agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("best"))
    joined = join_counted(members.where("identity IS NOT NULL"), groups, ["level", "identity"], F.col("rid"), table_column="n")
    shared = joined.select(
        "doc_id", F.bitwise_not("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.bitwise_not("best.row") == F.col("rid")).alias("kept"), "text_sha256"
    )
    single = members.where("identity IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return shared.unionByName(single)
