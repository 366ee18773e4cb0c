"""Repair of conversation structure at least cost, the least audit text among the cheapest.

A repaired conversation's roles are: nothing, or perhaps system and then user, assistant, user, assistant, ... That is a small
automaton; keeping, changing, deleting and inserting rows are arcs over (row, state), and each arc has a cost and a letter.

* Rows are sorted over the cluster by (conversation, turn) and cut into chunks of consecutive rows, so one very long
  conversation lies in many tasks. A chunk's cheapest costs between any two states are a 4 x 4 matrix.
* From the last chunk of a conversation to the first, the matrices give the cost to the end for every state after each chunk.
* Within a chunk, the optimal arcs follow from the cost to the end. Their nodes are ranked by the least audit of length 1, 2,
  4, ... (pairs of ranks: a node's and that of the node that its pointer of this length leads to), pointers are doubled, and
  where several pointers spell the same letters, the rank of what follows selects. Read through the doubled pointers, the
  least path gives the audit and the state after the chunk, for every state before it.
* One sorted pass per conversation strings the chunks' audits together and feeds the repaired rows to the digest piece by
  piece; it holds one chunk of text at a time. That pass is by contract sequential: the audit is one value, and so is a digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewatch.llm.common import drop_stored, join_counted, stored

# States: nothing kept yet, after system, after user, after assistant; it may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a row that is inserted or whose role is changed, by the state before it.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: The state after a kept row, by role class (s, u, a, other) and the state before it; -1: it can't be kept there.
KEPT = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1, -1, -1, -1]])
#: Cost to the end of a conversation after its last row: insertions that complete it.
END = np.array([0, 10, 5, 0])
FAR = 1 << 50
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4  # in the order of their letters
LETTERS = np.frombuffer(b".DIKR", np.uint8)
COST = {"keep": 0, "rerole": 1, "delete": 2, "insert": 5, "truncated": 5}
FINE, TRUNCATED, DELETED = range(3)  # what a row's fault means for its edits
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
_LEGAL = {(0, 1), (1, 2), (2, 1)}  # neighbours su, ua, au by role class


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of ``rows`` (conv_id, turn, role, text) after damage by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats the row, 4 sets its role to user. A null conv_id
    or turn is one space in the hashed text and stays null; a null role or text becomes one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    kept = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", kind.alias("kind")).where("kind <> 0")
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return kept.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(space("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` with the code of a row (role class, and whether it is blank or truncated) and a digest of role and text."""
    first = F.substring("role", 1, 1)
    role = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    truncated = F.col("text").rlike(r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z")
    fault = F.when(blank, DELETED).when(truncated, TRUNCATED).otherwise(FINE)
    same = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return rows.select("conv_id", "turn", "role", "text", (role + 4 * fault).cast("int").alias("code"), F.when(~blank, same).alias("same"))


def in_chunks(rows: DataFrame, chunk_rows: int, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Chunks of at most ``chunk_rows`` consecutive rows (and about ``chunk_bytes`` of text) of one conversation, in order.

    Rows are ordered by turn (null first), then role and text. They are dealt by ranges of that order, so that a conversation
    of any length is spread. One row per chunk: conv_id, chunk (rising), codes, digests, roles, texts, and of its turns the
    least, the largest and the number of different ones.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        names = ["conv_id", "chunk", "codes", "same", "roles", "texts", "low", "high", "turns"]
        held: list[tuple] = []
        size, now = 0, None

        def close() -> pa.RecordBatch:
            nonlocal held, size, number
            turns = [r[0] for r in held if r[0] is not None]
            columns = [bytes(r[3] for r in held), [r[4] for r in held], [r[1] for r in held], [r[2] for r in held]]
            types = [pa.binary(), pa.list_(pa.binary()), pa.list_(pa.string()), pa.list_(pa.string())]
            ends = [min(turns, default=None), max(turns, default=None), len({*turns})]
            arrays = [pa.array([x], t) for x, t in zip([now, number, *columns, *ends], [pa.int64(), pa.int64(), *types, *[pa.int64()] * 3])]
            held, size, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays(arrays, names=names)

        waiting: list[pa.RecordBatch] = []
        for b in batches:
            for conv, *row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "code", "same"))):
                if held and (conv != now or len(held) >= chunk_rows or size >= chunk_bytes):
                    waiting.append(close())
                    if len(waiting) >= 500:
                        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                        waiting = []
                now = conv
                held.append(row)
                size += len(row[2])
        if held:
            waiting.append(close())
        if waiting:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

    short = F.when(F.length("role") <= 40, F.left("text", F.lit(40)))
    dealt = rows.repartitionByRange("conv_id", "turn", F.left("role", F.lit(40)), short).sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(
        cut, "conv_id long, chunk long, codes binary, same array<binary>, roles array<string>, texts array<string>, low long, high long, turns long"
    )


def repeats(chunks: DataFrame) -> DataFrame:
    """(chunk, again): the places in each chunk whose role and text stand earlier in the conversation."""
    places = chunks.select("conv_id", "chunk", F.posexplode("same").alias("pos", "same")).where("same IS NOT NULL")
    firsts = places.groupBy("conv_id", "same").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("chunk", "pos")).alias("first")).where("n > 1")
    # a null conversation is one like the others, so the keys of the join hold no null
    key = [F.coalesce("conv_id", F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("unnamed"), "same"]
    found = join_counted(places.select(*key, "chunk", "pos"), firsts.select(*key, "n", "first"), ["conv", "unnamed", "same"], F.col("chunk"))
    return found.where((F.col("chunk") != F.col("first.chunk")) | (F.col("pos") != F.col("first.pos"))).groupBy("chunk").agg(F.collect_list("pos").alias("again"))


def backward(codes: list[np.ndarray], ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Cheapest costs of many chunks at once, from the last row to the first.

    ``ends`` (chunks, 4, k) holds k vectors of costs after each chunk by state. Returns per number of rows from the end the
    costs (active chunks, 4, k), longest chunks first, and the order of the chunks.
    """
    lengths = np.array([len(c) for c in codes])
    order = np.argsort(-lengths, kind="stable")
    levels = [ends[order]]
    active = len(order)
    for back in range(1, (lengths.max() if len(codes) else 0) + 1):
        while active and lengths[order[active - 1]] < back:
            active -= 1
        code = np.array([codes[k][-back] for k in order[:active]])
        after = levels[-1][:active]
        at = np.arange(active)
        role, fault = code & 3, code >> 2
        own = np.where(fault == TRUNCATED, COST["truncated"], 0)[:, None]
        best = after + COST["delete"]
        for state in range(4):
            reroled = after[:, NEXT[state]] + COST["rerole"] + own
            to = KEPT[role, state]
            kept = np.where((to >= 0)[:, None], after[at, to] + COST["keep"] + own, FAR)
            edited = np.where((fault == DELETED)[:, None], FAR, np.minimum(reroled, kept))
            best[:, state] = np.minimum(best[:, state], edited)
        user, assistant = best[:, USER].copy(), best[:, ASSISTANT].copy()
        best[:, USER] = np.minimum(user, assistant + COST["insert"])
        best[:, ASSISTANT] = np.minimum(assistant, user + COST["insert"])
        for state in (START, SYSTEM):
            best[:, state] = np.minimum(best[:, state], best[:, USER] + COST["insert"])
        levels.append(np.minimum(best, FAR))
    return levels, order


def matrices(codes: list[np.ndarray]) -> np.ndarray:
    """(chunks, 4, 4): the cheapest cost from a state before a chunk's first row to a state after its last; ``FAR``: none."""
    unit = np.where(np.eye(4, dtype=bool), 0, FAR)
    levels, order = backward(codes, np.broadcast_to(unit, (len(codes), 4, 4)).astype(np.int64))
    out = np.empty((len(codes), 4, 4), np.int64)
    for place, k in enumerate(order):
        out[k] = levels[len(codes[k])][place]
    return out


def optimal_arcs(codes: list[np.ndarray], ends: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (row, state) of many chunks and the arcs between them that lie on cheapest ways to the end.

    ``ends`` (chunks, 4) is the cost to the end after each chunk; ``last`` says which chunks end a conversation: there, rows
    may be inserted behind the last row too. Returns each chunk's first node (node = first + 4 * row + state), the nodes'
    costs, and source, letter and target of the arcs.
    """
    lengths = np.array([len(c) for c in codes], np.int64)
    first = np.concatenate([[0], np.cumsum(4 * (lengths + 1))])
    cost = np.empty(first[-1], np.int64)
    levels, order = backward(codes, ends[:, :, None].astype(np.int64))
    for back, level in enumerate(levels):
        chunk = order[: len(level)]
        node = first[chunk] + 4 * (lengths[chunk] - back)
        cost[node[:, None] + np.arange(4)] = level[:, :, 0]
    closing = first[:-1] // 4 + lengths  # the place after each chunk's last row
    is_closing = np.zeros(len(cost) // 4, bool)
    is_closing[closing] = True
    row_code = np.zeros(len(cost) // 4, np.int64)
    row_code[~is_closing] = np.concatenate(codes)
    open_end = np.zeros(len(cost) // 4, bool)
    open_end[closing] = ~last
    node = np.arange(len(cost))
    state, place = node % 4, node // 4
    code = row_code[place]
    role, fault = code & 3, code >> 2
    inside = ~is_closing[place]
    editable = inside & (fault != DELETED)
    own = np.where(fault == TRUNCATED, COST["truncated"], 0)
    kept = KEPT[role, state]
    base = 4 * (place + 1)
    kinds = [
        (DELETE, inside, base + state, COST["delete"] + 0 * own),
        (INSERT, ~open_end[place], 4 * place + NEXT[state], COST["insert"] + 0 * own),
        (KEEP, editable & (kept >= 0), base + kept, COST["keep"] + own),
        (REROLE, editable, base + NEXT[state], COST["rerole"] + own),
    ]
    source, letter, target = [], [], []
    for kind, allowed, to, price in kinds:
        at = np.flatnonzero(allowed & (cost < FAR))
        at = at[cost[at] == price[at] + cost[to[at]]]
        source.append(at)
        letter.append(np.full(len(at), kind))
        target.append(to[at])
    return first, cost, np.concatenate(source), np.concatenate(letter), np.concatenate(target)


def least_paths(nodes: int, source: np.ndarray, letter: np.ndarray, target: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least letter sequence from each of ``starts`` to a node without arcs, in a graph of arcs without circles.

    Returns the letters of all starts behind one another, the ends of each one's letters, and the node that each reaches.

    Round k knows every node's rank by its least sequence of up to 2^k letters, and pointers to the nodes where such
    sequences end. Of a node's pointers those whose ends rank least stay; the pair (own rank, that rank) is the rank by 2^(k+1)
    letters, and the pointers of the ends the new pointers. At last, of the pointers of each length, the one whose end ranks
    least by whole sequences is on the least path.
    """
    least = np.full(nodes, 9)
    np.minimum.at(least, source, letter)
    least[least == 9] = 0
    best = letter == least[source]
    ends = np.flatnonzero(least == 0)  # a node without arcs points to itself
    at, to = np.concatenate([source[best], ends]), np.concatenate([target[best], ends])
    order = np.lexsort((to, at))
    at, to = at[order], to[order]
    rank, steps = least.astype(np.int64), []
    while True:
        steps.append((at, to))
        begin = np.searchsorted(at, np.arange(nodes))
        follows = np.minimum.reduceat(rank[to], begin) if nodes else rank
        stays = rank[to] == follows[at]
        at, to = at[stays], to[stays]
        if np.all(least[to] == 0):
            rank = np.unique(rank * (nodes + 9) + follows, return_inverse=True)[1]
            break
        rank = np.unique(rank * (nodes + 9) + follows, return_inverse=True)[1].astype(np.int64)
        begin = np.searchsorted(at, np.arange(nodes + 1))
        width = np.diff(begin)[to]
        inner = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        both = np.unique(np.stack([np.repeat(at, width), to[np.repeat(begin[to], width) + inner]]), axis=1)
        at, to = both
    pointers, counts = [], [(least > 0).astype(np.int64)]
    for at, to in steps:
        order = np.lexsort((rank[to], at))
        pointer = to[order][np.searchsorted(at[order], np.arange(nodes))]
        pointers.append(pointer)
        counts.append(counts[-1] + counts[-1][pointer])
    length = counts[-1][starts]
    end = starts.copy()
    for k, pointer in enumerate(pointers):
        end = np.where(length >> k & 1, pointer[end], end)
    offset = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    node = np.repeat(starts, length)
    for k, pointer in enumerate(pointers):
        node = np.where(offset >> k & 1, pointer[node], node)
    return least[node], np.cumsum(length), end


STEPS = "conv_id long, chunk long, codes binary, matrix array<long>, tallies array<long>"
PATHS = "conv_id long, chunk long, costs array<long>, exits array<long>, audits array<string>, tallies array<long>"


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk: its codes with repeated rows marked, the cost matrix, and what it adds to the tallies."""
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("codes", pa.binary()), ("matrix", pa.list_(pa.int64())), ("tallies", pa.list_(pa.int64()))])
    for b in batches:
        codes, tallies = [], []
        for raw, again in zip(b.column("codes").to_pylist(), b.column("again").to_pylist()):
            code = np.frombuffer(raw, np.uint8).copy()
            role = code & 3
            blank = int(np.count_nonzero(code >> 2 == DELETED))
            if again:
                code[again] = role[again] + 4 * DELETED
            illegal = sum(pair not in _LEGAL for pair in zip(role[:-1].tolist(), role[1:].tolist()))
            tallies.append([blank, len(again or ()), int(np.count_nonzero(code >> 2 == TRUNCATED)), illegal, int(role[0]), int(role[-1])])
            codes.append(code)
        if codes:
            rows = zip(b.column("conv_id").to_pylist(), b.column("chunk").to_pylist(), map(bytes, codes), matrices(codes).reshape(-1, 16).tolist(), tallies)
            yield _batch(schema, list(rows))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For chunks in falling order: the cost to the end after each, and whether it ends its conversation."""
    now, following, vector = object(), None, END
    for b in batches:
        ends, last = [], []
        for conv, matrix in zip(b.column("conv_id").to_pylist(), b.column("matrix").to_pylist()):
            last.append(conv != now)
            vector = END if conv != now else (np.array(following).reshape(4, 4) + vector).min(axis=1)
            now, following = conv, matrix
            ends.append(vector.tolist())
        columns = [b.column(c) for c in ("conv_id", "chunk", "codes", "tallies")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(ends, pa.list_(pa.int64())), pa.array(last, pa.bool_())], names=["conv_id", "chunk", "codes", "tallies", "ends", "last"])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk and state before it: cost to the conversation's end, state after the chunk, and the chunk's part of the audit."""
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("costs", pa.list_(pa.int64())), ("exits", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("tallies", pa.list_(pa.int64()))])
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            b = whole.slice(at, 2000)
            codes = [np.frombuffer(c, np.uint8) for c in b.column("codes").to_pylist()]
            first, cost, source, letter, target = optimal_arcs(codes, np.array(b.column("ends").to_pylist()), np.array(b.column("last").to_pylist()))
            starts = (first[:-1, None] + np.arange(4)).ravel()
            letters, cuts, reached = least_paths(len(cost), source, letter, target, starts)
            text = LETTERS[letters].tobytes().decode()
            audits = [text[a:z] for a, z in zip([0, *cuts[:-1].tolist()], cuts.tolist())]
            rows = [
                (conv, chunk, cost[starts[4 * k : 4 * k + 4]].tolist(), (reached[4 * k : 4 * k + 4] % 4).tolist(), audits[4 * k : 4 * k + 4], tallies)
                for k, (conv, chunk, tallies) in enumerate(zip(*(b.column(c).to_pylist() for c in ("conv_id", "chunk", "tallies"))))
            ]
            yield _batch(schema, rows)


def edited(audit: str, state: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of the rows that stay or come in, by a chunk's part of the audit."""
    at = 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            yield letter, ROLES[state], ""
            continue
        if letter != "D":
            state = NEXT[state] if letter == "R" else KEPT["sua".index(roles[at][0]), state]
            yield letter, ROLES[state] if letter == "R" else roles[at], texts[at]
        at += 1


class _Conversation:
    """What the chunks of one conversation add up to, in order."""

    def __init__(self, conv: int | None):
        self.conv, self.state, self.cost = conv, START, None
        self.tallies, self.before, self.audit = [0, 0, 0, 0], None, []
        self.low = self.high = None
        self.turns, self.position, self.digest = 0, 0, hashlib.sha256()

    def add(self, path: dict, part: dict) -> Iterator[tuple]:
        """Takes a chunk in; yields its repaired rows (conv_id, position, edit, role, text)."""
        *counts, first, final = path["tallies"]
        self.tallies = [a + b for a, b in zip(self.tallies, counts)]
        self.tallies[3] += self.before is not None and (self.before, first) not in _LEGAL
        self.before = final
        if self.cost is None:
            self.cost = path["costs"][START]
        if part["low"] is not None:
            self.turns += part["turns"] - (part["low"] == self.high)
            self.low, self.high = part["low"] if self.low is None else self.low, part["high"]
        audit = path["audits"][self.state]
        self.audit.append(audit)
        for letter, role, text in edited(audit, self.state, part["roles"], part["texts"]):
            self.digest.update((b"\n" if self.position else b"") + f"{role}:{text}".encode())
            yield self.conv, self.position, letter, role, text
            self.position += 1
        self.state = path["exits"][self.state]

    def result(self) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        return (self.conv, gaps, *self.tallies, self.cost or 0, "".join(self.audit), self.digest.hexdigest())


RESULT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
ROWS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _strung(as_rows: bool):
    """Strings chunks together: batches sorted by conversation and chunk, of a chunk the path before the rows."""
    schema = ROWS if as_rows else RESULT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, path = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                for r in whole.slice(at, 500).to_pylist():
                    if now is None or r["conv_id"] != now.conv:
                        if now is not None and not as_rows:
                            out.append(now.result())
                        now = _Conversation(r["conv_id"])
                    if r["audits"] is not None:
                        path = r
                    elif r["roles"] is not None:
                        rows = now.add(path, r)
                        if as_rows:
                            out.extend(rows)
                        else:
                            for _ in rows:
                                pass
                    if len(out) >= 2000:
                        yield _batch(schema, out)
                        out = []
        if now is not None and not as_rows:
            out.append(now.result())
        if out:
            yield _batch(schema, out)

    return run


def _repaired(rows: DataFrame, ids: DataFrame, chunk_rows: int, as_rows: bool, kinds: str) -> DataFrame:
    spark = rows.sparkSession
    chunks, _ = stored(in_chunks(marked(rows), chunk_rows), "repair-chunks")
    again, again_path = stored(repeats(chunks), "repair-again")
    steps, steps_path = stored(chunks.select("conv_id", "chunk", "codes").join(again, "chunk", "left").mapInArrow(_steps, STEPS), "repair-steps")
    drop_stored(spark, again_path)
    falling = steps.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("chunk"))
    ends = falling.mapInArrow(_ends, "conv_id long, chunk long, codes binary, tallies array<long>, ends array<long>, last boolean")
    # A long conversation's chunks are dealt again. A code is one byte and costs much work: not to be gathered by bytes.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths, _ = stored(ends.repartition(tasks, "chunk").mapInArrow(_paths, PATHS), "repair-paths")
    drop_stored(spark, steps_path)
    parts = chunks.select("conv_id", "chunk", F.lit(1).alias("kind"), "roles", "texts", "low", "high", "turns")
    known = paths.withColumn("kind", F.lit(0))
    named = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select("conv_id", F.lit(-1).cast("long").alias("chunk"), F.lit(0).alias("kind"))
    both = named.unionByName(known, allowMissingColumns=True).unionByName(parts, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "kind").mapInArrow(_strung(as_rows), kinds)


def repaired_rows(conversations: DataFrame, chunk_rows: int = 2048) -> DataFrame:
    """The rows of every repaired conversation: conv_id, position (from 0), edit (K, R or I), role, text.

    Rows of a conversation are taken by turn (null first), then role and text. A null role or text counts as one space. Blank
    and repeated rows are deleted (2 each), others kept (0), given the other role (1) or deleted, and empty rows inserted (5),
    a truncated row that stays costs 5, so that the roles are none, or perhaps system and then user and assistant in turns, at
    least cost; of the cheapest ways the one whose letters D, I, K, R come first. Rows without conv_id are one conversation.
    Other columns are not read. An empty table gives no rows.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    return _repaired(rows, rows, chunk_rows, True, "conv_id long, position long, edit string, role string, text string")


def repair_digests(conversations: DataFrame, ids: DataFrame | None = None, chunk_rows: int = 2048) -> DataFrame:
    """Per conversation: faults, cost and audit of the repair (see ``repaired_rows``), and the SHA-256 of the repaired rows.

    Columns: conv_id, gaps (turns missing between the least and the largest), blank, duplicate, truncated (each row's first
    fault), illegal (neighbours whose roles don't follow each other), cost, audit (letters of all edits in order) and
    repaired_sha256 (rows as ``role:text``, joined by newlines). A conv_id of ``ids`` without rows has zeros and an empty audit.
    """
    kinds = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    return _repaired(rows, rows if ids is None else ids, chunk_rows, False, kinds)
