"""BPE, packing and fingerprints against the public libraries and brute force; the pipeline and the registration."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linewatch.llm.bpe import Codec, bpe_digests, decode_documents, encode_documents, read_ranks
from linewatch.llm.fingerprints import edited_fingerprints, fingerprint
from linewatch.llm.packing import Schedule, TokenizerFile, pack
from linewatch.llm.pretokens import units

RANKS, FILE = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def odd_texts(seed=1, n=3000):
    rng = random.Random(seed)
    letters = "ab  \n\t'st re1２é。!?🎉  \x1c\r<|endoftext|>"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return made + ["a" * 3000, " " * 2000, "\n" * 50 + " x", "ab" * 2000, "é" * 1500, "", " a ", "x<|endoftext|> y"]


def test_bpe_equals_the_library():
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    codec, texts = Codec(RANKS, P.PATTERN), odd_texts()
    got = codec.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode_ordinary(t) for t in texts]
    assert [codec.decode(x).decode() for x in got] == texts


def test_a_merge_of_a_lower_rank_that_comes_up_late():
    """'xab' ranks before 'ab' but needs it here: the replay falls back to merging that word by itself."""
    tokens = [bytes([i]) for i in range(256)] + [b"xa", b"xab", b"ab", b"yx", b"xabab"]
    ranks = {t: i for i, t in enumerate(tokens)}
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = Codec.__new__(Codec)
    from linewatch.llm.bpe import MergeReplay

    codec.replay = MergeReplay(ranks)
    words = ["yxab", "xab", "abab", "xabab", "yxabxab", "aab", "b", "xaab", "yyxabab"]
    got = [np.frombuffer(x, "<u4").tolist() for x in codec.replay.encode([w.encode() for w in words])]
    assert got == [library.encode_ordinary(w) for w in words]


def test_bpe_round_trip_on_documents(spark, awkward, nothing):
    rows = bpe_digests(awkward, RANKS, P.PATTERN).collect()
    texts = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in awkward.collect())
    assert Counter((r.doc_id, r.decoded_sha256) for r in rows) == texts
    back = decode_documents(encode_documents(awkward, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert Counter((r.doc_id, hashlib.sha256(r.decoded).hexdigest()) for r in back) == texts
    assert bpe_digests(nothing, RANKS, P.PATTERN).count() == 0


def test_units_give_the_text_back():
    for t in odd_texts(2, 500):
        first, rest = units(t)
        assert first + "".join(" " + x for x in rest) == t


def test_tokenizer_file_equals_the_library():
    library, texts = Tokenizer.from_file(FILE), odd_texts(3)
    got = TokenizerFile(FILE, P.PATTERN).encode(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def check_pieces(rows, ids, window=1024):
    """Every id in one piece, sequences gapless, and only full windows or powers of two."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert sum(r.length for r in rows) == sum(len(x) for _, x in ids)
    for doc, want in ids:
        mine = sorted((r.start, r.length, r.ids_crc32) for r in pieces[doc, len(want)])
        mine = sorted(set(mine))  # repeated rows have equal ids but may be cut apart elsewhere
        for s, n, crc in mine:
            assert zlib.crc32(np.array(want[s : s + n], "<u4").tobytes()) == crc
    for i, parts in sequences.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))
    return sequences


def test_packing_keeps_every_token_and_the_mixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(7, "doc_id")
    library = Tokenizer.from_file(FILE)
    ids = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in docs.collect()]
    rows = pack(docs, FILE, P.PATTERN).collect()
    assert [len({s for s, _, _ in [(r.start, r.length, 0) for r in rows if r.doc_id == d]}) > 0 for d, _ in ids]
    sequences = check_pieces(rows, ids)
    total = Counter()
    for r in rows:
        total[r.source] += r.length
    full, used = [s for s, p in sorted(sequences.items()) if sum(r.length for r in p) == 1024], Counter()
    whole = sum(n // 128 * 128 for n in total.values())
    for k, s in enumerate(full, 1):
        for r in sequences[s]:
            used[r.source] += r.length
        if k * 1024 < whole - 1024:  # the remainders of the queues follow after all whole turns
            assert all(abs(used[x] - k * 1024 * (n // 128 * 128) / whole) <= 2 * 128 for x, n in total.items())


def test_packing_to_a_target_mixture(spark):
    docs = spark.createDataFrame([(i, "word " * 300, "big" if i % 5 else "small") for i in range(50)], "doc_id long, text string, source string")
    rows = pack(docs, FILE, P.PATTERN, mixture={"big": 1, "small": 1}).collect()
    first = Counter()
    for r in rows:
        if r.sequence_id < 4:
            first[r.source] += r.length
    assert abs(first["big"] - first["small"]) <= 256


def test_packing_handles_awkward_rows(spark, awkward, nothing):
    library = Tokenizer.from_file(FILE)
    ids = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in awkward.collect()]
    check_pieces(pack(awkward, FILE, P.PATTERN).collect(), ids)
    assert pack(nothing, FILE, P.PATTERN).count() == 0


def test_turns_are_a_permutation_beyond_64_bits():
    lengths = {"a": 1000, "b": 256, "c": 37, "d": 4096}
    for scale in (1, 1 << 70):
        s = Schedule(lengths, {k: (n // 16) * scale for k, n in lengths.items()}, 16, 64)
        places = np.concatenate([s.turn_place(i, np.arange(t)) for i, t in enumerate(s.turns)])
        assert sorted(places.tolist()) == list(range(sum(s.turns)))
    with pytest.raises(ValueError):
        Schedule(lengths, lengths, 10, 64)


def test_merges_out_of_order_are_refused(tmp_path):
    import json

    spec = json.load(open(FILE, encoding="utf-8"))
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    (tmp_path / "odd.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="order of its merges"):
        TokenizerFile(str(tmp_path / "odd.json"), P.PATTERN)


def test_too_many_sources_are_named(spark, monkeypatch):
    from linewatch.llm import packing

    monkeypatch.setattr(packing, "MOST_SOURCES", 3)
    docs = spark.createDataFrame([(i, "a b", f"s{i}") for i in range(5)], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="more than 3 sources"):
        pack(docs, FILE, P.PATTERN)
    assert pack(docs.where("doc_id < 3"), FILE, P.PATTERN).select("doc_id").distinct().count() == 3


def edited(texts):
    out = []
    for i, t in enumerate(texts):
        h, after = len(t) // 2, texts[(i + 1) % len(texts)]
        out.append(t[: len(t) - h] + after[:h])
    return out


@pytest.fixture
def in_ranges(spark):
    """Sets into how many ranges a sort deals its rows."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {n: spark.conf.get(n) for n in names}

    def deal(ranges):
        spark.conf.set(names[0], str(ranges))
        spark.conf.set(names[1], "false")

    yield deal
    for n, v in before.items():
        spark.conf.set(n, v)


def brute_parts(docs, low=0.005, high=0.05):
    """doc -> (fingerprint components of a text) by plain loops over dictionaries; hashes from the same library."""
    import xxhash

    def h64(value):
        return xxhash.xxh64_intdigest(value, 42)

    texts = [t or "" for _, t in docs]
    terms = [{w for w in re.split(r"\s+", t.lower(), flags=re.ASCII) if w} for t in texts]
    df = Counter(w for x in terms for w in x)
    lexicon = {w for w, n in df.items() if low * len(texts) <= n <= high * len(texts)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def subset_hash(hashes, bits):
        seed = 42
        for x in hashes:  # Spark hashes an array element by element, each with the hash before as seed
            seed = xxhash.xxh64_intdigest((x & ((1 << 64) - 1)).to_bytes(8, "little"), seed)
        return signed(seed) & 0xFFFFFFFF if bits == 32 else signed(seed)

    def parts(text):
        own = {w for w in re.split(r"\s+", text.lower(), flags=re.ASCII) if w}
        band = sorted(signed(h64(w.encode())) for w in (own & lexicon or own))
        out = [(subset_hash(band, 64) or 1) if band else 0]
        for rate in (4, 8, 16, 32, 64, 128, 256):
            bits = rate.bit_length() - 1
            for i in range(8):
                kept = [x for x in band if (x >> ((7 * i + 3 * bits) % (63 - bits))) & (rate - 1) == (5 * i + bits) % rate]
                out.append((subset_hash(kept, 32) or 1) if kept else 0)
        return out

    return parts


def brute_likeness(a, b):
    used = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


def brute_text(parts):
    return "-".join([f"{parts[0] & (1 << 64) - 1:016x}", *(f"{x:08x}" for x in parts[1:])])


def test_fingerprints_and_likeness_equal_plain_loops(spark):
    """The registered query's rows, all columns, on a whole table."""
    from linewatch.llm.queries import op7_fingerprints

    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    parts, texts = brute_parts(docs), [t for _, t in docs]
    rows = {r.doc_id: r for r in op7_fingerprints(spark, sf).collect()}
    assert len(rows) == len(docs)
    for k, ((i, t), e) in enumerate(zip(docs, edited(texts))):
        own, changed, after = parts(t), parts(e), parts(texts[(k + 1) % len(texts)])
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (brute_text(own), brute_text(changed))
        assert (r.near_edited, r.near_next) == (pytest.approx(brute_likeness(own, changed)), pytest.approx(brute_likeness(own, after)))


def test_fifty_ranges_and_repeated_ids(spark, in_ranges):
    """Rows of equal doc_id and equal rows, over many ranges of the sort; the plan does not grow with the rows."""
    in_ranges(50)
    rng = random.Random(8)
    rows = [(rng.randrange(40) if rng.random() < 0.9 else None, rng.choice(["", "one two", "three", "a b c d e", f"text {k}"])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = edited_fingerprints(docs)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    texts = [t for _, t in order]
    want = Counter((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for (i, t), e in zip(order, edited(texts)))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got.collect()) == want
    large = edited_fingerprints(spark.createDataFrame([(i, f"text {i}") for i in range(4000)], "doc_id long, text string"))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(large) <= size(got)


@pytest.mark.parametrize("ranges", [3, 40])
def test_edited_texts_and_likeness(spark, in_ranges, ranges):
    in_ranges(ranges)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in edited_fingerprints(docs).collect()}
    plain = sorted((r.doc_id, r.text) for r in docs.collect())
    texts = [t for _, t in plain]
    by_text = {}
    for (i, t), e in zip(plain, edited(texts)):
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if e == t:
            assert r.near_edited == 1.0 and r.edited_fingerprint == r.fingerprint
    assert sum(r.near_edited for r in rows.values()) > 5 * sum(r.near_next for r in rows.values())


def test_fingerprints_handle_awkward_rows(spark, awkward, nothing):
    rows = edited_fingerprints(awkward).collect()
    assert len(rows) == awkward.count()
    order = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in awkward.collect()))
    texts = [t for *_, t in order]
    want = Counter((i if known else None, len(t), hashlib.sha256(e.encode()).hexdigest()) for (known, i, t), e in zip(order, edited(texts)))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    same = fingerprint(awkward).where("doc_id in (6, 7, 11) and text not like 'another%'").select("fingerprint").distinct().count()
    assert same == 1 and fingerprint(awkward).drop("fingerprint").columns == awkward.columns
    blank = {r.fingerprint for r in fingerprint(awkward).where("doc_id in (0, 1, 2)").collect()}
    assert len(blank) == 1
    assert edited_fingerprints(nothing).count() == 0 and fingerprint(nothing).count() == 0
    one = edited_fingerprints(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


def test_short_texts_have_fingerprints_of_their_own(spark):
    texts = [f"word{i}" for i in range(200)] + [f"some few words {i}" for i in range(100)] + ["", " \n", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = fingerprint(docs).collect()
    known = {r.fingerprint for r in rows if r.doc_id < 300}
    blank = {r.fingerprint for r in rows if r.doc_id >= 300}
    assert len(known) == 300 and len(blank) == 1 and not known & blank
    near = {r.doc_id: r.near_next for r in edited_fingerprints(docs).collect()}
    assert all(near[i] < 1.0 for i in range(300)) and near[299] == 0.0 and near[300] == near[301] == 1.0


def test_pipeline_stages(spark, awkward, nothing):
    """Each stage against a plain version of itself; columns of documents stay."""
    import corpus_pipeline as cp
    from linewatch.llm.common import stored
    from linewatch.llm.quality import score_quality
    from linewatch.llm.toxicity import score_toxicity
    from test_dedup import brute_groups, covered

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    after = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out, _ = stored(out, f"test-{name}")
        before = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            want = {r.doc_id for r in score_toxicity(docs, labels).where("predicted = 0").collect()}
        elif name == "quality":
            want = {r.doc_id for r in score_quality(docs, labels).where("predicted = 1").collect()}
        elif name == "near_duplicates":
            want = {i for i, (n, c) in brute_groups(sorted(before.items()), 5, 80).items() if i == c}
        else:
            want = set(before)
        assert {r.doc_id for r in out.collect()} == want, name
        if name == "shared_passages":
            words = {i: t.encode().split() for i, t in before.items()}
            gone = dict(zip(words, covered([tuple(w) for w in words.values()], cp.PASSAGE_WORDS)))
            for r in out.collect():
                g = gone[r.doc_id]
                kept = b" ".join(w for w, x in zip(words[r.doc_id], g) if not x).decode()
                assert r.text == (kept if any(g) else before[r.doc_id]) and r.n_chars == len(r.text)
        after[name] = out
        docs = out
    assert len({len(x) for x in cp.STAGES}) == 1 and [n for n, _ in cp.STAGES] == list(after)
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()} & {r.doc_id for r in after["toxicity"].collect()}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert len(toxic) <= 0.25 * labels.where("toxic = 1").count()
    assert len(clean - {r.doc_id for r in after["toxicity"].collect()}) <= 0.01 * len(clean)
    ran = cp.run(spark, sf)
    total = lambda df: df.agg(F.sum("length"), F.countDistinct("doc_id")).first()
    assert total(ran) == total(after["packing"])


def test_registration():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and {"op2_ngram_join", "op3_substring_dedup"} <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["op2_ngram_join", "op3_substring_dedup"])
def test_queries_match_duckdb(spark, name):
    import duckdb

    from checks.compare import _rows
    from linewatch.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    assert _rows(QUERIES[name](spark, SF).toPandas()) == _rows(con.execute(SQL[name]).df())
