"""Fill-in-the-middle against a plain string form, and the exact way back."""

import hashlib
import re

import pytest

from linewatch.llm.fill_in_middle import fill_in_middle, fill_in_middle_digests, restored
from linewatch.llm.queries import op11_fill_in_middle

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def _plain(doc_id, text):
    """(n, form, prefix length, middle length, output) by string slicing."""
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    tokens = TOKEN.findall(text)
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_string_slicing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in op11_fill_in_middle(spark, SF).collect()}
    expected = {}
    for r in docs:
        *head, output = _plain(r.doc_id, r.text)
        expected[r.doc_id] = (*head, _sha(output), _sha(r.text or ""))
    assert got == expected
    assert {x[1] for x in got.values()} == {"plain", "spm", "psm"}


def test_awkward_rows(spark, awkward):
    got = sorted((tuple(r) for r in fill_in_middle_digests(awkward).collect()), key=repr)
    expected = []
    for r in awkward.collect():
        *head, output = _plain(r.doc_id, r.text)
        expected.append((r.doc_id, *head, _sha(output), _sha(r.text or "")))
    assert got == sorted(expected, key=repr)


def test_sentinels_white_space_and_code_points(spark):
    texts = ["", " \t\r\n", "a<P>b c", "x <S", "P> <M", "é 🎉   ö \x1c z\x0b", "<" * 9 + " <<S P>", None] * 12
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = restored(fill_in_middle(docs))
    assert {(r.doc_id, r.form, r.output, r.text) for r in back.collect()} == {
        (i, _plain(i, t)[1], _plain(i, t)[4], t or "") for i, t in enumerate(texts)
    }


def test_every_share_and_other_sentinels(spark):
    docs = spark.createDataFrame([(i, f"one two three {i} ") for i in range(200)], "doc_id long, text string")
    marks = ("[pre]", "[suf]", "[mid]")
    assert {r.form for r in fill_in_middle(docs, percent=100, spm_percent=100, sentinels=marks).collect()} == {"spm"}
    psm = restored(fill_in_middle(docs, seed=7, percent=100, spm_percent=0, sentinels=marks), marks).collect()
    assert all(r.form == "psm" and r.output.startswith("[pre]") and r.text == f"one two three {r.doc_id} " for r in psm)
    assert {r.form for r in fill_in_middle(docs, percent=0).collect()} == {"plain"}
    for bad in (("<P>", "<P>", "<M>"), ("<<", "<S>", "<M>"), ("aP", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle(docs, sentinels=bad)


def test_empty_table(spark, nothing):
    assert fill_in_middle_digests(nothing).collect() == []
