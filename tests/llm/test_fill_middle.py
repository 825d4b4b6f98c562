from __future__ import annotations

import hashlib
import re
import time

from pyspark.sql import functions as F

from freightlens.llm.common import table
from freightlens.llm.fill_middle import fill_in_middle, restored, unit_ends
from freightlens.llm.queries import op11_fill_in_middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc, text, seed=42, percent=50, spm=80):
    """(n, form, prefix_chars, middle_chars, output), token by token."""
    text = text or ""
    units = TOKEN.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_matches_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: tuple(r)[1:] for r in op11_fill_in_middle(spark, sf_dir).collect()}
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    assert got.keys() == docs.keys()
    for doc, text in docs.items():
        *head, output = brute(doc, text)
        assert got[doc] == (*head, sha(output), sha(text or ""))


def test_odd_texts_and_names(spark, docs_of):
    texts = [
        None, "", " ", "\t\n", "a", " a", "a ", "a b", "a\x00b c", "　x y", "a<P>b", "<M>", "<S", "S> <P",
        "<", "<<", "x <", "> y", "é 😀 \x0b\x0c\r\n z", "one " * 50, "one " * 50,
    ]
    rows = [(k, t) for k, t in enumerate(texts * 8)] + [(None, "a b c")] * 2 + [(3, "\t\n")]
    docs = docs_of(rows, clash=("output", "Form", "n"))
    made = fill_in_middle(docs, percent=90, percent_spm=50)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(
        repr((d, *brute(d, t, percent=90, spm=50), t or "")) for d, t in rows
    )
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0)).collect() == []


def test_units():
    assert unit_ends("") == [] and unit_ends(" a  b ") == [2, 5, 6]


def test_very_long_texts_take_linear_time():
    for text in ("a " * 500_000, "a" * 1_000_000, " " * 1_000_000, "\n" * 500_000 + "a" + " " * 500_000):
        start = time.monotonic()
        assert unit_ends(text)[-1] == len(text)
        assert time.monotonic() - start < 5
