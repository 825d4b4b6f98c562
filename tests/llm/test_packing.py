from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from brute import token_ids
from freightlens.llm.common import table
from freightlens.llm.packing import pack, sequences
from freightlens.llm.queries import op9_packing, vocabulary
from freightlens.llm.tokens import Encoder

WORDS = vocabulary("word_bpe_49k.json")
TEXTS = [
    (1, None),
    (2, ""),
    (3, "Hello,  World!\n\t it's 42 CAFÉ́ é"),
    (4, "a <|endoftext|> b<|startoftext|>c d e \x1c f"),
    (5, "word " * 5000),
    (6, "İstanbul ΣΑΣ ﬁ 日本語 x"),
    (6, "İstanbul ΣΑΣ ﬁ 日本語 x"),
    (None, "no id"),
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_ids_equal_the_tokenizer(name):
    path = vocabulary(name)
    whole, own = Tokenizer.from_file(path), Encoder(path)
    assert own.by_word == name.startswith("word")
    for _, text in TEXTS:
        ids = np.frombuffer(own.encode(text or ""), own.dtype).tolist()
        assert ids == whole.encode(text or "", add_special_tokens=False).ids


def check(pieces, docs, length):
    """Each id lies in one piece, and the sequences are full and gapless."""
    whole = Tokenizer.from_file(WORDS)
    want, got = defaultdict(list), defaultdict(list)
    for doc, text in docs:
        want[doc].append(token_ids(whole, text).tobytes())
    rows = sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
    at, open_doc = 0, None
    for r in rows:
        assert r.sequence_id * length + r.offset == at and 0 < r.length <= length - r.offset
        if open_doc is None:
            assert r.start == 0
            open_doc = [r.doc_id, b"", r.doc_tokens]
        assert (r.doc_id, r.start, r.doc_tokens) == (open_doc[0], len(open_doc[1]) // 4, open_doc[2])
        open_doc[1] += bytes(r.ids)
        if len(open_doc[1]) == 4 * r.doc_tokens:
            got[r.doc_id].append(open_doc[1])
            open_doc = None
        at += r.length
    assert open_doc is None
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("length", [7, 4096])
def test_edge_cases(docs_of, length):
    docs = docs_of(TEXTS, ("Start", "part")).repartition(3)
    check(pack(docs, WORDS, length=length).collect(), TEXTS, length)


def test_sequences(docs_of):
    pieces = pack(docs_of(TEXTS), WORDS, length=64)
    rows = sorted(sequences(pieces).collect())
    ids = [np.frombuffer(r.ids, "<u4") for r in rows]
    assert [r.sequence_id for r in rows] == list(range(len(rows)))
    assert all(i.size == r.length for i, r in zip(ids, rows)) and {i.size for i in ids[:-1]} == {64}


def test_empty_table(docs_of):
    assert pack(docs_of([]), WORDS).count() == 0


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    whole, total = Tokenizer.from_file(WORDS), 0
    pieces = op9_packing(spark, sf_dir).collect()
    for r in pieces:
        ids = token_ids(whole, docs[r.doc_id])
        assert r.doc_tokens == ids.size
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        total += r.length
    assert total == sum(token_ids(whole, t).size for t in docs.values())
    assert len({r.sequence_id for r in pieces}) == -(-total // 4096)


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_ids_equal_the_tokenizer_s_on_all_texts(name):
    """Every text of the largest table, and every Latin-1 character in every neighbourhood."""
    own = Encoder(vocabulary(name))
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()
    every = "".join(map(chr, range(256)))
    texts += [every, every[::-1], " ".join(every), "a".join(every), "1".join(every), "'".join(every), every * 2]
    texts += ["it's IT'S we'll'd 'Re''ve ..'s '", "a<|endoftext|>b", "<|startoftext|>", "< |x|> ÀÉß ÿŸ İ ﬁ ñ", "e\u0301 x"]
    r = random.Random(2)
    texts += ["".join(r.choices(every + "'  sstt" * 4, k=60)) for _ in range(300)]
    plain = Tokenizer.from_file(vocabulary(name))
    for text in texts:
        got = np.frombuffer(own.encode(text or ""), own.dtype).tolist()
        assert got == plain.encode(text or "", add_special_tokens=False).ids, text[:80]
