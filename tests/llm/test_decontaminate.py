from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from brute import contamination
from freightlens.llm import decontaminate as op
from freightlens.llm.common import table
from freightlens.llm.oracle import ORACLE
from freightlens.llm.queries import op2_decontaminate
from oracle_compare import differences, duck

TEN = "one two three four five six seven eight nine ten"
ITEMS = [
    (1, TEN + " eleven"),
    (2, "Short item"),
    (3, None),
    (4, "..."),
    (5, "short ITEM"),
    (10, "Größe zwei drei vier fünf sechs sieben acht neun zehn elf"),
]
DOCS = [
    (1, None),
    (2, ""),
    (3, f"Before, {TEN.upper()}! after"),
    (4, "a short-item, here"),
    (5, TEN.replace("five", "5")),
    (6, f"{TEN} eleven {TEN} eleven"),
    (7, "x " * 50_000 + TEN),
    (8, "größe zwei drei vier fünf sechs sieben acht neun zehn"),
    (8, "größe zwei drei vier fünf sechs sieben acht neun zehn"),
    (None, "short item"),
]


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def digest(found):
    rows = found.selectExpr(
        "doc_id", "n_words", "n_hit", "size(item_ids)", "sha2(array_join(item_ids, ','), 256)", "n_hit > 0"
    ).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_edge_cases_match_brute_force(docs_of, items):
    found = op.find_contamination(docs_of(DOCS, ("N_Words", "hit_spans")), items)
    assert digest(found) == sorted(contamination(DOCS, ITEMS), key=repr)
    assert found.columns.count("n_words") == 1 and "N_Words" not in found.columns


def test_blocks_of_a_large_benchmark_give_the_same(docs_of, items):
    found = op.find_contamination(docs_of(DOCS), items, max_windows=2)
    assert digest(found) == sorted(contamination(DOCS, ITEMS), key=repr)


def test_items_without_id_count_as_in_the_statement(spark, tmp_path):
    rows = [*ITEMS, (None, "words of no id"), (None, "other item without id"), (None, None)]
    docs = [*DOCS[:8], (9, "here are words of no id and the other item without id"), (11, f"of no id, {TEN}")]
    docs.append((12, f"words of no id {TEN}"))
    for name, key, made in (("benchmark", "item_id", rows), ("documents", "doc_id", docs)):
        ids, texts = zip(*made, strict=True)
        data = pa.table({key: pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())})
        pq.write_table(data, str(tmp_path / f"{name}.parquet"))
    got = op2_decontaminate(spark, str(tmp_path))
    assert differences(got, duck(str(tmp_path)).sql(ORACLE["op2_decontaminate"])) == []
    found = {r.doc_id: (r.n_hit, r.n_items) for r in got.collect()}
    assert found[9] == (8, 1) and found[11] == (10, 1) and found[12] == (14, 2)
    items = spark.read.parquet(str(tmp_path / "benchmark.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    blocks = op.find_contamination(frame, items, max_windows=2).where("doc_id = 12").first()
    assert blocks.item_ids == ["1", None]
    assert not op.decontaminate(frame, items).where("doc_id in (9, 12)").count()


def test_hits_are_verified_word_by_word(docs_of):
    """A block whose code belongs to other words than the document's gives no hit."""
    data = np.frombuffer(b"an item that is short", np.uint8)
    code = int(op.window_hashes(op._Words(data).hashes, 2).view(np.int64)[0])
    frame = docs_of([(1, "an item that is short")]).selectExpr(
        "*",
        "cast(array() as array<struct<first:bigint,last:bigint>>) hit_spans",
        "cast(array() as array<string>) item_ids",
    )
    false = op._scan(frame, "text", [(code, 2, b"other words", "1")]).first()
    true = op._scan(frame, "text", [(code, 2, b"an item", "1")]).first()
    assert (false.hit_spans, false.item_ids) == ([], [])
    assert (len(true.hit_spans), true.item_ids) == (1, ["1"])


def test_modes(docs_of, items):
    docs = docs_of([(1, f"Keep this. {TEN}. And this."), (2, "clean"), (3, None)], ("n_hit",))
    kept = op.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]
    cut = {r.doc_id: r.text for r in op.decontaminate(docs, items, mode="spans").collect()}
    assert cut == {1: "Keep this. . And this.", 2: "clean", 3: None}
    with pytest.raises(ValueError):
        op.decontaminate(docs, items, mode="other")


def test_empty_tables(docs_of, items):
    assert op.find_contamination(docs_of([]), items).count() == 0
    assert digest(op.find_contamination(docs_of(DOCS[:4]), items.limit(0))) == sorted(
        contamination(DOCS[:4], []), key=repr
    )


def test_query_matches_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r[0], r[1]) for r in table(spark, sf_dir, "documents").collect()]
    items = [(r[0], r[1]) for r in table(spark, sf_dir, "benchmark").collect()]
    got = sorted(tuple(r) for r in op2_decontaminate(spark, sf_dir).collect())
    assert got == sorted(contamination(docs, items)) and any(r[-1] for r in got)
