from __future__ import annotations

from collections import defaultdict

from freightlens.llm.common import table
from freightlens.llm.line_dedup import MIN_WORDS, common_blocks, dedup_lines, passages, patience_alignment
from freightlens.llm.queries import op3_line_dedup

LONG = "this line has just over ten words in it, so it counts"
OTHER = "another long line that nobody else would write down in this very way"
DOCS = [
    (1, f"{LONG}\n\nown one"),
    (2, f"start\n  THIS line has just over ten words in it,   so it counts\nend"),
    (3, None),
    (4, ""),
    (5, "short\nown one"),
    (6, f"{OTHER}\n{OTHER}"),
    (7, f"{OTHER}\n{OTHER}"),
    (7, f"{OTHER}\n{OTHER}"),
    (8, f"{OTHER}\nthe same id\nshort"),
    (8, f"{LONG}\nwith another text"),
    (None, LONG),
    (9, "one two three four five\n\nsix seven eight nine ten"),
    (10, "one two three four five\n\nsix seven eight nine ten\nmore"),
    (11, "six seven eight nine ten\nbetween here\none two three four five"),
]
KEPT = {
    1: [f"{LONG}\n\nown one"],
    2: ["start\nend"],
    3: [None],
    4: [""],
    5: ["short\nown one"],
    6: [f"{OTHER}\n{OTHER}"],
    7: ["", ""],
    8: ["the same id\nshort", "with another text"],
    None: [LONG],
    9: ["one two three four five\n\nsix seven eight nine ten"],
    10: ["\nmore"],
    11: ["six seven eight nine ten\nbetween here\none two three four five"],
}


def by_id(found):
    out = defaultdict(list)
    for r in found.collect():
        out[r.doc_id].append(r.text)
    return {k: sorted(v, key=repr) for k, v in out.items()}


def test_edge_cases(docs_of):
    found = dedup_lines(docs_of(DOCS, ("N_Lines", "code")))
    assert by_id(found) == {k: sorted(v, key=repr) for k, v in KEPT.items()}
    assert found.columns == ["doc_id", "text", "code", "n_lines", "deleted_lines"]


def test_frequent_lines_are_treated_too(docs_of):
    """A passage that far more documents share than a rare line has holders."""
    rows = [(k, f"own text {k}\n{LONG}\nend {k}") for k in range(200)]
    got = by_id(dedup_lines(docs_of(rows), rare=2))
    assert got[0] == [rows[0][1]] and all(got[k] == [f"own text {k}\nend {k}"] for k in range(1, 200))


def test_short_frequent_lines_are_cut(docs_of):
    """The floor of ``min_words`` holds for lines with few holders only."""
    rows = [(k, f"own {k}\nAll rights\nyes\nfew have {k // 2}\nend {k}") for k in range(40)]
    got = by_id(dedup_lines(docs_of(rows), rare=3))
    assert got[0] == [rows[0][1]]
    assert all(got[k] == [f"own {k}\nyes\nfew have {k // 2}\nend {k}"] for k in range(1, 40))


def test_frequent_lines_in_another_order_are_cut(docs_of):
    rows = [(k, "all rights\nread more" if k % 2 else "read more\nall rights") for k in range(20)]
    got = by_id(dedup_lines(docs_of(rows), rare=3))
    assert got == {0: [rows[0][1]]} | {k: [""] for k in range(1, 20)}


def test_every_copy_of_a_repeat_is_cut(docs_of):
    """A later document may hold a line or a passage more often than any earlier one."""
    short = "one line of six words here\n\nand six more words after it"
    rows = [(1, f"{LONG}\nown\n{short}"), (2, f"{LONG}\na\n{LONG.upper()}\n{short}\nb\n{short}\nc")]
    got = by_id(dedup_lines(docs_of(rows)))
    assert got == {1: [rows[0][1]], 2: ["a\n\nb\n\nc"]}


def test_crossing_blocks_are_cut(docs_of):
    """Also those that only another document than the first holder has in this order."""
    one, two, three = (f"{w} short line of six words" for w in ("first", "second", "third"))
    rows = [
        (1, f"{three}\nx\n{two}\ny\n{one}\n{LONG}\n{OTHER}"),
        (2, f"{OTHER}\n{LONG}\nown two\n{one}\n{two}"),
        (3, f"{one}\n{two}\nown three\n{two}\n{one}"),
    ]
    got = by_id(dedup_lines(docs_of(rows)))
    assert got == {
        1: [rows[0][1]],
        2: [f"own two\n{one}\n{two}"],
        3: [f"own three\n{two}\n{one}"],
    }


def test_passages():
    assert passages([], 10) == set()
    assert passages([10, 12], 10) == set()
    assert passages([5, 5, 5], 10) == {(0, 1), (1, 2)}
    assert passages([3, 10, 2], 10) == {(0, 1), (1, 2)}
    assert passages([4, 3, 2], 10) == set()


def test_partitioning_does_not_matter(docs_of):
    docs = docs_of(DOCS)
    assert by_id(dedup_lines(docs.repartition(7))) == by_id(dedup_lines(docs.coalesce(1)))


def test_empty_table(docs_of):
    assert dedup_lines(docs_of([])).count() == 0


def test_patience_alignment():
    assert patience_alignment([]) == []
    # two anchors in order, one that crosses them
    assert patience_alignment([(0, 0, 2), (1, 9, 2), (2, 3, 2), (3, 4, 2)]) == [0, 2, 3]
    # lines that are not unique align between their neighbours only
    assert patience_alignment([(0, 5, 2), (1, 6, 0), (2, 1, 0), (3, 7, 2)]) == [0, 1, 3]
    assert patience_alignment([(0, 0, 0), (1, 1, 0)]) == [0, 1]


def test_common_blocks():
    text = "one two three\n\nfour five\nown\nsix"
    assert common_blocks(text, [0, 2, 4], 5) == [0, 2]
    assert common_blocks(text, [0, 2, 4], 6) == []
    assert common_blocks(text, [], 1) == []


def normal(line):
    return " ".join(line.lower().split())


def test_given_documents(spark):
    """Each later copy of a long line goes, and nothing goes that no earlier document has."""
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    got = {r.doc_id: r for r in op3_line_dedup(spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    held: dict[str, set[int]] = defaultdict(set)
    repeated = 0
    for doc in sorted(texts):
        lines = texts[doc].split("\n")
        gone = {int(k) for k in got[doc].deleted_lines.split(",") if k}
        assert got[doc].text == "\n".join(x for k, x in enumerate(lines) if k not in gone)
        assert all(held[normal(lines[k])] for k in gone)
        for k, line in enumerate(lines):
            if len(line.split()) >= MIN_WORDS and held[normal(line)]:
                repeated += 1
                assert k in gone
        for line in lines:
            held[normal(line)].add(doc)
    assert repeated > 100


def test_given_passages(spark):
    """No later copy of a long line or passage of an earlier document is left."""
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    got = {r.doc_id: r for r in op3_line_dedup(spark, sf_dir).collect()}
    held: set[str] = set()
    repeated = 0
    for doc in sorted(texts):
        lines = [(k, normal(x)) for k, x in enumerate(texts[doc].split("\n")) if x.strip()]
        gone = {int(k) for k in got[doc].deleted_lines.split(",") if k}
        own = set()
        for first in range(len(lines)):
            for last in range(first, min(first + MIN_WORDS, len(lines))):
                passage = "\n".join(x for _, x in lines[first : last + 1])
                if len(passage.split()) >= MIN_WORDS:
                    own.add(passage)
                    if passage in held:
                        repeated += 1
                        assert gone.issuperset(k for k, _ in lines[first : last + 1])
        held |= own
    assert repeated > 100
