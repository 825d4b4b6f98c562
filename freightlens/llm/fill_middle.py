"""Fill-in-the-middle: a text cut at two word boundaries and written in another order.

A unit is a word with the blanks before it, or the blanks at the end of the text. One
``fullmatch`` of (unit)* with the ``regex`` library keeps every repetition of its group,
so ``match.ends(1)`` holds the end of each unit: its length is the number of units and
its entries are the possible cuts. Nothing steps through a text in Python.

Four numbers of 32 bits from the SHA-256 of "seed:id" decide a document: two choose the
cuts among the n + 1 boundaries, the third whether it is transformed at all, the fourth
the form. In ``psm`` prefix, suffix and middle follow each other, in ``spm`` suffix,
prefix and middle. Marks stand before the parts, so ``restored`` gives the exact text back.

No shuffle: rows are handled where they are read, in small slices. A text is held whole,
with one integer for each of its units.

Defined cases: a null text is an empty one; an empty text, and one that holds a mark, stay
``plain``, with null lengths; a null id counts as an empty one, so "seed:" is hashed; rows
with equal id and text give equal results, however often they come. The result has
columns of its own only, so other columns of the table cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from freightlens.llm.common import fields_of, slices

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")

_MADE = "n long, form string, prefix_chars long, middle_chars long, output string"
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

_BLANK = r"\x20\x09-\x0D"
_UNITS = regex.compile(rf"([{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+)*")


def unit_ends(text: str) -> list[int]:
    """The end of each unit of a text, in code points."""
    return _UNITS.fullmatch(text).ends(1)


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def fill_in_middle(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    seed: int = 42,
    percent: int = 50,
    percent_spm: int = 80,
    marks: Sequence[str] = MARKS,
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of each document.

    ``percent`` of the documents are transformed, ``percent_spm`` of these as ``spm``.
    """
    before_prefix, before_suffix, before_middle = marks

    def transformed(doc: int | None, whole: str) -> tuple[int, str, int | None, int | None, str]:
        ends = unit_ends(whole)
        first, second, apply, form = draws(seed, doc)
        if not whole or apply % 100 >= percent or any(mark in whole for mark in marks):
            return len(ends), "plain", None, None, whole
        cuts = [0, *ends]
        low, high = sorted((first % len(cuts), second % len(cuts)))
        a, b = cuts[low], cuts[high]
        prefix, middle, suffix = whole[:a], whole[a:b], whole[b:]
        if form % 100 < percent_spm:
            output = f"{before_suffix}{suffix}{before_prefix}{prefix}{before_middle}{middle}"
            return len(ends), "spm", a, b - a, output
        output = f"{before_prefix}{prefix}{before_suffix}{suffix}{before_middle}{middle}"
        return len(ends), "psm", a, b - a, output

    narrow = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string"))
    fields = [narrow.schema.fields[0], *fields_of(_MADE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = batch.column(0), batch.column(1)
            rows = [
                transformed(doc, whole.as_py() or "")
                for doc, whole in zip(ids.to_pylist(), texts, strict=True)
            ]
            made = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(_KINDS)]
            yield pa.RecordBatch.from_arrays([ids, *made], names=[f.name for f in fields])

    return narrow.mapInArrow(run, StructType(fields))


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text from which an output of the given form was made."""
    before_prefix, before_suffix, before_middle = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.length(one) + len(second) + 1, F.length(rest))
        two = F.substring_index(rest, before_middle, 1)
        return one, two, F.substring(rest, F.length(two) + len(before_middle) + 1, F.length(rest))

    prefix, suffix, middle = parts(before_prefix, before_suffix)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(before_suffix, before_prefix)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
