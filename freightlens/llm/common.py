"""Helpers shared by the operators: reading tables, and words and their hashes in numpy.

Texts are handled as UTF-8 bytes. A word is a run of bytes of a given class, which
equals a run of characters since every byte of a non-ASCII character is 0x80 or more.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

#: ASCII letters in lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def byte_class(word: Callable[[int], bool]) -> np.ndarray:
    """For each byte value, whether it belongs to a word."""
    return np.array([word(b) for b in range(256)])


#: Digits, ASCII letters and everything beyond ASCII.
ALPHANUMERIC = byte_class(
    lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80
)
#: Everything but blank, tab, line feed, vertical tab, form feed and carriage return.
NOT_BLANK = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)

_BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)


_SHIPPED: set[str] = set()

#: Rows that a Python worker handles at a time, and bytes of a batch that it is sent.
SLICE_ROWS = 512
BATCH_BYTES = 16 << 20
_BATCH_SETTING, _DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application.

    Also lowers the session's bound on the bytes of an Arrow batch, as both the executor
    and the worker hold a batch for each running task.
    """
    current = spark.conf.get(_BATCH_SETTING)
    if current == _DEFAULT_BATCH:  # another setting is the user's choice
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="freightlens-code-"), "freightlens.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """The text with A to Z in lower case and nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns of these names, in any case."""
    taken = {n.lower() for n in names}
    return df.select(*(df[f"`{c}`"] for c in df.columns if c.lower() not in taken))


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_bounds(data: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one byte of each word."""
    flags = np.zeros(data.size + 2, np.int8)
    flags[1:-1] = classes[data]
    edges = np.flatnonzero(np.diff(flags))
    return edges[0::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not starts.size:
        return np.empty(0, np.uint64)
    lengths = ends - starts
    before = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(before, lengths)
    powers = np.full(int(lengths.max()), _MULTIPLIER)
    powers[0] = 1
    codes = _BYTE_CODES[data[place + np.repeat(starts, lengths)]] * np.cumprod(powers)[place]
    return mixed(np.add.reduceat(codes, before) + lengths.astype(np.uint64))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` consecutive words."""
    count = words.size - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = words[:count].copy()
    for k in range(1, size):
        total = total * _MULTIPLIER + words[k : k + count]
    return mixed(total)


def byte_arrays(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The UTF-8 bytes of each value of a string column, None for null; no copy is made."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for k in range(len(column)):
        yield data[bounds[k] : bounds[k + 1]] if valid[k] else None


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in small slices, so that what is made from one at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fields_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def with_computed(
    df: DataFrame, inputs: list[str], ddl: str, compute: Callable[..., list[list]]
) -> DataFrame:
    """Append the columns of ``ddl``, which ``compute`` makes from the input columns of a batch.

    ``compute`` gets one Arrow array for each input and returns one list for each new
    column. Columns of the frame that bear a new column's name are replaced.
    """
    new = fields_of(ddl)
    base = without(df, *(n for n in new.fieldNames() if n not in inputs))
    replaced = {n.lower() for n in new.fieldNames()}
    kept = [c for c in base.columns if c.lower() not in replaced]
    schema = StructType([base.schema[c] for c in kept] + list(new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in new]
        for batch in slices(batches):
            made = compute(*(batch.column(c) for c in inputs))
            arrays = [batch.column(c) for c in kept]
            arrays += [pa.array(v, k) for v, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *new.fieldNames()])

    return base.mapInArrow(run, schema)
