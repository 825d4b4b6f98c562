"""Find the rows at given ranks of a whole table without sorting it.

Rows are ordered by a tuple of columns, NULLs first, so a key and its tie-break are searched
for together. A random sample tells between which tuples a rank lies; the next pass counts
the rows below and inside these brackets, exactly, and returns a sample of the inside,
or, once it is small enough, all of it. A rank outside its bracket is noticed by the counts
and looked for again with wider brackets, so results are exact either way.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tuples that a pass samples of a bracket, and that it returns when it returns all of them.
SAMPLE, CELLS = 20_000, 50_000
# Half width of a bracket in standard deviations of a rank's place in the sample.
MARGIN = 6.0

_Tuple = tuple[object, ...]


@dataclass
class _Bracket:
    """Rows from ``low`` to ``high``, both included; None leaves a side open."""

    low: _Tuple | None
    high: _Tuple | None
    ranks: list[int]


def rows_at_ranks(
    df: DataFrame, order: Sequence[str], wanted: Callable[[int], Mapping[str, int]]
) -> dict[str, _Tuple]:
    """For each slot the values of ``order`` in the row at its rank, the first being 1.

    ``wanted`` turns the number of rows into slot -> rank; ranks that no row has are left
    out. Runs jobs when called: a count, and passes over ``df`` that return CELLS tuples, or
    SAMPLE for each rank. Two passes do for a few hundred thousand rows; each further one
    narrows the brackets some twenty times.
    """
    count = df.count()
    slots = {slot: rank for slot, rank in wanted(count).items() if 1 <= rank <= count}
    margin, sample = MARGIN, SAMPLE
    while True:
        found = _search(df, list(order), count, sorted(set(slots.values())), margin, sample)
        if found is not None:
            return {slot: found[rank] for slot, rank in slots.items()}
        margin, sample = max(2 * margin, 1), 4 * sample  # as narrow, but safer


def _search(
    df: DataFrame, order: list[str], count: int, ranks: list[int], margin: float, sample: int
) -> dict[int, _Tuple] | None:
    """The tuple at each rank, or None if a bracket missed its ranks."""
    brackets, inside, seed = [_Bracket(None, None, ranks)] if ranks else [], count, 0
    found: dict[int, _Tuple] = {}
    while brackets:
        fraction = 1.0 if inside <= CELLS else min(sample * len(brackets) / inside, 1.0)
        zones = _counted(df, order, brackets, fraction, seed)
        narrower: list[_Bracket] = []
        last, inside, before = inside, 0, 0
        for at, bracket in enumerate(brackets):
            before += zones.rows(2 * at)
            held, drawn = zones.rows(2 * at + 1), zones.sample(2 * at + 1)
            if not all(before < rank <= before + held for rank in bracket.ranks):
                return None
            places = {rank: rank - before for rank in bracket.ranks}
            if bracket.low is not None and bracket.low == bracket.high:
                found |= dict.fromkeys(places, bracket.low)  # any number of equal rows
            elif fraction == 1:
                found |= {rank: drawn.tuple_at(place) for rank, place in places.items()}
            else:
                closer = _narrowed(bracket, places, held, drawn, margin)
                narrower += [b for b, _ in closer]
                inside += sum(rows for _, rows in closer)
            before += held
        if inside > 0.9 * last:
            sample *= 4  # too few to narrow the brackets
        brackets, seed = narrower, seed + 1
    return found


def _narrowed(
    bracket: _Bracket, places: dict[int, int], held: int, sample: _Sample, margin: float
) -> list[tuple[_Bracket, int]]:
    """Brackets inside one, each with the rows it may hold; overlapping ones are joined."""
    spans: list[tuple[int, int, list[int]]] = []
    size = sample.rows
    for rank, place in sorted(places.items()):
        share = place / held
        spread = margin * (size * share * (1 - share)) ** 0.5 + 2
        low = min(sample.find(int(size * share - spread)), sample.distinct - 1)
        high = max(sample.find(int(size * share + spread) + 1), low, 0)
        if spans and low <= spans[-1][1]:
            spans[-1] = (spans[-1][0], high, [*spans[-1][2], rank])
        else:
            spans.append((low, high, [rank]))
    found = []
    for low, high, ranks in spans:
        first = bracket.low if low < 0 else sample.tuple(low)
        last = bracket.high if high >= sample.distinct else sample.tuple(high)
        rows = sample.between(max(low, 0), min(high, sample.distinct - 1)) * held // max(size, 1)
        equal = first is not None and first == last
        found.append((_Bracket(first, last, ranks), 0 if equal else rows))
    return found


class _Sample:
    """Distinct tuples of a zone in order, with the number of rows of each."""

    def __init__(self, table: pa.Table, order: list[str]) -> None:
        self._table, self._order = table, order
        self._upto = table.column("n").to_numpy().cumsum()
        self.distinct = len(self._upto)
        self.rows = int(self._upto[-1]) if self.distinct else 0

    def find(self, place: int) -> int:
        """The index of the tuple at a place counted from 1: -1 before, ``distinct`` after all."""
        return -1 if place < 1 else int(self._upto.searchsorted(place))

    def tuple(self, index: int) -> _Tuple:
        return tuple(self._table.column(c)[index].as_py() for c in self._order)

    def tuple_at(self, place: int) -> _Tuple:
        return self.tuple(self.find(place))

    def between(self, low: int, high: int) -> int:
        """Rows of the tuples from ``low`` to ``high``."""
        if high < low:
            return 0
        return int(self._upto[high] - (self._upto[low - 1] if low else 0))


class _Zones:
    """What a pass returns: zones below, inside and between the brackets, numbered in order."""

    def __init__(self, table: pa.Table, order: list[str]) -> None:
        self._order = order
        self._of = {zone: table.filter(pa.compute.equal(table.column("zone"), zone)) for zone in set(table.column("zone").to_pylist())}
        self._none = table.slice(0, 0)

    def rows(self, zone: int) -> int:
        return pa.compute.sum(self._of.get(zone, self._none).column("n")).as_py() or 0

    def sample(self, zone: int) -> _Sample:
        own = self._of.get(zone, self._none)
        return _Sample(own.filter(own.column("kept")), self._order)


def _counted(
    df: DataFrame, order: list[str], brackets: list[_Bracket], fraction: float, seed: int
) -> _Zones:
    """Count the zones; of rows inside brackets, a fraction is returned tuple by tuple."""
    row = F.struct(*(F.col(c) for c in order))
    zone = F.lit(2 * len(brackets))
    for at, bracket in reversed(list(enumerate(brackets))):
        inner = F.lit(2 * at + 1)
        upto = inner if bracket.high is None else F.when(row <= literals(df, order, bracket.high), inner).otherwise(zone)
        zone = upto if bracket.low is None else F.when(row < literals(df, order, bracket.low), 2 * at).otherwise(upto)
    open_ones = [2 * at + 1 for at, b in enumerate(brackets) if b.low is None or b.low != b.high]
    kept = F.col("zone").isin(open_ones)
    if fraction < 1:
        kept &= F.rand(seed) < fraction  # only guides the next brackets
    names = [f"o{k}" for k in range(len(order))]
    rows = df.select(zone.alias("zone"), *(F.col(c).alias(n) for c, n in zip(order, names)))
    cells = (
        rows.withColumn("kept", kept)
        .select("zone", "kept", *(F.when(F.col("kept"), F.col(n)).alias(n) for n in names))
        .groupBy("zone", "kept", *names)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # few rows: the zones, and the tuples that are returned
    return _Zones(cells.coalesce(1).sortWithinPartitions("zone", "kept", *names).toArrow(), names)


def literals(df: DataFrame, columns: Sequence[str], values: _Tuple) -> Column:
    """A constant struct of the columns' types."""
    made = []
    for column, value in zip(columns, values, strict=True):
        kind = df.schema[column].dataType
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) and value is not None:
            value = str(value)  # a plain literal would depend on time zones
        made.append(F.lit(value).cast(kind).alias(column))
    return F.struct(*made)
