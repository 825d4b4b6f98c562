"""Exact quantiles per group, and cuts of a long order into ranges."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freightlens.operators.row_search import rows_at_ranks
from freightlens.sources.scratch import stored

RANK_RULES: dict[str, Callable[[Column, Decimal], Column]] = {
    # smallest rank that covers the fraction
    "ceil": lambda n, p: F.ceil(n * F.lit(p)),
    # lower neighbour of the interpolated position
    "floor": lambda n, p: F.floor((n - 1) * F.lit(p)) + 1,
}
# The same for a known number of rows.
RANKS_AMONG: dict[str, Callable[[int, Decimal], int]] = {
    "ceil": lambda n, p: int((n * p).to_integral_value(ROUND_CEILING)),
    "floor": lambda n, p: int(((n - 1) * p).to_integral_value(ROUND_FLOOR)) + 1,
}

# Size of the sketch that ranges are cut by.
SKETCH_SIZE = 4000
# Leading bits of a value that one round of counting tells apart, and rows of a group
# that are counted value by value.
ROUND_BITS = 20
CELLS = 50_000


def ordinal(value: Column, kind: T.DataType) -> Column:
    """A double that never decreases as the value grows; NULL for NULL."""
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, value).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("double")
    if isinstance(kind, T.StringType):  # by its first six bytes
        first = F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), 1, 6)), 12, "0")
        return F.conv(first, 16, 10).cast("double")
    raise TypeError(f"cannot rank values of type {kind.simpleString()}")


def quantile_grid(v: Column, steps: int) -> Column:
    """Aggregate: ``steps`` + 1 sketched quantiles of a double; NULL without any."""
    # as text: the function wants a constant array
    fractions = ", ".join(f"{i / steps}D" for i in range(steps + 1))
    sketch = F.kll_sketch_agg_double(v, F.lit(SKETCH_SIZE))
    # an empty sketch has no quantiles; it ignores NaN
    filled = F.count_if(v.isNotNull() & ~F.isnan(v)) > 0
    return F.when(filled, F.kll_sketch_get_quantile_double(sketch, F.expr(f"array({fractions})")))


def range_cuts(df: DataFrame, key: str, tie_break: str, parts: int) -> list[tuple[float, float | None]]:
    """Cuts of (key, tie-break) order into about ``parts`` even ranges, as ordinals.

    A key that holds several ranges' worth of rows is cut by its tie-break. Runs one job,
    and another if there is such a key; collects no more than ``parts`` rows and makes at most
    one cut more for each such key.
    """
    k = ordinal(F.col(key), df.schema[key].dataType)
    grid = df.agg(quantile_grid(k, parts)).first()[0] or []
    inner = sorted(grid)[1:-1]
    cuts: list[tuple[float, float | None]] = []
    times = {x: inner.count(x) for x in dict.fromkeys(inner)}
    hot = [x for x, n in times.items() if n > 1]
    ties = {}
    if hot:
        t = ordinal(F.col(tie_break), df.schema[tie_break].dataType)
        rows = df.filter(k.isin(hot)).groupBy(k.alias("k")).agg(quantile_grid(t, parts).alias("g"))
        ties = {r["k"]: sorted(r["g"] or []) for r in rows.collect()}
    for x, n in times.items():
        if n == 1 or not ties.get(x):
            cuts.append((x, None))
        else:
            own = ties[x]
            cuts += [(x, own[(len(own) - 1) * i // (n + 1)]) for i in range(1, n + 1)]
            cuts.append((x, None))
    return sorted(set(cuts), key=lambda c: (c[0], c[1] is None, c[1] or 0.0))


def with_range_number(
    df: DataFrame, name: str, key: str, tie_break: str, cuts: list[tuple[float, float | None]]
) -> DataFrame:
    """Add how many cuts lie before a row; never decreases in (key, tie-break) order, NULLs first.

    A binary search: each step is a column of its own that looks up one cut, so a row is
    compared with as many cuts as their number has binary digits.
    """

    def constants(values: Sequence[float]) -> Column:
        return F.expr("array(" + ", ".join(f"double('{v!r}')" for v in values) + ")")

    if not cuts:
        return df.withColumn(name, F.lit(0))
    keys = constants([float(k) for k, _ in cuts])
    # a cut without a tie-break comes after every row of its key
    ties = constants([float("inf") if t is None else float(t) for _, t in cuts])
    found = df.withColumns(
        {
            "_key": ordinal(F.col(key), df.schema[key].dataType),
            "_tie": ordinal(F.col(tie_break), df.schema[tie_break].dataType),
            name: F.lit(0),
        }
    )
    step = 1 << (len(cuts).bit_length() - 1)
    while step:
        at = F.col(name) + (step - 1)
        cut = F.get(keys, at)  # NULL beyond the last
        after = (F.col("_key") > cut) | ((F.col("_key") == cut) & (F.col("_tie") > F.get(ties, at)))
        found = found.withColumn(name, F.when(after, F.col(name) + step).otherwise(F.col(name)))
        step //= 2
    return found.drop("_key", "_tie")


def ordered_code(value: Column) -> Column:
    """A long that orders like a double: its exponent, then its fraction; NULL least, NaN most."""
    size = F.abs(value)
    guess = F.greatest(F.coalesce(F.floor(F.log2(size)), F.lit(-1022)), F.lit(-1022))
    half = F.floor(guess / 2)
    scaled = size / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), guess - half)
    # next to a power of two the logarithm may be off by one
    power = F.when(scaled >= 2, guess + 1).when((scaled < 1) & (guess > -1022), guess - 1).otherwise(guess)
    fraction = F.when(scaled >= 2, scaled / 2).when((scaled < 1) & (guess > -1022), scaled * 2).otherwise(scaled)
    code = F.shiftleft((power + 1022).cast("long"), 52) + (fraction * float(1 << 52)).cast("long")
    infinite = F.lit(2047 << 52)
    return (
        F.when(value.isNull(), F.lit(-(1 << 63)))
        .when(F.isnan(value), infinite + 1)
        .when(size == float("inf"), F.when(value > 0, infinite).otherwise(-infinite))
        .otherwise(F.when(value < 0, -code).otherwise(code))
    )


def _same(columns: Sequence[str]) -> Column:
    return reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns))


def _quantiles_of_groups(
    df: DataFrame, value: str, ranks: Callable[[Column], Mapping[str, Column]], groups: list[str]
) -> DataFrame:
    """(groups, slot, value) at each rank of each group.

    Rows are counted by group and leading bits of the value, which the map side sums up, and
    each rank is followed into the cell that holds it, with more bits each round, until
    no such cell has more than ``CELLS`` rows. Their values are then counted one by one. A group's
    state is one row for each rank, and one task holds no more of a group than its cells.
    """
    code = ordered_code(ordinal(F.col(value), df.schema[value].dataType))
    rows = df.select(*groups, F.col(value).alias("value"), code.alias("code"))
    own = [f"_{g}" for g in groups]

    def held(cells: DataFrame, by: list[str]) -> DataFrame:
        """The cells that hold a rank, and the rank among their rows."""
        before = F.sum("rows").over(Window.partitionBy(*by).orderBy("cell")) - F.col("rows")
        inside = (F.col("rank") > 0) & (F.col("rank") <= F.col("rows"))
        return cells.withColumn("rank", F.col("rank") - before).filter(inside)

    def cell(bits: int) -> Column:
        return F.shiftright("code", 64 - bits)

    bits = ROUND_BITS
    counted = rows.groupBy(*groups, cell(bits).alias("cell")).agg(F.count(F.lit(1)).alias("rows"))
    counted = counted.toDF(*own, "cell", "rows")
    size = F.sum("rows").over(Window.partitionBy(*own))
    slots = F.array(
        *(
            F.struct(F.lit(name).alias("slot"), rank.cast("long").alias("rank"))
            for name, rank in ranks(F.col("n")).items()
        )
    )
    before = F.sum("rows").over(Window.partitionBy(*own).orderBy("cell")) - F.col("rows")
    among = counted.withColumns({"n": size, "before": before}).withColumn("at", F.explode(slots))
    state = among.select(*own, "cell", "rows", "at.slot", (F.col("at.rank") - F.col("before")).alias("rank"))
    state = stored(state.filter((F.col("rank") > 0) & (F.col("rank") <= F.col("rows"))), "rank-cells")

    while bits < 64 and not state.filter(F.col("rows") > CELLS).isEmpty():
        more = min(bits + ROUND_BITS, 64)
        met = rows.join(state.withColumnRenamed("cell", "_cell").drop("rows"), _same(groups) & (cell(bits) == F.col("_cell")))
        finer = met.groupBy(*own, "slot", "rank", cell(more).alias("cell")).agg(F.count(F.lit(1)).alias("rows"))
        state, bits = stored(held(finer, [*own, "slot"]), "rank-cells"), more

    met = rows.join(state.select(*own, "slot", "rank", F.col("cell").alias("_cell")), _same(groups) & (cell(bits) == F.col("_cell")))
    values = met.groupBy(*own, "slot", "rank", F.col("value").alias("cell")).agg(F.count(F.lit(1)).alias("rows"))
    found = held(values, [*own, "slot"])
    return found.select(*(F.col(o).alias(g) for o, g in zip(own, groups)), "slot", F.col("cell").alias("value"))


def group_quantiles(
    df: DataFrame,
    value: str,
    fractions: Mapping[str, str],
    rule: str,
    group_by: Sequence[str] = (),
) -> DataFrame:
    """Discrete quantiles per group, one column per named fraction.

    Fractions are decimal text, so ranks such as ``ceil(30 * 0.1)`` are exact.
    The two rank rules are named in ``RANK_RULES``; they differ at 0.75 for some
    group sizes. NULLs take part and rank first. An empty input gives no rows. The ranks
    are searched for when this is called; with groups, their cells are stored.
    """
    groups = list(group_by)
    shares = {name: Decimal(p) for name, p in fractions.items()}
    if not groups:
        kind = df.schema[value].dataType
        schema = T.StructType([T.StructField(name, kind) for name in fractions])
        ranks = RANKS_AMONG[rule]
        found = rows_at_ranks(df, [value], lambda n: {name: ranks(n, p) for name, p in shares.items()})
        rows = [tuple(found[name][0] for name in fractions)] if found else []
        return df.sparkSession.createDataFrame(rows, schema)
    rank = RANK_RULES[rule]
    found = _quantiles_of_groups(
        df, value, lambda n: {name: rank(n, p) for name, p in shares.items()}, groups
    )
    columns = [
        F.max(F.when(F.col("slot") == name, F.col("value"))).alias(name) for name in fractions
    ]
    return found.groupBy(*groups).agg(*columns)
