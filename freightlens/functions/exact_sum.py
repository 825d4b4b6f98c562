"""Sums of doubles that are exact, so that neither order nor partitioning shows in them.

Every finite double is a whole number of units 2^(20 b - 1074) for a bin b near its own
exponent, and less than 2^75 of them. Cut into four digits of 20 bits, the numbers of one
bin are added as longs, which merge in any order; some 10^12 rows fit. The sums of a
group's few bins are then carried into one long number, and that is rounded once, to the
nearest double, to even in a tie.

Expressions are SQL text, which builds far faster than nested Python lambdas.
"""

from __future__ import annotations

from functools import cache

_BITS, DIGITS, _LEAST = 20, 4, -1074
_BASE = 1 << _BITS
_BINS = (1024 - _LEAST) // _BITS + 1


def finite(value: str) -> str:
    """The value, or NULL if it is NaN or infinite."""
    return f"CASE WHEN NOT isnan({value}) AND abs({value}) < double('inf') THEN {value} END"


def exponent_bin(value: str) -> str:
    """The bin of a finite double; NULL for NULL, and for zero, which adds nothing to any."""
    # the logarithm may be off by one next to a power of two, which the bounds allow for
    bin_ = f"greatest(cast(floor((floor(log2(abs({value}))) - {53 + _LEAST}) / {_BITS}) AS int), 0)"
    return f"CASE WHEN {value} <> 0 THEN {bin_} END"


@cache
def _scale(half: int) -> str:
    """For each bin one of two factors that bring its unit to 1, each within a double's range."""
    scales = [-(_LEAST + _BITS * b) for b in range(_BINS)]
    factors = [2.0 ** (s // 2, s - s // 2)[half] for s in scales]
    return "array(" + ", ".join(f"{f!r}D" for f in factors) + ")"


def units(value: str, bin_: str) -> str:
    """A finite double in units of its bin; exact, as it is scaled by powers of two."""
    return f"{value} * get({_scale(0)}, {bin_}) * get({_scale(1)}, {bin_})"


def unit_digits(count: str) -> list[str]:
    """The four digits of a number of units, lowest first, each with the number's sign."""
    digits = []
    for place in range(DIGITS):
        # the remainder of doubles is exact and has the sign of the first, as the cast keeps it
        upto = count if place == DIGITS - 1 else f"{count} % {float(_BASE ** (place + 1))!r}D"
        digits.append(f"cast(({upto}) / {float(_BASE**place)!r}D AS long)")
    return digits


def _let(name: str, value: str, then: str) -> str:
    """``then``, in which ``name`` is a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {then}), 0)"


def _carried(sums: str, sign: int) -> str:
    """(carry, digits): digits from 0 to the base; a negative number carries -1 at the end."""
    total = f"(s.carry + {sign} * d.digit)"
    digit = f"named_struct('place', d.place, 'digit', {total} & {_BASE - 1}L)"
    none = "cast(array() AS array<struct<place:int,digit:bigint>>)"
    return (
        f"aggregate({sums}, named_struct('carry', 0L, 'digits', {none}), (s, d) -> named_struct("
        f"'carry', shiftright({total}, {_BITS}), 'digits', concat(s.digits, array({digit}))))"
    )


def _rounded(digits: str) -> str:
    """The double nearest to a number given by its digits, lowest first.

    The five highest digits are taken as one decimal of 81 bits or more, with a last bit
    for whether anything is left below; its conversion to a double rounds correctly.
    """
    kind = "struct<number:decimal(38,0),taken:int,place:int,rest:boolean>"

    def state(number: str, taken: str, place: str, rest: str) -> str:
        return f"cast(named_struct('number', {number}, 'taken', {taken}, 'place', {place}, 'rest', {rest}) AS {kind})"

    taken = state(f"s.number * {_BASE} + d.digit", "s.taken + 1", "d.place", "s.rest")
    left = state("s.number", "s.taken", "s.place", "s.rest OR d.digit <> 0")
    power = f"({_BITS} * s.place + {_LEAST - 1})"
    return (
        f"aggregate(reverse({digits}), {state('0', '0', '0', 'false')}, (s, d) ->"
        f" CASE WHEN s.taken = 0 AND d.digit = 0 THEN s WHEN s.taken < 5 THEN {taken} ELSE {left} END,"
        f" s -> cast(s.number * 2 + IF(s.rest, 1, 0) AS double)"
        f" * pow(2D, floor({power} / 2)) * pow(2D, {power} - floor({power} / 2)))"
    )


def exact_total(entries: str) -> str:
    """The sum, rounded once, of (bin, digits) entries, digits being sums of ``unit_digits``.

    Zero without entries.
    """
    bins = f"transform({entries}, e -> e.bin)"
    # room for the highest digit and for what its sum carries over
    places = f"sequence(array_min({bins}), array_max({bins}) + 7)"
    at = f"aggregate({entries}, 0L, (t, e) -> t + coalesce(get(e.digits, p - e.bin), 0L))"
    sums = f"transform({places}, p -> named_struct('place', p, 'digit', {at}))"
    negative = f"-{_rounded('(' + _carried('sums', -1) + ').digits')}"
    signed = f"IF(up.carry >= 0, {_rounded('up.digits')}, {negative})"
    total = _let("sums", sums, _let("up", _carried("sums", 1), signed))
    return f"IF(size({entries}) > 0, {total}, 0D)"
