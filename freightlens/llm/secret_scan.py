"""Secret scan: plain patterns, and credentials whose parts stand close to each other.

Base patterns report on their own: assigned values, access identifiers and long hex
strings. Other strings may or may not be secret: random-looking tokens, of 24 characters or
more without an upper bound, and endpoints.
These weak candidates are reported only when complementary parts stand in the same
scope, which is a stretch of ``scope`` characters: a token next to an access identifier
or an endpoint, an endpoint next to an access identifier or a token that is reported.

Parts are found in one pass over whole texts. Linking is an interval join in Spark: a
part is filed under the cells of ``scope`` characters that it touches, and candidates
meet complements in the same or a neighbouring cell. A cell holds few parts, as each
part has a least length, so no key grows with the corpus or with a document.

Defined cases: a null text is an empty one. Rows with equal id and text get equal
results; rows with the same id and other texts are judged apart; a null id is an id.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.llm.common import with_computed, without
from freightlens.sources import stored

#: Base kinds in the order in which equal starts are listed, then the linked ones.
KINDS = ("assign", "access", "hex", "token", "endpoint")

# A failing match of the first pattern still uses up its text, so its length is tested
# afterwards. For the other two, a bound in the pattern gives the same matches.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}(?![A-Za-z0-9+/_=-])")
_URL = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?")
_HOST = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)+")
_SERVICE = ".amazonaws.com"
_EDGE = re.compile(r"\b(?=[a-z0-9-])")
_ASSIGNED_LEAST = 6


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns in code points, by start, then kind."""
    found = [
        (m.start(), 0, m.end())
        for m in _ASSIGN.finditer(text)
        if m.end(2) - m.start(2) >= _ASSIGNED_LEAST
    ]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def _random_looking(s: str) -> bool:
    """Upper and lower case and digits, with many distinct characters for the length."""
    return (
        any(c.isupper() for c in s)
        and any(c.islower() for c in s)
        and any(c.isdigit() for c in s)
        and len(set(s)) >= 14
    )


def weak_parts(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidate tokens outside base spans, and endpoints."""
    found = []
    if any(c in text for c in "0123456789"):
        ends = np.array([b for _, _, b in base], np.int64)
        starts = np.array([a for _, a, _ in base], np.int64)
        for m in _TOKEN.finditer(text):
            if _random_looking(m.group()) and not np.any((starts < m.end()) & (ends > m.start())):
                found.append(("token", m.start(), m.end()))
    if "://" in text or _SERVICE in text:
        found += [("endpoint", a, b) for a, b in endpoints(text)]
    return found


def endpoints(text: str) -> list[tuple[int, int]]:
    """URLs up to their port, and between them host names of a service, from a word's edge on.

    Runs of host characters are taken whole and looked at for the service's name, so no
    text is read again from each of its characters.
    """
    urls = [m.span() for m in _URL.finditer(text)] if "://" in text else []
    found = list(urls)
    if _SERVICE in text:
        gaps = zip([0, *(b for _, b in urls)], [*(a for a, _ in urls), len(text)], strict=True)
        for start, stop in gaps:
            for host in _HOST.finditer(text, start, stop):
                edge = _EDGE.search(text, host.start(), host.end())
                last = text.rfind(_SERVICE, edge.start() + 1, host.end()) if edge else -1
                if last >= 0:
                    found.append((edge.start(), last + len(_SERVICE)))
    return sorted(found)


_SPANS = "array<struct<kind:string,first:long,last:long>>"


def _parts(texts: pa.Array) -> list[list]:
    base, weak = [], []
    for text in texts:
        text = text.as_py() or ""
        own = base_spans(text)
        base.append([{"kind": k, "first": a, "last": b} for k, a, b in own])
        weak.append([{"kind": k, "first": a, "last": b} for k, a, b in weak_parts(text, own)])
    return [base, weak]


def _near(left: DataFrame, right: DataFrame, scope: int) -> DataFrame:
    """Parts of ``left`` with a part of ``right`` at most ``scope`` characters away."""
    cell = F.expr(f"explode(sequence(first div {scope} - 1, last div {scope} + 1))")
    left = left.withColumn(
        "cell", F.expr(f"explode(sequence(first div {scope}, last div {scope}))")
    )
    right = right.select(
        F.col("__id").alias("r_id"),
        F.col("__text").alias("r_text"),
        F.col("first").alias("r_first"),
        F.col("last").alias("r_last"),
        cell.alias("r_cell"),
    )
    close = (F.col("r_first") - F.col("last") <= scope) & (F.col("first") - F.col("r_last") <= scope)
    same = F.col("__id").eqNullSafe(F.col("r_id")) & (F.col("__text") == F.col("r_text"))
    near = left.join(right, same & (F.col("cell") == F.col("r_cell")) & close, "left_semi")
    return near.drop("cell").distinct()


def scan_secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = 400
) -> DataFrame:
    """Each document's id column, ``base`` and ``spans``: what the patterns report alone, and all.

    Both are arrays of (kind, first, last) by start, then kind, in code points with an
    exclusive end. Stores the parts (not the texts) when called.
    """
    narrow = docs.select(
        F.col(f"`{doc_id}`").alias("__id"),
        F.xxhash64(f"`{text}`").alias("__text"),
        F.col(f"`{text}`").cast("string").alias("__whole"),
    )
    parts = with_computed(narrow, ["__whole"], f"base {_SPANS}, weak {_SPANS}", _parts)
    parts = stored(without(parts, "__whole"), "parts")

    def exploded(column: str) -> DataFrame:
        return parts.select("__id", "__text", F.explode(column).alias("p")).select(
            "__id", "__text", "p.kind", "p.first", "p.last"
        )

    access = exploded("base").where("kind = 'access'")
    weak = exploded("weak").distinct()
    tokens, endpoints = weak.where("kind = 'token'"), weak.where("kind = 'endpoint'")
    linked_tokens = _near(tokens, access.unionByName(endpoints), scope)
    linked_endpoints = _near(endpoints, access.unionByName(linked_tokens), scope)
    linked = (
        linked_tokens.unionByName(linked_endpoints)
        .groupBy(F.col("__id").alias("l_id"), F.col("__text").alias("l_text"))
        .agg(F.collect_list(F.struct("kind", "first", "last")).alias("linked"))
    )
    same = F.col("__id").eqNullSafe(F.col("l_id")) & (F.col("__text") == F.col("l_text"))
    order = F.create_map(*(x for k, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(k))))
    every = F.concat("base", F.coalesce("linked", F.expr(f"cast(array() as {_SPANS})")))
    ranked = F.array_sort(
        F.transform(
            every,
            lambda s: F.struct(
                s["first"].alias("a"), order[s["kind"]].alias("k"), s["last"].alias("b"), s.alias("s")
            ),
        )
    )
    return (
        parts.join(linked, same, "left")
        .withColumn("spans", F.transform(ranked, lambda r: r["s"]))
        .select(F.col("__id").alias(doc_id), "base", "spans")
    )


def joined_spans(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"], s["last"])), ","
    )
