"""URL filter: host and path rules, and a list of canonical URLs behind a Bloom filter.

A URL gets the verdict of the longest rule that fits. URLs without one are looked up
in the list: a blocked Bloom filter lets possible hits pass to an exact join with the
list, which removes the false positives; all others are known not to be listed and
are not shuffled.

The filter's size follows the list's up to ``max_blocks`` (a bound of the broadcast).
Beyond it the filter passes more false positives to the join; the result stays exact.

Defined cases: null, or text without "://", has an empty host and path and no canonical
URL; it gets the default verdict. An empty list blocks nothing. Repeated rows are
judged alike. Columns that bear the name of a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.llm.bloom import MAX_BLOCKS, block_count, with_possible
from freightlens.llm.common import lower_ascii, without
from freightlens.sources import stored


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_host(url: Column) -> Column:
    """From the first "://" to "/", "?", "#" or the end, A to Z in lower case; else empty."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """One form for a page's variants; null without a host.

    Scheme, fragment, a leading "www." or "m.", trailing slashes, and the parameters
    ``ref`` and ``utm_*`` go; the other parameters are sorted.
    """
    host = F.regexp_replace(url_host(url), r"^(www|m)\.", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(
        F.split(query, "&"), lambda p: (F.length(p) > 0) & ~p.rlike(r"^(utm_[^=]*|ref)(=|\z)")
    )
    params = F.array_join(F.array_sort(kept), "&")
    whole = F.concat(host, path, F.when(F.length(params) > 0, F.concat(F.lit("?"), params)).otherwise(""))
    return F.when(F.length(host) > 0, whole)


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)


def longest_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = _fits(rule, host, path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def listed_urls(
    df: DataFrame, listed: DataFrame, url: str, listed_url: str, max_blocks: int = MAX_BLOCKS
) -> DataFrame:
    """The frame with a column ``listed``; ``url`` and ``listed_url`` are canonical.

    Counts the list when called, to size the filter.
    """
    own = listed.select(F.col(listed_url).alias("__url")).where("__url is not null").distinct()
    own = stored(own, "listed")  # read three times; the join may split a hot URL's pages
    base = without(df, "listed")
    blocks = block_count(own.count(), max_blocks)
    tested = with_possible(base, url, own, "__url", blocks)
    out = tested.where(~F.col("__maybe")).drop("__maybe").withColumn("listed", F.lit(False))
    possible = tested.where("__maybe").drop("__maybe")
    exact = possible.join(
        own.withColumn("__in", F.lit(True)), F.col(url) == F.col("__url"), "left"
    ).select(*(F.col(f"`{c}`") for c in base.columns), F.col("__in").isNotNull().alias("listed"))
    return out.unionByName(exact)


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: list[Rule],
    url: str = "url",
    listed_url: str = "url",
    default: str = "allow",
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """The pages with host, path, rule, listed and verdict.

    ``listed`` holds URLs in any form; they are canonicalised here. ``verdict`` is the
    longest fitting rule's, else "block" for a listed URL, else ``default``.
    """
    base = without(pages, "host", "path", "rule", "listed", "verdict")
    host, path = url_host(F.col(url)), url_path(F.col(url))
    judged = base.withColumns({"host": host, "path": path, "__canonical": canonical_url(F.col(url))})
    name, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    judged = judged.withColumns({"rule": name, "__ruled": verdict})
    urls = listed.select(canonical_url(F.col(listed_url)).alias("__listed_url"))
    found = listed_urls(judged, urls, "__canonical", "__listed_url", max_blocks)
    method = F.when(F.col("listed"), "block").otherwise(default)
    return found.withColumn("verdict", F.coalesce("__ruled", method)).drop("__ruled", "__canonical")
