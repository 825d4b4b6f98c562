"""Language identification of web pages by Bayesian evidence fusion.

Four pieces of evidence on a page's language are multiplied:

* its text, by a naive Bayes model of byte trigrams that is counted over all labelled
  texts by grouped aggregation, and tempered, as trigrams depend on each other;
* the language that its markup declares, and
* the suffix of its address; how likely each is in a language is learned from the pages
  themselves, by summing what the text alone says over all pages that share it;
* a prior for its host, smoothed towards that of the registered domain, which is
  smoothed towards that of all pages. A page does not count towards its own prior.

All sums are grouped aggregations with partial sums, so a host with a third of the pages
is one row for each task; joining them back is left to skew-aware joins on small rows.

Defined cases: a null or empty page has no text evidence; a page without a declared
language, or with none of the form of a language code, declares "und"; an address
without a host has the host, domain and suffix "". Repeated rows count each. Labelled
texts that are null or have a null language are not used; without any, the language
and the probability are null. At most ``MAX_LANGUAGES`` languages are told apart; more are an error.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.llm.common import LOWER, byte_arrays, with_computed
from freightlens.llm.url_filter import url_host
from freightlens.sources import stored

#: Buckets of hashed trigrams, and the bound on languages: the model has a row for each pair.
BUCKETS = 1 << 14
MAX_LANGUAGES = 200
#: Weight of the text's log-likelihood, and pages' worth of the parent in a host's prior.
TEMPER, HOST_STRENGTH, DOMAIN_STRENGTH = 0.1, 5.0, 20.0
SMOOTHING = 0.5

_OPENED = re.compile(r"<(script|style)\b", re.IGNORECASE)
_CLOSED = re.compile(r"</(script|style)\s*+>", re.IGNORECASE)
_HTML = re.compile(r"<html\b", re.IGNORECASE)
_LANG = re.compile(r"""\blang\s*+=\s*+["']?([A-Za-z]{2,3})(?![A-Za-z])""", re.IGNORECASE)


def trigram_buckets(text: np.ndarray) -> np.ndarray:
    """Hashed byte trigrams of a text in lower case."""
    low = LOWER[text].astype(np.uint32)
    if low.size < 3:
        return np.empty(0, np.int64)
    code = (low[:-2] * np.uint32(65599) + low[1:-1]) * np.uint32(65599) + low[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def trigram_counts(labelled: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, bucket, n) over all labelled texts; partial counts are made in the tasks."""
    narrow = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.lower(F.col(lang).cast("string")).alias("lang"), F.col(text).cast("string").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
        for batch in batches:
            names = batch.column("lang").to_pylist()
            for name, data in zip(names, byte_arrays(batch.column("text")), strict=True):
                sums[name] += np.bincount(trigram_buckets(data), minlength=BUCKETS)
        for name, counts in sums.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * used.size, pa.string()),
                    pa.array(used.astype(np.int32)),
                    pa.array(counts[used]),
                ],
                names=["lang", "bucket", "n"],
            )

    partial = narrow.mapInArrow(run, "lang string, bucket int, n long")
    return partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def text_model(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log-probability of each bucket in each.

    The collected rows are bounded by languages times buckets.
    """
    counts = stored(counts, "trigrams")
    names = sorted(r[0] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sums = np.zeros((len(names), BUCKETS))
    place = {name: k for k, name in enumerate(names)}
    for name in names:
        own = counts.where(F.col("lang") == name).select("bucket", "n").toPandas()
        sums[place[name], own["bucket"].to_numpy()] = own["n"].to_numpy()
    sums += SMOOTHING
    return names, np.log(sums / sums.sum(axis=1, keepdims=True)).astype(np.float32)


def page_text(html: str) -> str:
    """The page with each script, style sheet, comment and tag replaced by a blank.

    Ends are listed once and only looked up, so that markup that never ends is not searched
    for its end again and again.
    """
    ends: dict[str, list[tuple[int, int]]] = {"script": [], "style": []}
    for m in _CLOSED.finditer(html):
        ends["style" if m.group(1).lower() == "style" else "script"].append(m.span())
    comment_end = html.rfind("-->")
    kept, done, at = [], 0, html.find("<")
    while at >= 0:
        stop, opened = -1, _OPENED.match(html, at)
        if opened:
            own = ends["style" if opened.group(1).lower() == "style" else "script"]
            k = bisect_left(own, (opened.end(), 0))
            stop = own[k][1] if k < len(own) else -1
        elif html.startswith("<!--", at) and comment_end >= at + 4:
            stop = html.find("-->", at + 4) + 3
        if stop < 0:
            stop = html.find(">", at + 1) + 1
            if not stop:
                break  # no tag ends any more
        kept += [html[done:at], " "]
        done, at = stop, html.find("<", stop)
    return "".join([*kept, html[done:]])


def declared_language(html: str) -> str:
    """The language named in the first ``html`` tag that names one."""
    at = _HTML.search(html)
    while at:
        stop = html.find(">", at.end())
        found = _LANG.search(html, at.end(), stop if stop >= 0 else len(html))
        if found:
            return found.group(1).lower()
        # further tags before this one's end can name none either
        at = _HTML.search(html, stop) if stop >= 0 else None
    return "und"


def text_evidence(pages: DataFrame, page_id: str, url: str, html: str, model: np.ndarray) -> DataFrame:
    """(id, host, domain, suffix, declared, evidence): no page content any more."""
    host = url_host(F.col(url))
    labels = F.split("host", r"\.")
    narrow = pages.select(
        F.col(page_id).alias("id"), host.alias("host"), F.col(html).cast("string").alias("html")
    ).withColumns(
        {
            "domain": F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), "."),
            "suffix": F.element_at(labels, -1),
        }
    )

    def compute(column: pa.Array) -> list[list]:
        declared, evidence = [], []
        for value in column:
            page = value.as_py() or ""
            declared.append(declared_language(page))
            data = np.frombuffer(page_text(page).encode(), np.uint8)
            counts = np.bincount(trigram_buckets(data), minlength=BUCKETS)
            evidence.append((TEMPER * (model @ counts)).tolist())
        return [declared, evidence]

    made = with_computed(narrow, ["html"], "declared string, evidence array<double>", compute)
    return made.drop("html")


def _normalised(logs: Column) -> Column:
    """Probabilities from log-weights."""
    top = F.array_max(logs)
    shifted = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x)
    return F.transform(shifted, lambda x: x / total)


def _sums(df: DataFrame, keys: list[str], name: str, size: int) -> DataFrame:
    """For each key, the summed text posteriors as an array and their number."""
    parts = [F.sum(F.col("posterior")[k]).alias(f"p{k}") for k in range(size)]
    grouped = df.groupBy(*keys).agg(*parts, F.count(F.lit(1)).alias(f"{name}_n"))
    return grouped.select(*keys, F.array(*(f"p{k}" for k in range(size))).alias(name), f"{name}_n")


def _added(parts: list[Column]) -> Column:
    out = parts[0]
    for part in parts[1:]:
        out = F.zip_with(out, part, lambda a, b: a + b)
    return out


def identify_languages(
    pages: DataFrame,
    labelled: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """page_id, host, declared, text_language, language, probability of each page.

    ``labelled`` has texts with their language. Counts it and stores the pages' evidence
    when called.
    """
    names, model = text_model(trigram_counts(labelled, text, lang))
    size = len(names)
    if not size:
        host = url_host(F.col(url)).alias("host")
        none = [F.lit(None).cast("string").alias(c) for c in ("declared", "text_language", "language")]
        return pages.select(page_id, host, *none, F.lit(None).cast("double").alias("probability"))
    evidence = text_evidence(pages, page_id, url, html, model)
    seen = stored(evidence.withColumn("posterior", _normalised(F.col("evidence"))), "evidence")

    # one row: how many pages of each language there seem to be, and all pages
    total = seen.agg(*(F.sum(F.col("posterior")[k]) for k in range(size)), F.count(F.lit(1))).first()
    pages_of = [float(x or 0.0) for x in total[:-1]]
    every = float(sum(pages_of)) + size * SMOOTHING
    overall = F.array(*(F.lit((x + SMOOTHING) / every) for x in pages_of))
    of_language = F.array(*(F.lit(x) for x in pages_of))

    def likelihood(sums: str) -> Column:
        """Log of the chance, in each language, of what the pages of these sums share."""
        return F.zip_with(sums, of_language, lambda a, b: F.log((a + SMOOTHING) / (b + 2 * SMOOTHING)))

    def smoothed(sums: str, count: str, parent: Column, strength: float) -> Column:
        others = F.zip_with(sums, "posterior", lambda a, b: F.greatest(a - b, F.lit(0.0)))
        whole = F.col(count) - 1 + strength
        return F.zip_with(others, parent, lambda a, p: (a + strength * p) / whole)

    fused = seen
    for key, name in (("declared", "d"), ("suffix", "s"), ("domain", "g"), ("host", "h")):
        # stored, so that the join may split a host or suffix that many pages share
        fused = fused.join(stored(_sums(seen, [key], name, size), f"sums-{key}"), key)
    fused = fused.withColumn("domain_prior", smoothed("g", "g_n", overall, DOMAIN_STRENGTH))
    fused = fused.withColumn("prior", smoothed("h", "h_n", F.col("domain_prior"), HOST_STRENGTH))
    logs = _added(
        [F.col("evidence"), likelihood("d"), likelihood("s"), F.transform("prior", lambda x: F.log(x))]
    )
    fused = fused.withColumn("fused", _normalised(logs))
    known = F.array(*(F.lit(n) for n in names))

    def best(chances: str) -> Column:
        return F.element_at(known, F.array_position(chances, F.array_max(chances)).cast("int"))

    return fused.select(
        F.col("id").alias(page_id),
        "host",
        "declared",
        best("posterior").alias("text_language"),
        best("fused").alias("language"),
        F.round(F.array_max("fused"), 4).alias("probability"),
    )
