from __future__ import annotations

import math
import random
import re
import time

import numpy as np
import pytest

from freightlens.llm import language_id as op
from freightlens.llm.common import table
from freightlens.llm.language_id import declared_language, page_text
from freightlens.llm.queries import op1_language_fusion

LABELLED = [
    ("the house and the garden are over there", "en"),
    ("das haus und der garten sind dort drüben", "DE"),
    ("la maison et le jardin sont là", "fr"),
    (None, "fr"),
    ("no language", None),
]
PAGES = [
    (1, "http://a.b.de/x", '<html lang="de-AT"><body>das haus und der garten</body></html>'),
    (2, "http://a.b.de/y", "<p>das haus</p><script>the the the the and and</script>"),
    (3, "http://a.b.de/z", "<html lang='de'>"),
    (4, "http://c.fr/", "<HTML class=x LANG=fr>le jardin et la maison"),
    (5, None, "the garden and the house"),
    (6, "nothing", None),
    (6, "nothing", None),
    (7, "http://a.b.de/q", '<html lang="">der garten und das haus sind dort'),
    (None, "http://x.com", "the garden " * 20_000),
]


def brute(labelled, pages):
    names = sorted({lang.lower() for text, lang in labelled if text is not None and lang})
    model = []
    for name in names:
        counts = np.full(op.BUCKETS, op.SMOOTHING)
        for text, lang in labelled:
            if text is not None and lang and lang.lower() == name:
                np.add.at(counts, op.trigram_buckets(np.frombuffer(text.encode(), np.uint8)), 1)
        model.append(np.log(counts / counts.sum()).astype(np.float32))
    rows = []
    for page, url, html in pages:
        host = url.split("://")[1].split("/")[0] if url and "://" in url else ""
        data = np.frombuffer(op.page_text(html or "").encode(), np.uint8)
        logs = np.array([op.TEMPER * m[op.trigram_buckets(data)].sum() for m in model], float)
        weights = np.exp(logs - logs.max())
        keys = (op.declared_language(html or ""), host.split(".")[-1], ".".join(host.split(".")[-2:]), host)
        rows.append((page, host, keys, logs, weights / weights.sum()))
    total = sum(r[4] for r in rows)
    overall = (total + op.SMOOTHING) / (total.sum() + len(names) * op.SMOOTHING)
    out = []
    for page, host, keys, logs, own in rows:
        shared = [[r[4] for r in rows if r[2][k] == keys[k]] for k in range(4)]
        sums = [sum(s) for s in shared]
        score = logs + sum(np.log((s + op.SMOOTHING) / (total + 2 * op.SMOOTHING)) for s in sums[:2])
        domain = (np.maximum(sums[2] - own, 0) + op.DOMAIN_STRENGTH * overall) / (
            len(shared[2]) - 1 + op.DOMAIN_STRENGTH
        )
        prior = (np.maximum(sums[3] - own, 0) + op.HOST_STRENGTH * domain) / (
            len(shared[3]) - 1 + op.HOST_STRENGTH
        )
        score = score + np.log(prior)
        chance = np.exp(score - score.max())
        chance /= chance.sum()
        out.append((page, host, keys[0], names[int(own.argmax())], names[int(chance.argmax())], chance.max()))
    return out


@pytest.fixture
def labelled(spark):
    return spark.createDataFrame([(*r, "x") for r in LABELLED], "text string, lang string, Bucket string")


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "x") for r in PAGES], "page_id long, url string, html string, Host string")


def compared(got, want):
    got, want = (sorted(x, key=lambda r: repr(tuple(r)[:4])) for x in (got, want))
    assert [tuple(r)[:5] for r in got] == [r[:5] for r in want]
    assert all(math.isclose(a[5], b[5], abs_tol=2e-4) for a, b in zip(got, want))


def test_edge_cases_match_brute_force(pages, labelled):
    compared(op.identify_languages(pages, labelled).collect(), brute(LABELLED, PAGES))


def test_host_prior_decides_an_empty_page(pages, labelled):
    got = {r.page_id: r for r in op.identify_languages(pages, labelled).collect()}
    assert got[3].language == "de" and got[7].declared == "und" and got[2].language == "de"


def test_empty_tables(pages, labelled):
    assert op.identify_languages(pages.limit(0), labelled).count() == 0
    none = op.identify_languages(pages, labelled.limit(0)).collect()
    assert len(none) == len(PAGES) and {r.language for r in none} == {None}


def test_too_many_languages_are_an_error(spark, pages, monkeypatch):
    monkeypatch.setattr(op, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError):
        op.identify_languages(pages, spark.createDataFrame(LABELLED, "text string, lang string"))


def test_query_matches_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    labelled = [(r.text, r.lang) for r in table(spark, sf_dir, "documents").collect()]
    pages = [(r.page_id, r.url, r.html) for r in table(spark, sf_dir, "pages").collect()]
    compared(op1_language_fusion(spark, sf_dir).collect(), brute(labelled, pages))


MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.DOTALL | re.IGNORECASE)
DECLARED = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})(?![A-Za-z])""", re.IGNORECASE)


def test_markup_is_read_as_by_plain_patterns():
    """The plain patterns search on and on for ends that never come, but say what to find."""
    r = random.Random(1)
    parts = ["<", ">", "<script>", "</script >", "<Style", "</STYLE>", "<!--", "-->", "<p>", "x", " ", "<scripts>", "</script"]
    parts += ["<html", " lang=", "'en'", "de", "lang = fr", "<HTML>", "xlang=es", "abcd", "\n"]
    for _ in range(6000):
        page = "".join(r.choices(parts, k=r.randint(1, 12)))
        assert page_text(page) == MARKUP.sub(" ", page), page
        found = DECLARED.search(page)
        assert declared_language(page) == (found.group(1).lower() if found else "und"), page


def test_very_long_pages_take_linear_time():
    for part in ("<html ", "<script>", "<!--", "<", "</script ", "<html lang ", "<style></script>"):
        page = part * (1_000_000 // len(part))
        start = time.monotonic()
        page_text(page)
        declared_language(page)
        assert time.monotonic() - start < 4, part
