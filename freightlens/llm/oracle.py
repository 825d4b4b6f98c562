"""DuckDB statements for the operators' queries that SQL can express."""

from __future__ import annotations

from freightlens.llm.queries import SPAM_TERMS, URL_RULES

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all({_LOWER.format(f'coalesce({text}, chr(32))')}, '{pattern}')"


_ALPHANUMERIC = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP2 = f"""
WITH item AS (
    SELECT item_id, {_words("text", _ALPHANUMERIC)} AS w FROM benchmark
), windows AS (
    SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS size,
        array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS run
    FROM item, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(k)
    WHERE len(w) > 0
), doc AS (
    SELECT doc_id, {_words("text", _ALPHANUMERIC)} AS w FROM documents
), sizes AS (
    SELECT DISTINCT size FROM windows
), runs AS (
    SELECT doc_id, k, size, array_to_string(w[k : k + size - 1], ' ') AS run
    FROM doc, sizes, unnest(range(1, len(w) - size + 2)) AS t(k)
    WHERE len(w) >= size
), hits AS (
    SELECT doc_id, k, size, item FROM runs JOIN windows USING (size, run)
), hit_words AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM hits, unnest(range(k, k + size)) AS t(place) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
    coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_AFTER = "CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END"
_HOST = _LOWER.format(f"regexp_extract(coalesce({_AFTER}, ''), '^[^/?#]*', 0)")
_PATH = f"regexp_extract(coalesce({_AFTER}, ''), '^[^/?#]*([^?#]*)', 1)"
_QUERY = rf"regexp_extract(coalesce({_AFTER}, ''), '^[^?#]*\?([^#]*)', 1)"


def _rule_rows() -> str:
    return ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)


OP4 = rf"""
WITH rules(verdict, h, p) AS (VALUES {_rule_rows()}),
parts AS (
    SELECT page_id, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS query FROM pages
), canonical AS (
    SELECT page_id, host, path, CASE WHEN host <> '' THEN
        regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '')
        || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS url
    FROM (
        SELECT *, list_sort(list_filter(string_split(query, '&'), lambda x:
            x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)'))) AS params
        FROM parts
    )
), listed AS (
    SELECT DISTINCT url FROM canonical WHERE url IS NOT NULL
        AND regexp_matches(host, '{"|".join(SPAM_TERMS)}')
), fitting AS (
    SELECT page_id, arg_max(h || p, length(h || p)) AS rule,
        arg_max(verdict, length(h || p)) AS ruled
    FROM canonical JOIN rules
        ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    GROUP BY page_id
)
SELECT c.page_id, c.host, c.path, f.rule, l.url IS NOT NULL AS listed,
    coalesce(f.ruled, CASE WHEN l.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM canonical c LEFT JOIN listed l ON c.url = l.url LEFT JOIN fitting f ON c.page_id = f.page_id
"""

# Sets of shingles; equal texts are one class, and links between classes are followed to
# the least id. The join on shingles is quadratic in the holders of a shingle.
OP7 = rf"""
WITH RECURSIVE doc AS (
    SELECT doc_id, {_words("text", r"[^\x20\x09-\x0D]+")} AS w FROM documents
), sets AS (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] ELSE
        list_transform(range(1, len(w) - least(len(w), 5) + 2),
            lambda k: array_to_string(w[k : k + least(len(w), 5) - 1], ' ')) END)) AS s
    FROM doc
), classes AS (
    SELECT min(doc_id) AS a, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), holders AS (
    SELECT a, n, unnest(s) AS shingle FROM classes
), links AS (
    SELECT x.a AS a, y.a AS b FROM holders x JOIN holders y USING (shingle)
    WHERE x.a <> y.a AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
    GROUP BY x.a, y.a, x.n, y.n
    HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
    SELECT a, a AS b FROM classes
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), components AS (
    SELECT a, min(b) AS component FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles,
    coalesce(k.component, d.doc_id) AS component_id,
    coalesce(k.component, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN classes c ON d.s = c.s LEFT JOIN components k ON c.a = k.a
"""

OP8 = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
        CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
    WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
    FROM scored
) WHERE rank <= 20
"""

OP11 = r"""
WITH doc AS (
    SELECT doc_id, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
        sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), drawn AS (
    SELECT doc_id, t, u, len(u) AS n,
        CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a,
        CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
        CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50
            THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM doc
), parts AS (
    SELECT doc_id, t, n, form, array_to_string(u[1 : least(a, b)], '') AS p,
        array_to_string(u[least(a, b) + 1 : greatest(a, b)], '') AS m,
        array_to_string(u[greatest(a, b) + 1 :], '') AS s
    FROM drawn
)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""


def _draw(*parts: str) -> str:
    text = " || ':' || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"CAST('0x' || md5('42:' || {text})[1:15] AS BIGINT)"


# The targets are shared out again round by round, and every quotient is ranked.
OP12 = rf"""
WITH RECURSIVE doc AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
    FROM documents
), copies AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS copy FROM doc
), sources AS (
    SELECT source, place, W, 2 * W AS cap, [3, 1, 2][1 + place % 3] AS weight,
        greatest(1, least(65536, CAST(ceil(W / 65536) AS BIGINT))) AS shards
    FROM (
        SELECT source, CAST(sum(size) AS BIGINT) AS W, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
        FROM doc GROUP BY source
    )
), rounds AS (
    SELECT 0 AS round, [CAST(-1 AS BIGINT)] AS full_ones,
        (SELECT sum(W) * 1.5e0 / sum(weight) FROM sources) AS level
    UNION ALL
    SELECT round + 1, f.places, f.level FROM rounds, LATERAL (
        SELECT list(place ORDER BY place) FILTER (cap < weight * rounds.level) AS places,
            ((SELECT sum(W) FROM sources) * 1.5e0 - coalesce(sum(cap) FILTER (cap < weight * rounds.level), 0))
                / nullif(sum(weight) FILTER (cap >= weight * rounds.level), 0) AS level
        FROM sources
    ) f
    WHERE f.places IS NOT NULL AND f.places <> rounds.full_ones AND f.level IS NOT NULL
), targets AS (
    SELECT sources.*, least(CAST(cap AS DOUBLE), weight * (SELECT arg_max(level, round) FROM rounds)) AS target
    FROM sources
), dealt AS (
    SELECT c.doc_id, c.size, c.copy, t.place, {_draw("c.doc_id", "c.size", "c.copy")} AS draw,
        {_draw("c.doc_id", "c.size", "c.copy")} % t.shards AS shard
    FROM copies c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source
), shards AS (
    SELECT place, shard, CAST(sum(size) AS BIGINT) AS words,
        greatest(1, CAST(round(sum(size) / 32) AS BIGINT)) AS m
    FROM dealt GROUP BY place, shard HAVING sum(size) > 0
), votes AS (
    SELECT t.place, t.target, sum(m) AS M, least(t.target * sum(m) / t.W, 2 * sum(m)) AS v
    FROM shards JOIN targets t USING (place) GROUP BY t.place, t.target, t.W
), seats AS (
    SELECT place, count(*) AS seats FROM (
        SELECT place, row_number() OVER (ORDER BY v / (2 * k + 1) DESC, place) AS rank
        FROM votes, unnest(range(CAST(2 * M AS BIGINT))) AS r(k)
    ) WHERE rank <= (SELECT round(sum(CAST(v AS DECIMAL(28, 6)))) FROM votes)
    GROUP BY place
), quotas AS (
    SELECT place, shard, count(*) AS quota FROM (
        SELECT s.place, s.shard, e.seats, row_number() OVER (
            PARTITION BY s.place
            ORDER BY least(CAST(e.seats AS DOUBLE) * s.m / v.M, 2 * s.m) / (2 * k + 1) DESC, s.shard) AS rank
        FROM shards s JOIN votes v USING (place) JOIN seats e USING (place), unnest(range(2 * s.m)) AS r(k)
    ) WHERE rank <= seats
    GROUP BY place, shard
), blocks AS (
    SELECT place, shard, b, b * words // m AS first, (b + 1) * words // m AS last,
        coalesce(quota, 0) // m + CASE WHEN row_number() OVER (
            PARTITION BY place, shard ORDER BY {_draw("place", "shard", "b")}, b
        ) <= coalesce(quota, 0) % m THEN 1 ELSE 0 END AS times
    FROM shards LEFT JOIN quotas USING (place, shard), unnest(range(m)) AS r(b)
), laid AS (
    SELECT *, sum(size) OVER (
        PARTITION BY place, shard ORDER BY draw, doc_id NULLS FIRST, size, copy
        ROWS UNBOUNDED PRECEDING
    ) - size AS start FROM dealt
), given AS (
    SELECT l.place, l.doc_id, l.size, l.copy,
        sum((least(l.start + l.size, b.last) - greatest(l.start, b.first)) * b.times) AS taken
    FROM laid l JOIN blocks b ON l.place = b.place AND l.shard = b.shard
        AND b.first < l.start + l.size AND b.last > l.start
    GROUP BY l.place, l.doc_id, l.size, l.copy
)
SELECT d.doc_id, t.source, d.size, t.W AS source_size, t.target,
    CAST(coalesce(g.taken, 0) AS BIGINT) AS taken
FROM dealt d JOIN targets t USING (place)
LEFT JOIN given g ON g.place = d.place AND g.doc_id IS NOT DISTINCT FROM d.doc_id
    AND g.size = d.size AND g.copy = d.copy
"""


def _assigned(books: str) -> str:
    """For each row and part, the nearest entry and its distance."""
    return f"""(
        SELECT id, part, min((dist, entry)) AS near FROM (
            SELECT c.id, c.part, b.entry,
                sum((c.x - b.x) * (c.x - b.x)) AS dist
            FROM cells c JOIN {books} b ON c.part = b.part AND c.place = b.place
            GROUP BY c.id, c.part, b.entry
        ) GROUP BY id, part
    )"""


def _refined(books: str) -> str:
    return f"""(
        SELECT b.part, b.entry, b.place, coalesce(n.x, b.x) AS x FROM {books} b LEFT JOIN (
            SELECT c.part, a.near[2] AS entry, c.place,
                CAST(floor(sum(c.x) / count(*)) AS BIGINT) AS x
            FROM cells c JOIN {_assigned(books)} a ON a.id = c.id AND a.part = c.part
            GROUP BY ALL
        ) n ON n.part = b.part AND n.entry = b.entry AND n.place = b.place
    )"""


# The nearest entry by comparing with every entry.
OP13 = f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS id, vec_id, label, v FROM (
        SELECT vec_id, label,
            list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE len(embedding) > 0 AND len(embedding) % 16 = 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    )
), cells AS MATERIALIZED (
    SELECT id, k // (len(v) // 16) AS part, k % (len(v) // 16) AS place, v[k + 1] AS x
    FROM kept, unnest(range(len(v))) AS r(k)
    WHERE len(v) = (SELECT len(v) FROM kept WHERE id = 0)
), books0 AS MATERIALIZED (
    SELECT part, entry, place, x FROM cells JOIN (
        SELECT id, row_number() OVER (ORDER BY id) - 1 AS entry FROM (SELECT DISTINCT id FROM cells)
    ) USING (id) WHERE entry < 64
), books1 AS MATERIALIZED {_refined("books0")},
books2 AS MATERIALIZED {_refined("books1")},
coded AS (
    SELECT id, string_agg(format('{{:02x}}', CAST(near[2] AS INTEGER)), '' ORDER BY part) AS code,
        CAST(sum(near[1]) AS BIGINT) AS error
    FROM {_assigned("books2")} GROUP BY id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) FROM books2)
        AS codebooks_sha256
FROM coded JOIN kept USING (id)
"""

ORACLE: dict[str, str] = {
    "op2_decontaminate": OP2,
    "op4_url_filter": OP4,
    "op7_minhash_join": OP7,
    "op8_threshold_topk": OP8,
    "op11_fill_in_middle": OP11,
    "op12_source_mix": OP12,
    "op13_vector_codes": OP13,
}
