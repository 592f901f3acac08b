"""The queries in DuckDB's SQL, where it can say the same over whole tables."""

from __future__ import annotations

from ledgerline.llm import secrets, urls

#: Every twentieth vector against all of them, by signs.
TOPK = """
WITH v AS (SELECT vec_id, [x > 0 FOR x IN embedding] AS s FROM embeddings),
d AS (SELECT q.vec_id AS query_id, r.vec_id AS id, len(list_filter(list_zip(q.s, r.s), lambda p: p[1] <> p[2]))::INTEGER AS distance
  FROM v q, v r WHERE q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, rank, id, distance FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, id))::INTEGER AS rank FROM d) WHERE rank <= 10
"""

#: All windows of 100 bytes, as hexadecimal text; islands of repeated ones; what lies between.
REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, hash(substr(h, 2 * s + 1, 200)) AS k FROM d, unnest(range(0, greatest(0, len(h) // 2 - 99))) t(s)),
f AS (SELECT k, min((doc_id::HUGEINT << 40) + s) AS first FROM w GROUP BY k HAVING count(*) > 1),
r AS (SELECT doc_id, s FROM w JOIN f USING (k) WHERE (doc_id::HUGEINT << 40) + s <> first),
g AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM r)),
i AS (SELECT doc_id, island, min(s) AS a, max(s) + 100 AS b FROM g GROUP BY ALL),
k AS (SELECT doc_id, island, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a FROM i UNION ALL SELECT doc_id, 1000000000, max(b), NULL FROM i GROUP BY ALL),
kept AS (SELECT doc_id, string_agg(CASE WHEN a IS NULL THEN substr(h, 2 * p + 1) ELSE substr(h, 2 * p + 1, 2 * (a - p)) END, '' ORDER BY p) AS left_over FROM k JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM i GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(left_over, h))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def url_filter(rules=urls.RULES, rounds: int = urls.ROUNDS, damping: float = urls.DAMPING, threshold: float = urls.THRESHOLD) -> str:
    """Rules, host graph, and as many rounds of the two ranks, written out."""
    rest = "CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END"
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lambda u: low(f"regexp_extract({rest.format(u=u)}, '^([^/?#]*)', 1)")
    cases = lambda value: "CASE " + " ".join(f"WHEN (host = {_literal(r.partition('/')[0])} OR ends_with(host, {_literal('.' + r.partition('/')[0])})) AND starts_with(path, {_literal('/' + r.partition('/')[2])}) THEN {value(a, r)}" for a, r in sorted(rules, key=lambda x: (-len(x[1]), x[1]))) + " END"
    link = f"CASE WHEN contains(x, '://') THEN {host('x')} WHEN starts_with(x, '//') THEN {host(chr(39) + 'http:' + chr(39) + ' || x')} ELSE host END"
    href = _literal(r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""")
    named = _literal(r"(?i)\b((?:[a-z0-9-]+\.)+[a-z][a-z0-9-]+)\b")
    head = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, {host('url')} AS host, regexp_extract({rest.format(u='url')}, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
p AS (SELECT *, {cases(lambda a, r: _literal(r))} AS rule, {cases(lambda a, r: str(a).lower())} AS allow FROM h),
x AS (SELECT *, row_number() OVER () AS page FROM p),
l AS (SELECT DISTINCT page, host, t AS target FROM (SELECT page, host, unnest([{link} FOR x IN regexp_extract_all(html, {href}, 1)]) AS t FROM x
  UNION ALL SELECT page, host, n FROM (SELECT page, host, unnest([{low('x')} FOR x IN regexp_extract_all(html, {named}, 1)]) AS n FROM x) WHERE n IN (SELECT host FROM p))),
e AS (SELECT host AS source, target, count(*)::DOUBLE AS weight FROM l WHERE target <> '' GROUP BY ALL),
b AS (SELECT 't' AS kind, source AS a, target AS z, weight FROM e UNION ALL SELECT 'd', target, source, weight FROM e),
m AS (SELECT kind, a, z, weight / sum(weight) OVER (PARTITION BY kind, a) AS share FROM b),
s AS (SELECT host, count(*) FILTER (WHERE allow)::DOUBLE AS trust, count(*) FILTER (WHERE NOT allow)::DOUBLE AS distrust, count(*) AS pages FROM p GROUP BY host),
n AS (SELECT host, kind, sum(seed) AS seed FROM (SELECT host, 't' AS kind, trust AS seed FROM s UNION ALL SELECT host, 'd', distrust FROM s UNION ALL SELECT z, kind, 0 FROM m) GROUP BY ALL),
r0 AS (SELECT host, kind, seed AS rank FROM n)"""
    steps = "".join(
        f",\nr{i + 1} AS MATERIALIZED (SELECT n.host, n.kind, {1 - damping} * seed + {damping} * coalesce(i, 0) AS rank FROM n LEFT JOIN (SELECT m.kind, z AS host, sum(rank * share) AS i FROM m JOIN r{i} r ON r.host = m.a AND r.kind = m.kind GROUP BY ALL) q ON q.host = n.host AND q.kind = n.kind)"
        for i in range(rounds)
    )
    return f"""{head}{steps},
v AS (SELECT host, coalesce(sum(rank) FILTER (WHERE kind = 't'), 0) AS trust, coalesce(sum(rank) FILTER (WHERE kind = 'd'), 0) AS distrust, max(pages) AS pages FROM r{rounds} JOIN (SELECT host, pages FROM s) USING (host) GROUP BY host)
SELECT page_id, p.host, path, rule, CASE WHEN coalesce(allow, NOT coalesce(distrust - trust > {threshold} * pages, false)) THEN 'allow' ELSE 'block' END AS verdict, round(trust, 6) AS trust, round(distrust, 6) AS distrust
FROM p LEFT JOIN v ON v.host = p.host"""


def _any_case(words: str) -> str:
    """Letters of either case, without folding others to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def secret_scan(thresholds: dict[str, float] = secrets.THRESHOLDS, window: int = secrets.WINDOW, allow: tuple[str, ...] = secrets.ALLOW) -> str:
    """Texts cut up to matches and single characters, whose running lengths are places; candidates and the entropy of each of their windows by its definition."""
    word = "(?:" + "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    assign = word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    kinds = [("assign", assign, f"length(regexp_extract(part, {_literal(assign)}, 1)) >= 6"), ("access", "AKIA[A-Z0-9]+", "length(part) >= 20"), ("hex", "[0-9a-f]+", "length(part) >= 24")]
    cut_up = lambda pattern, rest, only: f"SELECT doc_id, part, (sum(length(part)) OVER (PARTITION BY doc_id ORDER BY n) - length(part))::BIGINT AS a FROM (SELECT doc_id, unnest(l) AS part, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, regexp_extract_all(t, {_literal(f'(?s){pattern}|{rest}')}) AS l FROM d WHERE regexp_matches(t, {_literal(only)})))"
    base = " UNION ALL ".join(f"SELECT doc_id, {i} AS o, '{k}' AS kind, a, a + length(part) AS b FROM ({cut_up(p, '[^A]' if k == 'access' else '[^0-9a-f]+' if k == 'hex' else '.', p) if k != 'access' else cut_up(p, '.', p)}) WHERE regexp_full_match(part, {_literal(p)}) AND {fits}" for i, (k, p, fits) in enumerate(kinds))
    least = min(2**t for t in thresholds.values())
    limit = "CASE " + " ".join(f"WHEN class = '{c}' THEN {t}" for c, t in thresholds.items()) + " END"
    bits = "list_max([list_sum([-(c::DOUBLE / length(w)) * log2(c::DOUBLE / length(w)) FOR c IN map_values(list_histogram(string_split(w, '')))]) FOR w IN [substr(part, i::BIGINT, " + str(window) + f") FOR i IN range(1, 1 + greatest(1, length(part) - {window - 1}))]])"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), base AS ({base}),
c AS (SELECT *, CASE WHEN NOT regexp_matches(part, '[0-9]') THEN 'letters' WHEN regexp_full_match(part, '[0-9a-fA-F]+') THEN 'hex' ELSE 'mixed' END AS class FROM ({cut_up('[A-Za-z0-9+/_-]+', '[^A-Za-z0-9+/_-]+', '.')})
  WHERE length(part) >= {least} - 1e-9 AND regexp_matches(part, '[A-Za-z]') AND regexp_full_match(part, '[A-Za-z0-9+/_-]+') AND NOT regexp_full_match(part, {_literal('|'.join(f'(?:{x})' for x in allow))})),
e AS (SELECT doc_id, 3 AS o, 'entropy' AS kind, a, a + length(part) AS b FROM c WHERE {bits} >= {limit} - 1e-9),
s AS (SELECT * FROM base UNION ALL SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = e.doc_id AND base.a <= e.a AND e.b <= base.b)),
g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex, count(*) FILTER (WHERE kind = 'entropy') AS n_entropy,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) FILTER (WHERE kind <> 'entropy') AS own, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, coalesce(n_entropy, 0)::BIGINT AS n_entropy, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


ORACLES = {"op4_url_filter": url_filter(), "op6_secret_scan": secret_scan(), "op9_suffix_dedup": REPEATS, "op10_exact_topk": TOPK}
