"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from . import url_filter
from .license_scan import PHRASES, TEMPLATES, template_words

#: Distinct n-grams of each text, the pairs that share enough of them, and the smallest key reachable.
OP1 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reached)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id::BIGINT AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""

#: Brute-force cosines in double precision.
OP2 = """
WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN embedding::DOUBLE[] END AS e FROM embeddings),
u AS (SELECT * FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id, vec_id AS reached FROM v UNION SELECT r.vec_id, l.y FROM r JOIN l ON l.x = r.reached)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.x = v.vec_id)::BIGINT AS n_links, m.component_id::BIGINT AS component_id, v.vec_id = m.component_id AS kept
FROM v JOIN (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id) m USING (vec_id)
"""

#: Targets and expected copies by water filling, and the lowest Pareto ranks of each source. Exact for doc_ids that don't repeat.
OP3 = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
g AS (SELECT *, round(16 * log2(1 + log2(1 + size)))::INT AS grade FROM d),
l AS (SELECT source, grade, sum(size)::DOUBLE AS words, pow(2.0, grade / 16.0) AS merit FROM g GROUP BY ALL),
s AS (SELECT source, sum(words) AS source_size FROM l GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS full_size, sum(source_size) OVER () AS total FROM s),
v AS (SELECT *, full_size / weight AS level FROM w),
f AS (SELECT *, sum(full_size) OVER up + level * (sum(weight) OVER () - sum(weight) OVER up) <= total AS filled FROM v WINDOW up AS (ORDER BY level RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT source, source_size, CASE WHEN filled THEN full_size ELSE least(full_size, (total - sum(CASE WHEN filled THEN full_size ELSE 0 END) OVER ()) * weight / nullif(sum(CASE WHEN filled THEN 0 ELSE weight END) OVER (), 0)) END AS target FROM f),
lw AS (SELECT l.*, source_size, target, merit * words AS weight, 3.0::DOUBLE * words AS full_size, 3.0::DOUBLE / merit AS level FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source),
lf AS (SELECT *, sum(full_size) OVER up + level * (sum(weight) OVER (PARTITION BY source) - sum(weight) OVER up) <= target AS filled FROM lw WINDOW up AS (PARTITION BY source ORDER BY level RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ls AS (SELECT *, CASE WHEN filled THEN full_size ELSE least(full_size, (target - sum(CASE WHEN filled THEN full_size ELSE 0 END) OVER (PARTITION BY source)) * weight / nullif(sum(CASE WHEN filled THEN 0 ELSE weight END) OVER (PARTITION BY source), 0)) END AS share FROM lf),
le AS (SELECT *, round(coalesce(share / nullif(words, 0), 0), 9) AS expected FROM ls),
p AS (SELECT *, target - sum(floor(expected) * words) OVER (PARTITION BY source) AS missing FROM le),
u AS (
  SELECT g.doc_id, g.source, g.size, p.source_size, p.target, p.missing, p.expected, p.expected - floor(p.expected) AS part, (('0x' || substr(md5(g.doc_id::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE AS x
  FROM g JOIN p ON g.source IS NOT DISTINCT FROM p.source AND g.grade = p.grade),
r AS (SELECT *, CASE WHEN part > 0 AND size > 0 THEN (x / (1 - x)) / (part / (1 - part)) END AS q FROM u),
n AS (SELECT *, q IS NOT NULL AND sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q / (1 + q), doc_id) - size / 2 <= missing AS extra FROM r)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * (floor(expected) + extra::INT))::BIGINT AS taken FROM n
"""

#: The first document of each window of 13 words, and the words that no later window covers.
OP8 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS win FROM p),
f AS (SELECT win, min(doc_id) AS first FROM g GROUP BY win),
b AS (SELECT doc_id, list(i) AS starts FROM g JOIN f USING (win) WHERE doc_id > first GROUP BY doc_id),
c AS (SELECT DISTINCT doc_id, unnest(flatten(list_transform(starts, lambda s: range(s, s + 13)))) AS i FROM b),
q AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, d.w, unnest(range(1, len(d.w) + 1)) AS i FROM d JOIN q USING (doc_id)),
t AS (SELECT k.doc_id, array_agg(k.w[k.i] ORDER BY k.i) AS kept FROM k LEFT JOIN c ON c.doc_id = k.doc_id AND c.i = k.i WHERE c.i IS NULL GROUP BY k.doc_id),
o AS (SELECT d.doc_id, d.w, CASE WHEN q.doc_id IS NULL THEN d.w ELSE coalesce(t.kept, []) END AS kept FROM d LEFT JOIN q USING (doc_id) LEFT JOIN t ON t.doc_id = d.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM o
"""


#: Hits of three words, put together by diagonals.
OP9 = r"""
WITH t AS (SELECT * FROM (VALUES %s) v(template, words, label, phrase)),
tw AS (SELECT *, string_split(words, ' ') AS tw FROM t),
tg AS (SELECT template, label, phrase, len(tw) AS n, unnest(range(0, len(tw) - 2)) AS pos, tw FROM tw),
tk AS (SELECT template, label, phrase, n, pos, array_to_string(tw[pos + 1:pos + 3], ' ') AS gram FROM tg),
d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
dp AS (SELECT doc_id, unnest(range(0, len(w) - 2)) AS place, w FROM d),
dk AS (SELECT doc_id, place, array_to_string(w[place + 1:place + 3], ' ') AS gram FROM dp),
h AS (SELECT DISTINCT doc_id, template, label, phrase, n, place - pos AS diagonal, pos FROM dk JOIN tk USING (gram)),
g AS (SELECT DISTINCT doc_id, template, phrase, diagonal FROM h),
o AS (SELECT doc_id, template, diagonal, (phrase OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal), 3) > 2)::INT AS new FROM g),
c AS (SELECT doc_id, template, diagonal, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS grp FROM o),
m AS (
  SELECT doc_id, template, label, phrase, n, grp, min(diagonal) AS low, list(DISTINCT pos) AS votes FROM h JOIN c USING (doc_id, template, diagonal) GROUP BY ALL),
s AS (
  SELECT *, len(list_distinct(flatten(list_transform(votes, lambda a: [a, a + 1, a + 2])))) / n AS share FROM m
  WHERE len(votes) >= CASE WHEN phrase THEN n - 2 ELSE greatest(1, (n - 2) // 2) END),
v AS (SELECT *, greatest(low, 0) AS start FROM s WHERE share >= CASE WHEN phrase THEN 1 ELSE 0.8 END)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, count(*) FILTER (phrase)::BIGINT AS n_base, min(start) FILTER (phrase)::BIGINT AS first_word, max(start) FILTER (phrase)::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (phrase)), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS labels, coalesce(max(share), 0)::DOUBLE AS score
FROM d LEFT JOIN v USING (doc_id) GROUP BY d.doc_id, d.w
""" % ", ".join(f"({i}, '{' '.join(template_words(t))}', '{label}', {i < len(PHRASES)})" for i, (t, label) in enumerate([*PHRASES, *TEMPLATES]))

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _suffix_cases() -> str:
    """Labels of a suffix by the public suffix rules, exceptions first, then the longest."""
    rules = url_filter.SuffixRules.of(url_filter.SUFFIXES)
    is_one = lambda k, names: f"len(l) >= {k} AND array_to_string(l[greatest(1, len(l) - {k - 1}):], '.') IN ({', '.join(map(repr, names))})"
    cases = [f"WHEN {is_one(k, names)} THEN {k - 1}" for k, names in sorted(rules.excepted.items(), reverse=True)]
    for k in rules.lengths():
        cases += [f"WHEN {is_one(k, rules.plain[k])} THEN {k}"] if k in rules.plain else []
        cases += [f"WHEN len(l) >= {k} AND {is_one(k - 1, rules.wild[k - 1])} THEN {k}"] if k - 1 in rules.wild else []
    return " ".join(cases)


def _strength(rows: str, parent: str) -> str:
    """Strength of a level's prior from rows (n, bad, the parent's rate)."""
    chance, spread, more = f"sum({parent} * (1 - {parent}))", f"sum(n * pow(bad / n - {parent}, 2))", f"sum({parent} * (1 - {parent}) * (n - 1))"
    return f"(SELECT greatest(2.0, least(200.0, CASE WHEN {spread} > {chance} THEN {more} / ({spread} - {chance}) - 1 ELSE 200.0 END)) FROM {rows})"


#: Rules, longest first; elsewhere counts per host, domain and suffix, each shrunk toward the next. Exact for page_ids that don't repeat.
OP10 = rf"""
WITH pg AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {_LETTERS}), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
lb AS (SELECT doc_id, (quality = 0 OR toxic = 1)::INT AS bad FROM labels),
oc AS (SELECT host, bad FROM pg JOIN lb ON try_cast(nullif(regexp_extract(path, '^/[^/]*/(\d{{1,18}})', 1), '') AS BIGINT) = doc_id WHERE bad IS NOT NULL),
h0 AS (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '') AS own FROM pg),
h1 AS (SELECT *, string_split(own, '.') AS l, regexp_matches(own, '^(\d+\.){{3}}\d+$|^\[') AS address FROM h0),
h2 AS (SELECT *, CASE {_suffix_cases()} WHEN len(l) > 1 AND regexp_matches(l[len(l)], '^[a-z]{{2}}$') AND l[len(l) - 1] IN {url_filter.SECOND_LEVELS} THEN 2 ELSE 1 END AS k FROM h1),
lv AS (
  SELECT host, CASE WHEN address THEN own ELSE array_to_string(l[greatest(1, len(l) - k):], '.') END AS domain, CASE WHEN address THEN own ELSE array_to_string(l[greatest(1, len(l) - k + 1):], '.') END AS suffix FROM h2),
hn AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM oc JOIN lv USING (host) GROUP BY ALL),
dn AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hn GROUP BY ALL),
sn AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM dn GROUP BY ALL),
t AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS p0, sum(n) + 1 AS p0_n FROM sn),
s0 AS (SELECT * FROM sn, t), k1 AS (SELECT {_strength("s0", "p0")} AS k1),
s1 AS (SELECT suffix, (bad + k1 * p0) / (n + k1) AS p1, n + k1 AS p1_n FROM s0, k1),
d0 AS (SELECT dn.*, p1 FROM dn JOIN s1 USING (suffix)), k2 AS (SELECT {_strength("d0", "p1")} AS k2),
d1 AS (SELECT domain, suffix, (bad + k2 * p1) / (n + k2) AS p2, n + k2 AS p2_n FROM d0, k2),
g0 AS (SELECT hn.*, p2 FROM hn JOIN d1 USING (domain, suffix)), k3 AS (SELECT {_strength("g0", "p2")} AS k3),
g1 AS (SELECT host, (bad + k3 * p2) / (n + k3) AS p3, n + k3 AS p3_n FROM g0, k3),
a AS (
  SELECT host, coalesce(p3, p2, p1, p0) AS mean, CASE WHEN p3 IS NOT NULL THEN 1 - 1 / (p3_n + 1) WHEN p2 IS NOT NULL THEN (1 - 1 / (p2_n + 1)) * (1 - 1 / (k3 + 1))
    WHEN p1 IS NOT NULL THEN (1 - 1 / (p1_n + 1)) * (1 - 1 / (k2 + 1)) * (1 - 1 / (k3 + 1)) ELSE (1 - 1 / (p0_n + 1)) * (1 - 1 / (k1 + 1)) * (1 - 1 / (k2 + 1)) * (1 - 1 / (k3 + 1)) END AS known
  FROM lv LEFT JOIN g1 USING (host) LEFT JOIN d1 USING (domain, suffix) LEFT JOIN s1 USING (suffix), t, k1, k2, k3 WHERE host <> ''),
r AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) v(verdict, at_host, at_path)),
f AS (SELECT page_id, arg_max(at_host || at_path, length(at_host || at_path)) AS rule, arg_max(verdict, length(at_host || at_path)) AS verdict FROM pg JOIN r ON (host = at_host OR ends_with(host, '.' || at_host)) AND starts_with(path, at_path) GROUP BY page_id)
SELECT page_id, pg.host, path, f.rule, coalesce(f.verdict, CASE WHEN mean - 1.64 * sqrt(mean * (1 - mean) * (1 - known)) >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(mean, 9) AS bad_rate
FROM pg LEFT JOIN f USING (page_id) LEFT JOIN a ON a.host = pg.host
"""

#: All scores of each query.
OP11 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: Every group's share of every kept term, and all pairs of groups.
OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_LETTERS}), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 30),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(any_value(s.n), 0)::HUGEINT AS n FROM d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS uses, 1 + 1000000000 * (coalesce(c.n, 0) + 5) // (g.n + 5 * l.v) AS p, 1 + 1000000000 * (k.n + 5) // (l.n + 5 * l.v) AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
a AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
f AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(a.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE uses > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM f)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""

def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1, "op2_embedding_near_dedup": OP2, "op3_pareto_mixing": OP3, "op8_substring_dedup": OP8, "op9_license_scan": OP9, "op10_url_filter": OP10, "op11_exact_top_k": OP11, "op12_source_divergence": OP12}
