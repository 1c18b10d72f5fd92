"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from .mixing import TARGETS
from .quality import RULES, STOP_WORDS

WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORDS}') AS w FROM documents),
b AS (SELECT cast(item_id AS varchar) AS i, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORDS}') AS w FROM benchmark),
bw AS (SELECT DISTINCT i, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT i, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n)),
h AS (SELECT r, dw.n, s, i FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
p AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT i) AS n_items, string_agg(DISTINCT i, ',' ORDER BY i) AS items FROM h GROUP BY r)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""

_BARE = "translate({}, ' \t\n\x0b\x0c\r', '')"
_RATIOS = {"mean_word_chars": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "word_chars"), "stop_ratio": ("n_stop", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"), "ellipsis_line_ratio": ("n_ellipsis", "n_lines"), "bullet_line_ratio": ("n_bullet", "n_lines")}


def _measure(m: str) -> str:
    return f"CASE WHEN {_RATIOS[m][1]} > 0 THEN {_RATIOS[m][0]} / {_RATIOS[m][1]} ELSE 0 END" if m in _RATIOS else m


OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
       list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT r, s, hash(w[s], w[s + 1], w[s + 2]) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS s FROM d)),
f AS (SELECT r, s FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
q AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + 3)) AS p FROM f) GROUP BY r),
m AS (SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(length(array_to_string(w, '')) AS bigint) AS word_chars,
       cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols, cast(len(l) AS bigint) AS n_lines, cast(len(l) - len(list_distinct(l)) AS bigint) AS n_dup_lines,
       coalesce(q.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) AS n_stop,
       len(list_filter(l, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS n_ellipsis, len(list_filter(l, lambda x: ltrim(x) LIKE '- %' OR ltrim(x) LIKE '* %' OR ltrim(x) LIKE '•%')) AS n_bullet
       FROM d LEFT JOIN q USING (r)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(f"{_measure(m)} {s} {b}" for m, s, b in RULES)} AS kept
FROM v
"""

OP9 = f"""
WITH w(s, w) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in sorted(TARGETS.items()))}),
n AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
x AS (SELECT n.s, n.n, w.w, sum(n.n) OVER () AS total, count(*) FILTER (w.w IS NULL) OVER () AS others, coalesce(sum(w.w) OVER (), 0) AS given FROM n LEFT JOIN w ON n.s = w.s),
y AS (SELECT s, n, total, coalesce(w, greatest(0, 1 - given) / others) / (given + CASE WHEN others > 0 THEN greatest(0, 1 - given) ELSE 0 END) * total / n AS rate FROM x),
k AS (SELECT s, rate, unnest(range(0, cast(ceil(rate + 10 * sqrt(rate) + 25) AS bigint) + 1)) AS k FROM y),
p AS (SELECT s, k, sum(CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - lgamma(k + 1)) WHEN k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY k) AS c FROM k),
c AS (SELECT s, list(c ORDER BY k) AS cdf FROM p GROUP BY s),
u AS (SELECT doc_id, source, cdf, (cast('0x' || substr(md5('42:' || coalesce(cast(doc_id AS varchar), 'null') || ':' || coalesce(source, '')), 1, 13) AS bigint) + 0.5) / 4503599627370496 AS u
      FROM documents JOIN c ON coalesce(source, '') = s),
e AS (SELECT doc_id, source, cast(len(list_filter(cdf, lambda x: x < u)) AS bigint) AS n_copies FROM u)
SELECT doc_id, source, n_copies, copy, substr(md5('mix42:' || coalesce(cast(doc_id AS varchar), 'null') || ':' || copy), 1, 16) AS mix_key
FROM (SELECT *, unnest(range(0, n_copies)) AS copy FROM e WHERE n_copies > 0)
"""


OP11 = f"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
      FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, n AS k, w[s:s + n - 1] AS g FROM (SELECT lang, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM p, (VALUES (1), (2), (3)) AS t(n) WHERE len(w) >= n)),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, f AS a FROM f WHERE k > 1 AND f >= 10),
m AS (SELECT lang, g, max(a) AS longer FROM (SELECT lang, g[1:2] AS g, a FROM c WHERE k = 3 UNION ALL SELECT lang, g[2:3], a FROM c WHERE k = 3) GROUP BY ALL),
s AS (SELECT lang, k, g, a, unnest(range(1, k)) AS cut FROM c LEFT JOIN m USING (lang, g) WHERE longer IS NULL OR 100 * longer < 50 * a),
t AS (SELECT s.lang, s.g, a, cut, x.f AS l, y.f AS r, 1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS score
      FROM s JOIN f AS x ON x.lang = s.lang AND x.g = s.g[1:cut] JOIN f AS y ON y.lang = s.lang AND y.g = s.g[cut + 1:s.k]),
b AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, cast(score AS bigint) AS score FROM t QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1)
SELECT lang, rank, phrase, a, l, r, cast(n AS bigint) AS n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b) JOIN n USING (lang) WHERE rank <= 2000
"""

_NEAR = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _op12(k: int = 16, rounds: int = 3, dim: int = 64) -> str:
    """Each round: all distances, the nearest, then means, an empty centroid as it was."""
    out = [f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: cast(floor({dim} * cast(x AS double)) AS hugeint)) AS v, embedding AS e FROM embeddings
     WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
     f"c0 AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(cast(vec_id AS varchar), 'null')), e) - 1 AS i, v FROM v) WHERE i < {k})"]
    for n in range(rounds + 1):
        out.append(f"a{n} AS (SELECT r, arg_min(i, (d, i)) AS i, min(d) AS d FROM (SELECT v.r, c.i, {_NEAR} AS d FROM v, c{n} AS c) GROUP BY r)")
        if n < rounds:
            mean = "(s - (s % n + n) % n) // n"
            out.append(f"m{n} AS (SELECT i, list({mean} ORDER BY p) AS v FROM (SELECT i, p, sum(x) AS s, count(*) AS n FROM (SELECT a.i, unnest(v.v) AS x, unnest(range({dim})) AS p FROM v JOIN a{n} AS a USING (r)) GROUP BY i, p) GROUP BY i)")
            out.append(f"c{n + 1} AS (SELECT c.i, coalesce(m.v, c.v) AS v FROM c{n} AS c LEFT JOIN m{n} AS m USING (i))")
    return f"""
WITH {", ".join(out)}
SELECT vec_id, cast(a.i AS int) AS cluster, cast(d AS bigint) AS distance, cast(sum(d) OVER (PARTITION BY a.i) AS bigint) AS cluster_inertia,
       cast(sum(d) OVER () AS bigint) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM v JOIN a{rounds} AS a USING (r) JOIN c{rounds} AS c ON a.i = c.i
"""


OP12 = _op12()


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": OP4, "op6_quality_rules": OP6, "op9_poisson_mix": OP9, "op11_collocations": OP11, "op12_drake_clusters": OP12}
