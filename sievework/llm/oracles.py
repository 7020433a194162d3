"""DuckDB's SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

from .laws import hypergeometric_sql
from .mixing import PRIME

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a), c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN n ON a = id
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, i, hash(list_slice(w, i, i + 34)) AS h1, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h2 FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
g AS (SELECT h1, h2 FROM s GROUP BY ALL HAVING count(*) > 1), c AS (SELECT DISTINCT doc_id, i + o AS p FROM s JOIN g USING (h1, h2), generate_series(0, 34) t(o)),
x AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY 1),
p AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d)),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.i = c.p GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0000000000"

QUALITY = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
q AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM g JOIN (SELECT doc_id, x FROM g GROUP BY ALL HAVING count(*) > 1) USING (doc_id, x), generate_series(0, 2) s(o) GROUP BY 1),
l AS (SELECT doc_id, source, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM d)),
f AS (SELECT doc_id, source, line, translate(array_to_string(lw, ' '), '{_UPPER}', '{_LOWER}') AS nl, len(lw) AS n FROM l WHERE len(lw) > 0),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM f GROUP BY 1),
a AS (SELECT source, nl FROM (SELECT source, nl, count(DISTINCT doc_id) AS n FROM f GROUP BY ALL) JOIN (SELECT source, count(*) AS docs FROM documents GROUP BY 1) USING (source) WHERE n > 20 AND n > 0.002 * docs),
r AS (SELECT doc_id, sum(n)::BIGINT AS n_removed FROM f JOIN a USING (source, nl) GROUP BY 1),
m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed, 0) AS n_removed
  FROM d LEFT JOIN q USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed <= 0.5 * n_words AS kept FROM m
"""


def _poly(i: int) -> str:
    x, y, z = (f"(concat('0x', h[{13 + 8 * j}:{20 + 8 * j}])::BIGINT % {PRIME})" for j in range(i, i + 3))
    return f"((({x} * b + {y}) % {PRIME} * b + {z}) % {PRIME})"


def mixing(depth: int = 8, block: int = 16) -> str:
    """The splitting tree as a chain of common tables, a level each, and each shard's blocks in their permuted order."""
    none = "'(none)'"
    levels = ["n0 AS (SELECT source, 0::BIGINT AS node, quota FROM plan)"]
    for level in range(depth):
        step = 1 << (depth - level - 1)
        drawn = hypergeometric_sql("n", "l", "quota", f"concat_ws('|', 'mix', coalesce(source, {none}), {level}, node)")
        levels.append(
            f"""i{level} AS (SELECT source, shard // {2 * step} AS node, sum(blocks)::BIGINT AS n, sum(CASE WHEN (shard // {step}) % 2 = 0 THEN blocks ELSE 0 END)::BIGINT AS l FROM leaves GROUP BY ALL),
b{level} AS MATERIALIZED (SELECT a.source, a.node, quota, CASE WHEN n > 0 THEN {drawn.replace('source', 'a.source').replace(', node)', ', a.node)')} ELSE 0 END AS drawn FROM n{level} a JOIN i{level} b ON a.source IS NOT DISTINCT FROM b.source AND a.node = b.node),
n{level + 1} AS (SELECT source, 2 * node AS node, drawn AS quota FROM b{level} UNION ALL SELECT source, 2 * node + 1, quota - drawn FROM b{level})"""
        )
    return f"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, sha256(concat_ws('|', coalesce(doc_id::VARCHAR, {none}), coalesce(source, {none}), coalesce(text, {none}))) AS h FROM documents),
r AS MATERIALIZED (SELECT *, concat('0x', h[1:12])::BIGINT % {1 << depth} AS shard, ceil(size / {block})::BIGINT AS blocks FROM d),
leaves AS MATERIALIZED (SELECT source, shard, sum(blocks)::BIGINT AS blocks FROM r GROUP BY ALL),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(blocks)::BIGINT AS n FROM r GROUP BY 1),
k AS (SELECT *, [3.0, 1.0, 2.0][1 + (i % 3)]::DOUBLE AS w, 2.0 * source_size AS cap FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s)),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, i) AS j, coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb, coalesce(sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb FROM k),
e AS (SELECT *, (1.5 * (SELECT sum(source_size) FROM s)::DOUBLE - cb) / ((SELECT sum(w) FROM k) - wb) AS level FROM o),
t AS (SELECT source, source_size, n, least(cap, coalesce((SELECT min_by(level, j) FROM e WHERE level * w <= cap) * w, cap))::DOUBLE AS target FROM e),
plan AS MATERIALIZED (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes, CASE WHEN source_size > 0 THEN floor(n * (target - floor(target / source_size) * source_size) / source_size + 0.5) ELSE 0 END::BIGINT AS quota FROM t),
{','.join(levels)},
x AS (SELECT doc_id, h, source, shard, size, b, row_number() OVER (PARTITION BY source, shard ORDER BY {_poly(0)} * {PRIME} + {_poly(3)}, doc_id, b) AS k
  FROM (SELECT *, unnest(generate_series(0, blocks - 1)) AS b FROM r WHERE size > 0)),
p AS (SELECT doc_id, h, sum(least({block}, size - b * {block}))::BIGINT AS words FROM x JOIN n{depth} q ON x.source IS NOT DISTINCT FROM q.source AND x.shard = q.node WHERE k <= q.quota GROUP BY ALL)
SELECT r.doc_id, size, plan.source_size, target, (passes * size + coalesce(words, 0))::BIGINT AS taken, shard FROM r JOIN plan ON r.source IS NOT DISTINCT FROM plan.source LEFT JOIN p ON r.doc_id = p.doc_id AND r.h = p.h
"""
