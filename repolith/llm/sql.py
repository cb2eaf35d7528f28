"""DuckDB SQL for those queries that SQL can express on whole tables."""

from __future__ import annotations

from repolith.llm import mixing

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

EXACT = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')) AS text_sha256 FROM documents),
r AS (SELECT doc_id, text_sha256, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
        row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept
      FROM d WINDOW w AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r
"""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
g AS (SELECT r, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
s AS (SELECT r, least(3, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 3)) AS step FROM p),
t AS (SELECT r, sum(step)::BIGINT AS n_repeat_words FROM s GROUP BY r),
f AS (SELECT d.r, doc_id, host, len(words)::BIGINT AS n_words,
        length(array_to_string(words, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len([l FOR l IN string_split(text, chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')])
         - len(list_distinct([l FOR l IN string_split(text, chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')])))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN t ON d.r = t.r),
x AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        n_symbols > 0.2::DOUBLE * word_chars OR n_dup_lines > 0.5::DOUBLE * n_words AS more FROM f),
h AS (SELECT host, count(*) AS n, sum((base_failed OR more)::INT)::DOUBLE AS x FROM x WHERE host IS NOT NULL GROUP BY host),
m AS (SELECT sum(x) / sum(n) AS m, var_pop(x / n) AS v, avg(1.0::DOUBLE / n) AS inverse FROM h),
k AS (SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * inverse, 1e-9) - 1, 10), 1e6) AS weight FROM m),
q AS (SELECT host, (x + m * weight) / (n + weight) AS host_rate FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(host_rate > 0.5, false) AS kept
FROM x LEFT JOIN q ON x.host = q.host
"""


def _case(column: str, targets: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in targets.items()) + " END"


def _names(targets: dict[str, float]) -> str:
    return ", ".join(f"'{k}'" for k in targets if k != "other")


def mixing_sql(table: str = "documents", rounds: int = 12, share: float = 0.25) -> str:
    """CTEs up to ``mixed``: the rows of ``table`` with their cell, words, probability and selection."""
    targets = {"source": mixing.SOURCES, "lang": mixing.LANGS, "topic": mixing.TOPICS}
    each = lambda form: ", ".join(form.format(m=m, target=_case(f"{m}_", targets[m])) for m in mixing.MARGINS)
    steps = []
    for i in range(rounds * 3):
        name = mixing.MARGINS[i % 3]
        steps.append(f"rake{i + 1} AS (SELECT * REPLACE (least(tokens, weight * part_{name} / sum(weight) OVER (PARTITION BY {name}_)) AS weight) FROM rake{i})")
    return rf"""counted AS (SELECT *, greatest(len({WORDS}), 1)::BIGINT AS tokens_ FROM {table}),
celled AS (SELECT *, CASE WHEN source IN ({_names(mixing.SOURCES)}) THEN source ELSE 'other' END AS source_,
  CASE WHEN lang IN ({_names(mixing.LANGS)}) THEN lang ELSE 'other' END AS lang_,
  CASE WHEN tokens_ < 100 THEN 'short'
       WHEN (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), ''))) * 40 >= tokens_ THEN 'lines' ELSE 'long' END AS topic_
  FROM counted),
cells AS (SELECT source_, lang_, topic_, sum(tokens_)::DOUBLE AS tokens FROM celled GROUP BY ALL),
aimed AS (SELECT *, sum(tokens) OVER () AS total, {each("{target} / count(*) OVER (PARTITION BY {m}_) AS raw_{m}")} FROM cells),
scaled AS (SELECT *, {each("raw_{m} / sum(raw_{m}) OVER () AS target_{m}, sum(tokens) OVER (PARTITION BY {m}_) AS held_{m}")} FROM aimed),
goals AS (SELECT *, {each("sum(target_{m}) OVER (PARTITION BY {m}_) AS goal_{m}")} FROM scaled),
ratios AS (SELECT *, {each("held_{m} / goal_{m} AS ratio_{m}")} FROM goals),
ups AS (SELECT *, {each("sum(tokens) OVER up_{m} AS tokens_{m}, sum(target_{m}) OVER up_{m} AS targets_{m}")} FROM ratios
  WINDOW {each("up_{m} AS (ORDER BY ratio_{m} RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")}),
carried AS (SELECT *, {each(f"min(CASE WHEN ratio_{{m}} >= {share!r}::DOUBLE * total THEN total - tokens_{{m}} + ratio_{{m}} * targets_{{m}} END) OVER () AS carried_{{m}}")} FROM ups),
budgeted AS (SELECT *, least(greatest(least({each("carried_{m}")}), {share!r}::DOUBLE * total), total) AS budget FROM carried),
rake0 AS (SELECT source_, lang_, topic_, tokens, tokens * budget / total AS weight,
  {each("least(held_{m}, max((budget - total + tokens_{m}) / targets_{m}) OVER () * goal_{m}) AS part_{m}")} FROM budgeted),
{", ".join(steps)},
ratio AS (SELECT source_, lang_, topic_, weight / tokens AS probability_ FROM rake{rounds * 3}),
mixed AS (SELECT celled.*, probability_, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < probability_ AS selected_
  FROM celled JOIN ratio USING (source_, lang_, topic_))"""


MIXING = f"""
WITH {mixing_sql()}
SELECT doc_id, source_ AS source, lang_ AS lang, topic_ AS topic, tokens_ AS n_words, round(probability_, 6) AS probability, selected_ AS selected FROM mixed
"""

NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 4 THEN array_to_string(w[i:i + 3], ' ') ELSE array_to_string(w, ' ') END AS g
      FROM d, unnest(range(1, greatest(len(w) - 2, 2))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reached)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

REPEATS = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM d, unnest(range(1, len(w) - 18)) x(i) WHERE len(w) >= 20),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS gone FROM k),
g AS (SELECT t.doc_id, t.i, word, coalesce(max(gone::INT) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS removed
      FROM t LEFT JOIN f ON f.doc_id = t.doc_id AND f.i = t.i),
h AS (SELECT doc_id, sum(removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (removed = 0) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN h ON h.doc_id = d.doc_id
"""

# crc32 by its definition: eight entries for a digit, as only the first of each carries the digit's bits.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(conv_id::VARCHAR, '')])), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"

TRIE = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, length(text) AS chars, md5(length(role) || ':' || role || ':' || text) AS key, turn FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS i FROM k),
c AS (SELECT conv_id, ({_CRC} % 6)::BIGINT AS h, conv_id - conv_id % 100 AS source FROM (SELECT DISTINCT conv_id FROM t)),
n AS (SELECT c.conv_id, 1 AS part, r.i, key, chars FROM c JOIN r ON r.conv_id = c.source AND r.i <= c.h
      UNION ALL SELECT c.conv_id, 2, r.i, key, chars FROM c JOIN r ON r.conv_id = c.conv_id AND r.i > c.h),
s AS (SELECT conv_id, row_number() OVER w AS depth, md5(string_agg(key, '') OVER w) AS node, chars FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY part, i ROWS UNBOUNDED PRECEDING)),
a AS (SELECT conv_id, depth, node, chars, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), '') AS parent, lead(node) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM s
      UNION ALL SELECT c.conv_id, 0, '', 0, NULL, NOT EXISTS (SELECT 1 FROM s WHERE s.conv_id = c.conv_id) FROM c),
g AS (SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM a GROUP BY node),
q AS (SELECT parent, count(*) AS n_children FROM g GROUP BY parent),
w AS (SELECT g.*, coalesce(n_children, 0)::BIGINT AS n_children, (n_convs - 1) * chars AS saved FROM g LEFT JOIN q ON q.parent = g.node),
-- A node's ancestors are those of its smallest member's path.
u AS (SELECT a.node, sum((w.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(w.saved)::BIGINT AS saved_tokens FROM w JOIN a ON a.conv_id = w.conv_id AND a.depth <= w.depth GROUP BY a.node)
SELECT w.conv_id, w.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM w JOIN u ON u.node = w.node LEFT JOIN g p ON p.node = w.parent
"""


def clusters_sql(k: int = 40, rounds: int = 5, components: int = 64, seed: int = 2) -> str:
    """Squared distances row by row, for every vector and centroid of each round."""
    near = lambda i: (
        f"d{i} AS (SELECT r, c, sum((v.x - m.x) * (v.x - m.x))::BIGINT AS distance FROM v JOIN m{i} m ON m.i = v.i GROUP BY r, c), "
        f"a{i} AS (SELECT r, arg_min((c, distance), (distance, c)) AS best FROM d{i} GROUP BY r), b{i} AS (SELECT r, best[1] AS c, best[2] AS distance FROM a{i})"
    )
    mean = lambda i: (
        f"m{i + 1} AS (SELECT m.c, m.i, coalesce(s.x, m.x) AS x FROM m{i} m LEFT JOIN "
        f"(SELECT c, i, floor(sum(x)::HUGEINT / count(*))::BIGINT AS x FROM v JOIN b{i} USING (r) GROUP BY c, i) s ON s.c = m.c AND s.i = m.i)"
    )
    steps = ", ".join(f"{near(i)}, {mean(i)}" for i in range(rounds))
    return f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings),
kept AS (SELECT r, vec_id, [floor(256 * x)::BIGINT FOR x IN e] AS v FROM e WHERE len(e) = {components} AND len([x FOR x IN e IF x IS NOT NULL AND isfinite(x)]) = {components}),
v AS (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept),
m0 AS (SELECT c - 1 AS c, i, x FROM (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), vec_id, v) AS c FROM kept) JOIN v USING (r) WHERE c <= {k}),
{steps}, {near(rounds)},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM m{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
FROM b{rounds} JOIN kept USING (r) JOIN h USING (c)
"""


ORACLES = {
    "op1_ngram_jaccard_join": NEAR, "op3_quality_rules": QUALITY, "op5_mixing": MIXING, "op7_substring_dedup": REPEATS, "op9_exact_dedup": EXACT,
    "op11_conversation_trie": TRIE, "op13_centroid_clusters": clusters_sql(),
}
