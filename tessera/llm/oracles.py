"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality_rules import DEFAULT_RULES, STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in sorted({f for w in STOP_WORDS for f in (w, w.capitalize())}))
_PASSES = " AND ".join(
    f"{r.measure} {'>=' if r.fails == 'below' else '<='} {r.threshold}" for r in DEFAULT_RULES
)

QUALITY_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, (w[i], w[i + 1], w[i + 2]) AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words,
         len(lines) AS n_lines, len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop_words
  FROM d LEFT JOIN covered USING (doc_id)),
x AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbols_per_word,
         n_stop_words / greatest(n_words, 1) AS stop_word_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_PASSES} AS kept, n_lines, n_stop_words
FROM x
"""

SNAPSHOT_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM t GROUP BY conv_id),
w AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_logged FROM c GROUP BY turns),
p AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM c)),
kept AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turns = w.turns)),
rows AS (SELECT conv_id, n_logged, turns, unnest(range(1, len(turns) + 1)) AS position FROM kept)
SELECT conv_id, (position - 1) // 64 AS piece, (len(turns) + 63) // 64 AS n_pieces, len(turns) AS n_turns, n_logged,
       string_agg('<|im_start|>' || turns[position].role || chr(10) || turns[position].text || '<|im_end|>' || chr(10), '' ORDER BY position) AS rendered
FROM rows GROUP BY ALL
"""

_TERMS = r"""list_filter(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

MAXSCORE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, s GROUP BY term, n_docs),
p AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS impact
  FROM tf JOIN w USING (term), s),
x AS (SELECT item_id, r, doc_id, sum(impact)::BIGINT AS score FROM q JOIN p USING (term) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 50
"""

PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (
  SELECT lang, r, unnest(w) AS w, generate_subscripts(w, 1) AS i
  FROM (SELECT lang, row_number() OVER () AS r, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces)),
v AS (SELECT lang, w AS x, lead(w) OVER o AS y, lead(w, 2) OVER o AS z FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
f AS MATERIALIZED (
  SELECT lang, [x] AS g, count(*) AS f FROM v GROUP BY ALL
  UNION ALL SELECT lang, [x, y], count(*) FROM v WHERE y IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, [x, y, z], count(*) FROM v WHERE z IS NOT NULL GROUP BY ALL),
t AS (SELECT concat(lang, chr(10), array_to_string(g, ' ')) AS p, f FROM f),
n AS (SELECT lang, count(*) AS n FROM v GROUP BY lang),
c AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1 AND f >= 10),
gone AS (
  SELECT lang, s AS g, max(a) AS longest FROM (SELECT lang, a, unnest([g[1:2], g[2:3]]) AS s FROM c WHERE len(g) = 3) GROUP BY ALL),
cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM c),
scored AS (
  SELECT cuts.lang, cuts.g, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts
  JOIN t AS x ON x.p = concat(cuts.lang, chr(10), array_to_string(cuts.g[1:k], ' '))
  JOIN t AS y ON y.p = concat(cuts.lang, chr(10), array_to_string(cuts.g[k + 1:], ' '))),
best AS (SELECT lang, g, a, unnest(min_by({'l': l, 'r': r, 'score': score}, (score, k))) FROM scored GROUP BY lang, g, a),
kept AS (
  SELECT best.lang, array_to_string(best.g, ' ') AS phrase, a, l, r, score::BIGINT AS score
  FROM best LEFT JOIN gone ON gone.lang = best.lang AND gone.g = best.g WHERE longest IS NULL OR 100 * longest < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""

ORACLES: dict[str, str] = {"op11_suffix_phrases": PHRASES_SQL, "op13_maxscore": MAXSCORE_SQL, "op4_snapshot_collapse": SNAPSHOT_SQL, "op9_quality_rules": QUALITY_SQL}
