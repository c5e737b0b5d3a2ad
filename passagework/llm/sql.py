"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from passagework.llm.lines import SITES
from passagework.llm.quality import BASE_RULES, METHOD_RULES, STOP_WORDS, SYMBOLS, Rule

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

TOOL_LINKS = """
WITH asked AS (
  SELECT conv_id, 'call-' || turn AS call_id, turn, coalesce(text, '') AS body, turn % 3 AS kind,
         turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island
  FROM conversations WHERE role = 'user'
), calls AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS depth,
    CASE kind WHEN 0 THEN 'search' WHEN 1 THEN 'summarise' ELSE 'translate' END AS tool,
    CASE kind
      WHEN 0 THEN '{"limit":' || (length(body) % 10) || ',"query":' || to_json(body)::VARCHAR || '}'
      WHEN 1 THEN '{"style":"' || CASE WHEN length(body) < 200 THEN 'short' ELSE 'full' END || '","text":' || to_json(body)::VARCHAR || '}'
      ELSE '{"text":' || to_json(body)::VARCHAR || ',"to":"en"}' END AS arguments,
    CASE kind
      WHEN 0 THEN concat_ws('; ', CASE WHEN length(body) % 10 > 8 THEN 'limit: above 8' END, CASE WHEN length(body) > 400 THEN 'query: above 400' END)
      WHEN 1 THEN CASE WHEN length(body) < 200 THEN '' ELSE 'style: not allowed' END
      ELSE '' END AS problems
  FROM asked
), results AS (
  SELECT conv_id, 'call-' || (turn - 1) AS call_id, turn, text FROM conversations WHERE role = 'assistant'
)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.tool, coalesce(c.turn, r.turn) AS turn, c.depth,
  CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS state,
  CASE WHEN c.call_id IS NULL THEN 0 ELSE 1 END::BIGINT AS n_calls, CASE WHEN r.call_id IS NULL THEN 0 ELSE 1 END::BIGINT AS n_results,
  coalesce(c.problems, '') AS problems,
  '{"arguments":' || coalesce(c.arguments, 'null') || ',"id":' || to_json(coalesce(c.call_id, r.call_id))::VARCHAR
    || ',"result":' || coalesce(to_json(r.text)::VARCHAR, 'null') || ',"tool":' || coalesce(to_json(c.tool)::VARCHAR, 'null') || '}' AS json
FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
"""

SITE_SPREAD = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS body FROM documents),
split AS (SELECT r, source, string_split(body, chr(10)) AS parts FROM docs),
rows AS (SELECT r, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM split),
named AS (SELECT *, trim(line, {BLANKS}) AS bare FROM rows),
common AS (SELECT bare FROM named WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT coalesce('s' || source, '')) >= {SITES})
SELECT d.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.bare IS NOT NULL) AS n_removed,
  sha256(coalesce(string_agg(n.line, chr(10) ORDER BY n.i) FILTER (WHERE c.bare IS NULL), '')) AS kept_sha256
FROM docs d JOIN named n ON d.r = n.r LEFT JOIN common c ON c.bare = n.bare
GROUP BY d.r, d.doc_id
"""


def _failed(rule: Rule) -> str:
    scale = rule.per or "1"
    tests = []
    if rule.low is not None:
        tests.append(f"{rule.metric} < {scale} * {rule.low}::DOUBLE")
    if rule.high is not None:
        tests.append(f"{rule.metric} > {scale} * {rule.high}::DOUBLE")
    return f"CASE WHEN ({' OR '.join(tests)}) AND n_words >= {rule.from_words} THEN '{rule.name}' END"


def _only(characters: str) -> str:
    return f"length(regexp_replace(body, '[^{characters}]+', '', 'g'))"


QUALITY_RULES = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body,
    [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS words,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF trim(x, {BLANKS}) <> ''] AS lines
  FROM documents
), windows AS (
  SELECT r, unnest(range(1, len(words) - 3)) AS p, unnest([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]) AS win
  FROM docs WHERE len(words) >= 5
), twice AS (SELECT r, p FROM windows QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
covered AS (SELECT r, count(DISTINCT w) AS n FROM (SELECT r, unnest(range(p, p + 5)) AS w FROM twice) GROUP BY r),
counts AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(body) - {_only(" \\x09-\\x0D")} AS word_chars, {_only(SYMBOLS)} AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
    {_only("A-Z")} AS n_upper, {_only("\\p{L}")} AS n_letters, {_only("!?")} AS n_marks,
    len([x FOR x IN words IF lower(x) IN ({", ".join(f"'{w}'" for w in STOP_WORDS)})]) AS n_stop_words,
    len([x FOR x IN lines IF substring(trim(x, {BLANKS}), 1, 1) IN ('-', '*', '•', '‣')]) AS n_bullet_lines,
    len([x FOR x IN lines IF rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…']) AS n_ellipsis_lines
  FROM docs LEFT JOIN covered USING (r)
), named AS (
  SELECT *, concat_ws(',', {", ".join(_failed(r) for r in BASE_RULES + METHOD_RULES)}) AS failed,
    concat_ws(',', {", ".join(_failed(r) for r in BASE_RULES)}) <> '' AS base_failed
  FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed = '' AS kept, failed FROM named
"""

EXACT_DEDUP = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST, r) = 1 AS kept, sha256(body) AS text_sha256
FROM docs
"""

COLLOCATIONS = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM split GROUP BY lang),
places AS (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM split, (SELECT unnest([1, 2, 3]) AS size) WHERE len(ws) >= size),
counts AS (SELECT lang, size, ws[i:i + size - 1] AS phrase, count(*) AS f FROM places GROUP BY ALL),
cuts AS (
  SELECT lang, size, phrase, f AS a, unnest(range(1, size)) AS k FROM counts WHERE size > 1 AND f >= 10
), parts AS (
  SELECT c.*, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.phrase[1:k] JOIN counts r ON r.lang = c.lang AND r.phrase = c.phrase[k + 1:]
), best AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, inner_phrase, max(a) AS a
  FROM (SELECT lang, unnest([phrase[1:2], phrase[2:3]]) AS inner_phrase, a FROM best WHERE size = 3) GROUP BY ALL
), kept AS (
  SELECT b.lang, array_to_string(b.phrase, ' ') AS phrase, b.a, l, r, score::BIGINT AS score
  FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.inner_phrase = b.phrase WHERE g.a IS NULL OR 100 * g.a < 50 * b.a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op1_tool_links": TOOL_LINKS,
    "op2_site_spread": SITE_SPREAD,
    "op5_quality_rules": QUALITY_RULES,
    "op11_collocations": COLLOCATIONS,
    "op12_exact_dedup": EXACT_DEDUP,
}
