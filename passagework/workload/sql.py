"""SQL twins of the registered queries, for DuckDB over the same tables.

Written against the definitions, not against the Spark code: chunks and words are
built with list functions, scores with the plain formula.
"""

from __future__ import annotations

from passagework.functions.text import FOLD_FROM, FOLD_TO
from passagework.workload.tables import FIRST_HOUR, KANA_FROM, KANA_TO

ORACLES: dict[str, str] = {}

CJK = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}"
INK = r"[^\s\x0B\x{85}\p{Z}]"
KANA = f"CASE WHEN lang = 'es' THEN translate(text, '{KANA_FROM}', '{KANA_TO}') ELSE text END"
ASCII_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXT = """CASE WHEN source = 'src7' THEN '.png' WHEN source = 'src13' THEN ''
 WHEN lang = 'en' THEN '.md' WHEN lang = 'fr' THEN '.txt' WHEN lang = 'de' THEN '.html' ELSE '.py' END"""


def files(content: str = "text") -> str:
    return f"""files AS (
 SELECT doc_id AS file_id, source || '/' || lang || '/' || doc_id || {EXT} AS path,
  doc_id || {EXT} AS filename, nullif({EXT}, '') AS extension, strlen(text) AS size_bytes,
  CAST({FIRST_HOUR} + doc_id * 3600 AS DOUBLE) AS modified,
  CASE {EXT} WHEN '.md' THEN 'Markdown' WHEN '.html' THEN 'HTML' WHEN '.py' THEN 'Python' END AS lang,
  lang AS tag1, source AS tag2, {content} AS content
 FROM documents)"""


def cut(source: str = "files", size: int = 30, step: int = 20, key: str = "file_id", blank: bool = False) -> str:
    number = "w" if blank else f"row_number() OVER (PARTITION BY {key} ORDER BY w) - 1"
    return f"""lines AS (SELECT {key}, string_split(content, chr(10)) AS l FROM {source}),
 wins AS (SELECT {key}, l, unnest(range(0, CASE WHEN len(l) <= {size} THEN 1
   ELSE 1 + CAST(ceil((len(l) - {size}) / {step}.0) AS BIGINT) END)) AS w FROM lines),
 texts AS (SELECT {key}, w, array_to_string(l[w * {step} + 1 : w * {step} + {size}], chr(10)) AS content FROM wins),
 chunks AS (SELECT {key}, CAST({number} AS BIGINT) AS chunk_no, content FROM texts
  WHERE regexp_matches(content, '{INK}'))"""


WORDS = f"""words AS (SELECT file_id, chunk_no, regexp_extract_all(translate(lower(content), '{FOLD_FROM}', '{FOLD_TO}'),
  '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS t FROM chunks),
 occ AS (SELECT file_id, chunk_no, len(t) AS dl, unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM words)"""

GRAMS = """folded AS (SELECT file_id, chunk_no, string_split(lower(content), '') AS ch FROM chunks),
 grams AS (SELECT file_id, chunk_no, len(ch) - 2 AS dl, unnest(range(0, len(ch) - 2)) AS pos,
   unnest(ch[1 : len(ch) - 2]) AS a, unnest(ch[2 : len(ch) - 1]) AS b, unnest(ch[3 : len(ch)]) AS c
  FROM folded WHERE len(ch) > 2),
 gocc AS (SELECT file_id, chunk_no, dl, pos, a || b || c AS term FROM grams)"""

CHUNKS = f"WITH {files()}, {cut()}"
OCC = f"{CHUNKS}, {WORDS}"

# Words of the benchmark texts, one clause each.
UNITS = f"""units AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS query_id,
  unnest(regexp_extract_all(translate(lower(text), '{FOLD_FROM}', '{FOLD_TO}'), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')) AS term
 FROM benchmark)"""

# Relevance of rows (query_id, clause, file_id, chunk_no, dl, tf) in `hits`.
def scored(total: str = "words", length: str = "len(t)") -> str:
    return f"""corpus AS (SELECT count(*) AS n, avg({length}) AS mean FROM {total}),
 freq AS (SELECT query_id, clause, count(*) AS df FROM hits GROUP BY ALL),
 scored AS (SELECT query_id, clause, file_id, chunk_no,
   (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END)
   * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS score
  FROM hits JOIN freq USING (query_id, clause), corpus)"""


BENCH_HITS = f"""{OCC}, {UNITS},
 hits AS (SELECT query_id, term AS clause, file_id, chunk_no, dl, count(*) AS tf
  FROM occ JOIN units USING (term) GROUP BY ALL),
 {scored()},
 found AS (SELECT query_id, file_id, chunk_no, round(sum(score), 6) AS score FROM scored GROUP BY ALL)"""

BEST = "SELECT *, row_number() OVER (PARTITION BY query_id, file_id ORDER BY score DESC, chunk_no) AS place FROM {}"
RANK = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id, chunk_no) AS BIGINT) AS rank"


def top_files(hits: str, k: int) -> str:
    return f"top AS (SELECT *, {RANK} FROM ({BEST.format(hits)}) WHERE place = 1 QUALIFY rank <= {k})"


# Sources, metadata, filters

ORACLES["scan_text"] = "SELECT doc_id, text, strlen(text) AS n_bytes FROM documents"
ORACLES["file_meta"] = f"""WITH {files()} SELECT file_id, path, filename, extension, size_bytes, modified, lang,
 CAST(NULL AS VARCHAR) AS title, '["' || tag1 || '","' || tag2 || '"]' AS tags, CAST(1735689600 AS DOUBLE) AS indexed_at
 FROM files"""
ORACLES["file_tags"] = f"WITH {files()} SELECT file_id, tag1 AS tag FROM files UNION SELECT file_id, tag2 FROM files"
ORACLES["file_lang"] = f"WITH {files()} SELECT file_id, extension, lang FROM files"
ORACLES["filter_text_ext"] = f"""WITH {files()}
 SELECT file_id, path, extension, 'default' AS list FROM files WHERE extension IN ('.md', '.txt', '.html', '.py')
 UNION ALL SELECT file_id, path, extension, 'override' FROM files WHERE extension IN ('.html', '.py')"""
ORACLES["filter_size"] = f"""WITH {files()}
 SELECT file_id, size_bytes, 'default' AS bound FROM files WHERE size_bytes BETWEEN 1 AND 524288
 UNION ALL SELECT file_id, size_bytes, 'small' FROM files WHERE size_bytes BETWEEN 1 AND 4096"""

PAGES = """pages2 AS (SELECT page_id, replace(replace(regexp_replace(url, '^https?://', ''),
  '/fr/', '/node_modules/'), '/es/', '/dist/') AS path FROM pages)"""
ORACLES["filter_ignore"] = f"""WITH {PAGES},
 parts AS (SELECT page_id, path, string_split(path, '/') AS p FROM pages2),
 steps AS (SELECT page_id, path, unnest(range(1, len(p) + 1)) AS n, p FROM parts),
 judged AS (SELECT page_id, path, array_to_string(p[1:n], '/') AS node, n, len(p) AS deep, p FROM steps),
 own AS (SELECT page_id, CASE
   WHEN regexp_matches(node, '(^|/)[^/]*ther[^/]*(/.*)?$') THEN false
   WHEN regexp_matches(node, '^m\\.[^/]*/en(/.+)$') OR (node LIKE 'm.%' AND regexp_matches(node, '^m\\.[^/]*/en$') AND n < deep) THEN true
   WHEN regexp_matches(node, '^blog\\.[^/]*$') OR regexp_matches(node, '^blog\\.[^/]*/') THEN true
   WHEN regexp_matches(node, '(^|/)[^/]*\\.html(/.*)?$') THEN true ELSE false END AS gone FROM judged)
 SELECT page_id, '/site/' || path AS path FROM pages2
 WHERE NOT list_has_any(string_split(path, '/'), ['.git', 'node_modules', '.venv', '__pycache__', '.cache', 'dist', '.next', '.nuxt'])
  AND page_id NOT IN (SELECT page_id FROM own WHERE gone)"""
ORACLES["filter_substring"] = f"""WITH {PAGES} SELECT page_id, path FROM pages2
 WHERE NOT contains(left(path, length(path) - strpos(reverse(path), '/')), 'spam-farm')
  AND NOT contains(left(path, length(path) - strpos(reverse(path), '/')), 'node_modules')"""
ORACLES["meta_search"] = f"""WITH {files()} SELECT path, size_bytes, modified, lang FROM files
 WHERE extension = '.md' AND lang = 'Markdown' AND contains(filename, '1') AND modified > epoch(TIMESTAMP '2024-01-02')
 ORDER BY modified DESC, path LIMIT 30"""
ORACLES["recent_files"] = f"""WITH {files()} SELECT path, size_bytes, modified, lang FROM files
 WHERE modified > epoch(TIMESTAMP '2024-01-22') ORDER BY modified DESC, path LIMIT 30"""
ORACLES["largest_files"] = f"""WITH {files()} SELECT path, size_bytes, modified, lang FROM files
 ORDER BY size_bytes DESC, path LIMIT 20"""
ORACLES["frontmatter"] = f"""SELECT doc_id AS file_id,
 CASE WHEN {EXT} <> '.md' THEN NULL WHEN lang = 'en' THEN source END AS title,
 CASE WHEN {EXT} <> '.md' THEN NULL WHEN lang = 'en' THEN '["en","' || source || '"]' END AS tags FROM documents"""

# The Spanish block is not closed; should the text close it by chance, prose is no mapping, so all of it stays.
FRONT = """CASE lang WHEN 'en' THEN chr(10) || text WHEN 'fr' THEN chr(10) || text WHEN 'de' THEN chr(10) || text
 ELSE '---' || chr(10) || 'title: ' || source || chr(10) || text END"""
ORACLES["frontmatter_body"] = f"""WITH bodies AS (SELECT doc_id AS file_id, {FRONT} AS content FROM documents),
 {cut("bodies")} SELECT file_id, chunk_no, md5(content) AS digest FROM chunks"""

# Chunks, tokens, postings

ORACLES["chunk_lines"] = f"{CHUNKS} SELECT file_id, chunk_no, content FROM chunks"
ORACLES["chunk_small"] = f"WITH {files()}, {cut(size=9, step=6)} SELECT file_id, chunk_no, content FROM chunks"
ORACLES["chunk_plain"] = f"WITH {files()}, {cut(size=50, step=50, blank=True)} SELECT file_id, chunk_no, content FROM chunks"
ORACLES["chunk_turns"] = f"""WITH turns AS (SELECT conv_id, turn, text AS content FROM conversations),
 {cut("turns", 5, 3, "conv_id, turn")} SELECT conv_id, turn, chunk_no, content FROM chunks"""
ORACLES["tokens_word"] = f"{OCC} SELECT file_id, chunk_no, CAST(pos AS BIGINT) AS pos, term FROM occ"
ORACLES["tokens_tri"] = f"""{CHUNKS}, {GRAMS} SELECT term, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos,
 CAST(max(dl) AS BIGINT) AS max_dl FROM gocc GROUP BY term"""
ORACLES["postings_word"] = f"""{OCC} SELECT term, file_id, chunk_no, CAST(dl AS BIGINT) AS dl, count(*) AS tf,
 string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM occ GROUP BY term, file_id, chunk_no, dl"""
ORACLES["postings_tri"] = f"""{CHUNKS}, {GRAMS},
 post AS (SELECT term, file_id, chunk_no, count(*) AS tf, min(pos) AS first, max(pos) AS last FROM gocc GROUP BY ALL)
 SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, CAST(max(tf) AS BIGINT) AS max_tf,
 CAST(sum(first) AS BIGINT) AS sum_first, CAST(sum(last) AS BIGINT) AS sum_last FROM post GROUP BY term"""
ORACLES["corpus_stats"] = f"""{CHUNKS}, {WORDS},
 sized AS (SELECT len(t) AS w, greatest(length(content) - 2, 0) AS g FROM words JOIN chunks USING (file_id, chunk_no))
 SELECT count(*) AS n_chunks, CAST(sum(w) AS BIGINT) AS total_words, CAST(sum(g) AS BIGINT) AS total_grams,
 round(avg(w), 6) AS avg_words, round(avg(g), 6) AS avg_grams FROM sized"""
ORACLES["term_stats"] = f"""{OCC} SELECT term, count(DISTINCT (file_id, chunk_no)) AS df, count(*) AS cf FROM occ GROUP BY term"""
ORACLES["cjk_profile"] = f"""WITH t AS (SELECT doc_id, {KANA} AS c FROM documents),
 k AS (SELECT doc_id, unnest(regexp_split_to_array(c, '[\\s\\x0B\\x{{85}}\\p{{Z}}]+')) AS w FROM t),
 s AS (SELECT doc_id, bool_or(length(regexp_replace(w, '[^{CJK}]', '', 'g')) BETWEEN 1 AND 2) AS short FROM k GROUP BY doc_id)
 SELECT doc_id, regexp_matches(c, '[{CJK}]') AS has_cjk, CAST(length(regexp_replace(c, '[^{CJK}]', '', 'g')) AS BIGINT) AS n_cjk,
 short AS has_short FROM t JOIN s USING (doc_id)"""

# Matching

ORACLES["match_term"] = f"{OCC}, {UNITS} SELECT DISTINCT query_id, file_id, chunk_no FROM occ JOIN units USING (term)"
ORACLES["match_and"] = f"""{CHUNKS}, {WORDS}
 SELECT 'two' AS query_id, file_id, chunk_no FROM words WHERE list_has_all(t, ['the', 'that'])
 UNION ALL SELECT 'three', file_id, chunk_no FROM words WHERE list_has_all(t, ['der', 'die', 'und'])
 UNION ALL SELECT 'none', file_id, chunk_no FROM words WHERE list_has_all(t, ['the', 'und'])"""
ORACLES["match_batch"] = f"""{OCC}, {UNITS},
 need AS (SELECT query_id, count(*) AS n FROM units GROUP BY query_id),
 got AS (SELECT query_id, file_id, chunk_no, count(DISTINCT term) AS n FROM occ JOIN units USING (term) GROUP BY ALL)
 SELECT query_id, file_id, chunk_no FROM got JOIN need USING (query_id, n)"""
ORACLES["match_or"] = f"""{CHUNKS}, {WORDS}
 SELECT 'two' AS query_id, file_id, chunk_no FROM words WHERE list_has_any(t, ['that', 'und'])
 UNION ALL SELECT 'same', file_id, chunk_no FROM words WHERE list_contains(t, 'for')"""
ORACLES["match_not"] = f"""{CHUNKS}, {WORDS}
 SELECT 'one' AS query_id, file_id, chunk_no FROM words WHERE list_contains(t, 'the') AND NOT list_contains(t, 'with')
 UNION ALL SELECT 'groups', file_id, chunk_no FROM words WHERE (list_contains(t, 'die') AND NOT list_contains(t, 'mit'))
  OR (list_contains(t, 'les') AND NOT list_contains(t, 'pour'))"""
JOINED = f"{CHUNKS}, {WORDS}, joined AS (SELECT file_id, chunk_no, ' ' || array_to_string(t, ' ') || ' ' AS j, t FROM words)"
ORACLES["match_phrase"] = f"""{JOINED}
 SELECT 'two' AS query_id, file_id, chunk_no FROM joined WHERE contains(j, ' of the ')
 UNION ALL SELECT 'three', file_id, chunk_no FROM joined WHERE contains(j, ' the of the ')
 UNION ALL SELECT 'same', file_id, chunk_no FROM joined WHERE contains(j, ' the the ')
 UNION ALL SELECT 'mixed', file_id, chunk_no FROM joined WHERE contains(j, ' de la ') AND contains(j, ' pour ')"""
ORACLES["match_prefix"] = f"""{JOINED}
 SELECT 'one' AS query_id, file_id, chunk_no FROM joined WHERE contains(j, ' tha')
 UNION ALL SELECT 'both', file_id, chunk_no FROM joined WHERE contains(j, ' eau') AND contains(j, ' le ')"""

KCHUNKS = f"WITH {files(KANA)}, {cut()}, low AS (SELECT file_id, chunk_no, lower(content) AS c FROM chunks)"


def times(part: str) -> str:
    """Occurrences of a part none of whose beginnings is also its end."""
    return f"(length(c) - length(replace(c, '{part}', ''))) // length('{part}')"


ORACLES["match_trigram"] = f"""{KCHUNKS}
 SELECT 'word' AS query_id, file_id, chunk_no, CAST({times('ation')} AS BIGINT) AS tf FROM low WHERE contains(c, 'ation')
 UNION ALL SELECT 'and', file_id, chunk_no, CAST({times('the')} AS BIGINT) FROM low WHERE contains(c, 'the') AND contains(c, 'ou')
 UNION ALL SELECT 'phrase', file_id, chunk_no, CAST({times('of the')} AS BIGINT) FROM low WHERE contains(c, 'of the')
 UNION ALL SELECT 'kana', file_id, chunk_no, CAST({times('pア認ア')} AS BIGINT) FROM low WHERE contains(c, 'pア認ア')"""
ORACLES["match_like"] = f"""{KCHUNKS}, abc AS (SELECT file_id, chunk_no, {ASCII_FOLD.format('content')} AS c FROM chunks)
 SELECT 'short' AS query_id, file_id, chunk_no, CAST(0.01 AS DOUBLE) AS score FROM abc WHERE contains(c, '認認')
 UNION ALL SELECT 'two', file_id, chunk_no, CAST(0.01 AS DOUBLE) FROM abc WHERE contains(c, 'dエ') AND contains(c, 'lア')
 UNION ALL SELECT 'case', file_id, chunk_no, CAST(0.01 AS DOUBLE) FROM abc WHERE contains(c, 'able') AND contains(c, 'the')
 UNION ALL SELECT 'wild', file_id, chunk_no, CAST(0.01 AS DOUBLE) FROM abc WHERE contains(c, '100%')"""

# Ranking and results

ORACLES["bm25_term"] = f"""{OCC},
 hits AS (SELECT term AS query_id, 0 AS clause, file_id, chunk_no, dl, count(*) AS tf FROM occ
  WHERE term IN ('the', 'und', 'pour') GROUP BY ALL),
 {scored()} SELECT query_id, file_id, chunk_no, round(score, 6) AS score FROM scored"""
ORACLES["bm25_multi"] = f"{BENCH_HITS} SELECT query_id, file_id, chunk_no, score FROM found"
ORACLES["search_top"] = f"""{BENCH_HITS}, {top_files('found', 10)}
 SELECT query_id, rank, path, chunk_no, score FROM top JOIN files USING (file_id)"""
ORACLES["stored_search"] = ORACLES["search_top"]
ORACLES["search_paths"] = f"""{BENCH_HITS}, {top_files('found', 5)}
 SELECT query_id, rank, path FROM top JOIN files USING (file_id)"""
ORACLES["search_tag"] = f"""{BENCH_HITS},
 tagged AS (SELECT * FROM found WHERE file_id IN (SELECT file_id FROM files WHERE tag1 = 'fr' OR tag2 = 'src3')),
 {top_files('tagged', 10)} SELECT query_id, rank, file_id, chunk_no, score FROM top"""
ORACLES["search_overfetch"] = f"""{BENCH_HITS},
 first30 AS (SELECT query_id, file_id, chunk_no, score FROM (SELECT *, {RANK} FROM found) WHERE rank <= 30),
 {top_files('first30', 10)} SELECT query_id, rank, file_id, chunk_no, score FROM top"""
ORACLES["search_chunks"] = f"""{BENCH_HITS}, top AS (SELECT *, {RANK} FROM found QUALIFY rank <= 30)
 SELECT query_id, rank, path, chunk_no, score, size_bytes, modified, lang FROM top JOIN files USING (file_id)"""
ORACLES["search_context"] = f"""{BENCH_HITS}, top AS (SELECT *, {RANK} FROM found QUALIFY rank <= 10)
 SELECT query_id, rank, file_id, chunk_no, score, content FROM top JOIN chunks USING (file_id, chunk_no)"""
ORACLES["stored_context"] = ORACLES["search_context"]


def snippets(k: int) -> str:
    """`shown`: the k best files of each benchmark text with the 40 words around most of its distinct words."""
    pattern = r"[\p{L}\p{N}\p{Co}]+"
    return f"""{BENCH_HITS}, {top_files('found', k)},
 asked AS (SELECT query_id, list(term) AS q FROM units GROUP BY query_id),
 cutup AS (SELECT query_id, rank, file_id, chunk_no, score, q, regexp_extract_all(content, '{pattern}') AS w,
  regexp_split_to_array(content, '{pattern}') AS g FROM top JOIN chunks USING (file_id, chunk_no) JOIN asked USING (query_id)),
 folded AS (SELECT *, regexp_extract_all(translate(lower(array_to_string(w, ' ')), '{FOLD_FROM}', '{FOLD_TO}'), '{pattern}') AS f FROM cutup),
 marked AS (SELECT *, list_transform(f, lambda x: CASE WHEN list_contains(q, x) THEN x END) AS h FROM folded),
 scanned AS (SELECT *, list_transform(range(0, greatest(len(w) - 40, 0) + 1), lambda s: len(list_distinct(h[s + 1 : s + 40]))) AS n FROM marked),
 placed AS (SELECT *, list_position(n, list_max(n)) AS a, least(list_position(n, list_max(n)) + 39, len(w)) AS z FROM scanned),
 shown AS (SELECT query_id, rank, file_id, chunk_no, score, (CASE WHEN a > 1 THEN '...' ELSE g[1] END)
  || array_to_string(list_transform(range(a, z + 1), lambda i: (CASE WHEN i = a THEN '' ELSE g[i] END)
   || (CASE WHEN h[i] IS NULL THEN w[i] ELSE '>>>' || w[i] || '<<<' END)), '')
  || (CASE WHEN z < len(w) THEN '...' ELSE g[z + 1] END) AS snippet FROM placed)"""


ORACLES["search_snippet"] = f"{snippets(10)} SELECT query_id, rank, file_id, chunk_no, score, snippet FROM shown"
ORACLES["search_json"] = f"""{snippets(5)},
 lists AS (SELECT query_id, string_agg('{{"path":' || to_json(path) || ',"tags":'
   || to_json('["' || tag1 || '","' || tag2 || '"]') || ',"score":' || to_json(score) || ',"snippet":' || to_json(snippet) || '}}',
   ',' ORDER BY rank) AS hits, count(*) AS n FROM shown JOIN files USING (file_id) GROUP BY query_id)
 SELECT CAST(item_id AS VARCHAR) AS query_id, '{{"query":' || to_json(text) || ',"count":' || coalesce(n, 0) || ',"results":'
  || coalesce('[' || hits || ']', 'null') || '}}' AS json FROM benchmark LEFT JOIN lists ON query_id = CAST(item_id AS VARCHAR)"""


def _routed() -> str:
    word_units = "VALUES ('ascii','that',2),('ascii','the',2),('kana','pア認ア',1),('long','mエー한エ',2),('long','dエl',2)," \
        "('mixed','lア証',2),('mixed','the',2),('short','認認',1)"
    # Parts of three or more characters; each query here has only such parts or none.
    part_units = "VALUES ('kana','pア認ア',1),('long','mエー한エ',2),('long','dエl',2),('mixed','lア証',2),('mixed','the',2)"
    first = scored().replace("corpus AS", "wcorpus AS").replace(", corpus)", ", wcorpus)").replace("hits", "whits") \
        .replace("freq", "wfreq").replace("scored AS", "wscored AS")
    second = scored("low", "greatest(length(c) - 2, 0)").replace("corpus AS", "gcorpus AS").replace(", corpus)", ", gcorpus)") \
        .replace("hits", "ghits").replace("freq", "gfreq").replace("scored AS", "gscored AS")
    return f"""{KCHUNKS}, {WORDS},
 wunits(query_id, term, need) AS ({word_units}), gunits(query_id, term, need) AS ({part_units}),
 whits AS (SELECT query_id, term AS clause, file_id, chunk_no, dl, count(*) AS tf FROM occ JOIN wunits USING (term) GROUP BY ALL),
 {first},
 wfound AS (SELECT query_id, file_id, chunk_no, sum(score) AS score FROM wscored GROUP BY ALL
  HAVING (query_id, count(*)) IN (SELECT query_id, need FROM wunits)),
 ghits AS (SELECT query_id, term AS clause, file_id, chunk_no, greatest(length(c) - 2, 0) AS dl,
   (length(c) - length(replace(c, term, ''))) // length(term) AS tf FROM low JOIN gunits ON contains(c, term)),
 {second},
 gfound AS (SELECT query_id, file_id, chunk_no, sum(score) AS score FROM gscored GROUP BY ALL
  HAVING (query_id, count(*)) IN (SELECT query_id, need FROM gunits)),
 abc AS (SELECT file_id, chunk_no, {ASCII_FOLD.format('content')} AS c FROM chunks),
 lfound AS (SELECT 'short' AS query_id, file_id, chunk_no FROM abc WHERE contains(c, '認認')
  UNION ALL SELECT 'long', file_id, chunk_no FROM abc WHERE contains(c, 'mエー한エ') AND contains(c, 'dエl')
  UNION ALL SELECT 'mixed', file_id, chunk_no FROM abc WHERE contains(c, 'lア証') AND contains(c, 'the')),
 found AS (SELECT query_id, 'word' AS branch, file_id, chunk_no, round(score, 6) AS score FROM wfound
  UNION ALL SELECT query_id, 'gram', file_id, chunk_no, round(score, 6) FROM gfound
  UNION ALL SELECT query_id, 'substring', file_id, chunk_no, CAST(0.01 AS DOUBLE) FROM lfound)"""


ROUTED = _routed()
ORACLES["search_routed"] = f"{ROUTED} SELECT query_id, branch, file_id, chunk_no, score FROM found"
ORACLES["stored_routed"] = ORACLES["search_routed"]
ORACLES["search_hybrid"] = f"""{ROUTED},
 one AS (SELECT query_id, branch, file_id, chunk_no, score FROM (SELECT *,
   row_number() OVER (PARTITION BY query_id, file_id, chunk_no ORDER BY score DESC, branch) AS b FROM found) WHERE b = 1),
 {top_files('one', 10)} SELECT query_id, rank, branch, file_id, chunk_no, score FROM top"""
ORACLES["stored_forms"] = f"""{JOINED}
 SELECT 'phrase' AS query_id, file_id, chunk_no FROM joined WHERE contains(j, ' of the ')
 UNION ALL SELECT 'prefix', file_id, chunk_no FROM joined WHERE contains(j, ' tha')
 UNION ALL SELECT 'not', file_id, chunk_no FROM joined WHERE contains(j, ' die ') AND NOT contains(j, ' mit ')"""
ORACLES["preview"] = """WITH t AS (SELECT doc_id, replace(text, chr(10), ' ') AS c FROM documents)
 SELECT doc_id, CASE WHEN length(c) > 120 THEN c[1:120] || '...' ELSE c END AS preview,
 c[1:80] AS short, c[1:100] AS line FROM t"""

# Statistics and listings

ORACLES["stats_totals"] = f"""{CHUNKS} SELECT (SELECT count(*) FROM files) AS n_files,
 (SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) FROM files) AS total_bytes, (SELECT count(*) FROM chunks) AS n_chunks"""
ORACLES["stats_ext"] = f"""WITH {files()} SELECT extension, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes
 FROM files WHERE extension IS NOT NULL GROUP BY extension ORDER BY n_files DESC, extension LIMIT 15"""
ORACLES["stats_tags"] = """SELECT tag, count(*) AS n_files FROM
 (SELECT lang AS tag FROM documents UNION ALL SELECT source FROM documents) GROUP BY tag"""
ORACLES["stats_embeddings"] = "SELECT count(*) AS n_embeddings FROM embeddings"
ORACLES["index_counts"] = f"""WITH {files()}, texty AS (SELECT * FROM files WHERE extension IS NOT NULL AND extension <> '.png'
  AND size_bytes BETWEEN 1 AND 524288), {cut("texty")}
 SELECT (SELECT count(*) FROM files) AS n_files, (SELECT count(*) FROM chunks) AS n_chunks, CAST(0 AS BIGINT) AS n_errors"""
ORACLES["meta_latest"] = f"WITH {files()} SELECT tag2 AS key, max_by(path, modified) AS value FROM files GROUP BY tag2"


def tree(source: str, limit: str = "len(p)") -> str:
    return f"""parts AS (SELECT string_split(path, '/') AS p FROM {source}),
 steps AS (SELECT p, unnest(range(0, {limit})) AS depth FROM parts),
 nodes AS (SELECT array_to_string(p[1:depth], '/') AS parent, depth, p[depth + 1] AS name, depth < len(p) - 1 AS is_dir,
   len(list_filter(p[1:depth + 1], lambda x: x LIKE '.%' OR x IN ('node_modules', '__pycache__', 'dist'))) AS noise FROM steps)
 SELECT DISTINCT parent, depth, name, is_dir FROM nodes WHERE noise = 0"""


ORACLES["tree_listing"] = f"WITH {PAGES}, {tree('pages2')}"
ORACLES["tree_shallow"] = f"WITH {files()}, {tree('files', 'least(len(p), 2)')}"

# Vectors

VEC = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
ORACLES["cosine_pairs"] = f"""WITH {VEC} SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity
 FROM v a JOIN v b ON b.vec_id = a.vec_id + 1"""
MEANS = """dims AS (SELECT label, unnest(e) AS x, unnest(range(0, len(e))) AS d FROM v),
 avgs AS (SELECT label, d, avg(x) AS x FROM dims GROUP BY ALL),
 means AS (SELECT label, list(x ORDER BY d) AS m FROM avgs GROUP BY label)"""
ORACLES["semantic_top"] = f"""WITH {VEC}, {MEANS}, {files()},
 pairs AS (SELECT CAST(means.label AS VARCHAR) AS query_id, CAST(v.label AS BIGINT) AS file_id, vec_id AS chunk_no,
  round(list_cosine_similarity(m, e), 9) AS score FROM means, v),
 {top_files('pairs', 10)}
 SELECT query_id, rank, file_id, chunk_no, coalesce(path, '?') AS path, round(score, 6) AS score FROM top LEFT JOIN files USING (file_id)"""
ORACLES["semantic_batch"] = f"""WITH {VEC},
 pairs AS (SELECT CAST(a.vec_id AS VARCHAR) AS query_id, b.vec_id AS file_id, CAST(0 AS BIGINT) AS chunk_no,
  round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id),
 {top_files('pairs', 5)} SELECT query_id, rank, file_id, round(score, 6) AS score FROM top"""
ORACLES["related_files"] = f"""WITH {VEC}, {MEANS},
 pairs AS (SELECT CAST(a.label AS VARCHAR) AS query_id, CAST(b.label AS BIGINT) AS file_id, 0 AS chunk_no,
  round(list_cosine_similarity(a.m, b.m), 9) AS score FROM means a JOIN means b ON a.label <> b.label),
 {top_files('pairs', 5)} SELECT query_id, rank, file_id, round(score, 6) AS score FROM top"""


def _lists(k: int) -> str:
    keyword = top_files("found", k).replace("top AS", "keyword AS", 1)
    near = top_files("pairs", k).replace("top AS", "near AS", 1)
    return f"""{BENCH_HITS}, {keyword}, {VEC},
 pairs AS (SELECT CAST(item_id AS VARCHAR) AS query_id, b.vec_id AS file_id, CAST(0 AS BIGINT) AS chunk_no,
  round(list_cosine_similarity(a.e, b.e), 9) AS score FROM benchmark JOIN v a ON item_id = a.vec_id, v b),
 {near}"""


ORACLES["compare_methods"] = f"""{_lists(5)}
 SELECT query_id, file_id, coalesce(keyword.rank, 0) AS keyword_rank, coalesce(near.rank, 0) AS semantic_rank, round(near.score, 6) AS similarity,
  CASE WHEN near.rank IS NULL THEN 'keyword' WHEN keyword.rank IS NULL THEN 'semantic' ELSE 'both' END AS method
 FROM keyword FULL JOIN near USING (query_id, file_id)"""
ORACLES["rrf_hybrid"] = f"""{_lists(20)},
 fused AS (SELECT query_id, file_id, 0 AS chunk_no, round(sum(1.0 / (60 + rank)), 6) AS score FROM
  (SELECT query_id, file_id, rank FROM keyword UNION ALL SELECT query_id, file_id, rank FROM near) GROUP BY ALL)
 SELECT query_id, rank, file_id, CAST(score AS DOUBLE) AS score FROM (SELECT *, {RANK} FROM fused) WHERE rank <= 10"""

# Change sets and streams

ORACLES["incremental_changes"] = f"""WITH {files()} SELECT path, CASE WHEN tag2 = 'src3' THEN 'new' WHEN tag2 = 'src5' THEN 'deleted'
 WHEN tag1 = 'de' THEN 'changed' ELSE 'same' END AS change FROM files"""
ORACLES["incremental_apply"] = f"""WITH {files("CASE WHEN lang = 'de' THEN 'neu' || chr(10) || text ELSE text END")},
 kept AS (SELECT path, content FROM files WHERE tag2 <> 'src5'), {cut("kept", key="path")}
 SELECT path, chunk_no, md5(content) AS digest FROM chunks"""
ORACLES["incremental_store"] = ORACLES["incremental_apply"]
ORACLES["store_recovery"] = ORACLES["incremental_apply"]
ORACLES["stored_rebuilt"] = ORACLES["incremental_apply"]
ORACLES["stream_late"] = ORACLES["chunk_lines"].replace("SELECT file_id, chunk_no, content FROM", "SELECT file_id, chunk_no, md5(content) AS digest FROM")
ORACLES["stream_index"] = f"{CHUNKS} SELECT file_id, chunk_no, md5(content) AS digest FROM chunks"
ORACLES["scan_files"] = " UNION ALL ".join(
    f"SELECT '{t}.parquet' AS filename, '.parquet' AS extension, count(*) AS n_rows FROM {t}" for t in ("benchmark", "documents", "pages"))
ORACLES["stream_onto_store"] = ORACLES["stream_index"]
ORACLES["stored_mixed"] = f"""
SELECT 'gram' AS branch, query_id, file_id, chunk_no FROM ({ORACLES["match_trigram"]})
UNION ALL SELECT 'substring', query_id, file_id, chunk_no FROM ({ORACLES["match_like"]})
"""
CHANGED = f"""WITH {files("CASE WHEN lang = 'de' THEN 'neu' || chr(10) || text ELSE text END")},
 kept AS (SELECT * FROM files WHERE tag2 <> 'src5'), {cut("kept")}"""
ORACLES["stored_updated_search"] = ORACLES["search_top"].replace(CHUNKS, CHANGED)
ORACLES["semantic_text"] = f"""WITH {VEC}, {MEANS}, {files()}, {cut()},
 pairs AS (SELECT CAST(means.label AS VARCHAR) AS query_id, vec_id AS file_id, CAST(0 AS BIGINT) AS chunk_no,
  round(list_cosine_similarity(m, e), 9) AS score FROM means, v),
 {top_files('pairs', 10)}
 SELECT query_id, rank, file_id, chunk_no, md5(content) AS content, round(score, 6) AS score FROM top JOIN chunks USING (file_id, chunk_no)"""
ORACLES["embed_hash"] = f"""{CHUNKS},
 tokens AS (SELECT file_id, chunk_no, md5('7:' || unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+'))) AS code FROM chunks),
 cells AS (SELECT file_id, chunk_no, CAST('0x' || code[1:8] AS BIGINT) % 64 AS d, sum(CASE WHEN code[9] >= '8' THEN 1 ELSE -1 END) AS x
  FROM tokens GROUP BY ALL),
 grid AS (SELECT file_id, chunk_no, unnest(range(0, 64)) AS d FROM chunks)
 SELECT file_id, chunk_no, CAST(64 AS BIGINT) AS dim, CASE WHEN bool_or(x <> 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length,
  string_agg(CASE WHEN x > 0 THEN '+' WHEN x < 0 THEN '-' ELSE '0' END, '' ORDER BY d) AS signs, CAST(NULL AS VARCHAR) AS error
 FROM grid LEFT JOIN cells USING (file_id, chunk_no, d) GROUP BY file_id, chunk_no"""
