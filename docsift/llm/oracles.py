"""DuckDB SQL of the operators that SQL can express, stated from the contracts
and without any part of the Spark side."""

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *,
    length(replace(text, '\', '\\')) + (length(text) - length(replace(text, '<|', ''))) // 2
      + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4
      + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7 AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>' || role || '<|im_sep|>') + chars + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

LEAKS = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark
), item_grams AS (
  SELECT DISTINCT item_id, n, w[i:i + n - 1] AS g
  FROM (SELECT item_id, w, least(5, len(w)) AS n, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM item WHERE len(w) > 0)
), widths AS (SELECT DISTINCT n FROM item_grams), doc_grams AS (
  SELECT DISTINCT doc_id, w[i:i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, widths)
), q AS (SELECT item_id, count(*) AS q FROM item_grams GROUP BY item_id)
SELECT doc_id, item_id, count(*) / any_value(q)::DOUBLE AS containment
FROM doc_grams JOIN item_grams USING (g) JOIN q USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(q)
"""

LINES = r"""
WITH base AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
    [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(0, 5) AS r(j) GROUP BY doc_id
), line AS (
  SELECT doc_id, host, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS l
  FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS x FROM base)
), host_size AS (
  SELECT host, count(*) AS docs FROM base GROUP BY host
), often AS (
  SELECT host, l FROM line JOIN host_size USING (host) WHERE l <> ''
  GROUP BY host, l HAVING count(DISTINCT doc_id) > 10 AND count(DISTINCT doc_id) > 0.01 * any_value(docs)
), share AS (
  SELECT line.doc_id, coalesce(sum(length(line.l)) FILTER (often.l IS NOT NULL), 0) / sum(length(line.l))::DOUBLE AS share
  FROM line LEFT JOIN often ON line.host = often.host AND line.l = often.l
  WHERE line.l <> '' GROUP BY line.doc_id
), raw AS (
  SELECT doc_id, [y FOR y IN string_split(text, chr(10)) IF regexp_matches(y, '[^\x20\x09-\x0D]')] AS x FROM base
), measured AS (
  SELECT base.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(x) - len(list_distinct(x)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(share, 0) AS removed_share
  FROM base JOIN raw USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN share USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, removed_share,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 1 - removed_share >= 0.5 AS kept
FROM measured
"""

REPEATS = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\S+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, hash(w[i:i + 49]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM doc)
), seen AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS low, max(doc_id) OVER (PARTITION BY h) AS high FROM windows
), marked AS (
  SELECT doc_id, i, doc_id <> low AS later FROM seen WHERE low <> high
), covered AS (
  SELECT doc_id, i + j AS word, bool_and(later) AS later FROM marked, range(0, 50) AS r(j) GROUP BY doc_id, i + j
), islands AS (
  SELECT doc_id, later, word, word - row_number() OVER (PARTITION BY doc_id ORDER BY word) AS all_run,
    word - row_number() OVER (PARTITION BY doc_id, later ORDER BY word) AS own_run FROM covered
), all_spans AS (
  SELECT doc_id, min(word) - 1 AS s, max(word) AS e FROM islands GROUP BY doc_id, all_run
), cut_spans AS (
  SELECT doc_id, min(word) - 1 AS s, max(word) AS e FROM islands WHERE later GROUP BY doc_id, own_run
), shown AS (
  SELECT doc_id, sum(e - s)::BIGINT AS n_repeated, string_agg(s || ':' || e, ',' ORDER BY s) AS repeated FROM all_spans GROUP BY doc_id
), cut AS (
  SELECT doc_id, sum(e - s)::BIGINT AS n_removed, string_agg(s || ':' || e, ',' ORDER BY s) AS removed FROM cut_spans GROUP BY doc_id
)
SELECT doc_id, n_repeated, coalesce(n_removed, 0) AS n_removed, repeated, coalesce(removed, '') AS removed FROM shown LEFT JOIN cut USING (doc_id)
"""

AUDIT = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), judged AS (
  SELECT d.doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'),
    coalesce(d.doc_id > (min(d.doc_id) OVER (PARTITION BY text)), false)] AS fails
  FROM doc d
), said AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), cell AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM judged LEFT JOIN said USING (doc_id) GROUP BY part, fails
), orders(o) AS (
  SELECT '' UNION ALL SELECT o || l FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS t(l) WHERE NOT contains(o, l)
), steps AS (
  SELECT o AS filter_order, k::INT AS step, ascii(o[k]) - 64 AS own, [ascii(c) - 64 FOR c IN string_split(o[:k - 1], '') IF c <> ''] AS before
  FROM orders, range(1, 6) AS r(k) WHERE length(o) = 5
), counted AS (
  SELECT part, filter_order, step, own,
    sum(n) FILTER (NOT fails[own] AND NOT gone) AS kept,
    sum(n) FILTER (fails[own] AND NOT gone) AS removed,
    sum(n) FILTER (fails[own] AND gone) AS redundant,
    sum(n) FILTER (fails[own] AND len(list_filter(fails, lambda f: f)) = 1) AS unique_fails,
    sum(good) FILTER (fails[own] AND NOT gone) AS good_lost,
    sum(toxic) FILTER (fails[own] AND NOT gone) AS toxic_lost
  FROM (SELECT *, len(list_filter(before, lambda b: fails[b])) > 0 AS gone FROM cell, steps)
  GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
FROM counted
"""

NEGATIVES = r"""
WITH vec AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pair AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum([p[1] * p[2] FOR p IN list_zip(a.v, b.v)])::BIGINT AS score
  FROM vec a JOIN vec b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN pair USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

SIMILAR = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), gram AS (
  SELECT DISTINCT doc_id, w[i:i + 3] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM doc WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id
), link AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM gram a JOIN gram b USING (g) JOIN size s ON s.doc_id = a.doc_id JOIN size t ON t.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(s.n) + any_value(t.n) - count(*))
), reach(u, v) AS (
  SELECT doc_id, doc_id FROM size UNION SELECT reach.u, link.v FROM reach JOIN link ON link.u = reach.v
), component AS (
  SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN component USING (doc_id)
"""
