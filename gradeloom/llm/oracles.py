"""DuckDB SQL for the queries that SQL can express; written apart from the operators."""

#: The lines of a text with their words, judged one by one, and 8-word windows counted per document.
LINE_RULES = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
wins AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS win
         FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM worded)),
starts AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
repeats AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words
            FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM starts) GROUP BY doc_id),
lines AS (SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w,
                 trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)),
judged AS (SELECT doc_id, line, w, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
    len(w) = 0 OR NOT (
      len(list_filter(w, lambda x: x IN ('|', '>', '»'))) >= 3 AND len(list_filter(w, lambda x: x IN ('|', '>', '»'))) * 4 >= len(w)
      OR length(regexp_replace(core, '[^#*$%&|<>]+', '', 'g')) >= 3 AND length(regexp_replace(core, '[^#*$%&|<>]+', '', 'g')) * 12 > length(core)
      OR len(w) >= 8 AND len(list_distinct(w)) * 3 < len(w)
      OR len(w) <= 12 AND regexp_matches(core, '(?i)(?:cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|sign in|sign up|log in|click here|read more|subscribe to|skip to content|back to top|enable javascript|share this)')
      OR len(w) >= 40 AND NOT regexp_matches(core, '[.!?:;,…。！？)\]"''»”’]$')) AS passes
    FROM lines),
by_doc AS (SELECT doc_id, sum(CASE WHEN passes THEN chars ELSE 0 END)::BIGINT AS left_chars,
                  (count(*) FILTER (WHERE len(w) > 0) - count(DISTINCT line) FILTER (WHERE len(w) > 0))::BIGINT AS n_dup_lines
           FROM judged GROUP BY doc_id),
counted AS (
  SELECT worded.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, left_chars
  FROM worded JOIN by_doc USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND left_chars >= word_chars * 0.5 AS kept, left_chars
FROM counted
"""

#: Targets by raising the common level source by source; words are taken in the order of the hash key.
MIX = r"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                     md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
                   3 * source_size AS cap FROM sums),
levels AS (SELECT a.source, ((SELECT sum(source_size) FROM sums) - coalesce(sum(b.cap) FILTER (WHERE b.cap / b.weight < a.cap / a.weight), 0))
                  / sum(b.weight) FILTER (WHERE b.cap / b.weight >= a.cap / a.weight) AS level
           FROM weighed a, weighed b GROUP BY a.source),
targets AS (SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT max(level) FROM levels)) AS target FROM weighed),
ordered AS (SELECT doc_id, size, source_size, target, floor(target + 0.5)::BIGINT AS budget,
                   sum(size) OVER (PARTITION BY docs.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
            FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size * size + greatest(0, least(size, budget % source_size - start)) ELSE 0 END)::BIGINT AS taken
FROM ordered
"""

#: All windows of 35 words, those that start at two places, and the words that they cover.
SUBSTRING = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, i, md5(array_to_string(words[i:i+34], ' ')) AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM docs)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS n FROM starts) WHERE n > 1),
covered AS (SELECT DISTINCT doc_id, i + j AS p FROM again, (SELECT unnest(range(0, 35)) AS j)),
spans AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before <> p - 1) AS n_spans
          FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM covered) GROUP BY doc_id),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM placed ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
