"""DuckDB SQL for the quality-rules query, formulated by unnesting words and windows."""

OP4 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
ww AS (SELECT doc_id, i, md5(concat_ws(' ', words[i], words[i+1], words[i+2], words[i+3], words[i+4])) AS g
       FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM ww) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(0, 5)) AS j) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, w.source, len(words)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN dl USING (doc_id) LEFT JOIN cover USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM f GROUP BY source),
p AS (SELECT sum(failed) AS f, sum(n) AS t, count(*) AS k, avg(failed / n) AS m, var_pop(failed / n) AS v, avg(1.0::DOUBLE / n) AS r FROM h),
q AS (SELECT *, k >= 3 AND v - m * (1 - m) * r > 1e-12 AND m > 0 AND m < 1 AS fitted FROM p),
b AS (SELECT CASE WHEN fitted THEN m ELSE f / t END AS mean,
        CASE WHEN fitted THEN greatest(1.0::DOUBLE, m * (1 - m) / (v - m * (1 - m) * r) - 1) ELSE t / k END AS strength FROM q),
r AS (SELECT h.source, n, strength, (failed + mean * strength) / (n + strength) AS rate FROM h, b),
s AS (SELECT source, rate, rate - 2 * sqrt(rate * (1 - rate) / (n + strength + 1)) > 0.5 AS bad FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT bad AS kept, bad AS host_rejected, round(rate, 6) AS shrunk_rate
FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source
"""

SQL = {"op4_host_quality_rules": OP4}
