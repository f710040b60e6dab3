"""SQL of another engine that gives the rows of the queries that SQL can express."""

from __future__ import annotations

from . import quality

#: CRC-32 by its byte table, over the hexadecimal form of the text's bytes.
_CRC = """
bits AS (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS v FROM range(0, 256) t(i)),
crc_table AS (SELECT list(v ORDER BY i) AS crc FROM bits)"""


def _md5_bits(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


SHARDS = f"""
WITH {_CRC.strip()},
hexed AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS source, hex(encode(coalesce(text, ''))) AS hx FROM documents),
rows AS (SELECT doc_id, source, CAST(length(hx) // 2 + 16 AS BIGINT) AS size, {_md5_bits("'7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')")} AS h,
    xor(list_reduce(list_transform(range(0, length(hx) // 2), lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c // 256, crc[CAST(xor(c, b) % 256 + 1 AS INTEGER)]), 4294967295), 4294967295) AS text_crc32 FROM hexed, crc_table),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32, size) - (({_md5_bits("'8:' || source")}) % 1000003 + CAST(0.5 AS DOUBLE)) / CAST(1000003 AS DOUBLE)) / count(*) OVER (PARTITION BY source) AS place FROM rows),
placed AS (SELECT *, row_number() OVER (ORDER BY place, source, h, doc_id, text_crc32, size) - 1 AS pos, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, pos * 40 // total AS shard FROM placed)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(pos - (shard * total + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut
"""

_SPACE = r"[ \t-\r]"
_RISK, _LEVEL = quality.RISK / len(quality.RULES), quality.ERROR / ((len(quality.STRATA) + 1) * len(quality.RULES))
_SCORES = " UNION ALL ".join(f"SELECT stratum, good, '{r}' AS rule, {r} AS score FROM holdout" for r in quality.RULES)
_REJECTED = " OR ".join(f"coalesce({r} > (SELECT cutoff FROM chosen c WHERE c.stratum = f.stratum AND c.rule = '{r}'), false)" for r in quality.RULES)
QUALITY = rf"""
WITH texts AS (SELECT doc_id, CASE WHEN lang IN ({", ".join(f"'{x}'" for x in quality.STRATA)}) THEN lang ELSE 'other' END AS stratum, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, list_filter(string_split_regex(text, '{_SPACE}+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l FROM texts),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM split)),
again AS (SELECT doc_id, gram FROM grams GROUP BY doc_id, gram HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT g.doc_id, unnest(range(g.i, g.i + 5)) AS p FROM grams g JOIN again USING (doc_id, gram)) GROUP BY doc_id),
counted AS (SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{_SPACE}+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS upper FROM split LEFT JOIN covered USING (doc_id)),
f AS (SELECT doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_symbols::DOUBLE / greatest(n_words, 1) AS symbol_ratio, n_dup_lines::DOUBLE / greatest(n_lines, 1) AS dup_line_ratio, n_repeat_words::DOUBLE / greatest(n_words, 1) AS repeat_ratio, upper::DOUBLE / greatest(word_chars, 1) AS upper_ratio FROM counted),
known AS (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
holdout AS (SELECT f.*, good FROM f JOIN known USING (doc_id) WHERE NOT base_failed),
scores AS ({_SCORES}),
cutoffs(i, cutoff) AS (VALUES {", ".join(f"({i}, {c}::DOUBLE)" for i, c in enumerate(quality.CUTOFFS))}),
tests AS (SELECT stratum, rule, i, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND score > cutoff) AS k, count(*) FILTER (NOT good AND score > cutoff) AS bad FROM scores, cutoffs GROUP BY stratum, rule, i, cutoff),
tails AS (SELECT *, CASE WHEN k >= n * {_RISK}::DOUBLE THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln({_RISK}::DOUBLE) + (n - j) * ln(1 - {_RISK}::DOUBLE)))) END <= {_LEVEL}::DOUBLE AS passed FROM tests),
certified AS (SELECT t.* FROM tails t WHERE NOT EXISTS (SELECT 1 FROM tails u WHERE u.stratum = t.stratum AND u.rule = t.rule AND NOT u.passed AND u.i <= t.i) AND k * {quality.WORTH} <= bad),
chosen AS (SELECT stratum, rule, max(cutoff) AS cutoff FROM (SELECT *, max(bad) OVER (PARTITION BY stratum, rule) AS most FROM certified) WHERE most > 0 AND bad >= most * {quality.ENOUGH}::DOUBLE GROUP BY stratum, rule)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_REJECTED}) AS kept, stratum, {", ".join(quality.RULES)} FROM f
"""
