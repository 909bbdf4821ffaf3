"""DuckDB SQL for the operators SQL can express."""

from __future__ import annotations

from merchantlens.llm.quality_rules import BASE_FAILED, RULES, STOP_WORDS

WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH split_up AS (
    SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS whole,
           regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l
    FROM documents
), windows AS (
    SELECT row_id, i, list_slice(w, i, i + 7) AS win
    FROM (SELECT row_id, w, unnest(range(1, len(w) - 6)) AS i FROM split_up WHERE len(w) >= 8)
), repeated AS (
    SELECT row_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY row_id, win) > 1
), covered AS (
    SELECT row_id, count(DISTINCT i + k) AS n FROM repeated, range(0, 8) AS r(k) GROUP BY row_id
), measured AS (
    SELECT s.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
           len(regexp_extract_all(whole, '[#*$%&|<>]')) AS n_symbols,
           len(l) - len(list_distinct(l)) AS n_dup_lines,
           coalesce(c.n, 0) AS n_repeat_words,
           len(regexp_extract_all(whole, '!')) AS n_exclamations,
           len(list_filter(w, lambda x: list_contains([{", ".join(f"'{word}'" for word in STOP_WORDS)}], x)))
               AS n_stop_words,
           len(l) AS n_lines
    FROM split_up s LEFT JOIN covered c USING (row_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({BASE_FAILED}) AS base_failed,
       NOT ({BASE_FAILED}) AND {" AND ".join(f"({rule.passed()})" for rule in RULES)} AS kept
FROM measured
"""

MINED = """
WITH usable AS (
    SELECT row_number() OVER () AS n, vec_id, if(vec_id % 7 = 0, (label + 1) % 10, label) AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.n AS a, a.vec_id AS anchor_id, b.n AS b, b.vec_id AS other_id, a.label = b.label AS same,
           list_dot_product(a.v, b.v)::BIGINT AS score
    FROM usable a JOIN usable b ON a.n <> b.n WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id, b) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id,
       row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.other_id, s.b)::INTEGER AS rank,
       s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY rank <= 5
"""

# A feature's checksum is taken byte by byte with the usual table of 256 remainders.
DRAWN = r"""
WITH crc_table AS (
    SELECT list(list_reduce(range(8), lambda c, k: if(c % 2 = 1, xor(c // 2, 3988292384), c // 2), i) ORDER BY i) AS c
    FROM range(256) AS r(i)
), texts AS (
    SELECT 0 AS side, row_number() OVER () AS n, doc_id, text FROM documents
    UNION ALL SELECT 1, row_number() OVER (), item_id, text FROM benchmark
), worded AS (
    SELECT side, n, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM texts
), features AS (
    SELECT side, n, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS feature FROM worded
), hashed AS (
    SELECT feature, xor(list_reduce(
        list_transform(range(octet_length(encode(feature))), lambda i: ('0x' || hex(encode(feature))[2 * i + 1:2 * i + 2])::BIGINT),
        lambda crc, byte: xor(crc // 256, c[xor(crc % 256, byte) + 1]), 4294967295), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT feature FROM features), crc_table
), located AS (
    SELECT side, n, bucket FROM features JOIN hashed USING (feature)
), counted AS (
    SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM located GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM counted) + 10000)::DOUBLE)
                                   / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counted) + 10000)::DOUBLE)))::BIGINT AS gain
    FROM counted
), weighted AS (
    SELECT n, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
    FROM located JOIN gains USING (bucket) WHERE side = 0 GROUP BY n
), scored AS (
    SELECT w.n, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln(
               (('0x' || left(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM worded w LEFT JOIN weighted USING (n) WHERE side = 0
), placed AS (
    SELECT n, row_number() OVER (ORDER BY score DESC, doc_id, n) AS place, count(*) OVER () AS n_long FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, if(place <= 25 * n_long // 100, place, NULL) AS rank
FROM scored LEFT JOIN placed USING (n)
"""

ORACLES = {"op9_quality_rules": QUALITY, "op12_hard_negatives": MINED, "op13_target_resampling": DRAWN}
