"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

from statewave.llm.quality_rules import STOP_WORDS

SPACE = r"\x20\x09-\x0D"
QUOTED_STOP_WORDS = ", ".join(f"'{w}'" for w in STOP_WORDS)

#: kind, place, pattern, what confirms a match m (with its digits d), score, context words, least score.
#: Patterns without look-around; what may not stand before or after a match is the last pair.
PII = (
    ("email", 1, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 0.9, "mail|contact|write|address", 0, "", ""),
    ("ip", 2, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
     "list_max(list_transform(string_split(m, '.'), lambda x: CAST(x AS HUGEINT))) <= 255", 0.6, "ip|host|server|address|login", 0, "", ""),
    ("card", 3, r"[0-9]([\x20-]?[0-9])+", "length(d) BETWEEN 16 AND 19 AND luhn", 0.8,
     "card|visa|master|credit|karte|carte|tarjeta", 0, "", ""),
    ("phone", 4, r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 8 AND 15", 0.7, "phone|tel|call|mobile|fax|anruf", 0, "", ""),
    ("iban", 5, r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]){11,30}", "length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND mod97 = 1", 0.8,
     "iban|account|konto|compte|cuenta|bank", 0.5, "[A-Za-z0-9]$", "^[A-Za-z0-9]"),
    ("short_card", 6, r"[0-9]([\x20-]?[0-9])+", "length(d) BETWEEN 13 AND 15 AND luhn", 0.3,
     "card|visa|amex|diners|credit|karte|carte|tarjeta", 0.5, "", ""),
    ("us_ssn", 7, r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT regexp_matches(m, '^(000|666|9[0-9][0-9])|-00-|-0000$')", 0.3,
     "ssn|social|security|tax", 0.5, "[0-9-]$", "^[0-9-]"),
)

LUHN = """list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 0
    THEN (2 * CAST(d[length(d) + 1 - i] AS INT)) // 10 + (2 * CAST(d[length(d) + 1 - i] AS INT)) % 10
    ELSE CAST(d[length(d) + 1 - i] AS INT) END)) % 10 = 0"""
MOD97 = """list_reduce(list_prepend(0, list_transform(string_split(b[5:] || b[:4], ''), lambda c: CASE WHEN c = '' THEN 0 WHEN c >= 'A'
    THEN ascii(c) - 55 ELSE CAST(c AS INT) END)), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97)"""


def pii_matches(kind: tuple) -> str:
    name, place, pattern, confirmed, score, context, least, before, after = kind
    edges = "".join(f" AND NOT regexp_matches({side}, '{p}')" for side, p in (("gap", before), ("next", after)) if p)
    return f"""
    SELECT doc_id, row, {place} AS place, '{name}' AS kind, start, start + length(m) AS stop FROM (
        SELECT *, {LUHN if 'luhn' in confirmed else 'true'} AS luhn, {MOD97 if 'mod97' in confirmed else '0'} AS mod97 FROM (
            SELECT doc_id, row, i, ms[i] AS m, gs[i] AS gap, gs[i + 1] AS next, regexp_replace(ms[i], '[^0-9]', '', 'g') AS d,
                replace(ms[i], ' ', '') AS b, CAST(list_sum(list_transform(gs[:i], lambda x: length(x)))
                    + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
            FROM (SELECT doc_id, row, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
                SELECT doc_id, row, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gs FROM d))))
    WHERE {confirmed}{edges} AND {score} + CASE WHEN regexp_matches(lower(right(gap, 40)), '{context}') THEN 0.3 ELSE 0 END >= {least}"""


OP1 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(map(pii_matches, PII))}),
joined AS (SELECT row, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
    count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start) FILTER (place <= 4) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start) AS spans FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
    coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (row)"""

OP2 = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+')) AS BIGINT) AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffled FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
r AS (SELECT *, 1.5 * sum(source_size) OVER () AS budget, 2 * source_size AS cap,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left, 2 * coalesce(sum(source_size) OVER before, 0) AS cap_before
    FROM w WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CAST(cap AS DOUBLE) * weight_left <= weight * (CAST(budget AS DOUBLE) - cap_before) AS capped FROM r),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE weight * ((CAST(budget AS DOUBLE)
    - coalesce(sum(cap) FILTER (capped) OVER (), 0)) / sum(weight) FILTER (NOT capped) OVER ()) END AS target FROM c),
q AS (SELECT doc_id, size, source_size, target, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY shuffled, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(floor(target + 0.5) - before, size))
    + greatest(0, least(floor(target + 0.5) - source_size - before, size)) AS BIGINT) AS taken,
    CASE WHEN target > 0 THEN (before + size) / target END AS first_finish FROM q"""

OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^{SPACE}]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (
    SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id
    GROUP BY ALL) JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)"""

OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^{SPACE}]+') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS ls FROM d),
grams AS (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS times FROM (SELECT row, i, array_to_string(ws[i:i + 2], ' ') AS g
    FROM (SELECT row, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2))),
again AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE times > 1) GROUP BY row),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[{SPACE}]*\\z'))) AS n_ellipsis_lines,
    len(list_intersect(list_distinct(ws), [{QUOTED_STOP_WORDS}])) AS n_stop_words FROM w LEFT JOIN again USING (row)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_symbols > 20 * n_words
        OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_ellipsis_lines > 50 * n_lines OR n_stop_words < 2) AS kept FROM b"""

OP10 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id
    WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM p QUALIFY rank <= 20"""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM (
    SELECT lang, unnest(string_split_regex({LOWERED}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (
    SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY ALL),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= 10),
cuts AS (SELECT c.*, cut, l.f AS l, r.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
    JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(ws[:cut], ' ')
    JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(ws[i:i + 1], ' ') AS phrase FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE k = 3)) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN inner_ USING (lang, phrase) JOIN n USING (lang)
WHERE longer IS NULL OR 100 * longer < 50 * a QUALIFY rank <= 2000"""

#: crc32 by its table of 256 values, which its rule of eight steps gives; h holds the text's bytes as hex digits.
CRC_STEP = "CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
OP12 = f"""
WITH RECURSIVE steps(k, b, x) AS (
    SELECT 0, b, b FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b) UNION ALL SELECT k + 1, b, {CRC_STEP} FROM steps WHERE k < 8),
crc AS (SELECT list(x ORDER BY b) AS t FROM steps WHERE k = 8),
w AS (SELECT 'd' AS side, row_number() OVER () AS row, doc_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
    UNION ALL SELECT 'b', NULL, NULL, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
f AS (SELECT side, row, feature, count(*) AS n FROM (
    SELECT side, row, unnest(ws) AS feature FROM w
    UNION ALL SELECT side, row, ws[i] || ' ' || ws[i + 1] FROM (SELECT side, row, ws, unnest(range(1, len(ws))) AS i FROM w)) GROUP BY ALL),
hashed AS (SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))),
        lambda c, v: xor(t[1 + (xor(c, v) & 255)], c >> 8)), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT feature, hex(encode(feature)) AS h FROM f), crc),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t
    FROM f JOIN hashed USING (feature) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * ((SELECT coalesce(sum(s), 0) FROM counts) + 10000)
    / ((CAST(s AS DOUBLE) + 1) * ((SELECT coalesce(sum(t), 0) FROM counts) + 10000)))) AS BIGINT) AS gain FROM counts),
sums AS (SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight
    FROM f JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row),
d AS (SELECT doc_id, len(ws) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), ''))[:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM w LEFT JOIN sums USING (row) WHERE side = 'd'),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS place,
    count(*) OVER (PARTITION BY words >= 20) AS enough FROM d)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= enough * 25 // 100 THEN place END AS rank FROM r"""

ORACLES: dict[str, str] = {
    "op1_pii": OP1, "op2_mixing": OP2, "op3_ngram_join": OP3, "op7_quality_rules": OP7, "op10_nearest": OP10,
    "op11_phrases": OP11, "op12_resample": OP12}
