"""SQL twins (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"
_CHARS = r"regexp_replace({}, '[\x20\x09-\x0D]+', '', 'g')"

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{_SPACE}'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
    FROM d),
windows AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
    FROM w, unnest(range(1, len(ws) - 1)) r(i)),
repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
    FROM repeated, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
counts AS (SELECT doc_id, host, len(ws)::BIGINT AS n_words,
    length({_CHARS.format('t')})::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN covered USING (doc_id)),
lines AS (SELECT doc_id, host, length({_CHARS.format('l')}) AS chars,
    regexp_replace(trim(regexp_replace(lower(l), '{_SPACE}', ' ', 'g')), '[0-9]+', '0', 'g')
        AS line FROM (SELECT doc_id, host, unnest(ls) AS l FROM w)),
hosts AS (SELECT host, count(DISTINCT doc_id) AS docs FROM lines GROUP BY host),
often AS (SELECT host, line, count(DISTINCT doc_id) AS n, min(doc_id) AS keeper
    FROM lines GROUP BY host, line HAVING n > 50),
gone AS (SELECT l.doc_id, count(*) AS removed, sum(chars) AS lost
    FROM lines l JOIN often USING (host, line) JOIN hosts USING (host)
    WHERE n > docs * 0.001 AND l.doc_id <> keeper GROUP BY l.doc_id),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
    FROM counts LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    coalesce(removed, 0)::BIGINT AS lines_removed,
    NOT base_failed AND word_chars - coalesce(lost, 0) >= 0.3 * word_chars AS kept
FROM judged"""

CHAT = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
        (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), ''))
        AS loss_sha256,
    sum(length('<|im_start|>') + length(role) + 1 + length(text)
        + len(regexp_extract_all(text, '<\\*\|')) + length('<|im_end|>') + 1)::BIGINT
        AS formatted_chars
FROM turns GROUP BY conv_id"""

#: Kind, its number, pattern (words end at \b here), start score and context.
_PII = (
    ("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0.9,
     "mail|contact|write"),
    ("ip", 1, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", 0.6,
     "(?:^|[^a-z])ip(?:[^a-z]|$)|address|server|host|client"),
    ("card", 2, r"[0-9](?:[\x20-]?[0-9])+", 0.8, "card|visa|credit|payment|master"),
    ("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", 0.6,
     "phone|call|(?:^|[^a-z])tel(?:[^a-z]|$)|mobile|fax"),
    ("iban", 4, r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", 0.9, "iban|bank|account|transfer"),
    ("national", 5, r"\b[0-9]{8}[A-Z]\b", 0.3,
     "(?:^|[^a-z])(?:dni|nif)(?:[^a-z]|$)|passport|identi"),
)


def _found(kind: str, k: int, pattern: str, score: float, context: str) -> str:
    return f"""SELECT doc_id, text, {k} AS k, '{kind}' AS kind, {score} AS base,
        regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps,
        '{context}' AS context FROM d"""


_LUHN = """list_sum(list_transform(range(1, length(digits) + 1), lambda i:
    CASE WHEN i % 2 = 1 THEN reverse(digits)[i]::INT
    ELSE list_extract([0, 2, 4, 6, 8, 1, 3, 5, 7, 9], reverse(digits)[i]::INT + 1) END)) % 10 = 0"""
_MOD97 = """list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(
    substr(bare, 5) || substr(bare, 1, 4), ''), lambda c: (CASE WHEN c BETWEEN '0' AND '9'
    THEN ascii(c) - 48 ELSE ascii(c) - 55 END)::HUGEINT)),
    lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"""
_FIT = f"""CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(m, '.'),
        lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(ltrim(p, '0') AS INT), 0) <= 255))
    WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND {_LUHN}
    WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
    WHEN 'iban' THEN {_MOD97}
    ELSE 'TRWAGMYFPDXBNJZSQVHLCKE'[substr(m, 1, 8)::INT % 23 + 1] = substr(m, 9, 1) END"""

PII = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_found(*x) for x in _PII)}),
placed AS (SELECT doc_id, text, k, kind, base, context, ms[i] AS m,
    (list_sum(list_transform(gaps[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
    FROM found, unnest(range(1, len(ms) + 1)) r(i)),
checked AS (SELECT *, s + length(m) AS e, regexp_replace(m, '[^0-9]', '', 'g') AS digits,
    replace(m, ' ', '') AS bare FROM placed),
scored AS (SELECT doc_id, k, kind, s, e, round(greatest(0, least(1, base
        + CASE WHEN regexp_matches(near, context) THEN 0.3 ELSE 0 END
        - CASE WHEN regexp_matches(near, 'example only|sample|dummy|version|placeholder')
            THEN 0.3 ELSE 0 END)), 2)::DOUBLE AS score
    FROM (SELECT *, lower(substr(text, greatest(s - 40, 0) + 1, s - greatest(s - 40, 0)) || ' '
        || substr(text, e + 1, 40)) AS near FROM checked WHERE {_FIT})),
kept AS (SELECT *, kind || ':' || s || ':' || e AS span FROM scored WHERE k < 4 OR score >= 0.5)
SELECT doc_id, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip,
    count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
    sha256(coalesce(string_agg(span, ',' ORDER BY s, k) FILTER (k < 4), '')) AS base_sha256,
    coalesce(string_agg(span, ',' ORDER BY s, k), '') AS spans,
    coalesce(string_agg(score::VARCHAR, ',' ORDER BY s, k), '') AS scores
FROM d LEFT JOIN kept USING (doc_id) GROUP BY doc_id"""

#: Every document against every order of the filters.
AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic
    FROM labels GROUP BY doc_id),
failed AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t)
        THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS f
    FROM d LEFT JOIN lab USING (doc_id)),
sets AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS n_good,
    count(*) FILTER (toxic) AS n_toxic FROM failed GROUP BY part, f),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letter a, letter b, letter c, letter d, letter e
    WHERE length(a.x || b.x || c.x || d.x || e.x) = 5
        AND len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, filter_order[step:step] AS own,
    filter_order[1:step - 1] AS earlier
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
judged AS (SELECT part, filter_order, step, own, n, n_good, n_toxic, f,
    contains(f, own) AS hit, length(f) > length(translate(f, earlier, '')) AS gone
    FROM sets, steps),
counted AS (SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (f = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(n_good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost,
    coalesce(sum(n_toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost
    FROM judged GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted"""

ORACLE = {"op2_chat": CHAT, "op6_pii": PII, "op7_quality_rules": QUALITY,
          "op11_filter_audit": AUDIT}
