"""DuckDB twins of the named queries, where SQL can say them."""

from __future__ import annotations

from staywise.llm import disclosure, license_scan, quality_rules

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_STOP = _quoted(sorted({v for w in quality_rules.STOP_WORDS for v in (w, w.capitalize())}))
_LIMITS = {r.ratio: (r.low, r.high) for r in quality_rules.DEFAULT_RULES}

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
grams AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams),
again AS (SELECT r, count(DISTINCT p) AS n FROM twice, unnest([i, i + 1, i + 2]) AS u(p) WHERE c > 1 GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM w, unnest(string_split(t, chr(10))) AS u(l)
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(lines.dup, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
             len(list_filter(ws, lambda x: x IN ({_STOP}))) AS n_stop, coalesce(lines.n, 0) AS n_lines
      FROM w LEFT JOIN again USING (r) LEFT JOIN lines USING (r)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND word_chars / n_words BETWEEN {_LIMITS["mean_word_length"][0]} AND {_LIMITS["mean_word_length"][1]}
       AND n_symbols / n_words BETWEEN {_LIMITS["symbols_per_word"][0]} AND {_LIMITS["symbols_per_word"][1]}
       AND n_stop / n_words BETWEEN {_LIMITS["stop_word_share"][0]} AND {_LIMITS["stop_word_share"][1]}
       AND n_dup_lines / n_lines BETWEEN {_LIMITS["dup_line_share"][0]} AND {_LIMITS["dup_line_share"][1]} AS kept
FROM j
"""

_NORMAL = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_NORMAL} AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_NORMAL} AS ws FROM benchmark),
windows AS (SELECT DISTINCT item, least(13, len(ws)) AS n, array_to_string(ws[i : i + 12], ' ') AS g
            FROM b, unnest(range(1, greatest(2, len(ws) - 11))) AS u(i) WHERE len(ws) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT r, i, n, array_to_string(ws[i : i + n - 1], ' ') AS g FROM d, lengths, unnest(range(1, len(ws) - n + 2)) AS u(i)),
hits AS (SELECT r, i, n, item FROM spots JOIN windows USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(p) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS g FROM d, unnest(range(1, greatest(2, len(ws) - 1))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
least AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.x = d.doc_id
"""

CHAT = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (
    SELECT *, length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?(?:s>|INST\]|ROLE\]))', '\1\\\2', 'g')) AS body,
           length(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?(?:s>|INST\]|ROLE\]))', '\1\\\2', 'g')) AS name
    FROM said)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(7 + body + CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 15 ELSE 15 + name END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

_TEMPLATES = ", ".join(f"('{n}', '{t}')" for n, t in license_scan.TEMPLATES)
_FILE = r"regexp_matches(regexp_extract(path, '([^/]*)$', 1), '" + license_scan.LICENCE_NAME + "')"

LICENCES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(text, '') AS t, coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS top FROM documents),
p AS (SELECT r, doc_id, t, CASE WHEN regexp_matches(string_split(t, chr(10))[1], '{license_scan.CUE}') AND length(text) < 400
                        THEN top || '/LICENSE.' || doc_id ELSE top || '/' || (doc_id % 100) || '/' || doc_id || '.txt' END AS path FROM d),
f AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir FROM p),
said AS (SELECT r, trim(l) AS line FROM f, unnest(string_split(t, chr(10))) AS u(l) WHERE regexp_matches(l, '{license_scan.CUE}')),
lines AS (SELECT line, count(*) AS n FROM said GROUP BY line),
terms AS (SELECT line, n, tok, count(*) AS tf FROM lines, unnest(regexp_extract_all(lower(line), '{license_scan.TOKEN}')) AS u(tok) GROUP BY ALL),
rarity AS (SELECT tok, sum(n) AS df FROM terms GROUP BY tok),
total AS (SELECT coalesce(sum(n), 0) AS a FROM lines),
w AS (SELECT line, tok, tf * (ln((1 + a) / (1 + df)) + 1) AS w FROM terms JOIN rarity USING (tok), total),
own AS (SELECT licence, tok, count(*) AS tf FROM (VALUES {_TEMPLATES}) AS v(licence, body), unnest(regexp_extract_all(lower(body), '{license_scan.TOKEN}')) AS u(tok) GROUP BY ALL),
v AS (SELECT licence, tok, tf * (ln((1 + a) / (1 + coalesce(df, 0))) + 1) AS v FROM own LEFT JOIN rarity USING (tok), total),
cosine AS (SELECT line, licence, round(sum(w * v) / (any_value(la) * any_value(lb)), 6) AS score
           FROM w JOIN v USING (tok) JOIN (SELECT line, sqrt(sum(w * w)) AS la FROM w GROUP BY line) USING (line)
           JOIN (SELECT licence, sqrt(sum(v * v)) AS lb FROM v GROUP BY licence) USING (licence) GROUP BY line, licence),
stated AS (SELECT r, licence, score FROM said JOIN cosine USING (line) WHERE score >= 0.75
           QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, licence) = 1),
grants AS (SELECT dir AS up, licence AS g_licence, score AS g_score, path AS g_path FROM stated JOIN f USING (r) WHERE {_FILE}
           QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) = 1),
dirs AS (SELECT DISTINCT dir FROM f),
nearest AS (SELECT * FROM dirs JOIN grants ON up = '' OR starts_with(dir || '/', up || '/')
            QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(up) DESC) = 1)
SELECT doc_id, path, coalesce(licence, g_licence) AS licence,
       CASE WHEN licence IS NOT NULL AND {_FILE} THEN 'file' WHEN licence IS NOT NULL THEN 'header' WHEN g_licence IS NOT NULL THEN 'inherited' END AS how,
       coalesce(score, g_score) AS score, CASE WHEN licence IS NOT NULL THEN path ELSE g_path END AS from_path
FROM f LEFT JOIN stated USING (r) LEFT JOIN nearest USING (dir)
"""

_CRC = """list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
                       lambda a, o: CASE WHEN o >= 0 THEN xor(a, o) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)"""

TRIE = f"""
WITH said AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d
              FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS p FROM said),
convs AS (SELECT c, xor({_CRC}, 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id AS c FROM said)),
turns AS (SELECT c, p, d, n FROM convs JOIN t ON conv_id = c - c % 100 AND p <= h UNION ALL SELECT c, p, d, n FROM convs JOIN t ON conv_id = c AND p > h),
seqs AS (SELECT c, coalesce(list(d ORDER BY p) FILTER (d IS NOT NULL), []) AS ds, list(n ORDER BY p) AS ns FROM convs LEFT JOIN turns USING (c) GROUP BY c),
paths AS (SELECT c, k AS depth, len(ds) AS last, array_to_string(ds[1 : k], '') AS id, CASE WHEN k > 0 THEN array_to_string(ds[1 : k - 1], '') END AS up,
                 CASE WHEN k > 0 THEN ns[k] ELSE 0 END AS chars FROM seqs, unnest(range(0, len(ds) + 1)) AS u(k)),
nodes AS (SELECT id, any_value(up) AS up, any_value(depth) AS depth, any_value(chars) AS chars, min(c) AS conv_id, count(*) AS n_convs,
                 sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last = depth), '')) AS ends_sha256 FROM paths GROUP BY id),
kids AS (SELECT up AS id, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
own AS (SELECT *, coalesce(n_children, 0) AS kids, (n_convs - 1) * chars AS saved FROM nodes LEFT JOIN kids USING (id)),
below AS (SELECT a.id, count(*) FILTER (v.kids = 0) AS n_leaves, CAST(sum(v.saved) AS BIGINT) AS saved_tokens FROM own AS a JOIN own AS v ON starts_with(v.id, a.id) GROUP BY a.id)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.kids AS n_children, n_leaves, saved_tokens, o.ends_sha256
FROM own AS o JOIN below USING (id) LEFT JOIN nodes AS p ON p.id = o.up
"""

_KINDS = (
    ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "true", f"translate(v, '{_UPPER}', '{_UPPER.lower()}')"),
    ("ip", "[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) > 255)) = 0", "v"),
    ("card", "[0-9](?:[\\x20-]?[0-9])+", """length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
        CASE WHEN (length(digits) - i) % 2 = 0 THEN CAST(digits[i] AS INT) WHEN CAST(digits[i] AS INT) < 5 THEN 2 * CAST(digits[i] AS INT) ELSE 2 * CAST(digits[i] AS INT) - 9 END)) % 10 = 0""", "digits"),
    ("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", "length(digits) BETWEEN 10 AND 15", "digits"),
)
_FOUND = " UNION ALL ".join(
    f"""SELECT r, {rank} AS rank, '{kind}' AS kind, p - length(v) AS start, p AS "end", '{kind}:' || {entity} AS entity, before, after
    FROM (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS digits, sum(length(before) + length(v)) OVER (PARTITION BY r ORDER BY i) AS p
          FROM (SELECT r, i, ms[i] AS v, gs[i] AS before, gs[i + 1] AS after
                FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gs FROM d), unnest(range(1, len(ms) + 1)) AS u(i)))
    WHERE {test}"""
    for rank, (kind, pattern, test, entity) in enumerate(_KINDS)
)
_RULE = disclosure.Disclosure()

PRIVATE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_FOUND}),
sides AS (SELECT r, entity, true AS last, CASE WHEN length(before) > {disclosure.REACH} THEN regexp_replace(right(before, {disclosure.REACH}), '^[^ 	-
]*', '') ELSE before END AS c, start AS base FROM found
          UNION ALL SELECT r, entity, false, CASE WHEN length(after) > {disclosure.REACH} THEN regexp_replace(left(after, {disclosure.REACH}), '[^ 	-
]*$', '') ELSE after END, "end" FROM found),
cut AS (SELECT *, regexp_extract_all(c, '[^ 	-
]+') AS ws, regexp_split_to_array(c, '[^ 	-
]+') AS gs FROM sides),
placed AS (SELECT r, entity, ws[i] AS w, CASE WHEN last THEN base - length(c) ELSE base END
                  + list_sum(list_transform(range(1, i + 1), lambda k: length(gs[k]) + length(ws[k]))) - length(ws[i]) AS s
           FROM cut, unnest(range(1, len(ws) + 1)) AS u(i) WHERE CASE WHEN last THEN i > len(ws) - {disclosure.WINDOW} ELSE i <= {disclosure.WINDOW} END),
near AS (SELECT DISTINCT r, entity, translate(regexp_extract(w, '{disclosure.TERM.replace("'", "''")}', 1), '{_UPPER}', '{_UPPER.lower()}') AS term,
                CAST(s + length(regexp_extract(w, '^([^\p{{L}}\d@]*)', 1)) AS BIGINT) AS start FROM placed WHERE regexp_matches(w, '{disclosure.TERM.replace("'", "''")}')),
pairs AS (SELECT entity, term, left(term, {_RULE.letters}) AS general, count(*) AS near, count(DISTINCT t) AS texts FROM near JOIN d USING (r) GROUP BY ALL),
around AS (SELECT entity, sum(near) AS around FROM pairs GROUP BY entity),
spoken AS (SELECT translate(regexp_extract(w, '{disclosure.TERM.replace("'", "''")}', 1), '{_UPPER}', '{_UPPER.lower()}') AS term FROM d, unnest(regexp_extract_all(t, '[^ 	-
]+')) AS u(w)
           WHERE regexp_matches(w, '{disclosure.TERM.replace("'", "''")}')),
counts AS (SELECT term, count(*) AS c FROM spoken GROUP BY term),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM spoken),
telling AS (SELECT term, entity FROM pairs JOIN around USING (entity) JOIN counts USING (term), total
            WHERE texts >= {_RULE.support} AND around < n AND round(log2(near * n / (c * around)) / log2(n / around), 6) >= {_RULE.threshold}),
terms AS (SELECT DISTINCT r, 4 AS rank, 'term' AS kind, start, start + length(term) AS "end" FROM near JOIN telling USING (term, entity)),
spans AS (SELECT r, rank, kind, start, "end" FROM found UNION ALL SELECT * FROM terms),
told AS (SELECT r, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
                count(*) FILTER (kind = 'term') AS n_terms, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT), ',' ORDER BY start, rank) FILTER (rank < 4) AS base,
                string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT), ',' ORDER BY start, rank) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_terms, 0) AS n_terms
FROM d LEFT JOIN told USING (r)
"""

PHRASES = rf"""
WITH RECURSIVE pieces AS (
    SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws
    FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents), unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS u(p)),
f AS (SELECT lang, array_to_string(ws[i : i + k - 1], ' ') AS phrase, k AS words, count(*) AS f FROM pieces, unnest(range(1, 6)) AS x(k), unnest(range(1, len(ws) - k + 2)) AS y(i) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY lang),
cand AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 100),
cuts AS (SELECT c.lang, c.phrase, c.a, k, h.f AS l, t.f AS r, n, CAST(1000 * CAST(a AS HUGEINT) * n // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
         FROM cand AS c, unnest(range(1, c.words)) AS u(k) JOIN f AS h ON h.lang = c.lang AND h.phrase = array_to_string(w[1 : k], ' ')
         JOIN f AS t ON t.lang = c.lang AND t.phrase = array_to_string(w[k + 1 : c.words], ' ') JOIN total ON total.lang = c.lang),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS whole FROM cand, unnest(range(2, words)) AS x(m), unnest(range(1, words - m + 2)) AS y(i) GROUP BY ALL),
e AS (SELECT lang, phrase, a, array_to_string(w[1 : 4], ' ') AS src, array_to_string(w[2 : 5], ' ') AS dst FROM cand WHERE words = 5),
steps AS (SELECT v.lang, i.phrase AS before, o.phrase AS after FROM cand AS v JOIN e AS i ON i.lang = v.lang AND i.dst = v.phrase AND i.a = v.a JOIN e AS o ON o.lang = v.lang AND o.src = v.phrase AND o.a = v.a
          WHERE words = 4 AND i.phrase <> o.phrase),
walk AS (SELECT lang, phrase, phrase AS seen, 0 AS k FROM e UNION ALL SELECT w.lang, w.phrase, after, k + 1 FROM walk AS w JOIN steps AS s ON s.lang = w.lang AND s.before = w.seen),
ahead AS (SELECT lang, phrase, max(k) AS ahead, max_by(seen, k) AS last FROM walk GROUP BY ALL),
path AS (SELECT lang, phrase, CAST(max(ahead) OVER (PARTITION BY lang, last) + 5 AS BIGINT) AS path_words FROM ahead),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
           FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE whole IS NULL OR whole < a)
SELECT lang, rank, phrase, a, l, r, n, score, path_words FROM ranked LEFT JOIN path USING (lang, phrase) WHERE rank <= 2000
"""
