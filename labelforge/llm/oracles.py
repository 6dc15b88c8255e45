"""DuckDB SQL for the queries whose whole result SQL can express.

Token counts, the URL verdict, packing and the lattice score need a tokenizer or a trained
model; ``tests/llm`` holds those against brute force.
"""

from __future__ import annotations

#: every word of every document with its place: doc_id, i (from 1), w
_WORDS = r"""
worded AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS ws FROM documents),
placed AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM worded)
"""

SUBSTRING_DEDUP = f"""
WITH {_WORDS},
windows AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS seq
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM worded)),
starts AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY seq) AS least FROM windows)
    WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + d AS i FROM starts, range(13) AS r(d)),
marked AS (SELECT p.doc_id, p.i, p.w, g.i IS NOT NULL AS removed FROM placed p LEFT JOIN gone g USING (doc_id, i)),
kept AS (
    SELECT doc_id, count(*) FILTER (WHERE removed) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT removed) AS rest
    FROM marked GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM worded LEFT JOIN kept USING (doc_id)
"""

QUALITY_RULES = rf"""
WITH {_WORDS},
windows AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS seq
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM worded)),
repeats AS (
    SELECT doc_id, count(DISTINCT i + d) AS n
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, seq) AS times FROM windows), range(3) AS r(d)
    WHERE times > 1 GROUP BY doc_id),
split AS (
    SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls
    FROM documents),
lines AS (
    SELECT doc_id, host, text, length(line) AS chars,
           trim(regexp_replace(regexp_replace(lower(line), '[ \t-\r]+', ' ', 'g'), '[0-9]', '0', 'g'), ' ') AS line
    FROM (SELECT doc_id, host, text, unnest(ls) AS line FROM split)),
hosts AS (SELECT host, count(DISTINCT text) AS texts FROM split GROUP BY host),
common AS (
    SELECT host, line, owner
    FROM (SELECT host, line, count(DISTINCT text) AS held, min(doc_id) AS owner FROM lines GROUP BY host, line) JOIN hosts USING (host)
    WHERE held > 20 AND held > texts * 0.02::DOUBLE),
own AS (
    SELECT doc_id, sum(chars) AS chars, coalesce(sum(chars) FILTER (WHERE c.line IS NOT NULL AND c.owner <> doc_id), 0) AS removed
    FROM lines LEFT JOIN common c USING (host, line) GROUP BY doc_id),
base AS (
    SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
           (length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM worded w JOIN split USING (doc_id) LEFT JOIN repeats USING (doc_id)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(chars - removed >= chars * 0.3::DOUBLE, TRUE) AS kept
FROM failed LEFT JOIN own USING (doc_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH texts AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
items AS (SELECT item_id::VARCHAR AS item_id, {_ALNUM} AS ws FROM benchmark),
sized AS (SELECT item_id, ws, least(len(ws), 10) AS size FROM items WHERE len(ws) > 0),
passages AS (
    SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS seq
    FROM (SELECT item_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM sized)),
windows AS (
    SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS seq
    FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM texts, (SELECT DISTINCT size FROM sized))),
found AS (SELECT doc_id, size, i, item_id FROM windows JOIN passages USING (size, seq)),
hit AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT doc_id, size, i FROM found)) GROUP BY doc_id),
held AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed
    FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)
"""

NGRAM_JOIN = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS ws
    FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                        ELSE list_sort(list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)])) END AS grams
    FROM worded),
named AS (SELECT doc_id, len(grams) AS n, CASE WHEN len(grams) > 0 THEN min(doc_id) OVER (PARTITION BY grams) ELSE doc_id END AS class FROM sets),
grams AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets SEMI JOIN (SELECT DISTINCT class FROM named) c ON doc_id = c.class),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(class, other) AS (
    SELECT DISTINCT class, class FROM named
    UNION
    SELECT r.class, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
roots AS (SELECT class, min(other) AS component_id FROM reach GROUP BY class)
SELECT doc_id, n::BIGINT AS n_shingles, component_id FROM named JOIN roots USING (class)
"""

CHAT_FORMAT = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -1, turn, role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)),
sized AS (
    SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS text_chars,
           length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\-')) AS role_chars FROM said),
agg AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
           coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
           sum(length('<|im_start|>') + role_chars + 1 + text_chars + length('<|im_end|>') + 1) AS formatted_chars
    FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(learned)::BIGINT AS loss_chars,
       sha256(learned) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM agg
"""

SUFFIX_DEDUP = """
WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
bytes AS (
    SELECT doc_id, i, hex(h[i + 1:i + 1]) AS x, CASE WHEN i + 100 <= octet_length(h) THEN md5(h[i + 1:i + 100]) END AS seq
    FROM (SELECT doc_id, h, unnest(range(octet_length(h))) AS i FROM raw)),
ranked AS (SELECT doc_id, i, x, seq IS NOT NULL AND row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) > 1 AS later FROM bytes),
marked AS (
    SELECT doc_id, i, x, max(later::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) = 1 AS removed
    FROM ranked),
runs AS (SELECT *, removed AND NOT lag(removed, 1, FALSE) OVER (PARTITION BY doc_id ORDER BY i) AS opens FROM marked),
kept AS (
    SELECT doc_id, count(*) FILTER (WHERE removed) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
           string_agg(x, '' ORDER BY i) FILTER (WHERE NOT removed) AS rest
    FROM runs GROUP BY doc_id)
SELECT doc_id, octet_length(h)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(rest, ''))) AS kept_sha256
FROM raw LEFT JOIN kept USING (doc_id)
"""

def crc32(text: str) -> str:
    """Unsigned checksum of a string, bit by bit over its UTF-8 bytes."""
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || hex(encode({text})[i + 1:i + 1]))::BIGINT)"
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {bits}))"


SPELLING_VARIANTS = f"""
WITH RECURSIVE runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS keyed, run, count(*) AS k
    FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
          FROM documents)
    WHERE length(run) >= 7 GROUP BY ALL),
summed AS (SELECT run, k, {crc32('keyed')} AS h FROM runs),
words AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM summed),
v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
gone AS MATERIALIZED (SELECT word, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
    SELECT a.word, b.word AS other FROM gone a JOIN gone b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT g.word, v.word FROM gone g JOIN v ON v.word = g.rest
    UNION SELECT v.word, g.word FROM gone g JOIN v ON v.word = g.rest),
ranked AS (SELECT near.word, other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
                  row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS r FROM near JOIN v o ON o.word = other),
told AS MATERIALIZED (
    SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * v.n THEN other END AS form, CASE WHEN other_n >= 10 * v.n THEN other_n END AS form_n
    FROM v LEFT JOIN ranked ON ranked.word = v.word AND r = 1),
paths(word, stop) AS (SELECT word, word FROM told UNION ALL SELECT p.word, t.form FROM paths p JOIN told t ON t.word = p.stop WHERE t.form IS NOT NULL),
roots AS (SELECT p.word, p.stop AS root FROM paths p JOIN told t ON t.word = p.stop WHERE t.form IS NULL)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM told JOIN roots USING (word)
"""


def _leaf(n_chars: str) -> str:
    field = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    return "sha256(" + " || ".join(field(x) for x in ("doc_id::VARCHAR", "source", "lang", n_chars, "text")) + ")"


def _levels(name: str, leaves: str) -> str:
    """CTE (tree, level, pos, hash, total): all levels above ``leaves`` (tree, pos, hash, total)."""
    return f"""{name}(tree, level, pos, hash, total) AS (
    SELECT tree, 0, pos, hash, total FROM {leaves}
    UNION ALL
    SELECT tree, level + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), (total + 1) // 2 FROM {name} WHERE total > 1 GROUP BY tree, level, pos // 2, total)"""


def _climb(name: str, start: str, levels: str) -> str:
    """CTE (id, tree, level, pos, folded, proof): every row of ``start`` (id, tree, pos, folded, proof) up to its root."""
    return f"""{name}(id, tree, level, pos, folded, proof, total) AS (
    SELECT id, s.tree, 0, s.pos, folded, proof, total FROM {start} s JOIN {levels} l ON l.tree = s.tree AND l.level = 0 AND l.pos = s.pos
    UNION ALL
    SELECT id, c.tree, c.level + 1, c.pos // 2, sha256(CASE WHEN c.pos % 2 = 1 THEN sib.hash || folded ELSE folded || coalesce(sib.hash, '') END),
           proof || coalesce(sib.hash, ''), (c.total + 1) // 2
    FROM {name} c LEFT JOIN {levels} sib ON sib.tree = c.tree AND sib.level = c.level AND sib.pos = xor(c.pos, 1::BIGINT) WHERE c.total > 1)"""


MERKLE_MANIFEST = f"""
WITH RECURSIVE hashed AS (
    SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '-') AS tree, {_leaf('n_chars::VARCHAR')} AS leaf,
           CASE WHEN {crc32('doc_id::VARCHAR')} % 7 = 0 THEN {_leaf('(n_chars + 1)::VARCHAR')} ELSE {_leaf('n_chars::VARCHAR')} END AS start FROM documents),
leaves AS MATERIALIZED (SELECT *, leaf AS hash, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS total FROM hashed),
{_levels('lv', 'leaves')},
subs AS MATERIALIZED (SELECT tree AS name, hash, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS total FROM lv WHERE total = 1),
{_levels('tv', 'subs')},
low AS (SELECT id, tree, pos, start AS folded, '' AS proof FROM leaves),
{_climb('up', 'low', 'lv')},
high AS (SELECT id, '' AS tree, subs.pos, folded, proof FROM up JOIN subs ON subs.name = up.tree WHERE up.total = 1),
{_climb('top', 'high', 'tv')}
SELECT doc_id, leaf, subs.hash AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM top JOIN leaves USING (id) JOIN subs ON subs.name = leaves.tree, (SELECT hash AS root FROM tv WHERE total = 1) WHERE top.total = 1
"""

ORACLES = {
    "op3_ngram_join": NGRAM_JOIN,
    "op4_substring_dedup": SUBSTRING_DEDUP,
    "op5_quality_rules": QUALITY_RULES,
    "op7_decontamination": DECONTAMINATION,
    "op9_chat_format": CHAT_FORMAT,
    "op10_suffix_array_dedup": SUFFIX_DEDUP,
    "op12_spelling_variants": SPELLING_VARIANTS,
    "op13_merkle_manifest": MERKLE_MANIFEST,
}
