"""DuckDB SQL for the operators of this subpackage that SQL can express."""

from __future__ import annotations

#: Table of the usual CRC-32, from its rule.
_CRC_TABLE = """crc_table AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM (SELECT unnest(range(256)) AS i))"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, where ``crc_table`` is in scope."""
    found = f"list_transform(range(octet_length(encode({text}))), lambda k: CAST('0x' || substr(hex(encode({text})), 2 * k + 1, 2) AS BIGINT))"
    return f"xor(list_reduce([4294967295] || {found}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAF = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"

MANIFEST = f"""
WITH RECURSIVE {_CRC_TABLE},
hashed AS (
    SELECT doc_id, lang, {_LEAF.format("text")} AS leaf,
        CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_LEAF.format(_LOWER.format("text"))} END AS told
    FROM documents, crc_table),
leaves AS (
    SELECT doc_id, leaf, coalesce(told, leaf) AS told, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
    FROM hashed),
tree AS (
    SELECT g, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM leaves
    UNION ALL
    SELECT g, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM tree WHERE n > 1 GROUP BY g, level, i // 8, n),
roots AS (SELECT g, level, h FROM tree WHERE n = 1),
upper AS (
    SELECT 0 AS level, g AS i, h, count(*) OVER () AS n FROM roots
    UNION ALL
    SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM upper WHERE n > 1 GROUP BY level, i // 8, n),
steps AS (
    SELECT l.g, l.i AS leaf_i, a.level, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < a.i), '') AS l, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > a.i), '') AS r
    FROM leaves l JOIN tree a ON a.g = l.g AND a.n > 1 AND a.i = l.i // CAST(pow(8, a.level) AS BIGINT)
    JOIN tree s ON s.g = a.g AND s.level = a.level AND s.i // 8 = a.i // 8
    GROUP BY l.g, l.i, a.level),
upper_steps AS (
    SELECT r.g, r.level + a.level AS level, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < a.i), '') AS l, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > a.i), '') AS r
    FROM roots r JOIN upper a ON a.n > 1 AND a.i = r.g // CAST(pow(8, a.level) AS BIGINT)
    JOIN upper s ON s.level = a.level AND s.i // 8 = a.i // 8
    GROUP BY r.g, r.level, a.level),
paths AS (
    SELECT g, leaf_i, list(struct_pack(l := l, r := r) ORDER BY level) AS path
    FROM (FROM steps UNION ALL SELECT l.g, l.i, u.level, u.l, u.r FROM leaves l JOIN upper_steps u USING (g)) GROUP BY g, leaf_i),
proofs AS (
    SELECT l.*, coalesce(path, []) AS path, r.h AS subroot, (SELECT h FROM upper WHERE n = 1) AS root
    FROM leaves l JOIN roots r USING (g) LEFT JOIN paths p ON p.g = l.g AND p.leaf_i = l.i),
folded AS (
    SELECT *, list_reduce([told] || list_transform(path, lambda p: p.l || '|' || p.r), lambda a, p: sha256(split_part(p, '|', 1) || a || split_part(p, '|', 2))) AS folded_root FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda p: p.l || p.r), '')) AS proof_sha256, folded_root,
    CAST(coalesce(list_sum(list_transform(path, lambda p: length(p.l) + length(p.r))), 0) // 64 AS INTEGER) AS n_siblings, folded_root = root AS verified
FROM folded
"""

VARIANTS = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
    SELECT doc_id, run, count(*) AS c
    FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, {_LOWER.format("unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+'))")} AS run FROM documents)
    WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, c, {_crc32("doc_id || ':' || run")} AS h FROM runs, crc_table),
words AS (
    SELECT word, CAST(sum(c) AS BIGINT) AS n
    FROM (SELECT c, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
skips AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM skips a JOIN skips b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION
    SELECT a.word, s.word, s.n FROM words a JOIN skips s ON a.word = s.rest
    UNION
    SELECT s.word, a.word, a.n FROM words a JOIN skips s ON a.word = s.rest),
near AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS best, max(other_n) AS best_n FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n FROM words w LEFT JOIN near USING (word)),
chains AS (
    SELECT word, word AS root FROM forms WHERE form IS NULL
    UNION ALL
    SELECT f.word, c.root FROM chains c JOIN forms f ON f.form = c.word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN chains USING (word)
"""
