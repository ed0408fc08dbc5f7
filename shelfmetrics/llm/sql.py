"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

ORACLE = {
    # Texts are compared unescaped, and each example repeats its prefix; the escapes add one character for each of \\ # < : in texts and roles.
    "op6_chat_format": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
             f AS (SELECT *, 4 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + 2 + length(regexp_replace(text, '([\\#<:])', '\\\1', 'g')) + 9 AS chars,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM t),
             p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS so_far, max(place) OVER (PARTITION BY conv_id) AS last FROM f)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(so_far) FILTER (role = 'assistant' OR place = last) AS BIGINT) AS formatted_chars
        FROM p GROUP BY conv_id""",
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    # One row of the recursion per turn: the shard whose turn it is takes the first slot of its walk that nobody owns.
    "op8_sharding": """
        WITH RECURSIVE walk AS (
            SELECT k, 'shard-' || lpad(CAST(k AS VARCHAR), 2, '0') AS shard,
                   CAST('0x' || substr(md5('offset shard-' || lpad(CAST(k AS VARCHAR), 2, '0')), 1, 8) AS BIGINT) % 2503 AS first,
                   CAST('0x' || substr(md5('stride shard-' || lpad(CAST(k AS VARCHAR), 2, '0')), 1, 8) AS BIGINT) % 2502 + 1 AS stride
            FROM range(24) r(k)),
        turns AS (
            SELECT 0 AS turn, (SELECT first FROM walk WHERE k = 0) AS slot, [(SELECT first FROM walk WHERE k = 0)] AS taken
            UNION ALL
            SELECT turn + 1, slot, list_append(taken, slot)
            FROM (SELECT t.turn, t.taken,
                         (SELECT arg_min((w.first + j * w.stride) % 2503, j) FROM range(2503) s(j)
                          WHERE NOT list_contains(t.taken, (w.first + j * w.stride) % 2503)) AS slot
                  FROM turns t JOIN walk w ON w.k = (t.turn + 1) % 24 WHERE t.turn < 2502)),
        owner AS (SELECT t.slot, w.shard FROM turns t JOIN walk w ON w.k = t.turn % 24)
        SELECT d.doc_id, o.slot, o.shard
        FROM documents d JOIN owner o
          ON o.slot = CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % 2503""",
    # Words one edit apart are found by what is left without one letter: the same at the same place, or the shorter word itself.
    "op11_spelling_grams": r"""
        WITH RECURSIVE crc AS (SELECT [list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) FOR n IN range(256)] AS t),
             runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
             k AS (SELECT run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS name FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
             h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, [CAST(CAST('0x' || x AS UTINYINT) AS BIGINT) FOR x IN regexp_extract_all(hex(encode(name)), '..')]),
                                                  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM k, crc),
             w AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
                   FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
             d AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
             p AS (SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
                   UNION SELECT d.word, w.word, w.n FROM d JOIN w ON w.word = d.rest
                   UNION SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = d.rest),
             b AS (SELECT word, count(*) AS n_near, max(m) AS m FROM p GROUP BY word),
             f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n FROM w LEFT JOIN b USING (word)),
             o AS (SELECT f.*, x.form FROM f LEFT JOIN (SELECT word, m, min(other) AS form FROM p GROUP BY word, m) x ON x.word = f.word AND x.m = f.form_n),
             r AS (SELECT word, word AS root, form AS following FROM o UNION ALL SELECT r.word, r.following, o.form FROM r JOIN o ON o.word = r.following)
        SELECT o.word, form, root, n, n_near, form_n FROM o JOIN r ON r.word = o.word AND r.following IS NULL""",
    # crc32 over the digits of an id by the table of the reflected polynomial; nodes are named by the joined digests of their turns.
    "op13_prefix_trie": """
        WITH crc AS (SELECT [list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) FOR n IN range(256)] AS t),
             o AS (SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, length(coalesce(text, '')) AS chars,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
                   FROM conversations WHERE conv_id IS NOT NULL),
             c AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
                          xor(list_reduce(list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
                                          lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 6 AS h
                   FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc),
             r AS (SELECT c.conv_id, o.place, o.id, o.chars FROM c JOIN o ON o.conv_id = c.base AND o.place <= h
                   UNION ALL SELECT conv_id, place, id, chars FROM c JOIN o USING (conv_id) WHERE place > h),
             d AS (SELECT conv_id, id, chars, row_number() OVER w AS depth, string_agg(id, '') OVER w AS node FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
             m AS (SELECT conv_id, node, depth, chars FROM d UNION ALL SELECT conv_id, '', 0, 0 FROM c),
             n AS (SELECT node, any_value(depth) AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs FROM m GROUP BY node),
             k AS (SELECT left(node, 32 * (depth - 1)) AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
             s AS (SELECT left(node, 32 * a.up) AS node, sum(CAST(n_children IS NULL AS INT)) AS n_leaves, sum((n_convs - 1) * chars) AS saved
                   FROM n LEFT JOIN k USING (node), LATERAL (SELECT unnest(range(depth + 1)) AS up) a GROUP BY 1),
             e AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ends
                   FROM (SELECT conv_id, max_by(node, depth) AS node FROM m GROUP BY conv_id) GROUP BY node)
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
               CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
        FROM n LEFT JOIN k USING (node) JOIN s USING (node) LEFT JOIN e USING (node)
             LEFT JOIN n p ON p.node = left(n.node, 32 * (n.depth - 1)) AND n.depth > 0""",
}
