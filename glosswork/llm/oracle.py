"""SQL for the queries that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op10_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(n) AS text_sha256
FROM d WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id)
"""

# The template, written anew: `<turn>` role, newline, text, `</turn>`, newline, where
# `&` and `<` of texts are replaced.
ORACLE["op8_chat_format"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
     e AS (SELECT *, length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) AS n,
                  length(replace(replace(role, '&', '&amp;'), '<', '&lt;')) AS r FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(6 + r + 1 + n + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLE["op1_jaccard_join"] = r"""
WITH RECURSIVE
  w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') AS words FROM documents),
  s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
              ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS sh FROM w),
  e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS shingle FROM s),
  l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
        GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
  both_ways AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.low, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) m ON m.a = s.doc_id
"""

# CRC-32, bytewise by a table of 256 entries that the rule makes.
CRC_TABLE = """crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM range(256) r(i)))"""


def _crc(codes: str) -> str:
    """SQL for the checksum of a list of byte values; ``t`` is the table."""
    step = "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), {step}))"


def _ascii(text: str) -> str:
    return f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"


ORACLE["op11_merkle_manifest"] = f"""
WITH RECURSIVE {CRC_TABLE},
  d AS (SELECT *, CASE WHEN {_crc(_ascii("CAST(doc_id AS VARCHAR)"))} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut
        FROM documents, crc_table),
  h AS (SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
          || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
          || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text, cut FROM d),
  l AS MATERIALIZED (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,
          row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
          sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
          sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS suspect FROM h),
  nodes AS (SELECT s, 0 AS level, pos, leaf AS node, n FROM l
            UNION ALL SELECT s, level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (n + 2) // 3
            FROM nodes WHERE n > 1 GROUP BY s, level, pos // 3, n),
  subroots AS (SELECT s, node FROM nodes WHERE n = 1),
  tops AS (SELECT 0 AS level, s AS pos, node, count(*) OVER () AS n FROM subroots
           UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (n + 2) // 3
           FROM tops WHERE n > 1 GROUP BY level, pos // 3, n),
  steps AS (SELECT l.s, l.pos, m.level, coalesce(string_agg(node, '' ORDER BY m.pos) FILTER (m.pos < l.pos // CAST(3 ** m.level AS BIGINT)), '') AS before,
              coalesce(string_agg(node, '' ORDER BY m.pos) FILTER (m.pos > l.pos // CAST(3 ** m.level AS BIGINT)), '') AS after
            FROM l JOIN nodes m ON m.s = l.s AND m.n > 1 AND m.pos // 3 = l.pos // CAST(3 ** (m.level + 1) AS BIGINT)
            GROUP BY l.s, l.pos, m.level
            UNION ALL
            SELECT l.s, l.pos, 100 + m.level, coalesce(string_agg(node, '' ORDER BY m.pos) FILTER (m.pos < l.s // CAST(3 ** m.level AS BIGINT)), ''),
              coalesce(string_agg(node, '' ORDER BY m.pos) FILTER (m.pos > l.s // CAST(3 ** m.level AS BIGINT)), '')
            FROM l JOIN tops m ON m.n > 1 AND m.pos // 3 = l.s // CAST(3 ** (m.level + 1) AS BIGINT)
            GROUP BY l.s, l.pos, m.level),
  proofs AS MATERIALIZED (SELECT s, pos, list({{'a': before, 'z': after}} ORDER BY level) AS proof,
                          sha256(string_agg(before || after, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY s, pos),
  folded AS (SELECT s, pos, 0 AS k, suspect AS node, coalesce(proof, []) AS proof FROM l LEFT JOIN proofs USING (s, pos)
             UNION ALL SELECT s, pos, k + 1, sha256(proof[k + 1].a || node || proof[k + 1].z), proof FROM folded WHERE k < len(proof))
SELECT l.doc_id, l.leaf, u.node AS subroot, r.node AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
       f.node AS folded_root, f.node = r.node AS verified
FROM l JOIN subroots u USING (s) LEFT JOIN proofs p USING (s, pos)
JOIN folded f ON f.s = l.s AND f.pos = l.pos AND f.k = len(f.proof)
CROSS JOIN (SELECT node FROM tops WHERE n = 1) r
"""

# Bytes of a text: pairs of digits of its hexadecimal form.
_BYTES = "list_transform(range(1, strlen(b) + 1), lambda i: (instr('0123456789ABCDEF', substr(x, 2 * i - 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, 2 * i, 1)) - 1)"
ORACLE["op12_stratified_shards"] = f"""
WITH {CRC_TABLE},
  d AS (SELECT doc_id, source, coalesce(text, '') AS b, hex(coalesce(text, '')) AS x, md5('shards:' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS shuffled FROM documents),
  c AS (SELECT doc_id, source, shuffled, CAST(strlen(b) + 8 AS BIGINT) AS size, {_crc(_BYTES)} AS text_crc32 FROM d, crc_table),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY shuffled, doc_id NULLS FIRST, text_crc32, size) - 1 AS DOUBLE) AS place,
          CAST(count(*) OVER (PARTITION BY source) AS DOUBLE) AS of FROM c),
  g AS (SELECT *, row_number() OVER (ORDER BY (place + CAST(0.5 AS DOUBLE)) / of, source NULLS FIRST, shuffled, doc_id NULLS FIRST, text_crc32, size) - 1 AS pos,
          count(*) OVER () AS total FROM r),
  p AS (SELECT *, pos * 24 // total AS shard FROM g)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY pos) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""


def _edit(way: str, price: str, letter: str) -> str:
    """SQL for a way (six digits of cost, then the audit) with one more edit."""
    return f"lpad(CAST(CAST(left({way}, 6) AS INTEGER) + {price} AS VARCHAR), 6, '0') || substr({way}, 7) || '{letter}'"


def _best(*ways: str) -> str:
    return f"least({', '.join(ways)})"


_FREE = _best("w.b", "w.s", "w.a")  # whoever the user may follow
# Ways by the state of the grammar, row by row: b nothing said, s system, u user, a assistant.
ORACLE["op13_repair"] = f"""
WITH RECURSIVE {CRC_TABLE},
  k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
          coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
  l AS (SELECT *, {_crc(_ascii("name"))} % 20 AS lot FROM k, crc_table),
  m AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
          CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
          unnest(range(CASE WHEN lot = 3 THEN 2 ELSE 1 END)) AS copy FROM l WHERE lot <> 0),
  n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos, left(role, 1) AS i,
          rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM m),
  f AS MATERIALIZED (SELECT conv_id, turn, role, text, pos, i,
          CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
          lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair FROM n),
  g AS MATERIALIZED (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM f),
  walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS pos, '000000' AS b, CAST(NULL AS VARCHAR) AS s, '000002I' AS u, '000004II' AS a
           FROM (SELECT DISTINCT conv_id FROM f)
           UNION ALL
           SELECT conv_id, pos, b, s, u1, {_best("a0", _edit("u1", "2", "I"))} FROM (
             SELECT *, {_best("u0", _edit("a0", "2", "I"), _edit("b", "2", "I"), _edit("s", "2", "I"))} AS u1 FROM (
               SELECT w.conv_id, g.pos, {_edit("w.b", "3", "D")} AS b,
                 {_best(_edit("w.s", "3", "D"), f"CASE WHEN NOT gone AND i = 's' THEN {_edit('w.b', 'cut', 'K')} END")} AS s,
                 {_best(_edit("w.u", "3", "D"), f"CASE WHEN NOT gone AND i = 'u' THEN {_edit(_FREE, 'cut', 'K')} END",
                        f"CASE WHEN NOT gone THEN {_edit(_FREE, '2 + cut', 'R')} END")} AS u0,
                 {_best(_edit("w.a", "3", "D"), f"CASE WHEN NOT gone AND i = 'a' THEN {_edit('w.u', 'cut', 'K')} END",
                        f"CASE WHEN NOT gone THEN {_edit('w.u', '2 + cut', 'R')} END")} AS a0
               FROM walk w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.pos = w.pos + 1))),
  won AS MATERIALIZED (SELECT conv_id, least(b, a) AS way FROM walk
          QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
  e AS (SELECT conv_id, substr(way, 7) AS audit, unnest(range(1, length(way) - 5)) AS k, length(replace(substr(way, 7), 'D', '')) % 2 AS odd FROM won),
  o AS (SELECT conv_id, k, substr(audit, k, 1) AS edit, odd, length(replace(left(audit, k), 'I', '')) AS pos,
          length(replace(left(audit, k), 'D', '')) - 1 - odd AS said FROM e),
  t AS (SELECT o.conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN said % 2 = 0 THEN 'user' ELSE 'assistant' END
            || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS sha
        FROM o JOIN f ON f.conv_id IS NOT DISTINCT FROM o.conv_id AND f.pos = greatest(o.pos, 1) WHERE edit <> 'D' GROUP BY o.conv_id),
  c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
          count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
          count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
  q AS (SELECT DISTINCT conv_id FROM conversations)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(CAST(left(way, 6) AS INTEGER), 0) AS BIGINT) AS cost, coalesce(substr(way, 7), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM q LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN won ON won.conv_id IS NOT DISTINCT FROM q.conv_id
  LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM q.conv_id
"""
