"""SQL that recomputes every registered query on the same tables.

The derived inputs are the expressions of ``fixtures.py``; the operators are
stated here a second time, set-wise (unnest, group, join), while the package
mostly works row-wise.
"""

from __future__ import annotations

import re
import unicodedata

from glosswork.catalog import fixtures as fx

# Stated anew, so that an error in the package's own values shows. What Python strips is
# asked from Python; what JavaScript trims are the space separators and these.
PY_SPACE = "".join(c for c in map(chr, range(0x10000)) if c.isspace())
JS_SPACE = "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) == "Zs") + "\t\n\v\f\r\u2028\u2029\ufeff"
# Titles of earlier translations, and what has to survive one.
TRANSLATED_PREFIXES = ("[Translated]", "[中文]", "[双语]")
TOKEN_PATTERNS = {
    "citation": r"\[\d+\]",
    "number": r"\d+(?:\.\d+)?",
    "placeholder": r"\{[A-Za-z][A-Za-z0-9]*\}",
    "tag": r"</?[A-Za-z][A-Za-z0-9]*>",
    "url": r"https?://[A-Za-z0-9./_~%?=&#:@+-]+",
}


def _strip(expression: str, space: str = PY_SPACE) -> str:
    return f"trim({expression}, '{space}')"


def _routed(expression: str) -> str:
    name = _strip(expression)
    return f"CASE WHEN {name} NOT IN ('', 'codex', 'codex-cli', 'default') THEN {name} END"


_RELATIONS = {
    "segments": """
      SELECT doc_id || ':' || pos AS seg_id, doc_id, CAST(pos // 10 + 1 AS INTEGER) AS page_no, pos, lang,
             CASE WHEN contains(text, ' | ') THEN 'table' ELSE 'text' END AS kind, text
      FROM (SELECT doc_id, lang, unnest(lines) AS text,
                   CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS pos
            FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS lines FROM documents))""",
    "gated": f"""
      SELECT *, lang = 'en' AND length({_strip('text')}) >= 5 AS translate FROM segments""",
    "wanted": f"""
      SELECT *, {_routed(fx.REQUESTED_MODEL)} AS effective_model FROM gated WHERE translate""",
    "listed": f"SELECT doc_id, {fx.PAGE_LIST} AS pages FROM documents WHERE {fx.HAS_PAGE_LIST}",
    "listed_items": """
      SELECT doc_id, item, TRY_CAST(string_split(item, '-')[1] AS BIGINT) AS low, TRY_CAST(string_split(item, '-')[-1] AS BIGINT) AS high
      FROM (SELECT doc_id, unnest(string_split(pages, ',')) AS item FROM listed)""",
    "listed_wrong": """
      SELECT DISTINCT doc_id, CASE WHEN low > high THEN 'page range runs backwards: ' ELSE 'not a page or page range: ' END || item AS error
      FROM listed_items WHERE low IS NULL OR high IS NULL OR low > high""",
    "batched": f"""
      SELECT *, (rn - 1) // {fx.MAX_BATCH} AS batch_no, CAST((rn - 1) % {fx.MAX_BATCH} AS INTEGER) AS ord
      FROM (SELECT seg_id AS job_id, CAST(doc_id % {fx.WORKERS} AS INTEGER) AS shard, doc_id, pos, text,
                   effective_model,
                   row_number() OVER (PARTITION BY doc_id % {fx.WORKERS} ORDER BY doc_id, pos) AS rn
            FROM wanted)""",
    "batches": """
      SELECT shard, batch_no, effective_model, list(job_id ORDER BY ord) AS job_ids,
             '[' || string_agg('{"id":"' || job_id || '","messages":[{"role":"user","content":' ||
                    CAST(to_json(text) AS VARCHAR) || '}]}', ',' ORDER BY ord) || ']' AS payload
      FROM batched GROUP BY shard, batch_no, effective_model""",
    "paired": """
      SELECT shard, batch_no, effective_model, job_ids,
        CASE batch_no % 15
          WHEN 0 THEN head || array_to_string(rows, ',') || ']}'
          WHEN 1 THEN head || array_to_string(list_reverse(rows), ',') || ']}'
          WHEN 2 THEN 'I cannot do that' WHEN 3 THEN '{"answers":[]}'
          WHEN 4 THEN '{"translations":{"id":"1"}}'
          WHEN 5 THEN head || array_to_string(rows[2:], ',') || ']}'
          WHEN 6 THEN head || array_to_string(rows, ',') || ',{"id":"x","text":"y"}]}'
          WHEN 7 THEN head || array_to_string(rows, ',') || ',' || rows[1] || ']}'
          WHEN 8 THEN head || array_to_string(list_concat(['{"id":"' || job_ids[1] || '","text":"  "}'], rows[2:]), ',') || ']}'
          WHEN 9 THEN head || array_to_string(list_concat(['{"id":1,"text":"one"}'], rows[2:]), ',') || ']}'
          WHEN 10 THEN head || '7,' || array_to_string(rows, ',') || ']}'
          WHEN 11 THEN head || array_to_string(rows, ',') || ',{"id":"' || job_ids[1] || '","text":""}]}'
          WHEN 12 THEN head || array_to_string(rows, ',') || ']} done'
          WHEN 13 THEN '[' || array_to_string(rows, ',') || ']' END AS raw
      FROM (SELECT *, '{"translations":[' AS head,
                   list_transform(job_ids, lambda i: '{"id":"' || i || '","text":" T ' || i || ' "}') AS rows
            FROM batches)""",
    # Audit, set-wise: unnest what came back, compare it with what was asked for.
    "checked": f"""
      SELECT *, row_number() OVER () AS b,
             CASE WHEN json_valid(raw) THEN raw END AS ok,
             CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT'
                   AND json_type(raw, '$.translations') = 'ARRAY' THEN raw END AS listed
      FROM (SELECT * REPLACE ({_strip('raw')} AS raw) FROM paired)""",
    "kept": f"""
      SELECT b, id, {_strip('text')} AS text, n FROM (
        SELECT b, n, json_extract_string(e, '$.id') AS id, json_extract_string(e, '$.text') AS text,
               json_type(e) AS te, json_type(e, '$.id') AS ti, json_type(e, '$.text') AS tt
        FROM (SELECT b, unnest(json_extract(listed, '$.translations[*]')) AS e,
                     generate_subscripts(json_extract(listed, '$.translations[*]'), 1) AS n
              FROM checked WHERE listed IS NOT NULL))
      WHERE te = 'OBJECT' AND ti = 'VARCHAR' AND tt = 'VARCHAR' AND {_strip('text')} <> ''""",
    "asked": "SELECT b, unnest(job_ids) AS id FROM checked",
    "repeats": """
      SELECT b, arg_min(id, n) AS dup FROM (
        SELECT b, id, n, row_number() OVER (PARTITION BY b, id ORDER BY n) AS k FROM kept) WHERE k = 2 GROUP BY b""",
    "omissions": "SELECT b, count(*) AS n FROM (SELECT b, id FROM asked EXCEPT SELECT b, id FROM kept) GROUP BY b",
    "surplus": "SELECT b, count(*) AS n FROM (SELECT b, id FROM kept EXCEPT SELECT b, id FROM asked) GROUP BY b",
    "audited": """
      SELECT c.*, CASE WHEN c.raw IS NULL THEN NULL WHEN c.ok IS NULL THEN 'json'
               WHEN c.listed IS NULL THEN 'missing_translations' WHEN r.dup IS NOT NULL THEN 'duplicate'
               WHEN o.n > 0 THEN 'omitted' WHEN s.n > 0 THEN 'unexpected' END AS defect,
             CASE WHEN c.raw IS NULL THEN NULL WHEN c.ok IS NULL THEN 'reply is not valid JSON'
               WHEN c.listed IS NULL THEN 'reply has no translations array'
               WHEN r.dup IS NOT NULL THEN 'reply repeats id ' || r.dup
               WHEN o.n > 0 THEN 'reply omits ' || o.n || ' item(s)'
               WHEN s.n > 0 THEN 'reply has ' || s.n || ' unexpected item(s)' END AS detail
      FROM checked c LEFT JOIN repeats r USING (b) LEFT JOIN omissions o USING (b) LEFT JOIN surplus s USING (b)""",
    "requests": f"""
      SELECT conv_id AS req_id, {fx.REQUEST_BODY} AS body FROM (
        SELECT conv_id, '[' || string_agg('{{"role":' || CAST(to_json(role) AS VARCHAR) || ',"content":' ||
                 CAST(to_json(text) AS VARCHAR) || '}}', ',' ORDER BY turn) || ']' AS messages
        FROM conversations GROUP BY conv_id)""",
    "triaged": """
      SELECT req_id, body, CASE
          WHEN octet_length(encode(body)) NOT BETWEEN 1 AND 4194304 THEN 'size'
          WHEN NOT json_valid(body) THEN 'json' WHEN json_type(body) <> 'OBJECT' THEN 'object'
          WHEN coalesce(json_type(body, '$.messages') <> 'ARRAY', true) THEN 'messages'
          WHEN json_array_length(body, '$.messages') = 0 THEN 'messages'
          WHEN len(list_filter(json_extract(body, '$.messages[*]'), lambda m: json_type(m) <> 'OBJECT')) > 0
            THEN 'element' END AS reject FROM requests""",
    "request_jobs": """
      SELECT req_id, CASE WHEN json_type(body, '$.model') IS NULL OR json_extract_string(body, '$.model') = ''
               THEN 'codex-cli' ELSE json_extract_string(body, '$.model') END AS requested_model,
             CAST(json_extract(body, '$.messages') AS VARCHAR) AS messages
      FROM triaged WHERE reject IS NULL""",
    "document_requests": f"""
      SELECT conv_id AS req_id, {fx.REQUEST_BODY} AS body, text FROM (
        SELECT doc_id AS conv_id, text,
               '[{{"role":"user","content":' || CAST(to_json(text) AS VARCHAR) || '}}]' AS messages FROM documents)""",
    # The same rules for the documents' requests, from their bodies.
    "document_triage": """
      SELECT req_id, text, reject,
        CASE WHEN reject IS NULL THEN CASE WHEN json_type(body, '$.model') IS NULL OR json_extract_string(body, '$.model') = ''
          THEN 'codex-cli' ELSE json_extract_string(body, '$.model') END END AS requested_model,
        CASE WHEN reject IS NULL THEN CAST(json_extract(body, '$.messages') AS VARCHAR) END AS messages
      FROM (SELECT *, CASE
          WHEN octet_length(encode(body)) NOT BETWEEN 1 AND 4194304 THEN 'size'
          WHEN NOT json_valid(body) THEN 'json' WHEN json_type(body) <> 'OBJECT' THEN 'object'
          WHEN coalesce(json_type(body, '$.messages') <> 'ARRAY', true) THEN 'messages'
          WHEN json_array_length(body, '$.messages') = 0 THEN 'messages'
          WHEN len(list_filter(json_extract(body, '$.messages[*]'), lambda m: json_type(m) <> 'OBJECT')) > 0
            THEN 'element' END AS reject FROM document_requests)""",
    "document_jobs": f"""
      SELECT *, (rn - 1) // {fx.MAX_BATCH} AS batch_no FROM (
        SELECT CAST(req_id AS VARCHAR) AS job_id, CAST(req_id % {fx.WORKERS} AS INTEGER) AS shard, req_id, text, messages,
               {_routed('requested_model')} AS effective_model,
               row_number() OVER (PARTITION BY req_id % {fx.WORKERS} ORDER BY req_id) AS rn
        FROM document_triage WHERE reject IS NULL)""",
    "job_events": f"SELECT user_id AS job_id, event_id AS seq, {fx.EVENT_BODY} AS body FROM events",
    "parsed": """
      SELECT *, CASE WHEN json_type(body, '$.type') = 'VARCHAR' THEN json_extract_string(body, '$.type') END AS type
      FROM (SELECT * FROM job_events WHERE json_valid(body)) WHERE json_type(body) = 'OBJECT'""",
    "progress": """
      SELECT job_id, seq, stage, CASE WHEN pct IS NULL THEN stage
               ELSE stage || ': ' || CASE WHEN r = 0 AND pct < 0 THEN '-0' ELSE CAST(CAST(r AS BIGINT) AS VARCHAR) END || '%' END AS label
      FROM (SELECT *, round_even(pct, 0) AS r FROM (
        SELECT job_id, seq, stage, CASE WHEN x BETWEEN 0 AND 1 THEN x * 100 ELSE x END AS pct FROM (
          SELECT job_id, seq,
            CASE WHEN s1 THEN json_extract_string(body, '$.stage') WHEN s2 THEN json_extract_string(body, '$.phase')
                 WHEN s3 THEN json_extract_string(body, '$.name') ELSE 'working' END AS stage,
            CASE WHEN json_type(v) = 'BOOLEAN' THEN CASE WHEN CAST(v AS VARCHAR) = 'true' THEN 1.0 ELSE 0.0 END
                 WHEN json_type(v) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(v AS DOUBLE)
                 WHEN json_type(v) = 'OBJECT' AND json_type(v, '$.current') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
                  AND json_type(v, '$.total') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
                  AND CAST(json_extract(v, '$.total') AS DOUBLE) <> 0
                 THEN CAST(json_extract(v, '$.current') AS DOUBLE) / CAST(json_extract(v, '$.total') AS DOUBLE) END AS x
          FROM (SELECT *,
              coalesce(json_type(body, '$.stage') NOT IN ('NULL') AND
                       json_extract_string(body, '$.stage') NOT IN ('', 'false', '0'), false) AS s1,
              coalesce(json_type(body, '$.phase') NOT IN ('NULL') AND
                       json_extract_string(body, '$.phase') NOT IN ('', 'false', '0'), false) AS s2,
              coalesce(json_type(body, '$.name') NOT IN ('NULL') AND
                       json_extract_string(body, '$.name') NOT IN ('', 'false', '0'), false) AS s3,
              CASE WHEN json_exists(body, '$.overall_progress') THEN json_extract(body, '$.overall_progress')
                   ELSE json_extract(body, '$.progress') END AS v
            FROM parsed WHERE type = 'progress'))))""",
    "ends": """
      SELECT job_id, min(seq) AS end_seq, arg_min(outcome, seq) AS outcome,
             arg_min(CASE WHEN outcome = 'error' THEN error ELSE '' END, seq) AS error FROM (
        SELECT job_id, seq,
          CASE WHEN type = 'error' THEN 'error'
               WHEN coalesce(json_type(body, '$.translate_result'), 'NULL') = 'NULL' THEN 'empty_result'
               ELSE 'finish' END AS outcome,
          coalesce(nullif(json_extract_string(body, '$.error'), ''), 'translation failed') AS error
        FROM parsed WHERE type IN ('error', 'finish')) GROUP BY job_id""",
    "outcomes": """
      SELECT j.job_id, coalesce(any_value(e.outcome), 'no_result') AS outcome,
             CASE WHEN any_value(e.outcome) = 'error' THEN any_value(e.error) END AS error,
             count(p.seq) AS n_progress, arg_max(p.label, p.seq) AS last_label
      FROM (SELECT DISTINCT job_id FROM job_events) j LEFT JOIN ends e USING (job_id)
      LEFT JOIN progress p ON p.job_id = j.job_id AND (e.end_seq IS NULL OR p.seq < e.end_seq)
      GROUP BY j.job_id""",
    "logs": f"SELECT doc_id AS job_id, {fx.STDOUT} AS stdout, {fx.STDERR} AS stderr FROM documents",
    "whole": f"SELECT job_id, {_strip('stdout', JS_SPACE)} AS s FROM logs",
    "candidates": f"""
      SELECT job_id, 0 AS n, true AS strict, s AS rec FROM whole WHERE json_valid(s)
      UNION ALL
      SELECT job_id, n, false, line FROM (
        SELECT job_id, n, {_strip('line', JS_SPACE)} AS line FROM (
          SELECT job_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM (
            SELECT job_id, string_split_regex(s, '\\r\\n|\\n|\\r') AS lines FROM whole WHERE NOT json_valid(s))))
      WHERE line LIKE '{{%}}' AND json_valid(line)""",
    "judged": """
      SELECT *, CASE WHEN json_type(rec) <> 'OBJECT' THEN 'object'
          WHEN NOT fi THEN 'input_pdf' WHEN NOT (fm OR nm) THEN 'mono_pdf' WHEN NOT (fd OR nd) THEN 'dual_pdf'
          WHEN nm AND nd THEN 'both_null' END AS problem
      FROM (SELECT *,
          coalesce(json_type(rec, '$.input_pdf') = 'VARCHAR' AND json_extract_string(rec, '$.input_pdf') <> '', false) AS fi,
          coalesce(json_type(rec, '$.mono_pdf') = 'VARCHAR' AND json_extract_string(rec, '$.mono_pdf') <> '', false) AS fm,
          coalesce(json_type(rec, '$.dual_pdf') = 'VARCHAR' AND json_extract_string(rec, '$.dual_pdf') <> '', false) AS fd,
          coalesce(json_type(rec, '$.mono_pdf') = 'NULL', false) AS nm,
          coalesce(json_type(rec, '$.dual_pdf') = 'NULL', false) AS nd FROM candidates)""",
    "chosen": """
      SELECT job_id, strict, rec, problem FROM (
        SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n DESC) AS k FROM judged
        WHERE strict OR problem IS NULL) WHERE k = 1""",
    "attachments": f"""
      SELECT doc_id AS attachment_id, {fx.ATTACHMENT_ITEM} AS item_id, {fx.LIBRARY_ID} AS library_id,
             doc_id AS child_pos, coalesce(doc_id = best_id, false) AS is_best, {fx.IS_PDF} AS is_pdf,
             {fx.ATTACHMENT_TITLE} AS title, {fx.ATTACHMENT_FILE} AS filename, {fx.ATTACHMENT_PATH} AS path
      FROM documents LEFT JOIN (SELECT source, min(doc_id) AS best_id FROM documents JOIN labels USING (doc_id)
                                WHERE quality = 1 GROUP BY source) USING (source)""",
    "library_files": f"SELECT {fx.ATTACHMENT_PATH} AS path FROM documents WHERE {fx.FILE_PRESENT}",
    "best": """
      SELECT item_id, attachment_id FROM (
        SELECT item_id, attachment_id,
               row_number() OVER (PARTITION BY item_id ORDER BY is_best DESC, child_pos) AS k
        FROM attachments WHERE is_pdf AND item_id IS NOT NULL AND path IN (SELECT path FROM library_files))
      WHERE k = 1""",
    "picked": """
      SELECT attachment_id, min(sel_pos) AS target_pos FROM (
        SELECT doc_id * 2 AS sel_pos, attachment_id FROM documents JOIN attachments ON attachment_id = doc_id
        WHERE doc_id % 2 = 0 AND is_pdf
        UNION ALL
        SELECT sel_pos, attachment_id FROM (SELECT source AS item_id, min(doc_id) * 2 + 1 AS sel_pos
                                            FROM documents GROUP BY source) JOIN best USING (item_id))
      GROUP BY attachment_id""",
    "results": f"""
      SELECT doc_id AS job_id, source AS title, '/in/' || source || '/é' || doc_id || '.pdf' AS input_pdf,
             {fx.MONO_PDF} AS mono_pdf, {fx.DUAL_PDF} AS dual_pdf FROM documents""",
    "offered": f"""
      SELECT job_id, place, kind, label, norm AS path,
             CASE WHEN norm LIKE '{fx.ROOT}/%' THEN substr(norm, {len(fx.ROOT) + 2}) END AS rel_path FROM (
        SELECT *, {'regexp_replace(' * 4}replace(CASE WHEN p LIKE '/%' THEN p ELSE '{fx.OUTPUT_DIR}/' || p END, '/./', '/')
               {", '/[^/]+/[.][.]/', '/')" * 4} AS norm FROM (
          SELECT job_id, 0 AS place, 'dual' AS kind, '[双语] ' || title AS label, dual_pdf AS p FROM results
          UNION ALL SELECT job_id, 1, 'mono', '[中文] ' || title, mono_pdf FROM results) WHERE p <> '')""",
    "output_files": f"""
      SELECT unnest(['/vault/out/m/' || doc_id || '.pdf', '/vault/out/m' || doc_id || '.pdf',
                     '/vault/out/d' || doc_id || '.pdf']) AS path FROM documents WHERE {fx.FILE_PRESENT}""",
    "runs": f"""
      SELECT doc_id % 7 AS run_id, doc_id AS target_pos, source || ' ' || doc_id AS display_title,
             {fx.N_CREATED} AS n_created, {fx.RUN_ERROR} AS error FROM documents""",
    "memory": f"""
      SELECT sha256(text) AS key_hash, effective_model, '[v' || v || '] ' || text AS text, v AS version,
             part FROM (SELECT *, doc_id % 5 + 1 AS v, doc_id % 5 AS part FROM wanted)""",
}


_OFFLINE = "'[zh] ' || text"  # what the offline translator answers
_RELATIONS["translated"] = f"SELECT *, CASE WHEN translate THEN {_OFFLINE} END AS result FROM gated"
# The corpus run asks for the default model; memory holds texts stored under it.
_RELATIONS["remembered"] = """
      SELECT DISTINCT key_hash, text FROM memory WHERE part = 0 AND effective_model IS NULL"""
_RELATIONS["corpus"] = f"""
      SELECT g.*, CASE WHEN translate THEN coalesce(r.text, {_OFFLINE.replace('text', 'g.text')}) END AS result
      FROM gated g LEFT JOIN remembered r ON g.translate AND r.key_hash = sha256(g.text)"""
_RELATIONS["pairs"] = f"""
      SELECT seg_id, text || {fx.TOKENS} AS source, {_OFFLINE} || {fx.TOKENS_OUT} AS output FROM wanted"""
_RELATIONS["tokens"] = " UNION ALL ".join(
    f"SELECT seg_id, '{cls}' AS cls, unnest(regexp_extract_all({side}, '{pattern}')) AS token, {weight} AS w FROM pairs"
    for cls, pattern in TOKEN_PATTERNS.items()
    for side, weight in (("source", 1), ("output", -1))
)


def _needed(body: str, found: dict[str, str]) -> None:
    for name, sql in _RELATIONS.items():
        if name not in found and re.search(rf"\b(FROM|JOIN)\s+{name}\b", body):
            _needed(sql, found)
            found[name] = sql


def sql(body: str) -> str:
    """The query with the relations it needs, each after those it builds on."""
    found: dict[str, str] = {}
    _needed(body, found)
    if not found:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in found.items()) + "\n" + body


_PREFIXED = " OR ".join(f"starts_with(title, '{p}')" for p in TRANSLATED_PREFIXES)
_BROKEN = "batch translation failed: model Model-Y is not available"


def _quote_tail(label: str, col: str) -> str:
    t = _strip(col, JS_SPACE)
    return f"""'{label} (' || octet_length(encode({col})) || ' bytes): ' || CASE WHEN {t} = '' THEN '<empty>'
      ELSE CAST(to_json(CASE WHEN length({t}) > 1200 THEN '…' || right({t}, 1200) ELSE {t} END) AS VARCHAR) END"""


_STATUS = """count(*) FILTER (WHERE raw IS NOT NULL AND defect IS NULL) AS batches,
  count(*) FILTER (WHERE raw IS NOT NULL AND defect IS NOT NULL) AS failed_batches,
  CAST(coalesce(sum(len(job_ids)) FILTER (WHERE raw IS NOT NULL AND defect IS NULL), 0) AS BIGINT) AS translated_items,
  CAST(coalesce(sum(len(job_ids)) FILTER (WHERE raw IS NULL), 0) AS BIGINT) AS queued_items"""
_DETAIL = f"right({_strip('CASE WHEN length(stderr) > 0 THEN stderr ELSE stdout END')}, 2000)"

_TRIAGE = """SELECT t.req_id, t.reject, j.requested_model, md5(j.messages) AS messages_md5
  FROM triaged t LEFT JOIN request_jobs j USING (req_id)"""
_OUTCOME = "SELECT job_id, outcome, error, n_progress, last_label FROM outcomes"

def _reported(limit: int, if_blank: str, if_empty: str) -> str:
    """Error text of the two reporters that trim as JavaScript does."""
    picked = f"coalesce(nullif(stderr, ''), nullif(stdout, ''), {if_empty or chr(39) * 2})"
    shown = f"right({_strip(picked, JS_SPACE)}, {limit})"
    return f"coalesce(nullif({shown}, ''), {if_blank})" if if_blank else shown


_QUERIES = {
    "input_gate": f"""SELECT doc_id, path, CASE WHEN doc_id % 7 = 0 THEN 'missing'
        WHEN NOT regexp_matches(path, '[^/][.][pP][dD][fF]$') THEN 'not_pdf' END AS reason
      FROM (SELECT doc_id, {fx.CANDIDATE_PATH} AS path FROM documents)""",
    "request_triage": _TRIAGE,
    "model_routing": f"""SELECT seg_id, {_routed(fx.REQUESTED_MODEL)} AS effective_model,
        'forced' AS forced_model FROM segments""",
    "segment_explode": "SELECT seg_id, doc_id, page_no, pos, lang, kind, md5(text) AS text_md5 FROM segments",
    "page_select": "SELECT seg_id, page_no FROM segments WHERE page_no IN (1, 2) OR page_no BETWEEN 4 AND 6",
    "segment_gate": f"""SELECT seg_id, translate, translate AND kind <> 'table' AS translate_no_tables,
        length({_strip('text')}) > 0 AS has_text FROM gated""",
    "collect_targets": f"""SELECT target_pos, attachment_id, a.item_id, library_id, path,
        coalesce(nullif(i.title, ''), nullif(a.title, ''), nullif(filename, ''), 'PDF') AS display_title
      FROM picked JOIN attachments a USING (attachment_id)
      LEFT JOIN (SELECT DISTINCT source AS item_id, {fx.ITEM_TITLE} AS title FROM documents) i ON i.item_id = a.item_id
      WHERE NOT ({_PREFIXED.replace('title', 'a.title')}) AND path IN (SELECT path FROM library_files)
        AND library_id <> 1""",
    "best_attachment": "SELECT item_id, attachment_id FROM best",
    "batch_by_count": "SELECT job_id, shard, batch_no, effective_model, ord FROM batched",
    "batch_by_window": """WITH RECURSIVE e AS (
        SELECT user_id, event_id, epoch_us(ts) AS t,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
      walk AS (
        SELECT user_id, event_id, rn, t AS anchor, 1 AS n, CAST(0 AS BIGINT) AS batch_no FROM e WHERE rn = 1
        UNION ALL
        SELECT e.user_id, e.event_id, e.rn,
               CASE WHEN w.n < 4 AND e.t < w.anchor + 43200000000 THEN w.anchor ELSE e.t END,
               CASE WHEN w.n < 4 AND e.t < w.anchor + 43200000000 THEN w.n + 1 ELSE 1 END,
               CASE WHEN w.n < 4 AND e.t < w.anchor + 43200000000 THEN w.batch_no ELSE w.batch_no + 1 END
        FROM walk w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
      SELECT user_id, event_id, batch_no FROM walk""",
    "batch_payload": """SELECT shard, batch_no, effective_model, len(job_ids) AS n_jobs,
        octet_length(encode(payload)) AS n_bytes, md5(payload) AS payload_md5 FROM batches""",
    "segment_dedup": """SELECT key_hash, effective_model, first.doc_id AS doc_id, first.pos AS pos, n_rows FROM (
        SELECT sha256(text) AS key_hash, effective_model, min({'doc_id': doc_id, 'pos': pos}) AS first, count(*) AS n_rows
        FROM wanted GROUP BY 1, 2)""",
    "listed_pages": """SELECT doc_id, page_no, count(*) AS n_segments FROM segments s
      WHERE (doc_id NOT IN (SELECT doc_id FROM listed WHERE pages IS NOT NULL)
             OR EXISTS (SELECT 1 FROM listed_items e WHERE e.doc_id = s.doc_id AND s.page_no BETWEEN e.low AND e.high))
        AND doc_id NOT IN (SELECT doc_id FROM listed_wrong)
      GROUP BY doc_id, page_no
      UNION ALL SELECT doc_id, -1, length(error) FROM listed_wrong""",
    "memory_split": """SELECT seg_id, m.text IS NOT NULL AS hit, md5(m.text) AS memory_md5 FROM wanted w
      LEFT JOIN (SELECT DISTINCT key_hash, effective_model, text FROM memory WHERE part = 0) m
        ON m.key_hash = sha256(w.text) AND m.effective_model IS NOT DISTINCT FROM w.effective_model""",
    "memory_upsert": """SELECT key_hash, effective_model, md5(arg_max(text, version)) AS text_md5,
        CAST(max(version) AS INTEGER) AS version FROM memory GROUP BY 1, 2""",
    "memory_store": """SELECT key_hash, effective_model, md5(arg_max(text, version)) AS text_md5,
        CAST(max(version) AS INTEGER) AS version FROM memory GROUP BY 1, 2""",
    "batch_infer": f"""SELECT shard, batch_no, effective_model,
        CASE WHEN effective_model = 'Model-Y' THEN NULL ELSE md5('{{"translations":[' || string_agg(
          '{{"id":"' || job_id || '","text":' || CAST(to_json({_OFFLINE}) AS VARCHAR) || '}}', ',' ORDER BY ord) || ']}}')
        END AS raw_md5,
        CASE WHEN effective_model = 'Model-Y' THEN '{_BROKEN}' END AS error
      FROM batched GROUP BY 1, 2, 3""",
    "call_ledger": f"""SELECT shard, batch_no, effective_model,
        CASE WHEN effective_model = 'Model-Y' THEN NULL ELSE md5('{{"translations":[' || string_agg(
          '{{"id":"' || job_id || '","text":' || CAST(to_json({_OFFLINE}) AS VARCHAR) || '}}', ',' ORDER BY ord) || ']}}')
        END AS raw_md5,
        CASE WHEN effective_model = 'Model-Y' THEN 'batch translation failed: not recorded' END AS error
      FROM batched GROUP BY 1, 2, 3""",
    "reply_audit": """SELECT shard, batch_no, effective_model, defect, detail,
        (SELECT count(*) FROM kept k WHERE k.b = a.b) AS n_usable FROM audited a""",
    "single_reply_audit": f"""SELECT doc_id, CASE WHEN defect IS NULL THEN md5({_strip('t')}) END AS translation_md5, defect
      FROM (SELECT *, CASE WHEN json_valid(s) THEN json_extract_string(s, '$.translation') END AS t,
          CASE WHEN NOT json_valid(s) THEN 'json' WHEN json_type(s) <> 'OBJECT' THEN 'object'
               WHEN coalesce(json_type(s, '$.translation') <> 'VARCHAR', true) THEN 'empty'
               WHEN {_strip("json_extract_string(s, '$.translation')")} = '' THEN 'empty' END AS defect
        FROM (SELECT doc_id, {_strip('raw')} AS s FROM (
          SELECT doc_id, {fx.SINGLE_REPLY} AS raw FROM (
            SELECT doc_id, CAST(to_json(text) AS VARCHAR) AS quoted FROM documents))))""",
    "result_scatter": """SELECT j.job_id, CASE WHEN a.raw IS NOT NULL AND a.defect IS NULL THEN k.text END AS result,
        CASE WHEN a.raw IS NULL THEN 'no translation was returned' ELSE a.detail END AS error
      FROM batched j JOIN audited a ON a.shard = j.shard AND a.batch_no = j.batch_no
        AND a.effective_model IS NOT DISTINCT FROM j.effective_model
      LEFT JOIN (SELECT b, id, min(text) AS text FROM kept GROUP BY b, id) k ON k.b = a.b AND k.id = j.job_id""",
    "deadline_audit": """SELECT j.job_id, min(c.done_at) IS NULL AS timed_out,
        coalesce(min(epoch_us(c.done_at) - epoch_us(j.submitted_at)), -1) AS waited_us
      FROM (SELECT event_id AS job_id, ts AS submitted_at FROM events) j
      LEFT JOIN (SELECT event_id - 1 AS job_id, ts AS done_at FROM events
                 UNION ALL SELECT event_id - 2, ts FROM events WHERE event_id % 3 = 0
                 UNION ALL SELECT event_id + 1, ts FROM events WHERE event_id % 4 = 0) c
        ON c.job_id = j.job_id AND c.done_at BETWEEN j.submitted_at AND j.submitted_at + INTERVAL 330 SECOND
      GROUP BY j.job_id""",
    "preservation_audit": """SELECT seg_id, cls, CAST(sum(greatest(d, 0)) AS BIGINT) AS lost,
        CAST(sum(greatest(-d, 0)) AS BIGINT) AS added
      FROM (SELECT seg_id, cls, token, sum(w) AS d FROM tokens GROUP BY seg_id, cls, token) GROUP BY seg_id, cls""",
    "progress_normalize": "SELECT job_id, seq, stage, label FROM progress",
    "job_outcome": _OUTCOME,
    "result_salvage": """SELECT w.job_id, CASE WHEN c.problem IS NULL THEN json_extract_string(rec, '$.input_pdf') END AS input_pdf,
        CASE WHEN c.problem IS NULL THEN json_extract_string(rec, '$.mono_pdf') END AS mono_pdf,
        CASE WHEN c.problem IS NULL THEN json_extract_string(rec, '$.dual_pdf') END AS dual_pdf,
        coalesce(NOT strict, false) AS recovered, CASE WHEN rec IS NULL THEN 'parse' ELSE problem END AS problem
      FROM whole w LEFT JOIN chosen c USING (job_id)""",
    "output_manifest": """SELECT job_id, kind, rel_path, label, status FROM (
        SELECT job_id, kind, rel_path, label,
               CASE WHEN path IN (SELECT path FROM output_files) THEN 'ok' ELSE 'missing_file' END AS status
        FROM offered WHERE rel_path IS NOT NULL
        UNION ALL
        SELECT job_id, NULL, NULL, NULL,
               CASE WHEN job_id IN (SELECT job_id FROM offered) THEN 'outside_root' ELSE 'no_output' END
        FROM results WHERE job_id NOT IN (SELECT job_id FROM offered WHERE rel_path IS NOT NULL))""",
    "result_records": """SELECT job_id, '{"input_pdf":' || CAST(to_json(input_pdf) AS VARCHAR) || ',"mono_pdf":' ||
        coalesce(CAST(to_json(mono_pdf) AS VARCHAR), 'null') || ',"dual_pdf":' ||
        coalesce(CAST(to_json(dual_pdf) AS VARCHAR), 'null') || '}' AS record FROM results""",
    "assemble_outputs": """SELECT doc_id, 'mono' AS kind, md5(string_agg(coalesce(result, text), chr(10) ORDER BY pos)) AS text_md5,
        count(*) AS n_segments, count(result) AS n_translated
      FROM translated GROUP BY doc_id
      UNION ALL
      SELECT doc_id, 'dual', md5(string_agg(text || coalesce(chr(10) || result, ''), chr(10) ORDER BY pos)),
        count(*), count(result)
      FROM translated GROUP BY doc_id""",
    "backend_status": f"""SELECT coalesce(effective_model, 'codex-cli-default') AS model, {_STATUS}
      FROM audited GROUP BY 1""",
    "shard_status": f"""SELECT coalesce(CAST(shard AS VARCHAR), 'all') AS shard, coalesce(model, 'all') AS model, {_STATUS}
      FROM (SELECT *, coalesce(effective_model, 'codex-cli-default') AS model FROM audited) a
      GROUP BY ROLLUP (a.shard, a.model)""",
    "run_summary": """SELECT run_id, count(*) AS n_targets,
        CAST(coalesce(sum(n_created) FILTER (WHERE error IS NULL), 0) AS BIGINT) AS n_created,
        count(error) AS n_failed,
        CAST(floor(count(*) FILTER (WHERE n_created IS NOT NULL OR error IS NOT NULL) * 100 / count(*) + 0.5) AS BIGINT) AS percent
      FROM runs GROUP BY run_id""",
    "first_failures": """SELECT run_id, CAST(place AS INTEGER) AS place, display_title || ': ' || error AS message FROM (
        SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY target_pos) AS place
        FROM runs WHERE error IS NOT NULL) WHERE place <= 5""",
    "outcome_results": f"""
      SELECT o.job_id, o.outcome, o.error,
        CASE WHEN o.outcome = 'finish' THEN replace(nullif(json_extract_string(b.body, '$.translate_result.mono_pdf_path'), ''),
                                                    'm/../', '{fx.OUTPUT_DIR}/') END AS mono_pdf,
        CASE WHEN o.outcome = 'finish' THEN nullif(json_extract_string(b.body, '$.translate_result.dual_pdf_path'), '') END AS dual_pdf
      FROM outcomes o LEFT JOIN ends e USING (job_id) LEFT JOIN parsed b ON b.job_id = o.job_id AND b.seq = e.end_seq""",
    "job_verdicts": """
      SELECT r.job_id, count(f.path) AS n_ok,
        CASE WHEN count(i.path) > count(f.path) THEN 'missing_file' WHEN count(i.path) > 0 THEN 'ok'
             WHEN any_value(r.job_id) IN (SELECT job_id FROM offered) THEN 'outside_root' ELSE 'no_output' END AS verdict
      FROM results r LEFT JOIN (SELECT * FROM offered WHERE rel_path IS NOT NULL) i USING (job_id)
      LEFT JOIN output_files f ON f.path = i.path GROUP BY r.job_id""",
    "failure_report": f"""SELECT job_id, md5({_DETAIL}) AS detail_md5, md5({_reported(2500, "'exit code unknown'", '')}) AS library_md5,
        md5({_reported(3000, '', "'exit code unknown'")}) AS notes_md5, md5({_quote_tail('stdout', 'stdout')}) AS stdout_md5,
        md5({_quote_tail('stderr', "coalesce(stderr, '')")}) AS stderr_md5 FROM logs""",
    "corpus_documents": """SELECT doc_id, 'mono' AS kind, md5(string_agg(coalesce(result, text), chr(10) ORDER BY pos)) AS text_md5,
        count(*) AS n_segments, count(result) AS n_translated
      FROM corpus WHERE page_no IN (1, 2, 3, 5) GROUP BY doc_id
      UNION ALL
      SELECT doc_id, 'dual', md5(string_agg(text || coalesce(chr(10) || result, ''), chr(10) ORDER BY pos)),
        count(*), count(result)
      FROM corpus WHERE page_no IN (1, 2, 3, 5) GROUP BY doc_id""",
    "direct_documents": """SELECT doc_id, 'mono' AS kind, md5(string_agg(coalesce(result, text), chr(10) ORDER BY pos)) AS text_md5,
        count(*) AS n_segments, count(result) AS n_translated FROM corpus GROUP BY doc_id""",
    "corpus_calls": f"""SELECT 'Model-Y' AS model, CAST(sum(calls) AS BIGINT) AS batches, CAST(0 AS BIGINT) AS failed_batches,
        CAST(sum(n) AS BIGINT) AS translated_items, CAST(0 AS BIGINT) AS queued_items
      FROM (SELECT count(*) AS n, (count(*) + {fx.MAX_BATCH - 1}) // {fx.MAX_BATCH} AS calls FROM (
          SELECT min({{'d': doc_id, 'p': pos}}).d % {fx.WORKERS} AS shard FROM gated
          WHERE translate AND sha256(text) NOT IN (
            SELECT key_hash FROM memory WHERE part = 0 AND effective_model = 'Model-Y')
          GROUP BY text) GROUP BY shard)""",
    "corpus_memory": f"""SELECT effective_model, CAST(version AS INTEGER) AS version, count(*) AS n_keys,
        CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (
          SELECT DISTINCT key_hash, effective_model, text, version FROM memory WHERE part = 0
          UNION ALL
          SELECT DISTINCT sha256(text), NULL, {_OFFLINE}, 3 FROM gated
          WHERE translate AND sha256(text) NOT IN (SELECT key_hash FROM remembered))
      GROUP BY 1, 2""",
    "stream_triage": """SELECT req_id, reject IS NULL AS accepted, reject, requested_model,
        md5(messages) AS messages_md5 FROM document_triage""",
    "stream_microbatch": """SELECT shard, batch_no, effective_model, count(*) AS n_jobs,
        md5('[' || string_agg('{"id":"' || job_id || '","messages":' || messages || '}', ',' ORDER BY req_id) || ']') AS payload_md5
      FROM document_jobs GROUP BY 1, 2, 3""",
    "stream_hot_shard": f"""SELECT 0 AS shard, batch_no, effective_model, count(*) AS n_jobs,
        md5('[' || string_agg('{{"id":"' || job_id || '","messages":' || messages || '}}', ',' ORDER BY req_id) || ']') AS payload_md5
      FROM (SELECT * REPLACE ((row_number() OVER (ORDER BY req_id) - 1) // {fx.MAX_BATCH} AS batch_no) FROM document_jobs) GROUP BY 2, 3""",
    "stream_replay": f"""SELECT job_id, CASE WHEN coalesce(effective_model, '') <> '12' THEN md5({_strip(_OFFLINE)}) END AS result_md5,
        CASE WHEN effective_model = '12' THEN 'batch translation failed: model 12 is not available' END AS error
      FROM document_jobs""",
    "stream_translate": f"""SELECT job_id, CASE WHEN coalesce(effective_model, '') <> '12' THEN md5({_strip(_OFFLINE)}) END AS result_md5,
        CASE WHEN effective_model = '12' THEN 'batch translation failed: model 12 is not available' END AS error
      FROM document_jobs""",
    "stream_outcome": f"{_OUTCOME} WHERE outcome <> 'no_result'",
    "stream_status": f"""SELECT coalesce(effective_model, 'codex-cli-default') AS model, {_STATUS}
      FROM audited GROUP BY 1""",
    "stream_status_windows": f"""
      SELECT strftime(w, '%Y-%m-%d') AS day, coalesce(m, 'codex-cli-default') AS model,
        count(*) FILTER (answered AND NOT failed) AS batches, count(*) FILTER (answered AND failed) AS failed_batches,
        CAST(coalesce(sum(n) FILTER (answered AND NOT failed), 0) AS BIGINT) AS translated_items,
        CAST(coalesce(sum(n) FILTER (NOT answered), 0) AS BIGINT) AS queued_items
      FROM (SELECT date_trunc('day', ts) AS w, {fx.TIMED_REPLY['effective_model']} AS m, {fx.TIMED_REPLY['n_jobs']} AS n,
              {fx.TIMED_REPLY['answered']} AS answered, {fx.TIMED_REPLY['failed']} AS failed, {fx.TIMED_REPLY['arrival']} AS arrival,
              max(ts) FILTER ({fx.TIMED_REPLY['arrival']} = 0) OVER () - INTERVAL {fx.STATUS_DELAY_DAYS} DAY AS closed,
              max(ts) OVER () - INTERVAL {fx.STATUS_DELAY_DAYS} DAY AS told FROM events)
      WHERE w + INTERVAL 1 DAY <= told AND (arrival < 2 OR w + INTERVAL 1 DAY > closed) GROUP BY 1, 2""",
    "failure_counts": f"""SELECT md5({_DETAIL}) AS detail_md5, count(*) AS n_jobs FROM logs GROUP BY 1""",
}

ORACLE = {name: sql(body) for name, body in _QUERIES.items()}
