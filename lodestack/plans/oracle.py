"""DuckDB SQL for the catalogue's queries, written from the semantics, not from the Spark plans."""

from __future__ import annotations


def _cid(data: str) -> str:
    """The identifier of a blob expression."""
    h = f"('711220' || sha256({data}))"
    groups = " || ".join(f"to_base(('0x' || substr({h}, {10 * g + 1}, 10))::BIGINT, 32, 8)" for g in range(7))
    return f"('b' || translate({groups}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'abcdefghijklmnopqrstuvwxyz234567'))"


def _token(user: str, password: str) -> str:
    return f"('owner-' || sha256({user} || ':' || {password}))"


def _files(name: str, content: str = "encode(text)", table: str = "documents") -> str:
    return f"files AS (SELECT doc_id AS file_id, {name} AS filename, source, lang, n_chars, {content} AS content FROM {table})"


_BY_ID, _BY_LANG = _files("'doc-' || doc_id || '.txt'"), _files("lang || '.txt'")


def _chunks(source: str = "files", size: int = 1024, key: str = "file_id") -> str:
    n = f"CAST(ceil(octet_length(content) / {size}.0) AS BIGINT)"
    return f"""chunks AS (
    SELECT {key}, i AS idx, data, CAST(octet_length(data) AS BIGINT) AS size, {_cid("data")} AS hash
    FROM (SELECT {key}, i, content[i * {size} + 1:(i + 1) * {size}] AS data FROM (SELECT {key}, content, unnest(range(0, {n})) AS i FROM {source})))"""


def _manifests(out: str = "manifests", name: str = "filename") -> str:
    return f"""{out}_text AS (
    SELECT f.file_id, {name} AS filename, coalesce(total, 0) AS total_size, coalesce(n, 0) AS chunk_count,
           '{{' || chr(10) || '  "version": 1,' || chr(10) || '  "hash_algo": "sha2-256",' || chr(10) || '  "chunk_size": 1024,' || chr(10)
           || '  "total_size": ' || coalesce(total, 0) || ',' || chr(10) || '  "filename": "' || {name} || '",' || chr(10) || '  "chunks": [' || chr(10)
           || coalesce(lines || chr(10), '') || '  ]' || chr(10) || '}}' || chr(10) AS body
    FROM files f LEFT JOIN (
        SELECT file_id, CAST(sum(size) AS BIGINT) AS total, count(*) AS n,
               string_agg('    {{ "index": ' || idx || ', "size": ' || size || ', "hash": "' || hash || '" }}', ',' || chr(10) ORDER BY idx) AS lines
        FROM chunks GROUP BY file_id) c USING (file_id)
), {out} AS (SELECT *, {_cid("encode(body)")} AS cid FROM {out}_text)"""


_STORED = f"WITH {_BY_ID}, {_chunks()}"
_NAMED = f"{_STORED}, {_manifests()}"
_SECOND = f"""
WITH {_files("''")}, {_chunks()}, stored AS (SELECT DISTINCT hash FROM chunks),
more AS (SELECT item_id AS file_id, encode(text) AS content FROM benchmark UNION ALL SELECT -page_id - 1, encode(html) FROM pages)"""
_LOG = f"""WITH {_BY_LANG}, {_chunks()}, {_manifests()},
log AS (SELECT m.file_id AS seq, m.cid, f.source, CASE WHEN f.source <> 'src0' THEN {_token("f.source", "'pw-' || f.source")} END AS token
        FROM manifests m JOIN files f USING (file_id)),
owners AS (SELECT cid, arg_max_null(token, seq) AS token FROM log GROUP BY cid),
one AS (SELECT cid, min(filename) AS filename, min(total_size) AS total_size, min(file_id) AS file_id FROM manifests GROUP BY cid),
gone AS (SELECT DISTINCT cid FROM log WHERE source = 'src1')"""
_LISTED = f"{_LOG}, listed AS (SELECT token, o.cid, coalesce(filename, o.cid) AS filename, coalesce(total_size, 0) AS size FROM owners o LEFT JOIN one USING (cid) WHERE token IS NOT NULL)"
_ASKED = f"""{_LOG}, plain AS (SELECT cid, CASE WHEN token = {_token("'src2'", "'pw-src2'")} THEN substr(token, 7) ELSE token END AS stored FROM owners WHERE token IS NOT NULL),
asked AS (SELECT cid, stored, filename, who, CASE who WHEN 'owner' THEN stored WHEN 'other' THEN {_token("'someone'", "'pw-someone'")} END AS token
          FROM one LEFT JOIN plain USING (cid), (SELECT unnest(['owner', 'other', 'nobody']) AS who))"""
_OPEN = "(stored IS NULL OR NOT starts_with(stored, 'owner-') OR stored IS NOT DISTINCT FROM token)"

_SCRIPT = """
WITH conn AS (
    SELECT conv_id, max(turn) AS last, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, ((conv_id % 5) + 5) % 5 AS fault,
           min(turn) FILTER (WHERE octet_length(encode(text)) = 0) AS empty_turn
    FROM conversations GROUP BY conv_id)
SELECT conv_id AS conn_id,
       CASE fault WHEN 3 THEN 0 WHEN 2 THEN 1 ELSE coalesce(empty_turn + 2, last + CASE fault WHEN 4 THEN 10 ELSE 11 END) END AS seq,
       CASE WHEN fault IN (2, 3, 4) OR empty_turn IS NOT NULL THEN 'closed' WHEN fault = 1 THEN 'size_mismatch' ELSE 'uploaded' END AS event,
       CASE WHEN fault = 3 THEN 'empty token' WHEN fault = 2 THEN 'short start' WHEN empty_turn IS NOT NULL THEN 'empty chunk' WHEN fault = 4 THEN 'upload under way' ELSE 'chat-' || conv_id END AS detail,
       CASE WHEN fault IN (2, 3) THEN 0 WHEN empty_turn IS NULL THEN bytes
            ELSE (SELECT CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) FROM conversations c WHERE c.conv_id = conn.conv_id AND c.turn < empty_turn) END AS received
FROM conn"""

SQL: dict[str, str] = {
    "q01_chunk_documents": f"{_STORED} SELECT file_id, idx, size, sha256(data) AS data_sha256 FROM chunks",
    "q02_chunk_cid": f"{_STORED} SELECT file_id, idx, hash FROM chunks",
    "q03_unique_blocks": f"{_STORED} SELECT DISTINCT hash, size FROM chunks",
    "q04_dedup_report": f"""{_STORED} SELECT count(*) AS n_chunks, count(DISTINCT hash) AS n_blocks, CAST(sum(size) AS BIGINT) AS logical_bytes,
        (SELECT CAST(sum(size) AS BIGINT) FROM (SELECT DISTINCT hash, size FROM chunks)) AS stored_bytes FROM chunks""",
    "q05_new_blocks": f"{_SECOND}, {_chunks('more').replace('chunks AS', 'fresh AS', 1)} SELECT DISTINCT hash, size FROM fresh WHERE hash NOT IN (SELECT hash FROM stored)",
    "q06_build_manifests": f"{_NAMED} SELECT file_id, cid, total_size, chunk_count, sha256(body) AS manifest_sha256 FROM manifests",
    "q07_parse_manifest": f"{_NAMED} SELECT cid, 1::BIGINT AS version, 'sha2-256' AS hash_algo, 1024::BIGINT AS chunk_size, total_size, filename, chunk_count AS n_chunks FROM manifests",
    "q08_explode_manifest": f"{_NAMED} SELECT cid, idx, size, hash FROM manifests JOIN chunks USING (file_id)",
    "q09_list_files": f"{_LISTED} SELECT token, cid, filename, size FROM listed",
    "q10_list_missing_manifest": f"""{_LISTED} SELECT token, cid, CASE WHEN filename = 'es.txt' THEN cid ELSE filename END AS filename,
        CASE WHEN filename = 'es.txt' THEN 0 ELSE size END AS size FROM listed""",
    "q11_list_unauthenticated": f"""{_LISTED} SELECT source, (SELECT count(*) FROM listed l WHERE l.token = {_token("s.source", "'pw-' || s.source")}) AS n_files
        FROM (SELECT DISTINCT source FROM documents) s UNION ALL SELECT 'nobody', 0""",
    "q12_reassemble": "SELECT doc_id AS file_id, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS content_sha256 FROM documents WHERE text <> ''",
    "q13_download_decision": f"{_ASKED} SELECT cid, who, CASE WHEN NOT {_OPEN} THEN 'AUTH_ERROR' WHEN filename = 'fr.txt' THEN 'DOWNLOAD_ERROR' ELSE 'OK' END AS download FROM asked",
    "q14_delete_decision": f"{_ASKED} SELECT cid, who, CASE WHEN stored IS NULL THEN token IS NULL ELSE {_OPEN} END AS can_delete FROM asked",
    "q15_verify_blocks": f"{_STORED} SELECT file_id, idx, hash, CASE right(hash, 1) WHEN 'b' THEN 'missing' WHEN 'a' THEN 'corrupt' ELSE 'ok' END AS status FROM chunks",
    "q16_size_mismatch": f"{_STORED} SELECT file_id, count(*) FILTER (WHERE right(hash, 1) = 'a') AS n_differ, count(*) AS n_chunks FROM chunks GROUP BY file_id",
    "q17_declared_size_check": """WITH s AS (SELECT doc_id AS file_id, CASE WHEN lang = 'de' THEN 0 ELSE n_chars END AS declared, CAST(octet_length(encode(text)) AS BIGINT) AS received FROM documents)
        SELECT *, CASE WHEN declared <> 0 AND declared <> received THEN -2 ELSE 0 END AS rc FROM s""",
    "q18_refcounts": f"""{_LOG} SELECT hash, count(*) AS literal_refs, count(*) FILTER (WHERE file_id IN (SELECT file_id FROM one)) AS live_refs
        FROM chunks GROUP BY hash""",
    "q19_refcounts_after_delete": f"{_LOG} SELECT hash, count(*) AS live_refs FROM chunks JOIN one USING (file_id) WHERE cid NOT IN (SELECT cid FROM gone) GROUP BY hash",
    "q20_gc_candidates": f"{_LOG} SELECT DISTINCT hash, size FROM chunks WHERE hash NOT IN (SELECT hash FROM chunks JOIN one USING (file_id) WHERE cid NOT IN (SELECT cid FROM gone))",
    "q21_live_files_after_delete": f"{_LOG} SELECT cid, filename, total_size FROM one WHERE cid NOT IN (SELECT cid FROM gone)",
    "q22_resume_plan": f"""{_LOG} SELECT m.file_id, l.token, m.total_size, min(idx) AS next_index, count(*) AS n_left, CAST(sum(size) AS BIGINT) AS bytes_left
        FROM manifests m JOIN log l ON l.seq = m.file_id JOIN chunks c ON c.file_id = m.file_id AND idx >= chunk_count // 2 GROUP BY ALL""",
    "q23_owner_last_writer": f"{_LOG} SELECT cid, token FROM owners",
    "q24_rechunk_frames": f"""WITH whole AS (SELECT conv_id AS conn_id, encode(string_agg(text, '' ORDER BY turn)) AS content FROM conversations GROUP BY conv_id),
        {_chunks("whole", 256, "conn_id")} SELECT conn_id, idx, size, sha256(data) AS data_sha256 FROM chunks""",
    "q25_upload_progress": f"{_STORED} SELECT a.file_id, a.idx, CAST(sum(b.size) AS BIGINT) AS received, count(*) AS n_committed FROM chunks a JOIN chunks b ON a.file_id = b.file_id AND b.idx <= a.idx GROUP BY ALL",
    "q26_auth_tokens": f"""SELECT CASE WHEN attempt = 'unknown' THEN source || '?' ELSE source END AS username, attempt, attempt = 'right' AS ok,
        CASE WHEN attempt = 'right' THEN {_token("source", "'pw-' || source")} END AS token
        FROM (SELECT DISTINCT source FROM documents), (SELECT unnest(['right', 'wrong', 'unknown']) AS attempt)""",
    "q27_frame_codec": """WITH f AS (SELECT conv_id AS conn_id, turn AS seq, encode(text) AS p, conv_id || '-' || turn AS name, CAST(octet_length(encode(text)) AS BIGINT) AS length FROM conversations)
        SELECT conn_id, seq, '02' || lower(printf('%08x', length)) AS head, sha256(unhex('02' || printf('%08x', length)) || p) AS frame_sha256, 2 AS op, length, true AS same, true AS cut_detected,
               printf('%016x', length) || lower(hex(encode(name))) AS start_hex, length AS declared FROM f""",
    "q28_shard_distribution": f"""{_STORED}, b AS (SELECT DISTINCT hash FROM chunks)
        SELECT 'prefix' AS scheme, hash[1:2] || '/' || hash[3:4] AS shard, count(*) AS n_blocks FROM b GROUP BY ALL
        UNION ALL SELECT 'suffix', hash[57:57], count(*) FROM b GROUP BY ALL""",
    "q29_same_bytes_other_name": f"""{_NAMED}, {_manifests("copies", "'copy-of-' || filename")}
        SELECT m.file_id, m.cid, c.cid AS copy_cid, m.cid <> c.cid AS cids_differ, true AS same_chunks FROM manifests m JOIN copies c USING (file_id)""",
    "q30_list_json": f"""{_LISTED}, placed AS (
        SELECT *, count(*) OVER (PARTITION BY token) AS n, {" + ".join(f"(strpos('abcdefghijklmnopqrstuvwxyz234567', substr(cid, {54 + k}, 1)) - 1) * {32 ** (3 - k)}" for k in range(4))} AS place FROM listed)
        SELECT token, (place * ((n + 19) // 20)) // 1048576 AS page, '[' || string_agg('{{"cid":"' || cid || '","filename":"' || filename || '","size":' || size || '}}', ',' ORDER BY cid) || ']' AS response FROM placed GROUP BY ALL""",
    "q31_session_errors": _SCRIPT,
    "q32_stream_sessions": _SCRIPT,
    "q34_name_fallbacks": f"""WITH {_files("CASE WHEN lang = 'fr' THEN 'unnamed' ELSE 'doc-' || doc_id || '.txt' END")}, {_chunks()}, {_manifests()}
        SELECT file_id, filename AS stored_name, CASE WHEN filename = 'unnamed' THEN cid ELSE filename END AS shown_name FROM manifests""",
    "q35_owner_path_roundtrip": f"{_LOG} SELECT cid, token, true AS is_owner FROM owners WHERE token IS NOT NULL",
    "q36_response_classify": f"{_LOG} SELECT file_id, CASE WHEN filename = 'en.txt' THEN cid END AS cid FROM manifests",
    "q37_empty_inputs": f"""WITH {_files("'doc-' || doc_id || '.txt'", "CASE WHEN lang = 'es' THEN ''::BLOB ELSE encode(text) END")}, {_chunks()}, {_manifests()}
        SELECT file_id, cid, total_size, chunk_count, total_size > 0 AS gateway_accepts, CASE WHEN chunk_count = 0 THEN 'done' ELSE 'chunks' END AS download FROM manifests""",
    "q38_users_from_json": "SELECT DISTINCT source AS username, sha256(source || ':x') AS password_hash, 1700000000500 AS created_ms FROM documents WHERE lang <> 'es'",
    "q39_block_exists": f"{_SECOND}, {_chunks('more').replace('chunks AS', 'fresh AS', 1)} SELECT count(*) AS n_present FROM (SELECT hash FROM fresh UNION SELECT hash FROM chunks) WHERE hash IN (SELECT hash FROM stored)",
    "q40_upload_ids": f"{_NAMED} SELECT file_id, left(filename || '-1700000000', 255) AS upload_id, left(cid, 10) AS hash_preview FROM manifests",
    "q41_client_slices": f"""WITH whole AS (SELECT page_id, encode(html) AS content FROM pages), {_chunks("whole", 262144, "page_id")}
        SELECT page_id, idx, size, sha256(data) AS data_sha256, true AS same FROM chunks""",
    "q43_put_files": f"""{_LOG}, odd_last AS (SELECT cid, count(*) AS n_uploads, arg_max_null(token, seq) AS token FROM log GROUP BY cid)
        SELECT o.cid, filename, total_size, n_uploads, o.token, (SELECT count(DISTINCT hash) FROM chunks) AS n_blocks, (SELECT CAST(sum(size) AS BIGINT) FROM (SELECT DISTINCT hash, size FROM chunks)) AS stored_bytes
        FROM odd_last o JOIN one USING (cid)""",
    "q44_delete_files": f"""{_LOG}, asked AS (SELECT o.cid, o.token AS stored, CASE total_size % 3 WHEN 0 THEN o.token WHEN 1 THEN {_token("'someone'", "'pw-someone'")} END AS token FROM owners o JOIN one USING (cid)),
        decided AS (SELECT cid, CASE WHEN stored IS NULL THEN token IS NULL ELSE stored IS NOT DISTINCT FROM token END AS ok FROM asked)
        SELECT cid, CASE WHEN ok THEN 'deleted' ELSE 'AUTH_ERROR' END AS outcome, NOT ok AS there FROM decided UNION ALL SELECT 'nothing', 'missing', false""",
    "q45_create_users": """SELECT source AS username, sha256(source || ':' || 'pw-' || arg_min(doc_id, (doc_id % 2) * 1000000000000 + doc_id)) AS password_hash, true AS dated, count(*) - 1 AS n_turned_away FROM documents GROUP BY source""",
    "q46_resume_requests": f"""{_NAMED}, asked AS (SELECT file_id, CASE WHEN file_id % 11 = 0 THEN 'RESUME_ERROR: invalid arguments' WHEN file_id % 7 = 0 OR file_id % 3 = 0 THEN 'RESUME_ERROR: no manifest found for upload_id' ELSE 'RESUME_OK' END AS reply, chunk_count FROM manifests)
        SELECT file_id, reply, CASE WHEN reply = 'RESUME_OK' THEN chunk_count // 2 END AS next_index FROM asked""",
    "q47_session_access": f"""{_LOG}, asked AS (SELECT file_id, cid, o.token AS stored, filename, k, CASE k WHEN 0 THEN o.token WHEN 1 THEN {_token("'someone'", "'pw-someone'")} END AS token
            FROM owners o JOIN one USING (cid), (SELECT unnest([0, 1, 2]) AS k)),
        said AS (SELECT *, stored IS NULL OR stored IS NOT DISTINCT FROM token AS open, file_id * 3 + k AS conn_id FROM asked),
        first AS (SELECT *, CASE WHEN NOT open THEN 'AUTH_ERROR' WHEN filename = 'fr.txt' THEN 'DOWNLOAD_ERROR' END AS fault FROM said),
        third AS (SELECT *, CASE WHEN file_id % 5 = 0 THEN 'empty delete' WHEN stored IS NULL AND token IS NOT NULL THEN 'AUTH_ERROR' END AS refused FROM first WHERE fault IS NULL)
        SELECT conn_id, 1 AS seq, CASE WHEN fault IS NULL THEN 'download' ELSE 'closed' END AS event, coalesce(fault, cid) AS detail FROM first
        UNION ALL SELECT conn_id, 2, 'download', cid FROM third
        UNION ALL SELECT conn_id, 3, CASE WHEN refused IS NULL THEN 'delete' ELSE 'closed' END, coalesce(refused, cid) FROM third
        UNION ALL SELECT conn_id, 4, 'list', coalesce(token, '') FROM third WHERE refused IS NULL""",
    "q48_session_resume": """WITH s AS (SELECT doc_id AS conn_id, doc_id % 5 <> 0 AND doc_id % 2 = 0 AS ok FROM documents)
        SELECT conn_id, 0 AS seq, CASE WHEN ok THEN 'resumed' ELSE 'closed' END AS event, CASE WHEN ok THEN 'up-' || conn_id ELSE 'RESUME_ERROR' END AS detail, 0 AS received FROM s
        UNION ALL SELECT conn_id, 2, 'uploaded', 'up-' || conn_id, 4 FROM s WHERE ok""",
    "q49_signed_in": f"""SELECT doc_id, source AS username, {_token("source", "'pw-' || source")} AS token FROM documents WHERE lang NOT IN ('fr', 'es', 'de')""",
}
