"""DuckDB SQL of the service queries."""

from __future__ import annotations

from readalong.plans import fixtures
from readalong.plans import oracles as o

_EMPTY = "Text is empty after cleaning"
_CLEANED = o._chain("SELECT doc_id, coalesce(text, '') AS t FROM documents", "doc_id", *o._CLEAN)
_CLEAN_CHUNKS = o._chunks(f"SELECT doc_id, t AS text FROM ({_CLEANED})")


def _line(stem: str = "doc_id") -> str:
    number = "CASE WHEN chunk_index < 10000 THEN lpad(CAST(chunk_index AS VARCHAR), 4, '0') ELSE CAST(chunk_index AS VARCHAR) END"
    return f"'file ''audio/' || {stem} || '_chunk_' || {number} || '.wav'''"


_TALKS = "SELECT conv_id AS doc_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1"
_TALK_CHUNKS = o._chunks(f"SELECT doc_id, t AS text FROM ({o._chain(_TALKS, 'doc_id', *o._CLEAN)})")
_WORDS = f"""{o._TURNS}, {o._timing('turns')},
w0 AS (SELECT doc_id, chunk_index, "start", "end", unnest(l) AS norm, generate_subscripts(l, 1) - 1 AS word_pos FROM (SELECT *, {o._tokens('text')} AS l FROM timing)),
w1 AS (SELECT *, length(norm) AS k, sum(length(norm)) OVER (PARTITION BY doc_id, chunk_index) AS total, sum(length(norm)) OVER (PARTITION BY doc_id, chunk_index ORDER BY word_pos ROWS UNBOUNDED PRECEDING) AS upto FROM w0),
est AS (SELECT doc_id, norm, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, word_pos) - 1 AS INTEGER) AS word_idx, round(least("end", "start" + ("end" - "start") / total * upto) + 1e-9, 3) AS e FROM w1),
spoken AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'forced-whisper' ELSE 'estimated-chunk' END AS timing_source FROM est WHERE doc_id % 3 <> 0 OR word_idx % 7 <> 3)"""
_ALIGNED = f"""WITH RECURSIVE {_WORDS},
a AS (SELECT doc_id, list(norm ORDER BY word_idx) AS two FROM est GROUP BY 1), b AS (SELECT doc_id, any_value(timing_source) AS timing_source, list(norm ORDER BY word_idx) AS one FROM spoken GROUP BY 1),
ab AS (SELECT * FROM a JOIN b USING (doc_id)),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, CAST(-1 AS BIGINT) AS hit_i, CAST(-1 AS BIGINT) AS hit_j FROM ab
  UNION ALL SELECT doc_id,
    CASE WHEN same THEN i + 1 WHEN p > 0 THEN i WHEN q > 0 THEN i + q ELSE i + 1 END, CASE WHEN same THEN j + 1 WHEN p > 0 THEN j + p WHEN q > 0 THEN j ELSE j + 1 END,
    CASE WHEN same THEN i ELSE -1 END, CASE WHEN same THEN j ELSE -1 END
  FROM (SELECT r.doc_id, i, j, one[i + 1] = two[j + 1] AS same, coalesce(list_position(list_slice(two, j + 2, j + 9), one[i + 1]), 0) AS p, coalesce(list_position(list_slice(one, i + 2, i + 9), two[j + 1]), 0) AS q
    FROM r JOIN ab ON ab.doc_id = r.doc_id WHERE i < len(one) AND j < len(two))),
n AS (SELECT doc_id, count(*) AS n, list({{'spoken_idx': hit_i, 'printed_idx': hit_j}} ORDER BY hit_i) AS words FROM r WHERE hit_i >= 0 GROUP BY 1)
SELECT doc_id, CAST(to_json({{'timing_source': timing_source, 'spoken_word_count': len(one), 'pdf_word_count': len(two), 'aligned_word_count': coalesce(n, 0), 'coverage': round(coalesce(n, 0) * 100.0 / len(one), 2), 'words': coalesce(words, [])}}) AS VARCHAR) AS json FROM ab LEFT JOIN n USING (doc_id)"""
_LAID = f"""SELECT b.*, m.keep AS laid FROM ({fixtures.LAID}) b LEFT JOIN (SELECT doc_id, page_index, ordinal, coalesce(bool_or(keep) FILTER (ratio >= 0.35), false) AS keep
FROM (SELECT b.doc_id, b.page_index, b.ordinal, r.keep, {o._OVERLAP.format(a='b', b='r', least='1e-6')} AS ratio FROM ({fixtures.LAID}) b JOIN ({fixtures.REGIONS}) r USING (doc_id, page_index)) GROUP BY ALL) m USING (doc_id, page_index, ordinal)"""
_REASONS = f"""SELECT b.*, CASE WHEN laid = false THEN 'layout-filter' WHEN r.n IS NOT NULL THEN 'repeated-margin' WHEN page_index > 0 AND c < 0.08 AND words <= 20 THEN 'top-margin' WHEN c > 0.88 AND words <= 35 THEN 'bottom-margin' END AS drop_reason
FROM (SELECT *, {o._FP} AS fp, {o._CENTER} AS c, len(list_filter(string_split_regex(txt, '\\s+'), lambda w: w <> '')) AS words FROM ({_LAID})) b LEFT JOIN ({o._repeated(fixtures.LAID)}) r ON r.doc_id = b.doc_id AND r.fp = b.fp"""
_NUMBERED = "(SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)"
_ROWS = f"SELECT doc_id, 'Before' || chr(10) || '| No | Line |' || chr(10) || '|---|:--|' || chr(10) || array_to_string(list_transform(l, lambda x, i: '| ' || i || ' | ' || replace(x, '|', '/') || ' |'), chr(10)) || chr(10) || 'after' AS text FROM {_NUMBERED}"
_ITEMS = f"SELECT doc_id, array_to_string(list_transform(l, lambda x, i: CASE (i - 1) % 3 WHEN 0 THEN '- ' || x WHEN 1 THEN i || ') ' || x ELSE x END), chr(10)) AS t FROM {_NUMBERED}"
_GRID = f"SELECT doc_id, CAST((k - 1) // 40 AS INTEGER) AS page_index, CAST((k - 1) % 40 AS INTEGER) AS ordinal, CASE WHEN (k - 1) % 2 = 0 THEN 320.0 ELSE 50.0 END::DOUBLE AS x0, ((k - 1) % 40 * 19)::DOUBLE AS y0 FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS k FROM {_NUMBERED})"
_ERRORS = "doc_id % 10 = 3"


def oracle_sql() -> dict[str, str]:
    """By query name."""
    return {
        "reader_run": f"""{_CLEAN_CHUNKS}, {o._timing('chunks')}, made AS (SELECT doc_id, count(*) AS n, max_by("end", chunk_index) AS total, md5(string_agg({_line()}, chr(10) ORDER BY chunk_index)) AS manifest_md5, md5(string_agg(text, chr(10) ORDER BY chunk_index)) AS chunks_md5 FROM timing GROUP BY 1)
SELECT d.doc_id, CASE WHEN n IS NULL THEN 'error' ELSE 'done' END AS status, CASE WHEN n IS NULL THEN '{_EMPTY}' END AS error, length(d.text) AS char_count, coalesce(n, 0) AS n_chunks, coalesce(total, 0) AS total, manifest_md5, chunks_md5,
CASE WHEN n IS NOT NULL THEN 'output/final/' || d.doc_id || '.wav' END AS final_wav, CASE WHEN n IS NOT NULL THEN 'output/final/' || d.doc_id || '.mp3' END AS final_mp3 FROM d LEFT JOIN made USING (doc_id)""",
        "reader_coverage": f"""{_TALK_CHUNKS}, {o._boxes(f"SELECT doc_id, chunk_index, {o._tokens('text')} AS ch FROM chunks")} SELECT * FROM cover""",
        "run_options": "SELECT * FROM (VALUES ('chunk_size', '400'), ('allowance', '200'), ('generate_mp3', 'true'), ('remove_references', 'true'), ('keep_chunks', 'false'), ('output_dir', 'output')) AS t(name, value)",
        "preflight_check": f"SELECT job_id, count(*) FILTER (NOT coalesce(present, false)) = 0 AS ok, count(*) FILTER (NOT coalesce(present, false)) AS n_missing, 'Dependency check failed: ' || string_agg(name, ', ' ORDER BY name) FILTER (NOT coalesce(present, false)) AS message FROM ({fixtures.REQUIREMENTS}) GROUP BY 1",
        "source_requests": f"""WITH r AS (SELECT request_id, nullif(pdf_path, '') AS p, nullif(upload, '') AS u FROM ({fixtures.REQUESTS})),
a AS (SELECT *, CASE WHEN p LIKE '/%' THEN p ELSE '/srv/' || p END AS path FROM r), k AS (SELECT DISTINCT path FROM ({fixtures.KNOWN})),
s AS (SELECT *, CASE WHEN (p IS NULL) = (u IS NULL) THEN 400 WHEN p IS NOT NULL AND path NOT IN (SELECT path FROM k) THEN 404 ELSE 200 END AS status FROM a)
SELECT request_id, status, CASE status WHEN 400 THEN 'Provide exactly one of ''pdf_path'' or ''file''.' WHEN 404 THEN 'PDF not found: ' || path END AS detail,
CASE WHEN status = 200 THEN coalesce(path, '/srv/uploads/' || coalesce(nullif(regexp_replace(regexp_replace(u, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'upload.pdf')) END AS path FROM s""",
        "decoded_texts": f"""WITH b AS (SELECT doc_id, TRY(decode(unhex(h))) AS utf, array_to_string(list_transform(range(length(h) // 2), lambda i: chr(CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER))), '') AS latin FROM ({fixtures.BYTES})),
t AS (SELECT doc_id, coalesce(utf, latin) AS text FROM b UNION ALL SELECT doc_id, coalesce(text, '') FROM documents)
SELECT doc_id, md5(text) AS text_md5, length(text) AS n_chars, {o._strip('text')} = '' AS is_blank FROM t""",
        "read_files": "SELECT n_nationkey, text, false AS is_blank, sha256(text) AS doc_key, true AS has_metadata_path FROM (SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name || ' lies in region ' || n_regionkey || chr(10) AS text FROM nation)",
        "read_metadata": "SELECT CAST(r_regionkey AS BIGINT) AS page_index, r_name AS text, CAST(NULL AS BOOLEAN) AS kept FROM region",
        "chunk_files": f"""{o._DOC_CHUNKS}, k AS (SELECT doc_id, chunk_index, doc_id || '_chunk_' || CASE WHEN chunk_index < 10000 THEN lpad(CAST(chunk_index AS VARCHAR), 4, '0') ELSE CAST(chunk_index AS VARCHAR) END AS key FROM chunks)
SELECT doc_id, count(*) AS n_chunks, min(key) AS first_key, max_by(key, chunk_index) AS last_key FROM k GROUP BY 1""",
        "source_page_files": "SELECT CAST(doc_id AS VARCHAR) AS stem, CAST(k AS INTEGER) AS page_index, doc_id || '_page_' || (k + 1) || '.pdf' AS page_name FROM (SELECT doc_id, unnest(range(CAST(ceil(length(coalesce(text, '')) / 3000) AS BIGINT))) AS k FROM documents)",
        "cache_skip": "WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents) SELECT * FROM h WHERE content_hash NOT IN (SELECT content_hash FROM h WHERE doc_id % 2 = 0)",
        "job_manifest": f"""WITH d AS (SELECT doc_id, CASE WHEN {_ERRORS} THEN ' ' || chr(10) ELSE t END AS text FROM ({o._WRAPPED})), h AS (SELECT doc_id, text, sha256(text) AS content_hash FROM d)
SELECT substr(sha256(doc_id || '|' || content_hash || '|mp3'), 1, 32) AS job_id, doc_id, content_hash, CASE WHEN {_ERRORS} THEN 'error' ELSE 'done' END AS status, CASE WHEN {_ERRORS} THEN '{_EMPTY}' END AS error FROM h""",
        "job_polls": f"""WITH e AS ({fixtures.STATES}), f AS (SELECT job_id, arg_min(status, at_ms) AS status, arg_min(coalesce(error, '?'), at_ms) AS error, min(at_ms) AS at_ms FROM e WHERE status IN ('done', 'error') GROUP BY 1)
SELECT j.job_id, coalesce(f.status, 'processing') AS status, CASE WHEN f.status = 'error' THEN CASE WHEN error = '?' THEN 'Page job failed: ' || j.job_id ELSE error END END AS error, CAST(ceil(at_ms / 3000) + 1 AS BIGINT) AS n_polls, CAST(ceil(at_ms / 3000) * 3000 AS BIGINT) AS waited_ms FROM (SELECT DISTINCT job_id FROM e) j LEFT JOIN f USING (job_id)""",
        "result_reads": f"""WITH b AS (SELECT a.job_id, a.what, r.job_id IS NULL AS unknown, r.status, CASE a.what WHEN 'metadata' THEN metadata WHEN 'highlights' THEN highlights WHEN 'audio' THEN audio ELSE '-' END AS path, a.what IN ('metadata', 'highlights', 'audio') AS res FROM ({fixtures.READS}) a LEFT JOIN ({fixtures.RESULTS}) r USING (job_id))
SELECT job_id, what, CASE WHEN unknown THEN 404 WHEN res AND status <> 'done' THEN 400 WHEN path IS NULL THEN 404 ELSE 200 END AS code, CASE WHEN unknown THEN 'Job not found' WHEN res AND status <> 'done' THEN 'Job not done (status: ' || status || ')' WHEN path IS NULL THEN 'No ' || what || ' in result' END AS detail,
'/api/v1/jobs/' || job_id || CASE WHEN what = 'status' THEN '' ELSE '/' || what END AS url FROM b""",
        "stream_progress": f"""{o._chunks(f"SELECT doc_id, text FROM documents WHERE NOT ({_ERRORS}) AND {o._strip('text')} <> ''")}
SELECT 'documents' AS what, count(*) AS n FROM documents UNION ALL SELECT 'errors', count(*) FROM documents WHERE {_ERRORS} OR {o._strip("coalesce(text, '')")} = '' UNION ALL SELECT 'chunks', count(*) FROM chunks""",
        "stage_metrics": f"""{o._DOC_CHUNKS}
SELECT 'extract' AS stage, count(*) AS rows, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars FROM documents UNION ALL SELECT 'clean', count(*), CAST(sum(length(t)) AS BIGINT) FROM ({_CLEANED}) UNION ALL SELECT 'chunk', count(*), CAST(sum(length(text)) AS BIGINT) FROM chunks""",
        "request_latency": "SELECT user_id, count(ms) AS n, round(avg(ms), 3) AS mean_ms, round(max(ms), 3) AS max_ms FROM (SELECT user_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1000 AS ms FROM events) GROUP BY 1",
        "merge_guard": f"""{o._DOC_CHUNKS}, m AS (SELECT doc_id, md5(string_agg({_line()}, chr(10) ORDER BY chunk_index)) AS manifest_md5 FROM chunks WHERE NOT ({_ERRORS}) GROUP BY 1)
SELECT doc_id, manifest_md5, CASE WHEN manifest_md5 IS NULL THEN 'No audio files to merge.' END AS error FROM documents LEFT JOIN m USING (doc_id)""",
        "timed_audio": f"""{o._DOC_CHUNKS}, {o._timing('(SELECT * FROM chunks WHERE chunk_index < 3)')} SELECT doc_id, chunk_index, "start", "end" FROM timing""",
        "nested_text": f"SELECT doc_id, md5({o._strip('t')}) AS text_md5 FROM (SELECT doc_id, array_to_string(list_filter(list_transform(l, lambda x: array_to_string(list_filter(list_transform(string_split(x, ' '), lambda w: {o._strip('w')}), lambda w: w <> ''), ' ')), lambda x: x <> ''), chr(10)) AS t FROM {_NUMBERED})",
        "layout_filter": f"SELECT doc_id, page_index, ordinal AS pos, drop_reason IS NULL AS kept, drop_reason FROM ({_REASONS})",
        "extract_layout": f"""WITH f AS ({_REASONS}), p AS ({o._ordered(fixtures.LAID)})
SELECT f.doc_id, string_agg(txt, chr(10) || chr(10) ORDER BY f.page_index, reading_pos) AS text FROM f JOIN p ON p.doc_id = f.doc_id AND p.page_index = f.page_index AND p.ordinal = f.ordinal WHERE drop_reason IS NULL GROUP BY 1""",
        "spoken_tables": o._tables(_ROWS),
        "spoken_lists": f"SELECT doc_id, {o._LISTS} AS text FROM ({_ITEMS})",
        "scanned_words": f"""WITH {o._PRINTED}, w AS (SELECT doc_id, page_index, ordinal, x0, y0, regexp_replace(replace(lower(word), '’', ''''), '[^a-z0-9'']+', '', 'g') AS norm FROM ({fixtures.WORDS})
UNION ALL SELECT doc_id + 1000, word_idx // 40, -word_idx, word_idx % 10 * 60.0, word_idx % 40 // 10 * 200.0, norm FROM printed)
SELECT doc_id, CAST(page_index AS INTEGER) AS page_index, CAST(ordinal AS INTEGER) AS ordinal, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_index, y0, x0, ordinal) - 1 AS INTEGER) AS word_idx, norm FROM w WHERE norm <> ''""",
        "document_order": o._ordered(_GRID),
        "timing_source": f"""WITH {_WORDS}, s AS (SELECT doc_id, timing_source, count(*) AS n_spoken, round(max(e), 3) AS last_end FROM spoken GROUP BY ALL)
SELECT s.*, CASE WHEN doc_id % 2 = 0 THEN 'metadata' ELSE 'scan' END AS word_source, n_printed FROM s JOIN (SELECT doc_id, count(*) AS n_printed FROM est GROUP BY 1) USING (doc_id)""",
        "alignment_payload": _ALIGNED,
        "active_highlight": f"""{o._BOXES}, {o._timing('turns')}, marks AS (SELECT doc_id, "start" AS t, CAST(chunk_index AS BIGINT) AS idx FROM timing),
probes AS (SELECT doc_id, k AS probe_id, round(total * (k - 1) / 7, 3) AS t FROM (SELECT doc_id, max_by("end", chunk_index) AS total FROM timing GROUP BY 1), range(10) AS g(k)),
act AS ({o._ACTIVE.format(by='doc_id')}) SELECT a.doc_id, a.probe_id, a.active, b.page_index, b.nx0, b.ny0, b.nx1, b.ny1 FROM act a LEFT JOIN boxes b ON b.doc_id = a.doc_id AND b.chunk_index = a.active""",
        "page_append": f"""{o._DOC_CHUNKS}, pg AS (SELECT doc_id, CAST(chunk_index // 5 AS INTEGER) AS page_index, count(*) AS n_chunks FROM chunks GROUP BY ALL)
SELECT *, CASE WHEN page_index = 0 OR page_index % 2 = 1 THEN 1 ELSE 0 END AS turn, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_index) - 1 AS INTEGER) AS position FROM pg""",
        "page_size": f"""WITH s AS (SELECT page_index, greatest(1, abs(coalesce(x1, 1) - coalesce(x0, 0))) AS w, greatest(1, abs(coalesce(y1, 1) - coalesce(y0, 0))) AS h FROM ({fixtures.VIEWS}))
SELECT coalesce(s.page_index, k.page_index) AS page_index, coalesce(w, width) AS width, coalesce(h, height) AS height, w IS NOT NULL AND (w IS DISTINCT FROM width OR h IS DISTINCT FROM height) AS changed FROM s FULL JOIN ({fixtures.SIZES}) k ON k.page_index = s.page_index""",
        "unit_display": "SELECT doc_id, printf('%.2f MB', n * 1000 / 1024 / 1024) AS size, CASE WHEN n > 0 THEN CAST(floor(n / 16 / 60 + 0.5) AS BIGINT) || 'm audio' END AS audio FROM (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents)",
        "elapsed_split": "SELECT k AS id, k // 60 AS mins, k % 60 AS secs FROM range(0, 4000, 37) AS r(k)",
        "auto_advance": f"""{o._DOC_TIMING}, pg AS (SELECT doc_id, CAST(chunk_index // 5 AS INTEGER) AS page_index, list("start" ORDER BY chunk_index) AS starts FROM timing GROUP BY ALL)
SELECT doc_id, page_index, lead(page_index) OVER w AS next_page, lead(page_index) OVER w IS NOT NULL AS autoplay, CASE WHEN page_index % 2 = 0 THEN starts[least(len(starts), page_index + 3)] END AS seek FROM pg WINDOW w AS (PARTITION BY doc_id ORDER BY page_index)""",
        "null_defaults": f"SELECT doc_id, page_index, CASE WHEN first_start IS NULL THEN 0 ELSE 1 END AS n_timing, CASE WHEN page_count > 0 THEN CAST(page_count AS BIGINT) ELSE count(*) OVER (PARTITION BY doc_id) END AS total_pages FROM ({fixtures.RESULT_PAGES})",
    }
