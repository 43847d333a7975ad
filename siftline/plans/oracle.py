"""SQL with the same results as the queries of the catalogue."""

from __future__ import annotations

from siftline.operators.rows import ADDRESS, CONTACT, IDENTIFIER, PERSON, PHYSICAL
from siftline.settings import FORMATS, setting

_F = "(SELECT DISTINCT * FROM findings)"
_I = "(SELECT DISTINCT scan_id, path, name, decoded_name, size_bytes, original_extension, status, method, mime, extension, family, is_binary, confidence, message, scanned_at FROM file_inventory)"
_B = "(SELECT block_id, any_value(file_path) AS file_path, any_value(block_index) AS block_index, any_value(source_type) AS source_type, any_value(extraction_method) AS extraction_method, any_value(text) AS text, any_value(warnings) AS warnings, any_value(ocr) AS ocr, any_value(embedded_payload) AS embedded_payload, any_value(embedded_document_like) AS embedded_document_like, any_value(table_semantic_hints) AS table_semantic_hints, any_value(physical_person_mentions) AS physical_person_mentions FROM text_blocks GROUP BY block_id)"
_A = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY assessed_at DESC, assessment_id DESC) AS k FROM assessments) WHERE k = 1)"


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w.lower()}')" for w in words) + ")"


def _weights(column: str, table: dict[str, float], default: float = 0) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in table.items()) + f" ELSE {float(default)} END"


def _words(words: list[str] | dict[str, float]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_T, _P, _R = setting("triage"), setting("planner"), setting("risk")
_BASE = f"(SELECT *, {_weights('category', _R['weights'], _R['default_weight'])} AS w FROM (SELECT file_path, category, sum(count) AS n FROM {_F} GROUP BY 1, 2))"
_FLAGS = f"""(SELECT *, {_any("p", _P["suspicious"])} AS suspicious, {_any("p", _P["business"])} AS business, {_any("p", _P["scan_folders"])} AS scan FROM
 (SELECT path, any_value(lower(path)) AS p, any_value(lower(name)) AS nm, any_value(size_bytes) AS size_bytes, any_value(status) AS status, any_value(mime) AS mime, any_value(extension) AS extension, any_value(family) AS family, any_value(is_binary) AS is_binary FROM {_I} GROUP BY path))"""
_PLANS = f"""(SELECT *, CASE WHEN status = 'error' OR size_bytes = 0 THEN 'skip' WHEN family = 'executable' THEN 'binary_embedded_payload_probe' WHEN family = 'archive' THEN 'defer_archive'
  WHEN family = 'structured' THEN 'structured_parse' WHEN family IN ('web', 'text') THEN 'cheap_text' WHEN family = 'spreadsheet' THEN 'table_parse'
  WHEN family = 'document' AND mime = 'application/vnd.ms-office' THEN 'legacy_office_container' WHEN family = 'document' AND extension = 'pdf' THEN 'pdf_text_then_ocr'
  WHEN family = 'document' AND extension = 'docx' THEN 'docx_text_then_embedded_ocr' WHEN family = 'document' AND extension = 'rtf' THEN 'cheap_text' WHEN family = 'document' AND extension = 'doc' THEN 'office_conversion'
  WHEN family = 'document' THEN 'generic_document' WHEN family = 'presentation' THEN 'presentation_text_then_embedded_ocr' WHEN family = 'image' AND size_bytes < {_P["small_image_bytes"]} AND NOT suspicious THEN 'skip'
  WHEN family = 'image' THEN 'image_prefilter_then_ocr' WHEN family = 'video' THEN 'video_sparse_frame_ocr' WHEN NOT coalesce(is_binary, false) THEN 'cautious_text_fallback' ELSE 'manual_review_or_custom_extractor' END AS strategy,
  CASE WHEN status = 'error' THEN 'scanner_error' WHEN size_bytes = 0 THEN 'empty_file' WHEN family = 'image' AND size_bytes < {_P["small_image_bytes"]} AND NOT suspicious THEN 'tiny_image' END AS skip_reason FROM {_FLAGS})"""
_ESC = "strategy IN ('pdf_text_then_ocr', 'docx_text_then_embedded_ocr', 'presentation_text_then_embedded_ocr', 'image_prefilter_then_ocr', 'video_sparse_frame_ocr')"
_PERSONAL = _any("p", _T["personal"])
_SIGNALS = [
    ("suspicious_name", 42, "suspicious"), ("high_ocr_context", 20, "scan"), ("personal_keyword", 55, _PERSONAL), ("export_keyword", 34, _any("p", _T["export"])), ("informal_employee_folder", 92, _any("p", ["мои бумажки"])),
    ("employee_context", 45, _any("p", ["employes", "employees"])), ("lost_found_binary", 80, "(contains(p, 'lost+found') AND family = 'executable')"), ("scan_archive", 72, _any("p", ["архив сканы"])),
    ("subsidiary_context", 18, _any("p", ["дочерние предприятия"])), ("billing_context", 18, _any("p", ["billing"])), ("full_export", 12, "(contains(p, '/full/') OR starts_with(nm, 'full'))"),
    ("physical_person_hint", 42, "(contains(nm, 'physical') OR contains(p, 'физ'))"), ("people_table_name", 28, _any("nm", ["customers", "clients", "subscribers"])), ("low_value_export_name", -38, _any("nm", _T["low_value"])),
    ("operational_logistics_context", -12, _any("p", ["logistic", "логист"])), ("generic_web_snapshot", -12, "(family = 'web' AND regexp_full_match(nm, 'page_.*\\.html?'))"), ("publicish_context", -20, _any("p", _T["public"])),
    ("business_context", -18, f"(business AND NOT {_PERSONAL})"),
]  # fmt: skip
_SCORE = " + ".join([_weights("coalesce(family, 'unknown')", _T["family"]), _weights("coalesce(extension, 'unknown')", _T["extension"]), *(f"CASE WHEN {c} THEN {w} ELSE 0 END" for _, w, c in _SIGNALS)])
_TRIAGE = f"""(SELECT *, CASE WHEN blocked <> '' THEN 0.0 ELSE greatest(raw, 0.0) END AS triage_score FROM (SELECT *, {_SCORE} AS raw,
  CASE WHEN skip_reason IS NOT NULL THEN 'skip: planner skipped file (' || skip_reason || ')' WHEN family = 'archive' THEN 'skip: archive needs separate safe unpacking policy' WHEN family IN ('image', 'presentation') THEN 'skip: ' || family || ' OCR is reserved for hard mode' ELSE '' END AS blocked,
  CASE WHEN family IN ('text', 'structured', 'spreadsheet') THEN 'text_table' WHEN family = 'document' THEN 'document' WHEN family = 'web' THEN 'web' WHEN family IN ('executable', 'video') THEN 'binary_media' WHEN family IN ('image', 'presentation') THEN 'ocr_media' ELSE 'other' END AS bucket,
  CASE WHEN skip_reason IS NOT NULL THEN 'planner_skip:' || skip_reason WHEN family IN ('archive', 'image', 'presentation') THEN family ELSE array_to_string(list_filter([
   CASE WHEN coalesce(family, 'unknown') IN ({_words(_T["family"])}) THEN 'family:' || family END, CASE WHEN extension IN ({_words(_T["extension"])}) THEN 'ext:' || extension END,
   {", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, _, c in _SIGNALS)}], lambda x: x IS NOT NULL), ',') END AS signals FROM {_PLANS}))"""
_NAMED = _any("nm", ["паспорт", "passport", "удостовер", "identity", "identification", "driver", "license", "анкета", "заявление", "согласие", "пропуск", "дмс", "dms", "personal", "личн", "scan", "скан", "photo", "фото"])
_BASELINE = f"coalesce(family IN ('executable', 'video', 'text', 'structured', 'spreadsheet') OR (family = 'document' AND extension IN ('docx', 'rtf', 'doc') AND ({_NAMED} OR {_any('p', ['мои бумажки', 'employes', 'employees'])} OR contains(p, '/прочее/'))) OR (family = 'web' AND {_NAMED}), false)"
_CAPS = _weights("bucket", _T["bucket_caps"]["normal"])
_OCR = f"(CASE WHEN family IN ('image', 'video') THEN 30 ELSE 0 END + CASE WHEN family = 'document' AND extension = 'pdf' THEN 18 ELSE 0 END + CASE WHEN family = 'presentation' THEN 12 ELSE 0 END + CASE WHEN extension IN ('tif', 'tiff') THEN 55 ELSE 0 END + CASE WHEN suspicious THEN 70 ELSE 0 END + CASE WHEN contains(p, 'архив сканы') THEN 60 ELSE 0 END + CASE WHEN scan THEN 20 ELSE 0 END + CASE WHEN {_any('p', ['паспорт', 'удостовер', 'анкета', 'согласие', 'личн'])} THEN 45 ELSE 0 END + CASE WHEN {_any('p', ['прочее', 'документы партнеров', 'сайты'])} THEN -20 ELSE 0 END)"
_FIRST = """CASE strategy WHEN 'binary_embedded_payload_probe' THEN 'binary_payload_extractor' WHEN 'defer_archive' THEN 'archive_inventory' WHEN 'table_parse' THEN 'spreadsheet_extractor'
  WHEN 'structured_parse' THEN CASE WHEN extension IN ('csv', 'tsv') THEN 'csv_extractor' WHEN extension IN ('json', 'parquet') THEN extension || '_extractor' ELSE 'structured_extractor' END
  WHEN 'cheap_text' THEN CASE family WHEN 'web' THEN 'html_text_extractor' WHEN 'text' THEN 'plain_text_extractor' ELSE 'rtf_text_extractor' END WHEN 'legacy_office_container' THEN 'legacy_office_extractor'
  WHEN 'pdf_text_then_ocr' THEN 'pdf_text_extractor' WHEN 'docx_text_then_embedded_ocr' THEN 'docx_text_extractor' WHEN 'office_conversion' THEN 'legacy_doc_extractor' WHEN 'generic_document' THEN 'document_extractor'
  WHEN 'presentation_text_then_embedded_ocr' THEN 'presentation_text_extractor' WHEN 'image_prefilter_then_ocr' THEN 'image_prefilter' WHEN 'video_sparse_frame_ocr' THEN 'video_metadata' WHEN 'cautious_text_fallback' THEN 'plain_text_extractor' END"""
_PRIORITY = """CASE WHEN strategy IN ('structured_parse', 'pdf_text_then_ocr', 'docx_text_then_embedded_ocr') OR (strategy = 'cheap_text' AND family <> 'document') THEN 10 WHEN strategy = 'cheap_text' THEN 20
  WHEN strategy IN ('table_parse', 'image_prefilter_then_ocr') THEN 15 WHEN strategy = 'presentation_text_then_embedded_ocr' THEN 25 WHEN strategy IN ('binary_embedded_payload_probe', 'office_conversion') THEN 35
  WHEN strategy IN ('legacy_office_container', 'video_sparse_frame_ocr') THEN 40 WHEN strategy = 'generic_document' THEN 50 WHEN strategy = 'cautious_text_fallback' THEN 60 WHEN strategy = 'defer_archive' THEN 70 END"""
_OCR_PRIORITY = "CASE WHEN extension IN ('tif', 'tiff') THEN 10 WHEN scan OR suspicious THEN 15 WHEN business THEN 65 ELSE 40 END"


def _digits(value: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"CAST(substr({value}, {k + 1}, 1) AS INT) * {w}" for k, w in enumerate(weights)) + ")"


def _key(n: int) -> str:
    return f"lpad(CAST(o_orderkey * 7919 % {10**n} AS VARCHAR), {n}, '0')"


_WS = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_REGISTRY = ", ".join(f"('{k}', '{f}', {b})" for k, (_, f, b) in FORMATS.items())

ORACLE: dict[str, str] = {
    "findings_by_file": f"SELECT file_path, sum(count)::BIGINT AS total_count, count(DISTINCT block_index) AS blocks_with_pii, count(DISTINCT category)::INT AS n_categories FROM {_F} GROUP BY 1",
    "categories_ordered": f"SELECT file_path, (row_number() OVER (PARTITION BY file_path ORDER BY n DESC, bi, fi) - 1)::INT AS k, category, n::BIGINT AS count FROM (SELECT file_path, category, sum(count) AS n, min(struct_pack(b := block_index, f := finding_id)).b AS bi, min(struct_pack(b := block_index, f := finding_id)).f AS fi FROM {_F} GROUP BY 1, 2)",
    "pii_summary": f"SELECT category, sum(count)::BIGINT AS total, count(DISTINCT file_path) AS files, count(*) AS findings FROM {_F} GROUP BY 1",
    "top_files": f"SELECT file_path, sum(count)::BIGINT AS total_count FROM {_F} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "finding_examples": f"SELECT finding_id, count(*) AS examples, count(DISTINCT e) AS distinct_examples FROM (SELECT finding_id, unnest(examples) AS e FROM {_F}) GROUP BY 1",
    "base_scores": f"SELECT file_path, round(sum(least(w + greatest(n - 1, 0) * least(w * {_R['repeat_factor']}, {_R['repeat_cap']}), w * {_R['max_multiplier']})), 4)::DOUBLE AS base FROM {_BASE} GROUP BY 1",
    "findings_by_family": f"SELECT i.family, f.category, sum(f.count)::BIGINT AS total FROM {_F} f LEFT JOIN (SELECT path, any_value(family) AS family FROM {_I} GROUP BY 1) i ON i.path = f.file_path GROUP BY 1, 2",
    "only_by_model": f"SELECT finding_id, block_id, category FROM {_F} f WHERE detector LIKE 'ner:%' AND NOT EXISTS (SELECT 1 FROM findings r WHERE r.detector LIKE 'regex%' AND r.block_id = f.block_id AND r.category = f.category)",
    "check_digits": f"""
        SELECT o_orderkey, 'is_snils' AS kind, CAST(substr(v, 1, 9) AS INT) > 1001998 AND {_digits("v", list(range(9, 0, -1)))} % 101 % 100 = CAST(substr(v, 10, 2) AS INT) AS valid FROM (SELECT o_orderkey, {_key(11)} AS v FROM orders)
        UNION ALL SELECT o_orderkey, 'is_inn_legal', {_digits("v", [2, 4, 10, 3, 5, 9, 4, 6, 8])} % 11 % 10 = CAST(substr(v, 10, 1) AS INT) FROM (SELECT o_orderkey, {_key(10)} AS v FROM orders)
        UNION ALL SELECT o_orderkey, 'is_inn_person', {_digits("v", [7, 2, 4, 10, 3, 5, 9, 4, 6, 8])} % 11 % 10 = CAST(substr(v, 11, 1) AS INT) AND {_digits("v", [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8])} % 11 % 10 = CAST(substr(v, 12, 1) AS INT) FROM (SELECT o_orderkey, {_key(12)} AS v FROM orders)
        UNION ALL SELECT o_orderkey, 'is_luhn', list_sum(list_transform(range(1, 17), lambda k: CASE WHEN k % 2 = 1 THEN (CAST(v[k] AS INT) * 2) // 10 + (CAST(v[k] AS INT) * 2) % 10 ELSE CAST(v[k] AS INT) END)) % 10 = 0 AND len(list_distinct(string_split(v, ''))) > 1 FROM (SELECT o_orderkey, {_key(16)} AS v FROM orders)""",
    "masked_values": f"""
        SELECT o_orderkey, 'u***' || right(CAST(o_orderkey AS VARCHAR), 1) || '@mail.test' AS email, repeat('*', 12) || right(v, 4) AS number, left(v, 6) || '******' || right(v, 4) AS card,
        '***-***-' || substr(v, 7, 3) || ' ' || substr(v, 10, 2) AS snils, left(v, 2) || ' ** ******' AS passport, '**.**.****' AS birth_date, 'A*** M*** B***' AS name FROM (SELECT o_orderkey, {_key(16)} AS v FROM orders)""",
    "synthetic_findings": """
        SELECT o_orderkey, c AS category, 1 AS count, d AS detector, e AS example FROM (SELECT o_orderkey, unnest([
         {'c': 'email', 'd': 'regex:email', 'e': 'u***' || right(k, 1) || '@mail.test'}, {'c': 'phone', 'd': 'regex:phone', 'e': '*******' || right(lpad(k, 9, '0'), 4)},
         {'c': 'bik', 'd': 'regex+context:bik', 'e': '*****' || right(lpad(k, 7, '0'), 4)}, {'c': 'bank_account', 'd': 'regex+context:bank_account', 'e': '40817***********' || right(lpad(k, 15, '0'), 4)},
         {'c': 'cvv', 'd': 'regex+context:cvv', 'e': '***'}, {'c': 'birth_date', 'd': 'regex+context:birth_date', 'e': '**.**.****'}]) AS s FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders)) t, LATERAL (SELECT t.s.c AS c, t.s.d AS d, t.s.e AS e)""",
    "normalized_texts": rf"""
        SELECT block_id, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[\x{{00AD}}\x{{200B}}-\x{{200F}}\x{{2060}}\x{{FEFF}}]', '', 'g'), '[\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]', ' ', 'g'), '\r\n|[\n\r\x{{0085}}\x{{2028}}\x{{2029}}]'),
          lambda x: regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> ''), chr(10)) AS clean_text FROM {_B} WHERE text IS NOT NULL""",
    "scan_types": f"SELECT upper(coalesce(extension, 'unknown')) || ' (' || coalesce(mime, 'unknown') || ')' AS file_type, count(*) AS n FROM {_I} WHERE status <> 'error' GROUP BY 1",
    "scan_states": f"SELECT status, method, count(*) AS n FROM {_I} GROUP BY 1, 2",
    "file_extensions": rf"SELECT scan_id, lower(regexp_extract(name, '[^.]\.([^.\s/]+)$', 1)) AS extension, CASE WHEN starts_with(path, '/share/') THEN substr(path, 7) WHEN contains(path, '/share/') THEN regexp_extract(path, '/share(/.*)$', 1) ELSE '/' || regexp_extract(path, '([^/]*)$', 1) END AS submit_path FROM {_I}",
    "registered_formats": f"SELECT r.family, r.is_binary, count(*) AS files FROM {_I} i LEFT JOIN (VALUES {_REGISTRY}) r(extension, family, is_binary) ON r.extension = i.extension GROUP BY 1, 2",
    "plan_strategies": f"SELECT path, strategy, skip_reason, CASE WHEN strategy IN ('skip', 'manual_review_or_custom_extractor') THEN 0 ELSE 1 END AS steps, CASE WHEN {_ESC} THEN 1 ELSE 0 END AS escalations FROM {_PLANS}",
    "plan_summary": f"SELECT strategy, count(*) AS files, count(*) FILTER ({_ESC}) AS with_escalation, count(*) FILTER (skip_reason IS NOT NULL) AS skipped FROM {_PLANS} GROUP BY 1",
    "triage_scores": f"SELECT path, bucket, triage_score::DOUBLE AS triage_score, signals FROM {_TRIAGE}",
    "triage_selection": f"""
        WITH a AS (SELECT *, {_BASELINE} AS fast, {_CAPS} AS cap FROM {_TRIAGE}), b AS (SELECT *, NOT fast AND blocked = '' AND triage_score >= 25 AND cap > 0 AS can FROM a),
        c AS (SELECT *, coalesce(count(*) FILTER (fast OR can) OVER (PARTITION BY bucket ORDER BY triage_score DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM b),
        d AS (SELECT *, fast OR (can AND r < cap) AS passed FROM c), e AS (SELECT *, coalesce(count(*) FILTER (passed) OVER (ORDER BY triage_score DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM d),
        f AS (SELECT *, fast OR (passed AND t < 180) AS include FROM e), g AS (SELECT *, coalesce(count(*) FILTER (include) OVER (PARTITION BY bucket ORDER BY triage_score DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM f)
        SELECT path, bucket, triage_score::DOUBLE AS triage_score, include, CASE WHEN fast THEN 'include: fast baseline' WHEN blocked <> '' THEN blocked WHEN triage_score < 25 THEN 'skip: below cutoff' WHEN cap <= 0 THEN 'skip: bucket disabled' WHEN include THEN 'include: candidate' WHEN taken >= cap THEN 'skip: bucket cap' ELSE 'skip: total cap' END AS reason FROM g""",
    "ocr_budget": f"SELECT path, {_OCR}::DOUBLE AS ocr_score FROM {_PLANS} WHERE {_ESC} AND {_OCR} > 0 ORDER BY 2 DESC, 1 LIMIT 80",
    "block_flags": f"SELECT file_path, coalesce(bool_or(ocr), false) AS ocr_used, coalesce(bool_or(embedded_payload AND embedded_document_like), false) AS embedded_document, count(*) AS blocks, coalesce(sum(length(text)), 0)::BIGINT AS chars, coalesce(bool_or(trim(text) <> ''), false) AS with_text, sum(coalesce(len(warnings), 0))::BIGINT AS warnings FROM {_B} GROUP BY 1",
    "extraction_summary": f"SELECT extraction_method, count(*) AS blocks, count(DISTINCT file_path) AS files, sum(length(text))::BIGINT AS chars, count(*) FILTER (len(warnings) > 0) AS with_warnings FROM {_B} GROUP BY 1",
    "table_hints": f"SELECT file_path, hint, sum(n)::BIGINT AS n FROM (SELECT file_path, e.key AS hint, e.value AS n FROM (SELECT file_path, unnest(map_entries(table_semantic_hints)) AS e FROM {_B}) UNION ALL SELECT file_path, 'physical_person_rows', physical_person_mentions FROM {_B} WHERE coalesce(physical_person_mentions, 0) <> 0) GROUP BY 1, 2",
    "row_blocks": """
        WITH r AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k, count(*) OVER (PARTITION BY c_nationkey) AS total, 'c_custkey: ' || c_custkey || ' | c_name: ' || c_name || ' | c_mktsegment: ' || c_mktsegment AS line FROM customer)
        SELECT c_nationkey, ((k - 1) // 50)::BIGINT AS block_index, min(k) AS row_start, CASE WHEN count(*) < 50 THEN max(total) ELSE max(k) END AS row_end, count(*) AS lines, string_agg(line, chr(10) ORDER BY k) AS text FROM r GROUP BY 1, 2""",
    "recurring_lines": f"""
        WITH b AS (SELECT * FROM {_B} WHERE source_type IN ('pages', 'ocr') AND text IS NOT NULL AND text <> ''), p AS (SELECT file_path, count(DISTINCT block_index) AS pages FROM b GROUP BY 1),
        l AS (SELECT file_path, trim(line) AS line, count(DISTINCT block_index) AS n FROM (SELECT file_path, block_index, unnest(string_split(text, chr(10))) AS line FROM b) GROUP BY 1, 2)
        SELECT l.file_path, l.line, l.n AS pages FROM l JOIN p USING (file_path) WHERE l.line <> '' AND p.pages >= 3 AND l.n >= greatest(3, floor(p.pages * 0.3))""",
    "event_runs": "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE event_type IS NOT NULL AND event_type <> '') WHERE before IS DISTINCT FROM event_type",
    "json_members": "SELECT event_id, name, json_extract_string(props, '$.\"' || name || '\"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS name FROM events)",
    "ner_quota": f"""
        WITH w AS (SELECT * FROM {_B} WHERE source_type NOT IN ('table', 'json', 'workbook')), f AS (SELECT file_path, min(block_id) AS first FROM w GROUP BY 1 ORDER BY 2, 1 LIMIT 40)
        SELECT block_id, file_path, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY block_index, block_id) AS k FROM w) WHERE k <= 3 AND file_path IN (SELECT file_path FROM f)""",
    "rule_counts": f"SELECT h.rule AS rule, count(*) AS n, round(sum(h.score_delta), 2) AS score FROM (SELECT unnest(rule_hits) AS h FROM {_A}) GROUP BY 1",
    "level_counts": f"SELECT CASE WHEN score >= 180 THEN 'high' WHEN score >= 120 THEN 'submit' WHEN score >= 60 THEN 'review' ELSE 'low' END AS level, count(*) AS files FROM {_A} GROUP BY 1",
    "score_bands": f"SELECT CAST(low AS VARCHAR) || '-' || CAST(low + 25 AS VARCHAR) AS band, count(*) AS files FROM (SELECT CAST(floor(score / 25) * 25 AS BIGINT) AS low FROM {_A}) GROUP BY 1",
    "submit_list": f"SELECT submit_path FROM {_A} WHERE score >= 120 ORDER BY 1",
    "review_bands": f"SELECT CASE WHEN score >= 120 THEN 'submit' WHEN score >= 35 THEN 'review' ELSE 'suppressed' END AS band, count(*) AS files, round(max(score), 2) AS best FROM {_A} GROUP BY 1",
}
ORACLE["text_quality"] = rf"""
    SELECT doc_id, round(CASE WHEN words = 0 THEN 0.0 ELSE 0.7 * good / size + 0.3 * long_words / words END, 6) AS quality FROM (SELECT doc_id, length(text) AS size, length(regexp_replace(text, '[^\pL\pN\s\x{{0085}}\x{{00A0}}\x{{2028}}\x{{3000}}]', '', 'g')) AS good,
     len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '')) AS words, len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: length(x) >= 3)) AS long_words FROM documents WHERE text IS NOT NULL)"""
ORACLE["plan_steps"] = f"""
    SELECT extractor, priority::INT AS priority, (k - 1)::INT AS k, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY priority, own) AS k FROM (
     SELECT path, {_FIRST} AS extractor, {_PRIORITY} AS priority, 0 AS own FROM {_PLANS} WHERE strategy NOT IN ('skip', 'manual_review_or_custom_extractor')
     UNION ALL SELECT path, CASE WHEN family IN ('document', 'presentation') AND coalesce(extension, '') <> 'pdf' THEN 'embedded_image_ocr_extractor' ELSE 'ocr_extractor' END, {_OCR_PRIORITY}, 1 FROM {_PLANS} WHERE {_ESC})) GROUP BY 1, 2, 3"""
ORACLE["without_recurring_lines"] = f"""
    WITH gone AS (SELECT file_path, list(line) AS gone FROM ({ORACLE["recurring_lines"]}) GROUP BY 1)
    SELECT block_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT coalesce(list_contains(gone, x), false)), ' ') AS clean_text
    FROM (SELECT * FROM {_B} WHERE source_type IN ('pages', 'ocr') AND text IS NOT NULL) b LEFT JOIN gone g ON g.file_path = b.file_path"""
_NORMAL = """CASE WHEN skip_reason IS NOT NULL THEN 'skip: planner skipped file (' || skip_reason || ')' WHEN family = 'archive' THEN 'skip: archive needs separate safe unpacking policy' WHEN family = 'presentation' THEN 'skip: presentation deferred outside normal mode'
  WHEN family = 'image' THEN 'skip: image OCR is reserved for hard mode' WHEN family IN ('text', 'structured', 'spreadsheet', 'document', 'web', 'executable', 'video') THEN 'include: normal ' || family || ' extraction' ELSE 'skip: no normal-mode extractor' END"""
ORACLE["fast_selection"] = f"""
    SELECT path, CASE family WHEN 'executable' THEN 'include: executable binary payload probe' WHEN 'video' THEN 'include: video manual review candidate' WHEN 'text' THEN 'include: cheap text/table parser' WHEN 'structured' THEN 'include: cheap text/table parser'
     WHEN 'spreadsheet' THEN 'include: cheap text/table parser' WHEN 'image' THEN 'skip: OCR-heavy media in fast mode' WHEN 'presentation' THEN 'skip: OCR-heavy media in fast mode'
     WHEN 'web' THEN CASE WHEN {_NAMED} THEN 'include: web page with explicit file-name signal' ELSE 'skip: mass web snapshot without explicit file-name signal' END
     WHEN 'document' THEN CASE WHEN extension IN ('docx', 'rtf', 'doc') AND ({_NAMED} OR {_any('p', ['мои бумажки', 'employes', 'employees'])} OR contains(p, '/прочее/')) THEN 'include: office document with explicit/employee context'
      WHEN extension = 'pdf' THEN 'skip: PDF is expensive in fast mode' ELSE 'skip: document without fast-mode context' END ELSE 'skip: no fast-mode rule' END AS reason,
     {_NORMAL} AS normal_reason, CASE WHEN family IN ('image', 'presentation') AND skip_reason IS NULL THEN 'include: hard OCR candidate (' || family || ')' ELSE {_NORMAL} END AS hard_reason FROM {_PLANS}"""
ORACLE["plan_warnings"] = f"""
    SELECT path, concat_ws(',', CASE WHEN any_value(size_bytes) BETWEEN 1 AND {_P["tiny_bytes"]} THEN 'tiny_file' END, CASE WHEN any_value(confidence) < {_P["low_confidence"]} THEN 'low_confidence' END) AS plan_warnings FROM {_I} GROUP BY path"""
ORACLE["category_counters"] = f"SELECT category, detector, count(*) AS findings, sum(count)::BIGINT AS total, round(max(confidence), 4) AS most_confidence FROM {_F} GROUP BY 1, 2"
ORACLE["block_warnings"] = f"SELECT extraction_method, w AS warning, count(*) AS blocks FROM (SELECT extraction_method, unnest(warnings) AS w FROM {_B}) GROUP BY 1, 2"
ORACLE["latest_assessments"] = f"SELECT file_path, assessment_id, document_type, len(categories)::INT AS n_categories FROM {_A}"
ORACLE["packed_lines"] = """
    SELECT doc_id, (i - 1)::INT AS k, chunks[i] AS chunk FROM (SELECT doc_id, chunks, unnest(range(1, len(chunks) + 1)) AS i FROM (
     SELECT doc_id, list_reduce(list_transform(string_split(text, chr(10)), lambda x: [x]), lambda a, x: CASE WHEN length(a[-1]) + length(x[1]) + 2 <= 600 THEN list_concat(list_slice(a, 1, len(a) - 1), [a[-1] || chr(10) || x[1]]) ELSE list_concat(a, x) END) AS chunks
     FROM documents WHERE text IS NOT NULL))"""
_HINTS = {"person_name_column": PERSON, "address_column": ADDRESS, "contact_column": CONTACT, "identifier_column": IDENTIFIER, "person_type_column": PHYSICAL[3:], "physical_person_rows": PHYSICAL[:3]}
ORACLE["table_headers"] = rf"""
    SELECT block_id, len(cells) >= 2 AND (len(list_filter(cells, lambda c: {_any("lower(c)", [*PERSON, *ADDRESS, *CONTACT, *IDENTIFIER])})) > 0
      OR len(list_filter(cells, lambda c: length(c) <= 40 AND regexp_matches(c, '\pL') AND NOT regexp_matches(c, '\p{{Nd}}'))) >= greatest(2, len(cells) // 2)) AS header,
     concat_ws(',', {", ".join(f"CASE WHEN {_any('low', words)} THEN '{name}' END" for name, words in _HINTS.items())}) AS hints
    FROM (SELECT block_id, lower(text) AS low, list_filter(regexp_split_to_array(split_part(text, chr(10), 1), '[ 	

]*[|,;	][ 	

]*'), lambda c: trim(c) <> '') AS cells FROM {_B} WHERE source_type IN ('table', 'workbook') AND text IS NOT NULL)"""
_SUSPICIOUS = ["выгруз", "subscribers", "subscriber", "backup", "dump", "full", "scan", "скан", "паспорт", "passport", "анкета", "заявка", "пропуск", "дмс", "dms", "личн", "копия", "card", "карта"]
_IN_PATH = " + ".join(f"contains(p, '{w}')::INT" for w in _SUSPICIOUS)
_COUNTED = (*_R["weights"], "inn")
_SEEN = ("person_name_column", "address_column", "contact_column", "identifier_column", "sensitive_column_value", "physical_person_rows")
_RULES = [
    ("high_risk_identifier", 35, "high_risk > 0"), ("identity_document_media", 95, "identity_document > 0 AND (family IN ('image', 'video') OR ocr_used)"), ("form_identity_document", 80, "identity_document > 0 AND family IN ('document', 'rtf', 'web')"),
    ("embedded_identity_document_payload", 170, "embedded"), ("mass_bank_cards", 35, "bank_card > 4"), ("mass_snils", 30, "snils > 4"), ("person_profile_combo", 30, "fio > 0 AND greatest(passport_rf, snils, inn_person, birth_date, bank_account, bank_card) > 0"),
    ("contact_profile_combo", 18, "fio > 0 AND greatest(phone, email, address) > 0 AND kinds > 2"), ("special_categories", 20, "special > 0 AND strong"), ("mass_table_pii", 28, "is_table AND total > 99"), ("sensitive_export", 35, "is_table AND high_risk > 0"),
    ("table_sensitive_schema", 45, "is_table AND greatest(identifier_column, sensitive_column_value) > 0"), ("table_physical_person_names", 42, "is_table AND least(physical_person_rows, person_name_column) > 0"),
    ("table_name_address_schema", 34, "is_table AND least(person_name_column, address_column) > 0"), ("table_name_contact_schema", 26, "is_table AND least(person_name_column, contact_column) > 0"),
    ("informal_employee_folder", 50, f"total > 0 AND {_any('p', ['мои бумажки', 'employes', 'employees'])}"), ("high_ocr_context", 10, "total > 0 AND scan"), ("scan_archive_image", 55, "family = 'image' AND contains(p, 'архив сканы')"),
    ("web_snapshot_without_profile", -110, "family = 'web' AND NOT strong"),
]  # fmt: skip
_HITS = ", ".join(f"CASE WHEN {c} THEN {{'rule': '{n}', 'd': {float(d)}::DOUBLE}} END" for n, d, c in _RULES)
ORACLE["risk_assessment"] = f"""
    WITH cats AS (SELECT file_path, category, n, least(w + greatest(n - 1, 0) * least(w * {_R["repeat_factor"]}, {_R["repeat_cap"]}), w * {_R["max_multiplier"]}) AS part FROM {_BASE}),
    wide AS (SELECT file_path, {", ".join(f"coalesce(sum(n) FILTER (category = '{c}'), 0) AS {c}" for c in _COUNTED)}, sum(n) AS total, count(*) AS kinds, sum(part) AS base,
      coalesce(sum(n) FILTER (category IN ({_words(_R["high_risk"])})), 0) AS high_risk, coalesce(sum(n) FILTER (category IN ({_words(_R["special"])})), 0) AS special FROM cats GROUP BY 1),
    hints AS (SELECT file_path, {", ".join(f"coalesce(sum(n) FILTER (hint = '{h}'), 0) AS {h}" for h in _SEEN)} FROM ({ORACLE["table_hints"]}) GROUP BY 1),
    flags AS (SELECT file_path, coalesce(bool_or(ocr), false) AS ocr_used, coalesce(bool_or(embedded_payload AND embedded_document_like), false) AS embedded FROM {_B} GROUP BY 1),
    own AS (SELECT p.path AS file_path, p.p, p.family, p.scan, coalesce(p.strategy IN ('structured_parse', 'table_parse') OR p.family IN ('structured', 'spreadsheet') OR p.extension IN ('csv', 'tsv', 'json', 'parquet', 'xls', 'xlsx'), false) AS is_table,
      {", ".join(f"coalesce({c}, 0) AS {c}" for c in (*_COUNTED, *_SEEN, "total", "kinds", "base", "high_risk", "special"))}, coalesce(ocr_used, false) AS ocr_used, coalesce(embedded, false) AS embedded
      FROM {_PLANS} p LEFT JOIN wide w ON w.file_path = p.path LEFT JOIN hints h ON h.file_path = p.path LEFT JOIN flags f ON f.file_path = p.path),
    judged AS (SELECT *, greatest(passport_rf, snils, inn_person, mrz, cvv) > 0 OR (identity_document > 0 AND greatest(birth_date, fio) > 0) OR bank_card > 2 OR (fio > 0 AND greatest(birth_date, bank_account, bank_card) > 0) AS strong FROM own),
    hit AS (SELECT *, list_filter([{_HITS}, CASE WHEN {_IN_PATH} > 0 THEN {{'rule': 'suspicious_path', 'd': least(25.0, 8.0 + 4.0 * ({_IN_PATH}))::DOUBLE}} END], lambda x: x IS NOT NULL) AS hits FROM judged),
    raw AS (SELECT *, base + coalesce(list_sum(list_transform(hits, lambda x: x.d)), 0) AS r FROM hit),
    done AS (SELECT *, greatest(round(CASE WHEN total = 0 AND NOT coalesce(family = 'video' OR embedded OR (contains(p, 'архив сканы') AND family IN ('image', 'document') AND {_IN_PATH} > 0), false) THEN least(r, {_R["no_evidence_cap"]}) ELSE r END, 2), 0)::DOUBLE AS score FROM raw)
    SELECT file_path, score, CASE WHEN score >= {_R["high"]} THEN 'high' WHEN score >= {_R["submit"]} THEN 'submit' WHEN score >= {_R["review"]} THEN 'review' ELSE 'low' END AS level,
     CASE WHEN score >= {_R["priority"]} THEN 'manual_review_priority' WHEN score >= {_R["submit"]} THEN 'manual_review' ELSE 'do_not_submit_baseline' END AS recommendation,
     CASE WHEN embedded THEN 'embedded_identity_document' WHEN bank_card > 4 THEN 'card_dataset' WHEN identity_document > 0 THEN 'identity_document_media' WHEN snils > 4 THEN 'identifier_list' WHEN fio > 0 AND greatest(passport_rf, birth_date, inn_person) > 0 THEN 'personal_profile'
      WHEN {_any("p", ["анкета", "заявка"])} THEN 'form_or_request' WHEN is_table THEN 'table_or_export' WHEN family = 'image' THEN 'image_candidate' ELSE coalesce(family, 'unknown') END AS document_type,
     list_transform(hits, lambda x: x.rule) AS rules FROM done"""
ORACLE["risk_summary"] = f"""
    WITH a AS (SELECT * FROM {_A}), s AS (SELECT * FROM a WHERE score >= {_R["submit"]})
    SELECT 'level' AS what, CASE WHEN score >= 180 THEN 'high' WHEN score >= 120 THEN 'submit' WHEN score >= 60 THEN 'review' ELSE 'low' END AS item, count(*)::BIGINT AS n FROM a GROUP BY 2
    UNION ALL SELECT 'category', c.category, sum(c.count)::BIGINT FROM (SELECT unnest(categories) AS c FROM s) GROUP BY 2 UNION ALL SELECT 'rule', h.rule, count(*) FROM (SELECT unnest(rule_hits) AS h FROM s) GROUP BY 2"""
_SHOWN = "list_transform(list_filter(rule_hits, lambda h: h.score_delta {0} 0)[1:{1}], lambda h: h.rule || format('({{:+.0f}})', h.score_delta))"
ORACLE["best_risks"] = f"""
    SELECT score, submit_path, document_type, coalesce(array_to_string(list_transform(list_sort(list_transform(categories, lambda c: struct_pack(n := -c.count, c := c.category)))[1:8], lambda c: c.c || ':' || -c.n), ', '), '') AS kinds,
     array_to_string(list_concat({_SHOWN.format(">", 4)}, {_SHOWN.format("<", 3)}), '; ') AS rules FROM (SELECT * FROM {_A} ORDER BY score DESC, submit_path, assessment_id LIMIT 100) t"""
ORACLE["file_warnings"] = f"SELECT file_path, string_agg(array_to_string(warnings, '; '), '; ' ORDER BY block_index, block_id) AS warnings FROM {_B} WHERE len(warnings) > 0 GROUP BY 1"
ORACLE["failed_extractions"] = f"""
    SELECT file_path, arg_min(CASE WHEN len(warnings) > 0 THEN warnings[1] END, CASE WHEN len(warnings) > 0 THEN block_id END) AS warning FROM {_B} GROUP BY 1 HAVING NOT coalesce(bool_or(trim(text) <> ''), false) ORDER BY 1 LIMIT 10"""
