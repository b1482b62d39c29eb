"""DuckDB views the comparison statements build on, written independently of the Spark jobs."""

from __future__ import annotations

from packlens import fixed_values as fv
from packlens.sources.star import GTIN_PREFIXES, UNIT_CYCLE


def quote(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(quote(i) for i in items) + "]"


def sql_in(items) -> str:
    return "(" + ", ".join(quote(i) for i in items) + ")"


def _every(n: int, expr: str) -> str:
    return f"CASE WHEN k % {n} <> 0 THEN {expr} END"


DECLARATIONS = f"""
SELECT k AS scan_id, o_custkey AS owner_id, o_orderdate AS created_at,
  {_every(37, 's_name')} AS manufacturer_name, {_every(41, 'n_name')} AS manufacturer_address,
  {_every(31, 'p_name')} AS generic_name, {_every(29, 'CAST(p_size AS DOUBLE) * 20')} AS net_quantity_value,
  ({sql_list(UNIT_CYCLE)})[CAST(k % 12 AS INTEGER) + 1] AS net_quantity_unit,
  {_every(43, 'p_retailprice')} AS mrp, COALESCE(l_tax > 0.005, FALSE) AS mrp_includes_taxes,
  {_every(47, 'CAST(o_orderdate AS DATE)')} AS mfg_date, CAST(l_shipdate AS DATE) AS expiry_date,
  {_every(23, "'care' || k || '@example.in 1800-100-' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0')")} AS consumer_care,
  {_every(19, 'n_name')} AS country_of_origin, COALESCE(n_regionkey <> 2, FALSE) AS is_imported,
  {_every(5, 'l_quantity / 10')} AS min_numeral_height_mm, {_every(5, 'l_quantity / 15')} AS min_letter_height_mm,
  COALESCE(l_linestatus = 'F', FALSE) AS is_embossed, {_every(11, 'CAST(p_size AS DOUBLE) * 60')} AS panel_area_cm2,
  {_every(7, 'l_discount * 10')} AS min_width_to_height_ratio,
  {_every(9, 'CAST((k * 37) % 101 AS DOUBLE)')} AS ocr_confidence
FROM (SELECT *, o_orderkey AS k FROM orders) o
LEFT JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) = 1) l ON k = l_orderkey
LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN nation ON s_nationkey = n_nationkey
"""

_TAG = "CASE WHEN is_embossed THEN 'embossed pack' ELSE 'ordinary print' END"
_U = "lower(net_quantity_unit)"
_BY_QTY = f"({_U} IN {sql_in(fv.WEIGHT_VOLUME_UNITS)} AND net_quantity_value IS NOT NULL)"
_BY_PANEL = f"({_U} IN {sql_in(fv.COUNT_LENGTH_UNITS)})"

TIERED = f"""
SELECT *, CASE WHEN {_BY_QTY} THEN
    CASE WHEN base <= 200 THEN CASE WHEN is_embossed THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END
         WHEN base <= 500 THEN CASE WHEN is_embossed THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END
         ELSE CASE WHEN is_embossed THEN 6.0::DOUBLE ELSE 4.0::DOUBLE END END
  WHEN {_BY_PANEL} AND panel_area_cm2 > 0 THEN
    CASE WHEN panel_area_cm2 <= 100 THEN CASE WHEN is_embossed THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END
         WHEN panel_area_cm2 <= 500 THEN CASE WHEN is_embossed THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END
         WHEN panel_area_cm2 <= 2500 THEN CASE WHEN is_embossed THEN 6.0::DOUBLE ELSE 4.0::DOUBLE END
         ELSE 6.0::DOUBLE END END AS required_mm,
  CASE WHEN {_BY_QTY} THEN 'Table-I (net ' || format('{{:g}}', base) || 'g/ml, ' || {_TAG} || ')'
       WHEN {_BY_PANEL} AND panel_area_cm2 > 0 THEN 'Table-II (panel ' || format('{{:g}}', panel_area_cm2) || 'cm², ' || {_TAG} || ')'
       WHEN {_BY_PANEL} THEN 'Table-II needs principal display panel area'
       ELSE 'unknown unit class' END AS basis,
  CASE WHEN is_embossed THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS letter_mm, {_TAG} AS tag
FROM (SELECT *, CASE {_U} WHEN 'kg' THEN net_quantity_value * 1000 WHEN 'l' THEN net_quantity_value * 1000
      WHEN 'mg' THEN net_quantity_value / 1000 WHEN 'g' THEN net_quantity_value WHEN 'ml' THEN net_quantity_value END AS base
      FROM declarations)
"""

_STATUS_SQL = [
    "CASE WHEN manufacturer_name <> '' AND manufacturer_address <> '' THEN 'PASS' ELSE 'NOT_FOUND' END",
    "CASE WHEN generic_name <> '' THEN 'PASS' ELSE 'NOT_FOUND' END",
    f"CASE WHEN COALESCE(net_quantity_value, 0) <= 0 OR COALESCE(net_quantity_unit, '') = '' THEN 'NOT_FOUND' "
    f"WHEN {_U} IN {sql_in(fv.WEIGHT_VOLUME_UNITS + fv.COUNT_LENGTH_UNITS)} THEN 'PASS' ELSE 'FAIL' END",
    "CASE WHEN COALESCE(mrp, 0) <= 0 THEN 'NOT_FOUND' WHEN mrp_includes_taxes THEN 'PASS' ELSE 'FAIL' END",
    "CASE WHEN mfg_date IS NULL THEN 'NOT_FOUND' WHEN expiry_date <= mfg_date THEN 'FAIL' ELSE 'PASS' END",
    "CASE WHEN consumer_care <> '' THEN 'PASS' ELSE 'NOT_FOUND' END",
    "CASE WHEN is_imported AND COALESCE(country_of_origin, '') = '' THEN 'NOT_FOUND' ELSE 'PASS' END",
    "CASE WHEN min_numeral_height_mm IS NULL OR required_mm IS NULL THEN 'NOT_ASSESSABLE' "
    "WHEN min_numeral_height_mm >= required_mm THEN 'PASS' ELSE 'FAIL' END",
    "CASE WHEN min_letter_height_mm IS NULL THEN 'NOT_ASSESSABLE' WHEN min_letter_height_mm >= letter_mm THEN 'PASS' ELSE 'FAIL' END",
    "CASE WHEN min_width_to_height_ratio IS NULL THEN 'NOT_ASSESSABLE' "
    "WHEN min_width_to_height_ratio >= 1.0::DOUBLE / 3 THEN 'PASS' ELSE 'FAIL' END",
]

STATUSES = "SELECT *, " + ", ".join(f"{s} AS s{i}" for i, s in enumerate(_STATUS_SQL)) + " FROM tiered"

_ALL_S = [f"s{i}" for i in range(10)]
VERDICTS = f"""
SELECT *, CASE WHEN 'FAIL' IN ({', '.join(_ALL_S)}) OR ('NOT_FOUND' IN ({', '.join(_ALL_S)}) AND NOT weak) THEN 'NON_COMPLIANT'
  WHEN 'NOT_FOUND' IN ({', '.join(_ALL_S)}) OR 'NOT_ASSESSABLE' IN ({', '.join(_ALL_S)}) THEN 'INCOMPLETE' ELSE 'COMPLIANT' END AS verdict
FROM (SELECT *, COALESCE(ocr_confidence < 60, FALSE) AS weak FROM statuses)
"""

# message, observed and expected per rule and status
_D = "CAST(mfg_date AS VARCHAR)"
_E = "CAST(expiry_date AS VARCHAR)"
_REQ = "COALESCE('required >= ' || required_mm || 'mm', 'requirement undetermined')"
_TEXTS: dict[int, dict[str, tuple[str, str, str]]] = {
    0: {"PASS": ("'Manufacturer name+address present'", "manufacturer_name || '; ' || manufacturer_address", "'manufacturer name + address'"),
        "NOT_FOUND": ("'Missing manufacturer name/address (Rule 6(1)(a))'", "'absent'", "'manufacturer name + address'")},
    1: {"PASS": ("'Generic name present'", "generic_name", "'generic/common name'"),
        "NOT_FOUND": ("'Missing generic/common name (Rule 6(1)(b))'", "'absent'", "'generic/common name'")},
    2: {"PASS": ("'Net quantity present'", "format('{:g}', net_quantity_value) || ' ' || net_quantity_unit", "'net quantity in standard units'"),
        "FAIL": ("'Non-standard unit ''' || net_quantity_unit || ''' (Rule 6, SI units required)'", "net_quantity_unit", "'g/kg/mg/ml/l/cm/m/nos/pc'"),
        "NOT_FOUND": ("'Missing/invalid net quantity (Rule 6(1)(c))'", "'absent'", "'net quantity in standard units'")},
    3: {"PASS": ("'MRP with taxes present'", "'Rs. ' || mrp || ' (inclusive of all taxes)'", "'MRP inclusive of all taxes'"),
        "FAIL": ("'MRP must state ''inclusive of all taxes'' (Rule 6(1)(e) + Rule 2(m) manner)'", "'tax phrase absent'", "'''inclusive of all taxes'''"),
        "NOT_FOUND": ("'Missing/invalid MRP (Rule 6(1)(e))'", "'absent'", "'MRP inclusive of all taxes'")},
    4: {"PASS": ("'Date declarations valid'", f"'mfg/pack ' || {_D} || COALESCE(', expiry ' || {_E}, ', no expiry stated')", "'month and year of manufacture/pack/import'"),
        "FAIL": ("'Expiry date must be after manufacture date'", _E, f"'after ' || {_D}"),
        "NOT_FOUND": ("'Missing manufacture/pack date (Rule 6(1)(d))'", "'absent'", "'month and year of manufacture/pack/import'")},
    5: {"PASS": ("'Consumer care details present'", "consumer_care", "'customer-care contact'"),
        "NOT_FOUND": ("'Missing customer-care name/address/contact'", "'absent'", "'customer-care contact'")},
    6: {"PASS": ("'Origin declaration valid'", "COALESCE(NULLIF(country_of_origin, ''), 'domestic supply (no import claimed)')", "'country of origin if imported'"),
        "NOT_FOUND": ("'Imported package must declare country of origin'", "'absent'", "'country of origin'")},
    7: {"PASS": ("'Numeral height ' || min_numeral_height_mm || 'mm >= ' || required_mm || 'mm (' || basis || ')'", "min_numeral_height_mm || 'mm'", "'>= ' || required_mm || 'mm (' || basis || ')'"),
        "FAIL": ("'Numeral height ' || min_numeral_height_mm || 'mm < required ' || required_mm || 'mm (' || basis || ')'", "min_numeral_height_mm || 'mm'", "'>= ' || required_mm || 'mm (' || basis || ')'"),
        "NOT_ASSESSABLE": (f"CASE WHEN min_numeral_height_mm IS NULL THEN 'Numeral height not measured; ' || {_REQ} || ' (' || basis || ') — cannot assess' ELSE 'Cannot determine Table tier (' || basis || ') — cannot assess' END",
                           "CASE WHEN min_numeral_height_mm IS NULL THEN 'unmeasured' ELSE 'unknown tier' END",
                           f"CASE WHEN min_numeral_height_mm IS NULL THEN {_REQ} || ' (' || basis || ')' ELSE 'determinable tier' END")},
    8: {"PASS": ("'Letter height ' || min_letter_height_mm || 'mm >= ' || letter_mm || 'mm (' || tag || ')'", "min_letter_height_mm || 'mm'", "'>= ' || letter_mm || 'mm (' || tag || ')'"),
        "FAIL": ("'Letter height ' || min_letter_height_mm || 'mm < required ' || letter_mm || 'mm (Rule 7(3), ' || tag || ')'", "min_letter_height_mm || 'mm'", "'>= ' || letter_mm || 'mm (' || tag || ')'"),
        "NOT_ASSESSABLE": ("'Letter height not measured; required >= ' || letter_mm || 'mm — cannot assess'", "'unmeasured'", "'>= ' || letter_mm || 'mm'")},
    9: {"PASS": ("'Width/height ratio ' || format('{:.2f}', min_width_to_height_ratio) || ' >= 1/3'", "format('{:.2f}', min_width_to_height_ratio)", "'>= 0.33'"),
        "FAIL": ("'Width/height ratio ' || format('{:.2f}', min_width_to_height_ratio) || ' < 1/3 (excludes numeral ''1'' and letters i/I/l)'", "format('{:.2f}', min_width_to_height_ratio)", "'>= 0.33'"),
        "NOT_ASSESSABLE": ("'Glyph width not measured; required width >= 1/3 height — cannot assess'", "'unmeasured'", "'width/height >= 1/3'")},
}
_CITATION = ["Rule 6(1)(a)", "Rule 6(1)(b)", "Rule 6(1)(c)", "Rule 6(1)(e)", "Rule 6(1)(d)",
             "Rule 6(1) consumer-care proviso (post-2011 amendment)", "Rule 6(1)(a) importer clause",
             "Rule 7(2) Table-I/II", "Rule 7(3)", "Rule 7(3) proviso"]
_FIELD = ["manufacturer", "generic_name", "net_quantity", "mrp", "dates", "consumer_care",
          "country_of_origin", "numeral", "letter", "width"]


def _rule_select(i: int) -> str:
    def pick(slot: int) -> str:
        return "CASE " + " ".join(f"WHEN s{i} = '{st}' THEN {t[slot]}" for st, t in _TEXTS[i].items()) + " END"

    citation = quote(_CITATION[i])
    verified = "1"
    if i == 3:
        citation = "CASE WHEN s3 = 'PASS' THEN 'Rule 6(1)(e) + Rule 2(m)' ELSE 'Rule 6(1)(e)' END"
    if i == 5:
        verified = "0"
    if i == 6:
        citation = ("CASE WHEN s6 = 'PASS' THEN 'Rule 6(1)(a) importer clause' ELSE "
                    "'Rule 6(1)(a) importer clause (country wording: later amendment)' END")
        verified = "CASE WHEN s6 = 'PASS' THEN 1 ELSE 0 END"
    unassessed = "'review'" if i >= 7 else "'blocking'"
    return (
        f"SELECT scan_id, ocr_confidence, {i} AS rule_order, {quote(fv.RULE_IDS[i])} AS rule_id, s{i} AS status, "
        f"{pick(0)} AS message, {quote(_FIELD[i])} AS field, {citation} AS citation, {verified} AS citation_verified, "
        f"{pick(1)} AS observed, {pick(2)} AS expected, "
        f"CASE s{i} WHEN 'PASS' THEN 'info' WHEN 'NOT_ASSESSABLE' THEN {unassessed} ELSE 'blocking' END AS severity, "
        f"CASE WHEN s{i} = 'NOT_ASSESSABLE' THEN {quote(fv.CALIBRATION_REMEDY)} END AS remedy, "
        f"{quote(fv.RULE7_SOURCE if i >= 7 else '')} AS source_ref FROM statuses"
    )


FINDINGS = " UNION ALL ".join(_rule_select(i) for i in range(10))


def _guide_values() -> str:
    rows = []
    for rule_id, g in fv.GUIDE.items():
        texts = [quote(g.get(c)) for c in ("why_typed", "why_low", "why_clear", "why_invalid", "panel", "keyword")]
        rows.append(f"({quote(rule_id)}, {', '.join(texts)}, {sql_list(g.get('steps_typed', ()))}::VARCHAR[], "
                    f"{sql_list(g.get('steps_invalid', ()))}::VARCHAR[])")
    return ("SELECT * FROM (VALUES " + ", ".join(rows) +
            ") g(rule_id, why_typed, why_low, why_clear, why_invalid, panel, keyword, steps_typed, steps_invalid)")


_RETAKE = quote(fv.RETAKE_STEP).replace("{}", "' || panel || '")
_SEARCH = quote(fv.SEARCH_STEP).replace("{}", "' || COALESCE(keyword, 'the value') || '")
_CLOSE = f"[{quote(fv.VERIFY_STEP)}, {quote(fv.REVIEW_STEP)}]"
ANNOTATED = f"""
SELECT f.*, CASE WHEN status = 'PASS' THEN '' WHEN status = 'NOT_ASSESSABLE' THEN 'unmeasured'
    WHEN status = 'NOT_FOUND' THEN CASE WHEN ocr_confidence < 60 THEN 'possible_miss' ELSE 'likely_genuine' END
    WHEN ocr_confidence < 60 THEN 'likely_genuine' ELSE 'genuine' END AS cause,
  CASE WHEN status = 'PASS' THEN '' WHEN status = 'NOT_ASSESSABLE' THEN message
    WHEN status = 'NOT_FOUND' AND ocr_confidence IS NULL THEN why_typed
    WHEN status = 'NOT_FOUND' THEN replace(CASE WHEN ocr_confidence < 60 THEN why_low ELSE why_clear END, '{{conf}}', format('{{:g}}', ocr_confidence) || '%')
    ELSE replace(replace(why_invalid, '{{observed}}', observed), '{{expected}}', expected)
      || CASE WHEN ocr_confidence < 60 THEN replace({quote(fv.WEAK_NOTE)}, '{{conf}}', format('{{:g}}', ocr_confidence) || '%') ELSE '' END END AS why,
  CASE WHEN status = 'PASS' THEN '' ELSE array_to_string(
    CASE WHEN status = 'NOT_ASSESSABLE' THEN [remedy]
    WHEN status = 'NOT_FOUND' AND ocr_confidence IS NULL THEN list_concat(steps_typed, {_CLOSE})
    WHEN status = 'NOT_FOUND' AND ocr_confidence < 60 THEN list_concat([{_RETAKE}, {_SEARCH}], {_CLOSE})
    WHEN status = 'NOT_FOUND' THEN list_concat([{_RETAKE}], {_CLOSE})
    WHEN ocr_confidence < 60 THEN list_concat([{_SEARCH}], steps_invalid, {_CLOSE})
    ELSE list_concat(steps_invalid, {_CLOSE}) END, ' | ') END AS steps
FROM findings f JOIN guide USING (rule_id)
"""

_MONTH_LIST = sql_list(fv.MONTHS)


def _date_sql(col: str) -> str:
    month = f"({_MONTH_LIST})[month({col})]"
    return (f"CASE WHEN scan_id % 10 < 6 THEN strftime({col}, '%d/%m/%Y') "
            f"WHEN scan_id % 10 < 8 THEN upper(substr({month}, 1, 3)) || ' ' || year({col}) "
            f"ELSE {month} || ' ' || year({col}) END")


LABEL_TEXT = f"""
SELECT scan_id, ocr_confidence, violation, concat_ws(chr(10), generic_name,
  CASE WHEN manufacturer_name IS NOT NULL THEN concat_ws(', ', manufacturer_name, 'Plot ' || (scan_id + 1), manufacturer_address) END,
  CASE WHEN violation IS DISTINCT FROM 'missing_netqty' THEN 'Net Qty: ' || format('{{:g}}', net_quantity_value) || ' ' || net_quantity_unit END,
  CASE WHEN violation IS DISTINCT FROM 'missing_mrp' THEN 'MRP Rs. ' || format('{{:.2f}}', mrp) ||
    CASE WHEN mrp_includes_taxes AND violation IS DISTINCT FROM 'missing_tax_phrase' THEN ' Inclusive of all taxes' ELSE '' END END,
  CASE WHEN violation IS DISTINCT FROM 'missing_dates' THEN NULLIF(concat_ws(' ', 'Mfg: ' || {_date_sql('mfg_date')}, 'Exp: ' || {_date_sql('expiry_date')}), '') END,
  CASE WHEN violation IS DISTINCT FROM 'missing_care' THEN 'Customer Care: ' || consumer_care END,
  'Country of Origin: ' || country_of_origin) AS ocr_text
FROM (SELECT *, CASE WHEN scan_id % 4 = 0 THEN ({sql_list(fv.VIOLATIONS)})[CAST((scan_id // 4) % 5 AS INTEGER) + 1] END AS violation
      FROM declarations)
"""

DOCUMENT_FRAMES = """
SELECT doc_id // 3 AS scan_id, doc_id % 3 AS frame_index, CAST((doc_id * 37) % 101 AS DOUBLE) AS ocr_confidence, text FROM documents
"""

ORDER_FRAMES = """
SELECT l_orderkey AS scan_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS frame_index,
  least(round(l_discount * 1000), 100.0) AS ocr_confidence, 20 + l_partkey % 50 AS text_length,
  CASE WHEN l_quantity > 10 THEN round(l_quantity / 12, 2) END AS font_mm,
  l_suppkey % 7 <> 0 AS has_boxes, l_partkey % 11 <> 0 AS has_blob, l_partkey AS part_id FROM lineitem
"""

WORDS = """
SELECT scan_id, line_no * 100000 + token_no AS ord, line_no, token AS text, token_no * 120 AS x, line_no * 35 + token_no % 3 AS y,
  length(token) * 10 AS w, token_no % 3 + 20 AS h, CAST((scan_id + line_no * 7 + token_no * 37) % 104 - 3 AS DOUBLE) AS confidence
FROM (SELECT scan_id, line_no, unnest(toks) AS token, unnest(range(len(toks))) AS token_no
  FROM (SELECT scan_id, line_no, list_filter(string_split(line, ' '), lambda t: t <> '') AS toks
    FROM (SELECT doc_id AS scan_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)))
"""

_PREFIX_SQL = sql_list(GTIN_PREFIXES)
_CODE = "({p})[CAST({k} % {n} AS INTEGER) + 1] || lpad(CAST({k} AS VARCHAR), 9, '0') || '0'"
BARCODES = f"""
SELECT scan_id, frame_index AS pos, CASE WHEN part_id % 3 = 0 THEN 'EAN8' ELSE 'EAN13' END AS format,
  CASE WHEN part_id % 17 = 0 THEN '' ELSE {_CODE.format(p=_PREFIX_SQL, k='part_id', n=len(GTIN_PREFIXES))} END AS code FROM order_frames
"""
CATALOG = f"""
SELECT {_CODE.format(p=_PREFIX_SQL, k='p_partkey', n=len(GTIN_PREFIXES))} AS code,
  CASE WHEN p_partkey % 13 <> 0 THEN upper(string_split(p_name, ' ')[1]) END AS name,
  CASE WHEN p_partkey % 5 <> 0 THEN (p_size * 20) || ' G' END AS quantity, p_name AS product_name, p_brand AS brand FROM part
"""
GTIN_CARDS = """
SELECT scan_id, format, code, row_number() OVER (PARTITION BY scan_id ORDER BY first_pos, format, code) AS n,
  count(*) OVER (PARTITION BY scan_id) AS total
FROM (SELECT scan_id, format, code, min(pos) AS first_pos FROM barcodes WHERE code <> '' GROUP BY ALL)
"""
GS1 = ("SELECT * FROM (VALUES " + ", ".join(f"({quote(k)}, {quote(v)})" for k, v in fv.GS1_COUNTRIES.items()) +
       ") t(prefix, country)")

ACTIONS = f"""
SELECT event_id, event_id % (SELECT count(*) FROM orders) AS scan_id, ({sql_list(fv.RULE_IDS)})[CAST(event_id % 10 AS INTEGER) + 1] AS rule_id,
  CASE event_type WHEN 'click' THEN 'attest' WHEN 'error' THEN 'dispute' WHEN 'view' THEN 'withdraw' WHEN 'purchase' THEN 'confirm' WHEN 'signup' THEN 'override' END AS action,
  CASE WHEN event_id % 3 <> 0 THEN 'seen ' || event_id END AS observed, CAST(user_id AS VARCHAR) AS officer,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE 'note ' || event_id END AS notes,
  CASE WHEN user_id % 2 = 0 THEN 'admin' ELSE 'officer' END AS role, ts AS acted, value FROM events
"""

SCANS = """
SELECT v.scan_id, v.owner_id, v.created_at, t.ocr_text, v.ocr_confidence, v.verdict, v.verdict = 'COMPLIANT' AS compliant,
  CASE WHEN v.scan_id % 4 = 1 THEN 'final' ELSE 'pending_review' END AS status,
  CASE v.scan_id % 3 WHEN 0 THEN 'tesseract' WHEN 1 THEN 'florence-2' ELSE 'tesseract+merge3' END AS ocr_engine,
  CASE WHEN v.scan_id % 10 <> 0 THEN generic_name END AS product_name, CASE WHEN v.scan_id % 10 <> 1 THEN manufacturer_name END AS brand_name,
  CASE v.scan_id % 5 WHEN 0 THEN 'food' WHEN 1 THEN '' WHEN 2 THEN ' home ' END AS category,
  CASE WHEN v.scan_id % 6 <> 0 THEN (v.scan_id * 7 % 2000) / 10 - 100 END AS scan_lat,
  CASE WHEN v.scan_id % 8 <> 0 THEN (v.scan_id * 13 % 4001) / 11 - 182 END AS scan_lon,
  CASE WHEN v.scan_id % 4 = 1 THEN 'officer' || (v.scan_id % 20) END AS reviewed_by,
  CASE WHEN v.scan_id % 4 = 1 THEN v.created_at + INTERVAL 26 HOUR END AS reviewed_at,
  CASE WHEN v.scan_id % 8 = 1 THEN 'seen on pack' ELSE '' END AS review_notes, v.scan_id % 8 = 1 AS overridden,
  min_numeral_height_mm AS font_height_mm
FROM verdicts v JOIN label_text t ON v.scan_id = t.scan_id
"""

# Officer actions folded to the last one per scan and rule, against the machine findings.
OVERLAYS = f"""
SELECT a.scan_id, a.rule_id, CASE WHEN action = 'attest' THEN 'PASS' ELSE 'FAIL' END AS status, action = 'attest' AS has_observed,
  CASE WHEN action = 'attest' THEN COALESCE(a.observed, f.observed) END AS observed, a.officer, a.acted
FROM (SELECT * FROM actions WHERE action IN ('attest', 'dispute', 'withdraw') AND rule_id IN {sql_in(fv.RULE6_IDS)}
      QUALIFY row_number() OVER (PARTITION BY scan_id, rule_id ORDER BY acted DESC, event_id DESC) = 1) a
JOIN findings f ON a.scan_id = f.scan_id AND a.rule_id = f.rule_id
WHERE NOT (action <> 'attest' AND f.status <> 'PASS')
"""

OVERLAID = f"""
SELECT a.scan_id, a.rule_order, a.rule_id, COALESCE(o.status, a.status) AS status, a.severity, a.expected, a.remedy,
  CASE WHEN o.has_observed THEN o.observed ELSE a.observed END AS observed,
  CASE WHEN o.rule_id IS NULL THEN a.message ELSE trim(a.message || ' [officer-verified]') END AS message,
  CASE o.status WHEN 'PASS' THEN 'attested' WHEN 'FAIL' THEN 'disputed' ELSE a.cause END AS cause,
  CASE o.status WHEN 'PASS' THEN '' WHEN 'FAIL' THEN {quote(fv.DISPUTED_WHY)} ELSE a.why END AS why,
  CASE o.status WHEN 'PASS' THEN '' WHEN 'FAIL' THEN {quote(' | '.join(fv.DISPUTED_STEPS))} ELSE a.steps END AS steps,
  CASE WHEN o.rule_id IS NULL THEN 0 ELSE 1 END AS manual
FROM annotated a LEFT JOIN overlays o ON a.scan_id = o.scan_id AND a.rule_id = o.rule_id
"""

SHORT_RULES = ("SELECT * FROM (VALUES " + ", ".join(
    f"({quote(r)}, {quote(ref)}, {quote(req)})" for r, (ref, req) in fv.RULE_LABELS.items()) + ") t(rule_id, ref, requirement)")

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "declarations": (DECLARATIONS, ()),
    "tiered": (TIERED, ("declarations",)),
    "statuses": (STATUSES, ("tiered",)),
    "verdicts": (VERDICTS, ("statuses",)),
    "findings": (FINDINGS, ("statuses",)),
    "guide": (_guide_values(), ()),
    "annotated": (ANNOTATED, ("findings", "guide")),
    "label_text": (LABEL_TEXT, ("declarations",)),
    "document_frames": (DOCUMENT_FRAMES, ()),
    "order_frames": (ORDER_FRAMES, ()),
    "words": (WORDS, ()),
    "barcodes": (BARCODES, ("order_frames",)),
    "gtin_cards": (GTIN_CARDS, ("barcodes",)),
    "gs1": (GS1, ()),
    "catalog": (CATALOG, ()),
    "actions": (ACTIONS, ()),
    "scans": (SCANS, ("verdicts", "label_text")),
    "overlays": (OVERLAYS, ("actions", "findings")),
    "overlaid": (OVERLAID, ("annotated", "overlays")),
    "short_rules": (SHORT_RULES, ()),
}


def with_views(body: str, *names: str, replaced: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> str:
    """``body`` preceded by the named views and whatever they depend on."""
    views = {**VIEWS, **(replaced or {})}
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in views[name][1]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({views[n][0].strip()})" for n in order) + "\n" + body.strip()
