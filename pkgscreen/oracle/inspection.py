"""Checks for rules, scores and inspections."""

from __future__ import annotations

from pkgscreen import vocab as v
from pkgscreen.operators.rules import ABSENT, ELSEWHERE, LOW, POOR
from pkgscreen.oracle.base import check, cte, lst, m, x

cte("asse", "SELECT package_id FROM [[route]] WHERE route = 'ASSESS'")
cte("cx", """SELECT package_id, q.usable, q.score, NOT q.usable OR q.score < 60 AS blocks, o.avg_confidence AS ocr FROM [[asse]] JOIN [[pq]] q USING (package_id) JOIN [[po]] o USING (package_id)""")
cte("fv", "SELECT f.* FROM [[final]] f JOIN [[asse]] USING (package_id)")
cte("pm", f"""SELECT DISTINCT p.package_id, f.field FROM [[ptr]] p CROSS JOIN (SELECT unnest({v.FIELDS}) AS field) f
WHERE list_contains(p.hints, f.field) OR (p.location IN {lst(v.BASE_PLACES)} AND f.field IN {lst(v.BASE_FIELDS)})""")
cte("pms", f"""SELECT DISTINCT p.package_id, f.field FROM [[ptr]] p CROSS JOIN (SELECT unnest({v.FIELDS}) AS field) f
WHERE list_contains(p.hints, f.field) OR (p.location IN {lst(v.BASE_PLACES)} AND f.field IN {lst(v.BASE_FIELDS_STATUTORY)})""")
_price = f"TRY_CAST({x(v.PRICE_NUMBER, 1, 'value', True)} AS DOUBLE)"
_valid = {"PRESENT": "true", "PRESENT_AND_VALID_PRICE": f"coalesce({_price} BETWEEN 1 AND 50000, false)",
          "PRESENT_AND_VALID_UNIT": m(v.UNIT_VALUE, "value"), "VALID_DATE": "regexp_matches(value, '[0-9]')"}
check("rule_validators", "SELECT package_id, field, " + ", ".join(f"{e} AS {k.lower()}" for k, e in _valid.items()) + " FROM [[fv]] WHERE value IS NOT NULL")
cte("gr0", """SELECT c.package_id, c.blocks, r.*, string_split(r.fields, ',') AS fl,
  (SELECT value FROM [[fv]] f WHERE f.package_id = c.package_id AND f.field = r.depends_on) AS other FROM [[cx]] c CROSS JOIN [[generic_rules]] r""")
cte("gr1", """SELECT g.package_id, g.rule_id, count(f.value) AS present, count(f.value) FILTER (f.level <> 'LOW') AS strong, bool_or(p.field IS NOT NULL) AS pointed,
  any_value(f.value) FILTER (f.field = g.fl[1]) AS value, any_value(f.level) FILTER (f.field = g.fl[1]) AS level
FROM [[gr0]] g JOIN [[fv]] f ON f.package_id = g.package_id AND list_contains(g.fl, f.field) LEFT JOIN [[pm]] p ON p.package_id = g.package_id AND p.field = f.field GROUP BY ALL""")
cte("gr2", """SELECT g.*, h.* EXCLUDE (package_id, rule_id), CASE condition WHEN 'ALWAYS' THEN 'YES' WHEN 'FIELD_PRESENT' THEN CASE WHEN other IS NULL THEN 'NO' ELSE 'YES' END
  ELSE CASE WHEN other IS NULL THEN 'UNKNOWN' WHEN contains(lower(other), 'india') THEN 'NO' ELSE 'YES' END END AS applies
FROM [[gr0]] g JOIN [[gr1]] h USING (package_id, rule_id)""")
_ok = "CASE validation " + " ".join(f"WHEN '{k}' THEN {e}" for k, e in _valid.items()) + " END"
cte("gr3", f"""SELECT *, CASE WHEN applies = 'NO' THEN 'rule does not apply' WHEN applies = 'UNKNOWN' THEN 'applicability unknown'
  WHEN rule_type = 'MANDATORY_ANY' AND strong > 0 THEN 'declared' WHEN rule_type = 'MANDATORY_ANY' AND present > 0 THEN '{LOW}'
  WHEN (rule_type = 'MANDATORY_ANY' OR value IS NULL) AND blocks THEN '{POOR}' WHEN (rule_type = 'MANDATORY_ANY' OR value IS NULL) AND pointed THEN '{ELSEWHERE}'
  WHEN rule_type = 'MANDATORY_ANY' OR value IS NULL THEN '{ABSENT}' WHEN level = 'LOW' THEN '{LOW}' WHEN {_ok} THEN 'declared' ELSE 'value could not be validated' END AS reason FROM [[gr2]]""")
_st = f"CASE reason WHEN 'rule does not apply' THEN 'NOT_APPLICABLE' WHEN 'declared' THEN 'PASS' WHEN '{ABSENT}' THEN 'FAIL' WHEN 'rule awaits verification' THEN 'UNVERIFIED' ELSE 'MANUAL_REVIEW' END AS status"
cte("gfind", f"SELECT *, {_st} FROM [[gr3]]")
_g = "package_id, rule_id, status, reason"
check("rule_findings", f"SELECT {_g}, severity FROM [[gfind]]")
check("rule_unverified", f"SELECT package_id, rule_id, {_st}, reason FROM (SELECT * REPLACE (CASE WHEN NOT verified THEN 'rule awaits verification' ELSE reason END AS reason) FROM [[gr3]])")
check("rule_applicability", "SELECT package_id, rule_id, applies FROM [[gfind]]")
check("rule_mandatory", f"SELECT {_g} FROM [[gfind]] WHERE rule_type IN ('MANDATORY', 'CONDITIONAL')")
check("rule_any_of", f"SELECT {_g} FROM [[gfind]] WHERE rule_type = 'MANDATORY_ANY'")
check("pointer_match", "SELECT package_id, rule_id, pointed FROM [[gfind]]")


def fuse(src: str) -> str:
    return f"""SELECT package_id, CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'NON_COMPLIANT' WHEN count(*) FILTER (status IN ('MANUAL_REVIEW', 'UNVERIFIED')) > 0 THEN 'MANUAL_REVIEW'
  WHEN count(*) FILTER (status = 'PASS') > 0 THEN 'COMPLIANT' ELSE 'MANUAL_REVIEW' END AS decision,
  coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (status = 'FAIL'), '') AS failed_rules,
  coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (status IN ('MANUAL_REVIEW', 'UNVERIFIED')), '') AS review_rules FROM {src} GROUP BY package_id"""


check("decision_fuse", fuse("[[gfind]]"))

# statutory rules
cte("w", "SELECT package_id, " + ", ".join(
    f"max(value) FILTER (field = '{f}') AS {f}, max(level) FILTER (field = '{f}') AS {f}_level, max(ocr_conf) FILTER (field = '{f}') AS {f}_conf" for f in v.FIELDS)
    + ", max(ocr_text) FILTER (field = 'net_quantity') AS qtext, bool_or(address_detected) AS addressed FROM [[fv]] GROUP BY package_id")
_amt, _unit = f"CAST({x(v.STANDARD_QTY, 1, 'net_quantity')} AS DOUBLE)", f"lower({x(v.STANDARD_QTY, 2, 'net_quantity')})"
cte("w2", f"""SELECT w.*, c.blocks, {_amt} AS amt, {_unit} AS unit, p.pf FROM [[w]] w JOIN [[cx]] c USING (package_id)
LEFT JOIN (SELECT package_id, list(field) AS pf FROM [[pms]] GROUP BY 1) p USING (package_id)""")
_gr = "amt * CASE WHEN unit IN ('kg', 'l') THEN 1000 ELSE 1 END"
cte("w3", f"""SELECT *, CASE WHEN net_quantity IS NULL OR net_quantity_level = 'LOW' OR amt IS NULL THEN 'UNKNOWN' WHEN unit NOT IN ('g', 'gm', 'kg', 'ml', 'l') THEN 'FULL'
  WHEN {_gr} <= 10 THEN 'EXEMPT' WHEN {_gr} <= 20 THEN 'PARTIAL' ELSE 'FULL' END AS exemption FROM [[w2]]""")
check("exemption_mode", "SELECT package_id, exemption FROM [[w3]]")


def absent(*fields: str) -> str:
    return (f"CASE WHEN blocks THEN '{POOR}' WHEN {' OR '.join(f'coalesce(list_contains(pf, {f!r}), false)' for f in fields)} THEN '{ELSEWHERE}' ELSE '{ABSENT}' END")


def simple(f: str, test: str, good: str, bad: str) -> str:
    return f"CASE WHEN {f} IS NULL THEN {absent(f)} WHEN {f}_level = 'LOW' THEN '{LOW}' WHEN {test} THEN '{good}' ELSE '{bad}' END"


_qty = simple("net_quantity", "amt IS NOT NULL", "standard unit", "no standard unit")
_made = "coalesce(manufacturing_date, packing_date)"
_month = f"(({' OR '.join(m(p, _made) for p in v.MONTH_YEAR)}) AND ({m(v.MONTH_WORD, _made)} OR {m(v.DAY_MONTH_YEAR, _made)}))"
_mp = f"TRY_CAST({x(v.PRICE_NUMBER, 1, 'mrp', True)} AS DOUBLE) BETWEEN 1 AND 50000"
_wrong = " OR ".join(f"(unit = '{u}' AND amt {o} {n})" for u, o, n in v.UNIT_LIMITS)
_bad = "|".join("|".join([rf"\b{p}\b", *v.WORDING_ABBREVIATIONS.get(p, [])]) for p in v.WORDING_ABBREVIATIONS)
_H = {
    "manufacturer_details": f"CASE WHEN coalesce(manufacturer, packer, importer) IS NULL THEN {absent(*v.ENTITY_FIELDS)} WHEN CASE WHEN manufacturer IS NOT NULL THEN manufacturer_level WHEN packer IS NOT NULL THEN packer_level ELSE importer_level END = 'LOW' THEN '{LOW}' WHEN addressed THEN 'name and address found' ELSE 'name found, address not located' END",
    "commodity_identity": simple("product_name", "true", "name stated", ""), "net_quantity": _qty, "quantity_unit": _qty,
    "date_declaration": f"CASE WHEN {_made} IS NULL THEN {absent('manufacturing_date', 'packing_date')} WHEN CASE WHEN manufacturing_date IS NOT NULL THEN manufacturing_date_level ELSE packing_date_level END = 'LOW' THEN '{LOW}' WHEN {_month} THEN 'month and year stated' ELSE 'month and year unconfirmed' END",
    "mrp": simple("mrp", _mp, "plausible price", "implausible price"),
    "consumer_contact": f"CASE WHEN consumer_care IS NULL THEN {absent('consumer_care')} WHEN contains(lower(consumer_care), 'phone') THEN 'telephone stated' WHEN contains(lower(consumer_care), 'email') THEN 'e-mail only, telephone needed' ELSE 'unclear contact' END",
    "quantity_language": f"CASE WHEN net_quantity IS NULL THEN 'no quantity to judge' WHEN {m(_bad, chr(40) + 'net_quantity || ' + chr(39) + ' | ' + chr(39) + ' || qtext' + chr(41))} THEN 'misleading wording' ELSE 'no misleading wording' END",
    "unit_format": f"CASE WHEN amt IS NULL THEN 'no unit to judge' WHEN {_wrong} THEN 'another unit required' ELSE 'unit fits' END",
    "language": "CASE WHEN " + " + ".join(f"({f} IS NOT NULL)::INT" for f in v.LANGUAGE_FIELDS) + " >= 2 THEN 'enough declarations' ELSE 'too few declarations' END",
    "declaration_legibility": "CASE WHEN mrp IS NULL AND net_quantity IS NULL THEN 'legibility unknown' WHEN mrp IS NULL OR net_quantity IS NULL THEN 'legibility of one unknown' WHEN least(mrp_conf, net_quantity_conf) >= 0.85 THEN 'legible' ELSE 'legibility doubtful' END",
}
_case = " ".join(f"WHEN '{k}' THEN {e}" for k, e in _H.items())


def statutory(src: str, name: str) -> None:
    cte(f"{name}0", f"""SELECT w.package_id, r.*, CASE WHEN vtype = 'EXEMPTION_LOOKUP' THEN 'exemption gate: ' || exemption WHEN rule_id IN {lst(v.SCOPE_NA_RULES)} THEN 'rule outside photo screening'
  WHEN vtype IN {lst(v.SCOPE_NA_TYPES)} THEN 'check outside photo screening'
  WHEN category IN {lst(v.DECLARATION_CATEGORIES)} AND (exemption = 'EXEMPT' OR (exemption = 'PARTIAL' AND category NOT IN {lst(v.PARTIAL_CATEGORIES)})) THEN 'exempt by quantity'
  ELSE CASE category {_case} ELSE 'no check for this category' END END AS reason FROM {src} w CROSS JOIN [[statutory_rules]] r WHERE vtype <> 'REQUIRED_DECLARATIONS_PRESENT'""")
    cte(f"{name}1", f"""SELECT *, CASE WHEN reason IN ('name and address found', 'name stated', 'standard unit', 'month and year stated', 'plausible price', 'telephone stated', 'no misleading wording', 'unit fits', 'enough declarations', 'legible') THEN 'PASS'
  WHEN reason IN ('{ABSENT}', 'misleading wording') THEN 'FAIL' WHEN reason LIKE 'exemption gate%' OR reason LIKE '%outside photo screening' OR reason IN ('exempt by quantity', 'no quantity to judge', 'no unit to judge') THEN 'NOT_APPLICABLE'
  ELSE 'MANUAL_REVIEW' END AS status FROM [[{name}0]]""")
    cte(f"{name}2", f"""SELECT package_id, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'MANUAL_REVIEW') THEN 'MANUAL_REVIEW' WHEN bool_or(status = 'PASS') THEN 'PASS' ELSE 'NOT_APPLICABLE' END AS status
FROM [[{name}1]] GROUP BY 1""")
    cte(name, f"""SELECT package_id, rule_id, category, vtype, severity, title, fields, reason, status FROM [[{name}1]] UNION ALL
SELECT package_id, rule_id, category, vtype, severity, title, fields, CASE status WHEN 'FAIL' THEN 'declarations missing or invalid' WHEN 'MANUAL_REVIEW' THEN 'declarations uncertain' WHEN 'PASS' THEN 'all declarations found' ELSE 'declarations exempt' END, status
FROM [[{name}2]] CROSS JOIN [[statutory_rules]] WHERE vtype = 'REQUIRED_DECLARATIONS_PRESENT'""")


statutory("[[w3]]", "sf")
check("statutory_findings", f"SELECT {_g}, category, severity FROM [[sf]]")
for _key, _where in {
    "exemption_report": "category = 'exemptions'", "scope_na": "reason LIKE '%outside photo screening'", "exempt_rules": "reason = 'exempt by quantity'",
    "check_entity": "category = 'manufacturer_details'", "check_product_name": "category = 'commodity_identity'",
    "check_net_quantity": "category IN ('net_quantity', 'quantity_unit')", "check_mfg_date": "category = 'date_declaration'", "check_mrp": "category = 'mrp'",
    "check_contact": "category = 'consumer_contact'", "check_wording": "category = 'quantity_language'", "check_unit_threshold": "category = 'unit_format'",
    "check_language": "category = 'language'", "check_legibility": "category = 'declaration_legibility'", "aggregate_rule": "category = 'package_declarations'",
    "no_handler": "reason = 'no check for this category'",
}.items():
    check(_key, f"SELECT {_g} FROM [[sf]] WHERE {_where}")

# scores
def confidence(find: str, ocr: str, quality: str) -> str:
    return f"""SELECT c.package_id, {ocr} AS ocr, coalesce((SELECT avg(ext_conf) FROM [[fv]] f WHERE f.package_id = c.package_id AND f.value IS NOT NULL), 0.0) AS extraction,
  {quality} AS image_quality, coalesce(d.share, 0.5) AS rule_applicability FROM [[cx]] c
LEFT JOIN (SELECT package_id, count(*) FILTER (status IN ('PASS', 'FAIL')) / nullif(count(*) FILTER (status <> 'NOT_APPLICABLE'), 0)::DOUBLE AS share FROM {find} GROUP BY 1) d USING (package_id)"""


cte("conf0", confidence("[[sf]]", "c.ocr", "c.score / 100"))
_all = "greatest(0, least(1, 0.4::DOUBLE * ocr + 0.3::DOUBLE * extraction + 0.2::DOUBLE * image_quality + 0.1::DOUBLE * rule_applicability))"
cte("conf", f"SELECT *, {_all} AS overall FROM [[conf0]]")
check("confidence_components", "SELECT package_id, round(ocr, 6) AS ocr, round(extraction, 6) AS extraction, round(image_quality, 6) AS image_quality, round(rule_applicability, 6) AS rule_applicability FROM [[conf]]")
check("confidence_overall", "SELECT package_id, CAST(round(CAST(overall AS DECIMAL(18, 9)), 6) AS DOUBLE) AS overall FROM [[conf]]")
check("confidence_fields", "SELECT package_id, field, CASE WHEN value IS NULL THEN 0.0::DOUBLE ELSE round(greatest(0, least(1, ocr_conf, ext_conf)), 6) END AS confidence FROM [[fv]]")
cte("dec", fuse("[[sf]]"))
_weak = "round(overall, 9) < 0.70 AND decision IN ('COMPLIANT', 'NON_COMPLIANT')"
cte("guarded", f"SELECT package_id, CASE WHEN {_weak} THEN 'MANUAL_REVIEW' ELSE decision END AS decision, CASE WHEN {_weak} THEN decision END AS downgraded_from, overall, failed_rules FROM [[dec]] JOIN [[conf]] USING (package_id)")
check("decision_guard", "SELECT package_id, decision, downgraded_from FROM [[guarded]]")
_wt = "CASE severity WHEN 'CRITICAL' THEN 3.0 WHEN 'HIGH' THEN 2.0 WHEN 'MEDIUM' THEN 1.5 ELSE 1.0 END"
_cr = "CASE status WHEN 'PASS' THEN 1.0 WHEN 'MANUAL_REVIEW' THEN 0.5 WHEN 'FAIL' THEN 0.0 END"
_bk = "CASE category " + " ".join(f"WHEN '{c}' THEN '{b}'" for c, b in v.CATEGORY_BUCKETS.items()) + " ELSE 'other' END"


def scored(src: str) -> str:
    return f"SELECT *, {_wt} * {_cr} AS e, CASE WHEN {_cr} IS NOT NULL THEN {_wt} END AS wt, {_bk} AS bucket FROM {src}"


cte("sc", scored("[[sf]]"))
_ratio = "CAST(round(CAST(100 * sum(e) / sum(wt) AS DOUBLE), 1) AS DOUBLE)"
cte("score", f"SELECT package_id, {_ratio} AS score, count(wt) AS scored_rules, count(*) - count(wt) AS not_assessable FROM [[sc]] GROUP BY 1")
check("compliance_score", "SELECT * FROM [[score]]")
_grade = "CASE WHEN score IS NULL THEN '-' " + " ".join(f"WHEN score >= {n} THEN '{g}'" for n, g in v.GRADES) + " END AS grade"
check("score_grade", f"SELECT package_id, {_grade} FROM [[score]]")
check("score_breakdown", f"""SELECT k.package_id, k.bucket, (SELECT {_ratio} FROM [[sc]] s WHERE s.package_id = k.package_id AND s.bucket = k.bucket) AS score,
  (SELECT count(*) FROM [[sc]] s WHERE s.package_id = k.package_id AND s.bucket = k.bucket AND status = 'PASS') AS passed,
  (SELECT count(*) FROM [[sc]] s WHERE s.package_id = k.package_id AND s.bucket = k.bucket AND status = 'FAIL') AS failed,
  (SELECT count(*) FROM [[sc]] s WHERE s.package_id = k.package_id AND s.bucket = k.bucket AND status = 'MANUAL_REVIEW') AS reviewed,
  (SELECT count(*) FROM [[sc]] s WHERE s.package_id = k.package_id AND s.bucket = k.bucket AND wt IS NULL) AS not_assessable
FROM (SELECT package_id, unnest({v.BUCKETS}) AS bucket FROM [[cx]]) k""")
cte("corp", """SELECT package_id, lower(string_agg(t, chr(10) ORDER BY o1, o2, o3)) AS corpus FROM (
  SELECT package_id, 0 AS o1, field AS o2, 0 AS o3, value AS t FROM [[fv]] UNION ALL SELECT package_id, 0, field, 1, ocr_text FROM [[fv]]
  UNION ALL SELECT package_id, 1 + surface_idx, '', pos, text FROM [[pool0]] WHERE surface_usable AND package_id IN (SELECT package_id FROM [[asse]])) WHERE t IS NOT NULL GROUP BY 1""")
def _hits(patterns: list[str]) -> str:
    return "list_filter([" + ", ".join(f"regexp_extract(corpus, '{p}', 0, 'i')" for p in patterns) + "], lambda h: h <> '')"


_pts = ", ".join("{'p': " + " + ".join([f"3 * {m(p, 'corpus')}::INT" for p in s] + [f"{m(p, 'corpus')}::INT" for p in k]) + f", 'o': {-n}, 'n': '{c}'" + "}" for n, (c, s, k) in enumerate(v.COMMODITY))
_why = "CASE product_category " + " ".join(f"WHEN '{c}' THEN list_concat({_hits(s)}, {_hits(k)})" for c, s, k in v.COMMODITY) + " ELSE [] END"
cte("cls", f"SELECT package_id, corpus, list_reverse_sort(list_filter([{_pts}], lambda c: c.p > 0)) AS r FROM [[corp]]")
cte("cat0", """SELECT package_id, corpus, coalesce(r[1].n, 'unknown') AS product_category, CASE WHEN len(r) = 0 THEN 0.0::DOUBLE ELSE
  round(least(0.85::DOUBLE, 0.35::DOUBLE + 0.5::DOUBLE * (r[1].p - coalesce(r[2].p, 0)) / r[1].p), 4) END AS category_confidence,
  coalesce(r[1].p >= 3 AND coalesce(r[2].p, 0) < r[1].p, false) AS confident FROM [[cls]]""")
cte("cat", f"SELECT * EXCLUDE corpus, array_to_string(list_transform(({_why})[1:6], lambda h: trim(h)), '|') AS evidence FROM [[cat0]]")
check("classify_product", "SELECT * FROM [[cat]]")
_scope = "CASE category " + " ".join(f"WHEN '{c}' THEN product_category IN {lst(a)}" for c, a in v.CATEGORY_RULE_SCOPE.items()) + " ELSE true END"
check("rule_scope", f"SELECT package_id, rule_id, product_category = 'unknown' OR {_scope} AS in_scope FROM [[sf]] JOIN [[cat]] USING (package_id)")
_decl = "CASE d " + " ".join(f"WHEN '{k}' THEN {list(f)}" for k, f in v.DECLARED_FIELDS.items()) + f" WHEN '' THEN [] ELSE CASE WHEN d IN {lst(v.FIELDS)} THEN [d] ELSE [] END END"
_bycat = "CASE category " + " ".join(f"WHEN '{k}' THEN {list(f)}" for k, f in v.CATEGORY_FIELDS.items()) + " ELSE [] END"
cte("rf", f"SELECT *, CASE WHEN len(n0) > 0 THEN n0 ELSE {_bycat} END AS names FROM (SELECT *, flatten(list_transform(string_split(fields, ','), lambda d: {_decl})) AS n0 FROM [[sf]])")
check("rule_fields", "SELECT package_id, rule_id, array_to_string(names, ',') AS names FROM [[rf]]")
cte("fs", """SELECT package_id, field, CASE max(CASE status WHEN 'FAIL' THEN 2 WHEN 'MANUAL_REVIEW' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'MANUAL_REVIEW' ELSE 'PASS' END AS status
FROM (SELECT package_id, status, unnest(names) AS field FROM [[rf]]) WHERE status IN ('PASS', 'MANUAL_REVIEW', 'FAIL') GROUP BY ALL""")
check("field_status", "SELECT * FROM [[fs]]")
cte("pfirst", f"""SELECT p.package_id, f.field, p.location, p.surface_name, p.ptext FROM [[ptr]] p CROSS JOIN (SELECT unnest({v.FIELDS}) AS field) f
WHERE list_contains(p.hints, f.field) OR (p.location IN {lst(v.BASE_PLACES)} AND f.field IN {lst(v.BASE_FIELDS_STATUTORY)})
QUALIFY row_number() OVER (PARTITION BY p.package_id, f.field ORDER BY p.surface_idx, p.pos) = 1""")
_review = "CASE category " + " ".join(f"WHEN '{k}' THEN {list(f)}" for k, f in v.REVIEW_FIELDS.items() if f) + " ELSE [] END"
cte("pointed", f"""SELECT s.package_id, s.rule_id, p.field, p.location, p.surface_name, p.ptext FROM (SELECT *, {_review} AS names FROM [[sf]] WHERE reason = '{ELSEWHERE}') s
JOIN [[pfirst]] p ON p.package_id = s.package_id AND list_contains(s.names, p.field) QUALIFY row_number() OVER (PARTITION BY s.package_id, s.rule_id ORDER BY list_position(s.names, p.field)) = 1""")
check("finding_evidence", """SELECT r.package_id, r.rule_id, r.field, f.value, round(f.ocr_conf, 6) AS ocr_conf, round(f.ext_conf, 6) AS ext_conf, f.level, f.source_name, NULL::VARCHAR AS pointer_text, NULL::VARCHAR AS pointer_place
FROM (SELECT package_id, rule_id, unnest(names) AS field FROM [[rf]]) r JOIN [[fv]] f USING (package_id, field) WHERE f.value IS NOT NULL
UNION ALL SELECT package_id, rule_id, field, NULL, NULL, NULL, NULL, surface_name, ptext, location FROM [[pointed]]""")
check("annotation_plan", """SELECT f.package_id, f.source_name AS surface_name, f.field, f.value, f.x_min, f.y_min, f.x_max, f.y_max, coalesce(s.status, 'UNKNOWN') AS status, round(f.ext_conf, 6) AS ext_conf
FROM [[fv]] f LEFT JOIN [[fs]] s USING (package_id, field) WHERE f.value IS NOT NULL AND f.x_min IS NOT NULL""")
check("detection_rates", "SELECT field, count(value) AS found, count(*) AS total, round(100.0::DOUBLE * count(value) / count(*), 1) AS rate FROM [[final]] GROUP BY 1")
_first = "CASE category " + " ".join(f"WHEN '{k}' THEN '{f[0]}'" for k, f in v.REVIEW_FIELDS.items() if f) + " ELSE rule_id END"
cte("unus", "SELECT package_id, string_agg(surface_name, ', ' ORDER BY surface_idx) AS names, arg_min(surface_name, surface_idx) AS first FROM [[use]] WHERE NOT usable GROUP BY 1")
cte("act0", f"""SELECT a.*, f.value, f.source_name, p.location, p.surface_name AS pointer_photo, u.names, u.first,
  CASE WHEN p.package_id IS NOT NULL THEN 'pointer' WHEN contains(reason, 'address') THEN 'address' WHEN contains(reason, 'telephone') THEN 'care'
  WHEN contains(reason, 'legibility') OR category = 'declaration_legibility' THEN 'lines' WHEN f.value IS NOT NULL THEN 'read'
  WHEN contains(reason, 'too poor') THEN CASE WHEN u.names IS NOT NULL THEN 'photos' ELSE 'photo' END ELSE 'sides' END AS kind,
  CASE WHEN f.value IS NOT NULL THEN round(f.ext_conf, 3) ELSE CAST(round(CAST(c.overall AS DECIMAL(18, 9)), 3) AS DOUBLE) END AS confidence
FROM (SELECT *, {_first} AS field FROM [[sf]] WHERE status = 'MANUAL_REVIEW' AND category IN {lst(v.REVIEW_FIELDS)}) a LEFT JOIN [[fv]] f USING (package_id, field) JOIN [[conf]] c ON c.package_id = a.package_id
LEFT JOIN [[pointed]] p ON p.package_id = a.package_id AND p.rule_id = a.rule_id LEFT JOIN [[unus]] u ON u.package_id = a.package_id""")
cte("act", """SELECT *, CASE kind WHEN 'pointer' THEN 'the ' || location || ' of the package, where the label points' WHEN 'address' THEN 'address of the making unit' WHEN 'care' THEN 'consumer care panel'
  WHEN 'lines' THEN 'price and quantity lines' WHEN 'read' THEN 'read again: ' || value WHEN 'photos' THEN 'take again: ' || names WHEN 'photo' THEN 'take the photo again' ELSE 'sides not photographed yet' END AS check_location,
  CASE kind WHEN 'pointer' THEN pointer_photo WHEN 'address' THEN source_name WHEN 'care' THEN source_name WHEN 'read' THEN source_name WHEN 'photos' THEN first END AS source_image FROM [[act0]]""")
cte("acts", """SELECT package_id, field, array_to_string(list_transform(string_split(field, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS field_label, rule_id, title AS rule_reference, severity, reason, check_location,
  source_image, confidence, value AS current_value FROM [[act]]
QUALIFY row_number() OVER (PARTITION BY package_id, field, check_location ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, rule_id) = 1""")
check("review_actions", "SELECT * FROM [[acts]]")
cte("insp", f"""SELECT r.package_id, r.route, r.surfaces_total, r.surfaces_usable, y.cylindrical_package, w.product_name, w.brand, w.manufacturer, coalesce(g.decision, 'MANUAL_REVIEW') AS decision,
  g.downgraded_from, CAST(round(CAST(coalesce(g.overall, 0) AS DECIMAL(18, 9)), 6) AS DOUBLE) AS confidence, s.score, CASE WHEN s.package_id IS NOT NULL THEN {_grade.replace(' AS grade', '')} END AS grade, k.product_category, g.failed_rules AS violation_rule_ids, coalesce(a.n, 0) AS num_review_actions
FROM [[route]] r JOIN [[cyl]] y USING (package_id) LEFT JOIN [[w]] w USING (package_id) LEFT JOIN [[guarded]] g USING (package_id) LEFT JOIN [[score]] s USING (package_id)
LEFT JOIN [[cat]] k USING (package_id) LEFT JOIN (SELECT package_id, count(*) AS n FROM [[acts]] GROUP BY 1) a USING (package_id)""")
check("inspect_packages", "SELECT * FROM [[insp]]")
check("decision_counts", "SELECT decision, count(*) AS packages, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS share FROM [[insp]] GROUP BY 1")
check("inspection_rows", f"""SELECT i.package_id AS inspection_id, 'pkgscreen-inspection/1' AS response_schema, '2026-01-01T00:00:00Z' AS timestamp, i.product_name, i.decision,
  CASE i.decision WHEN 'COMPLIANT' THEN chr(128994) WHEN 'NON_COMPLIANT' THEN chr(128308) ELSE chr(128993) END AS decision_emoji, i.confidence, i.surfaces_total, i.surfaces_usable, i.cylindrical_package,
  'derived' AS ruleset_id, '1' AS ruleset_version, false AS ruleset_verified, coalesce(s.p, 0) AS num_rules_pass, coalesce(s.f, 0) AS num_rules_fail, coalesce(s.m, 0) AS num_rules_review, i.num_review_actions,
  i.brand, i.manufacturer, i.product_category, i.score AS compliance_score, coalesce(i.violation_rule_ids, '') AS violation_rule_ids, 'PENDING' AS inspector_status, NULL::VARCHAR AS final_decision, coalesce(s.n, 0) AS json_findings
FROM [[insp]] i LEFT JOIN (SELECT package_id, count(*) AS n, count(*) FILTER (status = 'PASS') AS p, count(*) FILTER (status = 'FAIL') AS f, count(*) FILTER (status = 'MANUAL_REVIEW') AS m FROM [[sf]] GROUP BY 1) s USING (package_id)""")
_list = lambda src, expr: f"(SELECT package_id, string_agg({expr}, ';' ORDER BY {expr}) AS l FROM {src} GROUP BY 1)"
cte("sgrp", """SELECT package_id, bucket, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed FROM [[sc]] GROUP BY ALL
UNION ALL SELECT package_id, b, 0, 0 FROM (SELECT DISTINCT package_id FROM [[sc]]) CROSS JOIN (SELECT unnest(BUCKETS) AS b) WHERE (package_id, b) NOT IN (SELECT (package_id, bucket) FROM [[sc]])""".replace("BUCKETS", str(v.BUCKETS)))
check("inspection_nested", f"""SELECT i.package_id, i.decision, f.l AS findings, a.l AS review_actions, c.l AS citations, g.l AS score_groups,
  (SELECT count(value) FROM [[final]] n WHERE n.package_id = i.package_id) AS n_declared, (SELECT count(*) FROM [[ptr]] p WHERE p.package_id = i.package_id) AS n_pointers
FROM [[insp]] i LEFT JOIN {_list("[[sf]]", "rule_id || '=' || status")} f USING (package_id) LEFT JOIN {_list("[[acts]]", "field || '>' || check_location")} a USING (package_id)
LEFT JOIN {_list("(SELECT * FROM [[sf]] WHERE status IN ('FAIL', 'MANUAL_REVIEW'))", "rule_id || '@' || rule_id")} c USING (package_id) LEFT JOIN {_list("[[sgrp]]", "bucket || ':' || passed || '/' || failed")} g USING (package_id)""")
cte("w4", "SELECT * REPLACE (false AS blocks) FROM [[w3]]")
statutory("[[w4]]", "ef")
cte("econf0", confidence("[[ef]]", "0.0", "0.0"))
cte("edec", fuse("[[ef]]"))
cte("esc", scored("[[ef]]"))
check("evaluate_fields", f"""SELECT package_id, CASE WHEN {_weak} THEN 'MANUAL_REVIEW' ELSE decision END AS decision, CASE WHEN {_weak} THEN decision END AS downgraded_from, CAST(round(CAST(overall AS DECIMAL(18, 9)), 6) AS DOUBLE) AS overall, score
FROM [[edec]] JOIN (SELECT *, {_all} AS overall FROM [[econf0]]) USING (package_id) JOIN (SELECT package_id, {_ratio} AS score FROM [[esc]] GROUP BY 1) USING (package_id)""")
