"""Checks for photo quality and the evidence pool."""

from __future__ import annotations

from pkgscreen import vocab as v
from pkgscreen.oracle.base import check, cte, lst, m, x

cte("qual", """SELECT *, blur >= 100 AS blur_pass, brightness BETWEEN 50 AND 240 AS brightness_pass, contrast >= 30 AS contrast_pass,
  glare <= 0.15::DOUBLE AS glare_pass, skew <= 0.3::DOUBLE AS skew_pass FROM [[surface_metrics]]""")
cte("qual2", """SELECT *, CAST(25 * blur_pass::INT + 25 * brightness_pass::INT + 20 * contrast_pass::INT + 15 * glare_pass::INT + 15 * skew_pass::INT AS DOUBLE) AS score
FROM [[qual]]""")
cte("stats", "SELECT package_id, surface_idx, count(*) AS n_lines, CAST(round(CAST(avg(confidence) AS DECIMAL(18, 8)), 4) AS DOUBLE) AS avg_confidence FROM [[lines]] GROUP BY ALL")
cte("use0", """SELECT q.*, score >= 60 AND blur_pass AND brightness_pass AS gate_usable, coalesce(n_lines, 0) AS n_lines, coalesce(avg_confidence, 0.0) AS avg_confidence
FROM [[qual2]] q LEFT JOIN [[stats]] USING (package_id, surface_idx)""")
cte("use", """SELECT *, gate_usable OR (n_lines >= 2 AND avg_confidence >= 0.90) AS usable,
  CASE WHEN gate_usable THEN 'quality_gate' WHEN n_lines >= 2 AND avg_confidence >= 0.90 THEN 'ocr_evidence' ELSE 'none' END AS usability_basis FROM [[use0]]""")
check("quality_score", """SELECT package_id, surface_idx, blur_pass, brightness_pass, contrast_pass, glare_pass, skew_pass, score,
  score >= 60 AND blur_pass AND brightness_pass AS gate_usable FROM [[qual2]]""")
check("surface_ocr", "SELECT package_id, surface_idx, n_lines, avg_confidence FROM [[stats]]")
check("surface_usability", "SELECT package_id, surface_idx, gate_usable, usable, usability_basis, n_lines, avg_confidence FROM [[use]]")
cte("pq", """SELECT package_id, bool_and(usable) AS usable, avg(score) AS score, count(*) AS surfaces_total,
  count(*) FILTER (usable) AS surfaces_usable FROM [[use]] GROUP BY package_id""")
check("package_quality", "SELECT package_id, usable, round(score, 6) AS score, surfaces_total, surfaces_usable FROM [[pq]]")
cte("po", """SELECT package_id, CAST(sum(CASE WHEN usable THEN n_lines ELSE 0 END) AS BIGINT) AS n_lines,
  coalesce(sum(CASE WHEN usable THEN avg_confidence * n_lines END) / nullif(sum(CASE WHEN usable THEN n_lines END), 0), 0.0) AS avg_confidence FROM [[use]] GROUP BY package_id""")
check("package_ocr", "SELECT package_id, n_lines, round(avg_confidence, 6) AS avg_confidence FROM [[po]]")
cte("route", """SELECT package_id, surfaces_total, surfaces_usable, failed AS surfaces_failed, CASE
  WHEN surfaces_usable > 0 AND n > 0 THEN 'ASSESS' WHEN failed = surfaces_total THEN 'ENGINE_FAULT'
  WHEN surfaces_usable = 0 AND failed > 0 THEN 'NO_USABLE_PHOTO_PARTIAL_FAULT' WHEN surfaces_usable = 0 THEN 'NO_USABLE_PHOTO'
  WHEN failed > 0 THEN 'NO_TEXT_PARTIAL_FAULT' ELSE 'NO_TEXT' END AS route
FROM (SELECT package_id, count(*) AS surfaces_total, count(*) FILTER (usable) AS surfaces_usable, count(ocr_error) AS failed,
  coalesce(sum(n_lines) FILTER (usable), 0) AS n FROM [[use]] GROUP BY package_id)""")
check("early_exit", "SELECT *, CASE WHEN route <> 'ASSESS' THEN 'MANUAL_REVIEW' END AS decision FROM [[route]]")

# pool and candidates
_order = "CASE f.field " + " ".join(f"WHEN '{f}' THEN {n}" for n, f in enumerate(v.FIELDS)) + " END"
cte("ufields", "SELECT f.* FROM [[fields]] f JOIN [[use]] u USING (package_id, surface_idx) WHERE u.usable")
cte("pool0", f"""SELECT l.*, u.usable AS surface_usable, c.field AS claimed0,
  max(coalesce(l.y_max, 0)) OVER (PARTITION BY l.package_id, l.surface_idx) AS h
FROM [[ln]] l JOIN [[use]] u USING (package_id, surface_idx)
LEFT JOIN (SELECT package_id, surface_idx, line_idx, max_by(field, {_order}) AS field FROM [[ufields]] f WHERE value IS NOT NULL AND line_idx >= 0 GROUP BY ALL) c
  ON c.package_id = l.package_id AND c.surface_idx = l.surface_idx AND c.line_idx = l.pos""")
cte("nutr", f"""SELECT a.package_id, a.surface_idx, a.line_no,
  bool_or(false) OR regexp_matches(any_value(a.text) || ' ' || coalesce(string_agg(b.text, ' ' ORDER BY b.pos), ''), '{v.CAND_NUTRITION}', 'i') AS nutrition
FROM [[ln]] a LEFT JOIN [[ln]] b ON a.package_id = b.package_id AND a.surface_idx = b.surface_idx AND a.pos <> b.pos AND abs(a.y_min - b.y_min) < 80
GROUP BY ALL""")
_dates = "coalesce(" + ", ".join(x(p.replace("(?i)", ""), 1, "t", not p.startswith("(?i)")) for p in v.CAND_DATES_CS) + ")"
_near = f"EXISTS (SELECT 1 FROM [[ln]] o WHERE o.package_id = p.package_id AND o.surface_idx = p.surface_idx AND o.pos <> p.pos AND abs(o.y_min - p.y_min) < 100 AND {m(v.ADDRESS_STRONG, 'o.text')})"
_ctry = "|".join(v.CAND_COUNTRIES)
_point = f"({m(v.POINTER_OF, 't')} OR {m(v.POINTER_ON, 't')} OR {m(v.POINTER_PLACE, 't')})"
_list = "[" + ", ".join(f"'{c}'" for c in v.CAND_COUNTRIES) + "]"
cte("pool1", f"""SELECT p.*, n.nutrition, h > 0 AND y_min >= h * 0.7::DOUBLE AS base, {_dates} AS dt,
  ({m(v.ADDRESS_STRONG, 't')} OR (regexp_matches(t, '^[0-9]{{6}}$') AND {_near}) OR len(list_distinct(list_transform(regexp_extract_all(t, '{v.ADDRESS_WEAK}', 0, 'i'), lambda w: lower(w)))) >= 2) AS address,
  {x(v.CAND_PHONE_CS, 0, 't', True)} AS phone, {x(v.EMAIL_CS, 0, 't', True)} AS email, {_point} AS pointer,
  list_min(list_transform(regexp_extract_all(t, '\\b({_ctry})\\b', 1, 'i'), lambda c: list_position({_list}, lower(c)))) AS cpos
FROM [[pool0]] p JOIN [[nutr]] n USING (package_id, surface_idx, line_no)""")


def norm(c: str) -> str:
    for _ in range(3):
        c = f"trim(regexp_replace({c}, '{v.ENTITY_LABEL_PREFIX}', '', 'i'), ':.,;- ')"
    return f"nullif({c}, '')"


_b = "package_id, surface_idx, surface_name, surface_usable, line_no, pos, text, confidence, base, claimed0, x_min, y_min, x_max, y_max"
_code = (f"regexp_matches(t, '{v.CAND_CODE_CS}') AND regexp_matches(t, '[0-9]') AND NOT {m(v.CAND_LICENCE, 't')} AND dt IS NULL AND NOT {m(v.CAND_CURRENCY, 't')}"
         f" AND NOT {m(v.CAND_QUANTITY, 't')} AND NOT (regexp_matches(t, '^[0-9]{{6}}$') AND {_near}) AND NOT nutrition")
_entity = f"length(t) BETWEEN 4 AND 60 AND NOT {m(v.CAND_LICENCE, 't')} AND NOT {m(v.CAND_ENTITY_POINTER, 't')} AND {m(v.CAND_COMPANY, 't')}"
_one = [
    ("date", "dt IS NOT NULL", "dt", "dt"),
    ("phone", f"phone IS NOT NULL AND NOT {m(v.CAND_LICENCE, 't')} AND NOT {m(v.CAND_STANDARD_MARK, 't')}", "phone", "'Phone: ' || phone"),
    ("email", "email IS NOT NULL", "email", "'Email: ' || email"),
    ("address", "address", "t", "t"), ("entity", _entity, "t", norm("t")), ("code", _code, "t", "t"),
    ("country", "cpos IS NOT NULL", f"array_to_string(list_transform(string_split({_list}[cpos], ' '), lambda w: upper(w[1]) || w[2:]), ' ')", None),
    ("pointer", "pointer", "t", "t"),
]
_cur = f"unnest(regexp_extract_all(t, '{v.CAND_CURRENCY}', 0, 'i'))"
_qty = f"unnest(regexp_extract_all(t, '{v.CAND_QUANTITY}', 0, 'i'))"
_ord = "unnest(range(len(regexp_extract_all(t, '{}', 0, 'i'))))"
cte("cand0", "\nUNION ALL ".join([
    f"SELECT {_b}, 0 AS ko, {_ord.format(v.CAND_CURRENCY)} AS n, 'currency' AS kind, {_cur} AS value, '₹' || {x(v.CAND_CURRENCY)} AS norm, false AS nutrition FROM [[pool1]]",
    f"SELECT * REPLACE (value AS norm) FROM (SELECT {_b}, 1 AS ko, {_ord.format(v.CAND_QUANTITY)} AS n, 'quantity' AS kind, {_qty} AS value, NULL::VARCHAR AS norm, nutrition FROM [[pool1]])",
    *[f"SELECT {_b}, {k + 2} AS ko, 0 AS n, '{kind}' AS kind, {val} AS value, {nm or val} AS norm, false AS nutrition FROM [[pool1]] p WHERE t <> '' AND {test}"
      for k, (kind, test, val, nm) in enumerate(_one)]]))
_key = "package_id, surface_idx, line_no"
check("pool", f"SELECT {_key}, surface_name, text, confidence, surface_usable FROM [[pool0]]")
check("pool_claims", f"SELECT {_key}, claimed0 AS claimed_by FROM [[pool0]]")
check("base_region", f"SELECT {_key}, CAST(h AS INT) AS surface_height, base AS in_base_region FROM [[pool1]]")
check("nutrition_ctx", f"SELECT {_key}, nutrition FROM [[nutr]]")
for key, kinds in {"cand_currency_qty": ["currency", "quantity"], "cand_date": ["date"], "cand_contact": ["phone", "email"], "cand_address": ["address"],
                   "cand_entity": ["entity"], "cand_code": ["code"], "cand_country": ["country"], "cand_pointer": ["pointer"]}.items():
    check(key, f"SELECT {_key}, kind, value, nutrition, base AS in_base_region FROM [[cand0]] WHERE kind IN {lst(kinds)}")
check("candidate_values", f"SELECT {_key}, kind, value, norm FROM [[cand0]]")

# chains: a greedy walk over the pieces of a photo, one step a piece, for any number of columns and pieces
cte("piece", """SELECT * FROM [[pool0]] WHERE claimed0 IS NULL AND surface_usable AND regexp_matches(t, '^[0-9]{1,8}$')""")
cte("pieces_of", """SELECT package_id, surface_idx, any_value(surface_name) AS surface_name,
  list({'x': x_min, 'y': y_min, 'pos': pos, 'bottom': y_max, 'text': t} ORDER BY x_min, y_min, pos) AS ps FROM [[piece]] GROUP BY ALL""")
cte("chain_steps", """SELECT package_id, surface_idx, 0 AS i, list_filter([{'x': 0::BIGINT, 'last': 0::BIGINT, 'members': [0::BIGINT], 'value': ''}], lambda c: false) AS cs FROM [[pieces_of]]
UNION ALL SELECT package_id, surface_idx, i + 1, CASE WHEN at_c IS NULL THEN list_append(cs, {'x': e.x::BIGINT, 'last': e.bottom::BIGINT, 'members': [e.pos::BIGINT], 'value': e.text})
  ELSE list_transform(cs, lambda c, k: CASE WHEN k = at_c THEN {'x': c.x, 'last': e.bottom::BIGINT, 'members': list_append(c.members, e.pos::BIGINT), 'value': c.value || e.text} ELSE c END) END
FROM (SELECT package_id, surface_idx, i, cs, p.ps[i + 1] AS e,
    nullif(list_position(list_transform(cs, lambda c: abs(p.ps[i + 1].x - c.x) <= 40 AND p.ps[i + 1].y - c.last > 0 AND p.ps[i + 1].y - c.last < 90), true), 0) AS at_c
  FROM chain_steps s JOIN [[pieces_of]] p USING (package_id, surface_idx) WHERE i < len(p.ps)) w""")
cte("chains", """SELECT package_id, surface_idx, surface_name, c.members[1] AS head, c.value AS value, c.members[2:] AS rest
FROM (SELECT s.package_id, s.surface_idx, p.surface_name, unnest(s.cs) AS c FROM [[chain_steps]] s JOIN [[pieces_of]] p ON p.package_id = s.package_id AND p.surface_idx = s.surface_idx AND s.i = len(p.ps))
WHERE len(c.members) >= 2""")
check("vertical_chains", "SELECT package_id, surface_idx, CAST(len(rest) + 1 AS INT) AS members, value FROM [[chains]]")
cte("pool2", """SELECT p.*, coalesce(p.claimed0, CASE WHEN c.pos IS NOT NULL THEN 'vertical_chain' END) AS claimed
FROM [[pool1]] p LEFT JOIN (SELECT package_id, surface_idx, unnest(rest) AS pos FROM [[chains]]) c USING (package_id, surface_idx, pos)""")
_cont = lambda n: f"(lead(claimed, {n}) OVER w IS NULL AND (lead(t, {n}) OVER w LIKE '%,' OR {m(v.POINTER_CONTINUES, f'lead(t, {n}) OVER w')}))"
cte("ptr0", f"""SELECT *, concat_ws(' ', text, CASE WHEN {_cont(1)} THEN lead(t, 1) OVER w END, CASE WHEN {_cont(1)} AND {_cont(2)} THEN lead(t, 2) OVER w END) AS ptext
FROM [[pool2]] WINDOW w AS (PARTITION BY package_id, surface_idx ORDER BY pos)""")
cte("ptr", f"""SELECT package_id, surface_idx, surface_name, line_no, pos, text AS original_text, ptext,
  lower(coalesce({x(v.POINTER_OF, 1, 'ptext')}, {x(v.POINTER_ON, 1, 'ptext')}, {x(v.POINTER_PLACE, 1, 'ptext')}, 'base')) AS location,
  list_sort(list_filter([{', '.join(f"CASE WHEN {m(p, 'ptext')} THEN '{f}' END" for p, f in v.POINTER_HINTS)}], lambda f: f IS NOT NULL)) AS hints
FROM [[ptr0]] WHERE pointer""")
check("pointers", "SELECT package_id, surface_idx, original_text, ptext AS pointer_text FROM [[ptr]]")
check("pointer_hints", "SELECT package_id, surface_idx, location, array_to_string(hints, ',') AS hinted_fields FROM [[ptr]]")
cte("sig", """SELECT package_id, bool_or(n >= 3 AND spread <= 80) AS cyl FROM (SELECT package_id, surface_idx, count(*) AS n, max(x_min) - min(x_min) AS spread
  FROM [[ln]] WHERE regexp_matches(t, '^[0-9]{1,3}$') GROUP BY ALL) GROUP BY ALL""")
cte("cyl", f"""SELECT u.package_id, coalesce(s.cyl, false) OR coalesce(p.container, false) AS cylindrical, coalesce(p.base, false) AS cylindrical_package
FROM (SELECT DISTINCT package_id FROM [[use]]) u LEFT JOIN [[sig]] s USING (package_id)
LEFT JOIN (SELECT package_id, bool_or({m(v.POINTER_CONTAINER, 'ptext')}) AS container, bool_or(location IN {lst(v.BASE_PLACES)}) AS base FROM [[ptr]] GROUP BY ALL) p USING (package_id)""")
check("cylindrical", "SELECT package_id, cylindrical, cylindrical_package FROM [[cyl]]")

# merge over photos
cte("merged", f"""SELECT k.package_id, k.field, f.value, coalesce(f.ocr_text, '') AS ocr_text, coalesce(f.ocr_conf, 0.0) AS ocr_conf, coalesce(f.ext_conf, 0.0) AS ext_conf,
  coalesce(f.level, 'MISSING') AS level, f.x_min, f.y_min, f.x_max, f.y_max, f.surface_idx AS source_idx, f.surface_name AS source_name
FROM (SELECT DISTINCT package_id, unnest({list(v.FIELDS)}) AS field FROM [[use]]) k
LEFT JOIN (SELECT * FROM [[ufields]] WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY package_id, field ORDER BY ext_conf DESC, ocr_conf DESC, surface_idx) = 1) f
  USING (package_id, field)""")
_mc = "package_id, field, value, ocr_text, round(ocr_conf, 6) AS ocr_conf, round(ext_conf, 6) AS ext_conf, level, source_name"
check("fields_merged", f"SELECT {_mc} FROM [[merged]] WHERE package_id IN (SELECT package_id FROM [[ufields]])")
check("fields_complete", f"SELECT {_mc} FROM [[merged]] WHERE package_id IN (SELECT package_id FROM [[ufields]])")

# hand-out, one step per still-missing declaration
cte("cand", f"""SELECT row_number() OVER (PARTITION BY package_id ORDER BY late, surface_idx, pos, ko, n) AS i, * FROM (
  SELECT 0 AS late, c.package_id, c.surface_idx, c.surface_name, c.surface_usable, c.pos, c.text, c.confidence, c.base, c.x_min, c.y_min, c.x_max, c.y_max, ko, n, kind, value, norm, c.nutrition, p.claimed
  FROM [[cand0]] c JOIN [[pool2]] p USING (package_id, surface_idx, pos)
  UNION ALL SELECT 1, h.package_id, h.surface_idx, h.surface_name, p.surface_usable, h.head, p.text, p.confidence, true, p.x_min, p.y_min, p.x_max, p.y_max, 0, 0, 'code', h.value, h.value, false, p.claimed
  FROM [[chains]] h JOIN [[pool2]] p ON p.package_id = h.package_id AND p.surface_idx = h.surface_idx AND p.pos = h.head)""")
cte("anch", f"""SELECT package_id, {', '.join(f"regexp_matches(string_agg(text, ' | ' ORDER BY surface_idx, pos), '{p}', 'i') AS a_{f}" for f, p in v.LABEL_ANCHORS.items())}
FROM [[ln]] GROUP BY package_id""")
cte("phints", "SELECT package_id, list_distinct(flatten(list(hints))) AS hints FROM [[ptr]] GROUP BY package_id")
cte("as_0", "SELECT NULL::BIGINT AS package_id, NULL::INT AS surface_idx, NULL::BIGINT AS pos, NULL::VARCHAR AS field, NULL::VARCHAR AS value, NULL::VARCHAR AS text, NULL::DOUBLE AS confidence, NULL::VARCHAR AS surface_name, NULL::VARCHAR AS gate, NULL::INT AS x_min, NULL::INT AS y_min, NULL::INT AS x_max, NULL::INT AS y_max WHERE false")
for _n, (_f, _k) in enumerate(v.FIELD_KINDS, 1):
    _kinds = "('phone', 'email')" if _k == "contact" else f"('{_k}')"
    _more = " AND NOT c.nutrition" if _k == "quantity" else ""
    if _k == "date":
        _more = f" AND NOT {m(v.DATE_TEXT_MADE if _f == 'best_before' else v.DATE_TEXT_USE_BY, 'c.text')}"
    _ptr = f"coalesce(list_contains(h.hints, '{_f}'), false)"
    _base = f"(y.cylindrical AND bool_or(c.base) OVER (PARTITION BY c.package_id))" if _f in v.BASE_FIELDS else "false"
    _anc = f"a.a_{_f}" if _f in v.ANCHOR_FIELDS else "false"
    cte(f"el_{_n}", f"""SELECT c.*, {_ptr} AS g_ptr, {_base} AS g_base, {_anc} AS g_anc FROM [[cand]] c JOIN [[merged]] mm ON mm.package_id = c.package_id AND mm.field = '{_f}' AND mm.value IS NULL
      JOIN [[anch]] a ON a.package_id = c.package_id JOIN [[cyl]] y ON y.package_id = c.package_id LEFT JOIN [[phints]] h ON h.package_id = c.package_id
      WHERE c.claimed IS NULL AND c.surface_usable AND c.kind IN {_kinds}{_more}
        AND NOT EXISTS (SELECT 1 FROM [[as_{_n - 1}]] d WHERE d.package_id = c.package_id AND d.surface_idx = c.surface_idx AND d.pos = c.pos)""")
    cte(f"as_{_n}", f"""SELECT * FROM [[as_{_n - 1}]] UNION ALL
      SELECT package_id, surface_idx, pos, '{_f}', norm, text, confidence, surface_name, CASE WHEN g_ptr THEN 'pointer' WHEN g_base THEN 'base' ELSE 'anchor' END, x_min, y_min, x_max, y_max FROM (
        SELECT * FROM [[el_{_n}]] WHERE (g_ptr OR g_base OR g_anc) AND (base OR NOT g_base OR g_ptr)
        QUALIFY row_number() OVER (PARTITION BY package_id ORDER BY confidence DESC, kind = 'email', i) = 1) WHERE norm IS NOT NULL""")
_last = f"as_{len(v.FIELD_KINDS)}"
check("field_association", f"SELECT package_id, field, value, surface_name AS source_name, gate, round(least(confidence, 0.65), 6) AS ext_conf FROM [[{_last}]]")
check("unclaimed_evidence", f"""SELECT package_id, surface_idx, text, kind, value FROM [[cand]] c WHERE claimed IS NULL
  AND NOT EXISTS (SELECT 1 FROM [[{_last}]] d WHERE d.package_id = c.package_id AND d.surface_idx = c.surface_idx AND d.pos = c.pos)""")
cte("fin0", f"""SELECT m.package_id, m.field, coalesce(m.value, a.value) AS value, coalesce(a.text, m.ocr_text) AS ocr_text, coalesce(a.confidence, m.ocr_conf) AS ocr_conf,
  CASE WHEN a.field IS NOT NULL THEN least(a.confidence, 0.65::DOUBLE) ELSE m.ext_conf END AS ext_conf, CASE WHEN a.field IS NOT NULL THEN 'LOW' ELSE m.level END AS level,
  coalesce(a.x_min, m.x_min) AS x_min, coalesce(a.y_min, m.y_min) AS y_min, coalesce(a.x_max, m.x_max) AS x_max, coalesce(a.y_max, m.y_max) AS y_max,
  coalesce(a.surface_idx, m.source_idx) AS source_idx, coalesce(a.surface_name, m.source_name) AS source_name
FROM [[merged]] m LEFT JOIN [[{_last}]] a USING (package_id, field)""")
cte("ad_0", "SELECT NULL::BIGINT AS package_id, NULL::VARCHAR AS field, NULL::INT AS surface_idx, NULL::BIGINT AS pos, NULL::VARCHAR AS text WHERE false")
for _n, _f in enumerate(v.ENTITY_FIELDS, 1):
    cte(f"ad_{_n}", f"""SELECT * FROM [[ad_{_n - 1}]] UNION ALL SELECT f.package_id, f.field, p.surface_idx, p.pos, p.text FROM [[fin0]] f JOIN [[pool2]] p
      ON p.package_id = f.package_id AND p.surface_idx = f.source_idx WHERE f.field = '{_f}' AND f.value IS NOT NULL AND p.address AND p.claimed IS NULL
      AND greatest(0, greatest(f.y_min, p.y_min) - least(f.y_max, p.y_max)) <= 220 AND greatest(0, greatest(f.x_min, p.x_min) - least(f.x_max, p.x_max)) <= 160
      AND NOT EXISTS (SELECT 1 FROM [[{_last}]] d WHERE d.package_id = p.package_id AND d.surface_idx = p.surface_idx AND d.pos = p.pos)
      AND NOT EXISTS (SELECT 1 FROM [[ad_{_n - 1}]] d WHERE d.package_id = p.package_id AND d.surface_idx = p.surface_idx AND d.pos = p.pos)
      QUALIFY row_number() OVER (PARTITION BY f.package_id ORDER BY p.pos) = 1""")
cte("final", f"""SELECT f.*, CASE WHEN f.field IN {lst(v.ENTITY_FIELDS)} AND f.value IS NOT NULL THEN a.field IS NOT NULL END AS address_detected, a.text AS address_text
FROM [[fin0]] f LEFT JOIN [[ad_3]] a USING (package_id, field)""")
check("entity_address", f"SELECT package_id, field, value, address_detected, address_text FROM [[final]] WHERE field IN {lst(v.ENTITY_FIELDS)} AND value IS NOT NULL")
check("evidence_run", """SELECT f.package_id, f.field, f.value, f.level, round(f.ext_conf, 6) AS ext_conf, f.source_name, f.address_detected, y.cylindrical_package
FROM [[final]] f JOIN [[cyl]] y USING (package_id)""")
check("conf_level", "SELECT package_id, surface_idx, line_no, CASE WHEN confidence >= 0.85 THEN 'HIGH' WHEN confidence >= 0.70 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM [[lines]]")
