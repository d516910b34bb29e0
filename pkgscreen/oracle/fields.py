"""Checks for extraction, written as joins of line rows."""

from __future__ import annotations

from pkgscreen import vocab as v
from pkgscreen.oracle.base import check, cte, lst, m, strip, words, x

cte("ln", f"""SELECT *, row_number() OVER (PARTITION BY package_id, surface_idx ORDER BY line_no) - 1 AS pos,
  {strip()} AS t FROM [[lines]]""")
cte("surf", "SELECT DISTINCT package_id, surface_idx, surface_name FROM [[lines]]")

NUTR = m(v.REJECT["nutrition"])
REJ = "(" + " OR ".join(m(p, "t") for p in v.REJECT.values()) + ")"
ON = "a.package_id = b.package_id AND a.surface_idx = b.surface_idx"
OVER = ("greatest(0, (least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min)) / "
        "CAST(least(greatest(1, a.y_max - a.y_min), greatest(1, b.y_max - b.y_min)) AS DOUBLE))")
DIST = ("sqrt(pow((a.x_min + a.x_max) / 2.0 - (b.x_min + b.x_max) / 2.0, 2) + "
        "pow((a.y_min + a.y_max) / 2.0 - (b.y_min + b.y_max) / 2.0, 2))")
BOTH, WEAK = "a.text || ' | ' || b.text", "least(a.confidence, b.confidence)"


def price_ok(val: str) -> str:
    return (f"({val} IS NOT NULL AND CAST({val} AS DOUBLE) BETWEEN 1 AND 50000 AND NOT {NUTR}"
            f" AND NOT ({m(v.PRICE_LONG_NUMBER)} AND NOT {m(v.PRICE_WORD)})"
            f" AND NOT ({m(v.PRICE_UNIT_SUFFIX)} AND NOT {m(v.PRICE_WORD)}))")


def cand(r, value, level, cap, line, conf=None, seen=None, idx=None, box=None):
    r = list(r) + ["0"] * (5 - len(r))
    conf = conf or f"{line}.confidence"
    box = box or line
    return (f"{line}.package_id, {line}.surface_idx, CAST({r[0]} AS INT) AS r1, CAST({r[1]} AS INT) AS r2, CAST({r[2]} AS INT) AS r3,"
            f" CAST({r[3]} AS DOUBLE) AS r4, CAST({r[4]} AS INT) AS r5, {value} AS value, {seen or line + '.text'} AS ocr_text,"
            f" {conf} AS ocr_conf, least({conf}, {cap}::DOUBLE) AS ext_conf, '{level}' AS level, {idx or line + '.pos'} AS line_idx,"
            f" {box}.x_min, {box}.y_min, {box}.x_max, {box}.y_max")


def field(name: str, cands: list[str]) -> None:
    union = "\nUNION ALL ".join(cands)
    cte(f"c_{name}", union)
    cte(f"f_{name}", f"""SELECT s.package_id, s.surface_idx, s.surface_name, '{name}' AS field, c.value, coalesce(c.ocr_text, '') AS ocr_text,
  coalesce(c.ocr_conf, 0.0) AS ocr_conf, coalesce(c.ext_conf, 0.0) AS ext_conf, coalesce(c.level, 'MISSING') AS level,
  CAST(coalesce(c.line_idx, -1) AS INT) AS line_idx, c.x_min, c.y_min, c.x_max, c.y_max
FROM [[surf]] s LEFT JOIN (SELECT * FROM [[c_{name}]] QUALIFY row_number() OVER (
  PARTITION BY package_id, surface_idx ORDER BY r1, r2, r3, r4, r5) = 1) c USING (package_id, surface_idx)""")


# price
cte("p_mrp", f"""SELECT *, {m(v.MRP_KEYWORD)} AS kw, {x(v.PRICE_VALUE)} AS price, {price_ok(x(v.PRICE_VALUE))} AS ok,
  CASE WHEN {m('rs')} THEN 'Rs.' ELSE '₹' END AS cur, {m(v.PRICE_NEIGHBOUR_SKIP)} AS skip, {m(v.PRICE_TAX)} AS tax,
  CASE WHEN {m(v.PRICE_ODD_START)} AND {price_ok(x(v.PRICE_ODD))} THEN {x(v.PRICE_ODD)} END AS odd FROM [[ln]]""")
field("mrp", [
    f"SELECT {cand(['1', 'a.pos'], 'a.cur || a.price', 'HIGH', .95, 'a')} FROM [[p_mrp]] a WHERE a.kw AND a.ok",
    f"SELECT {cand(['1', 'a.pos', '1', '0', 'b.pos'], 'b.cur || b.price', 'MEDIUM', .85, 'a', WEAK, BOTH)} FROM [[p_mrp]] a JOIN [[p_mrp]] b ON {ON} AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 AND b.pos <> a.pos WHERE a.kw AND b.ok AND NOT b.skip",
    f"SELECT {cand(['2', 'a.pos', '0', '0', 'b.pos'], chr(39) + '₹' + chr(39) + ' || b.price', 'MEDIUM', .80, 'b')} FROM [[p_mrp]] a JOIN [[p_mrp]] b ON {ON} AND b.pos BETWEEN a.pos - 3 AND a.pos + 2 WHERE a.tax AND b.ok",
    f"SELECT {cand(['3', 'a.pos'], chr(39) + '₹' + chr(39) + ' || a.odd', 'MEDIUM', .85, 'a')} FROM [[p_mrp]] a WHERE a.odd IS NOT NULL",
])

# quantity
NW = words(v.QTY_NUTRITION_WORDS)
cte("p_qty", f"""SELECT *, {m(v.QTY_LABEL)} AS lab, coalesce({x(v.QTY_VALUE, 0)}, {x(v.QTY_VALUE_SHORT, 0)}) AS qty, {x(v.QTY_VALUE)} AS n1,
  {x(v.QTY_VALUE, 0)} AS q1, {x(v.QTY_VALUE_SHORT)} AS n2, {x(v.QTY_VALUE_SHORT, 0)} AS q2, {m(v.QTY_WORD)} AS w, {m(v.QTY_NUTRITION_ROW)} AS nrow,
  regexp_matches(lower(string_agg(text, ' ') OVER (PARTITION BY package_id, surface_idx ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)), '{NW}') AS n_1,
  regexp_matches(lower(string_agg(text, ' ') OVER (PARTITION BY package_id, surface_idx ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), '{NW}') AS n_2
FROM [[ln]]""")
ALONE = "CASE WHEN a.q1 IS NOT NULL AND (CAST(a.n1 AS DOUBLE) >= 20 OR a.w) THEN a.q1 WHEN a.q2 IS NOT NULL AND (CAST(a.n2 AS DOUBLE) >= 20 OR a.w) THEN a.q2 END"
field("net_quantity", [
    f"SELECT {cand(['1', 'a.pos'], 'a.qty', 'HIGH', .95, 'a')} FROM [[p_qty]] a WHERE a.lab AND a.qty IS NOT NULL",
    f"SELECT {cand(['1', 'a.pos', '1', '0', 'b.pos'], 'b.qty', 'MEDIUM', .85, 'a', WEAK, BOTH)} FROM [[p_qty]] a JOIN [[p_qty]] b ON {ON} AND b.pos BETWEEN a.pos - 1 AND a.pos + 3 AND b.pos <> a.pos WHERE a.lab AND b.qty IS NOT NULL AND NOT b.n_1",
    f"SELECT {cand(['2', '-a.pos'], ALONE, 'LOW', .70, 'a')} FROM [[p_qty]] a WHERE NOT a.n_2 AND NOT a.nrow AND {ALONE} IS NOT NULL",
])

# entities
COMPANY = lambda c: f"({m(words(v.COMPANY_WORDS), c)} AND NOT {m(words(v.COMPANY_NUTRITION_WORDS), c)})"
cte("p_ent", f"""SELECT *, {COMPANY('text')} AS comp, ({m(v.ENTITY_REJECT)} OR {m(v.ENTITY_NUTRITION)}) AS rej,
  lead(CASE WHEN {m(v.NAME_CONTINUATION, 't')} THEN t END) OVER (PARTITION BY package_id, surface_idx ORDER BY pos) AS cont FROM [[ln]]""")
for kind, kws in v.ENTITY_KEYWORDS.items():
    same = "\nUNION ALL ".join(
        f"SELECT *, {n} AS kw, trim(regexp_replace(text, '{k}', '', 'gi'), ':.,; ') AS rest FROM [[p_ent]] WHERE {m(k)}"
        for n, k in enumerate(kws))
    cte(f"k_{kind}", same)
    kw = m("|".join(kws), "a.text")
    nxt = lambda lo, hi, cond, stage, cap, level, val: (
        f"SELECT {cand(['1', 'a.pos', '(SELECT min(kw) FROM [[k_%s]] z WHERE z.package_id = a.package_id AND z.surface_idx = a.surface_idx AND z.pos = a.pos) * 10 + %d' % (kind, stage), '0', 'b.pos'], val, level, cap, 'a', WEAK, chr(39).join(['a.text || ', ' | ', ' || ' + val]))}"
        f" FROM [[p_ent]] a JOIN [[p_ent]] b ON {ON} AND b.pos BETWEEN a.pos + {lo} AND a.pos + {hi} WHERE {kw} AND {cond}")
    val = "b.text || coalesce(' ' || b.cont, '')"
    field(kind, [
        f"SELECT {cand(['1', 'a.pos', 'a.kw * 10'], 'a.rest', 'HIGH', .90, 'a')} FROM [[k_{kind}]] a WHERE length(a.rest) >= 5 AND {COMPANY('a.rest')}",
        nxt(1, 3, "b.comp AND NOT b.rej", 1, .90, "HIGH", val),
        nxt(4, 10, "b.comp AND NOT b.rej", 2, .85, "MEDIUM", val),
        nxt(1, 4, "NOT b.rej", 3, .75, "MEDIUM", "b.text"),
    ])

# dates
cte("p_date", f"""SELECT *, coalesce({', '.join(x(p) for p in v.DATE_VALUES)}) AS d, {m(words(v.DATE_ADDRESS_WORDS))} AS addr,
  {x(v.DATE_EMBEDDED_CS, cs=True)} AS emb, {m(v.DATE_BATCH_LINE)} AND NOT {m(v.INSTRUCTION)} AS bl,
  {', '.join(f"{m(p)} AS l_{n}, {m(v.DATE_OTHER_LABELS[n])} AS o_{n}" for n, p in v.DATE_LABELS.items())} FROM [[ln]]""")
for name in v.DATE_LABELS:
    usable = f"b.pos <> a.pos AND NOT b.o_{name} AND b.d IS NOT NULL AND NOT b.addr"
    claimed = f"EXISTS (SELECT 1 FROM [[p_date]] o WHERE o.package_id = b.package_id AND o.surface_idx = b.surface_idx AND o.pos <> b.pos AND o.o_{name} AND {OVER.replace('a.', 'o.')} >= 0.2)"
    cands = [
        f"SELECT {cand(['1', 'a.pos'], 'a.d', 'HIGH', .95, 'a')} FROM [[p_date]] a WHERE a.l_{name} AND a.d IS NOT NULL",
        f"SELECT {cand(['1', 'a.pos', '1', DIST, 'b.pos'], 'b.d', 'MEDIUM', .85, 'b', WEAK, BOTH)} FROM [[p_date]] a JOIN [[p_date]] b ON {ON} WHERE a.l_{name} AND {usable} AND {OVER} >= 0.2",
        f"SELECT {cand(['1', 'a.pos', '2', '0', 'b.pos'], 'b.d', 'MEDIUM', .85, 'b', WEAK, BOTH)} FROM [[p_date]] a JOIN [[p_date]] b ON {ON} AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 WHERE a.l_{name} AND {usable} AND NOT {claimed}",
    ]
    if name != "best_before":
        cands.append(f"SELECT {cand(['2', 'a.pos', '0', '0', 'b.pos'], 'b.emb', 'LOW', .75, 'b')} FROM [[p_date]] a JOIN [[p_date]] b ON {ON} AND b.pos BETWEEN a.pos - 1 AND a.pos + 3 WHERE a.bl AND NOT b.addr AND b.emb IS NOT NULL")
    field(name, cands)

# batch


def batch_ok(c: str) -> str:
    return f"(length({c}) >= 2 AND lower({c}) NOT IN {lst(v.BATCH_NOT_CODES)} AND NOT (regexp_matches({c}, '^[0-9]+$') AND length({c}) < 4))"


B = [x(p) for p in v.BATCH_VALUES]
cte("p_batch", f"""SELECT *, NOT {m(v.INSTRUCTION)} AND coalesce({', '.join(B)}) IS NOT NULL AS lab,
  CASE WHEN NOT {m(v.INSTRUCTION)} THEN coalesce({', '.join(f"CASE WHEN {batch_ok(b)} THEN {b} END" for b in B)}) END AS val,
  regexp_matches(t, '{v.BATCH_SHAPE_CS}') AND NOT {m('lic|fssai|pin', 't')} AND NOT {m(v.BATCH_QTY, 't')} AND NOT regexp_matches(t, '{v.BATCH_DATE_CS}')
    AND NOT {m(v.BATCH_NUTRITION, 't')} AND NOT {REJ} AND {batch_ok('t')} AS code FROM [[ln]]""")
_pair = f"FROM [[p_batch]] a JOIN [[p_batch]] b ON {ON} AND b.pos BETWEEN a.pos - 4 AND a.pos + 4 AND b.pos <> a.pos WHERE a.lab AND b.code"
field("batch_number", [
    f"SELECT {cand(['1', 'a.pos'], 'a.val', 'HIGH', .90, 'a')} FROM [[p_batch]] a WHERE a.val IS NOT NULL",
    f"SELECT {cand(['2', 'a.pos', '0', DIST, 'b.pos'], 'b.t', 'MEDIUM', .85, 'b', WEAK, BOTH)} {_pair} AND {OVER} >= 0.2",
    f"SELECT {cand(['2', 'a.pos', '1', DIST, 'b.pos'], 'b.t', 'LOW', .70, 'b', WEAK, BOTH)} {_pair} AND {OVER} < 0.2",
])

# consumer care
_near = "OVER (PARTITION BY package_id, surface_idx ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)"
cte("p_care", f"""SELECT *, {m(words(v.CARE_WORDS))} AS kw, string_agg(text, ' | ') {_near} AS ctx, {x(v.EMAIL_CS, 0, cs=True)} AS mail FROM [[ln]]""")
cte("p_care2", f"SELECT *, {x(v.CARE_PHONE_CS, 0, 'ctx', True)} AS ph, {x(v.EMAIL_CS, 0, 'ctx', True)} AS em FROM [[p_care]]")
field("consumer_care", [
    f"SELECT {cand(['1', '0', '0', '-a.confidence', 'a.pos'], 'concat_ws(%s, %s || a.ph, %s || a.em)' % (repr(' | '), repr('Phone: '), repr('Email: ')), 'HIGH', .90, 'a', seen='a.ctx')} FROM [[p_care2]] a WHERE a.kw AND coalesce(a.ph, a.em) IS NOT NULL AND a.confidence > 0",
    f"SELECT {cand(['2', 'a.pos'], repr('Email: ') + ' || a.mail', 'MEDIUM', .75, 'a')} FROM [[p_care2]] a WHERE a.mail IS NOT NULL AND (lower(split_part(a.mail, '@', 1)) IN {lst(v.CARE_LOCAL_PARTS)} OR {m(words(v.CARE_DOMAIN_WORDS), 'split_part(a.mail, ' + repr('@') + ', 2)')})",
])

# origin
O = [strip(x(p)) for p in v.ORIGIN_VALUES]
_valid = ", ".join(f"CASE WHEN {m(words(v.ORIGIN_COUNTRIES), o)} THEN {o} END" for o in O)
cte("p_origin", f"SELECT *, coalesce({_valid}) AS o FROM [[ln]]")
field("country_of_origin", [f"SELECT {cand(['1', 'a.pos'], 'a.o', 'HIGH', .90, 'a')} FROM [[p_origin]] a WHERE a.o IS NOT NULL"])

# product name and brand
TM = r"[™®©]|\((?i:tm|r|c)\)|[A-Za-z]\s?TM\b"


def clean(c: str) -> str:
    gone = f"regexp_replace(regexp_replace({c}, '[™®©]|\\((?i:tm|r|c)\\)', '', 'g'), '([A-Za-z])\\s?TM\\b', '\\1', 'g')"
    return f"trim({strip(gone)}, ' :-–—.,')"


SHARE = "length(regexp_replace(t, '[^\\p{L}]', '', 'g')) / CAST(greatest(1, length(replace(t, ' ', ''))) AS DOUBLE)"
AREA = "(greatest(1, y_max - y_min) * greatest(1, x_max - x_min))"
cte("p_name", f"""SELECT *, {clean('text')} AS cl, {clean('t')} AS clt, {m(v.BRAND_LABEL)} AS lab,
  {clean(f"regexp_extract(text, '{v.BRAND_LABEL}', 1, 'i')")} AS bval, regexp_matches(t, '{TM}') AS tm,
  CASE WHEN length(t) BETWEEN 3 AND 40 AND confidence >= 0.80 AND NOT (contains(t, '(') AND contains(t, ')')) AND NOT {m(v.NAME_SKIP, 't')}
    AND NOT {m(v.ENTITY_SUFFIX, 't')} AND {SHARE} >= 0.6 THEN {AREA} * confidence * least(1.0, length(t) / 6.0::DOUBLE) END AS nscore,
  CASE WHEN length(t) BETWEEN 2 AND 30 AND confidence >= 0.85 AND NOT {m(v.BRAND_SKIP, 't')} AND NOT {m(v.ENTITY_SUFFIX, 't')} AND NOT {REJ}
    AND length(regexp_replace(t, '[^ ]+', '', 'g')) <= 2 AND {SHARE} >= 0.8
    AND ((t = upper(t) AND t <> lower(t)) OR (NOT regexp_matches(t, '(^|[^\\p{{L}}])\\p{{Ll}}') AND NOT regexp_matches(t, '\\p{{L}}\\p{{Lu}}')))
    THEN {AREA} * confidence END AS bscore FROM [[ln]]""")
cte("b_high", f"""SELECT * FROM (
  SELECT {cand(['1', 'a.pos'], 'a.bval', 'HIGH', .92, 'a')} FROM [[p_name]] a WHERE a.lab AND length(a.bval) BETWEEN 2 AND 40
  UNION ALL SELECT {cand(['1', 'a.pos'], 'b.cl', 'HIGH', .90, 'b', WEAK, BOTH)} FROM [[p_name]] a JOIN [[p_name]] b ON {ON} AND b.pos = a.pos + 1 WHERE a.lab AND a.bval = '' AND length(b.cl) BETWEEN 2 AND 40
  UNION ALL SELECT {cand(['2', 'a.pos'], 'a.clt', 'HIGH', .88, 'a')} FROM [[p_name]] a WHERE a.tm AND length(a.clt) BETWEEN 2 AND 40 AND NOT {m(v.BRAND_SKIP, 'a.clt')}
) QUALIFY row_number() OVER (PARTITION BY package_id, surface_idx ORDER BY r1, r2) = 1""")
field("product_name", [f"SELECT {cand(['1', '0', '0', '-a.nscore', 'a.pos'], 'a.t', 'MEDIUM', .75, 'a')} FROM [[p_name]] a LEFT JOIN [[b_high]] h ON h.package_id = a.package_id AND h.surface_idx = a.surface_idx WHERE a.nscore IS NOT NULL AND a.pos <> coalesce(h.line_idx, -1)"])
field("brand", [
    "SELECT package_id, surface_idx, r1, r2, r3, r4, r5, value, ocr_text, ocr_conf, ext_conf, level, line_idx, x_min, y_min, x_max, y_max FROM [[b_high]]",
    f"SELECT {cand(['3', '0', '0', '-a.bscore', 'a.pos'], 'a.t', 'LOW', .62, 'a')} FROM [[p_name]] a JOIN [[f_product_name]] n ON n.package_id = a.package_id AND n.surface_idx = a.surface_idx WHERE a.bscore IS NOT NULL AND a.pos <> n.line_idx",
])

_COLS = "package_id, surface_idx, field, value, ocr_text, round(ocr_conf, 6) AS ocr_conf, round(ext_conf, 6) AS ext_conf, level, line_idx"
KEYS = {
    "field_mrp": ["mrp"], "field_net_quantity": ["net_quantity"], "field_entity": v.ENTITY_FIELDS,
    "field_dates": list(v.DATE_LABELS), "field_batch": ["batch_number"], "field_consumer_care": ["consumer_care"],
    "field_origin": ["country_of_origin"], "field_product_name": ["product_name"], "field_brand": ["brand"],
}
for key, names in KEYS.items():
    check(key, "\nUNION ALL ".join(f"SELECT {_COLS} FROM [[f_{n}]]" for n in names))
cte("fields", "\nUNION ALL ".join(f"SELECT * FROM [[f_{n}]]" for n in v.FIELDS))
check("fields_all", f"SELECT {_COLS}, x_min, y_min, x_max, y_max FROM [[fields]]")

check("line_reject_tags", "SELECT package_id, surface_idx, line_no, "
      + ", ".join(f"{m(p)} AS is_{k}" for k, p in v.REJECT.items()) + " FROM [[lines]]")
check("line_neighbours", """SELECT a.package_id, a.surface_idx, a.line_no, CAST(b.pos - a.pos AS INT) AS distance, b.line_no AS near_line_no, b.text AS near_text
FROM [[ln]] a JOIN [[ln]] b ON a.package_id = b.package_id AND a.surface_idx = b.surface_idx AND b.pos BETWEEN a.pos - 3 AND a.pos + 3 AND b.pos <> a.pos""")
check("bbox_geometry", f"""SELECT a.package_id, a.surface_idx, a.line_no, b.line_no AS next_line_no, round({DIST}, 6) AS distance, round({OVER}, 6) AS overlap
FROM [[ln]] a JOIN [[ln]] b ON {ON} AND b.pos = a.pos + 1""")
