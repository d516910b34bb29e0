"""Evidence of a package: every line, what it could mean, and who may use it.

Works on the photo rows of :func:`extract.by_surface` with ``fields`` and
``usable`` beside the lines. Photos become packages without another exchange;
the ordered hand-out of candidates to missing declarations is a fold over a
fixed list of eleven names inside the package row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgscreen import vocab as v
from pkgscreen.config import DEFAULT, Thresholds
from pkgscreen.functions import geometry as g
from pkgscreen.functions.text import has, may_hold, needed, pick, strip_of

_T = "l.stripped"
_BOX = ["x_min", "y_min", "x_max", "y_max"]
_has = lambda p, col="text", cs=False: f"({may_hold(p, 'lowered')} AND {has(p, col, cs)})" if needed(p) else has(p, col, cs)  # noqa: E731  of a line's text, where ``lowered`` stands beside it
_y = lambda e: f"coalesce({e}.y_min, 0)"


def _near_text(line: str, over: str, dist: int) -> str:
    return (f"array_join(transform(filter({over}, o -> o.pos <> {line}.pos AND abs({_y('o')} - {_y(line)}) < {dist}),"
            f" o -> o.text), ' ')")


NUTRITION = f"(concat_ws(' ', l.text, {_near_text('l', 'lines', 80)}) RLIKE r'(?i){v.CAND_NUTRITION}')"
NEAR_ADDRESS = f"exists(lines, o -> o.pos <> l.pos AND abs({_y('o')} - {_y('l')}) < 100 AND o.near_strong)"
BASE_REGION = "(surface_height > 0 AND " + _y("l") + " >= surface_height * {share}D)"
IS_ADDRESS = f"(l.address_text OR (l.pin AND {NEAR_ADDRESS}))"
_S = "stripped"
IS_ENTITY = (f"(length({_S}) BETWEEN 4 AND 60 AND NOT {_has(v.CAND_LICENCE, _S)} AND NOT {_has(v.CAND_ENTITY_POINTER, _S)}"
             f" AND {_has(v.CAND_COMPANY, _S)})")
_DATE = "coalesce(" + ", ".join(pick(p, 1, _S, cs=True) for p in v.CAND_DATES_CS) + ")"
CODE_TEXT = (f"({_has(v.CAND_CODE_CS, _S, True)} AND {_has('[0-9]', _S)} AND NOT {_has(v.CAND_LICENCE, _S)} AND {_DATE} IS NULL"
             f" AND NOT {_has(v.CAND_CURRENCY, _S)} AND NOT {_has(v.CAND_QUANTITY, _S)})")
IS_CODE = f"(l.code_text AND NOT (l.pin AND {NEAR_ADDRESS}) AND NOT {NUTRITION})"
_COUNTRIES = "array(" + ", ".join(f"'{c}'" for c in v.CAND_COUNTRIES) + ")"
_COUNTRY = (f"get({_COUNTRIES}, array_min(transform(regexp_extract_all({_S}, r'(?i)\\b({'|'.join(v.CAND_COUNTRIES)})\\b', 1),"
            f" c -> CAST(array_position({_COUNTRIES}, lower(c)) AS INT))) - 1)")
IS_POINTER = f"({_has(v.POINTER_OF, _S)} OR {_has(v.POINTER_ON, _S)} OR {_has(v.POINTER_PLACE, _S)})"
_PREFIX = f"regexp_replace({{}}, r'(?i){v.ENTITY_LABEL_PREFIX}', '')"


def entity_value(col: str) -> str:
    """A name without its label words, which may be stacked up to three deep."""
    for _ in range(3):
        col = strip_of(_PREFIX.format(col), ":.,;- ")
    return f"nullif({col}, '')"


def _cand(kind: str, value: str, norm: str | None = None, nutrition: str = "false") -> str:
    return f"named_struct('kind', '{kind}', 'value', {value}, 'norm', {norm or value}, 'nutrition', {nutrition})"


def _when(test: str, cand: str) -> str:
    """A list of one candidate, or of none; not ``array_compact``, under which nothing is compiled."""
    return f"CASE WHEN {test} THEN array({cand}) ELSE array() END"


def _names_first(col: str) -> str:
    """Strip label words only where the line holds a name at all."""
    out = col
    for _ in range(3):
        out = strip_of(_PREFIX.format(out), ":.,;- ")
    return f"CASE WHEN {out} <> '' THEN {out} END"


_PRICED = f"regexp_extract_all({_S}, r'(?i){v.CAND_CURRENCY}', 0)"
_WEAK = f"regexp_extract_all({_S}, r'(?i){v.ADDRESS_WEAK}', 0)"
_PHONE, _MAIL = pick(v.CAND_PHONE_CS, 0, _S, cs=True), pick(v.EMAIL_CS, 0, _S, cs=True)
# what a text says wherever it stands; ``by_surface`` takes it once per text
POOL_FACTS: dict[str, str] = {
    "near_strong": _has(v.ADDRESS_STRONG),
    "address_text": f"({_has(v.ADDRESS_STRONG, _S)} OR ({may_hold(v.ADDRESS_WEAK, 'lowered')} AND size({_WEAK}) >= 2 AND size(array_distinct(transform({_WEAK}, w -> lower(w)))) >= 2))",
    "pin": _has("^[0-9]{6}$", _S),
    "code_text": CODE_TEXT,
    "amounts": f"regexp_extract_all({_S}, r'(?i){v.CAND_QUANTITY}', 0)",
    # the candidates that do not depend on the lines around, in the order of their kinds
    "ready": "concat(" + ", ".join([
        f"CASE WHEN size({_PRICED}) = 0 THEN array() ELSE transform({_PRICED}, x -> {_cand('currency', 'x', chr(39) + '₹' + chr(39) + ' || ' + pick(v.CAND_CURRENCY, 1))}) END",
        _when(f"{_DATE} IS NOT NULL", _cand("date", _DATE)),
        _when(f"{_PHONE} IS NOT NULL AND NOT {_has(v.CAND_LICENCE, _S)} AND NOT {_has(v.CAND_STANDARD_MARK, _S)}", _cand("phone", _PHONE, f"'Phone: ' || {_PHONE}")),
        _when(f"{_MAIL} IS NOT NULL", _cand("email", _MAIL, f"'Email: ' || {_MAIL}")),
        _when(IS_ENTITY, _cand("entity", _S, _names_first(_S))),
        _when(f"{_COUNTRY} IS NOT NULL", _cand("country", f"initcap({_COUNTRY})")), _when(IS_POINTER, _cand("pointer", _S))]) + ")",
}
_of = lambda *kinds: f"filter(l.ready, c -> c.kind IN ({', '.join(repr(k) for k in kinds)}))"
CANDIDATES = (
    "CASE WHEN l.stripped = '' THEN array() WHEN size(l.amounts) = 0 AND NOT l.address_text AND NOT l.pin AND NOT l.code_text THEN l.ready"
    f" ELSE concat({_of('currency')}, transform(l.amounts, x -> {_cand('quantity', 'x', None, NUTRITION)}), {_of('date', 'phone', 'email')}, "
    f"{_when(IS_ADDRESS, _cand('address', _T))}, {_of('entity')}, {_when(IS_CODE, _cand('code', _T))}, {_of('country', 'pointer')}) END")


def with_pool(photos: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Photos with ``pool``: every line with its claim, place and candidates.

    A line read by several declarations belongs to the last of them. Unusable
    photos keep their lines, flagged. The lines carry ``POOL_FACTS``.
    """
    if "usable" not in photos.columns:
        photos = photos.withColumn("usable", F.lit(True))
    claimed = "CAST(NULL AS STRING)"
    if "fields" in photos.columns:
        photos = photos.withColumn("_read", F.expr("reverse(filter(fields, f -> f.value IS NOT NULL))"))
        claimed = "get(_read, CAST(array_position(_read.line_idx, l.pos) AS INT) - 1).field"
    same = ", ".join(f"'{n}', l.{n}" for n in ["pos", "line_no", "text", "stripped", "confidence", *_BOX])
    line = f"named_struct({same}, 'claimed', {claimed}, 'base', {BASE_REGION.format(share=t.base_region)}, 'address', {IS_ADDRESS}, 'cands', {CANDIDATES})"
    return (photos
            .withColumn("surface_height", F.expr("coalesce(array_max(transform(lines, l -> coalesce(l.y_max, 0))), 0)"))
            .withColumn("pool", F.expr(f"transform(lines, l -> {line})")).drop("_read"))


def build_pool(photos: DataFrame) -> DataFrame:
    """Long form: one row per line."""
    return photos.selectExpr("package_id", "surface_idx", "surface_name", "usable AS surface_usable", "inline(pool)")


def detect(photos: DataFrame) -> DataFrame:
    """Long form: one row per candidate, in the order they are met."""
    return (photos.selectExpr("package_id", "surface_idx", "surface_name", "usable AS surface_usable", "explode(pool) AS l")
            .selectExpr("package_id", "surface_idx", "surface_name", "surface_usable", "l.line_no", "l.pos", "l.text", "l.confidence",
                        "l.base AS in_base_region", "l.claimed", "posexplode(l.cands) AS (cand_no, c)")
            .selectExpr("*", "c.kind", "c.value", "c.norm", "c.nutrition").drop("c"))


def nutrition_context(photos: DataFrame) -> DataFrame:
    return photos.selectExpr("package_id", "surface_idx", f"inline(transform(lines, l -> named_struct('line_no', l.line_no, 'nutrition', {NUTRITION})))")


def with_chains(photos: DataFrame) -> DataFrame:
    """Photos with ``chains``: digit pieces stacked in one column, read as one code.

    Pieces come in (x, y) order; each joins the first chain that accepts it: at
    most 40 px from its head, and below its last piece by less than 90 px.
    """
    pieces = ("array_sort(transform(filter(pool, e -> e.claimed IS NULL AND usable AND e.stripped RLIKE r'^[0-9]{1,8}$'),"
              " e -> named_struct('x', coalesce(e.x_min, 0), 'y', coalesce(e.y_min, 0), 'pos', e.pos, 'bottom', coalesce(e.y_max, 0), 'text', e.stripped)))")
    kind = "array<struct<x:int,last:int,members:array<int>,value:string>>"
    place = "array_position(transform(s, c -> abs(e.x - c.x) <= 40 AND e.y - c.last > 0 AND e.y - c.last < 90), true)"
    new = "named_struct('x', e.x, 'last', e.bottom, 'members', array(e.pos), 'value', e.text)"
    grown = "named_struct('x', c.x, 'last', e.bottom, 'members', array_append(c.members, e.pos), 'value', c.value || e.text)"
    fold = (f"aggregate({pieces}, CAST(array() AS {kind}), (s, e) -> CAST(IF({place} = 0, array_append(s, {new}),"
            f" transform(s, (c, i) -> IF(i = {place} - 1, {grown}, c))) AS {kind}))")
    claimed = "flatten(transform(chains, c -> slice(c.members, 2, size(c.members))))"
    names = ["pos", "line_no", "text", "stripped", "confidence", *_BOX]
    same = ", ".join(f"'{n}', e.{n}" for n in names)
    return (photos.withColumn("chains", F.expr(f"filter({fold}, c -> size(c.members) >= 2)"))
            .withColumn("pool", F.expr(
                f"IF(size(chains) = 0, pool, transform(pool, e -> named_struct({same}, 'claimed', coalesce(e.claimed, CASE WHEN array_contains({claimed}, e.pos) THEN 'vertical_chain' END),"
                " 'base', e.base, 'address', e.address, 'cands', e.cands)))")))


def vertical_chains(photos: DataFrame) -> DataFrame:
    return photos.selectExpr("package_id", "surface_idx", "inline(chains)")


def with_pointers(photos: DataFrame) -> DataFrame:
    """Photos with ``pointers``: lines that say where a declaration is printed.

    Up to two following free lines are added while they continue the sentence.
    """
    follows = lambda n: f"get(pool, l.pos + {n})"
    goes_on = lambda n: (f"({follows(n)}.claimed IS NULL AND ({follows(n)}.stripped LIKE '%,' OR {has(v.POINTER_CONTINUES, follows(n) + '.stripped')}))")
    text = (f"concat_ws(' ', l.text, CASE WHEN {goes_on(1)} THEN {follows(1)}.stripped END,"
            f" CASE WHEN {goes_on(1)} AND {goes_on(2)} THEN {follows(2)}.stripped END)")
    place = f"lower(coalesce({pick(v.POINTER_OF, 1, 'p.text')}, {pick(v.POINTER_ON, 1, 'p.text')}, {pick(v.POINTER_PLACE, 1, 'p.text')}, 'base'))"
    hints = "array_sort(array_distinct(array_compact(array(" + ", ".join(
        f"CASE WHEN {has(p, 'p.text')} THEN '{f}' END" for p, f in v.POINTER_HINTS) + "))))"
    found = (f"transform(filter(pool, l -> exists(l.cands, c -> c.kind = 'pointer')), l -> named_struct('surface_idx', surface_idx, 'pos', l.pos,"
             f" 'surface_name', surface_name, 'original_text', l.text, 'text', {text}, 'confidence', l.confidence))")
    return photos.withColumn("pointers", F.expr(
        f"transform({found}, p -> named_struct('surface_idx', p.surface_idx, 'pos', p.pos, 'surface_name', p.surface_name,"
        f" 'original_text', p.original_text, 'text', p.text, 'confidence', p.confidence, 'location', {place}, 'fields', {hints}))"))


SIGNATURE = ("(size(filter(pool, l -> l.stripped RLIKE r'^[0-9]{1,3}$')) >= 3 AND"
             " array_max(transform(filter(pool, l -> l.stripped RLIKE r'^[0-9]{1,3}$'), l -> coalesce(l.x_min, 0)))"
             " - array_min(transform(filter(pool, l -> l.stripped RLIKE r'^[0-9]{1,3}$'), l -> coalesce(l.x_min, 0))) <= 80)")


def merge_fields(fields: DataFrame) -> DataFrame:
    """The best reading of every declaration over all photos (long form)."""
    cells = ["value", "ocr_text", "ocr_conf", "ext_conf", "level", *_BOX, "reason", "line_idx", "surface_idx", "surface_name"]
    order = F.struct("ext_conf", "ocr_conf", -F.col("surface_idx"))
    found = F.when(F.col("value").isNotNull(), order)
    best = fields.groupBy("package_id", "field").agg(F.max_by(F.struct(*cells), found).alias("b"))
    return best.select("package_id", "field", "b.*").withColumnsRenamed(
        {"surface_idx": "source_idx", "surface_name": "source_name"}).fillna(
        {"ocr_text": "", "ocr_conf": 0.0, "ext_conf": 0.0, "level": "MISSING", "reason": "not found", "line_idx": -1})


_FIELD_TYPE = ("struct<field:string,value:string,ocr_text:string,ocr_conf:double,ext_conf:double,level:string,x_min:int,y_min:int,x_max:int,"
               "y_max:int,reason:string,line_idx:int,source_idx:int,source_name:string,gate:string,address_detected:boolean,address_text:string>")


def to_packages(photos: DataFrame) -> DataFrame:
    """One row per package from photos with pool, chains and pointers."""
    surface = ["surface_idx", "surface_name", "usable", "fields", "pool", "chains", "pointers", "cylinder"]
    extra = [c for c in ("score", "gate_usable", "usability_basis", "n_lines", "avg_confidence", "ocr_error") if c in photos.columns]
    key = [c for c in ("part", "package_id") if c in photos.columns]  # on the exchange of the photos, if they are not read from files
    return (photos.withColumn("cylinder", F.expr(SIGNATURE)).groupBy(*key)
            .agg(F.array_sort(F.collect_list(F.struct(*surface[:1], *surface[1:], *extra))).alias("surfaces")).select("package_id", "surfaces"))


def with_evidence(packages: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Packages with candidates, pointers, merged declarations and free evidence.

    A declaration found on no photo may be filled from the most confident free
    candidate of its kind, when a pointer, the base of a cylindrical package or a
    label elsewhere allows it; such a value is never better than LOW.
    """
    cand = ("named_struct('surface_idx', s.surface_idx, 'pos', l.pos, 'kind', c.kind, 'value', c.value, 'norm', c.norm, 'nutrition', c.nutrition,"
            " 'base', l.base, 'claimed', l.claimed, 'usable', s.usable, 'text', l.text, 'confidence', l.confidence, 'surface_name', s.surface_name, "
            + ", ".join(f"'{b}', l.{b}" for b in _BOX)
            + f", 'use_by', c.kind = 'date' AND {has(v.DATE_TEXT_USE_BY, 'l.text')}, 'made', c.kind = 'date' AND {has(v.DATE_TEXT_MADE, 'l.text')})")
    of_lines = f"flatten(transform(surfaces, s -> flatten(transform(s.pool, l -> transform(l.cands, c -> {cand})))))"
    chain = cand.replace("c.kind", "'code'").replace("c.value", "k.value").replace("c.norm", "k.value").replace("c.nutrition", "false").replace("l.base", "true")
    of_chains = f"flatten(transform(surfaces, s -> transform(s.chains, k -> element_at(transform(array(s.pool[k.members[0]]), l -> {chain}), 1))))"
    merged = []
    for n, name in enumerate(v.FIELDS):  # the order in which photos list their declarations
        read = f"get(s.fields, {n})"
        merged.append((name, f"array_max(transform(filter(surfaces, s -> s.usable AND {read}.value IS NOT NULL),"
                             f" s -> named_struct('e', {read}.ext_conf, 'o', {read}.ocr_conf, 'i', -s.surface_idx, 'f', {read}, 'n', s.surface_name)))"))
    packages = packages.select("*", F.expr(f"concat({of_lines}, {of_chains})").alias("cands"),
                               F.expr("flatten(transform(surfaces, s -> s.pointers))").alias("pointers"),
                               *[F.expr(b).alias(f"_m_{n}") for n, b in merged])
    cells = []
    for name in v.FIELDS:
        p = f"_m_{name}"
        cells.append(f"named_struct('field', '{name}', 'value', {p}.f.value, 'ocr_text', coalesce({p}.f.ocr_text, ''), 'ocr_conf', coalesce({p}.f.ocr_conf, 0.0D),"
                     f" 'ext_conf', coalesce({p}.f.ext_conf, 0.0D), 'level', coalesce({p}.f.level, 'MISSING'), " + ", ".join(f"'{b}', {p}.f.{b}" for b in _BOX)
                     + f", 'reason', coalesce({p}.f.reason, 'not found'), 'line_idx', coalesce({p}.f.line_idx, -1), 'source_idx', -{p}.i, 'source_name', {p}.n,"
                       " 'gate', CAST(NULL AS STRING), 'address_detected', CAST(NULL AS BOOLEAN), 'address_text', CAST(NULL AS STRING))")
    pool_text = "array_join(flatten(transform(surfaces, s -> transform(s.pool, l -> l.text))), ' | ')"
    packages = packages.withColumns({
        "labelled": F.expr(f"CAST(array({', '.join(cells)}) AS array<{_FIELD_TYPE}>)"),
        "pool_text": F.expr(pool_text), "pool_low": F.expr(f"lower({pool_text})"),
        "hints": F.expr("array_distinct(flatten(transform(pointers, p -> p.fields)))"),
        "cylindrical": F.expr(f"exists(pointers, p -> {has(v.POINTER_CONTAINER, 'p.text')}) OR exists(surfaces, s -> s.cylinder)"),
        "cylindrical_package": F.expr(f"exists(pointers, p -> p.location IN ({', '.join(repr(b) for b in v.BASE_PLACES)}))"),
    }).withColumn("anchored", F.expr("concat(" + ", ".join(  # asked only of declarations that no photo states
        _when(f"get(labelled, {v.FIELDS.index(f)}).value IS NULL AND {may_hold(p, 'pool_low')} AND {has(p, 'pool_text')}", f"'{f}'")
        for f, p in v.LABEL_ANCHORS.items() if f in v.ANCHOR_FIELDS) + ")"))
    packages = packages.withColumn("filled", F.expr(_associate(t)))
    taken = "exists(filled.out, o -> o.field = f.field)"
    packages = packages.withColumn("fields", F.expr(
        f"transform(labelled, f -> IF({taken}, filter(filled.out, o -> o.field = f.field)[0], f))"))
    packages = packages.withColumn("unclaimed", F.expr(
        "filter(cands, c -> c.claimed IS NULL AND NOT exists(filled.claimed, d -> d.surface_idx = c.surface_idx AND d.pos = c.pos))"))
    return _with_addresses(packages).drop(*[f"_m_{n}" for n in v.FIELDS], "labelled", "pool_text", "pool_low")


def concluded(packages: DataFrame) -> DataFrame:
    """What is read of packages once their evidence is handed out: of photos, their state and texts; of free candidates, what they say."""
    state = ["surface_idx", "surface_name", "usable", "score", "n_lines", "avg_confidence", "ocr_error"]
    photo = ", ".join(f"'{c}', s.{c}" for c in state) + ", 'pool', transform(s.pool, l -> named_struct('text', l.text))"
    free = ", ".join(f"'{c}', c.{c}" for c in ("surface_idx", "text", "kind", "value"))
    # hints and anchored stay: a column that only lambdas read would be worked out again for every element
    return packages.select("package_id", "pointers", "fields", "filled", "hints", "anchored", "cylindrical", "cylindrical_package",
                           F.expr(f"transform(surfaces, s -> named_struct({photo}))").alias("surfaces"), F.expr(f"transform(unclaimed, c -> named_struct({free}))").alias("unclaimed"))


def _associate(t: Thresholds) -> str:
    """The fold that hands free candidates to missing declarations, in fixed order."""
    asks = "array(" + ", ".join(
        f"named_struct('field', '{f}', 'kind', '{k}', 'base', {str(f in v.BASE_FIELDS).lower()}, 'anchor', {str(f in v.ANCHOR_FIELDS).lower()}, 'at', {v.FIELDS.index(f)})"
        for f, k in v.FIELD_KINDS) + ")"
    state = f"struct<claimed:array<struct<surface_idx:int,pos:int>>,out:array<{_FIELD_TYPE}>>"
    fits = ("(c.kind = a.kind OR (a.kind = 'contact' AND c.kind IN ('phone', 'email'))) AND c.claimed IS NULL AND c.usable"
            " AND NOT exists(s.claimed, d -> d.surface_idx = c.surface_idx AND d.pos = c.pos) AND NOT (a.kind = 'quantity' AND c.nutrition)"
            " AND (a.kind <> 'date' OR IF(a.field = 'best_before', NOT c.made, NOT c.use_by))")
    eligible = f"transform(filter(cands, c -> {fits}), (c, i) -> named_struct('neg', -c.confidence, 'late', c.kind = 'email', 'i', i, 'c', c))"
    gates = ("named_struct('pointer', array_contains(hints, a.field), 'base', cylindrical AND a.base AND exists(e, n -> n.c.base),"
             " 'anchor', a.anchor AND array_contains(anchored, a.field), 'e', e)")
    best = "array_min(filter(w.e, n -> NOT (w.base AND NOT w.pointer) OR n.c.base))"
    new = ("named_struct('field', a.field, 'value', b.c.norm, 'ocr_text', b.c.text, 'ocr_conf', b.c.confidence, 'ext_conf',"
           f" least(b.c.confidence, {t.association_cap}D), 'level', 'LOW', " + ", ".join(f"'{x}', b.c.{x}" for x in _BOX)
           + ", 'reason', 'unlabelled ' || a.kind || ' on ' || b.c.surface_name, 'line_idx', -1, 'source_idx', b.c.surface_idx, 'source_name', b.c.surface_name,"
             " 'gate', CASE WHEN w.pointer THEN 'pointer' WHEN w.base THEN 'base' ELSE 'anchor' END, 'address_detected', CAST(NULL AS BOOLEAN), 'address_text', CAST(NULL AS STRING))")
    let = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    take = (f"IF(b.c.norm IS NULL, s, named_struct('claimed', array_append(s.claimed, named_struct('surface_idx', b.c.surface_idx, 'pos', b.c.pos)), 'out', array_append(s.out, {new})))")
    step = let(eligible, "e", let(gates, "w", f"IF(size(w.e) = 0 OR NOT (w.pointer OR w.base OR w.anchor), s, {let(best, 'b', take)})"))
    open_gate = "(array_contains(hints, a.field) OR (cylindrical AND a.base) OR (a.anchor AND array_contains(anchored, a.field)))"
    missing = f"get(labelled, a.at).value IS NULL AND {open_gate}"
    return (f"aggregate({asks}, CAST(named_struct('claimed', array(), 'out', array()) AS {state}),"
            f" (s, a) -> CAST(IF({missing}, {step}, s) AS {state}))")


def _with_addresses(packages: DataFrame) -> DataFrame:
    """The first free address line next to each maker, packer and importer."""
    near = (f"{g.gap('f.y_min', 'f.y_max', 'l.y_min', 'l.y_max')} <= 220 AND {g.gap('f.x_min', 'f.x_max', 'l.x_min', 'l.x_max')} <= 160")
    state = "array<struct<field:string,surface_idx:int,pos:int,text:string>>"
    free = ("l.claimed IS NULL AND NOT exists(filled.claimed, d -> d.surface_idx = f.source_idx AND d.pos = l.pos)"
            " AND NOT exists(s, d -> d.surface_idx = f.source_idx AND d.pos = l.pos)")
    lines = "flatten(transform(filter(surfaces, p -> p.surface_idx = f.source_idx), p -> p.pool))"
    hit = f"get(filter({lines}, l -> l.address AND l.y_min IS NOT NULL AND {free} AND {near}), 0)"
    entities = f"filter(fields, f -> f.field IN ({', '.join(repr(e) for e in v.ENTITY_FIELDS)}) AND f.value IS NOT NULL AND f.y_min IS NOT NULL)"
    fold = (f"aggregate({entities}, CAST(array() AS {state}), (s, f) -> element_at(transform(array({hit}), h -> CAST(IF(h IS NULL, s,"
            f" array_append(s, named_struct('field', f.field, 'surface_idx', f.source_idx, 'pos', h.pos, 'text', h.text))) AS {state})), 1))")
    names = [p.split(":")[0] for p in _FIELD_TYPE[7:-1].split(",")]
    same = ", ".join(f"'{n}', f.{n}" for n in names if not n.startswith("address"))
    asked = f"(f.field IN ({', '.join(repr(e) for e in v.ENTITY_FIELDS)}) AND f.value IS NOT NULL AND f.y_min IS NOT NULL)"
    mine = "filter(addresses, d -> d.field = f.field)"
    return (packages.withColumn("addresses", F.expr(fold))
            .withColumn("fields", F.expr(
                f"transform(fields, f -> named_struct({same}, 'address_detected', CASE WHEN {asked} THEN size({mine}) > 0 END,"
                f" 'address_text', get({mine}, 0).text))")))


def level_from_conf(col: str):
    return F.expr(f"CASE WHEN {col} >= 0.85 THEN 'HIGH' WHEN {col} >= 0.70 THEN 'MEDIUM' ELSE 'LOW' END")
