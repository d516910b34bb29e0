"""Declarations from recognised lines.

The lines are brought together once, by package, in parts of bounded size. Labels
repeat each other, so within a part each different text gets its flags and values
once, as a flat row in a compiled projection; a photo then is one row with its lines in
reading order, and every declaration is the smallest of its ranked candidates
over that row. Nothing is joined and nothing is shuffled a second time: the
result stays partitioned by ``part`` for the merge over photos.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgscreen import vocab as v
from pkgscreen.config import spread
from pkgscreen.functions import geometry as g
from pkgscreen.functions.text import (
    any_of, has, in_list, letters_share, may_hold, mentions, needed, no_trademark, pick, sq, strip, strip_of,
    title_or_upper,
)

_has = lambda p, col="text", cs=False: f"({may_hold(p, 'lowered')} AND {has(p, col, cs)})" if needed(p) else has(p, col, cs)  # noqa: E731  of a line's text or a piece of it
_REJECTED = lambda col: "(" + " OR ".join(_has(p, col) for p in v.REJECT.values()) + ")"
_COMPANY = lambda low: f"({mentions(v.COMPANY_WORDS, low)} AND NOT {mentions(v.COMPANY_NUTRITION_WORDS, low)})"
_NAMED = lambda col: f"({has(any_of(v.COMPANY_WORDS), col)} AND NOT {has(any_of(v.COMPANY_NUTRITION_WORDS), col)})"
_DIGIT = "(text RLIKE r'[0-9]')"  # lines without a digit skip the number patterns


def _price_fits(value: str) -> str:
    return (f"({value} IS NOT NULL AND CAST({value} AS DOUBLE) BETWEEN {v.PRICE_MIN} AND {v.PRICE_MAX}"
            f" AND NOT {_has(v.REJECT['nutrition'])}"
            f" AND NOT (({_has(v.PRICE_LONG_NUMBER)} OR {_has(v.PRICE_UNIT_SUFFIX)}) AND NOT {_has(v.PRICE_WORD)}))")


def _batch_fits(value: str) -> str:
    return (f"(length({value}) >= 2 AND NOT {in_list(f'lower({value})', v.BATCH_NOT_CODES)}"
            f" AND NOT ({has('^[0-9]+$', value)} AND length({value}) < 4))")


def _entity_flags(kind: str) -> dict[str, str]:
    keywords = v.ENTITY_KEYWORDS[kind]
    rest = [strip_of(f"regexp_replace(text, r'(?i){k}', '')", ":.,; ") for k in keywords]
    name = [f"CASE WHEN length({r}) >= 5 AND {_NAMED(r)} THEN {r} END" for r in rest]
    first = " ".join(f"WHEN {_has(k)} THEN {n}" for k, n in zip(keywords, name))
    any_name = ", ".join(f"CASE WHEN {_has(k)} THEN {n} END" for k, n in zip(keywords, name))
    labelled = _has("|".join(keywords))
    return {
        f"{kind}_kw": labelled,
        f"{kind}_first": f"CASE WHEN {labelled} THEN CASE {first} END END",
        f"{kind}_any": f"CASE WHEN {labelled} THEN coalesce({any_name}) END",
    }


_T, _EMAIL, _PRICE, _ODD, _CLEAN = "stripped", "email", "price", "odd_price", no_trademark("stripped")
_BATCH_VALUES = [pick(p) for p in v.BATCH_VALUES]
_BATCH_HINT = _has(r"batch|lot|b\.?\s*no")  # no batch pattern matches without it
_ORIGINS = [strip(f"CASE WHEN {may_hold(p, 'lowered')} THEN {pick(p)} END") for p in v.ORIGIN_VALUES]
_LABELLED = f"regexp_extract(text, {sq('(?i)' + v.BRAND_LABEL)}, 1)"
_HAS_BOX = "y_min IS NOT NULL"

# values that several flags read, taken once per line
LINE_VALUES: dict[str, str] = {
    "stripped": strip(),
    "lowered": "lower(text)",
    "price": f"CASE WHEN {_DIGIT} THEN {pick(v.PRICE_VALUE)} END",
    "odd_price": f"CASE WHEN {_DIGIT} AND {has(v.PRICE_ODD_START)} THEN {pick(v.PRICE_ODD)} END",
    "qty": f"CASE WHEN {_DIGIT} THEN coalesce({pick(v.QTY_VALUE, 0)}, {pick(v.QTY_VALUE_SHORT, 0)}) END",
    "phone": f"CASE WHEN {_DIGIT} THEN {pick(v.CARE_PHONE_CS, 0, cs=True)} END",
    "email": f"CASE WHEN contains(text, '@') THEN {pick(v.EMAIL_CS, 0, cs=True)} END",
}
# one entry per flag a text can carry, over the text and its values
LINE_FLAGS: dict[str, str] = {
    "mrp_kw": _has(v.MRP_KEYWORD),
    "price_ok": _price_fits(_PRICE),
    "rs": _has("rs"),
    "price_skip": _has(v.PRICE_NEIGHBOUR_SKIP),
    "tax": _has(v.PRICE_TAX),
    "odd": f"CASE WHEN {_price_fits(_ODD)} THEN {_ODD} END",
    "qty_label": _has(v.QTY_LABEL),
    "qty_alone": (
        f"CASE WHEN qty IS NULL OR {_has(v.QTY_NUTRITION_ROW)} THEN NULL"
        f" WHEN {_has(v.QTY_WORD)} OR CAST({pick(v.QTY_VALUE)} AS DOUBLE) >= 20 THEN qty"
        f" WHEN CAST({pick(v.QTY_VALUE_SHORT)} AS DOUBLE) >= 20 THEN {pick(v.QTY_VALUE_SHORT, 0)} END"),
    "company": _COMPANY("lowered"),
    "name_skip": f"({_has(v.ENTITY_REJECT)} OR {_has(v.ENTITY_NUTRITION)})",
    "continues": f"CASE WHEN {_has(v.NAME_CONTINUATION, _T)} THEN {_T} END",
    "date": f"CASE WHEN {_DIGIT} THEN coalesce(" + ", ".join(pick(p) for p in v.DATE_VALUES) + ") END",
    "address_word": mentions(v.DATE_ADDRESS_WORDS, "lowered"),
    "dated_batch": f"({_has(v.DATE_BATCH_LINE)} AND NOT {_has(v.INSTRUCTION)})",
    "date_inside": f"CASE WHEN {_DIGIT} THEN {pick(v.DATE_EMBEDDED_CS, cs=True)} END",
    "batch": f"CASE WHEN {_BATCH_HINT} AND NOT {_has(v.INSTRUCTION)} THEN coalesce("
             + ", ".join(f"CASE WHEN {_batch_fits(b)} THEN {b} END" for b in _BATCH_VALUES) + ") END",
    "batch_label": f"({_BATCH_HINT} AND coalesce({', '.join(_BATCH_VALUES)}) IS NOT NULL AND NOT {_has(v.INSTRUCTION)})",
    "code": (
        f"CASE WHEN {_has(v.BATCH_SHAPE_CS, _T, True)} AND NOT {_has('lic|fssai|pin', _T)} AND NOT {_has(v.BATCH_QTY, _T)}"
        f" AND NOT {_has(v.BATCH_DATE_CS, _T, True)} AND NOT {_has(v.BATCH_NUTRITION, _T)}"
        f" AND NOT {_REJECTED(_T)} AND {_batch_fits(_T)} THEN {_T} END"),
    "care": mentions(v.CARE_WORDS, "lowered"),
    "care_email": f"CASE WHEN {in_list(f'lower(substring_index({_EMAIL}, {chr(39)}@{chr(39)}, 1))', v.CARE_LOCAL_PARTS)}"
                  f" OR {_has(any_of(v.CARE_DOMAIN_WORDS), f'substring_index({_EMAIL}, {chr(39)}@{chr(39)}, -1)')} THEN {_EMAIL} END",
    "origin": "coalesce(" + ", ".join(f"CASE WHEN {_has(any_of(v.ORIGIN_COUNTRIES), o)} THEN {o} END" for o in _ORIGINS) + ")",
    "name_weight": (
        f"CASE WHEN length({_T}) BETWEEN 3 AND 40"
        f" AND NOT (contains({_T}, '(') AND contains({_T}, ')')) AND NOT {_has(v.NAME_SKIP, _T)}"
        f" AND NOT {_has(v.ENTITY_SUFFIX, _T)} AND {letters_share(_T)} >= 0.6D"
        f" THEN least(1.0D, length({_T}) / 6.0D) END"),
    "brand_label": _has(v.BRAND_LABEL),
    "brand_value": f"CASE WHEN {_has(v.BRAND_LABEL)} THEN {no_trademark(_LABELLED)} END",
    "marked": f"CASE WHEN {_has(v.TRADEMARK_CS, _T, True)} AND length({_CLEAN}) BETWEEN 2 AND 40"
              f" AND NOT {has(v.BRAND_SKIP, _CLEAN)} THEN {_CLEAN} END",
    "brand_fit": (
        f"(length({_T}) BETWEEN 2 AND 30"
        f" AND NOT {_has(v.BRAND_SKIP, _T)} AND NOT {_has(v.ENTITY_SUFFIX, _T)} AND NOT {_REJECTED(_T)}"
        f" AND size(split({_T}, r'{v.WS}+')) <= 3 AND {letters_share(_T)} >= 0.8D AND {title_or_upper(_T)})"),
}
# flags that also depend on where and how well a line was read, over a line with its text's flags
PLACED_FLAGS: dict[str, str] = {
    "name_score": f"CASE WHEN confidence >= 0.80D AND {_HAS_BOX} AND f.name_weight IS NOT NULL THEN {g.area()} * confidence * f.name_weight END",
    "brand_score": f"CASE WHEN confidence >= 0.85D AND {_HAS_BOX} AND f.brand_fit THEN {g.area()} * confidence END",
}
_PLACED_FROM = {"name_score": "name_weight", "brand_score": "brand_fit"}
for _kind in v.ENTITY_FIELDS:
    LINE_FLAGS |= _entity_flags(_kind)
for _field, _label in v.DATE_LABELS.items():
    LINE_FLAGS[f"{_field}_label"] = _has(_label)
    LINE_FLAGS[f"{_field}_other"] = _has(v.DATE_OTHER_LABELS[_field])

SEEN = "seen"  # which flags any line of a photo carries, one bit each
SEEN_BITS = {n: 1 << i for i, n in enumerate([*LINE_FLAGS, "price", "qty", "phone", "email"])}
_BOOLEAN = {"mrp_kw", "price_ok", "rs", "price_skip", "tax", "qty_label", "company", "name_skip", "address_word", "dated_batch", "batch_label",
            "care", "brand_label", "brand_fit", *(f"{k}_kw" for k in v.ENTITY_FIELDS), *(f"{f}_{x}" for f in v.DATE_LABELS for x in ("label", "other"))}
_BASE = ["text", "confidence", "x_min", "y_min", "x_max", "y_max"]
LINES_PER_PHOTO = 8  # taken for the number of parts only


def tag_rejects(lines: DataFrame) -> DataFrame:
    """Which reject classes each line falls in."""
    return lines.withColumns({f"is_{k}": F.expr(has(p)) for k, p in v.REJECT.items()})


def by_surface(lines: DataFrame, flags: list[str], surfaces: DataFrame | None = None, facts: dict[str, str] | None = None,
               nested: bool = False) -> DataFrame:
    """One row per photo: its lines in reading order, each with the named flags.

    ``surfaces`` adds the columns known per photo (and photos without any line):
    both kinds of rows travel in one exchange by package and meet in one
    grouping, so there is no join. Only raw lines are moved. Behind the exchange the
    lines of a part are grouped by text and the flags, and more ``facts`` (name to
    expression over the text and its values), are taken once per text, as compiled
    expressions on flat rows; then lines are grouped by photo. With ``nested``, a line
    keeps what its text says in one struct ``f``, which spares copying it field by field.
    """
    keys = ["package_id", "surface_idx", "surface_name"]
    read = ["line_no", "confidence", "x_min", "y_min", "x_max", "y_max"]
    extra = [c for c in surfaces.columns if c not in keys] if surfaces is not None else []
    rows = lines.select(*keys, *read, "text", F.lit(True).alias("_line"))
    size = lines.count() if surfaces is None else surfaces.count() * LINES_PER_PHOTO
    if surfaces is not None:
        rows = rows.unionByName(surfaces.select(*keys, *extra), allowMissingColumns=True)
    at = F.struct(*keys, *read, "_line", *extra)
    texts = spread(rows, "package_id", size).groupBy("part", "text").agg(F.collect_list(at).alias("at"))
    texts = texts.withColumns({n: F.expr(e) for n, e in LINE_VALUES.items()})
    named = [n for n in flags if n not in LINE_VALUES]
    taken = {n: n for n in LINE_VALUES} | {m: LINE_FLAGS[m] for m in (_PLACED_FROM.get(n, n) for n in named)} | (facts or {})
    cells = ", ".join(f"'{n}', {e}" for n, e in taken.items())
    texts = texts.select("part", "text", "at", F.expr(f"named_struct({cells})").alias("f"))
    bits = [f"IF(coalesce(f.{n}{'' if n in _BOOLEAN else ' IS NOT NULL'}, false), {SEEN_BITS[n]}L, 0L)" for n in taken if n in SEEN_BITS]
    placed = texts.select("part", "text", "f", F.expr(" | ".join(bits)).alias(SEEN), "at").select("part", "text", "f", SEEN, F.inline("at"))
    own = [n for n in named if n in PLACED_FLAGS]
    placed = placed.withColumns({n: F.expr(PLACED_FLAGS[n]) for n in own})
    line = F.when(F.col("_line"), F.struct("line_no", "text", *read[1:], *own, "f"))
    photos = placed.select("part", *keys, *extra, SEEN, line.alias("line")).groupBy("part", *keys).agg(
        F.array_sort(F.collect_list("line")).alias("lines"), F.bit_or(SEEN).alias(SEEN), *[F.max(c).alias(c) for c in extra])
    shown = [n for n in [*named, *(facts or {})] if n not in own]
    said = ["'f', x.f"] if nested else [f"'{n}', x.f.{n}" for n in [*LINE_VALUES, *shown]]
    flat = ", ".join(["'pos', i", *(f"'{n}', x.{n}" for n in ["line_no", *_BASE, *own]), *said])
    return photos.withColumn("lines", F.expr(f"transform(lines, (x, i) -> named_struct({flat}))"))


def _within(anchor: str, before: int, after: int) -> str:
    """The lines from ``before`` above to ``after`` below an anchor line."""
    start = f"greatest({anchor}.pos - {before}, 0)"
    return f"slice(lines, {start} + 1, {anchor}.pos + {after} - {start} + 1)"


def _found(rank: list[str], value: str, level: str, cap: float, line: str, *, seen: str | None = None,
           conf: str | None = None, box: str | None = None, reason: str = "") -> str:
    """A ranked candidate; the smallest of a list is the one to keep."""
    conf, box = conf or f"{line}.confidence", box or line
    ranks = ", ".join(
        f"'r{n}', CAST({r} AS {'DOUBLE' if n == 4 else 'INT'})" for n, r in enumerate([*rank, *["0"] * (5 - len(rank))], 1))
    return (f"named_struct({ranks}, 'value', {value}, 'ocr_text', {seen or f'{line}.text'}, 'ocr_conf', {conf},"
            f" 'ext_conf', least({conf}, {cap}D), 'level', '{level}',"
            f" 'x_min', {box}.x_min, 'y_min', {box}.y_min, 'x_max', {box}.x_max, 'y_max', {box}.y_max,"
            f" 'reason', '{reason}', 'line_idx', {line}.pos)")


_RANK = re.compile(r"'r1', CAST\((\d+) AS INT\)")  # the first rank of a list's candidates, the same for all of them


def _each(where: str, then: str, over: str = "lines", x: str = "l") -> str:
    return f"transform(filter({over}, {x} -> {where}), {x} -> {then})"


def _near(anchor_where: str, over: str, where: str, then: str) -> str:
    """For every anchor line ``a``, the neighbour lines ``l`` that qualify.

    An anchor whose own line states the value ranks before its neighbours, so these are not looked at.
    """
    return f"flatten(transform(filter(lines, a -> {anchor_where}), a -> {_each(where, then, over)}))"


_BOTH, _WEAKER = "concat_ws(' | ', a.text, l.text)", "least(a.confidence, l.confidence)"
_MONEY = "(CASE WHEN l.rs THEN 'Rs.' ELSE '₹' END || l.price)"


def _if(flags: str, found: str) -> tuple[str, str]:
    """A list of candidates with the flags without each of which, on some line of the photo, it is empty."""
    return flags, found


def _mrp() -> list[tuple[str, str]]:
    return [
        _if("mrp_kw price_ok", _each("l.mrp_kw AND l.price_ok", _found(["1", "l.pos"], _MONEY, "HIGH", .95, "l", reason="price on the price line"))),
        _if("mrp_kw price_ok", _near("a.mrp_kw AND a.price_ok IS NOT TRUE", _within("a", 2, 2), "l.pos <> a.pos AND NOT l.price_skip AND l.price_ok",
              _found(["1", "a.pos", "1", "0", "l.pos"], _MONEY, "MEDIUM", .85, "a", seen=_BOTH, conf=_WEAKER, reason="price next to the price label"))),
        _if("tax price_ok", _near("a.tax", _within("a", 3, 2), "l.price_ok",
              _found(["2", "a.pos", "0", "0", "l.pos"], "'₹' || l.price", "MEDIUM", .80, "l", reason="price next to the tax phrase"))),
        _if("odd", _each("l.odd IS NOT NULL", _found(["3", "l.pos"], "'₹' || l.odd", "MEDIUM", .85, "l", reason="price in an unusual form"))),
    ]


def _around_text(line: str, n: int) -> str:
    return f"array_join(transform({_within(line, n, n)}, n -> n.text), ' ')"


def _net_quantity() -> list[tuple[str, str]]:
    words = any_of(v.QTY_NUTRITION_WORDS)
    return [
        _if("qty_label qty", _each("l.qty_label AND l.qty IS NOT NULL", _found(["1", "l.pos"], "l.qty", "HIGH", .95, "l", reason="quantity on the quantity line"))),
        _if("qty_label qty", _near("a.qty_label AND a.qty IS NULL", _within("a", 1, 3), f"l.pos <> a.pos AND l.qty IS NOT NULL AND NOT {has(words, _around_text('l', 1))}",
              _found(["1", "a.pos", "1", "0", "l.pos"], "l.qty", "MEDIUM", .85, "a", seen=_BOTH, conf=_WEAKER, reason="quantity next to the quantity label"))),
        _if("qty_alone", _each(f"l.qty_alone IS NOT NULL AND NOT {has(words, _around_text('l', 2))}",
              _found(["2", "-l.pos"], "l.qty_alone", "LOW", .70, "l", reason="quantity without a label"))),
    ]


def _entity(kind: str) -> list[tuple[str, str]]:
    kw, named = f"a.{kind}_kw AND a.{kind}_first IS NULL", "l.company AND NOT l.name_skip"
    following = "get(lines, l.pos + 1).continues"
    value = f"concat_ws(' ', l.text, {following})"
    seen = f"concat_ws(' | ', a.text, {value})"
    ahead = lambda lo, hi: f"slice(lines, a.pos + {lo} + 1, {hi - lo + 1})"
    return [
        _if(f"{kind}_first", _each(f"l.{kind}_first IS NOT NULL", _found(["1", "l.pos"], f"l.{kind}_first", "HIGH", .90, "l", reason="name on the label line"))),
        _if(f"{kind}_kw company", _near(kw, ahead(1, 3), named, _found(["1", "a.pos", "1", "0", "l.pos"], value, "HIGH", .90, "a", seen=seen, conf=_WEAKER, reason="name just below the label"))),
        _if(f"{kind}_kw company", _near(kw, ahead(4, 10), named, _found(["1", "a.pos", "2", "0", "l.pos"], value, "MEDIUM", .85, "a", seen=seen, conf=_WEAKER, reason="name further below the label"))),
        _if(f"{kind}_kw", _near(kw, ahead(1, 4), "NOT l.name_skip", _found(["1", "a.pos", "3", "0", "l.pos"], "l.text", "MEDIUM", .75, "a", seen=_BOTH, conf=_WEAKER, reason="first plausible line below the label"))),
        _if(f"{kind}_any", _each(f"l.{kind}_any IS NOT NULL", _found(["1", "l.pos", "4"], f"l.{kind}_any", "HIGH", .90, "l", reason="name on the label line"))),
    ]


def _date(field: str) -> list[tuple[str, str]]:
    bare, other = f"a.{field}_label AND a.date IS NULL", f"l.{field}_other"
    usable = f"l.pos <> a.pos AND NOT {other} AND l.date IS NOT NULL AND NOT l.address_word"
    taken = f"exists(lines, o -> o.pos <> l.pos AND o.{field}_other AND {g.vertical_overlap('o', 'l')} >= 0.2D)"
    pair = dict(seen=_BOTH, conf=_WEAKER)
    found = [
        _if(f"{field}_label date", _each(f"l.{field}_label AND l.date IS NOT NULL", _found(["1", "l.pos"], "l.date", "HIGH", .95, "l", reason="date on the label line"))),
        _if(f"{field}_label date", _near(bare, "lines", f"{usable} AND {g.vertical_overlap('a', 'l')} >= 0.2D",
              _found(["1", "a.pos", "1", g.centre_distance("a", "l"), "l.pos"], "l.date", "MEDIUM", .85, "l", reason="date in the same row as the label", **pair))),
        _if(f"{field}_label date", _near(bare, _within("a", 2, 2), f"{usable} AND NOT {taken}",
              _found(["1", "a.pos", "2", "0", "l.pos"], "l.date", "MEDIUM", .85, "l", reason="date near the label", **pair))),
    ]
    if field != "best_before":
        found.append(_if("dated_batch date_inside", _near("a.dated_batch", _within("a", 1, 3), "NOT l.address_word AND l.date_inside IS NOT NULL",
                           _found(["2", "a.pos", "0", "0", "l.pos"], "l.date_inside", "LOW", .75, "l", reason="date inside a batch line"))))
    return found


def _batch() -> list[tuple[str, str]]:
    row = f"{g.vertical_overlap('a', 'l')} >= 0.2D"
    common = "l.pos <> a.pos AND l.code IS NOT NULL"
    rank = lambda n: ["2", "a.pos", n, g.centre_distance("a", "l"), "l.pos"]
    pair = dict(seen=_BOTH, conf=_WEAKER)
    return [
        _if("batch", _each("l.batch IS NOT NULL", _found(["1", "l.pos"], "l.batch", "HIGH", .90, "l", reason="code on the batch line"))),
        _if("batch_label code", _near("a.batch_label", _within("a", 4, 4), f"{common} AND {row}", _found(rank("0"), "l.code", "MEDIUM", .85, "l", reason="code in the same row as the batch label", **pair))),
        _if("batch_label code", _near("a.batch_label", _within("a", 4, 4), f"{common} AND NOT ({row})", _found(rank("1"), "l.code", "LOW", .70, "l", reason="code near the batch label", **pair))),
    ]


def _consumer_care() -> list[tuple[str, str]]:
    around = _within("l", 1, 2)
    first = lambda c: f"get(filter(transform({around}, n -> n.{c}), n -> n IS NOT NULL), 0)"
    value = f"concat_ws(' | ', 'Phone: ' || {first('phone')}, 'Email: ' || {first('email')})"
    return [
        _if("care", _each(f"l.care AND l.confidence > 0 AND exists({around}, n -> n.phone IS NOT NULL OR n.email IS NOT NULL)",
              _found(["1", "0", "0", "-l.confidence", "l.pos"], value, "HIGH", .90, "l",
                     seen=f"array_join(transform({around}, n -> n.text), ' | ')", reason="contact next to a care phrase"))),
        _if("care_email", _each("l.care_email IS NOT NULL", _found(["2", "l.pos"], "'Email: ' || l.care_email", "MEDIUM", .75, "l", reason="care e-mail address"))),
    ]


def _origin() -> list[tuple[str, str]]:
    return [_if("origin", _each("l.origin IS NOT NULL", _found(["1", "l.pos"], "l.origin", "HIGH", .90, "l", reason="country of origin stated")))]


_STRIPPED = "l.stripped"


def _largest(score: str, than: str, found: str) -> str:
    """The candidate of the line with the largest score, another one's line left out; only that line's is made."""
    at = f"array_min(transform(filter(lines, l -> l.{score} IS NOT NULL AND l.pos <> coalesce({than}.line_idx, -1)), l -> named_struct('s', -l.{score}, 'at', l.pos))).at"
    return f"get(transform(slice(lines, {at} + 1, 1), l -> {found}), 0)"


_NAME = _largest("name_score", "_marked", _found(["1", "0", "0", "-l.name_score", "l.pos"], _STRIPPED, "MEDIUM", .75, "l", reason="most prominent text"))
_UNMARKED = no_trademark("l.text")
_MARKED_BRANDS = [
    _if("brand_label", _each("l.brand_label AND length(l.brand_value) BETWEEN 2 AND 40",
          _found(["1", "l.pos"], "l.brand_value", "HIGH", .92, "l", reason="brand label"))),
    # the value stands on the line after a bare label
    _if("brand_label", _near("a.brand_label AND a.brand_value = ''", "slice(lines, a.pos + 2, 1)", f"length({_UNMARKED}) BETWEEN 2 AND 40",
          _found(["1", "a.pos"], _UNMARKED, "HIGH", .90, "l", seen=_BOTH, conf=_WEAKER,
                 box="(CASE WHEN l.y_min IS NULL THEN a ELSE l END)", reason="line after the brand label"))),
    _if("marked", _each("l.marked IS NOT NULL", _found(["2", "l.pos"], "l.marked", "HIGH", .88, "l", reason="trademark sign"))),
]
_LARGE_BRAND = _largest("brand_score", "_name", _found(["3", "0", "0", "-l.brand_score", "l.pos"], _STRIPPED, "LOW", .62, "l", reason="prominent proper noun"))

_DATE_FLAGS = lambda f: [f"{f}_label", f"{f}_other", "date", "address_word", *([] if f == "best_before" else ["dated_batch", "date_inside"])]
_ENTITY_FLAGS = lambda k: [f"{k}_kw", f"{k}_first", f"{k}_any", "company", "name_skip", "continues"]
_BRAND_FLAGS = ["name_score", "brand_label", "brand_value", "marked", "brand_score"]
# declaration -> flags it reads, candidate lists
PLANS: dict[str, tuple[list[str], list[tuple[str, str]]]] = {
    "mrp": (["mrp_kw", "price", "price_ok", "rs", "price_skip", "tax", "odd"], _mrp()),
    "product_name": (_BRAND_FLAGS, []),
    "net_quantity": (["qty_label", "qty", "qty_alone"], _net_quantity()),
    **{k: (_ENTITY_FLAGS(k), _entity(k)) for k in v.ENTITY_FIELDS},
    **{f: (_DATE_FLAGS(f), _date(f)) for f in v.DATE_LABELS},
    "batch_number": (["batch", "batch_label", "code"], _batch()),
    "consumer_care": (["care", "phone", "email", "care_email"], _consumer_care()),
    "country_of_origin": (["origin"], _origin()),
    "brand": (_BRAND_FLAGS, []),
}
FIELD_COLUMNS = ["field", "value", "ocr_text", "ocr_conf", "ext_conf", "level",
                 "x_min", "y_min", "x_max", "y_max", "reason", "line_idx"]


def flags_for(fields: list[str]) -> list[str]:
    return list(dict.fromkeys(f for name in fields for f in PLANS[name][0]))


def _first(lists: list[tuple[str, str]]) -> str:
    """The smallest candidate of all lists; those that no line of the photo can fill are not looked through, nor those of a later rank than one found."""
    ranks: dict[int, list[str]] = {}
    for flags, found in lists:
        ranks.setdefault(int(_RANK.search(found).group(1)), []).append(f"CASE WHEN {_holds(flags)} THEN array_min({found}) END")
    some = " OR ".join(_holds(flags) for flags, _ in lists)
    return f"CASE WHEN {some} THEN coalesce({', '.join(f'array_min(array({chr(44).join(ranks[n])}))' for n in sorted(ranks))}) END"


def _holds(flags: str) -> str:
    mask = sum(SEEN_BITS[f] for f in flags.split())
    return f"({SEEN} & {mask}L = {mask}L)"


def field_structs(surfaces: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Photos with one more column, ``fields``: the array of their declarations; the flags they were read from are left behind."""
    fields = fields or v.FIELDS
    keep = [c for c in surfaces.columns if c != SEEN]
    first = _first if SEEN in surfaces.columns else lambda lists: f"array_min(concat({', '.join(found for _, found in lists)}))"
    each = lambda found: found
    spent = {*LINE_FLAGS, *PLACED_FLAGS, *LINE_VALUES, "f"} - {"stripped"}
    line = surfaces.schema["lines"].dataType.elementType
    said = line["f"].dataType.names if "f" in line.names else []
    if said:  # what a text says stands one level deeper
        flatly, named = first, re.compile(rf"(\b[a-z]|\))\.({'|'.join(said)})\b")
        each = lambda found: named.sub(r"\1.f.\2", found)
        first = lambda lists: each(flatly(lists))
    left = ", ".join([f"'{n}', l.{n}" for n in line.names if n not in spent] + [f"'{n}', l.f.{n}" for n in said if n not in spent])
    narrow = F.expr(f"transform(lines, l -> named_struct({left}))").alias("lines")
    best = {"product_name": "_name", "brand": "_brand"}
    if {"product_name", "brand"} & set(fields):
        surfaces = (
            surfaces.withColumn("_marked", F.expr(first(_MARKED_BRANDS)))
            .withColumn("_name", F.expr(each(_NAME)))
            .withColumn("_brand", F.expr(f"coalesce(_marked, {each(_LARGE_BRAND)})")))
    found = surfaces.select(*[c for c in keep if c != "lines"], narrow, *[
        F.expr(best.get(f) or first(PLANS[f][1])).alias(f"_{f}_found") for f in fields])
    absent = {"ocr_text": "''", "ocr_conf": "0.0D", "ext_conf": "0.0D", "level": "'MISSING'",
              "reason": "'not found'", "line_idx": "-1"}
    rows = [f"named_struct('field', '{f}', " + ", ".join(
        f"'{c}', " + (f"coalesce(_{f}_found.{c}, {absent[c]})" if c in absent else f"_{f}_found.{c}")
        for c in FIELD_COLUMNS[1:]) + ")" for f in fields]
    return found.select(*keep, F.expr(f"array({', '.join(rows)})").alias("fields"))


def extract_from(surfaces: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Long table of the declarations of photos already brought to rows."""
    # the array is never empty; inline would have its size inferred as a filter and all candidates evaluated again in it
    return field_structs(surfaces, fields).selectExpr("package_id", "surface_idx", "surface_name", "inline_outer(fields)")


def extract(lines: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Long table of declarations per photo; absent ones are MISSING rows."""
    fields = fields or v.FIELDS
    return extract_from(by_surface(lines, flags_for(fields)), fields)


def extract_all(lines: DataFrame) -> DataFrame:
    return extract(lines)


def neighbour_lines(lines: DataFrame, before: int, after: int) -> DataFrame:
    """Every line with each line around it, itself left out.

    Offsets are carried by ``lead``/``lag`` in one window over the photo, so the
    photo is sorted once and never joined to itself.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("package_id", "surface_idx").orderBy("line_no")
    around = [F.struct(F.lit(d).alias("distance"), F.lead("line_no", d).over(order).alias("near_line_no"),
                       F.lead("text", d).over(order).alias("near_text"))
              for d in range(-before, after + 1) if d]
    return (lines.select("package_id", "surface_idx", "line_no", "text", F.array(*around).alias("around"))
            .select("package_id", "surface_idx", "line_no", "text", F.inline("around"))
            .where("near_line_no IS NOT NULL"))


def looks_like_company(col: str):
    return F.expr(_NAMED(col))


def complete_fields(fields: DataFrame) -> DataFrame:
    """All declarations of every package; those found nowhere are MISSING.

    One pass per package: the found declarations become a map that the fixed
    list of names is looked up in.
    """
    cells = [c for c in fields.columns if c not in ("package_id", "field")]
    found = fields.groupBy("package_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field", F.struct(*cells)))).alias("found"))
    names = F.array(*[F.lit(f) for f in v.FIELDS])
    filled = {"level": "MISSING", "ocr_text": "", "ocr_conf": 0.0, "ext_conf": 0.0, "line_idx": -1, "reason": "not found"}
    rows = found.select("package_id", "found", F.explode(names).alias("field")).withColumn("f", F.try_element_at("found", F.col("field")))
    return rows.select("package_id", "field", *[
        (F.coalesce(F.col(f"f.{c}"), F.lit(filled[c])) if c in filled else F.col(f"f.{c}")).alias(c) for c in cells])
