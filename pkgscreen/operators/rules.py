"""Rule evaluation: rules are rows, packages meet them on the field or category they concern.

Generic rules: rule_id, requirement, rule_type, fields (array), validation, severity,
condition, depends_on, verified. Statutory rules: rule_id, category, vtype, severity,
title, fields and phrases (arrays), verified. ``sources.tables.read_ruleset`` reads
rule files; no rule is part of the library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pkgscreen import vocab as v
from pkgscreen.config import DEFAULT, Thresholds, fits, merged
from pkgscreen.functions.text import has, may_hold, sq, strip

POOR, ELSEWHERE, ABSENT = "not found; photos too poor to trust absence", "not found; printed elsewhere on the package", "not found on any photo"
LEVEL, ADDRESSED = "level", "address_detected"
LOW = "found with low confidence"
AGGREGATE = "REQUIRED_DECLARATIONS_PRESENT"  # kind of the rule that looks at the other findings of its package


RULES_BROADCAST = 10_000  # rules that travel to the packages; more of them meet the packages in salted parts


def meet(rows: DataFrame, rules: DataFrame, key: str, few: bool | None = None) -> DataFrame:
    """Rows of packages with the rules of the same key; packages are never the side that is sent round.

    A rule table of checked size is broadcast. A larger one is dealt to every part
    of the packages and merged there, so that a few key values do not limit the tasks.
    """
    if fits(rules, RULES_BROADCAST) if few is None else few:
        return rows.join(F.broadcast(rules), key)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rules.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.withColumn("part", F.pmod(F.xxhash64("package_id"), F.lit(parts)).cast("int")).join(dealt.hint("merge"), [key, "part"]).drop("part")


def contexts(packages: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Packages that can be judged, with their declarations by name and their quality."""
    return packages.select(
        "package_id", "pointers", "fields", F.expr("map_from_entries(transform(fields, f -> struct(f.field, f)))").alias("by"),
        F.expr("forall(surfaces, s -> s.usable)").alias("usable"), F.expr("transform(filter(surfaces, s -> NOT s.usable), s -> s.surface_name)").alias("unusable_names"),
        F.expr("aggregate(surfaces, 0.0D, (a, s) -> a + s.score) / size(surfaces)").alias("score"),
        F.expr("CAST(size(surfaces) AS BIGINT)").alias("surfaces_total"), F.expr("CAST(size(filter(surfaces, s -> s.usable)) AS BIGINT)").alias("surfaces_usable"),
        F.expr("aggregate(filter(surfaces, s -> s.usable), 0L, (a, s) -> a + s.n_lines)").alias("usable_lines"),
        F.expr("coalesce(try_divide(aggregate(filter(surfaces, s -> s.usable), 0.0D, (a, s) -> a + s.avg_confidence * s.n_lines), aggregate(filter(surfaces, s -> s.usable), 0L, (a, s) -> a + s.n_lines)), 0.0D)").alias("ocr"),
        F.expr("lower(array_join(concat(flatten(transform(array_sort(fields), f -> array(f.value, f.ocr_text))), flatten(transform(filter(surfaces, s -> s.usable), s -> transform(s.pool, l -> l.text)))), '\\n'))").alias("corpus"),
    ).where("surfaces_usable > 0 AND usable_lines > 0").withColumn("blocks", F.expr(f"NOT usable OR score < {t.usable_score}"))


def pointer_at(field: str, base: list[str]) -> str:
    """Position of the first pointer that says where a declaration is printed; 0 if none."""
    places, carried = ", ".join(f"'{p}'" for p in v.BASE_PLACES), ", ".join(f"'{b}'" for b in base)
    return f"CAST(array_position(transform(pointers, p -> array_contains(p.fields, {field}) OR (p.location IN ({places}) AND {field} IN ({carried}))), true) AS INT)"


def validators(value: str, kind: str) -> str:
    price = f"try_cast(get(regexp_extract_all({value}, r'{v.PRICE_NUMBER}', 1), 0) AS DOUBLE)"
    return (f"CASE {kind} WHEN 'PRESENT' THEN true WHEN 'PRESENT_AND_VALID_PRICE' THEN coalesce({price} BETWEEN {v.PRICE_MIN} AND {v.PRICE_MAX}, false)"
            f" WHEN 'PRESENT_AND_VALID_UNIT' THEN {has(v.UNIT_VALUE, value)} WHEN 'VALID_DATE' THEN {has('[0-9]', value)} ELSE false END")


def evaluate_rules(ctx: DataFrame, rules: DataFrame, enforce: bool = False) -> DataFrame:
    """Every generic rule on every package, matched on the fields the rule names.

    Each package offers one row per declaration; a rule takes the rows of its
    fields (and of the field it depends on) by an equality join.
    """
    slots = (ctx.select("package_id", "blocks", "pointers", F.explode(F.expr(
        "concat(transform(fields, f -> named_struct('field', f.field, 'value', f.value, 'level', f.level)), array(named_struct('field', '', 'value', CAST(NULL AS STRING), 'level', 'MISSING')))")).alias("f"))
             .select("package_id", "blocks", F.col("f.field").alias("field"), F.col("f.value").alias("value"), F.col("f.level").alias("level"),
                     F.expr(pointer_at("f.field", v.BASE_FIELDS)).alias("pointer")))
    wants = rules.select("rule_id", F.expr(
        "inline(concat(transform(IF(size(fields) = 0, array(''), fields), (x, i) -> named_struct('ord', i, 'field', x)), array(named_struct('ord', -1, 'field', coalesce(depends_on, '')))))"))
    target = F.col("ord") >= 0
    found = meet(slots, wants, "field").groupBy("package_id", "rule_id").agg(
        F.bool_or("blocks").alias("blocks"), F.max_by("value", F.when(F.col("ord") == 0, 1)).alias("value"), F.max_by("level", F.when(F.col("ord") == 0, 1)).alias("level"),
        F.count_if(target & F.col("value").isNotNull() & (F.col("level") != "LOW")).alias("strong"), F.count_if(target & F.col("value").isNotNull()).alias("present"),
        F.min(F.when(target & (F.col("pointer") > 0), F.struct("ord", "pointer"))).getField("pointer").alias("pointer"),
        F.max(F.when(F.col("ord") == -1, F.col("value"))).alias("other"))
    applies = ("CASE condition WHEN 'ALWAYS' THEN 'YES' WHEN 'ORIGIN_NOT_INDIA' THEN CASE WHEN other IS NULL THEN 'UNKNOWN' WHEN other RLIKE r'(?i)india' THEN 'NO' ELSE 'YES' END"
               " WHEN 'FIELD_PRESENT' THEN IF(other IS NULL, 'NO', 'YES') ELSE 'UNKNOWN' END")
    absent = f"CASE WHEN blocks THEN '{POOR}' WHEN pointer IS NOT NULL THEN '{ELSEWHERE}' ELSE '{ABSENT}' END"
    verdict = f"""CASE WHEN {str(enforce).lower()} AND NOT verified THEN struct('UNVERIFIED' AS status, 'rule awaits verification' AS reason)
      WHEN applies = 'NO' THEN named_struct('status', 'NOT_APPLICABLE', 'reason', 'rule does not apply') WHEN applies = 'UNKNOWN' THEN named_struct('status', 'MANUAL_REVIEW', 'reason', 'applicability unknown')
      WHEN size(fields) = 0 THEN named_struct('status', 'MANUAL_REVIEW', 'reason', 'rule names no field') WHEN rule_type NOT IN ('MANDATORY', 'CONDITIONAL', 'MANDATORY_ANY') THEN named_struct('status', 'MANUAL_REVIEW', 'reason', 'unknown rule type')
      WHEN rule_type = 'MANDATORY_ANY' AND strong > 0 THEN named_struct('status', 'PASS', 'reason', 'declared') WHEN rule_type = 'MANDATORY_ANY' AND present > 0 THEN named_struct('status', 'MANUAL_REVIEW', 'reason', '{LOW}')
      WHEN rule_type = 'MANDATORY_ANY' OR value IS NULL THEN named_struct('status', IF({absent} = '{ABSENT}', 'FAIL', 'MANUAL_REVIEW'), 'reason', {absent})
      WHEN level = 'LOW' THEN named_struct('status', 'MANUAL_REVIEW', 'reason', '{LOW}') WHEN {validators('value', 'validation')} THEN named_struct('status', 'PASS', 'reason', 'declared')
      ELSE named_struct('status', 'MANUAL_REVIEW', 'reason', 'value could not be validated') END"""
    return (meet(found, rules, "rule_id").withColumn("applies", F.expr(applies)).withColumn("v", F.expr(verdict))
            .select("package_id", "rule_id", "severity", "applies", "rule_type", "validation", F.col("v.status").alias("status"), F.col("v.reason").alias("reason"), "pointer", "value"))


def _f(field: str, cell: str = "value") -> str:
    return f"try_element_at(by, '{field}').{cell}"


def exemption_mode() -> str:
    amount = f"CAST(get(regexp_extract_all({_f('net_quantity')}, r'(?i){v.STANDARD_QTY}', 1), 0) AS DOUBLE)"
    unit = f"lower(get(regexp_extract_all({_f('net_quantity')}, r'(?i){v.STANDARD_QTY}', 2), 0))"
    grams = f"({amount} * IF({unit} IN ('kg', 'l'), 1000, 1))"
    return (f"CASE WHEN {_f('net_quantity')} IS NULL OR {_f('net_quantity', 'level')} = 'LOW' OR {amount} IS NULL THEN 'UNKNOWN' WHEN {unit} NOT IN ('g', 'gm', 'kg', 'ml', 'l') THEN 'FULL'"
            f" WHEN {grams} <= 10 THEN 'EXEMPT' WHEN {grams} <= 20 THEN 'PARTIAL' ELSE 'FULL' END")


def _absent(fields: list[str]) -> str:
    seen = " OR ".join(f"{pointer_at(repr(f), v.BASE_FIELDS_STATUTORY)} > 0" for f in fields)
    return f"CASE WHEN blocks THEN struct('MANUAL_REVIEW' AS status, '{POOR}' AS reason) WHEN {seen} THEN named_struct('status', 'MANUAL_REVIEW', 'reason', '{ELSEWHERE}') ELSE named_struct('status', 'FAIL', 'reason', '{ABSENT}') END"


def _say(status: str, reason: str) -> str:
    return f"struct('{status}' AS status, '{reason}' AS reason)"


def handlers(t: Thresholds = DEFAULT) -> dict[str, str]:
    """The outcome of each kind of check, from the declarations of one package."""
    ents = v.ENTITY_FIELDS
    entity = (f"CASE WHEN coalesce({', '.join(_f(e) for e in ents)}) IS NULL THEN {_absent(ents)}"
              f" WHEN CASE {' '.join(f'WHEN {_f(e)} IS NOT NULL THEN {_f(e, LEVEL)}' for e in ents)} END = 'LOW' THEN {_say('MANUAL_REVIEW', LOW)}"
              f" WHEN {' OR '.join(f'coalesce({_f(e)} IS NOT NULL AND {_f(e, ADDRESSED)}, false)' for e in ents)} THEN {_say('PASS', 'name and address found')}"
              f" ELSE {_say('MANUAL_REVIEW', 'name found, address not located')} END")

    def plain(field: str, test: str, good: str, bad: str) -> str:
        return (f"CASE WHEN {_f(field)} IS NULL THEN {_absent([field])} WHEN {_f(field, 'level')} = 'LOW' THEN {_say('MANUAL_REVIEW', LOW)}"
                f" WHEN {test} THEN {_say('PASS', good)} ELSE {_say('MANUAL_REVIEW', bad)} END")

    qty = plain("net_quantity", has(v.STANDARD_QTY, _f("net_quantity")), "standard unit", "no standard unit")
    price = f"try_cast(get(regexp_extract_all({_f('mrp')}, r'{v.PRICE_NUMBER}', 1), 0) AS DOUBLE)"
    made = f"coalesce({_f('manufacturing_date')}, {_f('packing_date')})"
    made_level = f"IF({_f('manufacturing_date')} IS NOT NULL, {_f('manufacturing_date', 'level')}, {_f('packing_date', 'level')})"
    month = f"(({' OR '.join(has(p, made) for p in v.MONTH_YEAR)}) AND ({has(v.MONTH_WORD, made)} OR {has(v.DAY_MONTH_YEAR, made)}))"
    care = _f("consumer_care")
    amount = f"CAST(get(regexp_extract_all({_f('net_quantity')}, r'(?i){v.STANDARD_QTY}', 1), 0) AS DOUBLE)"
    unit = f"lower(get(regexp_extract_all({_f('net_quantity')}, r'(?i){v.STANDARD_QTY}', 2), 0))"
    wrong = " OR ".join(f"({unit} = '{u}' AND {amount} {op} {n})" for u, op, n in v.UNIT_LIMITS)
    known = " + ".join(f"IF({_f(f)} IS NOT NULL, 1, 0)" for f in v.LANGUAGE_FIELDS)
    both = f"(IF({_f('mrp')} IS NOT NULL, 1, 0) + IF({_f('net_quantity')} IS NOT NULL, 1, 0))"
    return {
        "manufacturer_details": entity,
        "commodity_identity": plain("product_name", "true", "name stated", ""),
        "net_quantity": qty, "quantity_unit": qty,
        "date_declaration": f"CASE WHEN {made} IS NULL THEN {_absent(['manufacturing_date', 'packing_date'])} WHEN {made_level} = 'LOW' THEN {_say('MANUAL_REVIEW', LOW)}"
                            f" WHEN {month} THEN {_say('PASS', 'month and year stated')} ELSE {_say('MANUAL_REVIEW', 'month and year unconfirmed')} END",
        "mrp": plain("mrp", f"{price} BETWEEN {v.PRICE_MIN} AND {v.PRICE_MAX}", "plausible price", "implausible price"),
        "consumer_contact": f"CASE WHEN {care} IS NULL THEN {_absent(['consumer_care'])} WHEN contains(lower({care}), 'phone') THEN {_say('PASS', 'telephone stated')}"
                            f" WHEN contains(lower({care}), 'email') THEN {_say('MANUAL_REVIEW', 'e-mail only, telephone needed')} ELSE {_say('MANUAL_REVIEW', 'unclear contact')} END",
        "quantity_language": f"CASE WHEN {_f('net_quantity')} IS NULL THEN {_say('NOT_APPLICABLE', 'no quantity to judge')} ELSE {_say('PASS', 'no misleading wording')} END",
        "unit_format": f"CASE WHEN {amount} IS NULL THEN {_say('NOT_APPLICABLE', 'no unit to judge')} WHEN {wrong} THEN {_say('MANUAL_REVIEW', 'another unit required')} ELSE {_say('PASS', 'unit fits')} END",
        "language": f"IF({known} >= 2, {_say('PASS', 'enough declarations')}, {_say('MANUAL_REVIEW', 'too few declarations')})",
        "declaration_legibility": f"CASE {both} WHEN 0 THEN {_say('MANUAL_REVIEW', 'legibility unknown')} WHEN 1 THEN {_say('MANUAL_REVIEW', 'legibility of one unknown')} ELSE"
                                  f" IF(least({_f('mrp', 'ocr_conf')}, {_f('net_quantity', 'ocr_conf')}) >= {t.legible}D, {_say('PASS', 'legible')}, {_say('MANUAL_REVIEW', 'legibility doubtful')}) END",
        "_other": _say("MANUAL_REVIEW", "no check for this category"),
    }


def wording_pattern(phrases: str) -> str:
    """One pattern for the banned phrases of a rule with their usual short forms."""
    short = "map(" + ", ".join(f"'{k}', r'{'|'.join(p)}'" for k, p in v.WORDING_ABBREVIATIONS.items()) + ")"
    return (f"'(?i)' || array_join(transform({phrases}, p -> concat_ws('|', r'\\b' || p || r'\\b', try_element_at({short}, lower(p)))), '|')")


def evaluate_statutory(ctx: DataFrame, rules: DataFrame, enforce: bool = False, t: Thresholds = DEFAULT) -> DataFrame:
    """Every statutory rule on every package.

    Checks are worked out once per package, one row per kind; a rule then takes
    the row of its category by an equality join. The aggregate rule takes a row like
    any other and its verdict from the other findings of its package, over which a
    window counts: nothing is evaluated twice.
    """
    kinds = ", ".join(f"named_struct('handler', '{k}', 'h', {e})" for k, e in handlers(t).items())
    checks = ctx.select("package_id", F.expr(exemption_mode()).alias("exemption"),
                        F.expr(f"{_f('net_quantity')} || ' | ' || {_f('net_quantity', 'ocr_text')}").alias("quantity_text"),
                        F.expr(f"array({kinds})").alias("checks"))
    quoted = lambda items: ", ".join(f"'{i}'" for i in items)
    keyed = rules.withColumn("handler", F.expr(f"IF(category IN ({quoted(v.HANDLER_CATEGORIES)}), category, '_other')")).withColumn("banned", F.expr(
        f"IF(size(phrases) > 0, {wording_pattern('phrases')}, NULL)"))
    unverified = f"{str(enforce).lower()} AND NOT verified"
    verdict = f"""CASE WHEN {unverified} THEN {_say('UNVERIFIED', 'rule awaits verification')}
      WHEN vtype = 'EXEMPTION_LOOKUP' THEN named_struct('status', 'NOT_APPLICABLE', 'reason', 'exemption gate: ' || exemption)
      WHEN rule_id IN ({quoted(v.SCOPE_NA_RULES)}) THEN {_say('NOT_APPLICABLE', 'rule outside photo screening')} WHEN vtype IN ({quoted(v.SCOPE_NA_TYPES)}) THEN {_say('NOT_APPLICABLE', 'check outside photo screening')}
      WHEN category IN ({quoted(v.DECLARATION_CATEGORIES)}) AND (exemption = 'EXEMPT' OR (exemption = 'PARTIAL' AND category NOT IN ({quoted(v.PARTIAL_CATEGORIES)}))) THEN {_say('NOT_APPLICABLE', 'exempt by quantity')}
      WHEN category = 'quantity_language' AND h.status = 'PASS' AND quantity_text RLIKE banned THEN {_say('FAIL', 'misleading wording')} ELSE h END"""
    whole, package = f"vtype = '{AGGREGATE}'", Window.partitionBy("package_id")
    count = lambda *statuses: F.count_if(~F.expr(whole) & F.col("v.status").isin(*statuses)).over(package)
    gate = f"""CASE WHEN {unverified} THEN {_say('UNVERIFIED', 'rule awaits verification')} WHEN f > 0 THEN {_say('FAIL', 'declarations missing or invalid')}
      WHEN m > 0 THEN {_say('MANUAL_REVIEW', 'declarations uncertain')} WHEN p > 0 THEN {_say('PASS', 'all declarations found')} ELSE {_say('NOT_APPLICABLE', 'declarations exempt')} END"""
    few = fits(keyed, RULES_BROADCAST)
    if few:  # packages travel before they meet the rules, one row each, and their findings stay where they are
        checks = checks.repartition(int(ctx.sparkSession.conf.get("spark.sql.shuffle.partitions")), "package_id")
    # never empty; inline would have its size inferred as a filter and all checks worked out again in it
    checks = checks.selectExpr("package_id", "exemption", "quantity_text", "inline_outer(checks)")
    return (meet(checks, keyed, "handler", few).withColumn("v", F.expr(verdict))
            .withColumns({"f": count("FAIL"), "m": count("MANUAL_REVIEW", "UNVERIFIED"), "p": count("PASS")})
            .withColumn("v", F.expr(f"IF({whole}, {gate}, v)"))
            .select("package_id", "rule_id", "category", "severity", "title", "fields", F.col("v.status").alias("status"), F.col("v.reason").alias("reason")))


def fuse(findings: DataFrame) -> DataFrame:
    fail, review = F.col("status") == "FAIL", F.col("status").isin("MANUAL_REVIEW", "UNVERIFIED")
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("rule_id"))))
    return findings.groupBy("package_id").agg(
        ids(fail).alias("failed_rules"), ids(review).alias("review_rules"), F.count_if(F.col("status") == "PASS").alias("passed")).withColumn(
        "decision", F.expr("CASE WHEN size(failed_rules) > 0 THEN 'NON_COMPLIANT' WHEN size(review_rules) > 0 THEN 'MANUAL_REVIEW' WHEN passed > 0 THEN 'COMPLIANT' ELSE 'MANUAL_REVIEW' END"))


# ------------------------------------------------------------------ scoring
def literal_map(d: dict) -> str:
    def cell(x):
        return f"array({', '.join(repr(i) for i in x)})" if isinstance(x, list) else repr(x) if isinstance(x, str) else f"{x}D"
    return "map(" + ", ".join(f"'{k}', {cell(x)}" for k, x in d.items()) + ")"


def compliance_score(findings: DataFrame) -> DataFrame:
    """Severity-weighted credit of the findings that could be judged, 0 to 100."""
    weight = f"coalesce(try_element_at({literal_map(v.SEVERITY_WEIGHTS)}, upper(severity)), 1.0D)"
    credit = f"try_element_at({literal_map(v.STATUS_CREDIT)}, status)"
    scored = findings.withColumns({"w": F.expr(f"IF({credit} IS NULL, NULL, {weight})"), "e": F.expr(f"{weight} * {credit}")})
    grade = "CASE WHEN score IS NULL THEN '-' " + " ".join(f"WHEN score >= {n} THEN '{g}'" for n, g in v.GRADES) + " END"
    return scored.groupBy("package_id").agg(
        F.round(F.try_divide(100.0 * F.sum("e"), F.sum("w")), 1).alias("score"), F.count("w").alias("scored_rules"),
        F.count_if(F.col("w").isNull()).alias("not_assessable")).withColumn("grade", F.expr(grade))


def score_breakdown(findings: DataFrame) -> DataFrame:
    """All four groups of every package, from one grouping by package."""
    bucket = f"coalesce(try_element_at({literal_map(v.CATEGORY_BUCKETS)}, category), 'other')"
    weight = f"coalesce(try_element_at({literal_map(v.SEVERITY_WEIGHTS)}, upper(severity)), 1.0D)"
    credit = f"try_element_at({literal_map(v.STATUS_CREDIT)}, status)"
    rows = findings.withColumns({"bucket": F.expr(bucket), "e": F.expr(f"{weight} * {credit}"), "w": F.expr(f"IF({credit} IS NULL, NULL, {weight})")})
    cells = []
    for b in v.BUCKETS:
        mine = F.col("bucket") == b
        hit = lambda s: F.count_if(mine & (F.col("status") == s))  # noqa: E731, B023
        cells.append(F.struct(F.lit(b).alias("bucket"), F.round(F.try_divide(100.0 * F.sum(F.when(mine, F.col("e"))), F.sum(F.when(mine, F.col("w")))), 1).alias("score"),
                              hit("PASS").alias("passed"), hit("FAIL").alias("failed"), hit("MANUAL_REVIEW").alias("reviewed"),
                              F.count_if(mine & F.col("w").isNull()).alias("not_assessable")))
    return rows.groupBy("package_id").agg(F.array(*cells).alias("b")).select("package_id", F.inline("b"))


def confidence(ctx: DataFrame, findings: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Weighted confidence and its parts; a verdict below the threshold goes to review."""
    judged = F.count_if(F.col("status") != "NOT_APPLICABLE")
    share = findings.groupBy("package_id").agg(F.coalesce(F.try_divide(F.count_if(F.col("status").isin("PASS", "FAIL")), judged), F.lit(0.5)).alias("rule_applicability"))
    clamp = lambda e: f"greatest(0.0D, least(1.0D, {e}))"
    found = "filter(fields, f -> f.value IS NOT NULL)"
    parts = ctx.select("package_id", F.expr(clamp("ocr")).alias("ocr"), F.expr(
        f"coalesce(try_divide(aggregate({found}, 0.0D, (a, f) -> a + {clamp('f.ext_conf')}), size({found})), 0.0D)").alias("extraction"), F.expr(clamp("score / 100")).alias("image_quality"))
    joined = parts.join(merged(share), "package_id", "left").fillna(0.5, ["rule_applicability"])
    return joined.withColumn("overall", F.expr("round(" + clamp("0.4D * ocr + 0.3D * extraction + 0.2D * image_quality + 0.1D * rule_applicability") + ", 9)"))


def guard(decisions: DataFrame, confidences: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    weak = f"round(overall, 9) < {t.review} AND decision IN ('COMPLIANT', 'NON_COMPLIANT')"
    return (decisions.join(merged(confidences.select("package_id", "overall")), "package_id")
            .withColumn("downgraded_from", F.expr(f"CASE WHEN {weak} THEN decision END"))
            .withColumn("decision", F.expr(f"IF({weak}, 'MANUAL_REVIEW', decision)")))


def field_confidence(ctx: DataFrame) -> DataFrame:
    return ctx.selectExpr("package_id", "inline(fields)").selectExpr("package_id", "field", "IF(value IS NULL, 0.0D, greatest(0.0D, least(1.0D, ocr_conf, ext_conf))) AS confidence")


def classify(ctx: DataFrame, most: int = 6) -> DataFrame:
    """The commodity class with the most keyword evidence, and what was found for it; the earlier class on ties."""
    classes = []
    for n, (name, strong, weak) in enumerate(v.COMMODITY):
        hits = lambda patterns: "array(" + ", ".join(f"CASE WHEN {may_hold(p, 'corpus')} THEN regexp_substr(corpus, {sq('(?i)' + p)}) END" for p in patterns) + ")"
        classes.append(f"named_struct('strong', {hits(strong)}, 'weak', {hits(weak)}, 'late', {-n}, 'name', '{name}')")
    points = f"{v.STRONG_WEIGHT} * size(array_compact(c.strong)) + {v.WEAK_WEIGHT} * size(array_compact(c.weak))"
    scored = f"transform(classes, c -> named_struct('points', {points}, 'late', c.late, 'name', c.name, 'hits', slice(array_compact(concat(c.strong, c.weak)), 1, {most})))"
    # the searches are a column that is named twice: one named once would be worked out inside the lambdas, uncompiled
    searched = ctx.select("package_id", F.expr(f"array({', '.join(classes)})").alias("classes"))
    ranked = searched.select("package_id", F.expr(f"IF(classes IS NULL, NULL, reverse(array_sort(filter({scored}, c -> c.points > 0))))").alias("r"))
    best, second = "get(r, 0).points", "coalesce(get(r, 1).points, 0)"
    return ranked.selectExpr("package_id", "coalesce(get(r, 0).name, 'unknown') AS product_category",
                             f"CASE WHEN size(r) = 0 THEN 0.0D ELSE round(least(0.85D, 0.35D + 0.5D * ({best} - {second}) / {best}), 4) END AS category_confidence",
                             f"coalesce({best} >= 3 AND {second} < {best}, false) AS confident",
                             f"transform(coalesce(get(r, 0).hits, CAST(array() AS ARRAY<STRING>)), h -> {strip('h')}) AS evidence")


def scope_rules(findings: DataFrame, categories: DataFrame) -> DataFrame:
    allowed = f"try_element_at({literal_map(v.CATEGORY_RULE_SCOPE)}, category)"
    return findings.join(merged(categories.select("package_id", "product_category")), "package_id").withColumn(
        "in_scope", F.expr(f"{allowed} IS NULL OR product_category = 'unknown' OR array_contains({allowed}, product_category)"))


def rule_fields(findings: DataFrame) -> DataFrame:
    """The declarations a finding speaks about: its own list, else those of its category."""
    declared, by_category = literal_map(v.DECLARED_FIELDS), literal_map(v.CATEGORY_FIELDS)
    known = ", ".join(f"'{f}'" for f in v.FIELDS)
    named = f"flatten(transform(fields, d -> coalesce(try_element_at({declared}, d), IF(d IN ({known}), array(d), array()))))"
    return findings.withColumn("names", F.expr(named)).withColumn(
        "names", F.expr(f"array_distinct(IF(size(names) > 0, names, coalesce(try_element_at({by_category}, category), array())))"))


def field_status(findings: DataFrame) -> DataFrame:
    rank = "CASE status WHEN 'PASS' THEN 0 WHEN 'MANUAL_REVIEW' THEN 1 WHEN 'FAIL' THEN 2 END"
    rows = rule_fields(findings).select("package_id", F.expr(rank).alias("r"), F.explode("names").alias("field")).where("r IS NOT NULL")
    return rows.groupBy("package_id", "field").agg(F.expr("element_at(array('PASS', 'MANUAL_REVIEW', 'FAIL'), max(r) + 1)").alias("status"))


def annotation_plan(ctx: DataFrame, findings: DataFrame) -> DataFrame:
    """Boxes to draw on each photo with the worst status of their declaration."""
    boxes = ctx.selectExpr("package_id", "inline(fields)").where("value IS NOT NULL AND x_min IS NOT NULL AND source_name IS NOT NULL")
    return (boxes.join(merged(field_status(findings)), ["package_id", "field"], "left")
            .select("package_id", F.col("source_name").alias("surface_name"), "field", "value", "x_min", "y_min", "x_max", "y_max",
                    F.coalesce("status", F.lit("UNKNOWN")).alias("status"), "ext_conf"))


def matched_pointer(names: str) -> str:
    """The first pointer that says where one of the named declarations is printed, with the declaration."""
    places, carried = ", ".join(f"'{p}'" for p in v.BASE_PLACES), ", ".join(f"'{b}'" for b in v.BASE_FIELDS_STATUTORY)
    says = f"array_contains(p.fields, n) OR (p.location IN ({places}) AND n IN ({carried}))"
    return f"get(flatten(transform({names}, n -> transform(filter(pointers, p -> {says}), p -> named_struct('field', n, 'text', p.text, 'location', p.location, 'surface_name', p.surface_name)))), 0)"


def _review_names() -> str:
    return f"try_element_at({literal_map({k: f for k, f in v.REVIEW_FIELDS.items() if f})}, category)"


def evidence_of(ctx: DataFrame, findings: DataFrame) -> DataFrame:
    """What stands behind each finding: readings of its declarations; for an absence said to be printed elsewhere, the pointer that says so."""
    rows = rule_fields(findings).select("package_id", "rule_id", F.explode("names").alias("field"))
    fields = ctx.selectExpr("package_id", "inline(fields)").where("value IS NOT NULL")
    read = rows.join(merged(fields), ["package_id", "field"]).select("package_id", "rule_id", "field", "value", "ocr_conf", "ext_conf", "level", "source_name")
    absent = findings.where(F.col("reason") == ELSEWHERE).withColumn("names", F.expr(_review_names())).join(merged(ctx.select("package_id", "pointers")), "package_id")
    pointed = absent.withColumn("p", F.expr(matched_pointer("names"))).where("p IS NOT NULL").select(
        "package_id", "rule_id", F.col("p.field").alias("field"), F.col("p.surface_name").alias("source_name"), F.col("p.text").alias("pointer_text"), F.col("p.location").alias("pointer_place"))
    return read.unionByName(pointed, allowMissingColumns=True)


def review_actions(ctx: DataFrame, findings: DataFrame, confidences: DataFrame) -> DataFrame:
    """One targeted action per finding in review: what, where to look, on which photo; repeated ones are given once."""
    names = _review_names()
    cats = ", ".join(f"'{c}'" for c in v.REVIEW_FIELDS)
    rank = f"CAST(coalesce(try_element_at({literal_map({k: float(n) for k, n in v.SEVERITY_ORDER.items()})}, severity), 9.0D) AS INT)"
    rows = (findings.where(f"status = 'MANUAL_REVIEW' AND category IN ({cats})")
            .join(merged(ctx.select("package_id", "by", "pointers", "unusable_names")), "package_id").join(merged(confidences.select("package_id", "overall")), "package_id")
            .withColumn("field", F.expr(f"coalesce(get({names}, 0), rule_id)")).withColumn("f", F.expr("try_element_at(by, field)"))
            .withColumn("p", F.expr(f"IF(reason = '{ELSEWHERE}', {matched_pointer(names)}, NULL)")))
    again = "'take again: ' || array_join(unusable_names, ', ')"
    # the case of an action, and for each case where to look and on which photo
    case = """CASE WHEN p IS NOT NULL THEN 'pointer' WHEN contains(reason, 'address') THEN 'address' WHEN contains(reason, 'telephone') THEN 'care'
      WHEN contains(reason, 'legibility') OR category = 'declaration_legibility' THEN 'lines' WHEN f.value IS NOT NULL THEN 'read'
      WHEN contains(reason, 'too poor') THEN IF(size(unusable_names) > 0, 'photos', 'photo') ELSE 'sides' END"""
    check = f"""CASE kind WHEN 'pointer' THEN 'the ' || p.location || ' of the package, where the label points' WHEN 'address' THEN 'address of the making unit' WHEN 'care' THEN 'consumer care panel'
      WHEN 'lines' THEN 'price and quantity lines' WHEN 'read' THEN 'read again: ' || f.value WHEN 'photos' THEN {again} WHEN 'photo' THEN 'take the photo again' ELSE 'sides not photographed yet' END"""
    image = "CASE WHEN kind = 'pointer' THEN p.surface_name WHEN kind IN ('address', 'care', 'read') THEN f.source_name WHEN kind = 'photos' THEN unusable_names[0] END"
    rows = rows.withColumn("kind", F.expr(case)).withColumns({
        "check_location": F.expr(check), "source_image": F.expr(image), "rank": F.expr(rank), "confidence": F.expr("round(IF(f.value IS NOT NULL, f.ext_conf, overall), 3)"),
        "field_label": F.expr("initcap(replace(field, '_', ' '))")})
    order = F.row_number().over(Window.partitionBy("package_id", "field", "check_location").orderBy("rank", "rule_id"))
    return rows.withColumn("n", order).where("n = 1").select("package_id", "field", "field_label", "rule_id", F.col("title").alias("rule_reference"), "severity", "reason", "check_location", "source_image",
                                                             "confidence", F.col("f.value").alias("current_value"))
