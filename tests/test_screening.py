"""Acceptance cases on small packages written for this purpose."""

import random
import re

import pytest

from pkgscreen import vocab as v
from pkgscreen.config import written
from pkgscreen.functions.text import needed
from pkgscreen.operators import evidence as ev
from pkgscreen.operators import extract as ex
from pkgscreen.operators import rules as r
from pkgscreen.plans import inspection, screening
from pkgscreen.plans.fixtures import table
from pkgscreen.sources import tables

FRONT = ["ALMOND BITES", "MRP: Rs. 149.00", "Net Qty: 250 g"]
BACK = ["Manufactured By: Hillside Foods Pvt Ltd", "Plot 14, Industrial Estate, 560001", "Mfg Date: 05/03/2026", "Best Before 05/09/2026",
        "Batch No: HB2207", "Customer Care: 1800-222-3344", "Country of Origin: India"]


def rows(package, surface, texts, conf=0.97):
    return [(package, surface, f"s{surface}", n, t, conf, 20, n * 60, 420, n * 60 + 44) for n, t in enumerate(texts)]


STATUTORY = [("entity", "manufacturer_details", "FIELD_PRESENT", "CRITICAL"), ("price", "mrp", "FIELD_PRESENT", "CRITICAL"), ("amount", "net_quantity", "FIELD_PRESENT", "HIGH"),
             ("wording", "quantity_language", "DISALLOWED_PHRASES", "HIGH"), ("dates", "date_declaration", "FIELD_PRESENT", "HIGH"), ("care", "consumer_contact", "FIELD_PRESENT", "HIGH"),
             ("all", "package_declarations", r.AGGREGATE, "HIGH"), ("gate", "exemptions", "EXEMPTION_LOOKUP", "LOW"), ("unknown", "no_such_category", "OTHER", "LOW")]
GENERIC = [("p", "price", "MANDATORY", ["mrp"], "PRESENT_AND_VALID_PRICE", "HIGH", "ALWAYS", None, True),
           ("m", "maker", "MANDATORY_ANY", ["importer", "manufacturer"], "PRESENT", "HIGH", "ALWAYS", None, True),
           ("o", "importer", "CONDITIONAL", ["importer"], "PRESENT", "LOW", "ORIGIN_NOT_INDIA", "country_of_origin", False)]


def statutory_rules(spark):
    rows = [(*rule, rule[0], [], ["approximately", "about"] if rule[0] == "wording" else [], False) for rule in STATUTORY]
    return spark.createDataFrame(rows, "rule_id string, category string, vtype string, severity string, title string, fields array<string>, phrases array<string>, verified boolean")


def generic_rules(spark):
    return spark.createDataFrame(GENERIC, "rule_id string, requirement string, rule_type string, fields array<string>, validation string, severity string, condition string, depends_on string, verified boolean")


LINES = "package_id long, surface_idx int, surface_name string, line_no int, text string, confidence double, x_min int, y_min int, x_max int, y_max int"
METRICS = "package_id long, surface_idx int, surface_name string, blur double, brightness double, contrast double, glare double, skew double, ocr_error string"


@pytest.fixture(scope="module")
def screened(spark):
    lines = (rows(1, 0, FRONT) + rows(1, 1, BACK) + rows(2, 0, [FRONT[0], FRONT[2]]) + rows(2, 1, BACK)  # no price
             + rows(3, 0, FRONT, 0.35) + rows(3, 1, BACK, 0.35)  # weak reading
             + rows(4, 0, [FRONT[0], FRONT[1], "Net Qty: approx 250 g"]) + rows(4, 1, BACK))  # blurred quantity
    good, bad = (200.0, 120.0, 50.0, 0.05, 0.1, None), (10.0, 120.0, 50.0, 0.05, 0.1, "recogniser could not start")
    metrics = [(p, s, f"s{s}", *good) for p in (1, 2, 3, 4) for s in (0, 1)] + [(5, 0, "s0", *bad)]
    packages = screening.evidence_run(spark.createDataFrame(lines, LINES), spark.createDataFrame(metrics, METRICS)).cache()
    findings = r.evaluate_statutory(r.contexts(packages), statutory_rules(spark)).cache()
    results = {x.package_id: x for x in inspection.inspect(packages, findings).collect()}
    statuses = {(x.package_id, x.rule_id): x.status for x in findings.collect()}
    return results, statuses


def test_complete_package_has_no_violation(screened):
    results, statuses = screened
    assert results[1].violation_rule_ids == "" and statuses[1, "price"] == "PASS" and results[1].confidence > 0.8


def test_missing_price_fails(screened):
    results, statuses = screened
    assert statuses[2, "price"] == "FAIL" and results[2].decision == "NON_COMPLIANT"


def test_weak_reading_goes_to_a_person(screened):
    assert screened[0][3].decision == "MANUAL_REVIEW"


def test_misleading_wording_fails(screened):
    assert screened[1][4, "wording"] == "FAIL"


def test_recogniser_fault_is_not_judged(screened):
    assert screened[0][5].route == "ENGINE_FAULT" and screened[0][5].score is None


def test_rules_of_any_number_meet_packages_without_sending_packages_round(spark, monkeypatch):
    lines = [x for p in range(1, 5) for x in rows(p, 0, FRONT[:p]) + rows(p, 1, BACK)]
    metrics = [(p, s, f"s{s}", 200.0, 120.0, 50.0, 0.05, 0.1, None) for p in range(1, 5) for s in (0, 1)]
    context = r.contexts(screening.evidence_run(spark.createDataFrame(lines, LINES), spark.createDataFrame(metrics, METRICS)))
    context = written(context, "context")
    jobs = [lambda: r.evaluate_statutory(context, statutory_rules(spark)), lambda: r.evaluate_rules(context, generic_rules(spark))]
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    answers = lambda d: sorted((x.package_id, x.rule_id, x.status, x.reason) for x in d.collect())
    few = [answers(job()) for job in jobs]
    for job in jobs:
        assert "CartesianProduct" not in plan(job()) and "BuildLeft" not in plan(job())
    monkeypatch.setattr(r, "RULES_BROADCAST", 2)
    for job, want in zip(jobs, few):
        text = plan(job())
        assert not {"CartesianProduct", "BuildLeft", "BroadcastHashJoin"} & set(text.replace("(", " ").split()) and "SortMergeJoin" in text
        assert answers(job()) == want


def test_a_package_of_too_many_photos_is_refused_before_it_is_collected(spark):
    lines = rows(1, 0, FRONT) + rows(1, 1, BACK) + [x for n in range(9) for x in rows(2, n, FRONT)]
    metrics = [(p, s, f"s{s}", 200.0, 120.0, 50.0, 0.05, 0.1, None) for p, n in ((1, 2), (2, 9)) for s in range(n)]
    lines, metrics = spark.createDataFrame(lines, LINES), spark.createDataFrame(metrics, METRICS)
    packages = written(screening.evidence_run(lines, metrics), "packages")
    assert [x.package_id for x in packages.collect()] == [1]
    findings = written(r.evaluate_statutory(r.contexts(packages), statutory_rules(spark)), "findings")
    cited = findings.where("status = 'MANUAL_REVIEW'").selectExpr("package_id", "rule_id", "'c' AS chunk_id")
    whole = inspection.nested(packages, findings, cited, screening.rejected(metrics))
    got = {x.package_id: x for x in whole.collect()}
    assert (got[2].route, got[2].surfaces_total, got[2].decision, got[2].findings) == ("REFUSED", 9, None, None)
    assert len(got[1].findings) == len(STATUTORY) and {f.rule_id for f in got[1].findings if f.status == "MANUAL_REVIEW"} == {c.rule_id for c in got[1].citations or []}
    assert {d.field: d.value for d in got[1].declarations}["mrp"] == "Rs.149.00"
    flat = inspection.inspect(packages, findings)._jdf.queryExecution().executedPlan().toString()
    ids = set(re.findall(r"REPARTITION_BY_COL, \[plan_id=(\d+)", flat))
    assert "ENSURE_REQUIREMENTS" not in "".join(re.findall(r"Exchange hashpartitioning\(package_id.*", flat)) and ids
    stored = inspection.stored_rows(whole, "2026-01-01T00:00:00Z", {"id": "x", "version": "1", "verified": True})
    assert len(stored.columns) == 25 and {x.inspection_id: x.num_rules_pass for x in stored.collect()}[1] == sum(f.status == "PASS" for f in got[1].findings)


def test_chains_of_several_columns_against_a_greedy_walk(spark):
    rnd = random.Random(11)
    lines = []
    for package in range(40):  # up to 25 digit pieces in columns that may touch
        for n in range(rnd.randint(2, 25)):
            x, y = rnd.choice([20, 45, 200, 230, 400]) + rnd.randint(0, 9) * (package % 2), 30 * rnd.randint(0, 14)
            lines.append((package, 0, "s0", n, str(rnd.randint(1, 99)), 0.97, x, y, x + 30, y + 25))
        lines += [(package, 0, "s0", 40 + n, text, 0.97, 20, 700 + 60 * n, 400, 740 + 60 * n) for n, text in enumerate(FRONT)]
    metrics = [(p, 0, "s0", 200.0, 120.0, 50.0, 0.05, 0.1, None) for p in range(40)]
    photos = written(ev.with_pool(screening.photos_with_fields(spark.createDataFrame(lines, LINES), spark.createDataFrame(metrics, METRICS))), "photos")
    want = []
    for photo in photos.collect():
        chains = []
        for e in sorted((e for e in photo.pool if e.claimed is None and re.fullmatch("[0-9]{1,8}", e.stripped)), key=lambda e: (e.x_min, e.y_min, e.pos)):
            home = next((c for c in chains if abs(e.x_min - c["x"]) <= 40 and 0 < e.y_min - c["last"] < 90), None)
            if home is None:
                chains.append({"x": e.x_min, "last": e.y_max, "value": e.stripped, "n": 1})
            else:
                home.update(last=e.y_max, value=home["value"] + e.stripped, n=home["n"] + 1)
        want += [(photo.package_id, c["value"], c["n"]) for c in chains if c["n"] > 1]
    got = [(c.package_id, c.value, len(c.members)) for c in ev.vertical_chains(ev.with_chains(photos)).collect()]
    assert sorted(got) == sorted(want) and max(n for *_, n in want) >= 5 and len({p for p, *_ in want}) < len(want)


def test_photos_past_the_sixth_are_named(spark):
    files = spark.createDataFrame([(f"in/p/{n}.jpg",) for n in range(8)] + [("in/x.png",)], "path string")
    got = tables.group_surfaces(files, "in").collect()
    assert len(got) == 9 and sorted(x.surface_idx for x in got if x.reason) == [6, 7]


def test_price_traps(spark):
    lines = rows(1, 0, ["Protein 12.5 g", "Lic. No 10012345678901"]) + rows(2, 0, ["M.R.P", "Rs. 45.50"])
    got = {x.package_id: x for x in ex.extract(spark.createDataFrame(lines, LINES), ["mrp"]).collect()}
    assert got[1].value is None and got[1].level == "MISSING"
    assert got[2].value == "Rs.45.50" and got[2].level == "MEDIUM"


def test_tables_of_all_packages_are_never_sent_round(spark):
    """Findings compress to almost nothing, so a size taken from their files says nothing of their rows."""
    from pkgscreen.operators import regsearch as rs

    lines = spark.createDataFrame(rows(1, 0, FRONT) + rows(1, 1, BACK) + rows(2, 0, FRONT), LINES)
    metrics = spark.createDataFrame([(p, s, f"s{s}", 200.0, 120.0, 50.0, 0.05, 0.1, None) for p, s in ((1, 0), (1, 1), (2, 0))], METRICS)
    packages = written(screening.evidence_run(lines, metrics), "few-packages")
    findings = written(r.evaluate_statutory(r.contexts(packages), statutory_rules(spark)), "few-findings")
    context = r.contexts(packages)
    chunks = spark.createDataFrame([("price", "rules", "the price"), ("none", "rules", "nothing")], "chunk_id string, document string, text string")
    for made in (r.evidence_of(context, findings), r.annotation_plan(context, findings), r.review_actions(context, findings, r.confidence(context, findings))):
        assert "BroadcastExchange" not in made._jdf.queryExecution().executedPlan().toString()
    quoted = rs.quote_rules(findings.select("package_id", "rule_id"), chunks)
    assert sorted((q.package_id, q.rule_id, q.quote) for q in quoted.collect()) == [(1, "price", "the price"), (2, "price", "the price")]
    assert "BuildRight" in quoted._jdf.queryExecution().executedPlan().toString()


def test_equal_texts_are_read_once_and_parts_grow_with_the_rows(spark):
    from pkgscreen import config

    lines = [(p, 0, "s0", n, t, conf, 20, n * 60, 420 + p, n * 60 + 44) for p in range(60) for conf in [0.79 if p % 2 else 0.9] for n, t in enumerate(FRONT)]
    photos = ex.by_surface(spark.createDataFrame(lines, LINES), ex.flags_for(["mrp", "product_name"]))
    plan = photos._jdf.queryExecution().optimizedPlan().toString().splitlines()
    flags, source = next(i for i, x in enumerate(plan) if "RLIKE" in x), next(i for i, x in enumerate(plan) if "Repartition" in x)
    assert any("Aggregate [part" in x and "text" in x for x in plan[flags:source])  # texts are grouped below their flags
    got = {x.package_id: x.lines for x in photos.collect()}
    assert len(got) == 60 and all([x.text for x in found] == FRONT and found[1].price == "149.00" for found in got.values())
    scores = {p: found[0].name_score for p, found in got.items()}
    assert all(scores[p] == (None if p % 2 else 44 * (400 + p) * 0.9) for p in scores)
    assert config.spread(spark.range(10), "id", 8 * config.PART_ROWS).rdd.getNumPartitions() == 8


def test_lists_left_out_are_empty_ones(spark):
    """Candidate lists that the flags of a photo rule out, and texts kept nested, change no declaration."""
    sf = "/root/testdata/sf0.001"
    lines = table(spark, sf, "lines")
    flags = ex.flags_for(v.FIELDS)
    guarded = ex.extract_from(ex.by_surface(lines, flags, nested=True))
    every = ex.extract_from(ex.by_surface(lines, flags).drop(ex.SEEN))
    assert guarded.count() > 0 and guarded.exceptAll(every).count() == 0 and every.exceptAll(guarded).count() == 0


def test_needed_words_miss_no_match():
    """A text without any of the needed words is never matched; patterns that allow none have none."""
    patterns = [p for _, strong, weak in v.COMMODITY for p in [*strong, *weak]] + [*v.LABEL_ANCHORS.values(), v.ENTITY_SUFFIX, v.INSTRUCTION, v.QTY_LABEL, v.PRICE_TAX]
    texts = ["Non-Veg", "LIC NO 12345678901234", "mg / ml", "NET WT. 5 g", "Incl of all taxes", "230 V ~ 50 Hz", "size : XL", "Pvt", "made in", "nutrition facts", "e waste", ""]
    for pattern in patterns:
        for text in texts:
            if needed(pattern) and re.search(pattern, text, re.IGNORECASE):
                assert any(w in text.lower() for w in needed(pattern)), (pattern, text)
    assert needed(r"\bveg\b|\bnon[- ]?veg\b") == ["veg", "non"] and needed(r"a|\d+") == [] and needed(r"(?:abc)?") == []


def test_parts_are_dealt_before_they_become_lines(spark):
    """A small file of many parts is no single task."""
    assert table(spark, "/root/testdata/sf0.001", "lines").rdd.getNumPartitions() > 1
    assert table(spark, "/root/testdata/sf0.001", "surface_metrics").rdd.getNumPartitions() >= 4


def test_classes_search_only_for_words_that_are_there(spark):
    """Every pattern is searched for in the texts that may hold it, and only there."""
    texts = ["fssai lic. no 12345678901234\nnon-veg", "net 250 ml\nserve\nchilled", "bis registration 230 v ~ 50 hz watt", "mg / ml tablet store below 30 c", "nothing", ""]
    got = r.classify(spark.createDataFrame(list(enumerate(texts)), "package_id bigint, corpus string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(corpus") > 20
    for row in got.collect():
        found = {}
        for name, strong, weak in v.COMMODITY:
            hits = [[m.group() for p in patterns if (m := re.search(p, texts[row.package_id], re.IGNORECASE))] for patterns in (strong, weak)]
            found[name] = (v.STRONG_WEIGHT * len(hits[0]) + v.WEAK_WEIGHT * len(hits[1]), [h.strip() for h in [*hits[0], *hits[1]]][:6])
        best = max(found, key=lambda name: found[name][0])
        want = (best, found[best][1]) if found[best][0] else ("unknown", [])
        assert (row.product_category, row.evidence) == want


def test_findings_are_not_exchanged(spark):
    """Packages travel before they meet the rules: between the window over a package's findings and the rows of its checks nothing is exchanged."""
    context = spark.createDataFrame([], "package_id long").selectExpr(
        "package_id", "false AS blocks", "CAST(NULL AS array<struct<fields:array<string>,location:string>>) AS pointers",
        "CAST(NULL AS map<string,struct<value:string,level:string,ocr_text:string,ocr_conf:double,address_detected:boolean>>) AS by")
    plan = r.evaluate_statutory(context, statutory_rules(spark))._jdf.queryExecution().sparkPlan()
    prepared = spark._jvm.org.apache.spark.sql.execution.QueryExecution.prepareExecutedPlan(spark._jsparkSession, plan).toString()
    above, _, below = prepared[prepared.index("Window"):].partition("Generate")
    assert "hashpartitioning(package_id" not in above and "hashpartitioning(package_id" in below


def test_candidates_of_a_later_rank_are_not_looked_for():
    """A price on the price line ends the search: the lists of later ranks stand behind it, not beside it."""
    found = ex._first(ex.PLANS["mrp"][1])
    assert found.index("coalesce(array_min") < found.index("'r1', CAST(1 AS INT)") < found.index("'r1', CAST(3 AS INT)")
    assert "array_compact" not in found and "flatten(array(" not in found
    for lists in (found for _, found in ex.PLANS.values()):
        for _, found in lists:
            assert len(set(ex._RANK.findall(found))) == 1
