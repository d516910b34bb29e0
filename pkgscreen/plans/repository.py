"""Queries over stored inspections and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pkgscreen.operators import repository as r
from pkgscreen.plans.fixtures import table
from pkgscreen.plans.registry import QUERIES, query
from pkgscreen.plans.screening import staged_path

_SHOWN = ["inspection_id", "timestamp", "product_name", "manufacturer", "decision", "confidence", "compliance_score"]


def _over(key, job, name="inspections"):
    QUERIES[key] = lambda spark, sf: job(table(spark, sf, name))


_over("recent_inspections", lambda d: r.recent(d, 50).select(*_SHOWN))
_over("search_inspections", lambda d: r.search(
    d, product="HIGH", manufacturer="mach", violation="r1", decision="NON_COMPLIANT", inspector_status="PENDING",
    date_from="1996-01-01", date_to="2000-12-31", min_confidence=0.55, max_confidence=0.95).select(*_SHOWN))
_over("search_sorted", lambda d: r.search(d, category="food", sort_by="compliance_score", descending=True, limit=100).select(*_SHOWN))
_over("stats_totals", r.stats_totals)
_over("stats_groups", r.stats_groups)
_over("common_violations", lambda d: r.common_violations(d, 10))
_over("manufacturer_trends", lambda d: r.manufacturer_trends(d, 10))
_over("daily_trend", r.daily_trend)
_over("stats_empty", lambda d: r.stats_totals(d.where(F.col("decision") == "NEVER")))
_over("inspector_activity", r.inspector_activity, "decisions")
_over("override_rate", r.override_rate, "decisions")
_over("decision_supersede", lambda d: r.supersede(d).select("decision_id", "inspection_id", "supersedes", "superseded"), "decisions")
_over("current_decisions", lambda d: r.current_decisions(d).select("inspection_id", "decision_id", "inspector_id", "action", "final_decision"), "decisions")
_over("audit_read", lambda d: r.read_audit(d, action="purchase", n=200).select("id", "action", "actor", "details"), "audit_log")
_over("review_queue", lambda d: r.pending_queue(d, "confidence", 100).select(*_SHOWN, "tier"))
_over("queue_bucket", lambda d: d.select("inspection_id", r.queue_bucket("confidence").alias("tier")))


@query("decision_validation")
def decision_validation(spark, sf):
    return r.validate_decisions(table(spark, sf, "submissions"), table(spark, sf, "inspections")).select(
        "decision_id", "error", "recorded_action", "recorded_decision")


@query("inspections_reviewed")
def inspections_reviewed(spark, sf):
    return r.apply_decisions(table(spark, sf, "inspections"), table(spark, sf, "decisions")).select(
        "inspection_id", "decision", "inspector_status", "final_decision")


@query("audit_trail")
def audit_trail(spark, sf):
    return r.audit_trail(*[table(spark, sf, n) for n in ("inspections", "decisions", "audit_log")]).select(
        "inspection_id", "entry", "entry_id", "detail", "current", F.date_format("at", "yyyy-MM-dd").alias("day"))


@query("audit_nested")
def audit_nested(spark, sf):
    trail = r.nested_trail(r.audit_trail(*[table(spark, sf, n) for n in ("inspections", "decisions", "audit_log")]))
    return trail.select("inspection_id", "entries", "verdict", "current_decision", F.size("history").cast("long").alias("shown"), F.element_at("history", -1)["entry"].alias("last_entry"))


@query("inspections_upsert")
def inspections_upsert(spark, sf):
    rows = table(spark, sf, "inspections")
    stored = rows.where("decision <> 'COMPLIANT'")
    incoming = rows.where("decision <> 'NON_COMPLIANT'").withColumns({
        "confidence": F.lit(0.25), "inspector_status": F.lit("PENDING"), "final_decision": F.lit(None).cast("string")})
    return r.upsert_inspections(stored, incoming).select("inspection_id", "decision", "confidence", "inspector_status", "final_decision")


@query("payload_roundtrip")
def payload_roundtrip(spark, sf):
    rows = table(spark, sf, "inspections")
    return r.from_payload(r.to_payload(rows, "inspection_id"), rows.schema)


@query("payload_lookup")
def payload_lookup(spark, sf):
    """Payloads of the inspections that the decisions name, from the bucketed store."""
    rows = table(spark, sf, "inspections")
    path = staged_path(spark, "payloads", sf, lambda p: r.store_payloads(r.to_payload(rows, "inspection_id"), p))
    found = r.find_payloads(table(spark, sf, "decisions").selectExpr("CAST(inspection_id AS BIGINT) AS inspection_id"), path)
    return found.select("inspection_id", "found", F.get_json_object("payload", "$.decision").alias("decision"))


@query("schema_align")
def schema_align(spark, sf):
    rows = table(spark, sf, "inspections")
    return r.align_schema(rows.drop("brand", "compliance_score"), rows).select("inspection_id", "brand", "compliance_score", "decision")


@query("inspections_by_violation")
def _violations(spark, sf):
    return r.violation_breakdown(table(spark, sf, "inspections"), table(spark, sf, "part_rules").selectExpr(
        "replace(rule_id, 'P', 'R') AS chunk_id", "title AS document", "requirement AS rule_reference", "title"), 10)


QUERIES["violation_breakdown"] = QUERIES.pop("inspections_by_violation")
