"""Checks for stored inspections and decisions."""

from __future__ import annotations

from pkgscreen.oracle.base import check, cte

S = "inspection_id, timestamp, product_name, manufacturer, decision, confidence, compliance_score"
check("recent_inspections", f"SELECT {S} FROM [[inspections]] ORDER BY timestamp DESC NULLS LAST, inspection_id LIMIT 50")
check("search_inspections", f"""SELECT {S} FROM [[inspections]] WHERE contains(lower(product_name), 'high') AND contains(lower(manufacturer), 'mach')
  AND contains(lower(violation_rule_ids), 'r1') AND decision = 'NON_COMPLIANT' AND (inspector_status = 'PENDING' OR inspector_status IS NULL)
  AND timestamp >= '1996-01-01' AND timestamp <= '2000-12-31T23:59:59' AND confidence BETWEEN 0.55 AND 0.95""")
check("search_sorted", f"SELECT {S} FROM [[inspections]] WHERE product_category = 'food' ORDER BY compliance_score DESC NULLS LAST, inspection_id LIMIT 100")
_tot = """SELECT count(*) AS total_inspections, count(*) FILTER (decision = 'COMPLIANT') AS compliant, count(*) FILTER (decision = 'NON_COMPLIANT') AS non_compliant,
  count(*) FILTER (decision = 'MANUAL_REVIEW') AS manual_review, coalesce(round(100.0::DOUBLE * count(*) FILTER (decision = 'COMPLIANT') / nullif(count(*), 0), 1), 0.0::DOUBLE) AS compliance_rate,
  coalesce(round(avg(confidence), 4), 0.0::DOUBLE) AS average_confidence, round(avg(compliance_score), 1) AS average_compliance_score FROM [[inspections]]"""
check("stats_totals", _tot)
check("stats_empty", _tot + " WHERE decision = 'NEVER'")
check("stats_groups", """SELECT 'decision' AS grouping, decision AS name, count(*) AS inspections FROM [[inspections]] GROUP BY ALL
UNION ALL SELECT 'category', coalesce(product_category, 'unknown') AS c, count(*) FROM [[inspections]] GROUP BY c
UNION ALL SELECT 'inspector_status', coalesce(inspector_status, 'PENDING') AS c, count(*) FROM [[inspections]] GROUP BY c""")
cte("viol", "SELECT unnest(string_split(violation_rule_ids, ',')) AS rule_id FROM [[inspections]]")
cte("topviol", "SELECT rule_id, count(*) AS violations FROM [[viol]] WHERE rule_id <> '' GROUP BY rule_id ORDER BY violations DESC, rule_id LIMIT 10")
check("common_violations", "SELECT * FROM [[topviol]]")
check("violation_breakdown", """SELECT t.*, p.title AS document, p.requirement AS rule_reference, p.title FROM [[topviol]] t
LEFT JOIN [[part_rules]] p ON replace(p.rule_id, 'P', 'R') = t.rule_id""")
check("manufacturer_trends", """SELECT trim(coalesce(nullif(manufacturer, ''), 'Unknown')) AS manufacturer, count(*) AS inspections, count(*) FILTER (decision = 'NON_COMPLIANT') AS non_compliant,
  round(100.0::DOUBLE * count(*) FILTER (decision = 'NON_COMPLIANT') / count(*), 1) AS non_compliance_rate FROM [[inspections]] GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
check("daily_trend", """SELECT substr(timestamp, 1, 10) AS day, count(*) AS total, count(*) FILTER (decision = 'COMPLIANT') AS compliant,
  count(*) FILTER (decision = 'NON_COMPLIANT') AS non_compliant, count(*) FILTER (decision = 'MANUAL_REVIEW') AS manual_review FROM [[inspections]] GROUP BY 1""")
cte("hist", """SELECT *, lag(decision_id) OVER w AS supersedes, lead(decision_id) OVER w IS NOT NULL AS superseded FROM [[decisions]]
WINDOW w AS (PARTITION BY inspection_id ORDER BY ts, decision_id)""")
cte("curr", "SELECT * FROM [[hist]] WHERE NOT superseded")
check("inspector_activity", "SELECT inspector_id, count(*) AS decisions FROM [[curr]] GROUP BY 1")
check("override_rate", """SELECT count(*) AS human_reviewed, count(*) FILTER (action = 'OVERRIDE') AS overrides,
  round(100.0::DOUBLE * count(*) FILTER (action = 'OVERRIDE') / count(*), 1) AS override_rate FROM [[curr]]""")
check("decision_supersede", "SELECT decision_id, inspection_id, supersedes, superseded FROM [[hist]]")
check("current_decisions", "SELECT inspection_id, decision_id, inspector_id, action, final_decision FROM [[curr]]")
check("audit_read", "SELECT id, action, actor, details FROM [[audit_log]] WHERE action = 'purchase' ORDER BY id DESC LIMIT 200")
_tier = "CASE WHEN confidence >= 0.90 THEN 'AUTO_ACCEPT' WHEN confidence >= 0.70 THEN 'REVIEW' ELSE 'PRIORITY_REVIEW' END AS tier"
check("review_queue", f"SELECT {S}, {_tier} FROM [[inspections]] WHERE inspector_status = 'PENDING' OR inspector_status IS NULL ORDER BY confidence NULLS LAST, inspection_id LIMIT 100")
check("queue_bucket", f"SELECT inspection_id, {_tier} FROM [[inspections]]")
cte("val", """SELECT s.*, i.decision AS ai, i.inspection_id IS NOT NULL AS known, trim(inspector_id) AS who, upper(trim(action)) AS act, trim(reason) AS why,
  upper(trim(coalesce(s.final_decision, ''))) AS asked FROM [[submissions]] s LEFT JOIN [[inspections]] i ON i.inspection_id = s.inspection_id""")
cte("val2", """SELECT *, CASE WHEN NOT known THEN 'inspection not found' WHEN who = '' THEN 'inspector id missing' WHEN act NOT IN ('ACCEPT', 'OVERRIDE') THEN 'unknown action'
  WHEN why = '' THEN 'reason missing' WHEN act = 'ACCEPT' AND coalesce(final_decision, '') NOT IN ('', ai) THEN 'accept with another verdict'
  WHEN act = 'OVERRIDE' AND asked NOT IN ('COMPLIANT', 'NON_COMPLIANT', 'MANUAL_REVIEW') THEN 'illegal verdict'
  WHEN act = 'OVERRIDE' AND asked <> ai AND length(why) < 10 THEN 'override reason too short' END AS error FROM [[val]]""")
check("decision_validation", """SELECT decision_id, error, CASE WHEN error IS NULL THEN CASE WHEN act = 'OVERRIDE' AND asked <> ai THEN 'OVERRIDE' ELSE 'ACCEPT' END END AS recorded_action,
  CASE WHEN error IS NULL THEN CASE WHEN act = 'ACCEPT' THEN ai ELSE asked END END AS recorded_decision FROM [[val2]]""")
check("inspections_reviewed", """SELECT i.inspection_id, i.decision, coalesce(c.action, i.inspector_status) AS inspector_status, coalesce(c.final_decision, i.final_decision) AS final_decision
FROM [[inspections]] i LEFT JOIN [[curr]] c USING (inspection_id)""")
check("audit_trail", """SELECT inspection_id, 'automated' AS entry, inspection_id AS entry_id, decision AS detail, NULL::BOOLEAN AS current, substr(timestamp, 1, 10) AS day FROM [[inspections]]
UNION ALL SELECT inspection_id, 'decision', decision_id, action || ' ' || final_decision, NOT superseded, strftime(ts, '%Y-%m-%d') FROM [[hist]]
UNION ALL SELECT entity_id, 'audit', id, action, NULL, strftime(ts, '%Y-%m-%d') FROM [[audit_log]]""")
cte("trail", """SELECT inspection_id, 'automated' AS entry, inspection_id AS entry_id, decision AS detail, false AS current, CAST(timestamp AS TIMESTAMP) AS at FROM [[inspections]]
UNION ALL SELECT inspection_id, 'decision', decision_id, action || ' ' || final_decision, NOT superseded, CAST(ts AS TIMESTAMP) FROM [[hist]]
UNION ALL SELECT entity_id, 'audit', id, action, false, CAST(ts AS TIMESTAMP) FROM [[audit_log]]""")
check("audit_nested", """SELECT inspection_id, count(*) AS entries, max(detail) FILTER (entry = 'automated') AS verdict, max(detail) FILTER (current) AS current_decision, least(count(*), 1000) AS shown,
  last(entry ORDER BY "at", entry, entry_id) AS last_entry FROM [[trail]] GROUP BY 1""")
check("inspections_upsert", """SELECT inspection_id, decision, CASE WHEN decision <> 'NON_COMPLIANT' THEN 0.25::DOUBLE ELSE confidence END AS confidence,
  CASE WHEN decision = 'COMPLIANT' THEN 'PENDING' ELSE inspector_status END AS inspector_status, CASE WHEN decision = 'COMPLIANT' THEN NULL ELSE final_decision END AS final_decision FROM [[inspections]]""")
check("payload_roundtrip", "SELECT * FROM [[inspections]]")
check("payload_lookup", """SELECT d.inspection_id, i.inspection_id IS NOT NULL AS found, i.decision
FROM (SELECT DISTINCT CAST(inspection_id AS BIGINT) AS inspection_id FROM [[decisions]]) d LEFT JOIN [[inspections]] i USING (inspection_id)""")
check("schema_align", "SELECT inspection_id, NULL::VARCHAR AS brand, NULL::DOUBLE AS compliance_score, decision FROM [[inspections]]")
