"""Tables of the shapes the jobs work on, derived by SQL from the given tables.

Every text here is plain SQL that Spark and DuckDB both read, so the SQL checks
start from exactly the same rows. ``table(spark, sf_dir, name)`` builds one for
Spark; ``SQL[name]`` is the text for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pkgscreen import vocab as v

GIVEN = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


_PRICE = "CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS STRING)"

# surface, line, x_min, x_max, row on the photo, text (NULL = line not printed)
LINE_TEMPLATES = [
    (0, 0, 20, 420, 0, "upper(replace(p_brand, '#', '')) || CASE WHEN k % 5 = 0 THEN '' ELSE '(TM)' END"),
    (0, 1, 20, 620, 1, "upper(p_name)"),
    (0, 2, 20, 420, 2, f"CASE WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 0 THEN 'MRP:' WHEN k % 37 = 0 THEN 'Inclusive of all taxes' ELSE 'MRP: Rs. ' || {_PRICE} END"),
    (0, 3, 20, 420, 3, f"CASE WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 0 OR k % 37 = 0 THEN 'Rs. ' || {_PRICE} END"),
    (0, 4, 20, 420, 4, "CASE WHEN k % 13 = 0 THEN 'Net Qty: approx ' || " + _s("p_size * 5") + " || ' oz' "
        "WHEN k % 17 = 0 THEN 'Net Qty: ' || " + _s("p_size * 1000") + " || ' g' "
        "WHEN k % 19 = 0 THEN 'Net Qty: 8 g' WHEN k % 53 = 0 THEN 'Net Qty: 15 g' "
        "WHEN k % 41 = 0 THEN 'Net Qty: approx ' || " + _s("p_size * 5") + " || ' g' "
        "WHEN k % 47 = 0 THEN " + _s("p_size * 5") + " || ' ml' WHEN k % 47 = 1 THEN 'Net Weight' "
        "ELSE 'Net Qty: ' || " + _s("p_size * 5") + " || ' g' END"),
    (0, 5, 20, 420, 5, "CASE WHEN k % 47 = 1 THEN '250 g' END"),
    (1, 0, 20, 420, 0, "CASE WHEN k % 23 = 0 THEN 'Manufactured By:' ELSE 'Manufactured By: ' || p_type || ' Foods Pvt Ltd' END"),
    (1, 1, 20, 420, 1, "CASE WHEN k % 23 = 0 THEN p_type || ' Foods' END"),
    (1, 2, 20, 420, 2, "CASE WHEN k % 46 = 0 THEN 'PRIVATE LIMITED' END"),
    (1, 3, 20, 420, 3, "CASE WHEN k % 6 = 0 THEN NULL ELSE 'Plot ' || " + _s("k % 97 + 1") + " || ', Industrial Estate, 411001' END"),
    (1, 4, 20, 420, 4, "CASE WHEN k % 29 = 0 THEN 'SEE BASE OF CAN FOR MFG DATE' "
        "WHEN k % 10 = 0 THEN 'Mfg Date: ' || lpad(" + _s("k % 12 + 1") + ", 2, '0') || '/2026' "
        "ELSE 'Mfg Date: ' || lpad(" + _s("k % 28 + 1") + ", 2, '0') || '/' || lpad(" + _s("k % 12 + 1") + ", 2, '0') || '/2026' END"),
    (1, 5, 20, 420, 5, "CASE WHEN k % 4 = 0 THEN NULL WHEN k % 25 = 0 THEN 'USE BY 12/04/2027' ELSE 'Best Before: 12 months' END"),
    (1, 6, 20, 120, 6, "CASE WHEN k % 12 = 1 THEN 'PKD' END"),
    (1, 7, 200, 420, 6, "CASE WHEN k % 12 = 1 THEN '05JAN2026' END"),
    (1, 8, 20, 200, 7, "CASE WHEN k % 8 = 0 THEN 'Batch No' ELSE 'Batch No: B' || " + _s("1000 + k % 9000") + " END"),
    (1, 9, 240, 420, 7, "CASE WHEN k % 8 = 0 THEN 'B' || " + _s("1000 + k % 9000") + " END"),
    (1, 10, 20, 420, 8, "CASE WHEN k % 9 = 0 THEN 'Customer Care: care@example.com' WHEN k % 61 = 0 THEN 'info@example.com' "
        "ELSE 'Customer Care: 1800-' || " + _s("200 + k % 700") + " || '-' || " + _s("1000 + k % 9000") + " END"),
    (1, 11, 20, 420, 9, "CASE WHEN k % 14 = 0 THEN 'Country of Origin: China' WHEN k % 15 = 0 THEN NULL ELSE 'Country of Origin: India' END"),
    (1, 12, 20, 420, 10, "'Nutrition per 100 g'"),
    (1, 13, 20, 420, 11, "'Protein ' || " + _s("k % 30") + " || '.5 g'"),
    (1, 14, 20, 420, 13, "CASE WHEN k % 14 = 0 THEN 'Imported By' END"),
    (1, 15, 20, 420, 14, "CASE WHEN k % 28 = 0 THEN 'Store in a cool place' END"),
    (1, 16, 20, 420, 15, "CASE WHEN k % 28 = 0 THEN 'Keep away from sunlight' END"),
    (1, 17, 20, 420, 16, "CASE WHEN k % 28 = 0 THEN 'Handle gently' END"),
    (1, 18, 20, 420, 17, "CASE WHEN k % 42 = 0 THEN 'Harbour Traders' WHEN k % 14 = 0 THEN 'Global Traders Limited' END"),
    (2, 0, 20, 420, 0, "CASE WHEN k % 29 = 0 THEN 'KEEP UPRIGHT' END"),
    (2, 1, 300, 340, 1, "CASE WHEN k % 29 = 0 THEN '120' END"),
    (2, 2, 305, 340, 2, "CASE WHEN k % 29 = 0 THEN " + _s("770 + k % 10") + " END"),
    (2, 3, 298, 340, 3, "CASE WHEN k % 29 = 0 THEN " + _s("k % 89 + 10") + " END"),
    (2, 4, 20, 200, 6, "CASE WHEN k % 203 = 0 THEN 'Rs. 45.00' END"),
    (2, 5, 20, 200, 8, "CASE WHEN k % 29 = 0 THEN '12/03/2026' END"),
]
SURFACE_NAMES = ["front", "back", "base"]
# packages whose photos the recogniser could not read at all, or found empty
_READ = "k % 101 <> 0 AND k % 103 <> 0"


def _lines_sql(spark_dialect: bool) -> str:
    part = "SELECT p_partkey AS k, p_name, p_brand, p_type, p_size, p_retailprice FROM {part}"
    if spark_dialect:  # one scan of the table
        rows = ",\n".join(
            f"named_struct('surface_idx', {s}, 'line_no', {n}, 'x_min', {x0}, 'x_max', {x1}, 'row_no', {r}, 'text', {t})"
            for s, n, x0, x1, r, t in LINE_TEMPLATES)
        body = f"SELECT k, inline(array({rows})) FROM ({part}) p WHERE {_READ}"
    else:
        body = "\nUNION ALL ".join(
            f"SELECT k, {s} AS surface_idx, {n} AS line_no, {x0} AS x_min, {x1} AS x_max, {r} AS row_no, {t} AS text FROM ({part}) p WHERE {_READ}"
            for s, n, x0, x1, r, t in LINE_TEMPLATES)
    names = "CASE surface_idx WHEN 0 THEN 'front' WHEN 1 THEN 'back' ELSE 'base' END"
    return f"""SELECT k AS package_id, surface_idx, {names} AS surface_name, line_no, text,
  CASE WHEN k % 31 = 0 THEN CAST(0.35 AS DOUBLE) ELSE CAST(80 + (k * 7 + line_no) % 20 AS DOUBLE) / 100 END AS confidence,
  x_min, row_no * 60 AS y_min, x_max, row_no * 60 + 44 AS y_max
FROM ({body}) t WHERE text IS NOT NULL"""


_K = "CAST(o_orderkey AS BIGINT)"


def _case(key: str, values: list) -> str:
    """The ``key``-th of ``values``."""
    return f"CASE {key} " + " ".join(f"WHEN {n} THEN '{value}'" for n, value in enumerate(values)) + " END"


_GENERIC = 2 * len(v.FIELDS)  # every declaration under two kinds of rule
_GENERIC_SQL = f"""SELECT 'F' || CAST(j AS STRING) AS rule_id, 'declare the ' || replace(f, '_', ' ') AS requirement,
  CASE j % 3 WHEN 0 THEN 'MANDATORY' WHEN 1 THEN 'MANDATORY_ANY' ELSE 'CONDITIONAL' END AS rule_type,
  CASE WHEN j % 3 = 1 THEN f || ',' || g ELSE f END AS fields,
  CASE f WHEN 'mrp' THEN 'PRESENT_AND_VALID_PRICE' WHEN 'net_quantity' THEN 'PRESENT_AND_VALID_UNIT' ELSE CASE WHEN f LIKE '%date' OR f = 'best_before' THEN 'VALID_DATE' ELSE 'PRESENT' END END AS validation,
  {_case("j % 4", list(v.SEVERITY_WEIGHTS))} AS severity,
  CASE WHEN j % 3 < 2 THEN 'ALWAYS' WHEN j % 2 = 0 THEN 'FIELD_PRESENT' ELSE 'ORIGIN_NOT_INDIA' END AS condition,
  CASE WHEN j % 3 < 2 THEN NULL WHEN j % 2 = 0 THEN f ELSE 'country_of_origin' END AS depends_on, j % 2 = 0 AS verified
FROM (SELECT DISTINCT p_partkey % {_GENERIC} AS j, {_case(f"p_partkey % {_GENERIC} % {len(v.FIELDS)}", v.FIELDS)} AS f,
  {_case(f"(p_partkey % {_GENERIC} + 5) % {len(v.FIELDS)}", v.FIELDS)} AS g FROM {{part}}) r"""


def _statutory_sql() -> str:
    """A rule per kind of check: every category with a handler, every kind outside photo screening, some without either."""
    plain = [c for c in v.CATEGORY_BUCKETS if c not in v.HANDLER_CATEGORIES and c not in ("package_declarations", "exemptions")]
    kinds = [(c, "FIELD_PRESENT") for c in v.HANDLER_CATEGORIES] + [("exemptions", "EXEMPTION_LOOKUP"), ("package_declarations", "REQUIRED_DECLARATIONS_PRESENT")]
    kinds += [(plain[n % len(plain)], kind) for n, kind in enumerate(v.SCOPE_NA_TYPES) if kind != "EXEMPTION_LOOKUP"]
    kinds += [(c, "OTHER_CHECK") for c in plain[::3]] + [(plain[0], "FIELD_PRESENT")] * len(v.SCOPE_NA_RULES)
    own = [[d for d, f in v.DECLARED_FIELDS.items() if {*f} & {*v.CATEGORY_FIELDS.get(c, [])}] for c, _ in kinds]
    n, named = len(kinds), len(kinds) - len(v.SCOPE_NA_RULES)
    ids = [f"C{j}" for j in range(named)] + v.SCOPE_NA_RULES
    words = ",".join(v.WORDING_ABBREVIATIONS)
    return f"""SELECT rule_id, category, vtype, severity, 'check ' || CAST(j AS STRING) || ' of ' || replace(category, '_', ' ') AS title, fields,
  CASE category WHEN 'quantity_language' THEN '{words}' ELSE '' END AS phrases,
  CASE WHEN j % 4 = 0 THEN '' ELSE 'as ' || lower(replace(vtype, '_', ' ')) || ' says' END AS requirement,
  CASE WHEN j % 3 = 0 THEN NULL ELSE 'packages of kind ' || CAST(j % 5 AS STRING) END AS applicability,
  CASE WHEN j % 5 = 0 THEN '' ELSE 'quoted from part ' || CAST(j AS STRING) END AS evidence_text
FROM (SELECT j, {_case("j", ids)} AS rule_id, {_case("j", [c for c, _ in kinds])} AS category, {_case("j", [k for _, k in kinds])} AS vtype,
  {_case("j % 4", list(v.SEVERITY_WEIGHTS))} AS severity, {_case("j", [d[j % len(d)] if d else "" for j, d in enumerate(own)])} AS fields
  FROM (SELECT DISTINCT p_partkey % {n} AS j FROM {{part}}) k) r"""

# names of other fixtures in braces are resolved before the given tables
SQL: dict[str, str] = {
    "lines": _lines_sql(False),
    "surface_metrics": """SELECT k AS package_id, s AS surface_idx,
  CASE s WHEN 0 THEN 'front' WHEN 1 THEN 'back' ELSE 'base' END AS surface_name,
  CAST(40 + (k * 13 + s) % 400 AS DOUBLE) AS blur, CAST(30 + (k * 3) % 225 AS DOUBLE) AS brightness,
  CAST(20 + k % 60 AS DOUBLE) AS contrast, CAST(k % 25 AS DOUBLE) / 100 AS glare, CAST(k % 40 AS DOUBLE) / 100 AS skew,
  CASE WHEN k % 101 = 0 THEN 'recogniser could not start' END AS ocr_error
FROM (SELECT p_partkey AS k, 0 AS s FROM {part} UNION ALL SELECT p_partkey, 1 FROM {part}
      UNION ALL SELECT p_partkey, 2 FROM {part} WHERE p_partkey % 29 = 0) p""",
    "inspections": f"""SELECT {_K} AS inspection_id, substr(CAST(o_orderdate AS STRING), 1, 10) || 'T00:00:00' AS timestamp,
  o_orderpriority AS product_name, CASE WHEN o_orderkey % 3 = 0 THEN c_name END AS brand,
  CASE WHEN o_orderkey % 20 = 0 THEN NULL WHEN o_orderkey % 33 = 0 THEN ' ' || c_mktsegment || ' ' ELSE c_mktsegment END AS manufacturer,
  CASE o_orderkey % 5 WHEN 0 THEN 'food' WHEN 1 THEN 'beverage' WHEN 2 THEN 'cosmetic' WHEN 3 THEN NULL ELSE 'unknown' END AS product_category,
  CASE o_orderstatus WHEN 'F' THEN 'NON_COMPLIANT' WHEN 'O' THEN 'COMPLIANT' ELSE 'MANUAL_REVIEW' END AS decision,
  CASE WHEN o_orderkey % 17 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(50 + o_orderkey % 50 AS DOUBLE) / 100 END AS confidence,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey * 37 % 1001 AS DOUBLE) / 10 END AS compliance_score,
  CASE WHEN o_orderstatus <> 'F' THEN '' WHEN o_orderkey % 3 = 0 THEN 'R' || CAST(o_orderkey % 9 AS STRING)
       WHEN o_orderkey % 3 = 1 THEN 'R' || CAST(o_orderkey % 9 AS STRING) || ',R' || CAST(10 + o_orderkey % 7 AS STRING)
       ELSE 'R' || CAST(o_orderkey % 9 AS STRING) || ',R' || CAST(10 + o_orderkey % 7 AS STRING) || ',R' || CAST(20 + o_orderkey % 3 AS STRING) END AS violation_rule_ids,
  CASE o_orderkey % 4 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'OVERRIDE' WHEN 2 THEN 'PENDING' END AS inspector_status,
  CASE o_orderkey % 4 WHEN 0 THEN CASE o_orderstatus WHEN 'F' THEN 'NON_COMPLIANT' WHEN 'O' THEN 'COMPLIANT' ELSE 'MANUAL_REVIEW' END
       WHEN 1 THEN 'MANUAL_REVIEW' END AS final_decision
FROM {{orders}} o LEFT JOIN {{customer}} c ON o.o_custkey = c.c_custkey""",
    # what inspectors submit: some rows are valid, some must be refused
    "submissions": """SELECT event_id AS decision_id, user_id AS inspection_id,
  CASE WHEN event_id % 37 = 0 THEN ' ' ELSE 'insp-' || CAST(event_id % 12 AS STRING) END AS inspector_id,
  CASE event_type WHEN 'view' THEN ' accept ' WHEN 'purchase' THEN 'OVERRIDE' WHEN 'click' THEN 'override' WHEN 'signup' THEN 'ACCEPT' ELSE 'SKIP' END AS action,
  CASE WHEN event_id % 29 = 0 THEN '' WHEN value < 20 THEN 'ok' ELSE 'the printed text differs from the record' END AS reason,
  CASE event_type WHEN 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'COMPLIANT' WHEN 1 THEN 'non_compliant' ELSE 'MANUAL_REVIEW' END
       WHEN 'click' THEN CASE event_id % 2 WHEN 0 THEN 'UNSURE' ELSE 'NON_COMPLIANT' END WHEN 'signup' THEN 'COMPLIANT' END AS final_decision,
  ts
FROM {events}""",
    # every recorded decision, before any is superseded
    "decisions": """SELECT event_id AS decision_id, user_id AS inspection_id, 'insp-' || CAST(event_id % 12 AS STRING) AS inspector_id,
  CASE WHEN event_type = 'purchase' OR event_id % 7 = 0 THEN 'OVERRIDE' ELSE 'ACCEPT' END AS action,
  CASE event_id % 3 WHEN 0 THEN 'COMPLIANT' WHEN 1 THEN 'NON_COMPLIANT' ELSE 'MANUAL_REVIEW' END AS final_decision, ts
FROM {events}""",
    "audit_log": """SELECT event_id AS id, event_type AS action, CAST(user_id AS STRING) AS actor, user_id AS entity_id, props AS details, ts
FROM {events}""",
    "log_lines": """SELECT event_id AS line_no, CASE WHEN event_id % 10 = 0 THEN 'plain line ' || CAST(event_id AS STRING) ELSE props END AS line
FROM {events}""",
    "search_queries": """SELECT item_id AS query_id, CASE WHEN item_id % 5 = 0 THEN 'what is ' || text ELSE text END AS query,
  CASE WHEN item_id % 4 = 0 THEN 10 ELSE 5 END AS k FROM {benchmark}""",
    # one vector per text block: the first block of the document with that number
    "vectors": """SELECT vec_id * 1000000 AS chunk_id, CASE WHEN label >= 8 THEN 'image' ELSE 'text' END AS chunk_type, embedding
FROM {embeddings}""",
    "query_vectors": """SELECT vec_id AS query_id, embedding FROM {embeddings}""",
    # answers of the outside search and of the reranking model, as columns
    "external_hits": """SELECT item_id AS query_id, -(p.page_id + 1) AS chunk_id, p.url, p.html AS content, CAST(0.9 AS DOUBLE) AS score
FROM {benchmark} b JOIN {pages} p ON p.page_id % 40 = b.item_id % 40""",
    "files": """SELECT 'in/' || CASE WHEN page_id % 3 = 0 THEN '' ELSE 'pack' || CAST(page_id % 23 AS STRING) || '/' END || 'img' || CAST(page_id AS STRING)
    || CASE page_id % 7 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.txt' WHEN 3 THEN '.bmp' WHEN 4 THEN '.jpeg' WHEN 5 THEN '' ELSE '.gif' END AS path,
  CASE page_id % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'IMAGE/PNG' WHEN 2 THEN 'text/html' WHEN 3 THEN '' ELSE NULL END AS content_type,
  CASE WHEN page_id % 11 = 0 THEN 0 WHEN page_id % 13 = 0 THEN 20971521 WHEN page_id % 17 = 0 THEN 20971520 ELSE CAST(length(html) AS BIGINT) END AS size_bytes
FROM {pages}""",
    # the rules of the screening jobs: kinds, declarations and conditions by key arithmetic
    "generic_rules": _GENERIC_SQL,
    "statutory_rules": _statutory_sql(),
    # rule tables that grow with the data: one rule per part, ten sizes of ruleset
    "part_rules": """SELECT p_partkey % 97 AS ruleset_id, 'P' || CAST(p_partkey AS STRING) AS rule_id, upper(p_name) AS title,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS requirement, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS applicability,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name || ' ' || p_type END AS evidence_text,
  CASE p_partkey % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE 'OTHER' END AS severity,
  p_partkey % 194 <> 3 AS verified, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size END AS page
FROM {part}""",
}
_SPARK_SQL = {"lines": _lines_sql(True)}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DEALT = {"lines": ("part", "p_partkey"), "surface_metrics": ("part", "p_partkey")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = _SPARK_SQL.get(name, SQL[name])
    used = {t: read(spark, sf_dir, t) for t in GIVEN if "{" + t + "}" in text}
    if name in _DEALT:  # a million parts are one small file, which one task would read and turn into all their lines
        given, key = _DEALT[name]
        used[given] = used[given].repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)
    return spark.sql(text, **used)


def check_sql(name: str) -> str:
    return SQL[name].format(**{t: t for t in GIVEN})
