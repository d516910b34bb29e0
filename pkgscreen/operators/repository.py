"""Stored inspections: upsert, search, statistics, decisions and their history."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pkgscreen.config import path_exists, written

SORT_KEYS = ["timestamp", "confidence", "compliance_score", "product_name", "manufacturer", "decision"]
VERDICTS = ["COMPLIANT", "NON_COMPLIANT", "MANUAL_REVIEW"]
MIN_OVERRIDE_REASON = 10


def upsert_inspections(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows replace stored ones; what people decided is kept."""
    human = ["inspector_status", "final_decision"]
    is_new, is_old = F.col("i._new"), F.col("c._old")
    return (current.withColumn("_old", F.lit(True)).alias("c")
            .join(incoming.withColumn("_new", F.lit(True)).alias("i"), "inspection_id", "full_outer")
            .select("inspection_id", *[
                (F.when(is_old, F.col(f"c.{c}")).otherwise(F.col(f"i.{c}")) if c in human
                 else F.when(is_new, F.col(f"i.{c}")).otherwise(F.col(f"c.{c}"))).alias(c)
                for c in current.columns if c != "inspection_id"]))


def recent(inspections: DataFrame, n: int = 50) -> DataFrame:
    return inspections.orderBy(F.col("timestamp").desc_nulls_last(), "inspection_id").limit(n)


def search(inspections: DataFrame, *, product=None, manufacturer=None, brand=None, inspection_id=None, violation=None,
           decision=None, category=None, inspector_status=None, date_from=None, date_to=None, min_confidence=None,
           max_confidence=None, sort_by="timestamp", descending=True, limit=None) -> DataFrame:
    """All given filters hold together; texts match anywhere, in any case."""
    def within(column: str, text: str) -> Column:
        return F.contains(F.lower(F.col(column).cast("string")), F.lit(text.lower()))

    tests = [within(c, t) for c, t in (("product_name", product), ("manufacturer", manufacturer), ("brand", brand),
                                       ("inspection_id", inspection_id), ("violation_rule_ids", violation)) if t]
    if decision:
        tests.append(F.col("decision") == decision)
    if category:
        tests.append(F.col("product_category") == category)
    if inspector_status:
        same = F.col("inspector_status") == inspector_status
        tests.append(same | F.col("inspector_status").isNull() if inspector_status == "PENDING" else same)
    if date_from:
        tests.append(F.col("timestamp") >= date_from)
    if date_to:  # a bare day includes the whole day
        tests.append(F.col("timestamp") <= (date_to + "T23:59:59" if len(date_to) == 10 else date_to))
    if min_confidence is not None:
        tests.append(F.col("confidence") >= min_confidence)
    if max_confidence is not None:
        tests.append(F.col("confidence") <= max_confidence)
    for t in tests:
        inspections = inspections.where(t)
    if limit is None:
        return inspections
    key = F.col(sort_by if sort_by in SORT_KEYS else "timestamp")
    return inspections.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "inspection_id").limit(limit)


def stats_totals(inspections: DataFrame) -> DataFrame:
    """One row; all zero for an empty repository."""
    share = F.try_divide(100.0 * F.count_if(F.col("decision") == "COMPLIANT"), F.count("*"))
    return inspections.agg(
        F.count("*").alias("total_inspections"),
        *[F.count_if(F.col("decision") == d).alias(d.lower()) for d in VERDICTS],
        F.coalesce(F.round(share, 1), F.lit(0.0)).alias("compliance_rate"),
        F.coalesce(F.round(F.avg("confidence"), 4), F.lit(0.0)).alias("average_confidence"),
        F.round(F.avg("compliance_score"), 1).alias("average_compliance_score"))


def stats_groups(inspections: DataFrame) -> DataFrame:
    """Counts by decision, category and review state, in one pass over the rows."""
    groups = (("decision", F.col("decision")), ("category", F.coalesce("product_category", F.lit("unknown"))),
              ("inspector_status", F.coalesce("inspector_status", F.lit("PENDING"))))
    labels = F.array(*[F.struct(F.lit(g).alias("grouping"), n.alias("name")) for g, n in groups])
    return inspections.select(F.inline(labels)).groupBy("grouping", "name").agg(F.count("*").alias("inspections"))


def common_violations(inspections: DataFrame, n: int = 10) -> DataFrame:
    ids = inspections.select(F.explode(F.split("violation_rule_ids", ",")).alias("rule_id")).where("rule_id <> ''")
    return ids.groupBy("rule_id").agg(F.count("*").alias("violations")).orderBy(F.desc("violations"), "rule_id").limit(n)


def manufacturer_trends(inspections: DataFrame, n: int = 10) -> DataFrame:
    name = F.trim(F.coalesce(F.when(F.col("manufacturer") != "", F.col("manufacturer")), F.lit("Unknown")))
    bad = F.count_if(F.col("decision") == "NON_COMPLIANT")
    return (inspections.groupBy(name.alias("manufacturer"))
            .agg(F.count("*").alias("inspections"), bad.alias("non_compliant"),
                 F.round(100.0 * bad / F.count("*"), 1).alias("non_compliance_rate"))
            .orderBy(F.desc("inspections"), "manufacturer").limit(n))


def daily_trend(inspections: DataFrame) -> DataFrame:
    day = F.coalesce(F.expr("nullif(substring(timestamp, 1, 10), '')"), F.lit("unknown"))
    return inspections.groupBy(day.alias("day")).agg(
        F.count("*").alias("total"), *[F.count_if(F.col("decision") == d).alias(d.lower()) for d in VERDICTS])


def current_decisions(decisions: DataFrame) -> DataFrame:
    """The latest decision of each inspection, as an aggregate with map-side combine."""
    rest = [c for c in decisions.columns if c != "inspection_id"]
    latest = F.max_by(F.struct(*rest), F.struct("ts", "decision_id"))
    return decisions.groupBy("inspection_id").agg(latest.alias("d")).select("inspection_id", "d.*")


def supersede(decisions: DataFrame) -> DataFrame:
    """Each decision with the one it replaces and whether it was replaced itself.

    A segmented scan: decisions are range-partitioned by inspection, time and id, so
    one inspection's busy day spreads over tasks as well. Each range links its own
    neighbours as it streams by; then ranges exchange their border rows, one first
    and one last row each.
    """
    keys = ["inspection_id", "ts", "decision_id"]
    schema = decisions.schema
    n = int(decisions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = decisions.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    kind = schema["decision_id"].dataType.simpleString()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    linked = written(dealt.mapInArrow(_neighbours, f"{fields}, part int, row long, before {kind}, after {kind}"), "linked")
    ends = linked.groupBy("part").agg(F.min_by(F.struct("inspection_id", "decision_id"), "row").alias("head"), F.max_by(F.struct("inspection_id", "decision_id"), "row").alias("tail"), F.max("row").alias("last"))
    order = Window.orderBy("part")  # a row a range
    borders = ends.select("part", "last", F.lag("tail").over(order).alias("earlier"), F.lead("head").over(order).alias("later"))
    joined = linked.join(F.broadcast(borders), "part")
    over = lambda side, edge: F.when(edge & F.col(f"{side}.inspection_id").eqNullSafe(F.col("inspection_id")), F.col(f"{side}.decision_id"))
    return joined.select(*decisions.columns, F.coalesce("before", over("earlier", F.col("row") == 0)).alias("supersedes"),
                         F.coalesce("after", over("later", F.col("row") == F.col("last"))).isNotNull().alias("superseded"))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted range with their number and the ids before and after them in the same inspection."""
    held, row = None, 0

    def linked(rows: pa.Table, first: int, before: pa.Scalar | None, drop_last: bool) -> pa.RecordBatch:
        ids, own = rows["decision_id"].combine_chunks(), rows["inspection_id"].to_pylist()
        same = [a == b for a, b in zip(own, own[1:])]
        none = pa.scalar(None, ids.type)
        earlier = pa.array([before.as_py() if before is not None else None] + [i if s else None for i, s in zip(ids[:-1].to_pylist(), same)], ids.type)
        later = pa.array([i if s else None for i, s in zip(ids[1:].to_pylist(), same)] + [none.as_py()], ids.type)
        out = rows.append_column("row", pa.array(range(first, first + len(own)), pa.int64())).append_column("before", earlier).append_column("after", later)
        return (out.slice(0, len(own) - 1) if drop_last else out).combine_chunks()

    before = None  # the id before the held row, if of its inspection
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        if len(rows) > 1:
            yield from linked(rows, row, before, True).to_batches()
            a, b = rows.slice(len(rows) - 2, 2)["inspection_id"].to_pylist()
            before = rows["decision_id"][len(rows) - 2] if a == b else None
            row += len(rows) - 1
        held = rows.slice(len(rows) - 1, 1)
    if held is not None:
        yield from linked(held, row, before, False).to_batches()


def inspector_activity(decisions: DataFrame) -> DataFrame:
    return current_decisions(decisions).groupBy("inspector_id").agg(F.count("*").alias("decisions"))


def override_rate(decisions: DataFrame) -> DataFrame:
    over = F.count_if(F.col("action") == "OVERRIDE")
    return current_decisions(decisions).agg(
        F.count("*").alias("human_reviewed"), over.alias("overrides"),
        F.coalesce(F.round(F.try_divide(100.0 * over, F.count("*")), 1), F.lit(0.0)).alias("override_rate"))


def violation_breakdown(inspections: DataFrame, chunks: DataFrame, n: int = 10) -> DataFrame:
    cite = chunks.select(F.col("chunk_id").alias("rule_id"), "document", "rule_reference", "title")
    return common_violations(inspections, n).join(cite, "rule_id", "left")


def validate_decisions(submissions: DataFrame, inspections: DataFrame) -> DataFrame:
    """Every submission with its outcome: recorded (and how) or refused (and why)."""
    known = inspections.select("inspection_id", F.col("decision").alias("ai_decision"), F.lit(True).alias("known"))
    legal = ", ".join(f"'{d}'" for d in VERDICTS)
    s = submissions.join(known, "inspection_id", "left").withColumns({
        "who": F.trim(F.coalesce("inspector_id", F.lit(""))), "act": F.upper(F.trim(F.coalesce("action", F.lit("")))),
        "why": F.trim(F.coalesce("reason", F.lit(""))), "asked": F.upper(F.trim(F.coalesce("final_decision", F.lit(""))))})
    error = f"""CASE WHEN known IS NULL THEN 'inspection not found' WHEN who = '' THEN 'inspector id missing'
      WHEN act NOT IN ('ACCEPT', 'OVERRIDE') THEN 'unknown action' WHEN why = '' THEN 'reason missing'
      WHEN act = 'ACCEPT' AND final_decision <> '' AND final_decision <> ai_decision THEN 'accept with another verdict'
      WHEN act = 'OVERRIDE' AND asked NOT IN ({legal}) THEN 'illegal verdict'
      WHEN act = 'OVERRIDE' AND NOT (asked <=> ai_decision) AND length(why) < {MIN_OVERRIDE_REASON} THEN 'override reason too short'
      WHEN act = 'ACCEPT' AND (ai_decision IS NULL OR ai_decision NOT IN ({legal})) THEN 'no automated verdict' END"""
    return (s.withColumn("error", F.expr(error))
            .withColumn("recorded_action", F.expr("CASE WHEN error IS NULL THEN IF(act = 'OVERRIDE' AND asked <> ai_decision, 'OVERRIDE', 'ACCEPT') END"))
            .withColumn("recorded_decision", F.expr("CASE WHEN error IS NULL THEN IF(act = 'ACCEPT', ai_decision, asked) END")))


def apply_decisions(inspections: DataFrame, decisions: DataFrame) -> DataFrame:
    now = current_decisions(decisions).select("inspection_id", F.col("action").alias("_status"), F.col("final_decision").alias("_final"))
    return (inspections.join(now, "inspection_id", "left")
            .withColumns({"inspector_status": F.coalesce("_status", "inspector_status"), "final_decision": F.coalesce("_final", "final_decision")})
            .drop("_status", "_final"))


def read_audit(log: DataFrame, entity_id=None, actor=None, action=None, n: int = 200) -> DataFrame:
    for column, wanted in (("entity_id", entity_id), ("actor", actor), ("action", action)):
        if wanted is not None:
            log = log.where(F.col(column) == wanted)
    return log.orderBy(F.desc("id")).limit(n)


def audit_trail(inspections: DataFrame, decisions: DataFrame, log: DataFrame) -> DataFrame:
    """Everything that happened to an inspection, as one flat history.

    Rows instead of one nested value per inspection: a busy inspection then never
    has to fit in one row or one task.
    """
    verdicts = inspections.selectExpr("inspection_id", "'automated' AS entry", "inspection_id AS entry_id", "decision AS detail", "CAST(timestamp AS TIMESTAMP_NTZ) AS at", "CAST(NULL AS BOOLEAN) AS current")
    people = supersede(decisions).selectExpr("inspection_id", "'decision' AS entry", "decision_id AS entry_id", "action || ' ' || final_decision AS detail", "ts AS at", "NOT superseded AS current")
    entries = log.selectExpr("entity_id AS inspection_id", "'audit' AS entry", "id AS entry_id", "action AS detail", "ts AS at", "CAST(NULL AS BOOLEAN) AS current")
    return verdicts.unionByName(people).unionByName(entries)


def queue_bucket(column: str, review: float = 0.70, accept: float = 0.90) -> Column:
    c = F.col(column)
    return F.when(c >= accept, "AUTO_ACCEPT").when(c >= review, "REVIEW").otherwise("PRIORITY_REVIEW")


def pending_queue(inspections: DataFrame, sort_by: str = "confidence", n: int = 100) -> DataFrame:
    weakest_first = sort_by in ("confidence", "compliance_score")
    found = search(inspections, inspector_status="PENDING", sort_by=sort_by, descending=not weakest_first, limit=n)
    return found.withColumn("tier", queue_bucket("confidence"))


def detection_rates(fields: DataFrame) -> DataFrame:
    hit = F.count("value")
    return fields.groupBy("field").agg(
        hit.alias("found"), F.count("*").alias("total"), F.round(100.0 * hit / F.count("*"), 1).alias("rate"))


def decision_counts(inspections: DataFrame) -> DataFrame:
    """How many packages got each verdict, with their share of all."""
    counts = inspections.groupBy(F.coalesce("decision", F.lit("NONE")).alias("decision")).agg(F.count("*").alias("packages"))
    return counts.withColumn("share", F.round(100.0 * F.col("packages") / F.sum("packages").over(Window.partitionBy()), 1))


def trail_of(trail: DataFrame, inspection_id) -> DataFrame:
    """The history of one inspection, oldest first."""
    return trail.where(F.col("inspection_id") == inspection_id).orderBy("at", "entry", "entry_id")


def nested_trail(trail: DataFrame, most: int = 1000) -> DataFrame:
    """One row per inspection: its verdict, current decision and the latest ``most`` entries, nested; ``entries`` counts all."""
    newest = F.row_number().over(Window.partitionBy("inspection_id").orderBy(F.desc("at"), F.desc("entry"), F.desc("entry_id")))
    own = F.struct("at", "entry", "entry_id", "detail", "current")
    kept = trail.withColumn("n", newest).where(F.col("n") <= most).groupBy("inspection_id").agg(F.array_sort(F.collect_list(own)).alias("history"))
    whole = trail.groupBy("inspection_id").agg(F.count("*").alias("entries"), F.max(F.when(F.col("entry") == "automated", F.col("detail"))).alias("verdict"), F.max(F.when(F.col("current"), F.col("detail"))).alias("current_decision"))
    return whole.join(kept, "inspection_id")


def align_schema(df: DataFrame, target: DataFrame) -> DataFrame:
    """Columns a stored table does not have yet are null."""
    return target.limit(0).unionByName(df, allowMissingColumns=True)


def to_payload(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("payload"))


def from_payload(stored: DataFrame, schema) -> DataFrame:
    return stored.select(F.from_json("payload", schema).alias("p")).select("p.*")


PAYLOAD_BUCKETS = 64


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _touched(rows: DataFrame) -> list[int]:
    """Bucket numbers of the rows, as values that prune folders; no more than there are buckets."""
    return [r.bucket for r in rows.select("bucket").distinct().collect()]


def store_payloads(payloads: DataFrame, path: str, key: str = "inspection_id", buckets: int = PAYLOAD_BUCKETS) -> None:
    """Payloads by id in buckets of its hash, sorted inside and with Bloom filters, so that a lookup opens few files.

    Ids that come again replace what is stored: a bucket that gets rows is written
    anew, the others are left as they are.
    """
    spark = payloads.sparkSession
    latest = payloads.select(_bucket(key, buckets).alias("bucket"), key, "payload")
    if path_exists(spark, path):
        stored = read_payloads(spark, path, payloads.schema[key].dataType.simpleString(), key)
        kept = stored.where(F.col("bucket").isin(_touched(latest))).join(latest.select("bucket", key), ["bucket", key], "left_anti")
        latest = written(latest.unionByName(kept.select(*latest.columns)), "payloads")
    writer = latest.repartition("bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option(f"parquet.bloom.filter.enabled#{key}", "true").partitionBy("bucket").parquet(path)


def read_payloads(spark: SparkSession, path: str, kind: str = "long", key: str = "inspection_id") -> DataFrame:
    return spark.read.schema(f"{key} {kind}, payload string, bucket int").parquet(path)


def get_payload(spark: SparkSession, path: str, wanted: int, key: str = "inspection_id", buckets: int = PAYLOAD_BUCKETS) -> DataFrame:
    """The stored payload of one id, read from its bucket only."""
    at = spark.range(1).select(F.lit(wanted).alias(key)).select(_bucket(key, buckets)).first()[0]
    return read_payloads(spark, path, key=key).where((F.col("bucket") == at) & (F.col(key) == wanted)).select(key, "payload")


def find_payloads(ids: DataFrame, path: str, key: str = "inspection_id", buckets: int = PAYLOAD_BUCKETS) -> DataFrame:
    """Each id with its payload and whether it is stored; only buckets of these ids are read."""
    spark, kind = ids.sparkSession, ids.schema[key].dataType.simpleString()
    asked = ids.select(key).distinct().withColumn("bucket", _bucket(key, buckets))
    stored = read_payloads(spark, path, kind, key).where(F.col("bucket").isin(_touched(asked))).select("bucket", key, "payload")
    return asked.join(stored, ["bucket", key], "left").select(key, "payload", F.col("payload").isNotNull().alias("found"))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
