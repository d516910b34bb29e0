"""Queries that run a stream to its end and read the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from pkgscreen.operators import ingest as g
from pkgscreen.plans import fixtures
from pkgscreen.plans.registry import query
from pkgscreen.streaming import feeds


def _derived(spark, sf, name):
    """A derived table over streamed events."""
    events = feeds.follow(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return spark.sql(fixtures.SQL[name], events=events)


@query("stream_ingest")
def stream_ingest(spark, sf):
    docs = g.with_hash(feeds.follow(spark, sf, "documents").withColumn("file_name", F.expr("source || '-' || doc_id || '.txt'")))
    path = feeds.target(spark, "ingest")
    feeds.ingest(docs.select("doc_id", "content_hash", "text"), path)
    return spark.read.parquet(path).select("doc_id", "content_hash")


@query("stream_daily_trend")
def stream_daily_trend(spark, sf):
    path = feeds.target(spark, "trend")
    feeds.keep_trend(_derived(spark, sf, "decisions"), path)
    return feeds.read_trend(spark, path)


@query("stream_audit")
def stream_audit(spark, sf):
    path = feeds.target(spark, "audit")
    feeds.run(_derived(spark, sf, "audit_log"), path)
    return spark.read.parquet(path).select("id", "action", "actor", "details")


@query("stream_current_decision")
def stream_current_decision(spark, sf):
    path = feeds.target(spark, "current")
    feeds.keep_current(_derived(spark, sf, "decisions"), path)
    return feeds.read_current(spark, path).select("inspection_id", "decision_id", "inspector_id", "action", "final_decision")
