"""The append paths as streams; each finishes what is there and can be restarted.

Every stream keeps its own keyed state in the state store of its checkpoint, on
disk (RocksDB), so that what it must remember is spread over the executors and
bounded by a horizon where one is stated. A batch that is run again after a
failure has the same number and the same batch time, and writes the same folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgscreen.config import path_exists, scratch_dir
from pkgscreen.operators import repository as repo

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKET_DIGITS = 2  # of the content hash that name a bucket of the store


def follow(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table, be it one file or a folder of them, as a stream with the schema it was written with.

    The path is a pattern of one name: a stream's plain path would have to be a folder.
    """
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{table}.parquet}}")


def run(stream: DataFrame, path: str, *, mode: str = "append", each=None) -> None:
    """Work through all input that is there; progress and state are kept beside the result."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True)
    writer = writer.foreachBatch(each) if each else writer.format("parquet").option("path", path)
    writer.start().awaitTermination()


def target(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def ingest(docs: DataFrame, path: str, horizon: str = "30 days", late: str = "1 day") -> None:
    """New documents, each content once: the smallest id of the first batch that has it.

    Contents seen within the current ``horizon`` (a calendar-aligned span of batch
    time) are keyed state: a partial ``min_by`` per hash, so a content copied by a
    third of all rows is one row a task. State of a span that ended ``late`` ago is
    dropped. A content that is new to its span is looked up among the stored hashes
    of earlier spans only, in the buckets that the batch touches; in the first span
    nothing stored is read at all.
    """
    rest = [c for c in docs.columns if c != "content_hash"]
    seen = docs.withColumn("seen", F.current_timestamp()).withWatermark("seen", late)
    kept = seen.groupBy("content_hash", F.window("seen", horizon).alias("span")).agg(
        F.min_by(F.struct(*rest), F.struct("seen", "doc_id")).alias("d"), F.min("seen").alias("first"), F.max("seen").alias("last"))

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # a content changed by this batch is new if all its rows are of one batch time
        new = batch.where("first = last").select(F.substring("content_hash", 1, BUCKET_DIGITS).alias("bucket"), "content_hash", "d.*", F.col("span.start").cast("long").alias("span"))
        if path_exists(spark, path):
            kind = new.schema["content_hash"].dataType.simpleString()
            stored = spark.read.schema(f"content_hash {kind}, span long, batch long, bucket string").parquet(path)
            now = new.select("span").distinct().withColumnRenamed("span", "current")  # one row: a batch has one time
            older = stored.where(F.col("batch") != number).join(F.broadcast(now), F.col("span") < F.col("current"))
            new = new.join(older.select("bucket", "content_hash"), ["bucket", "content_hash"], "left_anti")
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("span", "batch", "bucket").parquet(path)

    run(kept, path, mode="update", each=store)


DAY_COUNTS = ("total", *(d.lower() for d in repo.VERDICTS))


def daily_trend(decisions: DataFrame, late: str = "2 days") -> DataFrame:
    """Decisions per day of the event; a day is closed, and later rows are dropped, once the watermark passes it."""
    count = lambda d: F.count_if(F.col("final_decision") == d).alias(d.lower())
    per_day = decisions.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("total"), *[count(d) for d in repo.VERDICTS])
    return per_day.select(F.col("window.start").alias("start"), *DAY_COUNTS)


def keep_trend(decisions: DataFrame, path: str, late: str = "2 days") -> None:
    """Closed days appended as files; open ones stay in the state store."""
    run(daily_trend(decisions, late), path)


def read_trend(spark: SparkSession, path: str) -> DataFrame:
    """Days so far, with whether each is closed: files of the closed ones, and the state of those still open."""
    closed = spark.read.schema(f"start timestamp, {', '.join(f'{c} long' for c in DAY_COUNTS)}").parquet(path)
    state = spark.read.format("statestore").option("path", f"{path}-progress").load()
    # the key holds the window; the value its counts in the order they are aggregated, all of one name, so they are named by place
    named = F.col("value").cast(f"struct<{', '.join(f'{c}: bigint' for c in DAY_COUNTS)}>")
    opened = state.select(F.col("key").cast("struct<window: struct<start: timestamp, end: timestamp>>").alias("k"), named.alias("v")).select(F.col("k.window.start").alias("start"), "v.*")
    days = closed.withColumn("closed", F.lit(True)).unionByName(opened.withColumn("closed", F.lit(False)))
    return days.select(F.date_format("start", "yyyy-MM-dd").alias("day"), *DAY_COUNTS, "closed")


def keep_current(decisions: DataFrame, path: str) -> None:
    """Latest decision per inspection: state per inspection, and per batch a folder with those that changed.

    Decisions may come in any order; the state is the latest by time, then id. Nothing
    that is stored is read or written again.
    """
    rest = [c for c in decisions.columns if c != "inspection_id"]
    latest = decisions.groupBy("inspection_id").agg(F.max_by(F.struct(*rest), F.struct("ts", "decision_id")).alias("d")).select("inspection_id", "d.*")

    def changes(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run(latest, path, mode="update", each=changes)


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The latest decision of every inspection: the last of its changes."""
    changes = spark.read.parquet(path)
    rest = [c for c in changes.columns if c not in ("inspection_id", "batch")]
    return changes.groupBy("inspection_id").agg(F.max_by(F.struct(*rest), "batch").alias("d")).select("inspection_id", "d.*")


def compact_current(spark: SparkSession, path: str, into: str) -> None:
    """The changes so far as one batch folder of a new table, for a reader that should not see the history again."""
    read_current(spark, path).write.mode("overwrite").parquet(f"{into}/batch=-1")
