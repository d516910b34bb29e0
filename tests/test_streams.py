"""Streams over several batches, restarts, copies, late and out-of-order rows."""

import datetime as dt
import uuid

import pytest

from pkgscreen.operators import ingest as g
from pkgscreen.streaming import feeds


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def add(spark, folder, rows, schema):
    """One more file of the stream's input."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{uuid.uuid4().hex}")


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


DOCS = "doc_id long, file_name string, text string"


def test_each_content_is_stored_once_over_batches_and_restarts(spark, folder):
    path = f"{folder}/out"

    def step(rows, **limits):
        add(spark, folder, rows, DOCS)
        docs = g.with_hash(source(spark, folder, DOCS)).select("doc_id", "content_hash", "text")
        feeds.ingest(docs, path, **limits)
        return sorted((r.doc_id, r.text) for r in spark.read.parquet(path).collect())

    assert step([(3, "c", "one"), (2, "b", "one"), (4, "d", "two"), (9, "e", "")]) == [(2, "one"), (4, "two"), (9, "")]
    # a copy in a later batch (and a smaller id) after a restart, and a new content twice
    assert step([(1, "a", "one"), (7, "g", "three"), (6, "f", "three"), (8, "e", "")]) == [(2, "one"), (4, "two"), (6, "three"), (9, "")]
    assert step([(10, "x", "two")]) == [(2, "one"), (4, "two"), (6, "three"), (9, "")]


def test_contents_older_than_the_horizon_are_found_in_the_store(spark, folder):
    path = f"{folder}/out"
    add(spark, folder, [(1, "a", "one"), (2, "b", "two")], DOCS)

    def go():
        feeds.ingest(g.with_hash(source(spark, folder, DOCS)).select("doc_id", "content_hash", "text"), path, horizon="1 second", late="1 second")

    go()
    for rows in ([(3, "c", "one")], [(4, "d", "two"), (5, "e", "three")]):  # each batch in a span of its own
        import time
        time.sleep(1.2)
        add(spark, folder, rows, DOCS)
        go()
    stored = spark.read.parquet(path)
    assert sorted(r.doc_id for r in stored.collect()) == [1, 2, 5]
    assert stored.select("span").distinct().count() >= 2


DECISIONS = "decision_id long, inspection_id long, final_decision string, ts timestamp"


def day(n, hour=0):
    return dt.datetime(2024, 1, n, hour)


def test_a_row_behind_the_watermark_is_dropped_and_open_days_are_read_from_state(spark, folder):
    path = f"{folder}/trend"
    rows = [[(1, 1, "COMPLIANT", day(1)), (2, 1, "NON_COMPLIANT", day(1, 5)), (3, 2, "COMPLIANT", day(2))],
            [(4, 2, "COMPLIANT", day(10))], [(5, 2, "COMPLIANT", day(1, 6)), (6, 2, "MANUAL_REVIEW", day(10, 3))]]
    for part in rows:
        add(spark, folder, part, DECISIONS)
        feeds.keep_trend(source(spark, folder, DECISIONS), path)
    got = {r.day: (r.total, r.compliant, r.non_compliant, r.manual_review, r.closed) for r in feeds.read_trend(spark, path).collect()}
    assert got == {"2024-01-01": (2, 1, 1, 0, True), "2024-01-02": (1, 1, 0, 0, True), "2024-01-10": (2, 1, 0, 1, False)}


def test_current_decision_with_rows_out_of_order_and_a_restart(spark, folder):
    path = f"{folder}/current"
    parts = [[(5, 1, "COMPLIANT", day(5)), (1, 2, "COMPLIANT", day(1))], [(4, 1, "NON_COMPLIANT", day(4)), (6, 1, "MANUAL_REVIEW", day(5))], [(2, 2, "NON_COMPLIANT", day(2)), (7, 3, "COMPLIANT", day(1))]]
    for part in parts:
        add(spark, folder, part, DECISIONS)
        feeds.keep_current(source(spark, folder, DECISIONS), path)
    want = {1: 6, 2: 2, 3: 7}
    assert {r.inspection_id: r.decision_id for r in feeds.read_current(spark, path).collect()} == want
    feeds.compact_current(spark, path, f"{folder}/compact")
    assert {r.inspection_id: r.decision_id for r in feeds.read_current(spark, f"{folder}/compact").collect()} == want
    assert spark.read.parquet(path).where("batch > 0 AND inspection_id = 2").count() == 1  # a batch holds only what it changed


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_is_followed_as_a_file_or_a_folder(spark, folder, files):
    import glob
    import os

    rows = [(n, f"{n}.txt", f"text {n % 4}") for n in range(9)]
    spark.createDataFrame(rows, DOCS).repartition(files).write.parquet(f"{folder}/parts")
    if files == 1:
        os.rename(glob.glob(f"{folder}/parts/*.parquet")[0], f"{folder}/documents.parquet")
    else:
        os.rename(f"{folder}/parts", f"{folder}/documents.parquet")
    path = f"{folder}/out"
    feeds.ingest(g.with_hash(feeds.follow(spark, folder, "documents")).select("doc_id", "content_hash", "text"), path)
    assert sorted(r.doc_id for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3]
