"""Connected components of a link table by rounds of joins over written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgscreen.llm.base import drop_path, scratch_path

FOLD_LINKS = 500_000


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task as stars around the smallest node of each piece; folded every FOLD_LINKS links."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def stars() -> pa.RecordBatch:
        u = np.array([x for x in up if root(x) != x], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.array([root(x) for x in u.tolist()], np.int64))], ["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > FOLD_LINKS:
            yield stars()
            up.clear()
    yield stars()


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node is either the centre of a star or hangs on exactly one centre."""
    roles = edges.selectExpr("u AS node", "1 AS child", "0 AS parent").unionAll(edges.selectExpr("v AS node", "0 AS child", "1 AS parent"))
    roles = roles.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return not roles.where("child > 1 OR (child = 1 AND parent = 1)").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b); only linked nodes.

    Each task first folds its own links to stars. Then large-star and small-star
    alternate: every node's neighbours are linked to the smallest of them, so that
    paths shorten by halves, until only stars are left. Centres are found by partial
    minima, so a node with a third of all links is reduced before it is shuffled.
    """
    spark = links.sparkSession
    path = scratch_path(spark, "edges")
    links.where("a <> b").select("a", "b").mapInArrow(_fold, "u long, v long").distinct().write.parquet(path)
    while True:
        now = spark.read.schema("u long, v long").parquet(path)
        if _stars_only(now):
            return now.selectExpr("u AS node", "v AS component").unionAll(now.selectExpr("v AS node", "v AS component").distinct())
        # large star: neighbours above a node link to the node's smallest neighbour
        both = now.unionAll(now.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "c")
        large = both.join(least, both.u == least.c).where("v > c").selectExpr("v AS u", "m AS v").where("u <> v")
        middle = scratch_path(spark, "large")
        large.write.parquet(middle)
        large = spark.read.schema("u long, v long").parquet(middle)
        # small star: a node and its neighbours below link to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        small = large.join(least, large.u == least.c).selectExpr("v AS u", "m AS v").unionAll(least.selectExpr("c AS u", "m AS v")).where("u <> v").distinct()
        after = scratch_path(spark, "small")
        small.write.parquet(after)
        drop_path(spark, middle)
        drop_path(spark, path)
        path = after
