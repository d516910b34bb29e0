"""Exact nearest vectors of many queries by blocks on both sides, with bounds that skip blocks.

Stored vectors are dealt into cells around seed vectors (the smallest id hashes, at
most ``CELLS`` of them, whatever the table's size). A cell's radius r, the largest
distance of its vectors from the seed c, bounds every inner product there: for a
query q of length 1, q.x <= q.c + r. Each query is scored in its most promising
cells first; the k-th best score found is a floor, and only cells whose bound
reaches it are scored in full.

Queries stay distributed. Cells are packed into groups of many vectors, and a query
is sent once to every group that holds a cell it needs: each side's rows are copied
to the parts of the other, so what is exchanged grows with rows times parts of at
most ``PART_VALUES`` numbers, not with pairs of query and cell. A part's cells are
skipped by their bounds; the others are one product in single precision, which only
chooses what may reach the floor, and that is scored in double precision. A part
leaves at most k rows (and ties) per query. The plan is the same for any number of queries.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pkgscreen.config import written

CELLS = 256
VECTORS_PER_CELL = 256  # no more cells than keep this many vectors in each, on average
QUERY_PART, VECTOR_PART = 65_536, 65_536  # most rows of a part
PART_VALUES = 2 ** 22  # most numbers of a part
LEAST_PART = 2048  # rows of a part that are not cut further for the cores' sake
TASKS_PER_CORE = 4
CROWD = 16  # times k: with more vectors of a cell at a query's floor, they are chosen by their order
FIRST_TIMES = 4  # vectors looked at first, for each result asked for
DIGITS = 9  # equal vectors tie whatever the order of summation
MARGIN = 1e-6
SLICE = 256  # queries of a group scored at once


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1, norm)


def _matrix(column) -> np.ndarray:
    return np.stack(column).astype("float64")


def into_cells(vectors: DataFrame, cells: int | None = None) -> tuple[DataFrame, pd.DataFrame]:
    """Rows with their ``cell``, written once, and per cell its seed, radius and size (at most CELLS rows)."""
    stored = vectors.select("chunk_id", "embedding").where("embedding IS NOT NULL")
    n = cells or max(1, min(CELLS, stored.count() // VECTORS_PER_CELL))
    chosen = stored.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(n).toPandas()
    seeds = _matrix(chosen["embedding"]) if len(chosen) else np.zeros((1, 1))
    half = (seeds ** 2).sum(axis=1) / 2

    def assign(frames):
        for f in frames:
            if len(f):
                x = _matrix(f["embedding"])
                cell = np.argmax(x @ seeds.T - half, axis=1)
                yield f.assign(cell=cell.astype("int32"), away=np.linalg.norm(x - seeds[cell], axis=1))

    kinds = dict(stored.dtypes)
    rows = written(stored.mapInPandas(assign, f"chunk_id {kinds['chunk_id']}, embedding {kinds['embedding']}, cell int, away double"), "cells")
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).toPandas().sort_values("cell")
    return rows.drop("away"), sizes.assign(seed=[seeds[c] for c in sizes["cell"]])


def cell_bounds(queries: DataFrame, sizes: pd.DataFrame, most: int | None = None) -> DataFrame:
    """(query_id, cell, bound, before): cells of each query by falling bound, with the vectors in those before; only cells with fewer than ``most`` before them."""
    kind = dict(queries.dtypes)["query_id"]
    cells, n, radius = (sizes[c].to_numpy() for c in ("cell", "n", "radius"))
    seeds = np.stack(sizes["seed"]) if len(sizes) else np.zeros((0, 1))

    def bound(frames):
        for f in frames:
            if len(f) and len(cells):
                top = unit(_matrix(f["embedding"])) @ seeds.T + radius
                order = np.argsort(-top, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                row, place = np.nonzero(before < (most or np.inf))
                at = order[row, place]
                yield pd.DataFrame({"query_id": f["query_id"].to_numpy()[row], "cell": cells[at].astype("int32"), "bound": top[row, at], "before": before[row, place]})

    return queries.select("query_id", "embedding").mapInPandas(bound, f"query_id {kind}, cell int, bound double, before long")


def best(ids: np.ndarray, scores: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row, and of what is within ``slack`` of the last."""
    if scores.shape[1] <= k:
        return np.repeat(np.arange(len(scores)), scores.shape[1]), np.tile(np.arange(scores.shape[1]), len(scores))
    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    row, column = np.nonzero(scores >= (edge - slack)[:, None])
    if slack == 0 and len(row) > k * len(scores):  # ties at the edge: the smaller ids
        order = np.lexsort((ids[column], -scores[row, column], row))
        row, column = row[order], column[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, column = row[place < k], column[place < k]
    return row, column


def score_cells(queries: DataFrame, rows: DataFrame, wanted: DataFrame, sizes: pd.DataFrame, k: int, slack: float) -> DataFrame:
    """The best of each query in its wanted cells: (query_id, chunk_id, score), k rows and ties per query and group."""
    spark = rows.sparkSession
    most = max(1, PART_VALUES // len(sizes["seed"].iloc[0])) if len(sizes) else 1
    q_rows, v_rows = min(QUERY_PART, most), min(VECTOR_PART, most)
    known = spark.createDataFrame([(int(c), max(1, math.ceil(n / v_rows))) for c, n in zip(sizes["cell"], sizes["n"])], "cell int, v_parts int")  # at most CELLS rows
    parts = wanted.groupBy("cell").agg(F.ceil(F.count("*") / q_rows).cast("int").alias("q_parts")).join(F.broadcast(known), "cell")
    parts = F.broadcast(parts)  # at most CELLS rows
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = (queries.select("query_id", "embedding").join(wanted.select("query_id", "cell"), "query_id").join(parts, "cell")
            .select("query_id", "embedding", "cell", dealt("query_id", "q_parts").alias("q"), spread("v_parts").alias("v")))
    right = rows.join(parts, "cell").select("chunk_id", "embedding", "cell", dealt("chunk_id", "v_parts").alias("v"), spread("q_parts").alias("q"))
    kinds = dict(queries.dtypes)["query_id"], dict(rows.dtypes)["chunk_id"]

    def score(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(stored):
            q, x, ids = unit(_matrix(asked["embedding"])), _matrix(stored["embedding"]).T, stored["chunk_id"].to_numpy()
            for at in range(0, len(q), SLICE):
                scores = np.round(q[at:at + SLICE] @ x, DIGITS)
                row, column = best(ids, scores, k, slack)
                found.append(pd.DataFrame({"query_id": asked["query_id"].to_numpy()[at + row], "chunk_id": ids[column], "score": scores[row, column]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})

    key = ["cell", "q", "v"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(score, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")


def part_sizes(asked: int, stored: int, values: int, cores: int) -> tuple[int, int]:
    """Rows of a part of queries and of vectors with so many ``values``: as large as memory allows, but enough parts for all cores."""
    tasks = TASKS_PER_CORE * cores
    most = max(1, PART_VALUES // values)
    q_part = min(QUERY_PART, most, max(LEAST_PART, math.ceil(asked / math.sqrt(tasks))))
    v_parts = math.ceil(tasks / max(1, math.ceil(asked / q_part)))
    return q_part, min(VECTOR_PART, most, max(LEAST_PART, math.ceil(stored / v_parts)))


def into_groups(sizes: pd.DataFrame, part: int) -> pd.DataFrame:
    """(cell, group, parts): cells packed into groups of at most ``part`` vectors; a larger cell is dealt over ``parts`` groups from ``group`` on."""
    rows, group, held = [], 0, 0
    for cell, n in zip(sizes["cell"], sizes["n"]):
        parts = max(1, math.ceil(n / part))
        if held and held + n > part:
            group, held = group + 1, 0
        rows.append((int(cell), group, parts))
        group, held = (group + parts, 0) if parts > 1 else (group, held + n)
    return pd.DataFrame(rows, columns=["cell", "group", "parts"]).astype("int32")


def needed_groups(queries: DataFrame, sizes: pd.DataFrame, groups: pd.DataFrame, slack: float) -> DataFrame:
    """Queries (query_id, embedding, floor) with the groups that hold a cell whose bound reaches their floor."""
    seeds, radius = np.stack(sizes["seed"]), sizes["radius"].to_numpy()
    n = int((groups["group"] + groups["parts"]).max())
    holds = np.zeros((len(sizes), n), "float32")
    for at, (first, parts) in enumerate(zip(groups["group"], groups["parts"])):
        holds[at, first:first + parts] = 1

    def choose(frames):
        for f in frames:
            if len(f):
                floor = f["floor"].fillna(-np.inf).to_numpy()
                need = unit(_matrix(f["embedding"])) @ seeds.T + radius >= (floor - slack - MARGIN)[:, None]
                yield f.assign(groups=[np.flatnonzero(row).astype("int32") for row in need.astype("float32") @ holds])

    kinds = dict(queries.dtypes)
    return queries.mapInPandas(choose, f"query_id {kinds['query_id']}, embedding {kinds['embedding']}, floor double, groups array<int>")


def score_groups(queries: DataFrame, rows: DataFrame, sizes: pd.DataFrame, groups: pd.DataFrame, q_part: int, k: int, slack: float) -> DataFrame:
    """What of each query's groups may be among its best (query_id, chunk_id, score): at least its floor, k rows and ties per query and part."""
    spark = rows.sparkSession
    wanted = queries.select("query_id", "embedding", "floor", F.explode("groups").alias("group"))
    parts = F.broadcast(wanted.groupBy("group").agg(F.ceil(F.count("*") / q_part).cast("int").alias("q_parts")))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = wanted.join(parts, "group").withColumn("q", dealt("query_id", "q_parts")).drop("q_parts")
    known = F.broadcast(spark.createDataFrame(groups, "cell int, group int, parts int"))  # at most CELLS rows
    right = rows.join(known, "cell").select("chunk_id", "embedding", "cell", (F.col("group") + dealt("chunk_id", "parts")).alias("group"))
    right = right.join(parts, "group").select("chunk_id", "embedding", "cell", "group", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)).alias("q"))
    kinds = dict(queries.dtypes)["query_id"], dict(rows.dtypes)["chunk_id"]
    bounds = {int(c): (seed, radius) for c, seed, radius in zip(sizes["cell"], sizes["seed"], sizes["radius"])}

    def score(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(stored):
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        stored = stored.sort_values("cell", kind="stable")
        q, x, ids = unit(_matrix(asked["embedding"])), _matrix(stored["embedding"]), stored["chunk_id"].to_numpy()
        least = asked["floor"].fillna(-np.inf).to_numpy() - slack
        place = np.empty(len(ids), "int64")
        place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        cells, first = np.unique(stored["cell"].to_numpy(), return_index=True)
        last = np.append(first[1:], len(ids))
        seeds, radius = np.stack([bounds[c][0] for c in cells]), np.array([bounds[c][1] for c in cells])
        far = np.linalg.norm(x, axis=1).max()
        width = "float32" if far < 1e30 else "float64"
        off = (x.shape[1] + 4) * 6e-8 * far + MARGIN  # what single precision may lose
        x_near, q_near = x.astype(width), q.astype(width)
        found = []
        for at in range(0, len(q), SLICE):
            s, near, low = q[at:at + SLICE], q_near[at:at + SLICE], least[at:at + SLICE]
            need = s @ seeds.T + radius >= (low - MARGIN)[:, None]
            rows_, columns, scores = [], [], []
            for cell in range(len(cells)):
                who, lo, hi = np.flatnonzero(need[:, cell]), first[cell], last[cell]
                if not len(who):
                    continue
                may = near[who] @ x_near[lo:hi].T >= (low[who] - off).astype(width)[:, None]
                row, column = np.divmod(np.flatnonzero(may.ravel()), hi - lo)
                if len(row) > CROWD * k * len(who):
                    full = np.round(s[who] @ x[lo:hi].T, DIGITS)
                    row, column = best(place[lo:hi], full, k, slack)
                    value = full[row, column]
                else:
                    value = np.round(np.einsum("ij,ij->i", s[who[row]], x[lo + column]), DIGITS)
                reach = value >= low[who[row]]
                rows_.append(who[row[reach]])
                columns.append(lo + column[reach])
                scores.append(value[reach])
            if not rows_:
                continue
            row, column, value = np.concatenate(rows_), np.concatenate(columns), np.concatenate(scores)
            order = np.lexsort((place[column], -value, row))
            row, column, value = row[order], column[order], value[order]
            start = np.searchsorted(row, row)
            kth = np.minimum(start + k - 1, len(row) - 1)
            keep = np.arange(len(row)) - start < k
            if slack:
                keep |= value >= np.where(row[kth] == row, value[kth], -np.inf) - slack
            found.append((at + row[keep], column[keep], value[keep]))
        row, column, value = (np.concatenate(part) for part in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[row], "chunk_id": ids[column], "score": value})

    key = ["group", "q"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(score, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, slack: float = 0.0, cells: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``k`` largest inner products of each query of length 1, ties by smaller id.

    With ``slack``, also what scores at most that much below the k-th.
    """
    queries = queries.select("query_id", "embedding").where("embedding IS NOT NULL")
    rows, sizes = into_cells(vectors, cells)
    if not len(sizes):
        return queries.sparkSession.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(rows.dtypes)['chunk_id']}, score double, rank int")
    q_part, v_part = part_sizes(queries.count(), int(sizes["n"].sum()), len(sizes["seed"].iloc[0]), queries.sparkSession.sparkContext.defaultParallelism)
    promising = written(cell_bounds(queries, sizes, FIRST_TIMES * k), "first-cells")
    first = closest(score_cells(queries, rows, promising, sizes, k, 0.0), k, 0.0)
    floor = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    groups = into_groups(sizes, v_part)
    asked = written(needed_groups(queries.join(floor, "query_id", "left"), sizes, groups, slack), "asked-groups")
    return closest(score_groups(asked, rows, sizes, groups, q_part, k, slack), k, slack)


def closest(scored: DataFrame, k: int, slack: float) -> DataFrame:
    """The ``k`` best of each query among scored rows, ties by smaller id; with ``slack``, also what is at most that much below the k-th."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    if slack == 0:
        return ranked.where(F.col("rank") <= k)
    last = ranked.where(F.col("rank") == k).select("query_id", F.col("score").alias("last"))
    return ranked.join(last, "query_id", "left").where(F.col("last").isNull() | (F.col("score") >= F.col("last") - slack)).drop("last")
