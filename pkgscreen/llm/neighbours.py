"""Approximate nearest neighbours by learned partitions.

``fit`` takes a bounded sample of distinct vectors (``SAMPLE`` rows, smallest
hashed ids), builds their exact neighbour graph, splits the graph into equally
large parts by recursive bisection (each cut at the median of the slowest mode
of a random walk on the graph, so few neighbours are parted), and trains a small
softmax classifier from vector to the parts of its neighbours. The number of
probed parts is the smallest that finds ``TARGET`` of the sample's neighbours.
``search`` puts every row in its most probable part, sends each query to its
most probable parts and reranks by exact cosine in double precision.

Equal vectors are collapsed first, losslessly for k results: of each distinct
vector the k + 1 smallest ids suffice. Parts are cut into blocks of rows and of
queries, so neither a large part nor many queries meet in one task.

Defined results: vectors that are null, zero, of another length than the
commonest, or hold null or non-finite components take no part; null ids neither;
rows that repeat an id keep one vector (the one with the smallest hash); ties go to the smaller id; fewer than k candidates are all
returned; an empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pkgscreen.llm.base import written

SAMPLE = 8192
NEIGHBOURS = 10
TARGET = 0.95
ROWS_PER_PART = 2048
MAX_PARTS = 256
BLOCK = 8192
SEED = 5


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles) of the rows that take part, one per id."""
    finite = F.expr("size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = CAST('Infinity' AS DOUBLE)) AND exists(embedding, x -> x <> 0)")
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("v") == (length[0][0] if length else 0))
    return rows.groupBy("vec_id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """rep (smallest id), v, ids (the k + 1 smallest ids, ascending) of each distinct vector."""
    key = rows.withColumn("h", F.struct(F.xxhash64("v"), F.xxhash64(F.lit(7), "v")))
    few = key.withColumn("place", F.row_number().over(Window.partitionBy("h").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    return few.groupBy("h").agg(F.min("vec_id").alias("rep"), F.min_by("v", "vec_id").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """(n, k) the k most similar other rows of each unit row."""
    n, x = len(x), x.astype(np.float32)
    k = min(k, n - 1)
    out = np.zeros((n, k), np.int64)
    for i in range(0, n, block):
        s = x[i:i + block] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i:i + block] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(graph: np.ndarray, x: np.ndarray, depth: int, rng: np.random.Generator) -> np.ndarray:
    """Part of each node: ``depth`` levels of bisection into halves of equal size."""
    n, k = graph.shape
    part = np.zeros(n, np.int64)
    a, b = np.repeat(np.arange(n), k), graph.reshape(-1)
    for _ in range(depth):
        same = part[a] == part[b]
        i, j = np.concatenate([a[same], b[same]]), np.concatenate([b[same], a[same]])
        degree = np.bincount(i, minlength=n) + 1.0
        size = np.bincount(part)
        axis = rng.normal(size=x.shape[1])
        f = x @ axis
        for _ in range(30):  # a lazy walk damps all but the slowest mode; the constant one is taken out
            f -= (np.bincount(part, f * degree) / np.bincount(part, degree))[part]
            f = 0.5 * f + 0.5 * (np.bincount(i, f[j], n) + f) / degree
            f /= np.sqrt(np.bincount(part, f * f) / size)[part] + 1e-12
        order = np.lexsort((f, part))
        place = np.arange(n) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        upper = np.zeros(n, np.int64)
        upper[order] = place >= np.repeat(size, size) // 2
        part = 2 * part + upper
    return part


@dataclass(frozen=True)
class Router:
    weight: np.ndarray
    bias: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return _unit(x) @ self.weight + self.bias


def train(x: np.ndarray, soft: np.ndarray, rng: np.random.Generator, epochs: int = 25, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on soft labels by Adam."""
    n, d = x.shape
    p = [np.zeros((d, soft.shape[1])), np.zeros(soft.shape[1])]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            at = order[i:i + batch]
            z = x[at] @ p[0] + p[1]
            z = np.exp(z - z.max(1, keepdims=True))
            g = (z / z.sum(1, keepdims=True) - soft[at]) / len(at)
            t += 1
            for q, grad, mm, vv in zip(p, (x[at].T @ g, g.sum(0)), m, v):
                mm += 0.1 * (grad - mm)
                vv += 0.001 * (grad * grad - vv)
                q -= 0.1 * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
    return p[0], p[1]


def fit(reps: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Router | None:
    """Partition and router from a bounded sample of distinct vectors; None without vectors."""
    n = reps.count()
    rows = reps.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(sample).toPandas()  # at most `sample` vectors
    if not n:
        return None
    rng, x = np.random.default_rng(seed), _unit(np.stack(rows["v"].to_numpy()).astype(float))
    depth = int(np.clip(np.ceil(np.log2(max(1, n / ROWS_PER_PART))), 0, np.log2(max(1, min(MAX_PARTS, len(x) // 32)))))
    if depth == 0:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), 1)
    graph = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(graph, x, depth, rng)
    soft = np.zeros((len(x), 1 << depth))
    for column in [np.arange(len(x)), *graph.T]:
        np.add.at(soft, (np.arange(len(x)), part[column]), 1 / (graph.shape[1] + 1))
    weight, bias = train(x, soft, rng)
    logits = x @ weight + bias
    own = logits.argmax(1)
    rank = np.empty_like(logits, dtype=np.int64)
    np.put_along_axis(rank, np.argsort(-logits, axis=1, kind="stable"), np.arange(1 << depth)[None, :], 1)
    needed = np.sort(np.take_along_axis(rank, own[graph], 1).reshape(-1))
    probes = int(needed[int(np.ceil(TARGET * len(needed))) - 1]) + 1
    return Router(weight, bias, probes)


def _router(router: Router, top: int):
    def route(frames):
        for f in frames:
            if not len(f):
                continue
            z = router.logits(np.stack(f["v"].to_numpy()))
            best = np.argsort(-z, axis=1, kind="stable")[:, :top].astype(np.int32)
            yield f.assign(parts=list(best))

    return route


def cosine(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosine of rows with rows; each pair's sums run in the same order wherever it is computed."""
    return (q * c).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((c * c).sum(1)))


def _searcher(k: int):
    def search(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(queries) or not len(rows):
            return none
        c, ids = np.stack(rows["v"].to_numpy()), rows["id"].to_numpy()
        u, out, n = _unit(c), [], min(k + 4, len(rows))
        for i in range(0, len(queries), 512):
            q = np.stack(queries["v"].to_numpy()[i:i + 512])
            s = _unit(q) @ u.T
            near = np.argpartition(-s, n - 1, axis=1)[:, :n]
            # everything as near as the last of the shortlist, up to rounding, stays for the exact measure
            edge = np.take_along_axis(s, near, 1).min(1) - 1e-12
            a, b = np.nonzero(s >= edge[:, None])
            exact = cosine(q[a], c[b])
            order = np.lexsort((ids[b], -exact, a))
            a, b, exact = a[order], b[order], exact[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            keep = place < k + 1
            out.append(pd.DataFrame({"query": queries["id"].to_numpy()[i:i + 512][a[keep]], "rep": ids[b[keep]], "score": exact[keep]}))
        return pd.concat(out)

    return search


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of ``vectors`` found for each row of ``queries``, itself apart."""
    stored = written(distinct_vectors(valid(vectors), k), "vectors")
    asked_rows = written(valid(queries).select(F.col("vec_id").alias("query_id"), "v", F.struct(F.xxhash64("v"), F.xxhash64(F.lit(7), "v")).alias("h")), "queries")
    asked = asked_rows.groupBy("h").agg(F.min("query_id").alias("id"), F.min_by("v", "query_id").alias("v"))
    router = fit(stored)
    spark = vectors.sparkSession
    if router is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    routed = "id long, v array<double>, parts array<int>"
    rows = written(stored.select(F.col("rep").alias("id"), "v").mapInPandas(_router(router, 1), routed).selectExpr("id", "v", "parts[0] AS part"), "routed")
    sent = written(asked.select("id", "v").mapInPandas(_router(router, router.probes), routed).select("id", "v", F.explode("parts").alias("part")), "sent")
    sizes = rows.groupBy("part").agg(F.expr(f"CAST(ceil(count(1) / {BLOCK}) AS INT)").alias("rows_n"))
    sizes = sizes.join(sent.groupBy("part").agg(F.expr(f"CAST(ceil(count(1) / {BLOCK}) AS INT)").alias("asked_n")), "part")
    sizes = F.broadcast(written(sizes, "sizes"))  # at most MAX_PARTS rows
    place = "pmod(xxhash64(id), {})"
    rows = rows.join(sizes, "part").selectExpr("id", "v", "part", f"{place.format('rows_n')} AS block", "explode(sequence(0, asked_n - 1)) AS turn")
    sent = sent.join(sizes, "part").selectExpr("id", "v", "part", "explode(sequence(0L, rows_n - 1L)) AS block", f"CAST({place.format('asked_n')} AS INT) AS turn")
    keys = ["part", "block", "turn"]
    found = sent.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(_searcher(k), "query long, rep long, score double")
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).where(F.col("place") <= k + 1)
    best = best.join(stored.select(F.col("rep").alias("r"), "ids"), F.col("rep") == F.col("r"))
    near = best.select("query", "score", F.explode("ids").alias("vec_id")).groupBy("query").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k + 1).alias("near"))
    per_query = asked_rows.select("query_id", "h").join(written(asked.select("h", "id").join(near, F.col("id") == F.col("query")).select(F.col("h").alias("g"), "near"), "near"), F.col("h") == F.col("g"))
    own = per_query.select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("at", "hit"))
    return own.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))
