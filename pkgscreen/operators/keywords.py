"""A keyword index with stored statistics and block maxima, and exact top-k search.

Chunks that lie together are a block. The index holds, written once:

- ``terms``: document frequency and weight of every term, so that a search never
  aggregates postings again;
- ``lists``: a row per chunk with its length and its counted terms;
- ``blocks``: a row per term and block with the largest and smallest share any
  posting of the term reaches there, and the postings themselves, at most as many as
  a block has chunks. A task makes them of the chunks it reads: postings are not exchanged.

A set of queries whose words are few enough to be sent round passes once over
``lists``: all scores of a chunk are added up in its row, nothing is exchanged, and
only the best k of each part leave it.

More queries use the maxima. A query's bound for a block is the sum of its terms'
maxima there: no chunk of the block can score more. The blocks of the highest bounds
are scored first; the k-th best score found there is a floor under the final k-th, so
blocks whose bound lies below it hold no result and their postings are not read. Every
pair of query and block is scored at most once, and skipping never changes the answer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pkgscreen import vocab as v
from pkgscreen.config import fits, written
from pkgscreen.functions.text import words

BLOCK_CHUNKS = 64
FIRST_BLOCKS = 2  # blocks scored first, for each result asked for
ASKED_BROADCAST = 100_000  # words of queries that travel to the postings
MARGIN = 1e-8  # sums of shares in another order differ less
PART_BLOCKS = 64  # blocks that a task orders by term at once
SCORED_PAIRS = 1_000_000  # pairs of query and chunk that a task scores at once


@dataclass(frozen=True)
class KeywordIndex:
    terms: DataFrame  # term, df, weight
    maxima: DataFrame  # term, block, most, least
    postings: DataFrame  # term, block, chunk_id, share
    n_blocks: int = 1
    lists: DataFrame | None = None  # chunk_id, length, terms
    mean: float = 0.0  # length of a chunk


def okapi_weight(n, df, floor=None):
    """log odds of a term, negative ones replaced by ``floor``."""
    weight = F.log(n - df + 0.5) - F.log(df + 0.5)
    return weight if floor is None else F.when(weight < 0, floor).otherwise(weight)


def plus_one_weight(n, df, floor=None):
    """log(1 + odds): never negative."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def share(tf, length, mean):
    """What a term's count in a chunk of that length gives; columns or arrays."""
    return tf * (v.BM25_K1 + 1) / (tf + v.BM25_K1 * (1 - v.BM25_B + v.BM25_B * length / mean))


def block_rows(lists: DataFrame, mean: float, block_chunks: int) -> DataFrame:
    """(term, block, most, least, postings) of chunks that lie together, in runs of ``PART_BLOCKS`` blocks ordered by term."""
    kind = dict(lists.dtypes)["chunk_id"]
    each = PART_BLOCKS * block_chunks

    def cut(batches):
        block = TaskContext.get().partitionId() << 32  # a task's blocks are numbered on from here
        for batch in (b.slice(at, each) for b in batches for at in range(0, b.num_rows, each)):
            terms, ids = batch.column("terms"), batch.column("chunk_id")
            row, flat = pc.list_parent_indices(terms).to_numpy(), terms.flatten()
            if len(row):
                gives = share(flat.field("tf").to_numpy(), batch.column("length").to_numpy()[row], mean)
                named = flat.field("term").dictionary_encode()
                by_name = pc.array_sort_indices(named.dictionary)
                place = np.empty(len(by_name), "int64")
                place[by_name.to_numpy()] = np.arange(len(by_name))
                key = place[named.indices.to_numpy()] * PART_BLOCKS + row // block_chunks
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                name, at = np.divmod(key[order][first], PART_BLOCKS)
                held = pa.StructArray.from_arrays([ids.take(pa.array(row[order])), pa.array(gives[order])], ["chunk_id", "share"])
                yield pa.RecordBatch.from_arrays([named.dictionary.take(by_name.take(pa.array(name))), pa.array(block + at), pa.array(np.maximum.reduceat(gives[order], first)),
                                                  pa.array(np.minimum.reduceat(gives[order], first)), pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), "int32"), held)],
                                                 ["term", "block", "most", "least", "postings"])
            block += -(-batch.num_rows // block_chunks)

    return lists.mapInArrow(cut, f"term string, block long, most double, least double, postings array<struct<chunk_id: {kind}, share: double>>")


def write_index(postings: DataFrame, path: str, chunks: DataFrame | None = None, weight=okapi_weight, block_chunks: int = BLOCK_CHUNKS, wordless: bool = True) -> None:
    """Index tables under ``path`` from ``ingest.term_lists`` or postings; blocks by term in each file, so that a term's rows prune by file statistics.

    ``chunks`` (chunk_id, length) says which chunks count, if postings leave out some
    without words; lists without a term count unless ``wordless`` is false. A term's
    negative weight becomes a quarter of the mean over all terms.
    """
    spark = postings.sparkSession
    if "terms" not in postings.columns:
        postings = postings.groupBy("chunk_id", "length").agg(F.collect_list(F.struct("term", "tf")).alias("terms"))
    postings.write.mode("overwrite").parquet(f"{path}/lists")
    lists = spark.read.parquet(f"{path}/lists")
    lists = lists if wordless else lists.where("length > 0")
    n, mean = (lists if chunks is None else chunks).agg(F.count("*"), F.avg("length")).first()
    blocks = max(1, -(-n // block_chunks))
    flat = F.inline("terms")
    frequency = written(lists.select(flat).groupBy("term").agg(F.count("*").alias("df")), "frequency")
    floor = frequency.agg(0.25 * F.avg(weight(F.lit(float(n)), F.col("df")))).first()[0] if n else 0.0
    frequency.withColumn("weight", weight(F.lit(float(n)), F.col("df"), F.lit(floor))).write.mode("overwrite").parquet(f"{path}/terms")
    block_rows(lists, mean, block_chunks).write.mode("overwrite").parquet(f"{path}/blocks")
    spark.range(1).select(F.lit(blocks).cast("long").alias("blocks"), F.lit(float(mean or 0)).alias("mean")).write.mode("overwrite").parquet(f"{path}/size")


def read_index(spark: SparkSession, path: str) -> KeywordIndex:
    listed = spark.read.parquet(f"{path}/blocks")
    return KeywordIndex(spark.read.parquet(f"{path}/terms"), listed.select("term", "block", "most", "least"),
                        listed.select("term", "block", F.inline_outer("postings")), *spark.read.parquet(f"{path}/size").select("blocks").first(),
                        spark.read.parquet(f"{path}/lists"), *spark.read.parquet(f"{path}/size").select("mean").first())


def asked_terms(queries: DataFrame, index: KeywordIndex, cut: str | None = None) -> DataFrame:
    """(query_id, term, weight) of queries; a word counts as often as the query says it."""
    asked = queries.select("query_id", F.explode(F.expr(cut or words("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    return index.terms.join(asked, "term").select("query_id", "term", (F.col("times") * F.col("weight")).alias("weight"))


def block_bounds(asked: DataFrame, index: KeywordIndex) -> DataFrame:
    """(query_id, block, bound): no chunk of the block scores more; a chunk may lack the terms of negative weight."""
    best = F.greatest(F.lit(0.0), F.greatest(F.col("weight") * F.col("most"), F.col("weight") * F.col("least")))
    return index.maxima.join(asked, "term").groupBy("query_id", "block").agg(F.sum(best).alias("bound"))


def score_blocks(asked: DataFrame, index: KeywordIndex, wanted: DataFrame, digits: int = 9) -> DataFrame:
    """Scores of the chunks that share a term with a query, in the wanted (query_id, block) only."""
    pairs = wanted.select("query_id", "block").join(asked, "query_id")
    return (index.postings.join(pairs, ["term", "block"]).groupBy("query_id", "chunk_id")
            .agg(F.round(F.sum(F.col("weight") * F.col("share")), digits).alias("score")))


def all_scores(queries: DataFrame, index: KeywordIndex, cut: str | None = None, digits: int | None = 9) -> DataFrame:
    """Every chunk that shares a word with a query: as many rows as there are such pairs.

    The pairs, far more than the postings, are added up where they arise and not exchanged.
    """
    asked = written(asked_terms(queries, index, cut), "asked")
    return scanned(asked, index, digits=digits) if fits(asked, ASKED_BROADCAST) else _scores(asked, index, digits)


def _scores(asked: DataFrame, index: KeywordIndex, digits: int | None = 9) -> DataFrame:
    score = F.sum(F.col("weight") * F.col("share"))
    return index.postings.join(asked, "term").groupBy("query_id", "chunk_id").agg((score if digits is None else F.round(score, digits)).alias("score"))


class Asked:
    """The words of a few queries, as they are sent to every task: per term its (query, weight) pairs, one behind the other."""

    def __init__(self, asked: DataFrame, mean: float):
        rows = asked.select("query_id", "term", "weight").toArrow().combine_chunks()  # at most ASKED_BROADCAST rows
        self.ids = rows["query_id"].unique()
        self.terms, self.mean = rows["term"].unique(), mean
        term, query = (pc.index_in(rows[c], value_set=known).to_numpy() for c, known in (("term", self.terms), ("query_id", self.ids)))
        order = np.argsort(term, kind="stable")
        self.query, self.weight = query[order].astype("int64"), rows["weight"].to_numpy()[order]
        self.n = np.bincount(term, minlength=len(self.terms))
        self.first = np.cumsum(self.n) - self.n

    def places(self, words: pa.Array) -> np.ndarray:
        """The number of each word among the asked terms, -1 for others."""
        return pc.fill_null(pc.index_in(words, value_set=self.terms), -1).to_numpy(zero_copy_only=False)

    def scores(self, rows: int, row: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, whether a word is shared) of ``rows`` chunks by all queries, from what asked terms count in them."""
        n = self.n[term]
        posting = np.repeat(np.arange(len(term)), n)
        pair = np.arange(len(posting)) - np.repeat(np.cumsum(n) - n, n) + self.first[term][posting]
        key = row[posting] * len(self.ids) + self.query[pair]
        gives = share(tf, length[row], self.mean)
        shape = rows, len(self.ids)
        hit = np.zeros(rows * len(self.ids), dtype=bool)
        hit[key] = True
        return np.bincount(key, self.weight[pair] * gives[posting], len(hit)).reshape(shape), hit.reshape(shape)


class Kept:
    """What a task keeps for its queries: the best ``k`` of each so far, so that little else leaves it."""

    def __init__(self, queries: int, k: int):
        self.k, self.held = k, np.full((queries, k), -np.inf)

    def new(self, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, column) of scores (-inf: none) that may be among the best ``k``, ties by smaller id; at most ``k`` a query."""
        top = np.partition(scores, -self.k, axis=1)[:, -self.k:] if scores.shape[1] > self.k else scores
        self.held = np.partition(np.concatenate([self.held, top], axis=1), -self.k, axis=1)[:, -self.k:]
        query, column = np.nonzero((scores >= self.held.min(axis=1)[:, None]) & (scores > -np.inf))
        if len(query) and np.bincount(query).max() > self.k:
            order = np.lexsort((np.unique(ids[column], return_inverse=True)[1], -scores[query, column], query))
            query, column = query[order], column[order]
            first = np.arange(len(query)) - np.searchsorted(query, query) < self.k
            query, column = query[first], column[first]
        return query, column


def scanned(asked: DataFrame, index: KeywordIndex, k: int | None = None, digits: int | None = 9) -> DataFrame:
    """(query_id, chunk_id, score) of a few queries in one pass over the chunks' lists, without an exchange.

    All pairs that share a word, or with ``k`` what the parts hold of the best ``k``.
    """
    spark = index.lists.sparkSession
    sent = spark.sparkContext.broadcast(Asked(asked, index.mean))

    def scan(batches):
        asked = sent.value
        kept = Kept(len(asked.ids), k) if k else None
        if not len(asked.ids):
            return
        step = max(1, SCORED_PAIRS // len(asked.ids))
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            ids, terms = batch.column("chunk_id"), batch.column("terms")
            row, flat = pc.list_parent_indices(terms).to_numpy(), terms.flatten()
            place = asked.places(flat.field("term"))
            at = place >= 0
            score, hit = asked.scores(batch.num_rows, row[at], place[at], flat.field("tf").to_numpy()[at], batch.column("length").to_numpy())
            score = score if digits is None else np.round(score, digits)
            if k:
                query, column = kept.new(ids.to_numpy(zero_copy_only=False), np.where(hit, score, -np.inf).T)
            else:
                column, query = np.nonzero(hit)
            yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(query)), ids.take(pa.array(column)), pa.array(score[column, query])], ["query_id", "chunk_id", "score"])

    kinds = dict(asked.dtypes)["query_id"], dict(index.lists.dtypes)["chunk_id"]
    return index.lists.mapInArrow(scan, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")


def ranked(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def search(queries: DataFrame, index: KeywordIndex, k: int, cut: str | None = None) -> DataFrame:
    """The best ``k`` chunks of every query: (query_id, chunk_id, score, rank)."""
    asked = written(asked_terms(queries, index, cut), "asked")
    return ranked(scanned(asked, index, k) if fits(asked, ASKED_BROADCAST) else _candidates(asked, index, k), k)


def candidates(queries: DataFrame, index: KeywordIndex, k: int, spare: float = 0.0, cut: str | None = None) -> DataFrame:
    """Scores that contain every chunk from a floor on: the k-th best less ``spare`` times the best."""
    return _candidates(written(asked_terms(queries, index, cut), "asked"), index, k, spare)


def _candidates(asked: DataFrame, index: KeywordIndex, k: int, spare: float = 0.0) -> DataFrame:
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    bounds = written(block_bounds(asked, index).withColumn("place", F.row_number().over(by_bound)), "bounds")
    scored = score_blocks(asked, index, bounds.where(F.col("place") <= FIRST_BLOCKS * k))
    first = written(scored if spare else ranked(scored, k).drop("rank"), "first-hits")
    floor = floors(first, k, spare)  # one row a query
    rest = bounds.where(F.col("place") > FIRST_BLOCKS * k).join(floor, "query_id", "left")
    rest = rest.where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - MARGIN))
    return first.unionByName(score_blocks(asked, index, rest))


def floors(hits: DataFrame, k: int, spare: float = 0.0) -> DataFrame:
    """(query_id, floor) of queries with k hits or more."""
    kept = ranked(hits, k)
    return kept.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.min("score").alias("last")).where(F.col("n") == k).select(
        "query_id", (F.col("last") - spare * F.greatest("best", F.lit(0.0))).alias("floor"))
