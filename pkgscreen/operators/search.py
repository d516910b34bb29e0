"""Keyword, vector and fused search for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pkgscreen import vocab as v
from pkgscreen.functions.text import one_spaced
from pkgscreen.operators import keywords as kw
from pkgscreen.operators import vectors as vec

DEFAULT_K, MOST_K = 5, 20  # results of a query that names no number; most that a query may ask for


def admit_queries(queries: DataFrame, most: int = 500) -> DataFrame:
    """Queries with the reason for refusing them; one without a number of results gets the usual one."""
    error = (f"CASE WHEN query IS NULL OR trim(query) = '' THEN 'query is empty' WHEN length(query) > {most} THEN 'query too long'"
             f" WHEN k < 1 OR k > {MOST_K} THEN 'k out of range' END")
    return queries.withColumn("error", F.expr(error)).withColumns({"query": F.trim("query"), "k": F.coalesce("k", F.lit(DEFAULT_K))})


def top(hits: DataFrame, k: int, by: str = "score", key: str = "query_id") -> DataFrame:
    """The best ``k`` of each query; kept small before the exchange by a partial limit."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by), "chunk_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def within(hits: DataFrame, queries: DataFrame, times: int, place: str = "rank") -> DataFrame:
    """Hits up to ``times`` as many as their query asked for."""
    return hits.join(queries.select("query_id", "k"), "query_id").where(F.col(place) <= times * F.col("k"))


def bm25_topk(queries: DataFrame, index: kw.KeywordIndex, k: int) -> DataFrame:
    """Okapi scores of the best ``k`` chunks that share a word with each query."""
    return kw.search(queries, index, k)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, modality: str | None = None) -> DataFrame:
    """Exact best inner products of unit-length queries with stored vectors, for any number of queries."""
    return vec.nearest(queries, vectors.where(F.col("chunk_type") == modality) if modality else vectors, k)


def adaptive_cut(hits: DataFrame) -> DataFrame:
    """Text hits within three quarters of the best of their retriever; images above .25."""
    best = F.max("score").over(Window.partitionBy("query_id", "retriever"))
    keep = F.when(F.col("retriever") == "clip", F.col("score") > 0.25).otherwise(F.col("score") >= 0.75 * best)
    return hits.withColumn("keep", keep).where("keep").drop("keep")


def query_intent(queries: DataFrame) -> DataFrame:
    asks = " OR ".join(f"contains(lower(query), '{p}')" for p in v.INFORMATIONAL)
    return queries.withColumn("informational", F.expr(asks)).withColumns({
        "semantic_weight": F.expr("IF(informational, 1.2D, 1.0D)"), "keyword_weight": F.expr("IF(informational, 0.3D, 0.5D)"),
        "image_weight": F.lit(0.3)})


def rrf_weighted(hits: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """Reciprocal ranks of the kept hits, weighted by what the query asks for."""
    rank = F.row_number().over(Window.partitionBy("query_id", "retriever").orderBy(F.desc("score"), "chunk_id"))
    weight = F.expr("CASE retriever WHEN 'faiss' THEN semantic_weight WHEN 'bm25' THEN keyword_weight ELSE image_weight END")
    per = lambda r, c: F.max(F.when(F.col("retriever") == r, F.col(c)))
    ranked = hits.withColumn("rank", rank).join(query_intent(queries).select("query_id", "semantic_weight", "keyword_weight", "image_weight"), "query_id")
    fused = ranked.groupBy("query_id", "chunk_id").agg(
        F.sum(weight / (60 + F.col("rank"))).alias("score"),
        *[per(r, "score").alias(f"{r}_score") for r in ("faiss", "bm25", "clip")],
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("retriever", "rank")))).alias("ranks"))
    return top(fused.withColumn("score", F.round("score", 12)), k) if k else fused


def rrf(hits: DataFrame, c: int = 40) -> DataFrame:
    return hits.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (c + F.col("rank"))).alias("score"))


def cut(column: str, n: int):
    return F.when(F.length(column) > n, F.concat(F.substring(column, 1, n), F.lit("..."))).otherwise(F.col(column))


def enrich_hits(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with their whole text and document, cut only where it is shown; hits without a chunk are left out."""
    d = docs.select("doc_id", "content_hash", F.col("source").alias("title"))
    return hits.join(chunks.select("chunk_id", "doc_id", "content"), "chunk_id").join(d, "doc_id")


def dedup_hits(hits: DataFrame, per_doc: int = 2) -> DataFrame:
    """At most ``per_doc`` chunks of a content, then no repeated text, in rank order.

    The quota is used up before the text test, as ranks are walked down.
    """
    in_doc = F.row_number().over(Window.partitionBy("query_id", "content_hash").orderBy("rank"))
    same = F.sha2(F.expr(one_spaced("lower(content)")), 256)
    first = F.row_number().over(Window.partitionBy("query_id", "text_hash").orderBy("rank"))
    return (hits.withColumn("n", in_doc).where(F.col("n") <= per_doc).withColumn("text_hash", same)
            .withColumn("n", first).where("n = 1").drop("n", "text_hash"))


def candidates(queries, query_vectors, index, vectors, times: int = 4) -> DataFrame:
    """Hits of the three retrievers, in multiples of each query's own ``k``: twice ``times`` by meaning, ``times`` by word, twice images."""
    def one(hits, name, n):
        return within(hits, queries, n).select("query_id", "chunk_id", "score", F.lit(name).alias("retriever"))

    return (one(vector_topk(query_vectors, vectors, 2 * times * MOST_K, "text"), "faiss", 2 * times)
            .unionByName(one(bm25_topk(queries, index, times * MOST_K), "bm25", times))
            .unionByName(one(vector_topk(query_vectors, vectors, 2 * times * MOST_K, "image"), "clip", 2 * times)))


def fused_hits(hits: DataFrame, queries: DataFrame, times: int = 4) -> DataFrame:
    """The best fused hits, ``times`` as many as each query asked for, which stays beside them as ``k``."""
    return within(rrf_weighted(hits, queries, times * MOST_K), queries, times)


def search(queries, query_vectors, index, vectors, chunks, docs) -> DataFrame:
    """Hybrid search: retrieve four times as much as each query asks for, cut, fuse, dedup."""
    fused = fused_hits(adaptive_cut(candidates(queries, query_vectors, index, vectors)), queries)
    kept = dedup_hits(enrich_hits(fused, chunks, docs))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return kept.withColumn("place", place).where(F.col("place") <= F.col("k"))


def rerank_fuse(hits: DataFrame) -> DataFrame:
    clamp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return hits.withColumn("final_score", 0.8 / (1 + F.exp(-F.col("logit"))) + 0.2 * clamp + F.when(F.col("chunk_id") < 0, 0.1).otherwise(0.0))


def explain(hits: DataFrame) -> DataFrame:
    """Final place, the factors behind it and the number of candidates."""
    total = F.count("*").over(Window.partitionBy("query_id"))
    ranked = top(rerank_fuse(hits).withColumns({"total_candidates": total, "final_score": F.round("final_score", 9)}), MOST_K, "final_score").where("rank <= k")
    return ranked.withColumns({"rrf_score": F.round("score", 4), "reranker_score": F.round("final_score", 4)})


def evidence_candidates(internal: DataFrame, external: DataFrame, forced: bool = False, threshold: float = 0.65) -> DataFrame:
    """Internal hits plus outside ones where these are wanted, first of each key kept."""
    wanted = internal.groupBy("query_id").agg((F.max("score") < threshold).alias("wanted")).where("wanted").select("query_id")
    outside = external if forced else external.join(wanted, "query_id", "left_semi")
    key = F.expr("CASE WHEN chunk_id > 0 THEN 'db_' || chunk_id ELSE 'web_' || coalesce(url, content) END")
    cols = ["query_id", "chunk_id", "url", "content", "score", "rank"]
    both = (internal.withColumn("url", F.lit(None).cast("string")).select(*cols, F.lit(0).alias("origin"))
            .unionByName(outside.withColumn("rank", -F.col("chunk_id").cast("int")).select(*cols, F.lit(1).alias("origin"))))
    first = F.row_number().over(Window.partitionBy("query_id", "key").orderBy("origin", "rank"))
    return both.withColumn("key", key).withColumn("n", first).where("n = 1").drop("n")


def relevant(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits sharing at least one blank-separated word with the query."""
    split = lambda c: F.filter(F.split(F.lower(c), v.WS + "+"), lambda w: w != "")
    return (hits.join(queries.select("query_id", "query", "k"), "query_id")
            .where(F.arrays_overlap(split("query"), split("content"))))


def final_sources(hits: DataFrame) -> DataFrame:
    """Rerank the first 2k of each query, keep k, cut the text."""
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("origin", "rank"))
    first = hits.withColumn("n", order).where(F.col("n") <= 2 * F.col("k")).drop("n", "rank")
    kept = top(rerank_fuse(first).withColumn("final_score", F.round("final_score", 9)), MOST_K, "final_score").where("rank <= k")
    return kept.withColumns({"content": cut("content", 750), "chunk_type": F.expr("IF(chunk_id < 0, 'web', 'text')")})


def evidence_confidence(sources: DataFrame) -> DataFrame:
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    own = F.avg(F.when(F.col("chunk_id") > 0, F.col("final_score")))
    used_web = F.max(F.when(F.col("chunk_id") < 0, 1).otherwise(0))
    return sources.groupBy("query_id").agg(clamp(
        0.5 * clamp(F.avg("final_score")) + 0.3 * clamp(own) + 0.2 * F.least(F.lit(1.0), F.count("*") / F.max("k")) - 0.15 * used_web).alias("confidence"))


def query_log(queries: DataFrame, hits: DataFrame) -> DataFrame:
    got = hits.groupBy("query_id").agg(F.count("*").alias("retrieved"))
    return queries.select("query_id", "query").join(got, "query_id", "left").fillna(0, ["retrieved"])


def index_overview(vectors: DataFrame) -> DataFrame:
    counts = vectors.groupBy("chunk_type").agg(F.count("*").alias("vectors"))
    return counts.withColumn("status", F.when(F.col("vectors") > 0, "ok").otherwise("empty"))
