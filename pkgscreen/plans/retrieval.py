"""Queries over documents, chunks and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from pkgscreen.operators import ingest as g
from pkgscreen.operators import keywords as kw
from pkgscreen.operators import search as s
from pkgscreen.plans.extraction import rounded
from pkgscreen.plans.fixtures import read, table
from pkgscreen.plans.registry import QUERIES, query
from pkgscreen.plans.screening import staged, staged_path


def docs(spark, sf):
    named = read(spark, sf, "documents").withColumns({
        "file_name": F.expr("source || '-' || doc_id || '.txt'"), "title": F.expr("IF(doc_id % 3 = 0, '', source || ' ' || doc_id)"),
        "source_url": F.expr("IF(doc_id % 4 = 0, 'http://' || source || '/' || doc_id, '')")})
    return g.with_hash(named)


def kept_docs(spark, sf):
    return g.dedup_documents(docs(spark, sf)).where("status = 'success'")


def chunks(spark, sf):
    return staged(spark, "chunks", sf, lambda: g.chunk_documents(kept_docs(spark, sf)))


def index(spark, sf):
    return kw.read_index(spark, staged_path(spark, "keyword-index", sf, lambda path: kw.write_index(g.term_lists(chunks(spark, sf)), path, wordless=False)))


def _job(key, job):
    QUERIES[key] = job


_job("doc_hash", lambda spark, sf: docs(spark, sf).select("doc_id", "content_hash", "summary"))
_job("doc_dedup", lambda spark, sf: g.dedup_documents(docs(spark, sf)).select("doc_id", "content_hash", "status"))
_job("doc_metadata_refresh", lambda spark, sf: g.refresh_metadata(docs(spark, sf)))
_job("chunk_documents", lambda spark, sf: g.chunk_documents(kept_docs(spark, sf)).select("chunk_id", "doc_id", "chunk_index", "content"))
_job("word_tokens", lambda spark, sf: g.tokens(read(spark, sf, "documents").selectExpr("doc_id AS chunk_id", "text AS content")).groupBy("chunk_id").agg(
    F.count("*").alias("n_tokens"), F.count_distinct("term").alias("n_terms"), F.max("term").alias("last_term")))
_job("postings", lambda spark, sf: g.build_postings(chunks(spark, sf)))
_job("keyword_index", lambda spark, sf: rounded(index(spark, sf).terms.join(index(spark, sf).maxima.groupBy("term").agg(F.max("most").alias("most")), "term"), "weight", "most"))
_job("vector_integrity", lambda spark, sf: g.check_vectors(table(spark, sf, "vectors")))
_job("doc_with_chunks", lambda spark, sf: g.with_chunks(kept_docs(spark, sf), chunks(spark, sf)).select(
    "doc_id", F.expr("coalesce(CAST(size(chunks) AS BIGINT), 0)").alias("n_chunks"), F.expr("array_join(transform(chunks, c -> md5(c.content)), ',')").alias("digests")))
_job("doc_page", lambda spark, sf: g.page(docs(spark, sf), 40, 25).select("doc_id", "title", "file_name"))


def _images(spark, sf):
    return read(spark, sf, "pages").selectExpr("page_id AS doc_id", "0 AS image_no", "IF(page_id % 5 = 0, ' ', url) AS description", "url AS image_path")


_job("image_chunks", lambda spark, sf: g.image_chunks(_images(spark, sf), chunks(spark, sf)).select("chunk_id", "doc_id", "chunk_index", "content", "image_path"))


@query("doc_delete")
def doc_delete(spark, sf):
    gone = read(spark, sf, "labels").where("toxic = 1")
    left, pieces = g.delete_document(kept_docs(spark, sf), chunks(spark, sf), gone)
    return left.selectExpr("'document' AS kind", "doc_id AS id").unionByName(pieces.selectExpr("'chunk' AS kind", "chunk_id AS id"))


@query("ingest_summary")
def ingest_summary(spark, sf):
    return g.ingest_summary(g.dedup_documents(docs(spark, sf)), chunks(spark, sf), table(spark, sf, "vectors"))


def length_embedder(texts):
    """A stand-in model: letter shares of a text; refuses texts without letters."""
    out = []
    for t in texts:
        n = [t.lower().count(c) for c in "aeiou"]
        out.append([x / sum(n) for x in n] if sum(n) else None)
    return out


_job("attach_embeddings", lambda spark, sf: rounded(g.attach_embeddings(chunks(spark, sf), length_embedder).select(
    "chunk_id", "chunk_type", F.posexplode("embedding").alias("place", "share")).withColumn("share", F.col("share").cast("double")), "share"))


def queries(spark, sf):
    return s.admit_queries(table(spark, sf, "search_queries")).where("error IS NULL")


def hits(spark, sf):
    return staged(spark, "retriever_hits", sf, lambda: s.candidates(
        queries(spark, sf), table(spark, sf, "query_vectors").join(queries(spark, sf).select("query_id"), "query_id", "left_semi"),
        index(spark, sf), table(spark, sf, "vectors")))


def found(spark, sf):
    q = queries(spark, sf)
    return staged(spark, "search_results", sf, lambda: s.search(
        q, table(spark, sf, "query_vectors").join(q.select("query_id"), "query_id", "left_semi"),
        index(spark, sf), table(spark, sf, "vectors"), chunks(spark, sf), docs(spark, sf)))


_job("query_admission", lambda spark, sf: s.admit_queries(table(spark, sf, "search_queries")).select("query_id", "query", "error"))
_job("bm25_topk", lambda spark, sf: rounded(s.bm25_topk(queries(spark, sf), index(spark, sf), 20).select("query_id", "chunk_id", "score", "rank"), "score"))
_job("vector_topk", lambda spark, sf: rounded(s.vector_topk(table(spark, sf, "query_vectors"), table(spark, sf, "vectors"), 10).select("query_id", "chunk_id", "score", "rank"), "score"))
_job("vector_topk_modality", lambda spark, sf: rounded(s.vector_topk(table(spark, sf, "query_vectors"), table(spark, sf, "vectors"), 10, "image").select("query_id", "chunk_id", "score", "rank"), "score"))
_job("adaptive_cut", lambda spark, sf: rounded(s.adaptive_cut(hits(spark, sf)), "score"))
_job("query_intent", lambda spark, sf: s.query_intent(table(spark, sf, "search_queries")).select("query_id", "informational", "semantic_weight", "keyword_weight", "image_weight"))
_job("hybrid_rrf", lambda spark, sf: rounded(s.fused_hits(s.adaptive_cut(hits(spark, sf)), queries(spark, sf)).drop("k").withColumn(
    "ranks", F.expr("array_join(transform(map_entries(ranks), e -> e.key || '=' || e.value), ',')")), "score", "faiss_score", "bm25_score", "clip_score"))
_job("rrf_plain", lambda spark, sf: rounded(s.rrf(s.bm25_topk(queries(spark, sf), index(spark, sf), 20).select("query_id", "chunk_id", "rank").unionByName(
    s.vector_topk(table(spark, sf, "query_vectors"), table(spark, sf, "vectors"), 20).select("query_id", "chunk_id", "rank"))), "score"))


def _enriched(spark, sf):
    return s.enrich_hits(s.fused_hits(s.adaptive_cut(hits(spark, sf)), queries(spark, sf)), chunks(spark, sf), docs(spark, sf))


_job("hit_enrich", lambda spark, sf: _enriched(spark, sf).select("query_id", "chunk_id", "doc_id", s.cut("content", 800).alias("content"), "title", "rank"))
_job("search_dedup", lambda spark, sf: s.dedup_hits(_enriched(spark, sf)).select("query_id", "chunk_id", "rank"))
_job("hybrid_search", lambda spark, sf: rounded(found(spark, sf).select("query_id", "chunk_id", "doc_id", "score", "place"), "score"))


def _logits(d):
    return d.withColumn("logit", F.expr("CAST(pmod(abs(chunk_id) * 31, 200) - 100 AS DOUBLE) / 25"))


_job("rerank_fuse", lambda spark, sf: rounded(s.rerank_fuse(_logits(found(spark, sf))).select("query_id", "chunk_id", "final_score"), "final_score"))
_job("explain_ranking", lambda spark, sf: s.explain(_logits(found(spark, sf).drop("rank"))).select("query_id", "chunk_id", "rank", "rrf_score", "reranker_score", "total_candidates"))


def _pool(spark, sf):
    return s.evidence_candidates(found(spark, sf), table(spark, sf, "external_hits"))


def _sources(spark, sf):
    return s.final_sources(_logits(s.relevant(_pool(spark, sf), queries(spark, sf))))


_job("evidence_candidates", lambda spark, sf: _pool(spark, sf).select("query_id", "chunk_id", "key", "origin"))
_job("evidence_relevance", lambda spark, sf: s.relevant(_pool(spark, sf), queries(spark, sf)).select("query_id", "chunk_id", "key"))
_job("final_sources", lambda spark, sf: rounded(_sources(spark, sf).select("query_id", "chunk_id", "rank", "chunk_type", "content", "final_score"), "final_score"))
_job("evidence_confidence", lambda spark, sf: rounded(s.evidence_confidence(_sources(spark, sf)), "confidence"))
_job("query_log", lambda spark, sf: s.query_log(queries(spark, sf), found(spark, sf)))
_job("index_overview", lambda spark, sf: s.index_overview(table(spark, sf, "vectors")))
