"""Queries over sources and regulation text."""

from __future__ import annotations

from pyspark.sql import functions as F

from pkgscreen.config import dealt, written
from pkgscreen.functions.text import reg_tokens
from pkgscreen.operators import keywords as kw
from pkgscreen.operators import regsearch as rs
from pkgscreen.operators import search as sr
from pkgscreen.plans.extraction import rounded
from pkgscreen.plans.fixtures import read, table
from pkgscreen.plans.inspection import generic, rules, statutory
from pkgscreen.plans.registry import QUERIES, query
from pkgscreen.plans.screening import staged, staged_path
from pkgscreen.sources import tables as src


def _job(key, job):
    QUERIES[key] = job


def raw_texts(spark, sf):
    """Documents as text files: a page mark in some, a rule number in others."""
    return dealt(read(spark, sf, "documents"), "doc_id").selectExpr("'doc_' || doc_id AS stem", """CASE WHEN doc_id % 3 = 0 THEN '[p. ' || (doc_id % 50) || '] ' ELSE '' END
      || CASE WHEN doc_id % 4 = 0 THEN 'Rule ' || (doc_id % 20) || '(1) ' ELSE '' END || replace(text, '\\n', '\\n\\n') AS text""")


def raw_json(spark, sf):
    """The same as JSON: envelopes for most documents, bare lists for the rest."""
    return read(spark, sf, "documents").selectExpr("'doc_' || doc_id AS stem", """CASE WHEN doc_id % 5 = 0
      THEN to_json(array(named_struct('id', 'C' || doc_id, 'text', text), named_struct('id', CAST(NULL AS STRING), 'text', ' ')))
      ELSE to_json(named_struct('document', source, 'effective_date', '2026-01-01', 'clauses', array(named_struct('text', text, 'page', CAST(doc_id AS INT), 'document', IF(doc_id % 2 = 0, 'own', NULL))))) END AS json""")


def corpus(spark, sf):
    def build():
        named = rs.rules_to_chunks(rules(spark, sf, "statutory_rules")).selectExpr(
            "rule_id AS chunk_id", "'rules' AS document", "rule_id AS rule_reference", "text", "category", "'ruleset' AS source_type")
        return rs.corpus_union(rs.clause_text(raw_texts(spark, sf)), named).drop("quote")
    quote = "IF(source_type = 'document', substring(text, 1, 300), NULL)"  # half the table, and the beginning of the text
    return staged(spark, "corpus", sf, build).withColumn("quote", F.expr(quote))


def index(spark, sf):
    """The corpus's keyword index, built once for all searches of a session."""
    return kw.read_index(spark, staged_path(spark, "reg-index", sf, lambda p: rs.write_keyword_index(corpus(spark, sf), p)))


def asked(spark, sf):
    return read(spark, sf, "benchmark").selectExpr("item_id AS query_id", "text AS query")


_job("clause_text", lambda spark, sf: rs.clause_text(raw_texts(spark, sf)).select("chunk_id", "document", "rule_reference", "page", "text"))
_job("clause_json", lambda spark, sf: rs.clause_json(raw_json(spark, sf)).select("chunk_id", "document", "page", "text", "effective_date"))
_job("corpus_union", lambda spark, sf: corpus(spark, sf).select("chunk_id", "document", "source_type", "category", "page"))
_job("reg_chunks", lambda spark, sf: rs.rules_to_chunks(table(spark, sf, "part_rules")).select("rule_id", "text", "page"))
_job("text_docs", lambda spark, sf: rs.name_files(read(spark, sf, "documents").selectExpr(
    "source || '-' || doc_id || IF(doc_id % 4 = 0, '', IF(doc_id % 4 = 1, '.TXT', '.md')) AS file_name", "text")).select("file_name", "file_type", "stem", F.length("text").cast("long").alias("n_chars")))
_job("reg_tokens", lambda spark, sf: corpus(spark, sf).select("chunk_id", F.expr(reg_tokens("text")).alias("w")).select(
    "chunk_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_terms")))
_job("reg_df", lambda spark, sf: rs.corpus_stats(corpus(spark, sf)))
_job("ngram_vectors", lambda spark, sf: rounded(rs.ngram_vectors(corpus(spark, sf)).select("chunk_id", F.posexplode("vector").alias("bucket", "weight")).where("weight > 0"), "weight"))
_job("reg_bm25", lambda spark, sf: rounded(rs.bm25_reg(asked(spark, sf), corpus(spark, sf), index=index(spark, sf)).select("query_id", "chunk_id", "score"), "score"))
_HIT = ["query_id", "chunk_id", "score", "rank"]
_job("reg_search", lambda spark, sf: rs.search_reg(asked(spark, sf), corpus(spark, sf), 5, index=index(spark, sf)).select(*_HIT, "keyword_score", "vector_score"))
_job("reg_search_filtered", lambda spark, sf: rs.search_reg(asked(spark, sf), corpus(spark, sf), 5, source_type="document", rule_reference="rule 1", index=index(spark, sf)).select(*_HIT))
_job("reg_stats", lambda spark, sf: rs.corpus_overview(corpus(spark, sf)))


@query("ngram_cosine")
def ngram_cosine(spark, sf):
    """The closest documents of each query by character triples alone."""
    docs = written(rs.clause_vectors(read(spark, sf, "documents").selectExpr("doc_id AS chunk_id", "text")), "doc-vectors")
    return rounded(sr.vector_topk(rs.ngram_vectors(asked(spark, sf), "query").selectExpr("query_id", "vector AS embedding"), docs, 5).select(*_HIT), "score")


# other vectors: triples hashed with sha1 instead of md5
_job("reg_custom_vec", lambda spark, sf: rs.search_reg(asked(spark, sf), corpus(spark, sf), 5, digest="sha1", index=index(spark, sf)).select(*_HIT))


@query("reg_citation")
def reg_citation(spark, sf):
    return rs.quote_rules(statutory(spark, sf).select("package_id", "rule_id"), corpus(spark, sf))


def citations(spark, sf):
    """Citations of the statutory findings."""
    return rs.cite_findings(statutory(spark, sf), corpus(spark, sf), index=lambda: index(spark, sf))


@query("cite_findings")
def cite_findings(spark, sf):
    """Statutory findings are cited by their rule, generic ones (whose rules are not in the corpus) by search."""
    named = rules(spark, sf, "generic_rules").select("rule_id", F.col("requirement").alias("title"))
    both = [statutory(spark, sf), generic(spark, sf).join(F.broadcast(named), "rule_id")]
    columns = "package_id", "rule_id", "status", "title", "reason"
    return rs.cite_findings(both[0].select(*columns).unionByName(both[1].select(*columns)), corpus(spark, sf), index=lambda: index(spark, sf))


# sources
@query("lines_explode")
def lines_explode(spark, sf):
    corner = "array(array(x_min, y_min), array(x_max, y_min), array(x_max, y_max), array(x_min, y_max))"
    photos = table(spark, sf, "lines").groupBy("package_id", "surface_idx", "surface_name").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "text", "confidence", F.expr(corner).alias("box")))).alias("l")).selectExpr(
        "package_id", "surface_idx", "surface_name", "l.text AS texts", "l.confidence AS confidences", "l.box AS bounding_boxes")
    return src.lines_of(photos).select("package_id", "surface_idx", "line_no", "text", "confidence", "x_min", "y_min", "x_max", "y_max")


_job("surface_grouping", lambda spark, sf: src.group_surfaces(table(spark, sf, "files"), "in"))
_job("file_admission", lambda spark, sf: src.admit_files(table(spark, sf, "files")).select("path", "reason", "code"))
_job("surface_count_check", lambda spark, sf: src.validate_surface_count(read(spark, sf, "lineitem").selectExpr(
    "l_orderkey AS package_id", "IF(l_orderkey % 50 = 0, NULL, l_linenumber) AS surface_idx")))
_job("ruleset_verified", lambda spark, sf: src.ruleset_verified(table(spark, sf, "part_rules")))
_job("log_tail", lambda spark, sf: src.log_tail(table(spark, sf, "log_lines"), 50))
