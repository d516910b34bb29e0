"""Checks for documents, chunks and hybrid search."""

from __future__ import annotations

from pkgscreen import vocab as v
from pkgscreen.oracle.base import check, cte, strip

cte("dc", """SELECT *, source || '-' || doc_id || '.txt' AS file_name, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source || ' ' || doc_id END AS title,
  CASE WHEN doc_id % 4 = 0 THEN 'http://' || source || '/' || doc_id ELSE '' END AS source_url, coalesce(nullif(text, ''), source || '-' || doc_id || '.txt') AS body FROM documents""")
cte("dh", "SELECT *, sha256(body) AS content_hash FROM [[dc]]")
cte("dd", "SELECT *, CASE WHEN row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) = 1 THEN 'success' ELSE 'skipped' END AS status FROM [[dh]]")
check("doc_hash", "SELECT doc_id, content_hash, substr(body, 1, 500) AS summary FROM [[dh]]")
check("doc_dedup", "SELECT doc_id, content_hash, status FROM [[dd]]")
check("doc_metadata_refresh", """SELECT content_hash, min(doc_id) AS doc_id, max_by(title, doc_id) FILTER (title <> '') AS title,
  max_by(source_url, doc_id) FILTER (source_url <> '') AS source_url FROM [[dh]] GROUP BY content_hash""")
_one = strip(f"regexp_replace(text, '{v.WS}+', ' ', 'g')")
cte("sent0", f"SELECT doc_id, string_split(regexp_replace({_one}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM [[dd]] WHERE status = 'success' AND {_one} <> ''")
cte("sent", "SELECT doc_id, ss, list_transform(ss, lambda s: len(string_split(s, ' '))) AS ns, len(ss) AS m FROM [[sent0]]")
# one row per sentence read; [lo, i] are the sentences of the open chunk, ending at a flush when done is set
cte("chunk_steps", """SELECT doc_id, 1 AS i, 1 AS lo, ns[1] AS len, NULL::INT AS from_s, NULL::INT AS to_s FROM [[sent]]
UNION ALL SELECT c.doc_id, c.i + 1, CASE WHEN flush THEN back ELSE c.lo END, CASE WHEN flush THEN list_sum(s.ns[back:c.i]) + s.ns[c.i + 1] ELSE c.len + s.ns[c.i + 1] END,
  CASE WHEN flush THEN c.lo END, CASE WHEN flush THEN c.i END
FROM (SELECT c.*, c.len + s.ns[c.i + 1] > 300 AS flush,
    CASE WHEN c.len + s.ns[c.i + 1] > 300 THEN coalesce(list_max(list_filter(range(c.lo, c.i + 1), lambda b: list_sum(s.ns[b:c.i]) >= 40)), c.lo) END AS back
  FROM chunk_steps c JOIN [[sent]] s USING (doc_id) WHERE c.i < s.m) c JOIN [[sent]] s USING (doc_id)""")
cte("pieces", """SELECT doc_id, from_s, to_s FROM [[chunk_steps]] WHERE from_s IS NOT NULL
UNION ALL SELECT c.doc_id, c.lo, c.i FROM [[chunk_steps]] c JOIN [[sent]] s ON s.doc_id = c.doc_id AND s.m = c.i""")
cte("pieces2", "SELECT p.doc_id, p.to_s, array_to_string(s.ss[p.from_s:p.to_s], ' ') AS content FROM [[pieces]] p JOIN [[sent]] s USING (doc_id)")
cte("chunks", """SELECT doc_id * 1000000 + chunk_index AS chunk_id, * FROM (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY to_s) - 1 AS INT) AS chunk_index, content
  FROM [[pieces2]] WHERE len(string_split(content, ' ')) > 20)""")
check("chunk_documents", "SELECT chunk_id, doc_id, chunk_index, content FROM [[chunks]]", True)
check("word_tokens", f"""SELECT doc_id AS chunk_id, count(*) AS n_tokens, count(DISTINCT w) AS n_terms, max(w) AS last_term
FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{v.WORD_TOKEN}')) AS w FROM documents) GROUP BY doc_id""")
cte("ctok", f"SELECT chunk_id, len(w) AS length, unnest(w) AS term FROM (SELECT chunk_id, regexp_extract_all(lower(content), '{v.WORD_TOKEN}') AS w FROM [[chunks]])")
cte("post", "SELECT chunk_id, CAST(length AS INT) AS length, term, count(*) AS tf FROM [[ctok]] GROUP BY ALL")
check("postings", "SELECT * FROM [[post]]", True)
cte("vowels", "SELECT chunk_id, [length(content) - length(replace(lower(content), l, '')) for l in ['a', 'e', 'i', 'o', 'u']] AS n FROM [[chunks]]")
check("attach_embeddings", """SELECT chunk_id, 'text' AS chunk_type, CAST(p AS INT) AS place, round(CAST(CAST(n[p + 1] / list_sum(n) AS FLOAT) AS DOUBLE), 6) AS share
FROM [[vowels]] CROSS JOIN (SELECT unnest(range(5)) AS p) WHERE list_sum(n) > 0""", True)
check("vector_integrity", """SELECT chunk_type, count(*) AS vectors, count(*) FILTER (chunk_id IS NULL) AS null_ids, count(chunk_id) - count(DISTINCT chunk_id) AS repeated_ids,
  CAST(min(len(embedding)) AS INT) AS least_dim, CAST(max(len(embedding)) AS INT) AS most_dim FROM [[vectors]] GROUP BY 1""")
check("doc_with_chunks", """SELECT d.doc_id, count(c.chunk_id) AS n_chunks, string_agg(md5(c.content), ',' ORDER BY c.chunk_index) AS digests
FROM [[dd]] d LEFT JOIN [[chunks]] c USING (doc_id) WHERE d.status = 'success' GROUP BY 1""", True)
check("doc_page", "SELECT doc_id, title, file_name FROM [[dc]] ORDER BY doc_id LIMIT 25 OFFSET 40")
check("image_chunks", """SELECT p.page_id * 1000000 + n AS chunk_id, p.page_id AS doc_id, n AS chunk_index, p.url AS content, p.url AS image_path
FROM (SELECT page_id, url, (SELECT count(*) FROM [[chunks]] c WHERE c.doc_id = p.page_id) AS n FROM pages p WHERE page_id % 5 <> 0) p""", True)
check("doc_delete", """SELECT 'document' AS kind, doc_id AS id FROM [[dd]] WHERE status = 'success' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'chunk', chunk_id FROM [[chunks]] WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""", True)
check("ingest_summary", """SELECT d.doc_id, d.status, coalesce(c.n, 0) AS chunks_created, coalesce(w.n, 0) AS vectors_added FROM [[dd]] d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM [[chunks]] GROUP BY 1) c USING (doc_id) LEFT JOIN (SELECT vec_id AS doc_id, count(*) AS n FROM embeddings GROUP BY 1) w USING (doc_id)""", True)

cte("adm", """SELECT *, CASE WHEN trim(query) = '' THEN 'query is empty' WHEN length(query) > 500 THEN 'query too long' WHEN k < 1 OR k > 20 THEN 'k out of range' END AS error FROM [[search_queries]]""")
check("query_admission", "SELECT query_id, trim(query) AS query, error FROM [[adm]]")
cte("q", "SELECT query_id, trim(query) AS query, coalesce(k, 5) AS k FROM [[adm]] WHERE error IS NULL")
cte("qt", f"SELECT query_id, unnest(regexp_extract_all(lower(query), '{v.WORD_TOKEN}')) AS term FROM [[q]]")
cte("cstat", "SELECT count(*) AS n, avg(length) AS al FROM (SELECT DISTINCT chunk_id, length FROM [[post]])")
cte("dfreq", "SELECT term, ln((SELECT n FROM [[cstat]]) - count(*) + 0.5) - ln(count(*) + 0.5) AS w FROM [[post]] GROUP BY term")
cte("idf", "SELECT term, CASE WHEN w < 0 THEN 0.25 * (SELECT avg(w) FROM [[dfreq]]) ELSE w END AS idf FROM [[dfreq]]")
check("keyword_index", """SELECT term, df, round(idf, 6) AS weight, round(most, 6) AS most FROM [[idf]] JOIN (
  SELECT term, count(*) AS df, max(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / (SELECT al FROM [[cstat]])))) AS most FROM [[post]] GROUP BY term) USING (term)""", True)
cte("kw", """SELECT query_id, chunk_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / (SELECT al FROM [[cstat]])))), 9) AS score
FROM [[qt]] JOIN [[post]] USING (term) JOIN [[idf]] USING (term) GROUP BY ALL""")


def asked(src: str, times: int, by: str = "score") -> str:
    """The best of each query, ``times`` as many as its own row asks for."""
    return f"""SELECT * EXCLUDE k FROM (SELECT t.*, q.k, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {by} DESC, chunk_id) AS INT) AS rank
  FROM {src} t JOIN [[q]] q USING (query_id)) WHERE rank <= {times} * k"""


def topn(src: str, k: int, by: str = "score") -> str:
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {by} DESC, chunk_id) AS INT) AS rank FROM {src} QUALIFY rank <= {k}"


cte("kwtop", topn("[[kw]]", 20))
check("bm25_topk", "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM [[kwtop]]", True)
cte("dots", """SELECT q.query_id, x.chunk_id, x.chunk_type, round(list_inner_product(q.embedding::DOUBLE[], x.embedding::DOUBLE[]) / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 9) AS score
FROM [[query_vectors]] q CROSS JOIN [[vectors]] x""")
for _key, _where in (("vector_topk", ""), ("vector_topk_modality", " WHERE chunk_type = 'image'")):
    check(_key, f"SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({topn(f'(SELECT * FROM [[dots]]{_where})', 10)})")
cte("rh", f"""SELECT query_id, chunk_id, score, 'faiss' AS retriever FROM ({asked("(SELECT * FROM [[dots]] WHERE chunk_type = 'text')", 8)})
UNION ALL SELECT query_id, chunk_id, score, 'bm25' FROM ({asked('[[kw]]', 4)})
UNION ALL SELECT query_id, chunk_id, score, 'clip' FROM ({asked("(SELECT * FROM [[dots]] WHERE chunk_type = 'image')", 8)})""")
cte("cutted", """SELECT query_id, chunk_id, score, retriever FROM (SELECT *, max(score) OVER (PARTITION BY query_id, retriever) AS best FROM [[rh]])
WHERE CASE WHEN retriever = 'clip' THEN score > 0.25 ELSE score >= 0.75 * best END""")
check("adaptive_cut", "SELECT query_id, chunk_id, round(score, 6) AS score, retriever FROM [[cutted]]", True)
_info = " OR ".join(f"contains(lower(query), '{p}')" for p in v.INFORMATIONAL)
cte("intent", f"SELECT query_id, {_info} AS informational FROM [[search_queries]]")
check("query_intent", """SELECT query_id, informational, CASE WHEN informational THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS semantic_weight,
  CASE WHEN informational THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS keyword_weight, 0.3::DOUBLE AS image_weight FROM [[intent]]""")
cte("fuse0", """SELECT c.*, row_number() OVER (PARTITION BY query_id, retriever ORDER BY score DESC, chunk_id) AS r, informational FROM [[cutted]] c JOIN [[intent]] USING (query_id)""")
cte("fuse", """SELECT query_id, chunk_id, round(sum((CASE retriever WHEN 'faiss' THEN CASE WHEN informational THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END WHEN 'bm25' THEN CASE WHEN informational THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END ELSE 0.3::DOUBLE END) / (60 + r)), 12) AS score,
  max(score) FILTER (retriever = 'faiss') AS faiss_score, max(score) FILTER (retriever = 'bm25') AS bm25_score, max(score) FILTER (retriever = 'clip') AS clip_score,
  string_agg(retriever || '=' || r, ',' ORDER BY retriever) AS ranks FROM [[fuse0]] GROUP BY query_id, chunk_id""")
cte("fused", asked("[[fuse]]", 4))
check("hybrid_rrf", """SELECT query_id, chunk_id, round(score, 6) AS score, round(faiss_score, 6) AS faiss_score, round(bm25_score, 6) AS bm25_score,
  round(clip_score, 6) AS clip_score, ranks, rank FROM [[fused]]""", True)
check("rrf_plain", f"""SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (40 + rank)), 6) AS score FROM (SELECT query_id, chunk_id, rank FROM [[kwtop]]
UNION ALL SELECT query_id, chunk_id, rank FROM ({topn('[[dots]]', 20)})) GROUP BY ALL""", True)
cte("rich", """SELECT f.query_id, f.chunk_id, f.score, f.rank, c.doc_id, d.content_hash, d.source AS title, c.content
FROM [[fused]] f JOIN [[chunks]] c USING (chunk_id) JOIN [[dh]] d ON d.doc_id = c.doc_id""")
check("hit_enrich", "SELECT query_id, chunk_id, doc_id, CASE WHEN length(content) > 800 THEN substr(content, 1, 800) || '...' ELSE content END AS content, title, rank FROM [[rich]]", True)
cte("quota", "SELECT * FROM [[rich]] QUALIFY row_number() OVER (PARTITION BY query_id, content_hash ORDER BY rank) <= 2")
_norm = strip(f"regexp_replace(lower(content), '{v.WS}+', ' ', 'g')")
cte("uniq", f"SELECT * FROM [[quota]] QUALIFY row_number() OVER (PARTITION BY query_id, {_norm} ORDER BY rank) = 1")
check("search_dedup", "SELECT query_id, chunk_id, rank FROM [[uniq]]", True)
cte("found", """SELECT * EXCLUDE k FROM (SELECT u.*, q.k, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS place FROM [[uniq]] u JOIN [[q]] q USING (query_id)) WHERE place <= k""")
check("hybrid_search", "SELECT query_id, chunk_id, doc_id, round(score, 6) AS score, place FROM [[found]]", True)
_final = ("0.8::DOUBLE / (1 + exp(-(CAST(abs(chunk_id) * 31 % 200 - 100 AS DOUBLE) / 25))) + 0.2::DOUBLE * greatest(0, least(1, score)) + CASE WHEN chunk_id < 0 THEN 0.1::DOUBLE ELSE 0 END")
check("rerank_fuse", f"SELECT query_id, chunk_id, round({_final}, 6) AS final_score FROM [[found]]", True)
cte("expl", f"SELECT query_id, chunk_id, score, round({_final}, 9) AS fs, count(*) OVER (PARTITION BY query_id) AS total_candidates FROM [[found]]")
check("explain_ranking", f"SELECT query_id, chunk_id, rank, round(score, 4) AS rrf_score, round(fs, 4) AS reranker_score, total_candidates FROM ({asked('[[expl]]', 1, 'fs')})", True)
cte("epool", """SELECT *, CASE WHEN chunk_id > 0 THEN 'db_' || chunk_id ELSE 'web_' || coalesce(url, content) END AS key FROM (
  SELECT query_id, chunk_id, NULL AS url, content, score, rank, 0 AS origin FROM [[found]]
  UNION ALL SELECT query_id, chunk_id, url, content, score, CAST(-chunk_id AS INT), 1 FROM [[external_hits]]
  WHERE query_id IN (SELECT query_id FROM [[found]] GROUP BY 1 HAVING max(score) < 0.65)) QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY origin, rank) = 1""")
check("evidence_candidates", "SELECT query_id, chunk_id, key, origin FROM [[epool]]", True)
_split = lambda c: f"list_filter(string_split_regex(lower({c}), '{v.WS}+'), lambda w: w <> '')"
cte("rele", f"SELECT e.* FROM [[epool]] e JOIN [[q]] q USING (query_id) WHERE list_has_any({_split('q.query')}, {_split('e.content')})")
check("evidence_relevance", "SELECT query_id, chunk_id, key FROM [[rele]]", True)
cte("src0", """SELECT * EXCLUDE (rank, k, n) FROM (SELECT e.*, q.k, row_number() OVER (PARTITION BY query_id ORDER BY origin, rank) AS n FROM [[rele]] e JOIN [[q]] q USING (query_id)) WHERE n <= 2 * k""")
cte("src1", f"SELECT *, round({_final}, 9) AS fs FROM [[src0]]")
cte("src", asked("[[src1]]", 1, "fs"))
check("final_sources", """SELECT query_id, chunk_id, rank, CASE WHEN chunk_id < 0 THEN 'web' ELSE 'text' END AS chunk_type,
  CASE WHEN length(content) > 750 THEN substr(content, 1, 750) || '...' ELSE content END AS content, round(fs, 6) AS final_score FROM [[src]]""", True)
check("evidence_confidence", """SELECT query_id, round(greatest(0, least(1, 0.5::DOUBLE * least(1, avg(fs)) + 0.3::DOUBLE * least(1, coalesce(avg(fs) FILTER (chunk_id > 0), 0)) + 0.2::DOUBLE * least(1, count(*) / CAST(any_value(k) AS DOUBLE))
  - 0.15::DOUBLE * max(CASE WHEN chunk_id < 0 THEN 1 ELSE 0 END))), 6) AS confidence FROM [[src]] JOIN [[q]] USING (query_id) GROUP BY 1""", True)
check("query_log", "SELECT q.query_id, q.query, (SELECT count(*) FROM [[found]] f WHERE f.query_id = q.query_id) AS retrieved FROM [[q]] q", True)
check("index_overview", "SELECT chunk_type, count(*) AS vectors, 'ok' AS status FROM [[vectors]] GROUP BY 1")
