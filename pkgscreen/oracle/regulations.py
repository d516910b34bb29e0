"""Checks for sources, regulation text and streams."""

from __future__ import annotations

from pkgscreen import vocab as v
from pkgscreen.oracle.base import check, cte, lst, strip

cte("rawt", """SELECT 'doc_' || doc_id AS stem, CASE WHEN doc_id % 3 = 0 THEN '[p. ' || (doc_id % 50) || '] ' ELSE '' END
  || CASE WHEN doc_id % 4 = 0 THEN 'Rule ' || (doc_id % 20) || '(1) ' ELSE '' END || replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents""")
cte("blk0", r"SELECT stem, unnest(string_split_regex(text, '\n\s*\n')) AS block, unnest(range(len(string_split_regex(text, '\n\s*\n')))) AS n FROM [[rawt]]")
cte("blk1", f"SELECT stem, n, {strip('block')} AS block FROM [[blk0]] WHERE {strip('block')} <> ''")
cte("blk2", r"SELECT *, TRY_CAST(nullif(regexp_extract(block, '\[p\.\s*(\d+)\]', 1), '') AS INT) AS mark, nullif(regexp_extract(block, '\[p\.\s*(\d+)\]', 0), '') AS tag FROM [[blk1]]")
cte("blk3", f"SELECT stem, n, last_value(mark IGNORE NULLS) OVER (PARTITION BY stem ORDER BY n) AS page, {strip('replace(block, coalesce(tag, chr(0)), ' + repr('') + ')')} AS text FROM [[blk2]]")
cte("clauses", r"""SELECT stem || '-' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INT), '0') AS chunk_id, replace(stem, '_', ' ') AS document,
  regexp_extract(text, '^(Rule\s+[\w()\-.]+)', 1, 'i') AS rule_reference, page, text FROM [[blk3]]""")
check("clause_text", "SELECT chunk_id, document, rule_reference, page, text FROM [[clauses]]")
check("clause_json", f"""SELECT CASE WHEN doc_id % 5 = 0 THEN 'C' || doc_id ELSE 'doc_' || doc_id || '-000' END AS chunk_id, CASE WHEN doc_id % 5 = 0 THEN 'doc_' || doc_id WHEN doc_id % 2 = 0 THEN 'own' ELSE source END AS document,
  CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id AS INT) END AS page, text, CASE WHEN doc_id % 5 <> 0 THEN '2026-01-01' END AS effective_date FROM documents WHERE trim(text) <> ''""")
cte("own", "SELECT rule_id AS chunk_id, concat_ws(' ', nullif(title, ''), nullif(requirement, ''), nullif(applicability, ''), nullif(evidence_text, '')) AS text, category FROM [[statutory_rules]]")
cte("reg", """SELECT chunk_id, document, rule_reference, page, text, NULL AS category, 'document' AS source_type FROM [[clauses]]
UNION ALL SELECT chunk_id, 'rules', chunk_id, NULL, text, category, 'ruleset' FROM [[own]]""")
check("corpus_union", "SELECT chunk_id, document, source_type, category, page FROM [[reg]]")
check("reg_chunks", "SELECT rule_id, concat_ws(' ', nullif(title, ''), nullif(requirement, ''), nullif(applicability, ''), nullif(evidence_text, '')) AS text, page FROM [[part_rules]]")
check("text_docs", """SELECT source || '-' || doc_id || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '.TXT' ELSE '.md' END AS file_name,
  CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'txt' ELSE 'md' END AS file_type, source || '-' || doc_id AS stem, length(text) AS n_chars FROM documents""")
cte("rtok", f"SELECT chunk_id, list_filter(regexp_extract_all(lower(text), '{v.REG_TOKEN}'), lambda t: t NOT IN {lst(v.REG_STOPWORDS)}) AS w FROM [[reg]]")
check("reg_tokens", "SELECT chunk_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_terms FROM [[rtok]]")
cte("rpost", "SELECT chunk_id, length, term, count(*) AS tf FROM (SELECT chunk_id, len(w) AS length, unnest(w) AS term FROM [[rtok]]) GROUP BY ALL")
check("reg_df", "SELECT term, count(*) AS df FROM [[rpost]] GROUP BY 1")
cte("rq", "SELECT item_id AS query_id, text AS query FROM benchmark")
cte("rqt", f"SELECT query_id, t AS term FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '{v.REG_TOKEN}')) AS t FROM [[rq]]) WHERE t NOT IN {lst(v.REG_STOPWORDS)}")
cte("ridf", "SELECT term, ln(1 + ((SELECT count(*) FROM [[rtok]]) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM [[rpost]] GROUP BY 1")
cte("rkw", "SELECT query_id, chunk_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / (SELECT avg(len(w)) FROM [[rtok]])))) AS score FROM [[rqt]] JOIN [[rpost]] USING (term) JOIN [[ridf]] USING (term) GROUP BY ALL")
check("reg_bm25", "SELECT query_id, chunk_id, round(score, 6) AS score FROM [[rkw]]")


def grams(name: str, src: str, key: str, text: str, digest: str = "md5") -> None:
    one = strip(f"regexp_replace(lower({text}), '{v.WS}+', ' ', 'g')")
    cte(f"{name}_n", f"SELECT {key} AS id, {one} AS n FROM {src}")
    cte(f"{name}_g", f"""SELECT id, bucket, count(*) AS c FROM (SELECT id, ('0x' || substr({digest}(substr(n, i, 3)), 1, 8))::BIGINT % 512 AS bucket
      FROM (SELECT id, n, unnest(range(1, greatest(1, length(n) - 2) + 1)) AS i FROM [[{name}_n]] WHERE n <> '')) GROUP BY ALL""")
    cte(f"{name}_v", f"SELECT id, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS w FROM [[{name}_g]]")


grams("rc", "[[reg]]", "chunk_id", "text")
grams("rqv", "[[rq]]", "query_id", "query")
grams("rd", "documents", "doc_id", "text")
check("ngram_vectors", "SELECT id AS chunk_id, CAST(bucket AS INT) AS bucket, round(w, 6) AS weight FROM [[rc_v]]")
check("ngram_cosine", """SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank
FROM (SELECT q.id AS query_id, d.id AS chunk_id, round(sum(q.w * d.w), 9) AS score FROM [[rqv_v]] q JOIN [[rd_v]] d USING (bucket) GROUP BY ALL) QUALIFY rank <= 5""")
def both_scores(cos: str, words: str, where: str, k: int, more: str = "") -> str:
    """The best k by keyword and character score together."""
    return f"""SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank{more}
FROM (SELECT *, round(0.65::DOUBLE * kw + 0.35::DOUBLE * cos, 4) AS score FROM (
  SELECT c.query_id, c.chunk_id, c.cos, coalesce(k.score / max(k.score) OVER (PARTITION BY c.query_id), 0) AS kw FROM [[{cos}]] c JOIN [[reg]] r USING (chunk_id)
  LEFT JOIN [[{words}]] k ON k.query_id = c.query_id AND k.chunk_id = c.chunk_id WHERE {where}) WHERE 0.65 * kw + 0.35 * cos > 0) QUALIFY rank <= {k}"""


def cosines(name: str, asked: str, stored: str) -> None:
    cte(name, f"SELECT q.id AS query_id, d.id AS chunk_id, sum(q.w * d.w) AS cos FROM [[{asked}_v]] q JOIN [[{stored}_v]] d USING (bucket) GROUP BY ALL")


cosines("rcos", "rqv", "rc")
check("reg_search", both_scores("rcos", "rkw", "true", 5, ", round(kw, 4) AS keyword_score, round(cos, 4) AS vector_score"))
check("reg_search_filtered", both_scores("rcos", "rkw", "source_type = 'document' AND contains(lower(rule_reference), 'rule 1')", 5))
grams("sc", "[[reg]]", "chunk_id", "text", "sha1")
grams("sqv", "[[rq]]", "query_id", "query", "sha1")
cosines("scos", "sqv", "sc")
check("reg_custom_vec", both_scores("scos", "rkw", "true", 5))
# findings in doubt: by rule id, or by search for their text
cte("doubt", """SELECT package_id, rule_id, status, title || ' ' || reason AS query FROM [[sf]] WHERE status IN ('FAIL', 'MANUAL_REVIEW')
UNION ALL SELECT package_id, rule_id, status, requirement || ' ' || reason FROM [[gfind]] WHERE status IN ('FAIL', 'MANUAL_REVIEW')""")
cte("dq", "SELECT DISTINCT query AS query_id, query FROM [[doubt]] WHERE rule_id NOT IN (SELECT chunk_id FROM [[reg]])")
cte("dqt", f"SELECT query_id, t AS term FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '{v.REG_TOKEN}')) AS t FROM [[dq]]) WHERE t NOT IN {lst(v.REG_STOPWORDS)}")
cte("dkw", "SELECT query_id, chunk_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / (SELECT avg(len(w)) FROM [[rtok]])))) AS score FROM [[dqt]] JOIN [[rpost]] USING (term) JOIN [[ridf]] USING (term) GROUP BY ALL")
grams("dqv", "[[dq]]", "query_id", "query")
cosines("dcos", "dqv", "rc")
cte("dhit", both_scores("dcos", "dkw", "true", 1))
check("cite_findings", """SELECT d.package_id, d.rule_id, d.status, coalesce(o.chunk_id, h.chunk_id) AS chunk_id,
  CASE WHEN o.chunk_id IS NOT NULL THEN 'exact_rule_id' WHEN h.chunk_id IS NOT NULL THEN 'hybrid_search' ELSE 'no_match' END AS retrieval
FROM [[doubt]] d LEFT JOIN [[own]] o ON o.chunk_id = d.rule_id LEFT JOIN [[dhit]] h ON h.query_id = d.query AND o.chunk_id IS NULL""", True)
check("reg_stats", "SELECT count(*) AS chunks, count(DISTINCT document) AS documents, count(DISTINCT source_type) AS source_types, count(page) AS with_page FROM [[reg]]")
check("reg_citation", "SELECT f.package_id, f.rule_id, 'rules' AS document, o.text AS quote FROM [[sf]] f JOIN [[own]] o ON o.chunk_id = f.rule_id")

check("lines_explode", "SELECT package_id, surface_idx, CAST(pos AS INT) AS line_no, text, confidence, x_min, y_min, x_max, y_max FROM [[ln]]")
check("surface_grouping", r"""SELECT *, CASE WHEN surface_idx >= 6 THEN 'too many photos' END AS reason FROM (SELECT package, CAST(row_number() OVER (PARTITION BY package ORDER BY path) - 1 AS INT) AS surface_idx, path FROM (
  SELECT path, CASE WHEN contains(substr(path, 4), '/') THEN 'package:' || split_part(path, '/', 2) ELSE substr(path, 4) END AS package
  FROM [[files]] WHERE regexp_matches(path, '\.(jpg|jpeg|png|bmp)$', 'i')))""")
cte("adm0", "SELECT *, CASE WHEN contains(string_split(path, '/')[-1], '.') THEN '.' || lower(string_split(path, '.')[-1]) ELSE '' END AS ext, lower(coalesce(content_type, '')) AS kind FROM [[files]]")
cte("adm1", f"""SELECT path, CASE WHEN ext <> '' AND ext NOT IN {lst(v.IMAGE_EXTENSIONS)} THEN 'unsupported file type' WHEN kind <> '' AND kind NOT IN {lst(v.IMAGE_TYPES)} THEN 'unsupported content type'
  WHEN size_bytes = 0 THEN 'empty file' WHEN size_bytes > 20971520 THEN 'file too large' END AS reason FROM [[adm0]]""")
check("file_admission", "SELECT path, reason, CASE WHEN reason IS NULL THEN 200 WHEN reason = 'file too large' THEN 413 ELSE 422 END AS code FROM [[adm1]]")
check("surface_count_check", """SELECT package_id, surfaces, CASE WHEN surfaces = 0 THEN 'no photo' WHEN surfaces > 6 THEN 'too many photos' END AS error
FROM (SELECT l_orderkey AS package_id, count(CASE WHEN l_orderkey % 50 <> 0 THEN l_linenumber END) AS surfaces FROM lineitem GROUP BY 1)""")
check("ruleset_verified", "SELECT ruleset_id, count(*) AS rules, bool_and(verified) AS ruleset_verified FROM [[part_rules]] GROUP BY 1")
check("log_tail", "SELECT line_no, CASE WHEN json_valid(line) THEN json_extract_string(line, '$.k') END AS k, CASE WHEN json_valid(line) THEN CAST(json(line) AS VARCHAR) END AS record, CASE WHEN NOT json_valid(line) THEN trim(line) END AS raw FROM [[log_lines]] ORDER BY line_no DESC LIMIT 50")

# streams: the same as their batch counterparts
check("stream_ingest", "SELECT doc_id, content_hash FROM [[dd]] WHERE status = 'success'")
check("stream_daily_trend", """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (final_decision = 'COMPLIANT') AS compliant,
  count(*) FILTER (final_decision = 'NON_COMPLIANT') AS non_compliant, count(*) FILTER (final_decision = 'MANUAL_REVIEW') AS manual_review,
  date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM [[decisions]]) AS closed FROM [[decisions]] GROUP BY ALL""")
check("stream_audit", "SELECT id, action, actor, details FROM [[audit_log]]")
check("stream_current_decision", "SELECT inspection_id, decision_id, inspector_id, action, final_decision FROM [[curr]]")
