"""Regulation text: clauses, keyword and character vectors, citations."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from pkgscreen import vocab as v
from pkgscreen.functions.text import one_spaced, reg_tokens, sq, strip
from pkgscreen.config import fits, merged, path_exists, scratch_dir, written
from pkgscreen.operators import ingest, search as sr
from pkgscreen.operators import keywords as kw
from pkgscreen.operators import vectors as vec


def rules_to_chunks(rules: DataFrame) -> DataFrame:
    parts = ["title", "requirement", "applicability", "evidence_text"]
    return rules.withColumn("text", F.concat_ws(" ", *[F.expr(f"nullif({p}, '')") for p in parts]))


def clause_text(raw: DataFrame) -> DataFrame:
    """Blocks of a text file; a page mark holds for its block and those after it.

    A file's blocks are cut into runs of one page within its row, so no text is exchanged.
    """
    let = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    first = lambda col, group: f"get(regexp_extract_all({col}, {sq(r'\[p\.\s*(\d+)\]')}, {group}), 0)"
    parts = f"transform(split(text, {sq(r'\n\s*\n')}), (b, i) -> named_struct('block_no', i, 'block', {strip('b')}))"
    mark = f"IF(contains(b.block, '[p.'), CAST({first('b.block', 1)} AS INT), NULL)"
    blocks = f"transform(filter({parts}, b -> b.block <> ''), b -> named_struct('block_no', b.block_no, 'block', b.block, 'mark', {mark}))"
    marked = "filter(transform(bs, (b, i) -> IF(b.mark IS NULL, NULL, i)), i -> i IS NOT NULL)"
    runs = ("transform(concat(array(0), ms), (lo, s) -> named_struct('page', IF(s = 0, CAST(NULL AS INT), get(bs, lo).mark),"
            " 'blocks', slice(bs, lo + 1, coalesce(get(ms, s), size(bs)) - lo)))")
    found = (raw.select("stem", F.expr(f"inline({let('bs', blocks, let('ms', marked, runs))})"))
             .select("stem", "page", F.expr("inline(blocks)")))
    text = F.expr(f"IF(contains(block, '[p.'), {strip(f"replace(block, coalesce({first('block', 0)}, ''), '')")}, block)")
    rule = F.expr(f"IF(lower(left(text, 4)) = 'rule', get(regexp_extract_all(text, {sq(r'(?i)^(Rule\s+[\w()\-.]+)')}, 1), 0), NULL)")
    return (found.withColumn("text", text)
            .select(F.format_string("%s-%03d", "stem", "block_no").alias("chunk_id"), F.regexp_replace("stem", "_", " ").alias("document"),
                    F.coalesce(rule, F.lit("")).alias("rule_reference"), "page", "text", F.substring("text", 1, 300).alias("quote"), F.lit("document").alias("source_type")))


CLAUSE = "struct<id:string,document:string,rule_reference:string,title:string,category:string,text:string,requirement:string,page:int,effective_date:string,url:string>"
ENVELOPE = f"struct<document:string,effective_date:string,url:string,clauses:array<{CLAUSE}>>"


def clause_json(raw: DataFrame) -> DataFrame:
    """Clauses of JSON files: an envelope with clauses, or a bare list of them.

    What a clause says about itself goes before what its envelope says.
    """
    env = F.from_json("json", ENVELOPE)
    rows = (raw.withColumn("e", env).withColumn("items", F.coalesce(F.col("e.clauses"), F.from_json("json", f"array<{CLAUSE}>")))
            .select("stem", "e", F.posexplode("items").alias("n", "c")).withColumn("text", F.coalesce(F.expr("nullif(c.text, '')"), F.col("c.requirement"), F.lit("")))
            .where(F.trim("text") != ""))
    return rows.select(F.coalesce("c.id", F.format_string("%s-%03d", "stem", "n")).alias("chunk_id"),
                       F.coalesce("c.document", "e.document", "stem").alias("document"), F.coalesce("c.rule_reference", F.lit("")).alias("rule_reference"),
                       F.coalesce("c.category", F.lit("")).alias("category"), F.col("c.page").alias("page"), "text", F.coalesce("c.url", "e.url").alias("url"),
                       F.coalesce("c.effective_date", "e.effective_date").alias("effective_date"), F.lit("amendment").alias("source_type"))


def corpus_union(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole


def read_texts(spark, path: str, pattern: str | None = None) -> DataFrame:
    """Whole files with stem and type from the path; undecodable bytes are replaced by the reader. An absent folder has none."""
    if not path_exists(spark, path):
        return name_files(spark.createDataFrame([], "text string, file_name string"))
    reader = spark.read.option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).text(path, wholetext=True)
    return name_files(files.select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("file_name")))


def read_corpus(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """Clauses of all text and JSON files under a folder, and a row (file_name, error) for what could not be loaded.

    JSON is parsed to a variant once; a file that is no JSON, or neither an envelope
    with clauses nor a list of them, is an error row and stops nothing else. Every
    file is one row: a folder of any size is read by many tasks.
    """
    texts = read_texts(spark, folder, "*.txt")
    parsed = read_texts(spark, folder, "*.json").withColumn("parsed", F.try_parse_json("text"))
    kind = F.schema_of_variant("parsed")
    shaped = F.col("parsed").isNotNull() & (kind.startswith("ARRAY") | F.try_variant_get("parsed", "$.clauses", "array<variant>").isNotNull())
    marked = parsed.withColumn("error", F.when(F.col("parsed").isNull(), "not JSON").when(~shaped, "no clauses"))
    good = marked.where("error IS NULL").select("stem", F.to_json("parsed").alias("json"))
    empty = texts.where(F.expr(strip("text")) == "").select("file_name", F.lit("empty file").alias("error"))
    errors = marked.where("error IS NOT NULL").select("file_name", "error").unionByName(empty)
    return corpus_union(clause_text(texts.select("stem", "text")), clause_json(good)), errors


def name_files(files: DataFrame) -> DataFrame:
    return files.withColumns({"file_type": F.expr("IF(contains(file_name, '.'), lower(substring_index(file_name, '.', -1)), '')"),
                              "stem": F.expr("IF(contains(file_name, '.'), left(file_name, length(file_name) - length(substring_index(file_name, '.', -1)) - 1), file_name)")})


def _unit_histograms(texts, digest: str, known: dict[int, int]) -> np.ndarray:
    """A unit vector per text: its character triples counted by hash bucket. ``known`` keeps the buckets of triples met before.

    All texts are one row of code points; a triple is a number, and only distinct ones are hashed.
    """
    texts = [text or "" for text in texts]
    length = np.fromiter(map(len, texts), "int64", len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype("int64")
    owner = np.repeat(np.arange(len(texts)), length)
    starts = max(0, len(points) - v.NGRAM + 1)
    whole = owner[:starts] == owner[len(points) - starts:]  # a triple ends in the text in which it begins
    keys = np.zeros(starts, "int64")
    for place in range(v.NGRAM):
        keys = keys << 21 | points[place:place + starts]
    code, triples = pd.factorize(keys[whole])
    buckets = np.empty(len(triples), "int64")
    hashed = lambda text: int(hashlib.new(digest, text.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % v.VECTOR_DIM
    for n, key in enumerate(triples.tolist()):
        bucket = known.get(key)
        if bucket is None:
            bucket = hashed("".join(chr(key >> 21 * place & 0x1FFFFF) for place in reversed(range(v.NGRAM))))
            if len(known) < KNOWN_TRIPLES:
                known[key] = bucket
        buckets[n] = bucket
    out = np.bincount(owner[:starts][whole] * v.VECTOR_DIM + buckets[code], minlength=len(texts) * v.VECTOR_DIM).reshape(len(texts), v.VECTOR_DIM).astype("float64")
    for row in np.flatnonzero((length > 0) & (length < v.NGRAM)):  # a shorter text is its own only piece
        out[row, hashed(texts[row])] = 1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def ngram_vectors(df: DataFrame, col: str = "text", vectorizer=None, digest: str = "md5") -> DataFrame:
    """Unit vectors of character triples hashed by ``digest``; another vectoriser (column to column) may be given.

    Texts are spaced by the JVM; a triple is hashed once per task, however often it occurs.
    """
    if vectorizer:
        return df.withColumn("vector", vectorizer(F.col(col)))

    def scan(frames):
        known: dict[int, int] = {}
        for f in frames:
            yield f.assign(vector=list(_unit_histograms(f["_spaced"].to_numpy(), digest, known))).drop(columns="_spaced")

    schema = StructType([*df.schema.fields, StructField("vector", ArrayType(DoubleType()))])
    return df.withColumn("_spaced", F.expr(one_spaced(f"lower({col})"))).mapInPandas(scan, schema)


def scanned(queries: DataFrame, words: DataFrame, chunks: DataFrame, index: kw.KeywordIndex, k: int, min_score: float, digest: str = "md5") -> DataFrame:
    """The best ``k`` clauses of a few queries (query_id, embedding) by both scores, without storing a clause's vector or score.

    ``words`` (query_id, term, weight) are the queries' words. A first pass over the
    keyword lists finds the best keyword score of each query; clauses pass once more,
    a batch becomes vectors and counted words, is scored by all queries and leaves its
    best for each of them.
    """
    spark = chunks.sparkSession
    held = queries.toArrow()  # at most SCANNED rows
    ids, q = held["query_id"].combine_chunks(), vec.unit(np.array(held["embedding"].to_pylist()).reshape(-1, v.VECTOR_DIM))
    asked = kw.Asked(words, index.mean)
    top = dict(kw.scanned(words, index, 1).groupBy("query_id").agg(F.max("score")).collect())
    best = np.array([top.get(i, 1.0) for i in asked.ids.to_pylist()])
    sent = spark.sparkContext.broadcast((ids, q, asked, best, pc.index_in(asked.ids, value_set=ids).to_numpy()))

    def scan(batches):
        (ids, q, asked, best, place_of), known = sent.value, {}
        if not len(ids):
            return
        kept, step = kw.Kept(len(ids), k), max(1, kw.SCORED_PAIRS // len(ids))
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            clauses, w = batch.column("chunk_id"), batch.column("w")
            cosine = q @ _unit_histograms(batch.column("_spaced").to_pylist(), digest, known).T
            place = asked.places(w.flatten())
            at = place >= 0
            pair, tf = np.unique(pc.list_parent_indices(w).to_numpy()[at] * max(1, len(asked.terms)) + place[at], return_counts=True)
            row, term = np.divmod(pair, max(1, len(asked.terms)))
            keyword = np.zeros(cosine.shape)
            if len(asked.ids):
                keyword[place_of] = (np.round(asked.scores(batch.num_rows, row, term, tf, pc.list_value_length(w).to_numpy())[0], 9) / best).T
            total = v.KEYWORD_SHARE * keyword + v.VECTOR_SHARE * cosine
            score = np.where(total > min_score, np.floor(total * 1e4 + 0.5) / 1e4, -np.inf)
            query, column = kept.new(clauses.to_numpy(zero_copy_only=False), score)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), clauses.take(pa.array(column)), *map(pa.array, (
                score[query, column], keyword[query, column], cosine[query, column]))], ["query_id", "chunk_id", "score", "keyword_score", "vector_score"])

    kinds = dict(queries.dtypes)["query_id"], dict(chunks.dtypes)["chunk_id"]
    rows = chunks.select("chunk_id", F.expr(one_spaced("lower(text)")).alias("_spaced"), F.expr(f"coalesce({reg_tokens('text')}, array())").alias("w"))
    return rows.mapInArrow(scan, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double, keyword_score double, vector_score double")


def clause_vectors(chunks: DataFrame, vectorizer=None, digest: str = "md5") -> DataFrame:
    """(chunk_id, embedding) of clauses by their text."""
    return ngram_vectors(chunks.select("chunk_id", "text"), "text", vectorizer, digest).select("chunk_id", F.col("vector").alias("embedding"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    postings = ingest.build_postings(chunks.select("chunk_id", F.col("text").alias("content")), reg_tokens("content"))
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def term_lists(chunks: DataFrame) -> DataFrame:
    return ingest.term_lists(chunks.select("chunk_id", F.col("text").alias("content")), reg_tokens("content"))


def write_keyword_index(chunks: DataFrame, path: str) -> None:
    """Index of the whole corpus under ``path``; chunks without a word count among the corpus. Texts are cut once."""
    kw.write_index(term_lists(chunks), path, weight=kw.plus_one_weight)


def keyword_index(chunks: DataFrame) -> kw.KeywordIndex:
    spark = chunks.sparkSession
    path = f"{scratch_dir(spark)}/reg-index-{uuid.uuid4().hex}"
    write_keyword_index(chunks, path)
    return kw.read_index(spark, path)


def bm25_reg(queries: DataFrame, chunks: DataFrame, k: int | None = None, index: kw.KeywordIndex | None = None) -> DataFrame:
    """Keyword scores; weights always come from the whole corpus. The best ``k`` of each query, or every chunk that shares a word."""
    index = index or keyword_index(chunks)
    if k:
        return kw.search(queries, index, k, reg_tokens("query"))
    return kw.all_scores(queries, index, reg_tokens("query"), None)


def search_reg(queries: DataFrame, chunks: DataFrame, k: int = 5, min_score: float = 0.0, vectorizer=None, digest: str = "md5",
               category=None, source_type=None, rule_reference=None, index: kw.KeywordIndex | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Keyword and character score together, best ``k`` clauses of every query, for any number of queries.

    ``index`` and ``vectors`` (chunk_id, embedding) of the corpus may be given, so that many searches share them.

    Filters choose the candidates; keyword scores are relative to the best of them.
    Few queries are ranked in one pass over the clauses. For more, a result has
    either a keyword score near the k-th best, nearer than any character score could
    make up for, or is among the best by characters (ties in the rounded sum
    included); both sets come from searches that skip what cannot reach them. Only
    what may be a result is scored in full.
    """
    asked = queries.where("query <> ''")
    index = index or keyword_index(chunks)
    if category:
        chunks = chunks.where(F.col("category") == category)
    if source_type:
        chunks = chunks.where(F.col("source_type") == source_type)
    if rule_reference:
        chunks = chunks.where(F.contains(F.lower("rule_reference"), F.lit(rule_reference.lower())))
    if category or source_type or rule_reference:  # the blocks' maxima stay bounds
        index = replace(index, postings=index.postings.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), lists=term_lists(chunks))
    q_vectors = written(ngram_vectors(asked.select("query_id", "query"), "query", vectorizer, digest).select("query_id", F.col("vector").alias("embedding")), "reg-queries")
    terms = written(kw.asked_terms(asked, index, reg_tokens("query")), "asked")
    if vectorizer is None and vectors is None and fits(q_vectors, SCANNED) and fits(terms, kw.ASKED_BROADCAST):
        best = sr.top(scanned(q_vectors, terms, chunks, index, k, min_score, digest), k)
        pairs = written(best.select("query_id", "chunk_id", F.col("keyword_score").alias("kw")), "reg-pairs")
        results = F.broadcast(pairs.select("chunk_id").distinct())  # at most k of each of SCANNED queries
        c_vectors = clause_vectors(chunks.join(results, "chunk_id", "left_semi"), None, digest)
    else:
        least = -1.0 if vectorizer else 0.0  # counts of triples have no negative products
        spare = v.VECTOR_SHARE * (1 - least) / v.KEYWORD_SHARE + ROUNDING
        words = written(kw.candidates(asked, index, k, spare, reg_tokens("query")), "reg-words")
        best = words.groupBy("query_id").agg(F.max("score").alias("best"))
        words = words.join(kw.floors(words, k, spare), "query_id", "left").where("floor IS NULL OR score >= floor").join(best, "query_id")
        words = words.select("query_id", "chunk_id", (F.col("score") / F.col("best")).alias("kw"))
        if vectors is None:
            c_vectors = written(clause_vectors(chunks, vectorizer, digest), "reg-clauses")
        else:
            c_vectors = vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi") if category or source_type or rule_reference else vectors
        near = vec.nearest(q_vectors, c_vectors, k, ROUNDING / v.VECTOR_SHARE).select("query_id", "chunk_id", F.lit(0.0).alias("kw"))
        pairs = words.unionByName(near).groupBy("query_id", "chunk_id").agg(F.max("kw").alias("kw"))
    held = pairs.join(q_vectors.withColumnRenamed("embedding", "q"), "query_id").join(c_vectors.withColumnRenamed("embedding", "c"), "chunk_id")

    def multiply(frames):
        for f in frames:
            if len(f):
                yield f.assign(vector_score=np.einsum("ij,ij->i", np.stack(f["q"]), np.stack(f["c"]))).drop(columns=["q", "c"])

    kinds = dict(queries.dtypes)["query_id"], dict(chunks.dtypes)["chunk_id"]
    scored = held.select("query_id", "chunk_id", F.col("kw").alias("keyword_score"), "q", "c").mapInPandas(
        multiply, f"query_id {kinds[0]}, chunk_id {kinds[1]}, keyword_score double, vector_score double")
    total = v.KEYWORD_SHARE * F.col("keyword_score") + v.VECTOR_SHARE * F.col("vector_score")
    found = scored.withColumn("total", total).where(F.col("total") > min_score).withColumn("score", F.floor(F.col("total") * 1e4 + 0.5) / 1e4).drop("total")
    return sr.top(found, k).withColumns({"keyword_score": F.round("keyword_score", 4), "vector_score": F.round("vector_score", 4)})


SCANNED = 1024  # queries whose vectors go to every task; more of them meet stored vectors by cells
KNOWN_TRIPLES = 1_000_000  # triples whose buckets a task keeps
ROUNDING = 2e-4  # scores are compared in steps of 1e-4


CITED_BROADCAST = 10_000  # cited rules or texts that travel to the findings


def _cited(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits(df, CITED_BROADCAST) else merged(df)


def quote_rules(findings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Findings with the clause of their own rule; of the corpus only the clauses of rules that occur are kept, findings are not moved for them."""
    named = chunks.select(F.col("chunk_id").alias("rule_id"), "document", F.col("text").alias("quote"))
    quotes = written(named.join(_cited(findings.select("rule_id").distinct()), "rule_id", "left_semi"), "quotes")
    return findings.join(_cited(quotes), "rule_id")


def cite_findings(findings: DataFrame, chunks: DataFrame, k: int = 1, **shared) -> DataFrame:
    """Clauses behind each finding in doubt: by rule id, else by search, else none.

    Findings repeat few distinct rules and texts: each is looked up once, and the
    answers travel to the findings if they are few (checked), so that these keep
    their partitioning. ``shared`` may give the corpus's ``index`` and ``vectors``, or
    functions that make them: they are called only if there is a text to search for.
    """
    doubt = findings.where("status IN ('FAIL', 'MANUAL_REVIEW')").select("package_id", "rule_id", "status", F.concat_ws(" ", "title", "reason").alias("query"))
    known = written(doubt.select("rule_id").distinct().join(chunks.select(F.col("chunk_id").alias("rule_id"), F.col("chunk_id").alias("exact")), "rule_id"), "cited-rules")
    marked = doubt.join(_cited(known), "rule_id", "left")
    texts = written(marked.where("exact IS NULL").select("query").distinct().withColumn("query_id", F.md5("query")), "cited-texts")
    if texts.isEmpty():  # every finding's rule is in the corpus
        searched = marked.withColumn("found", F.lit(None).cast(chunks.schema["chunk_id"].dataType))
    else:
        ready = {name: part() if callable(part) else part for name, part in shared.items()}
        hits = written(search_reg(texts, chunks, k, **ready).join(texts, "query_id").select("query", F.col("chunk_id").alias("found")), "cited-hits")
        searched = marked.join(_cited(hits), "query", "left")
    return searched.selectExpr("package_id", "rule_id", "status", "coalesce(exact, found) AS chunk_id",
                               "CASE WHEN exact IS NOT NULL THEN 'exact_rule_id' WHEN found IS NOT NULL THEN 'hybrid_search' ELSE 'no_match' END AS retrieval")


def corpus_overview(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.count_distinct("document").alias("documents"), F.count_distinct("source_type").alias("source_types"), F.count("page").alias("with_page"))
