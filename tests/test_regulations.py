import json

import numpy as np
from pyspark.sql import functions as F

from pkgscreen.operators import regsearch, vectors


def clauses(spark, n=3):
    names = ["document", "source_type", "category", "rule_reference", "title", "chunk_id", "text"]
    texts = ["net quantity on the label", "price of the package", "name of the maker"]
    rows = [(f"d{i}", "rule", "c", f"R{i}", f"t{i}", f"c{i:04d}", texts[i % 3] + (f" in part {i * 7919 % 97} of {i}" if i > 2 else "")) for i in range(n)]
    return spark.createDataFrame(rows, names)


def test_search_takes_any_number_of_queries_in_any_parts(spark, monkeypatch):
    chunks = clauses(spark)
    queries = spark.createDataFrame([(i, ["quantity label", "package price", "maker name"][i % 3]) for i in range(30)], "query_id long, query string")
    rows = lambda: sorted((r.query_id, r.chunk_id, r.score) for r in regsearch.search_reg(queries, chunks, 1).select(F.col("query_id"), "chunk_id", "score").collect())
    whole = rows()
    monkeypatch.setattr(vectors, "QUERY_PART", 7)
    assert rows() == whole and len(whole) == 30


def test_pruned_search_equals_scoring_everything(spark, monkeypatch):
    monkeypatch.setattr(vectors, "VECTORS_PER_CELL", 10)
    monkeypatch.setattr(regsearch.kw, "BLOCK_CHUNKS", 8)
    chunks = clauses(spark, 240)
    asked = ["quantity in part 5", "price", "maker of part 12 and 13", "xyzzy", "the label of the package"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    words = {(r.query_id, r.chunk_id): r.score for r in regsearch.bm25_reg(queries, chunks).collect()}
    vector = lambda df, col, key: {r[key]: np.array(r.vector) for r in regsearch.ngram_vectors(df, col).collect()}
    q, c = vector(queries, "query", "query_id"), vector(chunks, "text", "chunk_id")
    want = {}
    for i in q:
        best = max((s for (a, _), s in words.items() if a == i), default=1)
        total = {j: 0.65 * words.get((i, j), 0) / best + 0.35 * float(q[i] @ c[j]) for j in c}
        want[i] = sorted(((-np.floor(t * 1e4 + 0.5) / 1e4, j) for j, t in total.items() if t > 0))[:5]
    got = {}
    for r in sorted(regsearch.search_reg(queries, chunks, 5).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((-r.score, r.chunk_id))
    assert got == {i: w for i, w in want.items() if w}


def test_a_folder_of_good_broken_and_odd_files(spark, tmp_path):
    folder = tmp_path / "corpus"
    (folder / "deep").mkdir(parents=True)
    (folder / "a_rules.txt").write_text("[p. 4] Rule 6(1) first\n\nsecond block")
    (folder / "empty.txt").write_text(" \n")
    (folder / "good.json").write_text(json.dumps({"document": "D", "url": "u", "clauses": [{"id": "X1", "text": "one", "page": 2}, {"text": " "}]}))
    (folder / "deep" / "list.json").write_text(json.dumps([{"requirement": "two"}]))
    (folder / "broken.json").write_text('{"clauses": [')
    (folder / "other.json").write_text('{"a": 1}')
    found, errors = regsearch.read_corpus(spark, str(folder))
    assert {(r.chunk_id, r.text, r.page) for r in found.collect()} == {("a_rules-000", "Rule 6(1) first", 4), ("a_rules-001", "second block", 4), ("X1", "one", 2), ("list-000", "two", None)}
    assert {(r.file_name, r.error) for r in errors.collect()} == {("empty.txt", "empty file"), ("broken.json", "not JSON"), ("other.json", "no clauses")}
    found, errors = regsearch.read_corpus(spark, str(tmp_path / "absent"))
    assert found.count() == 0 and errors.count() == 0


def test_findings_whose_rules_are_in_the_corpus_need_no_search(spark):
    findings = spark.createDataFrame([(1, "r1", "FAIL", "price", "absent"), (2, "r1", "PASS", "price", "ok"), (3, "r2", "MANUAL_REVIEW", "date", "unclear")],
                                     "package_id long, rule_id string, status string, title string, reason string")
    chunks = spark.createDataFrame([("r1", "price rule"), ("r2", "date rule"), ("x", "other")], "chunk_id string, text string")

    def index():
        raise AssertionError("nothing is searched for")

    cited = regsearch.cite_findings(findings, chunks, index=index)
    assert sorted((r.package_id, r.chunk_id, r.retrieval) for r in cited.collect()) == [(1, "r1", "exact_rule_id"), (3, "r2", "exact_rule_id")]


def test_few_queries_scan_clauses_as_the_cells_would(spark, monkeypatch):
    texts = [("", 0)] + [(f"Net quantity {n} grams" if n % 4 == 0 else f"é kilogrammes {n}" if n % 4 == 1 else f"maker's address, street {n}", n) for n in range(1, 40)]
    chunks = spark.createDataFrame(texts, "text string, chunk_id long").repartition(3)
    queries = spark.createDataFrame([(1, "net quantity 3 grams"), (2, "kilogrammes é")], "query_id long, query string")
    scan = {(r.query_id, r.chunk_id): (r.score, r["rank"]) for r in regsearch.search_reg(queries, chunks, 4, digest="sha1").collect()}
    made, vectors_of = [], regsearch.clause_vectors
    monkeypatch.setattr(regsearch, "clause_vectors", lambda clauses, *rest: made.append(clauses.count()) or vectors_of(clauses, *rest))
    regsearch.search_reg(queries, chunks, 4, digest="sha1").collect()
    assert max(made) < 40  # only clauses that may be results get a stored vector
    monkeypatch.setattr(regsearch, "SCANNED", 0)
    cells = {(r.query_id, r.chunk_id): (r.score, r["rank"]) for r in regsearch.search_reg(queries, chunks, 4, digest="sha1").collect()}
    assert scan == cells and len(scan) >= 8


def histogram(text, digest):
    """A text's triples counted one by one."""
    import hashlib

    out = np.zeros(regsearch.v.VECTOR_DIM)
    for i in range(max(1, len(text) - 2) if text else 0):
        out[int(hashlib.new(digest, text[i:i + 3].encode()).hexdigest()[:8], 16) % len(out)] += 1
    return out / (np.linalg.norm(out) or 1)


def test_triples_of_a_batch_are_those_of_each_text():
    texts = ["net quantity", "", "ab", "né 😀 à", None, "aaaa", "x", "net"]
    for digest in ("md5", "sha1"):
        known = {}
        for _ in range(2):
            assert np.allclose(regsearch._unit_histograms(texts, digest, known), [histogram(t or "", digest) for t in texts])
    assert regsearch._unit_histograms([], "md5", {}).shape == (0, regsearch.v.VECTOR_DIM)


def test_pages_hold_on_without_moving_texts(spark):
    texts = {"a_b": "first\n\n[p. 4] Rule 6(1) x\n \n\n  second \n\n[p. 9] [p. 2]\n\nthird", "c": "[p. 1] only", "d": " \n\n ", "e": None, "f": "plain"}
    found = regsearch.clause_text(spark.createDataFrame(list(texts.items()), "stem string, text string"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.chunk_id, r.document, r.rule_reference, r.page, r.text) for r in found.collect()) == [
        ("a_b-000", "a b", "", None, "first"), ("a_b-001", "a b", "Rule 6(1)", 4, "Rule 6(1) x"), ("a_b-002", "a b", "", 4, "second"),
        ("a_b-003", "a b", "", 9, "[p. 2]"), ("a_b-004", "a b", "", 9, "third"), ("c-000", "c", "", 1, "only"), ("f-000", "f", "", None, "plain")]


def few(spark, monkeypatch, digest, **chosen):
    """Few queries by one pass, and by both scores of every clause; pairs of query and clause are neither written nor exchanged."""
    chunks = clauses(spark, 240).withColumn("source_type", F.expr("IF(right(chunk_id, 1) = '7', 'document', 'rule')")).repartition(3)
    asked = ["quantity in part 5", "price", "maker of part 12 and 13", "xyzzy", "the label of the package", ""]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    kept = [r for r in chunks.collect() if not chosen or (r.source_type == "document" and "r1" in r.rule_reference.lower())]
    words = {(r.query_id, r.chunk_id): r.score for r in regsearch.bm25_reg(queries, chunks).collect()}
    want = {}
    for i, query in enumerate(asked[:-1]):
        own = {r.chunk_id: words.get((i, r.chunk_id), 0) for r in kept}
        best = max(own.values()) or 1
        total = {r.chunk_id: 0.65 * own[r.chunk_id] / best + 0.35 * float(histogram(query, digest) @ histogram(r.text, digest)) for r in kept}
        want[i] = sorted((-np.floor(t * 1e4 + 0.5) / 1e4, j) for j, t in total.items() if t > 0)[:5]

    def no(*_):
        raise AssertionError("a row per query and clause")

    monkeypatch.setattr(regsearch.kw, "_candidates", no)
    for pairs in (50, 1_000_000):
        monkeypatch.setattr(regsearch.kw, "SCORED_PAIRS", pairs)
        got = {}
        for r in sorted(regsearch.search_reg(queries, chunks, 5, digest=digest, **chosen).collect(), key=lambda r: r["rank"]):
            got.setdefault(r.query_id, []).append((-r.score, r.chunk_id))
        assert got == {i: w for i, w in want.items() if w} and len(got) >= 4


def test_few_queries_leave_only_their_best(spark, monkeypatch):
    few(spark, monkeypatch, "md5")


def test_few_queries_over_chosen_clauses_leave_only_their_best(spark, monkeypatch):
    few(spark, monkeypatch, "md5", source_type="document", rule_reference="r1")


def test_few_queries_by_another_digest_leave_only_their_best(spark, monkeypatch):
    few(spark, monkeypatch, "sha1")


def test_findings_are_cited_by_the_clauses_lists_alone(spark):
    """No posting is read or exchanged for the few texts that findings repeat."""
    findings = spark.createDataFrame([(p, f"F{p % 2}", "FAIL", ["declare the price", "declare the maker"][p % 2], "absent") for p in range(40)] + [(90, "r1", "FAIL", "price", "absent")],
                                     "package_id long, rule_id string, status string, title string, reason string")
    chunks = spark.createDataFrame([("r1", "net quantity"), ("r2", "the price is to be declared"), ("r3", "the maker and the place"), ("r4", "")], "chunk_id string, text string")
    index = regsearch.keyword_index(chunks)
    index = regsearch.replace(index, postings=None, maxima=None)
    cited = {r.package_id: (r.chunk_id, r.retrieval) for r in regsearch.cite_findings(findings, chunks, index=index).collect()}
    assert cited == {90: ("r1", "exact_rule_id")} | {p: (["r2", "r3"][p % 2], "hybrid_search") for p in range(40)}


def test_trimmed_texts_are_those_of_the_pattern(spark):
    import random

    from pkgscreen import vocab as v
    from pkgscreen.functions.text import one_spaced, sq, strip

    rnd = random.Random(1)
    odd = [chr(c) for c in range(1, 0x3100) if not chr(c).isalnum()] + ["﻿", "　", "a", "b"]
    blank = [c for c in odd if c.isspace()] + ["᠎", "​"]
    rows = [("".join(rnd.choices(rnd.choice([odd, blank, [*blank, "a", "é"]]), k=rnd.randint(0, 8))),) for _ in range(4000)] + [(c,) for c in odd] + [(None,)]
    pattern = lambda col: f"regexp_replace({col}, {sq('^' + v.WS + '+|' + v.WS + '+$')}, '')"
    spaced = f"regexp_replace(t, {sq(v.WS + '+')}, ' ')"
    found = spark.createDataFrame(rows, "t string").selectExpr(f"{strip('t')} <=> {pattern('t')} AS a", f"{one_spaced('t')} <=> {pattern(spaced)} AS b")
    assert found.where("NOT a OR NOT b").count() == 0
