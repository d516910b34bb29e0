"""Skipping blocks never changes the best k, and skips."""

import random

import pytest
from pyspark.sql import functions as F

from pkgscreen.operators import ingest as g
from pkgscreen.operators import keywords as kw


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(7)
    common = ["the", "of", "and", "label"]
    rows = [(c, " ".join(rnd.choices(common, k=rnd.randint(3, 60)) + [f"w{int(rnd.paretovariate(0.7)) % 400}" for _ in range(rnd.randint(0, 20))])) for c in range(1500)]
    rows += [(5000 + c, "the of the rare0 label") for c in range(40)]  # ties
    chunks = spark.createDataFrame(rows, "chunk_id long, content string")
    queries = [(0, "the of w7 w19"), (1, "the label"), (2, "rare0 the and"), (3, "nothing here"), (4, "w3 w3 w11 w200 of"), (5, "and " * 5)]
    return g.build_postings(chunks).cache(), spark.createDataFrame(queries, "query_id long, query string")


@pytest.mark.parametrize("weight", [kw.okapi_weight, kw.plus_one_weight])
@pytest.mark.parametrize("k", [1, 5, 30])
def test_best_k_with_and_without_skipping(spark, corpus, tmp_path, weight, k):
    postings, queries = corpus
    kw.write_index(postings, str(tmp_path), weight=weight, block_chunks=16)
    index = kw.read_index(spark, str(tmp_path))
    row = lambda d: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in d.collect())
    assert row(kw.search(queries, index, k)) == row(kw.ranked(kw.all_scores(queries, index), k))


def test_blocks_are_skipped_and_bounds_hold(spark, corpus, tmp_path):
    postings, queries = corpus
    kw.write_index(postings, str(tmp_path), block_chunks=16)
    index = kw.read_index(spark, str(tmp_path))
    asked = kw.asked_terms(queries, index)
    bounds = kw.block_bounds(asked, index)
    best = kw.all_scores(queries, index).join(index.postings.select("chunk_id", "block").distinct(), "chunk_id").groupBy("query_id", "block").agg(F.max("score").alias("best"))
    assert bounds.join(best, ["query_id", "block"]).where(F.col("best") > F.col("bound") + kw.MARGIN).count() == 0
    tenth = kw.ranked(kw.all_scores(queries, index), 5).where("rank = 5").select("query_id", F.col("score").alias("floor"))
    needed = bounds.join(tenth, "query_id").where(F.col("bound") >= F.col("floor"))
    assert needed.count() < 0.5 * bounds.count()


def test_an_empty_corpus_has_no_hits(spark, corpus, tmp_path):
    kw.write_index(corpus[0].limit(0), str(tmp_path))
    assert kw.search(corpus[1], kw.read_index(spark, str(tmp_path)), 3).count() == 0


def test_pairs_of_query_and_chunk_are_not_exchanged(spark, tmp_path):
    postings = spark.createDataFrame([(n, 3, t, 1 + n % 2) for n in range(60) for t in ("net", "price", f"w{n % 5}")], "chunk_id long, length int, term string, tf long")
    kw.write_index(postings, str(tmp_path / "index"))
    index = kw.read_index(spark, str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "net price"), (2, "w3"), (3, "absent")], "query_id long, query string")
    scores = kw.all_scores(queries, index)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "query_id" in line]
    got = scores.groupBy("query_id").count().collect()
    assert sorted((r.query_id, r["count"]) for r in got) == [(1, 60), (2, 12)]


def test_skipping_blocks_and_scoring_all_agree(spark, corpus, tmp_path):
    postings, queries = corpus
    kw.write_index(postings, str(tmp_path), block_chunks=16)
    index = kw.read_index(spark, str(tmp_path))
    row = lambda d: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in d.collect())
    assert row(kw.ranked(kw.candidates(queries, index, 7), 7)) == row(kw.search(queries, index, 7))


def test_postings_are_exchanged_once(spark, tmp_path):
    """Counted without an exchange; index rows are lists by (term, block), searched without exchanging pairs of query and block."""
    chunks = spark.createDataFrame([(n, f"net price net w{n % 7}, {'pad ' * (n % 3)}") for n in range(300)] + [(300, "..."), (301, None), (302, "")], "chunk_id long, content string")
    postings = g.build_postings(chunks)
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()
    want = sorted((n, 4 + n % 3, t, tf) for n in range(300) for t, tf in [("net", 2), ("price", 1), (f"w{n % 7}", 1)] + [("pad", n % 3)] * bool(n % 3))
    assert sorted(tuple(r) for r in postings.select("chunk_id", "length", "term", "tf").collect()) == want
    kw.write_index(postings, str(tmp_path / "index"), block_chunks=16)
    listed = spark.read.parquet(str(tmp_path / "index" / "blocks"))
    assert listed.groupBy("term", "block").count().where("count > 1").count() == 0
    assert listed.selectExpr("max(size(postings)) AS n").first().n <= 300 and listed.selectExpr("sum(size(postings)) AS n").first().n == len(want)
    index = kw.read_index(spark, str(tmp_path / "index"))
    found = kw.search(spark.createDataFrame([(1, "price w3")], "query_id long, query string"), index, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "block" in x]


def test_an_index_is_built_and_read_without_exchanging_postings(spark, tmp_path, monkeypatch):
    """Lists of terms become blocks where they lie; a few queries meet them there, whatever is scored at once."""
    rnd = random.Random(3)
    rows = [(f"c{n:03d}", " ".join(rnd.choices(["net", "price", "of", "maker", "é", "w1", "w2", "w3"], k=rnd.randint(0, 9)))) for n in range(300)] + [("none", "..."), ("null", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string").repartition(5)
    lists = g.term_lists(chunks)
    kw.write_index(lists, str(tmp_path / "lists"), block_chunks=16, weight=kw.plus_one_weight)
    assert "Exchange" not in kw.block_rows(spark.read.parquet(str(tmp_path / "lists" / "lists")), 3.0, 16)._jdf.queryExecution().executedPlan().toString()
    index = kw.read_index(spark, str(tmp_path / "lists"))
    counted = [r[1].split() for r in rows if r[1]]
    assert index.mean == pytest.approx(sum(len(w) * (w != ["..."]) for w in counted) / len(counted))
    bounds = {(r.term, r.block): (r.most, r.least) for r in index.maxima.collect()}
    posted = [(r.term, r.block, r.chunk_id, r.share) for r in index.postings.collect()]
    assert len({p[:3] for p in posted}) == len(posted) == sum(len(set(w)) for w in counted if w != ["..."]) and {p[:2] for p in posted} == set(bounds)
    assert all(bounds[t, b][1] <= s <= bounds[t, b][0] for t, b, _, s in posted)
    queries = spark.createDataFrame([("a", "net price net"), ("b", "é w3"), ("c", "absent")], "query_id string, query string")
    row = lambda d: sorted((r.query_id, r.chunk_id, round(r.score, 6)) for r in d.collect())
    want = row(kw._scores(kw.asked_terms(queries, index), index))
    best = sorted((q, n + 1, c, s) for q in "ab" for n, (q, c, s) in enumerate(sorted((w for w in want if w[0] == q), key=lambda w: (-w[2], w[1]))[:5]))
    for pairs in (7, 1_000_000):
        monkeypatch.setattr(kw, "SCORED_PAIRS", pairs)
        assert row(kw.all_scores(queries, index)) == want and len(want) > 100
        assert sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in kw.search(queries, index, 5).collect()) == best
