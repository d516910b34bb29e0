"""Operators against brute force on small inputs."""

import numpy as np
import pytest

from pkgscreen.operators import ingest as g
from pkgscreen.operators import repository as repo
from pkgscreen.operators import search as s
from pkgscreen.operators import vectors as vec
from pkgscreen.sources import tables


def brute_chunks(text, size=300, overlap=40, least=20):
    import re
    words = lambda x: len(x.split())
    out, cur = [], []
    for sent in re.split(r"(?<=[.!?]) ", " ".join(text.split())):
        if cur and sum(map(words, cur)) + words(sent) > size:
            out.append(" ".join(cur))
            back = []
            while cur and sum(map(words, back)) < overlap:
                back.insert(0, cur.pop())
            cur = back
        cur.append(sent)
    return [c for c in [*out, " ".join(cur)] if words(c) > least]


def test_chunks_match_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(" ".join(["word"] * rng.integers(1, 60)) + "." for _ in range(rng.integers(1, 40))) for _ in range(20)]
    got = g.chunk_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for n, t in enumerate(texts):
        assert [r.content for r in sorted(got, key=lambda r: r.chunk_id) if r.doc_id == n] == brute_chunks(t)


@pytest.mark.parametrize("clustered", [False, True])
def test_nearest_by_cells_equals_brute_force_and_skips_cells(spark, monkeypatch, clustered):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 8)) * 3
    make = lambda n: np.round([centers[i % 12] + rng.normal(size=8) * 0.2 if clustered else rng.normal(size=8) for i in range(n)], 3)
    x, q = make(1200), make(60)
    x[77] = x[5]  # a tie
    rows = lambda a: [(i, [float(y) for y in r], "text") for i, r in enumerate(a)]
    stored = spark.createDataFrame(rows(x), "chunk_id long, embedding array<double>, chunk_type string")
    asked = spark.createDataFrame(rows(q), "query_id long, embedding array<double>, chunk_type string")
    monkeypatch.setattr(vec, "VECTORS_PER_CELL", 20)
    monkeypatch.setattr(vec, "QUERY_PART", 7)
    monkeypatch.setattr(vec, "VECTOR_PART", 11)
    scores = np.round(q / np.linalg.norm(q, axis=1, keepdims=True) @ x.T, 9)
    got = {(r.query_id, r["rank"]): r.chunk_id for r in s.vector_topk(asked, stored, 5).collect()}
    assert got == {(i, n + 1): j for i in range(60) for n, j in enumerate(np.lexsort((np.arange(1200), -scores[i]))[:5])}
    near = {(r.query_id, r.chunk_id) for r in vec.nearest(asked, stored, 5, slack=0.05).collect()}
    assert near == {(i, j) for i in range(60) for j in np.flatnonzero(scores[i] >= np.sort(scores[i])[-5] - 0.05)}
    if clustered:
        _, sizes = vec.into_cells(stored)
        bounds = vec.cell_bounds(asked, sizes).toPandas()
        fifth = np.sort(scores, axis=1)[:, -5]
        assert (bounds["bound"] >= fifth[bounds["query_id"]]).mean() < 0.6


def test_chunks_that_differ_behind_800_characters_both_stay(spark):
    hits = spark.createDataFrame([(1, 1, 1, 0.5), (1, 2, 2, 0.4), (1, 3, 3, 0.3)], "query_id long, chunk_id long, rank int, score double")
    chunks = spark.createDataFrame([(1, 1, "x " * 500 + "a"), (2, 2, "x " * 500 + "b"), (3, 3, "X " * 500 + " b")], "chunk_id long, doc_id long, content string")
    docs = spark.createDataFrame([(n, f"h{n}", "web") for n in (1, 2, 3)], "doc_id long, content_hash string, source string")
    assert sorted(r.chunk_id for r in s.dedup_hits(s.enrich_hits(hits, chunks, docs)).collect()) == [1, 2]


def test_every_query_gets_as_many_sources_as_it_asks_for(spark):
    queries = s.admit_queries(spark.createDataFrame([(1, "a", 3), (2, "a", 12), (3, "a", None), (4, "a", 21)], "query_id long, query string, k int"))
    assert [r.error for r in queries.orderBy("query_id").collect()] == [None, None, None, "k out of range"]
    hits = spark.createDataFrame([(q, c, c, 0, "a b", 0.5, c / 10) for q in (1, 2, 3) for c in range(1, 31)],
                                 "query_id long, chunk_id long, rank int, origin int, content string, score double, logit double")
    got = s.final_sources(s.relevant(hits, queries.where("error IS NULL"))).collect()
    for query, k in ((1, 3), (2, 12), (3, 5)):  # the best of the first 2k by rank
        assert sorted(r.chunk_id for r in got if r.query_id == query) == list(range(k + 1, 2 * k + 1))


def test_long_documents_are_chunked_in_linear_time(spark):
    import time
    text = " ".join(f"w{i} is a word here." for i in range(60_000))  # over a megabyte
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    got = [r.content for r in g.chunk_documents(one).orderBy("chunk_id").collect()]
    assert time.time() - start < 30 and got == brute_chunks(text)


def test_payloads_are_found_in_their_bucket_and_replaced(spark, tmp_path):
    path = str(tmp_path / "payloads")
    rows = spark.range(300).selectExpr("id AS inspection_id", "'v' || id AS name")
    repo.store_payloads(repo.to_payload(rows, "inspection_id"), path, buckets=16)
    repo.store_payloads(repo.to_payload(rows.where("inspection_id < 3").selectExpr("inspection_id", "'new' AS name"), "inspection_id"), path, buckets=16)
    one = repo.get_payload(spark, path, 2, buckets=16)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert [r.payload for r in one.collect()] == ['{"inspection_id":2,"name":"new"}'] and "PartitionFilters: [isnotnull(bucket" in plan
    assert repo.get_payload(spark, path, 1000, buckets=16).count() == 0
    asked = spark.createDataFrame([(5,), (1,), (999,), (5,)], "inspection_id long")
    found = {r.inspection_id: (r.found, r.payload) for r in repo.find_payloads(asked, path, buckets=16).collect()}
    assert found == {5: (True, '{"inspection_id":5,"name":"v5"}'), 1: (True, '{"inspection_id":1,"name":"new"}'), 999: (False, None)}
    assert "PartitionFilters: [bucket" in repo.find_payloads(asked, path, buckets=16)._jdf.queryExecution().executedPlan().toString()
    assert repo.read_payloads(spark, path).count() == 300


def test_a_busy_inspection_on_one_day_is_linked_over_ranges(spark):
    rows = [(n * 7 % 5003, 7, f"2026-01-01 00:{n // 100 % 60:02d}:00") for n in range(5003)] + [(9000, 8, "2026-01-01 00:00:00"), (9001, None, "2026-01-01 00:00:00"), (9002, None, "2026-01-02 00:00:00")]
    d = spark.createDataFrame(rows, "decision_id long, inspection_id long, ts string").selectExpr("* EXCEPT (ts)", "CAST(ts AS TIMESTAMP) AS ts")
    got = {r.decision_id: (r.supersedes, r.superseded) for r in repo.supersede(d).collect()}
    order = sorted((r[2], r[0]) for r in rows if r[1] == 7)
    want = {i: (order[n - 1][1] if n else None, n < len(order) - 1) for n, (_, i) in enumerate(order)}
    assert got == want | {9000: (None, False), 9001: (None, True), 9002: (9001, False)}


def test_one_current_decision_and_linked_history(spark):
    rows = [(n, 7, "i", "ACCEPT", "COMPLIANT", f"2026-01-{1 + n // 3:02d} 0{n % 3}:00:00") for n in range(12)]
    d = spark.createDataFrame(rows, "decision_id long, inspection_id long, inspector_id string, action string, final_decision string, ts string").selectExpr(
        "* EXCEPT (ts)", "CAST(ts AS TIMESTAMP) AS ts")
    got = {r.decision_id: r for r in repo.supersede(d).collect()}
    assert [n for n in got if not got[n].superseded] == [11]
    assert all(got[n].supersedes == n - 1 for n in range(1, 12)) and got[0].supersedes is None


def test_dedup_is_idempotent(spark):
    docs = g.with_hash(spark.createDataFrame([(1, "a", "f"), (2, "a", "f"), (3, "b", "f")], "doc_id long, text string, file_name string"))
    kept = g.dedup_documents(docs).where("status = 'success'")
    assert {r.doc_id for r in kept.collect()} == {1, 3}
    assert g.dedup_documents(docs, kept).where("status = 'success'").count() == 0


def test_rule_and_photo_files(spark, tmp_path):
    (tmp_path / "rules.json").write_text('{"ruleset_id": "own", "version": "1", "ruleset_verified": false, "rules": [{"rule_id": "A", "fields": ["mrp"], "verified": true}]}')
    assert tables.read_ruleset(spark, str(tmp_path / "rules.json")).first().rule_id == "A"
    (tmp_path / "p.json").write_text('{"package_id": 1, "surface_idx": 0, "surface_name": "s", "texts": ["x"], "confidences": [0.9], "bounding_boxes": [[[1, 2], [5, 2], [5, 9], [1, 9]]]}')
    line = tables.lines_of(tables.read_photos(spark, str(tmp_path / "p.json"))).first()
    assert (line.text, line.x_min, line.y_max) == ("x", 1, 9)


def test_a_query_is_sent_to_groups_of_cells_not_to_each_cell(spark, monkeypatch):
    """Copies of rows grow with parts; skipped cells, crowds of equal vectors and short tables change nothing."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(900, 6)), 2)
    x[100:400] = x[7]  # a crowd at the edge
    x[500:503] = 0
    q = np.concatenate([x[::9], [np.zeros(6)]])
    stored = spark.createDataFrame([(f"c{i:04d}", [float(y) for y in r]) for i, r in enumerate(x)], "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(q)] + [(999, None)], "query_id long, embedding array<float>")
    monkeypatch.setattr(vec, "VECTORS_PER_CELL", 15)
    monkeypatch.setattr(vec, "VECTOR_PART", 200)
    monkeypatch.setattr(vec, "QUERY_PART", 40)
    rows, sizes = vec.into_cells(stored)
    groups = vec.into_groups(sizes, 200)
    assert len(sizes) > 30 and groups["group"].max() <= 9 and groups.groupby("group")["cell"].count().max() > 5
    assert (groups["parts"] == np.ceil(sizes["n"].to_numpy() / 200)).all() and groups["parts"].max() == 2
    sent = vec.needed_groups(asked.where("embedding IS NOT NULL").selectExpr("*", "CAST(NULL AS DOUBLE) AS floor"), sizes, groups, 0.0)
    copies = {len(r.groups) for r in sent.collect()}
    assert copies == {(groups["group"] + groups["parts"]).max()} and max(copies) < len(sizes) / 3  # without a floor: all groups, few copies
    f = lambda a: a.astype("float32").astype("float64")
    scores = np.round(vec.unit(f(q)) @ f(x).T, 9)
    for crowd in (0, 16):
        monkeypatch.setattr(vec, "CROWD", crowd)
        got = {(r.query_id, r["rank"]): r.chunk_id for r in vec.nearest(asked, stored, 4).collect()}
        assert got == {(i, n + 1): f"c{j:04d}" for i in range(len(q)) for n, j in enumerate(np.lexsort((np.arange(900), -scores[i]))[:4])}
    few = vec.nearest(asked, stored.limit(3), 5)
    assert few.count() == 3 * len(q) and vec.nearest(asked, stored.limit(0), 5).count() == 0


def test_parts_are_bounded_and_occupy_the_cores():
    assert vec.part_sizes(615_000, 615_000, 64, 12) == (65_536, 65_536)
    assert vec.part_sizes(615_000, 615_000, 512, 12) == (8192, 8192)
    assert vec.part_sizes(200, 615_000, 64, 12) == (2048, 12_813)
    assert vec.part_sizes(0, 0, 64, 12) == (2048, 2048)


def test_fused_ranks_of_both_searches_move_no_posting(spark, tmp_path):
    """Ranks by word come from the lists of chunks alone; fused with ranks by vector as by hand."""
    from dataclasses import replace

    from pkgscreen.operators import keywords as kw

    texts = ["red apple pie", "green apple", "red car", "blue car red paint red", "pie of the day"] * 8
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    kw.write_index(g.term_lists(chunks), str(tmp_path), wordless=False)
    index = replace(kw.read_index(spark, str(tmp_path)), postings=None, maxima=None)
    queries = spark.createDataFrame([(1, "red apple"), (2, "car of")], "query_id long, query string")
    words = s.bm25_topk(queries, index, 6)
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "chunk_id" in x]
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(40, 5)), rng.normal(size=(2, 5))
    frame = lambda a, first, key: spark.createDataFrame([(first + i, [float(y) for y in r]) for i, r in enumerate(a)], f"{key} long, embedding array<double>")
    near = s.vector_topk(frame(q, 1, "query_id"), frame(x, 0, "chunk_id"), 6)
    got = {(r.query_id, r.chunk_id): r.score for r in s.rrf(words.select("query_id", "chunk_id", "rank").unionByName(near.select("query_id", "chunk_id", "rank"))).collect()}
    want = {}
    for i, asked in ((1, ["red", "apple"]), (2, ["car", "of"])):
        df = {w: sum(w in t.split() for t in texts) for w in {*" ".join(texts).split()}}
        raw = {w: np.log(40 - n + 0.5) - np.log(n + 0.5) for w, n in df.items()}
        least, mean = 0.25 * np.mean(list(raw.values())), np.mean([len(t.split()) for t in texts])
        score = {}
        for c, t in enumerate(texts):
            tf = {w: t.split().count(w) for w in asked if w in t.split()}
            if tf:
                score[c] = round(sum((raw[w] if raw[w] >= 0 else least) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len(t.split()) / mean)) for w, n in tf.items()), 9)
        by_vector = np.lexsort((np.arange(40), -np.round(vec.unit(q) @ x.T, 9)[i - 1]))[:6]
        for n, c in [*enumerate(sorted(score, key=lambda c: (-score[c], c))[:6]), *enumerate(by_vector.tolist())]:
            want[i, c] = want.get((i, c), 0) + 1 / (41 + n)
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
