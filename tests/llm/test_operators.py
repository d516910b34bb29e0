"""The training-data operators against brute force on small tables with odd rows."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pkgscreen.llm import importance, line_dedup, near_dedup, neighbours, packing, pieces, quality_rules, sitetree, tokencount, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, sig string"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice(["th", "an", "é", "re", "Ti"]) for _ in range(rnd.randint(1, 4)))
    out = {i: "\n".join(" ".join(word() for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 6))) for i in range(40)}
    base = [word() + str(i) for i in range(120)]
    for i in range(40, 90):  # near copies around one text, most of them unlike each other
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = word() + "x"
        out[i] = " ".join(w) + "\nShared LINE \t\nend"
    return out | {90: None, 91: "", 92: "one", 93: "one", 94: "a b c " * 3000, 95: " \n\t\n", 96: "shared line\n" + out[1], 97: out[1]}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, None if i % 7 == 0 else "en", "hot" if i % 3 else None, 0, "own", "own") for i, t in texts.items()], DOCS).cache()


def test_quality_counts_and_clashing_columns(spark, docs, texts):
    got = {r.doc_id: r for r in quality_rules.evaluate(docs).collect()}
    for i, t in texts.items():
        w = WORD.findall(t or "")
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {j + k for j in range(len(w) - 2) if windows[tuple(w[j:j + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert tuple(getattr(got[i], c) for c in quality_rules.COUNTS) == want
        assert got[i].base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    kept = quality_rules.apply(docs)
    assert kept.columns == docs.columns and {r.n_words for r in kept.collect()} <= {"own"}
    assert quality_rules.evaluate(docs.limit(0)).count() == 0


def test_quality_cuts_against_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(400):  # words of 4 to 8, of 70 to 100 (a script without spaces), markup, and a small source of long junk
        kind = ("en", "web") if i < 200 else ("zh", "web") if i < 300 else ("en", "markup") if i < 390 else (None, "junk")
        low, high = {("zh", "web"): (70, 100), (None, "junk"): (300, 900)}.get(kind, (4, 8))
        word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(low, high))) + ("<$|#" * rnd.randint(0, 2) if kind[1] == "markup" else "")
        rows.append((i, " ".join(word() for _ in range(60)), *kind))
    got = {r.doc_id: r for r in quality_rules.evaluate(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    sketch = defaultdict(Counter)
    value = {}
    for i, _, lang, source in rows:
        n = got[i].n_words
        value[i] = dict(symbols=(got[i].n_symbols + 1) / n, long_words=got[i].word_chars / n, dup_lines=(got[i].n_dup_lines + 1) / n, repeats=(got[i].n_repeat_words + 1) / n)
        for rule, v in value[i].items():
            cell = int(np.ceil(np.log(v) / np.log(1.02)))
            for key in ((), (lang,), (lang, source)):
                sketch[key, rule][cell] += 1

    def shrink(own, prior):
        total = sum(prior.values())
        return {c: own[c] + 100 * prior.get(c, 0) / total for c in {*own, *prior}}

    def quantile(cells, q):
        upto = 0
        for c in sorted(cells):
            upto += cells[c]
            if upto >= q * sum(cells.values()) - 1e-6:
                return c

    for i, _, lang, source in rows:
        kept = True
        for rule, least in (("symbols", 18), ("long_words", 2), ("dup_lines", 18), ("repeats", 18)):
            own = shrink(sketch[(lang, source), rule], shrink(sketch[(lang,), rule], sketch[(), rule]))
            m, u = quantile(own, 0.5), quantile(own, 0.75)
            away = max(u - m, least)
            cut = 1.02**m * (1 + 6 * (1.02**away - 1)) if rule == "long_words" else 1.02 ** (m + 6 * away)
            assert abs(got[i][f"cut_{rule}"] - cut) < 1e-6, (rule, lang, source)
            kept = kept and value[i][rule] <= cut
        assert got[i].kept == kept
        assert kept == (source != "junk"), i  # clean documents stay whatever their script; a small source of junk does not excuse itself


def test_quality_cuts_come_from_the_sketches(spark):
    """On ordinary documents no group's cut is a constant, and a source that differs gets another cut."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cuts = [f"cut_{rule}" for rule in quality_rules.RULES]
    groups = quality_rules.evaluate(docs).select("lang", "source", *cuts).distinct().collect()
    for cut in cuts:
        # sources of one language have words of the same mean length, to within a cell
        assert len({round(g[cut], 6) for g in groups}) > (2 if cut == "cut_long_words" else len(groups) / 4), cut
    moved = docs.withColumn("text", F.when(F.col("lang") == "en", F.concat("text", F.expr("repeat(' # $ %', 30)"))).otherwise(F.col("text")))
    again = {(g.lang, g.source): g for g in quality_rules.evaluate(moved).select("lang", "source", *cuts).distinct().collect()}
    english = [g for g in groups if g.lang == "en"]
    assert sum(again[g.lang, g.source].cut_symbols > 2 * g.cut_symbols for g in english) > 0.9 * len(english)


def test_lines(docs, texts):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    gone = {k for k, v in holders.items() if k and len(v) >= 10}
    for r in line_dedup.dedup(docs).collect():
        lines = (texts[r.doc_id] or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        assert (r.n_lines, r.n_dropped, r.kept_text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    later = {r.doc_id: r.n_dropped for r in line_dedup.dedup(docs, drop="later").collect()}
    assert later[40] == 0 and later[41] == 2 and later[96] == 1
    assert line_dedup.apply(docs).columns == docs.columns and line_dedup.dedup(docs.limit(0)).count() == 0


def brute_components(texts, k, similar):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= similar * (len(sets[i]) + len(sets[j]) - both):
                a, b = up[i], up[j]
                up = {x: min(a, b) if y in (a, b) else y for x, y in up.items()}
    return {i: (len(sets[i]), up[i]) for i in sets}


@pytest.mark.parametrize("block", [4096, 7])
def test_near_copies(docs, texts, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.dedup(docs).collect()}
    assert got == brute_components(texts, 3, 85)
    if block == 4096:
        assert near_dedup.apply(docs).columns == docs.columns and near_dedup.dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4096, 16])
def test_near_copies_in_dense_regions(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "DENSE", 1)
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block)
    texts = {}
    for i in range(150):  # pairs of similarity 90 / 112, just above 0.80
        both = [f"p{i}w{j}" for j in range(90)]
        texts[2 * i] = " ".join(both + [f"a{i}x{j}" for j in range(11)])
        texts[2 * i + 1] = " ".join(both + [f"b{i}x{j}" for j in range(11)])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 1, 80).collect()}
    assert got == brute_components(texts, 1, 80)


def test_a_task_holds_two_blocks_at_most(spark, monkeypatch):
    """A family on one template, each unlike the others by a fourth, with a few similar pairs in it."""
    held, confirm = [], near_dedup._confirm

    def counting(rows, similar, name):
        rows = near_dedup.written(rows, "rows")
        held.append((name, max([r["count"] for r in rows.groupBy("block").count().collect()], default=0)))
        return confirm(rows, similar, name)

    monkeypatch.setattr(near_dedup, "DENSE", 1)
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 8)
    monkeypatch.setattr(near_dedup, "_confirm", counting)
    common = [f"c{j}" for j in range(60)]
    texts = {i: " ".join(common + [f"d{i}w{j}" for j in range(20)]) for i in range(120)}
    texts |= {i + 120: texts[i] + f" more{i}" for i in range(0, 120, 6)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 1, 85).collect()}
    assert got == brute_components(texts, 1, 85)
    inside, rest = (dict(held)[name] for name in ("inside", "rest"))
    assert rest <= 2 * inside


def test_forest_is_sized_for_the_similarity():
    for similar in (50, 70, 80, 85, 95, 100):
        trees, depth = near_dedup.forest(similar)
        assert trees * depth <= near_dedup.N and (1 - (similar / 100) ** depth) ** trees <= near_dedup.MISS
    assert near_dedup.forest(85) == (16, 4) and near_dedup.forest(80) == (22, 4)


def test_packing(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    got = packing.pack(packing.tokenize(docs, size=512), size=512).toPandas()
    for i, t in texts.items():
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        mine = got[got.doc_id == i].sort_values("piece")
        assert [(r.start, r.length, r.ids_crc32) for r in mine.itertuples()] == [(o, len(ids[o:o + 512]), zlib.crc32(ids[o:o + 512].tobytes())) for o in range(0, len(ids), 512)]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.concatenate([[0], s.length.cumsum()[:-1]])).all() and s.length.sum() <= 512
    assert got.sequence_id.nunique() <= 1.05 * np.ceil(got.length.sum() / 512) + 1
    assert packing.pack(packing.tokenize(docs.limit(0))).count() == 0


def test_classifier(spark):
    rnd = random.Random(1)
    good = [(i, " ".join(rnd.choice("the of and with from one two".split()) for _ in range(60)), "own") for i in range(60)]
    bad = [(i, " ".join(rnd.choice("BUY!! NOW!! ### ***".split()) for _ in range(60)), "own") for i in range(60, 80)] + [(80, None, "own"), (81, "", "own")]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, log_weight string")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 80, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = importance.classify(docs, labels)
    assert {r.doc_id for r in kept.collect()} == set(range(60)) and kept.columns == docs.columns
    assert importance.classify(docs, labels.limit(0)).count() == 80
    scored = importance.score(docs, importance.fit(docs, labels), "doc_id")
    assert importance.resample(scored, 10).where("drawn").count() == 10


def test_weights_and_draw_against_brute_force(spark):
    """Both models counted gram by gram, the weights from them, and the draw by sorting all keys."""
    rnd = random.Random(5)
    texts = {i: " ".join(rnd.choice("The of and with from ONE two café ## !! 12".split()) for _ in range(rnd.randint(1, 50))) for i in range(200)}
    texts |= {200: None, 201: "", 202: " \n\t"}
    docs = spark.createDataFrame([*texts.items(), (None, "of and of")], "doc_id long, text string")
    good = {i for i in range(0, 120, 3)}
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    model = importance.fit(docs, labels, buckets=512)

    def cells(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return importance._ngram_cells(raw, np.array([0, len(raw)]), 512)[0].tolist()

    raw, target = Counter(cells("of and of")), Counter()
    for i, text in texts.items():
        raw.update(cells(text))
        target.update(cells(text) if i in good else ())
    ratio = {c: np.log((target[c] + 1) / (sum(target.values()) + 512)) - np.log((raw[c] + 1) / (sum(raw.values()) + 512)) for c in range(512)}
    scored = importance.score(docs, model, "doc_id")
    rows = importance.resample(scored, 40).withColumn("h", F.xxhash64("doc_id", F.lit(importance.SEED))).collect()
    assert len(rows) == 204
    keys = {}
    for r in rows:
        grams = cells("of and of" if r.doc_id is None else texts[r.doc_id])
        assert r.n_grams == len(grams) and abs(r.log_weight - sum(ratio[c] for c in grams)) < 1e-9
        if r.doc_id is not None:
            keys[r.doc_id] = r.log_weight - np.log(-np.log((r.h % (1 << 52) + 0.5) / (1 << 52)))
            assert abs(keys[r.doc_id] - r.gumbel_key) < 1e-9
    assert {r.doc_id for r in rows if r.drawn} == set(sorted(keys, key=lambda i: (-keys[i], i))[:40])
    kept = {r.doc_id for r in scored.where(importance.accepted(model)).collect()}
    assert kept == {r.doc_id for r in rows if r.n_grams and r.log_weight / r.n_grams >= model.cut}


def test_archives(spark):
    rows = [(1, "http://a.org/x", "<p>é"), (2, "https://www.A.org:443/x#y", "<p>é"), (3, None, None), (4, "http://b.org/%0A\r\n", ""), (5, "http://a.org/x", "z" * 200_000)]
    history = warc.archive_and_index(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in history:
        url, html = next((u, h or "") for i, u, h in rows if i == r.page_id)
        assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(html.encode()), base64.b32encode(hashlib.sha1(html.encode()).digest()).decode())
    assert {r.page_id: r.refers_to for r in history} == {1: None, 2: 1, 3: None, 4: 3, 5: None}
    assert warc.archive_and_index(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_loser_tree():
    rnd = random.Random(2)
    for k in range(1, 12):
        runs = [sorted(rnd.randint(0, 50) for _ in range(rnd.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = [list(map(float, v)) for v in rng.normal(size=(400, 8))]
    x[100:200] = [x[0]] * 100
    rows = list(enumerate(x)) + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0]), (None, x[5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(vectors, vectors.where("vec_id % 50 = 0")).toPandas()
    a, ids = np.array(x), np.arange(400)
    unit = a / np.linalg.norm(a, axis=1, keepdims=True)
    for q in range(0, 400, 50):
        s = np.round(unit @ unit[q], 12)
        s[q] = -2
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == np.lexsort((ids, -s))[:5].tolist()
    assert neighbours.search(vectors.limit(0), vectors).count() == 0


def test_edits_keep_counts():
    rnd, count = random.Random(4), tokencount.counter()
    letters = "ab cA'sdtl.,!019  \n\té가"
    for _ in range(300):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))
        tree = tokencount.SegmentTree(text, count, leaf=4)
        for _ in range(4):
            start, gone, new = rnd.randint(0, len(text)), rnd.randint(0, 5), "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 4)))
            tree.edit(start, gone, new)
            text = text[:start] + new + text[start + gone:]
            assert tree.text == text and tree.tokens == len(count.encoding.encode_ordinary(text))


def test_packed_leaves():
    for lengths, tokens in [([], []), ([1, 31, 4], [1, 7, 1]), ([32, 1, 70_000, 5], [1, 1, 30_000, 8]), ([5, 256], [1, 256])]:
        assert tokencount.unpacked(tokencount.packed(lengths, tokens)) == (lengths, tokens)


def edited_text(text, edits):
    for e in edits or ():
        start = min(max(e.start or 0, 0), len(text))
        text = text[:start] + (e.inserted or "") + text[start + max(e.removed or 0, 0):]
    return text


def test_kept_trees_follow_edits(docs, tmp_path):
    """Two rounds of edits on written trees: every count equals a recount of the whole text, and only touched pre-tokens are encoded."""
    count = tokencount.counter().encoding
    size = lambda text: len(count.encode_ordinary(text))
    rows = docs.select("doc_id", "text").withColumn("n_pretokens", F.lit("own"))
    tokencount.build(rows).write.parquet(str(tmp_path / "0"))
    for turn in range(2):
        trees = tokencount.with_sample_edits(docs.sparkSession.read.parquet(str(tmp_path / str(turn))))
        want = sorted((r.doc_id, size(r.text or ""), size(edited_text(r.text or "", r.edits)), edited_text(r.text or "", r.edits)) for r in trees.collect())
        tokencount.apply_edits(trees).write.parquet(str(tmp_path / str(turn + 1)))
        got = docs.sparkSession.read.parquet(str(tmp_path / str(turn + 1))).collect()
        assert sorted((r.doc_id, r.tokens_before, r.tokens_after, r.text) for r in got) == want
        assert all(r.n_edits == 4 and [sum(x) for x in tokencount.unpacked(bytes(r._tc_leaves))] == [len(r.text), r.tokens_after] for r in got)
        assert all(r.pretokens_encoded < 60 for r in got if r.doc_id == 94)


def test_trees_absent_or_out_of_date_are_built_anew(spark):
    schema = "doc_id long, text string, edits array<struct<start int, removed int, inserted string>>, _tc_leaves binary"
    rows = [(1, "one two three", [(0, 0, "x ")], None), (2, "one two three", None, b"\x09"), (3, None, None, None), (4, None, [(5, 2, "new")], b""),
            (5, "a b", [(None, None, None), (-3, -1, "c"), (99, 9, "d")], tokencount.packed([1, 2], [1, 1]))]
    got = {r.doc_id: r for r in tokencount.apply_edits(spark.createDataFrame(rows, schema)).collect()}
    assert [got[i].text for i in range(1, 6)] == ["x one two three", "one two three", None, "new", "ca bd"]
    assert (got[2].pretokens_encoded, got[2].tokens_before, got[3].tokens_after, got[4].tokens_before) == (3, 3, 0, 0)
    assert all(r.tokens_after == len(tokencount.counter().encoding.encode_ordinary(r.text or "")) for r in got.values())
    assert tokencount.apply_edits(tokencount.with_sample_edits(tokencount.build(spark.createDataFrame([], "doc_id long, text string")))).count() == 0


def test_pieces_equal_the_library(spark, docs, texts):
    model = pieces.vocabulary().model
    for r in pieces.encode(docs.select("doc_id", "text")).collect():
        assert np.frombuffer(r.piece_ids, "<u4").tolist() == model.encode(texts[r.doc_id] or "")
    assert all(r.decoded == (texts[r.doc_id] or "") for r in pieces.decode(pieces.encode(docs.select("doc_id", "text"))).collect())
    plain = docs.select("doc_id", "text")
    rows = lambda d: sorted(map(tuple, d.select("doc_id", "n_pieces", "ids_crc32", "decoded").collect()))
    assert rows(pieces.round_trip(plain)) == rows(pieces.decode(pieces.encode(plain)))
    odd = ["a" * 500, "ab" * 900 + " " * 40, "▁▁x <s> \x00 가\U0001f600"]
    assert [np.frombuffer(x, "<u4").tolist() for x in pieces.vocabulary().encode_all(odd)] == [model.encode(x) for x in odd]


def test_main_text(spark):
    page = ("<html><head><title>t</title></head><body><nav>menu</nav><div class='{c}'>{n}</div><article><h1>T{i}</h1><p>A&amp;B <b>c</b>d<br>e<p>x &#233;"
            "<div class=comments>no</div></article><footer>f</footer></body>")
    rows = [(i, f"http://h.org/{i}", page.format(c="ad", n=i, i=i)) for i in range(5)]
    rows += [(10 + i, f"http://g.org/{i}", f"<body><div class=top>Same on all</div><div class=txt><p>Text {i} {'w ' * i}</p></div>") for i in range(12)]
    rows += [(30, None, None), (31, "odd", "<p>a<"), (32, "http://h.org", "")]
    got = {r.page_id: r.text for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "T3 A&B cd e x é" and got[12] == "Text 2 w w" and got[30] == "" and got[31] == "a<"


@pytest.mark.parametrize("page, want", [
    ("<body><div class='layout has-sidebar'><article><p>Text here</p></article></div>", "Text here"),
    ("<body><article class='post has-related'><p>Text here</p><div class=related>no</div></article>", "Text here"),
    ("<body><form id=f><article><p>Text here</p></article></form>", "Text here"),
    ("<body><article><form><p>Text here</p></form></article>", "Text here"),
    ("<body><div class=sidebar><p>Text here</p></div>", "Text here"),
    ("<body><article><h2 id='related-work'>Related work</h2><section id='social-impact'><p>Text</p></section><h2 id=search>Search</h2></article>", "Related work Text Search"),
    ("<body><article><p>Before</p><svg><p>After</p></article>", "Before After"),
    ("<body><article><p>Let <math><mi>x</mi><annotation>no</annotation></math> be</p></article>", "Let x be"),
    ("<body><article><p>Short</p><div class=comments><p>Much longer words of readers</p></div></article><nav>menu</nav>", "Short"),
    ("<body><div>A page whose text stands in no paragraph</div><footer><p>Copyright</p></footer>", "A page whose text stands in no paragraph"),
])
def test_names_never_cut_the_article(page, want):
    assert sitetree.main_text(page) == want


LONG = " ".join(f"word{i}" for i in range(60))


@pytest.mark.parametrize("page, want", [
    ("<body><article><p>Text</p><section id=comments><h2>Readers</h2><p>no</p></section></article>", "Text"),
    ("<body><article><p>Text</p></article><ol class='comment-list'><li>no</ol>", "Text"),
    ("<body><div class=post><p>Text of the page</p><ol class=commentlist><li>no</ol><div id='comments-area'>no</div></div>", "Text of the page"),
    ("<body><article><p>Text</p></article><article class='comment-body'><p>no</p></article>", "Text"),
    ("<body><article><p>Text</p><div class='ad-slot'>no</div><p>on</p></article>", "Text on"),
    (f"<body><div class='sidebar-left'>no</div><div><p>{LONG}</p></div><div class='site-footer'>no</div><div class='cookie-banner'>no</div>", LONG),
    (f"<body><article><p>{LONG}</p></article><div class=more><article><h3><a href=x>Other</a></h3><p>teaser</p></article></div>", LONG),
    (f"<body><article><p>{LONG}</p><div class=more><article><h3>Other</h3><p>teaser</p></article></div></article>", LONG),
    (f"<body><article><p>One</p></article><article><p>{LONG}</p></article>", f"One {LONG}"),
    (f"<body><div><h1>Head</h1><p>Short text</p></div><aside><p>{LONG}</p></aside><footer><p>{LONG}</p></footer>", "Head Short text"),
    (f"<body><div><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul></div><div><h1>Head</h1><p>{LONG}</p></div>", f"Head {LONG}"),
    (f"<body class='search'><article><h2 id='comment-on-method'>Comment on method</h2><p>{LONG}</p></article>", f"Comment on method {LONG}"),
    ("<body><article><p title='a>b'>x<p title=\"un>closed</p></article>", "x closed"),
    ("<body><article><p>a</p><!-- never closed <p>b</p></article>", "a"),
])
def test_articles_among_comments_adverts_and_teasers(page, want):
    assert sitetree.main_text(page) == want


@pytest.mark.parametrize("unit", ["<a ", "<a \"", "<a x=\">\" ", "<svg>", "<b></i>", "<div>", "</div>", "<b><hr>", "<li><ul><b>", "<!-", "<!", "<", "a=\"<p x='", "<header><h1>"])
def test_long_broken_pages_take_linear_time(unit):
    start = time.process_time()
    sitetree.main_text(unit * (400_000 // len(unit)))
    assert time.process_time() - start < 10


def test_style_tree_chooses_the_article_of_hosts_without_one(spark):
    """Unnamed menus, notices and footers go by their low importance; the tree changes every page of such a host."""
    page = ("<body><div class=a1><p>Welcome to our pages</p><p>Read them all</p></div><div class=b2><div class=c3><h1>Head {i}</h1><p>Text {i} {w}</p></div>"
            "<div class=d4><p>Write to us</p></div></div><div class=e5><p>All rights are ours</p></div>")
    rows = [(i, f"http://t.org/{i}", page.format(i=i, w="more words " * (i % 5 + 1))) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in sitetree.extract(pages).collect()}
    assert got == {i: f"Head {i} Text {i} {'more words ' * (i % 5 + 1)}".strip() for i, _, _ in rows}
    assert all(sitetree.main_text(h) != got[i] for i, _, h in rows)


def test_pages_empty_and_clashing(spark):
    schema = "page_id long, url string, html string, text string, low string, n_pages int, host string"
    assert sitetree.extract(spark.createDataFrame([], schema)).count() == 0
    got = sitetree.extract(spark.createDataFrame([(None, None, "<article><p>x</p></article>", "own", "l", 3, "h")] * 2, schema)).collect()
    assert [(r.page_id, r.text, r.low, r.n_pages, r.host) for r in got] == [(None, "x", "l", 3, "h")] * 2


def shared_lines_out(texts):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    return {i: "\n".join(x for x in (t or "").split("\n") if not key(x) or len(holders[key(x)]) < 10) for i, t in texts.items()}


def test_pipeline_stages(spark, tmp_path):
    """Each stage on what the one before kept: the two classifiers against their own verdicts row by row, lines and copies against brute force."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, folder)
        assert done.columns == docs.columns, name
        done.write.parquet(str(tmp_path / name))
        after = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / name)).collect()}
        if name == "quality_classifier":
            model = importance.fit(docs, labels)
            want = {r.doc_id for r in importance.score(docs, model, "doc_id").collect() if r.n_grams and (model.cut is None or r.log_weight / r.n_grams >= model.cut)}
            assert after == {i: before[i] for i in want}
            known = {r.doc_id for r in labels.where("quality = 1").collect()} & set(before)
            assert len(known & want) >= 0.9 * len(known)
        elif name == "line_dedup":
            assert after == shared_lines_out(before)
        elif name == "near_dedup":  # exactly one document of each group stays
            assert after == {i: before[i] for i, (_, c) in brute_components(before, 5, 80).items() if c == i}
        else:
            assert all(len(WORD.findall(t or "")) >= 50 for t in after.values())
            assert after == {r.doc_id: before[r.doc_id] for r in quality_rules.evaluate(docs).where("kept").collect()}
        docs, before = spark.read.parquet(str(tmp_path / name)), after
    packed = corpus_pipeline.run(spark, folder).toPandas()
    assert set(packed.doc_id) == set(before)
